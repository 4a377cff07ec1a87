"""Typed tables over delimited files: a sink of one number and four tables of a public retail benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

from windrow.sources.files import DELIMITER

#: Columns by table. Fixed values.
TABLES = {
    "result_table": "res BIGINT",
    "store_sales": """
        ss_sold_date_sk BIGINT, ss_sold_time_sk BIGINT, ss_item_sk BIGINT, ss_customer_sk BIGINT, ss_cdemo_sk BIGINT, ss_hdemo_sk BIGINT, ss_addr_sk BIGINT,
        ss_store_sk BIGINT, ss_promo_sk BIGINT, ss_ticket_number BIGINT, ss_quantity BIGINT, ss_wholesale_cost DOUBLE, ss_list_price DOUBLE,
        ss_sales_price DOUBLE, ss_ext_discount_amt DOUBLE, ss_ext_sales_price DOUBLE, ss_ext_wholesale_cost DOUBLE, ss_ext_list_price DOUBLE,
        ss_ext_tax DOUBLE, ss_coupon_amt DOUBLE, ss_net_paid DOUBLE, ss_net_paid_inc_tax DOUBLE, ss_net_profit DOUBLE""",
    "web_sales": """
        ws_sold_date_sk BIGINT, ws_sold_time_sk BIGINT, ws_ship_date_sk BIGINT, ws_item_sk BIGINT, ws_bill_customer_sk BIGINT, ws_bill_cdemo_sk BIGINT,
        ws_bill_hdemo_sk BIGINT, ws_bill_addr_sk BIGINT, ws_ship_customer_sk BIGINT, ws_ship_cdemo_sk BIGINT, ws_ship_hdemo_sk BIGINT,
        ws_ship_addr_sk BIGINT, ws_web_page_sk BIGINT, ws_web_site_sk BIGINT, ws_ship_mode_sk BIGINT, ws_warehouse_sk BIGINT, ws_promo_sk BIGINT,
        ws_order_number BIGINT, ws_quantity BIGINT, ws_wholesale_cost DOUBLE, ws_list_price DOUBLE, ws_sales_price DOUBLE, ws_ext_discount_amt DOUBLE,
        ws_ext_sales_price DOUBLE, ws_ext_wholesale_cost DOUBLE, ws_ext_list_price DOUBLE, ws_ext_tax DOUBLE, ws_coupon_amt DOUBLE,
        ws_ext_ship_cost DOUBLE, ws_net_paid DOUBLE, ws_net_paid_inc_tax DOUBLE, ws_net_paid_inc_ship DOUBLE, ws_net_paid_inc_ship_tax DOUBLE, ws_net_profit DOUBLE""",
    "item": """
        i_item_sk BIGINT, i_item_id STRING, i_rec_start_date STRING, i_rec_end_date STRING, i_item_desc STRING, i_current_price DOUBLE,
        i_wholesale_cost DOUBLE, i_brand_id BIGINT, i_brand STRING, i_class_id BIGINT, i_class STRING, i_category_id BIGINT, i_category STRING,
        i_manufact_id BIGINT, i_manufact STRING, i_size STRING, i_formulation STRING, i_color STRING, i_units STRING, i_container STRING,
        i_manager_id BIGINT, i_product_name STRING""",
    "date_dim": """
        d_date_sk BIGINT, d_date_id STRING, d_date STRING, d_month_seq BIGINT, d_week_seq BIGINT, d_quarter_seq BIGINT, d_year BIGINT, d_dow BIGINT,
        d_moy BIGINT, d_dom BIGINT, d_qoy BIGINT, d_fy_year BIGINT, d_fy_quarter_seq BIGINT, d_fy_week_seq BIGINT, d_day_name STRING,
        d_quarter_name STRING, d_holiday STRING, d_weekend STRING, d_following_holiday STRING, d_first_dom BIGINT, d_last_dom BIGINT,
        d_same_day_ly BIGINT, d_same_day_lq BIGINT, d_current_day STRING, d_current_week STRING, d_current_month STRING, d_current_quarter STRING,
        d_current_year STRING""",
}


def create_table(spark: SparkSession, kind: str, name: str, path: str) -> None:
    """A table of one of ``TABLES`` over delimited files; a field that can't be read is null."""
    spark.sql(f"CREATE TABLE {name} ({TABLES[kind]}) USING csv OPTIONS (sep '{DELIMITER}', mode 'PERMISSIVE') LOCATION '{path}'")
