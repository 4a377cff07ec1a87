"""Rows of a Spark and a DuckDB result in a form that compares."""


def cell(v):
    if v is None or v != v:
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same_rows(spark_df, duck, sql):
    cols = sorted(spark_df.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in spark_df.collect())
    names = [d[0] for d in duck.execute(sql).description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(cell(r[k]) for k in at) for r in duck.execute(sql).fetchall())
    assert got == want
    return len(got)
