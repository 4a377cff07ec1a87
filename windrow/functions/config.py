"""Scalar functions for settings: sizes, durations, lists, bytes. What cannot be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of memory and their bytes. Fixed values.
MEMORY_UNITS = {
    "b": 1, "bytes": 1,
    "k": 1 << 10, "kb": 1 << 10, "kibibytes": 1 << 10,
    "m": 1 << 20, "mb": 1 << 20, "mebibytes": 1 << 20,
    "g": 1 << 30, "gb": 1 << 30, "gibibytes": 1 << 30,
    "t": 1 << 40, "tb": 1 << 40, "tebibytes": 1 << 40,
}
#: Units of time and their nanoseconds. Fixed values.
TIME_UNITS = {
    "d": 86_400_000_000_000, "day": 86_400_000_000_000, "days": 86_400_000_000_000,
    "h": 3_600_000_000_000, "hour": 3_600_000_000_000, "hours": 3_600_000_000_000,
    "min": 60_000_000_000, "minute": 60_000_000_000, "minutes": 60_000_000_000,
    "s": 1_000_000_000, "sec": 1_000_000_000, "secs": 1_000_000_000, "second": 1_000_000_000, "seconds": 1_000_000_000,
    "ms": 1_000_000, "milli": 1_000_000, "millis": 1_000_000, "millisecond": 1_000_000, "milliseconds": 1_000_000,
    "µs": 1_000, "micro": 1_000, "micros": 1_000, "microsecond": 1_000, "microseconds": 1_000,
    "ns": 1, "nano": 1, "nanos": 1, "nanosecond": 1, "nanoseconds": 1,
}

_AMOUNT = r"^\s*([0-9]+)\s*([^\s0-9].*?)?\s*$"


def _amount(text: Column, units: dict[str, int], default: int) -> Column:
    number = F.nullif(F.regexp_extract(text, _AMOUNT, 1), F.lit("")).try_cast("long")
    unit = F.lower(F.regexp_extract(text, _AMOUNT, 2))
    factor = F.when(unit == "", F.lit(default).cast("long"))
    for u, n in units.items():
        factor = factor.when(unit == u, F.lit(n).cast("long"))
    return F.try_multiply(number, factor)


def memory_bytes(text: Column) -> Column:
    """``10``, ``10 kb``, ``1G``: bytes; a number alone is bytes."""
    return _amount(text, MEMORY_UNITS, 1)


def duration_nanos(text: Column) -> Column:
    """``321 s``, ``5min``: nanoseconds; a number alone is milliseconds."""
    return _amount(text, TIME_UNITS, 1_000_000)


def split_quoted(text: Column, delimiter: str = ";") -> Column:
    """Split where the delimiter is not within single or double quotes; a doubled quote within
    quotes is one. Two delimiters with nothing between them, or an empty pair of quotes, are an
    empty item; one at the start or end is none. An open quote, or text behind a closed one, makes
    the whole list null."""
    d = "\\" + delimiter
    single, double = r"'[^']*+(?:''[^']*+)*+'", r'"[^"]*+(?:""[^"]*+)*+"'
    token = rf"""{single}|{double}|{d}|[^\s{d}'"][^{d}]*+"""
    tokens = F.regexp_extract_all(text, F.lit(rf"({token})"), F.lit(1))
    is_quoted = lambda x: x.startswith("'") | x.startswith('"')
    inside = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    item = lambda x: (
        F.when(x.startswith("'"), F.replace(inside(x), F.lit("''"), F.lit("'")))
        .when(x.startswith('"'), F.replace(inside(x), F.lit('""'), F.lit('"')))
        .otherwise(F.regexp_replace(x, r"\s+$", ""))
    )
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    broken = F.exists(pairs, lambda p: is_quoted(p["x"]) & F.coalesce(p["y"] != delimiter, F.lit(False)))
    kept = F.filter(pairs, lambda p: (p["x"] != delimiter) | F.coalesce(p["y"] == delimiter, F.lit(False)))
    items = F.transform(kept, lambda p: F.when(p["x"] == delimiter, F.lit("")).otherwise(item(p["x"])))
    return F.when(text.rlike(rf"^(?:\s*+(?:{token}))*+\s*+$") & ~broken, items)


def quoted(text: Column, delimiter: str = ";") -> Column:
    """The inverse for one item: in single quotes if it has a quote or the delimiter."""
    needs = text.contains("'") | text.contains('"') | text.contains(delimiter)
    return F.when(needs, F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(text)


def data_dirs(text: Column) -> Column:
    """``[SSD]/a,[HDD]/b,/c``: an array of structs ``medium, path``, with HDD where none is named."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")

    def one(x: Column) -> Column:
        path = F.regexp_replace(x, r"^\[(SSD|HDD)\]", "")
        return F.struct(F.when(x.startswith("[SSD]"), "SSD").otherwise("HDD").alias("medium"), F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/"))).alias("path"))

    return F.transform(items, one)


def with_length(payload: Column) -> Column:
    """Bytes after their length in four bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(payload).cast("long")), 8, "0")), payload)


def human_bytes(n: Column) -> Column:
    """A size in the largest unit that leaves at least 1, with two decimals."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for unit, k in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("tb", 1 << 40)):
        out = F.when(n >= k, F.concat(F.format_string("%.2f", n / k), F.lit(f" {unit}"))).otherwise(out)
    return out


def split_framed(payload: Column) -> Column:
    """The pieces of bytes in which each piece follows its length in four bytes; null if they don't come out even."""

    def step(acc: Column, _: Column) -> Column:
        size = F.conv(F.hex(F.substring(payload, acc["at"], F.lit(4))), 16, 10).cast("int")
        piece = F.substring(payload, acc["at"] + 4, size)
        more = F.struct((acc["at"] + 4 + size).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
        return F.when(acc["at"] + 3 <= F.octet_length(payload), more).otherwise(acc)

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<binary>").alias("out"))
    most = F.floor(F.octet_length(payload) / 4).cast("int")
    done = F.aggregate(F.sequence(F.lit(0), most), start, step, lambda s: F.when(s["at"] == F.octet_length(payload) + 1, s["out"]))
    return done
