"""Column helpers: banding, mapping, cleaning, dates, JSON, keys.  All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import quantiles


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(rules: list[tuple[Column, object]], default=None) -> Column:
    """Searched CASE: the label of the first rule that holds; null conditions do not hold."""
    out = None
    for condition, label in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(default) if out is None else out.otherwise(default)


def value_map(c, mapping: dict, default=None) -> Column:
    """Codes to names; unmapped values and nulls give ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(default)) if pairs else F.lit(default)


def with_columns(df: DataFrame, exprs: dict) -> DataFrame:
    """Add columns in order; a later one may use an earlier one."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.expr(kv[1]) if isinstance(kv[1], str) else kv[1]), exprs.items(), df)


def cut(c, edges: list, labels: list[str]) -> Column:
    """Right-closed bins: edges[i] < value <= edges[i+1]; outside and null give null."""
    return band([((col(c) > low) & (col(c) <= high), label) for low, high, label in zip(edges, edges[1:], labels)])


def qcut(df: DataFrame, c: str, labels: list[str], out: str) -> DataFrame:
    """Equal-frequency bins with exact interpolated edges; the smallest value is in the first bin."""
    q = len(labels)
    edges = quantiles(df, c, [i / q for i in range(1, q)], out="_edges")
    joined = df.crossJoin(F.broadcast(edges))  # one row
    rules = [(F.col(c) <= F.col("_edges")[i], label) for i, label in enumerate(labels[:-1])]
    return joined.withColumn(out, F.when(F.col(c).isNotNull(), band(rules, labels[-1]))).drop("_edges")


def clip(c, low, high) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def str_clean(c, steps: list) -> Column:
    """Apply steps in order: 'trim', 'upper', 'lower', 'title' or ('replace', old, new)."""
    out = col(c)
    for step in steps:
        if isinstance(step, tuple):
            out = F.replace(out, F.lit(step[1]), F.lit(step[2]))
        else:
            out = {"trim": F.trim, "upper": F.upper, "lower": F.lower, "title": F.initcap}[step](out)
    return out


def label(parts: list, sep: str = " ") -> Column:
    """Join parts to one string; nulls are left out."""
    return F.concat_ws(sep, *(col(p).cast("string") if not isinstance(p, str) else F.col(p).cast("string") for p in parts))


def regex_clean(c, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, col(c))


def extract_cols(df: DataFrame, c: str, pattern: str, names: list[str]) -> DataFrame:
    """Groups of a pattern as columns; no match gives null."""
    return df.withColumns({n: F.nullif(F.regexp_extract(F.col(c), pattern, i), F.lit("")) for i, n in enumerate(names, 1)})


def find_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def cast_safe(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; text that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def null_if(c, placeholders: list, default=None) -> Column:
    """Placeholders count as null; null becomes ``default``."""
    return F.coalesce(F.when(~col(c).isin(placeholders), col(c)), F.lit(default))


def parse_date(c, formats: list[str]) -> Column:
    """The first format that parses."""
    return F.coalesce(*(F.try_to_date(col(c), f) for f in formats))


def date_parts(c, parts: list[str]) -> dict[str, Column]:
    make = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth,
        "day_name": lambda x: F.date_format(x, "EEEE"), "month_name": lambda x: F.date_format(x, "MMMM"),
    }
    return {p: make[p](col(c)) for p in parts}


def bucket(df: DataFrame, c: str, unit: str = "month", fmt: str = "yyyy-MM", out: str = "bucket") -> DataFrame:
    """The first day of the period that a date is in, and its label in the given format."""
    start = F.date_trunc(unit, F.col(c))
    return df.withColumns({out: start.cast("date"), f"{out}_label": F.date_format(start, fmt)})


def explode_array(df: DataFrame, c, out: str, keep_empty: bool = False) -> DataFrame:
    """Elements of an array column, or of an array of literals, as rows; null and empty arrays give a row with null if ``keep_empty``, else none."""
    elements = F.array(*(F.lit(x) for x in c)) if isinstance(c, (list, tuple)) else col(c)
    return df.withColumn(out, (F.explode_outer if keep_empty else F.explode)(elements))


def diff(a, b, unit: str) -> Column:
    """b - a in days, hours, minutes, months or whole years."""
    a, b = col(a), col(b)
    seconds = F.unix_timestamp(b) - F.unix_timestamp(a)
    return {"days": F.datediff(b, a), "hours": seconds / 3600, "minutes": seconds / 60, "months": F.months_between(b, a), "years": F.floor(F.months_between(b, a) / 12)}[unit]


def convert_tz(c, source: str, target: str) -> Column:
    return F.from_utc_timestamp(F.to_utc_timestamp(col(c), source), target)


def calendar(spark: SparkSession, start: str, end: str, step: str = "1 day", business: bool = False) -> DataFrame:
    """One row for each date from start to end; ``business`` leaves weekends out."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {step})")).alias("d"))
    return days.where(F.weekday("d") < 5) if business else days


def calendar_of(df: DataFrame, c: str, step: str = "1 day", business: bool = False) -> DataFrame:
    """One row for each day, or first of a month, from the least to the largest date of a column."""
    low, high = F.min(c).cast("date"), F.max(c).cast("date")
    ends = df.agg((F.trunc(low, "month") if "month" in step else low).alias("low"), high.alias("high"))
    days = ends.select(F.explode(F.expr(f"sequence(low, high, interval {step})")).alias("d"))
    return days.where(F.weekday("d") < 5) if business else days


def json_get(c, fields: dict[str, str]) -> dict[str, Column]:
    return {out: F.get_json_object(col(c), path) for out, path in fields.items()}


def json_explode(df: DataFrame, c: str, path: str, element: str, out: str) -> DataFrame:
    """A JSON array as rows; rows whose array is null or empty give none."""
    return df.withColumn(out, F.explode(F.from_json(F.get_json_object(F.col(c), path), f"array<{element}>")))


def hash_key(cols: list, sep: str = "||") -> Column:
    """md5 business key; the separator keeps ('ab','c') and ('a','bc') apart, also where values hold it, and null differs from ''."""
    return F.md5(_joined(cols, sep))


def _joined(cols: list, sep: str) -> Column:
    mark = sep[0]
    escaped = lambda c: F.replace(F.replace(col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit("\\" + mark))
    return F.concat_ws(sep, *(F.coalesce(escaped(c), F.lit("\x00")) for c in cols))


def row_checksum(cols: list, sep: str = "||") -> Column:
    return F.sha2(_joined(cols, sep), 256)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sum_if(condition: Column, value) -> Column:
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0))


def rate_pct(part: Column, whole: Column, scale: int = 2) -> Column:
    """100 * part / whole; a zero whole gives null."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), scale)


def nullify_outside(c, low, high) -> Column:
    return F.when(col(c).between(low, high), col(c))


def enforce_domain(c, allowed: list, default=None) -> Column:
    return F.when(col(c).isin(allowed), col(c)).otherwise(F.lit(default))
