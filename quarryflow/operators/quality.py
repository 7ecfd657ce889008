"""Profiling, duplicates, outliers and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import medians, quantiles


def null_profile(df: DataFrame, by: str | None = None) -> DataFrame:
    """Null count and percent of each column (per group of ``by``), one pass over the data."""
    columns = [c for c in df.columns if c != by]
    grouped = df.groupBy(by) if by else df.groupBy()
    one = grouped.agg(F.count("*").alias("_n"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns))
    x = one.select(*([by] if by else []), "_n", F.explode(rows).alias("r"))
    return x.select(*([by] if by else []), "r.column_name", "r.nulls", F.round(F.try_divide(100.0 * F.col("r.nulls"), F.col("_n")), 2).alias("pct"))


def dedup_latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in the order given; end it with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dup_report(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outliers(df: DataFrame, c: str, method: str = "iqr", k: float | None = None, out: str = "outlier") -> DataFrame:
    """Flag values outside the quartile fences (k = 1.5) or beyond k standard deviations (k = 3)."""
    if method == "iqr":
        limits = quantiles(df, c, [0.25, 0.75], out="_q")
        k = 1.5 if k is None else k
        spread = F.col("_q")[1] - F.col("_q")[0]
        flag = (F.col(c) < F.col("_q")[0] - k * spread) | (F.col(c) > F.col("_q")[1] + k * spread)
    else:
        limits = df.agg(F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias("_q"))
        flag = F.abs(F.col(c) - F.col("_q.m")) > (3.0 if k is None else k) * F.col("_q.s")
    return df.crossJoin(F.broadcast(limits)).withColumn(out, F.coalesce(flag, F.lit(False))).drop("_q")  # one row


def validate_split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): rejected rows carry the names of the rules they break in ``errors``, joined in ``reason``; a null condition is broken.

    Clean rows keep all their columns; of rejected ones, columns of these two names are replaced.
    """
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    x = df.withColumn("_broken", broken)
    return x.where(F.size("_broken") == 0).drop("_broken"), x.where(F.size("_broken") > 0).withColumns({"errors": F.col("_broken"), "reason": F.concat_ws("; ", "_broken")}).drop("_broken")


def handle_nulls(df: DataFrame, drop: list[str] = (), flag: list[str] = (), fill: dict | None = None) -> DataFrame:
    """Nulls by column: rows of ``drop`` go, ``flag`` adds <c>_was_null, ``fill`` gives a value, or ("mean" | "median", group column or None).

    A group without any value keeps its nulls.
    """
    df = df.dropna(subset=list(drop)) if drop else df
    df = df.withColumns({f"{c}_was_null": F.col(c).isNull() for c in flag}) if flag else df
    for c, how in (fill or {}).items():
        if not isinstance(how, tuple):
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(how)))
            continue
        kind, group = how
        if group is None:
            one = df.agg(F.avg(c).alias("_fill")) if kind == "mean" else quantiles(df, c, [0.5], out="_fill").select(F.col("_fill")[0].alias("_fill"))
            df = df.crossJoin(F.broadcast(one))  # one row
        else:
            per = df.groupBy(group).agg(F.avg(c).alias("_fill")) if kind == "mean" else medians(df, [group], c, "_fill")
            df = df.join(per.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
        df = df.withColumn(c, F.coalesce(c, "_fill")).drop("_fill")
    return df


def parity(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """One row: rows where two expressions differ (nulls are equal), all rows, and the smallest key that differs."""
    differ = ~a.eqNullSafe(b)
    x = df.select(F.col(key).alias("_key"), differ.alias("_differ"))
    return x.agg(F.count(F.when(F.col("_differ"), 1)).alias("mismatches"), F.count("*").alias("n"), F.min(F.when(F.col("_differ"), F.col("_key"))).alias("first_key"))


def check(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), conditions: dict[str, Column] | None = None, same_rows_as: DataFrame | None = None) -> DataFrame:
    """Violations of each rule, one row each: not empty, not null, conditions (null passes, as in SQL), unique keys, the row count of another table."""
    names = {f"not_null:{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in not_null}
    names |= {f"check:{n}": F.count(F.when(~c, 1)) for n, c in (conditions or {}).items()}
    one = df.agg(F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("not_empty"), *(c.alias(n) for n, c in names.items()))
    report = one.unpivot([], ["not_empty", *(f"`{n}`" for n in names)], "rule", "violations")
    for keys in unique:
        dup = dup_report(df.dropna(subset=keys), keys).agg(F.lit("unique:" + ",".join(keys)).alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        report = report.unionByName(dup)
    if same_rows_as is not None:
        both = df.agg(F.count("*").alias("_a")).crossJoin(same_rows_as.agg(F.count("*").alias("_b")))  # one row each
        report = report.unionByName(both.select(F.lit("row_count").alias("rule"), F.abs(F.col("_a") - F.col("_b")).alias("violations")))
    return report


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    p = parent.select(F.col(parent_key or key).alias("_k")).distinct()
    return child.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_k"), "left_anti")


def check_schema(df: DataFrame, spec: dict) -> DataFrame:
    """Report of a declaration: {'not_null': [...], 'unique': [[...]], 'check': {name: sql}, 'foreign': {column: (table, key)}}."""
    report = check(df, spec.get("not_null", ()), spec.get("unique", ()), {n: F.expr(e) for n, e in spec.get("check", {}).items()})
    for column, (table, key) in spec.get("foreign", {}).items():
        report = report.unionByName(orphans(df, table, column, key).agg(F.lit(f"foreign:{column}").alias("rule"), F.count("*").alias("violations")))
    return report


def parse_profile(df: DataFrame, measures: str = "Measurements", born: str = "Born") -> DataFrame:
    """Free text such as '180 cm / 75 kg' and '4 April 1970 in Place, City (ABC)' as typed columns."""
    date = F.regexp_extract(born, r"([0-9]{1,2} [A-Za-z]+ [0-9]{4})", 1)
    return df.withColumns({
        "height_cm": F.regexp_extract(measures, r"([0-9]+) ?cm", 1).try_cast("double"), "weight_kg": F.regexp_extract(measures, r"([0-9]+) ?kg", 1).try_cast("double"),
        "born_date": F.try_to_date(F.nullif(date, F.lit("")), "d MMMM yyyy"), "born_place": F.nullif(F.trim(F.regexp_extract(born, r" in ([^,(]+)", 1)), F.lit("")),
        "born_country": F.nullif(F.regexp_extract(born, r"\(([A-Z]{3})\)", 1), F.lit("")),
    })
