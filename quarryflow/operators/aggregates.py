"""Aggregation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_groups(df: DataFrame, keys: list[str], aggregate: Column, predicate) -> DataFrame:
    """Rows of the groups whose aggregate meets the predicate (a function of a column).

    The groups are found by a partial aggregate and joined back, so no group is gathered in one task.
    """
    good = df.groupBy(*keys).agg(aggregate.alias("_agg")).where(predicate(F.col("_agg"))).drop("_agg")
    return df.join(good, keys, "left_semi")


def group_transform(df: DataFrame, keys: list[str], aggregate: Column, out: str) -> DataFrame:
    """Each row with the aggregate of its group."""
    return df.withColumn(out, aggregate.over(Window.partitionBy(*keys)))


def salted_agg(df: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], n: int = 16) -> DataFrame:
    """Two-level aggregate for hot groups whose aggregate has no cheap partial form (such as distinct lists)."""
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.lit(n))
    first = df.groupBy(*keys, salt.alias("_salt")).agg(*(c.alias(k) for k, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(k) for k, c in final.items()))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Frequency of each value, null included, with its share in percent."""
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 2)).drop("total")  # one row


def quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] = (), out: str = "quantiles") -> DataFrame:
    """Exact interpolated quantiles, as ``percentile`` gives them, without gathering a group's values in one task.

    Equal values are counted first, so a frequent one is a single row.  The counts are sorted by
    range and written; the sums of the parts tell which part holds a rank, and only such parts
    are added up row by row.  Nulls do not count.  One row per group of ``by`` (a null key is a
    group) that has a value; without ``by`` always one row, null for an empty table.
    """
    from ..sources.io import scratch

    spark, keys = df.sparkSession, [f"_k{i}" for i in range(len(by))]
    values = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = values.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranged = counts.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_id", F.monotonically_increasing_id())
    path = scratch(spark, "quantiles")
    ranged.write.parquet(path)  # fixes which row is in which part
    ranged = spark.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))

    group = Window.partitionBy(*keys)  # a row for each part of the group
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    parts = parts.withColumns({"_before": F.sum("_size").over(group.orderBy("_part")) - F.col("_size"), "_total": F.sum("_size").over(group)})
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("at")) for i, p in enumerate(probs)))
    held = F.filter("_wanted", lambda w: (F.floor(w["at"]) < F.col("_before") + F.col("_size")) & (F.ceil(w["at"]) >= F.col("_before")))
    parts = parts.withColumn("_wanted", wanted).withColumn("_wanted", held).where(F.size("_wanted") > 0)

    parts = parts.select(F.col("_part").alias("_in"), *(F.col(k).alias(f"_in{k}") for k in keys), "_before", "_wanted")
    rows = ranged.join(parts, [F.col("_part") == F.col("_in"), *(F.col(k).eqNullSafe(F.col(f"_in{k}")) for k in keys)])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_id"))
    hits = rows.withColumn("_upto", upto).withColumn("_w", F.explode("_wanted"))
    inside = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))
    low, high = F.floor("_w.at"), F.ceil("_w.at")
    hits = hits.where(inside(low) | inside(high)).withColumns({"_low": F.when(inside(low), F.col("_v")), "_high": F.when(inside(high), F.col("_v"))})
    pick = lambda name, i: F.max(F.when(F.col("_w.i") == i, F.col(name)))
    found = hits.groupBy(*keys).agg(*(pick(c, i).alias(f"{c}{i}") for i in range(len(probs)) for c in ("_low", "_high", "_w.at")))
    between = [F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise((F.ceil(F.col(f"`_w.at{i}`")) - F.col(f"`_w.at{i}`")) * F.col(f"_low{i}") + (F.col(f"`_w.at{i}`") - F.floor(F.col(f"`_w.at{i}`"))) * F.col(f"_high{i}")) for i in range(len(probs))]
    return found.select(*(F.col(k).alias(b) for k, b in zip(keys, by)), F.array(*between).alias(out))


def medians(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group; null for a group without values."""
    half = quantiles(df, value, [0.5], keys, "_q").withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)})
    groups = df.select(*keys).distinct()
    return groups.join(half, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], "left").select(*keys, F.col("_q")[0].alias(out))


def partition_profile(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows in each of Spark's partitions (and group of ``by``): shows skew, and whether equal keys meet."""
    return df.groupBy(F.spark_partition_id().alias("partition"), *by).agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, one row each."""
    stats = [("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
    one = df.agg(*(f(c).alias(f"{c}.{n}") for c in columns for n, f in stats))
    rows = [F.struct(F.lit(c).alias("column_name"), *(F.col(f"`{c}.{n}`").cast("double").alias(n) for n, _ in stats)) for c in columns]
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column_name", "_x")
    q = quantiles(long, "_x", [0.25, 0.5, 0.75], ["column_name"], "_q")
    x = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").join(q, "column_name", "left")
    return x.withColumns({name: F.col("_q")[i] for i, name in enumerate(("q25", "q50", "q75"))}).drop("_q")


def leave_one_out(df: DataFrame, value: str, out: str = "others_avg") -> DataFrame:
    """Each row with the mean of all other rows, from one total; null if there is no other."""
    total = df.agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    x = df.crossJoin(F.broadcast(total))  # one row
    return x.withColumn(out, F.try_divide(F.col("_s") - F.col(value), F.col("_n") - 1)).drop("_s", "_n")


def latest_per_group(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The columns of the row with the largest ``order`` per group, by a partial aggregate."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_b"))
    return best.select(*keys, "_b.*")


# --- distinct counts that can be kept and rolled up


def distinct_state(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """(by, bucket, bits): the distinct values of an integer column as bitmaps of 4 kB, each for a range of 32,768 values; nulls do not count."""
    rows = df.where(F.col(c).isNotNull())
    return rows.groupBy(*by, F.bitmap_bucket_number(F.col(c)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(c))).alias("bits"))


def merge_distinct(one: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """The state of both parts' rows together."""
    return one.unionByName(other).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(state: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """Exact distinct counts by columns of a kept state, coarser ones too, without the facts."""
    merged = state.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(out))


def distinct_sketch(df: DataFrame, by: list[str], c: str, bits: int = 12) -> DataFrame:
    """(by, sketch): HyperLogLog sketches of 2**bits slots, for columns of any kind; the standard error of their counts is about 1.04 / 2**(bits / 2), so 1.6 % for 12."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(c, bits).alias("sketch"))


def sketch_counts(state: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """Estimated distinct counts from sketches, by their columns or coarser ones."""
    return state.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))
