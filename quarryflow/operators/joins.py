"""Joins beyond a plain ``df.join``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .windows import fill_forward

#: Rows of a calendar that is sent to all tasks.
MOST_PERIODS = 100_000


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side; full outer join on the distinct keys."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = x.join(y, key, "outer")
    return both.where("in_a is null or in_b is null").select(key, F.when(F.col("in_b").isNull(), "left_only").otherwise("right_only").alias("side"))


def overlap_join(facts: DataFrame, periods: DataFrame, start: str, end: str, p_start: str, p_end: str, bucket: str = "month") -> DataFrame:
    """Facts active in a period: start <= p_end and coalesce(end, far) > p_start.

    Both sides are cut into calendar buckets, so the join has an equality to shuffle or
    broadcast by instead of comparing everything; a pair is taken in the first bucket it shares.
    Facts without an end last until the last period does, and those that began before the first
    period count from there.
    """
    last = periods.agg(F.max(p_end).alias("_last"), F.min(p_start).alias("_first"))
    f = facts.crossJoin(F.broadcast(last)).withColumn("_to", F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last")))  # one row
    step = F.expr(f"interval 1 {bucket}")
    buckets = lambda lo, hi: F.explode(F.when(lo <= hi, F.sequence(F.date_trunc(bucket, lo), F.date_trunc(bucket, hi), step)))
    f = f.withColumn("_bucket", buckets(F.greatest(F.col(start).cast("timestamp"), F.col("_first").cast("timestamp")), F.col("_to").cast("timestamp")))
    p = periods.withColumn("_bucket", buckets(F.col(p_start).cast("timestamp"), F.col(p_end).cast("timestamp")))
    first = F.greatest(F.date_trunc(bucket, F.col(start)), F.date_trunc(bucket, F.col(p_start))) == F.col("_bucket")
    hit = (F.col(start) <= F.col(p_end)) & (F.col(end).isNull() | (F.col(end) > F.col(p_start)))
    return f.join(p, "_bucket").where(hit & first).drop("_bucket", "_to", "_last", "_first")


def active_counts(facts: DataFrame, periods: DataFrame, start: str, end: str, p_start: str, p_end: str, by: list[str] = (), distinct: str | None = None, out: str = "active") -> DataFrame:
    """How many facts are active in each period: start <= p_end and coalesce(end, far) > p_start; periods without any have no row.

    A sweep: a fact counts +1 at its first period and -1 after its last, and the sums run along
    the calendar, so the rows that are shuffled do not depend on how long facts last.  With ``distinct``
    each of its values counts once a period (null does not count): its overlapping stretches are merged first.
    ``by`` splits the counts.  Periods are a calendar: none contains another.
    """
    by = list(by)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    calendar = periods.select(p_start, micros(p_start).alias("a"), micros(p_end).alias("b")).orderBy("a", "b").limit(MOST_PERIODS + 1).toPandas()
    if len(calendar) > MOST_PERIODS or not calendar["b"].is_monotonic_increasing:
        raise ValueError(f"periods must be a calendar of at most {MOST_PERIODS} rows, none within another")
    starts, ends = calendar["a"].to_numpy(), calendar["b"].to_numpy()
    count = len(calendar)

    @F.pandas_udf("int")
    def first_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, at.to_numpy(), side="left").astype("int32"))

    @F.pandas_udf("int")
    def last_of(at: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(starts, at.to_numpy(), side="left") - 1).astype("int32"))

    far = F.lit((1 << 63) - 1)
    rows = facts.where(F.col(start).isNotNull()).select(*by, *([distinct] if distinct else []), first_of(micros(start)).alias("_i"), last_of(F.coalesce(micros(end), far)).alias("_j"))
    rows = rows.where("_i <= _j")
    if distinct:
        w = Window.partitionBy(*by, distinct).orderBy("_i", "_j")
        rows = rows.where(F.col(distinct).isNotNull()).groupBy(*by, distinct, "_i").agg(F.max("_j").alias("_j"))  # a row for each period at most
        before = F.max("_j").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("_i") > before + 1), 1).otherwise(0))
        rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.groupBy(*by, distinct, "_run").agg(F.min("_i").alias("_i"), F.max("_j").alias("_j"))
    steps = rows.select(*by, F.explode(F.array(F.struct(F.col("_i").alias("at"), F.lit(1).alias("d")), F.struct((F.col("_j") + 1).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(*by, F.col("s.at").alias("_at")).agg(F.sum("s.d").alias("_d"))
    along = Window.partitionBy(*by).orderBy("_at")  # a row for each period
    steps = steps.withColumns({out: F.sum("_d").over(along), "_to": F.coalesce(F.lead("_at").over(along), F.lit(count)) - 1}).where((F.col(out) > 0) & (F.col("_at") <= F.col("_to")))
    each = steps.select(*by, out, F.explode(F.sequence("_at", "_to")).alias("_at"))
    names = facts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(calendar[p_start].tolist())], StructType([StructField("_n", IntegerType()), StructField(p_start, periods.schema[p_start].dataType)]))
    return each.join(names, F.col("_at") == F.col("_n")).select(*by, p_start, out)


def asof_join(fact: DataFrame, dim: DataFrame, key: str, ts: str, valid_from: str, valid_to: str, how: str = "left", large: int | None = None) -> DataFrame:
    """The dimension row valid when the fact happened: valid_from <= ts < valid_to, open if valid_to is null.

    A merge: facts and versions are sorted together by key and time, and the last version is
    carried along, so no row is repeated and the facts of a hot key are spread over tasks and time.
    The versions of a key do not overlap (as in SCD2); of several that start at once any is taken.
    ``how`` is inner or left; facts without key or time match none.
    """
    if how not in ("inner", "left"):
        raise ValueError("versions are carried to facts, so unmatched ones cannot be kept")
    same = fact.schema[ts].dataType == dim.schema[valid_from].dataType
    at = lambda c: F.col(c) if same else F.col(c).cast("timestamp")
    whole = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
    real = dim.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_to) > F.col(valid_from))))
    versions = real.select(F.col(key).alias("_k"), at(valid_from).alias("_at"), F.lit(0).alias("_side"), whole(dim).alias("_v"))
    facts = fact.select(F.col(key).alias("_k"), at(ts).alias("_at"), F.lit(1).alias("_side"), whole(fact).alias("_f"))
    both = facts.unionByName(versions, allowMissingColumns=True)
    x = fill_forward(both, ["_k"], ["_at", "_side"], "_v", large=large).where("_side = 1")
    until = F.col("_v").getField(valid_to)
    hit = F.col("_v").isNotNull() & F.col("_k").isNotNull() & F.col("_at").isNotNull() & (until.isNull() | (F.col("_f").getField(ts) < until))
    if how == "inner":
        x = x.where(hit)
    return x.select("_f.*", *(F.when(hit, F.col("_v").getField(c)).alias(c) for c in dim.columns if c != key))


def heavy_hitters(df: DataFrame, key: str, share: float, most: int = 1000) -> DataFrame:
    """(key, n) of the keys that hold more than ``share`` of the rows, from one mergeable sketch of bounded size; null keys do not count.

    The sketch tracks so many items that no such key escapes it; ``n`` is an estimate from above.
    """
    tracked = 1 << max(6, int(np.ceil(np.log2(4 / share))))
    found = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("all"), F.expr(f"approx_top_k(`{key}`, {min(most, tracked // 2)}, {tracked})").alias("top"))
    return found.select("all", F.explode("top").alias("t")).where(F.col("t.count") > F.col("all") * share).select(F.col("t.item").alias(key), F.col("t.count").alias("n"))


def salted_join(big: DataFrame, small: DataFrame, key: str, most: int = 16, how: str = "inner", share: float | None = None) -> DataFrame:
    """Skewed join: only the keys that hold many of the big side's rows are salted, each by its own count.

    A key with more than ``share`` of the rows (half of what a task gets on average, if not given)
    is cut into as many parts, ``most`` at most, by a hash of the row; the small side repeats its
    rows for these keys alone.  Repeatable under retries.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the small side is repeated, so its unmatched rows cannot be kept")
    tasks = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    share = share or 1 / (2 * max(1, tasks))
    hot = heavy_hitters(big, key, share).collect()  # at most 1 / share, and 1000, rows
    if not hot:
        return big.join(small, key, how)
    largest = max(r["n"] for r in hot)
    salts = [(r[key], max(2, -(-most * r["n"] // largest))) for r in hot]
    parts = big.sparkSession.createDataFrame(salts, StructType([StructField("_hot", big.schema[key].dataType), StructField("_parts", LongType())]))
    tag = lambda df: df.join(F.broadcast(parts), F.col(key) == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hot")  # noqa: E731  at most 1000 rows
    salted = tag(big).withColumn("_salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in big.columns)), F.col("_parts"))).drop("_parts")
    spread = tag(small).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def join_on(left: DataFrame, right: DataFrame, keys: dict[str, str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """Join on keys of different names; other columns that clash get a suffix."""
    clash = (set(left.columns) & set(right.columns)) - set(keys) - set(keys.values())
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash} | {r: f"_key_{r}" for r in keys.values()})
    on: Column = F.lit(True)
    for a, b in keys.items():
        on = on & (left[a] == right[f"_key_{b}"])
    return left.join(right, on, how).drop(*(f"_key_{b}" for b in keys.values()))


def join_with_indicator(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with ``_merge``: both, left_only or right_only."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "outer")
    mark = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return both.withColumn("_merge", mark).drop("_l", "_r")


def fanout_report(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row: rows on the left, rows after an inner and a left join, right keys that repeat.  Only key counts are joined."""
    a = left.groupBy(*on).agg(F.count("*").alias("l"))
    b = right.groupBy(*on).agg(F.count("*").alias("r"))
    j = a.join(b, on, "outer")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    return j.agg(F.sum(l).alias("left_rows"), F.sum(l * r).alias("inner_rows"), F.sum(l * F.greatest(r, F.lit(1))).alias("left_join_rows"), F.count(F.when(F.col("r") > 1, 1)).alias("duplicate_right_keys"))
