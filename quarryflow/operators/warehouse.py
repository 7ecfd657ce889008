"""Dimensions, facts, vault tables and marts.  Every function takes snapshots and returns a new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_key, row_checksum

#: Rows of a calendar that meets every entity.
MOST_PERIODS = 10_000


def changed(cols: list[str], left: str = "t", right: str = "s") -> Column:
    """Whether any column differs, null-safe."""
    return reduce(lambda a, b: a | b, (~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols), F.lit(False))


def scd1(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Overwrite attributes of known keys, add new ones; a null key is a key like others."""
    t, s = target.alias("t"), source.withColumn("_hit", F.lit(True)).alias("s")
    pick = lambda c: F.when(F.col("s._hit"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    j = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "outer")
    return j.select(*(F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys), *(pick(c) for c in cols))


def scd2_init(source: DataFrame, keys: list[str], attrs: list[str], as_of: Column) -> DataFrame:
    return source.select(*keys, *attrs, as_of.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))


def scd2_apply(dim: DataFrame, source: DataFrame, keys: list[str], attrs: list[str], as_of: Column) -> DataFrame:
    """Expire changed current rows, add their new version and new keys.  Intervals are half-open; an open end is null.

    Source keys must not repeat: that is checked, as a key would get two current rows.  A null key is a key like others.
    """
    if not source.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"the source repeats keys of {keys}")
    current, old = dim.where("is_current"), dim.where("not is_current")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    j = current.alias("t").join(source.withColumn("_hit", F.lit(True)).alias("s"), same, "left")
    gone = F.coalesce(F.col("s._hit") & changed(attrs), F.lit(False))
    kept = j.select(*(F.col(f"t.{c}") for c in [*keys, *attrs, "valid_from"]), F.when(gone, as_of).otherwise(F.col("t.valid_to")).alias("valid_to"), (~gone).alias("is_current"))
    n = source.alias("s").join(current.withColumn("_hit", F.lit(True)).alias("t"), same, "left").where(F.col("t._hit").isNull() | changed(attrs))
    fresh = scd2_init(n.select(*(F.col(f"s.{c}") for c in [*keys, *attrs])), keys, attrs, as_of)
    return old.select(*kept.columns).unionByName(kept).unionByName(fresh)


def scd2_as_of(dim: DataFrame, date: Column) -> DataFrame:
    return dim.where((F.col("valid_from") <= date) & (F.col("valid_to").isNull() | (F.col("valid_to") > date)))


def scd3(target: DataFrame, source: DataFrame, key: str, attr: str) -> DataFrame:
    """Keep the value before the last change in a column of its own.  A null in the source is no change; a null key matches a null key."""
    j = target.join(source.select(F.col(key).alias("_key"), F.col(attr).alias("_new")), F.col(key).eqNullSafe(F.col("_key")), "left")
    moved = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(attr))
    return j.select(key, F.when(moved, F.col("_new")).otherwise(F.col(attr)).alias(attr), F.when(moved, F.col(attr)).alias(f"prev_{attr}"))


def scd4_split(dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current table and the history table."""
    return dim.where("is_current"), dim.where("not is_current")


def surrogate_key(df: DataFrame, order: list[str], out: str = "sk") -> DataFrame:
    """Dense keys from 1 in a total order, without gathering the rows in one task.

    Rows are range-partitioned and numbered within their partition as they are written, by the
    number that Spark makes of partition and position; the counts per partition (one small row
    each) give the offsets.  So the rows are shuffled once.
    """
    from ..sources.io import scratch

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    path = scratch(df.sparkSession, "ranged")
    ranged.write.parquet(path)  # fixes which row is in which part, also if executors are lost later
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # one row a partition
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + within + 1).drop("_part", "_offset", "_id")


def hub(df: DataFrame, key: str, source: str, known: DataFrame | None = None) -> DataFrame:
    """Business keys with their hash; with ``known`` only those it lacks."""
    rows = df.where(F.col(key).isNotNull()).select(key).distinct().select(hash_key([key]).alias("hk"), key, F.lit(source).alias("record_source"))
    return rows if known is None else rows.join(known.select("hk"), "hk", "left_anti")


def satellite(df: DataFrame, key: str, attrs: list[str], source: str, load_ts: Column, known: DataFrame | None = None) -> DataFrame:
    """Attribute rows by hash key; with ``known`` only those that differ from its latest."""
    rows = df.select(hash_key([key]).alias("hk"), load_ts.alias("load_ts"), row_checksum(attrs).alias("checksum"), *attrs, F.lit(source).alias("record_source"))
    if known is None:
        return rows
    last = known.groupBy("hk").agg(F.max_by("checksum", "load_ts").alias("checksum"))
    return rows.join(last, ["hk", "checksum"], "left_anti").select(*rows.columns)


def link(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    rows = df.dropna(subset=keys).select(*keys).distinct()
    return rows.select(hash_key(keys).alias("lk"), *(hash_key([k]).alias(f"hk_{k}") for k in keys), F.lit(source).alias("record_source"))


def vault_current(hub_: DataFrame, sat: DataFrame, attrs: list[str]) -> DataFrame:
    """Each hub key with the attributes of its latest satellite row."""
    last = sat.groupBy("hk").agg(F.max_by(F.struct(*attrs), "load_ts").alias("_a"))
    return hub_.join(last, "hk").select(*hub_.columns, "_a.*")


def star_fact(fact: DataFrame, dims: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Replace business keys by surrogate keys; unknown members get -1.  dims: fact column -> (dimension, its key, its surrogate)."""
    for column, (dim, key, sk) in dims.items():
        fact = fact.join(dim.select(F.col(key).alias("_k"), F.col(sk).alias("_sk")), F.col(column) == F.col("_k"), "left").withColumn(f"{column}_sk", F.coalesce("_sk", F.lit(-1))).drop("_k", "_sk")
    return fact


def periodic_snapshot(events: DataFrame, periods: DataFrame, key: str, at: str, value: str, period_end: str) -> DataFrame:
    """One row per entity and period: the running total and count up to its end, events before the first period included.

    An event counts from the first period that ends on its day or later; events after the last
    period and without a time count nowhere.  A null key is an entity like others.  Totals per
    entity and period are summed first, so the calendar meets entities, never events.
    """
    ends = periods.select(F.col(period_end).cast("date").alias(period_end)).distinct()
    if ends.count() > MOST_PERIODS:
        raise ValueError(f"a calendar has at most {MOST_PERIODS} periods")
    days = events.groupBy(F.col(key).alias("_key"), F.to_date(at).alias("_day")).agg(F.sum(value).alias("v"), F.count("*").alias("n"))
    # each day's first period end: the calendar is an ordered list in one row
    listed = ends.agg(F.array_sort(F.collect_list(period_end)).alias("_ends"))
    per = days.crossJoin(F.broadcast(listed)).withColumn("_end", F.get(F.filter("_ends", lambda e: e >= F.col("_day")), F.lit(0))).groupBy("_key", "_end").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))  # one row of a checked size
    grid = events.select(key).distinct().crossJoin(F.broadcast(ends))  # a calendar of a checked size
    w = Window.partitionBy(key).orderBy(period_end).rowsBetween(Window.unboundedPreceding, 0)
    x = grid.join(per, F.col(key).eqNullSafe(F.col("_key")) & (F.col(period_end) == F.col("_end")), "left").withColumns({"total": F.coalesce(F.sum("v").over(w), F.lit(0.0)), "events": F.coalesce(F.sum("n").over(w), F.lit(0))})
    return x.select(key, period_end, "total", "events")


def accumulating(events: DataFrame, key: str, kind: str, at: str, milestones: list[str]) -> DataFrame:
    """First date of each milestone per entity."""
    return events.groupBy(key).agg(*(F.min(F.when(F.col(kind) == m, F.col(at))).alias(m) for m in milestones))


def rollup_levels(df: DataFrame, levels: list[str], measures: list[Column]) -> DataFrame:
    """Totals along a hierarchy with the number of levels in ``level``; the grand total is level 0."""
    known = reduce(lambda a, b: a + b, (1 - F.grouping(c).cast("int") for c in levels))
    return df.rollup(*levels).agg(*measures, known.alias("level"))


def slice_dice(df: DataFrame, where: dict, group: list[str], measures: list[Column]) -> DataFrame:
    for c, v in where.items():
        df = df.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    return df.groupBy(*group).agg(*measures)


def refresh_mart(mart: DataFrame, facts: DataFrame, period: str, build, touched: DataFrame | None = None, since=None) -> DataFrame:
    """Rebuild only some periods, the others come from the mart: the ``touched`` ones (a table of them), or all from the date ``since`` on."""
    if (touched is None) == (since is None):
        raise ValueError("give either touched periods or a date")
    if touched is None:
        late = F.col(period) >= F.lit(since).cast("date")
        return delete_late(mart, late).unionByName(build(facts.where(late)))
    fresh = build(facts.join(touched, period, "left_semi"))
    return mart.join(touched, period, "left_anti").unionByName(fresh)


def delete_late(df: DataFrame, late: Column) -> DataFrame:
    """Rows where the condition is not true; a null period stays."""
    return df.where(~F.coalesce(late, F.lit(False)))
