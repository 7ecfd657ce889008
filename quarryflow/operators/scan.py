"""Ordered scans of groups of any size: rows are placed by range, and what a part ends with is carried to the next.

A window over a key sends all rows of that key to one task.  Here rows are sorted by (key, order) over
all partitions and written, so that it is fixed which row is in which part.  A first pass works within
each part of a key; a second folds the last row of each part, one small row a part, along the parts; and
what a part inherits is put together with its own values.  So a key that holds half of all rows is spread
over half of the tasks.

Only keys that are large take this way: the others need one shuffle as a plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch

#: A key with more rows than this, and more than half of what a task gets on average, is large.
LARGE = 1000


def order_columns(order: list[str]) -> list[Column]:
    """Sort columns; a name that begins with ``-`` sorts descending (nulls last)."""
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def plain_names(order: list[str]) -> list[str]:
    return [c.removeprefix("-") for c in order]


def same_keys(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)), F.lit(True))


def large_keys(df: DataFrame, keys: list[str], large: int | None = None) -> DataFrame | None:
    """(_k0, ..., _rows) of the keys with many rows, or None if there are none; null is a key like others."""
    counts = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_rows"))
    size = counts.agg(F.sum("_rows").alias("total"), F.max("_rows").alias("most")).first()  # one pass over the keys
    if large is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        large = max(LARGE, (size["total"] or 0) // (2 * tasks))
    return counts.where(F.col("_rows") > large) if (size["most"] or 0) > large else None


def by_size(df: DataFrame, keys: list[str], order: list[str], plain: Callable[[DataFrame], DataFrame], spread: Callable[[Layout], DataFrame], large: int | None = None) -> DataFrame:
    """``plain`` for the rows of small keys and ``spread`` for those of large ones, put together.

    The two must give the same columns.  Whether a key is large changes the plan, never the rows.
    """
    hot = large_keys(df, keys, large)
    if hot is None:
        return plain(df)
    match = same_keys(keys, "_k")
    cold = plain(df.join(hot, match, "left_anti"))
    warm = spread(Layout(df.join(hot, match).drop(*(f"_k{i}" for i in range(len(keys)))), keys, order))
    return cold.unionByName(warm.select(*cold.columns))


class Layout:
    """Rows sorted by keys and order over all partitions, written once; ``df`` has ``_part`` and ``_id`` (the row's place)."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]):
        spark = df.sparkSession
        self.keys, self.order = keys, order
        sort = [*(F.asc(k) for k in keys), *order_columns(order)]
        ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
        path = scratch(spark, "placed")
        ranged.write.parquet(path)  # fixes which row is in which part, also if executors are lost later
        self.df = spark.read.schema(ranged.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))

    def key(self) -> Column:
        return F.struct(*self.keys) if self.keys else F.struct(F.lit(0).alias("all"))

    def within(self, *more: str, backward: bool = False):
        """The window over a part of a key."""
        return Window.partitionBy("_part", *self.keys, *more).orderBy(F.desc("_id") if backward else F.asc("_id"))

    def carry(self, df: DataFrame, values: dict[str, Column], fold: dict[str, Callable], backward: bool = False, before: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """``df`` with, for each value, ``_prior_<name>``: the fold of what the earlier parts of the row's key end with.

        ``values`` are taken from the last row of each part; ``fold`` makes a column of the value
        and a window over the parts of one key up to each.  ``_goes_on`` says that the row's key has
        earlier parts.  ``backward`` turns the order round; ``before`` may add columns to the parts.
        """
        last, first = (F.min_by, F.max_by) if backward else (F.max_by, F.min_by)
        parts = df.groupBy("_part").agg(last(F.struct(self.key().alias("_key"), *(c.alias(n) for n, c in values.items())), F.col("_id")).alias("_t"), first(self.key(), F.col("_id")).alias("_head"))
        parts = parts.select("_part", "_head", "_t.*")
        at = F.desc("_part") if backward else F.asc("_part")
        run = Window.partitionBy("_key").orderBy(at)
        if before is not None:
            parts = before(parts, run)
        parts = parts.withColumns({f"_f_{n}": make(F.col(n), run) for n, make in fold.items()})
        along = Window.orderBy(at)  # a row for each part
        inherited = [F.lag(f"_f_{n}").over(along).alias(f"_prior_{n}") for n in fold]
        parts = parts.select("_part", "_head", (F.lag("_key").over(along).eqNullSafe(F.col("_head")) & (F.row_number().over(along) > 1)).alias("_on"), *inherited).where("_on")
        joined = df.join(F.broadcast(parts), "_part", "left")  # a row for each part
        on = F.coalesce(F.col("_on"), F.lit(False)) & self.key().eqNullSafe(F.col("_head"))
        return joined.withColumn("_goes_on", on).withColumns({f"_prior_{n}": F.when(F.col("_goes_on"), F.col(f"_prior_{n}")) for n in fold}).drop("_head", "_on")

    # --- scans; each takes and gives rows with ``_part`` and ``_id``

    def running(self, df: DataFrame, value: Column, out: str, kind: str = "sum") -> DataFrame:
        """Cumulative sum, count, min or max up to each row; nulls do not count."""
        return self.running_all(df, {out: (value, kind)})

    def running_all(self, df: DataFrame, wanted: dict[str, tuple[Column, str]]) -> DataFrame:
        """Several of them, each (value, kind) by its name, in one pass over the rows."""
        kinds = {
            "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
            "count": (F.count, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
            "min": (F.min, F.min, lambda a, b: F.least(a, b)),
            "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
        }
        upto = self.within().rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({out: kinds[kind][0](value).over(upto) for out, (value, kind) in wanted.items()})
        folds = {out: (lambda v, run, over=kinds[kind][1]: over(v).over(run)) for out, (_, kind) in wanted.items()}
        df = self.carry(df, {out: F.col(out) for out in wanted}, folds)
        df = df.withColumns({out: kinds[kind][2](F.col(out), F.col(f"_prior_{out}")) for out, (_, kind) in wanted.items()})
        return df.drop("_goes_on", *(f"_prior_{out}" for out in wanted))

    def neighbour(self, df: DataFrame, value: Column, out: str, following: bool = False) -> DataFrame:
        """The value of the row before (or after), null at the end of the key."""
        df = df.withColumns({"_own": F.struct(value.alias("v")), "_at": F.row_number().over(self.within(backward=following))})
        df = df.withColumn(out, F.lag("_own").over(self.within(backward=following)))
        df = self.carry(df, {"v": F.col("_own")}, {"v": lambda v, run: v}, backward=following)
        return df.withColumn(out, F.when(F.col("_at") == 1, F.col("_prior_v")["v"]).otherwise(F.col(out)["v"])).drop("_own", "_at", "_prior_v", "_goes_on")

    def filled(self, df: DataFrame, value: Column, out: str, backward: bool = False) -> DataFrame:
        """The last known value up to each row (or the next one from it on)."""
        df = df.withColumn(out, F.last(value, True).over(self.within(backward=backward).rowsBetween(Window.unboundedPreceding, 0)))
        df = self.carry(df, {"v": F.col(out)}, {"v": lambda v, run: F.last(v, True).over(run)}, backward=backward)
        return df.withColumn(out, F.coalesce(F.col(out), F.col("_prior_v"))).drop("_prior_v", "_goes_on")

    def running_with_reset(self, df: DataFrame, value: Column, reset: Column, out: str) -> DataFrame:
        """Cumulative sum that starts anew at each row where ``reset`` holds; what is left after a part's last reset is carried on."""
        upto = self.within().rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_own", value).withColumn("_resets", F.count(F.when(reset, 1)).over(upto))
        df = df.withColumn(out, F.sum("_own").over(self.within("_resets").rowsBetween(Window.unboundedPreceding, 0)))
        resets_so_far = lambda parts, run: parts.withColumn("_since", F.sum(F.when(F.col("r") > 0, 1).otherwise(0)).over(run))
        since = Window.partitionBy("_key", "_since").orderBy("_part")
        df = self.carry(df, {"v": F.col(out), "r": F.col("_resets")}, {"v": lambda v, run: F.sum(v).over(since)}, before=resets_so_far)
        before = F.when(F.col("_resets") == 0, F.col("_prior_v"))
        return df.withColumn(out, F.coalesce(F.col(out) + before, F.col(out), before)).drop("_own", "_resets", "_prior_v", "_goes_on")

    def ranks(self, df: DataFrame) -> DataFrame:
        """``_row``, ``_rank``, ``_dense`` and ``_upto`` (rows up to the last equal one) by the order, ties across parts included."""
        own = F.struct(*plain_names(self.order))
        df = self.running(df, F.lit(1), "_row", "count")
        df = self.neighbour(df, own, "_before")
        df = self.neighbour(df, own, "_after", following=True)
        first, last = ~own.eqNullSafe(F.col("_before")), ~own.eqNullSafe(F.col("_after"))
        df = df.withColumns({"_first": first, "_last": last}).drop("_before", "_after")
        df = self.filled(df, F.when(F.col("_first"), F.col("_row")), "_rank")
        df = self.running(df, F.when(F.col("_first"), 1), "_dense", "count")
        return self.filled(df, F.when(F.col("_last"), F.col("_row")), "_upto", backward=True).drop("_first", "_last")
