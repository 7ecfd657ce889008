"""Window analytics.  Order columns are always explicit (names; ``-name`` sorts descending); add a unique one last to break ties.

Running, neighbouring, filling and ranking functions spread keys that hold many rows over all tasks
(``operators/scan.py``); ``large`` sets from how many rows on, by default more than half of a task's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import band
from .scan import by_size, order_columns, plain_names


def _over(keys: list, order: list | None = None):
    w = Window.partitionBy(*keys)
    return w.orderBy(*(order_columns(order) if all(isinstance(c, str) for c in order) else order)) if order else w


def rank_all(df: DataFrame, keys: list, order: list, tie_break: list | None = None, large: int | None = None) -> DataFrame:
    """row_number, rank and dense_rank; a large key is ranked by its parts, twice where a tie break makes another order."""
    names = ["row_number", "rank", "dense_rank"]

    def plain(x):
        w = _over(keys, order)
        return x.withColumns({"row_number": F.row_number().over(_over(keys, order + (tie_break or []))).cast("long"), "rank": F.rank().over(w).cast("long"), "dense_rank": F.dense_rank().over(w).cast("long")})

    def spread(layout):
        layout.order = order  # ties are by the order alone; rows lie by the tie break too
        return layout.ranks(layout.df).withColumnsRenamed({"_row": "row_number", "_rank": "rank", "_dense": "dense_rank"})

    return by_size(df, keys, order + (tie_break or []), plain, spread, large).select(*df.columns, *names)


def top_n(df: DataFrame, keys: list, order: list, n: int, ties: bool = False) -> DataFrame:
    """Greatest n per group; Spark limits each group before the shuffle (WindowGroupLimit)."""
    rank = F.rank() if ties else F.row_number()
    return df.withColumn("rn", rank.over(_over(keys, order))).where(F.col("rn") <= n)


def ntile_band(df: DataFrame, keys: list, order: list, labels: list[str], out: str = "band", large: int | None = None) -> DataFrame:
    """Labels of n tiles of each key, as even as they can be, the larger first."""
    n = len(labels)

    def spread(layout):
        x = layout.running(layout.df, F.lit(1), "_row", "count")
        size, more = F.floor(F.col("_rows") / n), F.col("_rows") % n
        inside = F.col("_row") - 1 - more * (size + 1)
        return x.withColumn("_tile", F.when(inside < 0, F.floor((F.col("_row") - 1) / (size + 1))).otherwise(more + F.floor(inside / size)) + 1)

    x = by_size(df, keys, order, lambda x: x.withColumn("_tile", F.ntile(n).over(_over(keys, order)).cast("long")), spread, large)
    return x.select(*df.columns, band([(F.col("_tile") == i, x) for i, x in enumerate(labels, 1)]).alias(out))


def rank_share(df: DataFrame, keys: list, order: list, large: int | None = None) -> DataFrame:
    """``percent_rank`` and ``cume_dist`` of each row in its key."""

    def plain(x):
        return x.withColumns({"percent_rank": F.percent_rank().over(_over(keys, order)), "cume_dist": F.cume_dist().over(_over(keys, order))})

    def spread(layout):
        x = layout.ranks(layout.df)
        return x.withColumns({"percent_rank": F.when(F.col("_rows") > 1, (F.col("_rank") - 1) / (F.col("_rows") - 1)).otherwise(0.0), "cume_dist": F.col("_upto") / F.col("_rows")})

    return by_size(df, keys, order, plain, spread, large).select(*df.columns, "percent_rank", "cume_dist")


def rank_pct(df: DataFrame, keys: list, order: list, out: str = "pct", large: int | None = None) -> DataFrame:
    """Average rank of ties over the number of rows."""

    def plain(x):
        ties = F.count("*").over(Window.partitionBy(*keys, *plain_names(order)))
        return x.withColumn(out, (F.rank().over(_over(keys, order)) + (ties - 1) / 2) / F.count("*").over(_over(keys)))

    def spread(layout):
        x = layout.ranks(layout.df)
        return x.withColumn(out, (F.col("_rank") + F.col("_upto")) / 2 / F.col("_rows"))

    return by_size(df, keys, order, plain, spread, large).select(*df.columns, out)


def lag_delta(df: DataFrame, keys: list, order: list, c: str, large: int | None = None) -> DataFrame:
    """The values before and after, and the change from the one before."""

    def plain(x):
        w = _over(keys, order)
        return x.withColumns({"prev": F.lag(c).over(w), "next": F.lead(c).over(w)})

    def spread(layout):
        return layout.neighbour(layout.neighbour(layout.df, F.col(c), "prev"), F.col(c), "next", following=True)

    return by_size(df, keys, order, plain, spread, large).select(*df.columns, "prev", "next", (F.col(c) - F.col("prev")).alias("delta"))


def with_previous(df: DataFrame, keys: list, order: list, c: str, out: str = "prev", following: bool = False, large: int | None = None) -> DataFrame:
    """The value of the row before (or after)."""
    move = F.lead if following else F.lag
    plain = lambda x: x.withColumn(out, move(c).over(_over(keys, order)))
    return by_size(df, keys, order, plain, lambda layout: layout.neighbour(layout.df, F.col(c), out, following), large).select(*df.columns, out)


def pct_change(df: DataFrame, keys: list, order: list, c: str, out: str = "pct_change", large: int | None = None) -> DataFrame:
    x = with_previous(df, keys, order, c, "_before", large=large)
    return x.withColumn(out, F.try_divide(F.col(c) - F.col("_before"), F.col("_before")) * 100).drop("_before")


def running(df: DataFrame, keys: list, order: list, c: str, fn: str = "sum", out: str = "running", large: int | None = None) -> DataFrame:
    """Cumulative sum, count, min, max or avg over rows up to the current one."""
    return running_all(df, keys, order, {out: (c, fn)}, large)


def running_all(df: DataFrame, keys: list, order: list, wanted: dict[str, tuple[str, str]], large: int | None = None) -> DataFrame:
    """Several of them, each (column, function) by its name; the rows are put in order once."""
    one = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}
    upto = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    plain = lambda x: x.withColumns({out: one[fn](c).over(upto) for out, (c, fn) in wanted.items()})

    def spread(layout):
        parts = {}
        for out, (c, fn) in wanted.items():
            parts |= {out: (F.col(c), fn)} if fn != "avg" else {out: (F.col(c).cast("double"), "sum"), f"_known_{out}": (F.col(c), "count")}
        x = layout.running_all(layout.df, parts)
        return x.withColumns({out: F.try_divide(out, f"_known_{out}") for out, (_, fn) in wanted.items() if fn == "avg"})

    return by_size(df, keys, order, plain, spread, large).select(*df.columns, *wanted)


def moving_avg(df: DataFrame, keys: list, order: list, c: str, n: int, min_periods: int = 1, out: str = "moving_avg") -> DataFrame:
    w = _over(keys, order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(c).over(w) >= min_periods, F.avg(c).over(w)))


def moving_range(df: DataFrame, keys: list, ts: str, c: str, days: int, fn=F.sum, out: str = "moving") -> DataFrame:
    """fn over the rows of the last ``days`` days, the current instant included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_timestamp(ts)).rangeBetween(-days * 86400 + 1, 0)
    return df.withColumn(out, fn(c).over(w))


def running_with_reset(df: DataFrame, keys: list, order: list, c: str, reset: Column, out: str = "running", large: int | None = None) -> DataFrame:
    """Running total that starts anew at each row where ``reset`` holds."""

    def plain(x):
        x = x.withColumn("_reset_group", F.sum(F.when(reset, 1).otherwise(0)).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
        return x.withColumn(out, F.sum(c).over(_over([*keys, "_reset_group"], order).rowsBetween(Window.unboundedPreceding, 0))).drop("_reset_group")

    return by_size(df, keys, order, plain, lambda layout: layout.running_with_reset(layout.df, F.col(c), reset, out), large).select(*df.columns, out)


def islands(df: DataFrame, keys: list, period: str, unit: str = "month", large: int | None = None) -> DataFrame:
    """Runs of consecutive periods: island_start, island_end, length.  Repeated periods count once."""
    rows = df.select(*keys, F.date_trunc(unit, F.col(period)).alias("p")).distinct()
    number = {"month": F.year("p") * 12 + F.month("p"), "day": F.datediff("p", F.lit("1970-01-01")), "week": F.floor(F.datediff("p", F.lit("1970-01-05")) / 7), "hour": F.floor(F.unix_timestamp("p") / 3600), "minute": F.floor(F.unix_timestamp("p") / 60)}[unit]
    plain = lambda x: x.withColumn("_row", F.row_number().over(_over(keys, ["p"])).cast("long"))
    rows = by_size(rows, keys, ["p"], plain, lambda layout: layout.running(layout.df, F.lit(1), "_row", "count"), large)
    rows = rows.withColumn("island", number - F.col("_row"))
    return rows.groupBy(*keys, "island").agg(F.min("p").alias("island_start"), F.max("p").alias("island_end"), F.count("*").alias("length")).drop("island")


def event_gaps(df: DataFrame, keys: list, ts: str, min_days: int, large: int | None = None) -> DataFrame:
    """Rows whose next event comes more than ``min_days`` days later."""
    x = with_previous(df, keys, [ts], ts, "next_ts", following=True, large=large)
    return x.withColumn("gap_days", F.datediff("next_ts", ts)).where(F.col("gap_days") > min_days)


def transitions(df: DataFrame, keys: list, order: list, c: str, large: int | None = None) -> DataFrame:
    """Rows whose value differs from the one before."""
    x = with_previous(df, keys, order, c, large=large)
    return x.where(F.col("prev").isNotNull() & (F.col("prev") != F.col(c)))


def top_changes(df: DataFrame, keys: list, order: list, c: str, n: int, rising: bool = False) -> DataFrame:
    """The n largest drops (or rises) from one row to the next, over all groups."""
    x = with_previous(df, keys, order, c, "_before").withColumn("change", F.col(c) - F.col("_before")).drop("_before").where("change is not null")
    return x.orderBy(F.desc("change") if rising else F.asc("change"), *keys, *order).limit(n)


def fill_forward(df: DataFrame, keys: list, order: list, c: str, backward: bool = False, large: int | None = None) -> DataFrame:
    """The last known value up to each row; ``backward``: the next one from it on."""

    def plain(x):
        w = _over(keys, order)
        fill = F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing)) if backward else F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return x.withColumn(c, fill)

    return by_size(df, keys, order, plain, lambda layout: layout.filled(layout.df, F.col(c), c, backward), large).select(*df.columns)
