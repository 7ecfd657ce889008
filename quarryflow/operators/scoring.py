"""Scores, decisions and business metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import band, col, count_if, rate_pct
from ..streaming.streams import tumbling
from .aggregates import medians
from .joins import active_counts
from .windows import with_previous

#: Rows of a table of thresholds that meets every row.
MOST_THRESHOLDS = 10_000


def score_weighted(df: DataFrame, weights: dict[str, float], size_col: str, per_size: list[str], tiers: list[float], labels: list[str]) -> DataFrame:
    """Weighted sum; the columns of ``per_size`` are divided by the entity's size (1 at least).  Tiers are half-open from below."""
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(1)), F.lit(1))
    parts = [F.coalesce(F.col(c), F.lit(0)) / (size if c in per_size else F.lit(1)) * w for c, w in weights.items()]
    score = sum(parts[1:], parts[0])
    return df.withColumn("score", F.round(score, 4)).withColumn("tier", band([(F.col("score") < t, x) for t, x in zip(tiers, labels)], labels[-1]))


def score_composite(df: DataFrame, rate: str, tier: str, years: str, bounds: tuple = (0.5, 2.0), penalties: dict | None = None) -> DataFrame:
    """Min-max rate at 0.4, tier penalty at 0.3, less experience (up to 20 years) at 0.2; scaled by 10 / 4, 0 at least, 2 places."""
    penalties = penalties or {"A": 0.0, "B": 3.0, "C": 6.0, "D": 10.0}
    low, high = bounds
    scaled = F.least(F.greatest((F.col(rate) - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 10
    penalty = band([(F.col(tier) == k, v) for k, v in penalties.items()], 5.0)
    experience = F.least(F.coalesce(F.col(years), F.lit(0)), F.lit(20)) / 20 * 10
    raw = scaled * 0.4 + penalty * 0.3 - experience * 0.2
    return df.withColumn("score", F.round(F.greatest(raw * 10 / 4, F.lit(0.0)), 2))


def score_rules(df: DataFrame, rules: list[tuple[Column, int]], cap: int = 100) -> DataFrame:
    """Points of the rules that hold, added up and capped."""
    points = [F.when(c, p).otherwise(0) for c, p in rules]
    return df.withColumn("points", F.least(sum(points[1:], points[0]), F.lit(cap)))


def decide(df: DataFrame, weights: dict[str, float], go: float, conditional: float) -> DataFrame:
    """GO, CONDITIONAL or NO GO from a weighted score of columns in [0, 1]; a null counts as 0."""
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", F.round(score, 4)).withColumn("decision", band([(F.col("score") >= go, "GO"), (F.col("score") >= conditional, "CONDITIONAL")], "NO GO"))


def loss_ratio(losses: DataFrame, premiums: DataFrame, key: str, loss: str, premium: str) -> DataFrame:
    """Losses over premiums per key; each side is summed before they meet, so neither is multiplied."""
    a = losses.groupBy(key).agg(F.sum(loss).alias("losses"))
    b = premiums.groupBy(key).agg(F.sum(premium).alias("premiums"))
    return a.join(b, key, "outer").withColumn("ratio", F.round(F.try_divide(F.col("losses"), F.col("premiums")), 4))


def mrr(subs: DataFrame, periods: DataFrame, start: str, end: str, plan: str, price: str, account: str) -> DataFrame:
    """Recurring revenue per month and plan: accounts active in the month times the price."""
    x = active_counts(subs, periods, start, end, "month", "month_end", [plan, price], account, "accounts")
    return x.select("month", plan, "accounts", F.round(F.col("accounts") * F.col(price), 2).alias("mrr"))


def churn(df: DataFrame, segment: list, left: Column, base: Column) -> DataFrame:
    """Churn percent of each segment over a base that the caller chooses."""
    return df.groupBy(*segment).agg(count_if(left).alias("churned"), rate_pct(count_if(left), count_if(base)).alias("churn_pct"))


def plan_changes(subs: DataFrame, account: str, order: list[str], price: str) -> DataFrame:
    """upgrade, downgrade or lateral against the account's plan before."""
    x = with_previous(subs, [account], order, price, "before").where("before is not null")
    return x.withColumn("change", band([(F.col(price) > F.col("before"), "upgrade"), (F.col(price) < F.col("before"), "downgrade")], "lateral"))


def health_score(payments: DataFrame, key: str, ok: Column, bands: list[tuple[float, str]], default: str) -> DataFrame:
    x = payments.groupBy(key).agg(rate_pct(count_if(ok), F.count("*")).alias("success_pct"))
    return x.withColumn("health", band([(F.col("success_pct") >= t, n) for t, n in bands], default))


def resolution_time(tickets: DataFrame, by: str, opened, closed) -> DataFrame:
    """Mean and exact median of the hours that tickets took, with counts of closed and open ones."""
    hours = (F.unix_timestamp(col(closed)) - F.unix_timestamp(col(opened))) / 3600
    x = tickets.select(by, hours.alias("_h"))
    half = medians(x, [by], "_h", "_m").withColumnRenamed(by, "_by")
    means = x.groupBy(by).agg(F.round(F.avg("_h"), 3).alias("avg_hours"), F.count("_h").alias("resolved"), count_if(F.col("_h").isNull()).alias("open"))
    return means.join(half, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "avg_hours", F.round("_m", 3).alias("median_hours"), "resolved", "open")


def scorecard(claims: DataFrame, sides: list[tuple[DataFrame, str]], by: list[str], measures: list[Column], rules: list[tuple[Column, str]], default: str, ts: str | None = None, width: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Claims joined to static tables, summed up per group and labelled; with ``ts`` also per time window.

    The same call serves a table and a stream; a stream needs ``ts`` and ``delay``, and gives a
    window once the watermark has passed it.
    """
    for side, key in sides:
        claims = claims.join(side, key)
    x = claims.groupBy(*by).agg(*measures) if ts is None else tumbling(claims, ts, width, delay, by, measures)
    return x.withColumn("flag", band(rules, default))


def feature_adoption(usage: DataFrame, plan: str, feature: str, account: str) -> DataFrame:
    x = usage.groupBy(plan, feature).agg(F.countDistinct(account).alias("accounts"), F.count("*").alias("uses"))
    return x.withColumn("rank", F.rank().over(Window.partitionBy(plan).orderBy(F.desc("accounts"))))


def payroll_variance(reports: DataFrame, by: str, reported: str, audited: str) -> DataFrame:
    return reports.groupBy(by).agg(F.round(F.sum(reported), 2).alias("reported"), F.round(F.sum(audited), 2).alias("audited"), F.round(F.sum(F.col(audited) - F.col(reported)), 2).alias("variance"))


def expiring(df: DataFrame, date_col: str, as_of: str, days: int) -> DataFrame:
    start = F.lit(as_of).cast("date")
    return df.where(F.col(date_col).cast("date").between(start, F.date_add(start, days)))


def time_intel(df: DataFrame, month: str, value: str) -> DataFrame:
    """Year to date, quarter over quarter and year over year of a table with one row for each month.

    Months without a row have no value, and are in the calendar that the others are compared by.
    """
    every = Window.orderBy(month)  # months, not facts
    ytd = Window.partitionBy(F.year(month)).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    months = df.agg(F.min(month).alias("_low"), F.max(month).alias("_high")).select(F.explode(F.expr("sequence(_low, _high, interval 1 month)")).alias(month))
    dense = months.join(df.withColumn("_there", F.lit(True)), month, "left")
    return dense.withColumns({"ytd": F.sum(value).over(ytd), "qoq": F.col(value) - F.lag(value, 3).over(every), "yoy": F.col(value) - F.lag(value, 12).over(every)}).where("_there").drop("_there")


def restrict(df: DataFrame, entitlements: DataFrame, user: str, on: str) -> DataFrame:
    """Rows of the regions that the user may see."""
    return df.join(entitlements.where(F.col("user") == user).select(on), on, "left_semi")


def what_if(df: DataFrame, score: str, thresholds: DataFrame) -> DataFrame:
    """Rows at or above each threshold of a small table."""
    if len(thresholds.limit(MOST_THRESHOLDS + 1).collect()) > MOST_THRESHOLDS:
        raise ValueError(f"more than {MOST_THRESHOLDS} thresholds")
    x = df.crossJoin(F.broadcast(thresholds))  # a parameter table of a checked size
    return x.groupBy("threshold").agg(count_if(F.col(score) >= F.col("threshold")).alias("hits"), F.count("*").alias("n"))


def resample(df: DataFrame, ts: str, unit: str, aggs: list[Column], periods: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """Aggregates per period; with a calendar (column period) every period of it appears, with ``dense`` every one from the first to the last of the data.

    A calendar that lacks periods of the data would lose rows, so that is an error.
    """
    x = df.groupBy(F.date_trunc(unit, F.col(ts)).cast("date").alias("period")).agg(*aggs)
    if dense:
        ends = df.agg(F.date_trunc(unit, F.min(ts)).cast("date").alias("low"), F.date_trunc(unit, F.max(ts)).cast("date").alias("high"))
        periods = ends.where("low is not null").select(F.explode(F.expr(f"sequence(low, high, interval 1 {unit})")).alias("period"))
    elif periods is not None and not x.where("period is not null").join(periods, "period", "left_anti").isEmpty():
        raise ValueError("the calendar lacks periods of the data")
    return x if periods is None else periods.join(x, "period", "left")
