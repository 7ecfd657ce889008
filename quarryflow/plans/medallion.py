"""Bronze, silver and gold layers as plain functions, and the job that runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import check, dedup_latest
from ..sources.io import read_table, write_table


def bronze(df: DataFrame, source: str, batch_id: int, ingested_at: str) -> DataFrame:
    """Rows as they came, with where they came from; the time is given, so a rerun gives the same rows."""
    at = F.lit(ingested_at).cast("timestamp")
    return df.withColumns({"_ingested_at": at, "_source_system": F.lit(source), "_batch_id": F.lit(batch_id), "_ingestion_date": at.cast("date")})


def land(df: DataFrame, path: str) -> None:
    write_table(df, path, mode="append", partition_by=["_ingestion_date"])


def silver_master(df: DataFrame, key: str, ranges: dict[str, tuple], order: list) -> DataFrame:
    """Keys trimmed and upper-cased, rows outside the ranges dropped, the latest row of each key."""
    df = df.withColumn(key, F.upper(F.trim(F.col(key)))).where(F.col(key).isNotNull() & (F.col(key) != ""))
    for c, (low, high) in ranges.items():
        df = df.where(F.col(c).between(low, high))
    return dedup_latest(df, [key], order)


def silver_events(df: DataFrame, money: list[str], dates: list[str], closed: str, owner: str) -> DataFrame:
    """Typed money and dates, and a quality flag: OPEN without a closing date, else MISSING without an owner, else CLEAN.  Rows whose money is null or negative go."""
    df = df.withColumns({c: F.col(c).try_cast("double") for c in money} | {c: F.col(c).try_cast("date") for c in dates})
    for c in money:
        df = df.where(F.col(c) >= 0)
    return df.withColumn("quality_flag", F.when(F.col(closed).isNull(), "OPEN").when(F.col(owner).isNull(), "MISSING").otherwise("CLEAN"))


def gold_risk(entities: DataFrame, sides: dict[str, DataFrame], key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entities with the aggregates of each side table (0 where there is none), scored."""
    for df in sides.values():
        measures = [c for c in df.columns if c != key]
        entities = entities.join(df, key, "left").withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in measures})
    return score(entities)


def gold_monthly(df: DataFrame, date: str, measures: list[Column]) -> DataFrame:
    return df.groupBy(F.date_trunc("month", F.col(date)).cast("date").alias("month")).agg(*measures)


def run_pipeline(spark: SparkSession, raw: DataFrame, root: str, silver: Callable, gold: Callable, rules: dict, batch_id: int = 1, ingested_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """Bronze to gold in order, each layer written and read again; gold is published only if its rules hold."""
    land(bronze(raw, "raw", batch_id, ingested_at), f"{root}/bronze")
    write_table(silver(read_table(spark, f"{root}/bronze")), f"{root}/silver", mode="overwrite")
    table = gold(read_table(spark, f"{root}/silver"))
    write_table(table, f"{root}/gold_staged", mode="overwrite")
    staged = read_table(spark, f"{root}/gold_staged")
    bad = check(staged, **rules).where("violations > 0").collect()  # one row a rule
    if bad:
        raise ValueError(f"gold breaks {[(r.rule, r.violations) for r in bad]}")
    write_table(staged, f"{root}/gold", mode="overwrite")
    return read_table(spark, f"{root}/gold")
