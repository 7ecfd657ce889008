"""Loads, upserts, change capture and versions over Parquet snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import dup_report
from .warehouse import changed


def _aligned(keys):
    return [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None, delete_missing: bool = False) -> DataFrame:
    """Matched rows take the listed columns of the source, others are added; ``delete_missing`` drops what the source lacks.

    Source keys must not repeat: that is checked, as repeats would multiply rows.
    """
    if not dup_report(source, keys).isEmpty():
        raise ValueError(f"the source repeats keys of {keys}")
    update = [c for c in target.columns if c not in keys] if update is None else update
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
    j = t.join(s, _aligned(keys), "right" if delete_missing else "outer")

    def value(c):
        if c in keys:
            return F.coalesce(f"t.{c}", f"s.{c}").alias(c)
        there = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        old = F.col(f"t.{c}")
        if c in update:
            return F.when(F.col("s._s"), there).otherwise(old).alias(c)
        return F.when(F.col("t._t"), old).otherwise(there).alias(c)

    return j.select(*(value(c) for c in target.columns))


def merge_add(target: DataFrame, delta: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Add delta measures to totals."""
    return target.select(*keys, *measures).unionByName(delta.select(*keys, *measures)).groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and, once each, the source rows whose keys it lacks; null keys are keys like others, and of repeated ones any row is taken."""
    new = source.dropDuplicates(keys).alias("s").join(target.alias("t"), _aligned(keys), "left_anti")
    return target.unionByName(new.select(*target.columns))


def update(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition is not true; null keeps a row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def cdc_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT, UPDATE and DELETE between two snapshots, with both rows as JSON; a null key is a key like others."""
    cols = [c for c in old.columns if c not in keys]
    j = old.withColumn("_t", F.lit(True)).alias("t").join(new.withColumn("_s", F.lit(True)).alias("s"), _aligned(keys), "outer")
    op = F.when(F.col("t._t").isNull(), "INSERT").when(F.col("s._s").isNull(), "DELETE").when(changed(cols), "UPDATE")
    row = lambda side, mark: F.when(F.col(mark), F.to_json(F.struct(*(F.col(f"{side}.{c}") for c in old.columns))))
    return j.select(*(F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys), op.alias("op"), row("t", "t._t").alias("old_row"), row("s", "s._s").alias("new_row")).where("op is not null")


def cdc_apply(target: DataFrame, log: DataFrame, keys: list[str], seq: str, op: str = "op") -> DataFrame:
    """Replay a change log; the last change of a key wins.  A null key is a key like others."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in log.columns if c not in keys)), seq).alias("_r")).select(*keys, "_r.*")
    kept = target.alias("t").join(last.select(*keys).alias("s"), _aligned(keys), "left_anti")
    return kept.unionByName(last.where(F.col(op) != "DELETE").select(*target.columns))


# --- a small store of whole snapshots: one folder a version and one manifest row each


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("version long, saved_at timestamp, operation string").parquet(f"{root}/manifest/*")


def versions(spark: SparkSession, root: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in store.listStatus(path)) if store.exists(path) else []


def save_version(df: DataFrame, root: str, operation: str = "WRITE", saved_at: str = "2024-01-01 00:00:00") -> int:
    """Write the next version; its manifest row comes last, so half a version is never read."""
    spark = df.sparkSession
    number = max(versions(spark, root), default=-1) + 1
    df.write.mode("overwrite").parquet(f"{root}/data/version={number}")
    spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(saved_at).cast("timestamp").alias("saved_at"), F.lit(operation).alias("operation")).write.mode("overwrite").parquet(f"{root}/manifest/version={number}")
    return number


def read_version(spark: SparkSession, root: str, version: int | None = None, at: str | None = None) -> DataFrame:
    """A version by number, the one current at a time, or the latest; a time before the first version is an error."""
    if at is not None:
        version = _manifest(spark, root).where(F.col("saved_at") <= F.lit(at).cast("timestamp")).agg(F.max("version")).first()[0]
        if version is None:
            raise ValueError(f"no version at {at}")
    if version is None:
        version = max(versions(spark, root))
    return spark.read.parquet(f"{root}/data/version={version}")


def history(spark: SparkSession, root: str) -> DataFrame:
    return _manifest(spark, root)


def compare_versions(spark: SparkSession, root: str, by: list[str]) -> DataFrame:
    """Row counts by group for every version."""
    out = None
    for v in versions(spark, root):
        x = read_version(spark, root, v).groupBy(*by).agg(F.count("*").alias("n")).withColumn("version", F.lit(v))
        out = x if out is None else out.unionByName(x)
    return out


def append_evolve(target: DataFrame, new: DataFrame) -> DataFrame:
    return target.unionByName(new, allowMissingColumns=True)


def incremental(source: DataFrame, root: str, name: str, ts: str, keys: list[str] | None = None, overlap: str = "0 seconds") -> int:
    """Append the rows that were not loaded yet and advance the watermark to the largest time loaded; returns the rows loaded.

    Read again are the rows from ``overlap`` before the watermark on, the watermark's own time
    included, and those without a time; of these, the ones whose keys (all columns, if none are
    given) were loaded in that stretch are left out.  So rows that tie with the watermark, come late
    by up to ``overlap``, or have no time are loaded once, whenever they come; rows that are later
    than that are not.  The load and its watermark are one numbered batch; the watermark is written
    last, and a batch that failed before is overwritten, so a rerun loads nothing twice.
    """
    spark = source.sparkSession
    done = versions(spark, f"{root}/{name}")
    keys = keys or source.columns
    fresh = source
    if done:
        mark = json.loads(spark.read.parquet(f"{root}/{name}/manifest/version={done[-1]}").first()["operation"])["mark"]
        recent = F.lit(True) if mark is None else F.col(ts).isNull() | (F.col(ts) >= F.lit(mark).cast("timestamp") - F.expr(f"interval {overlap}"))
        known = read_incremental(spark, root, name, source.schema).where(recent).select(*keys).distinct()
        fresh = source.where(recent).alias("t").join(known.alias("s"), _aligned(keys), "left_anti")
    number = max(done, default=-1) + 1
    fresh.write.mode("overwrite").parquet(f"{root}/{name}/data/version={number}")
    loaded = spark.read.schema(source.schema).parquet(f"{root}/{name}/data/version={number}").agg(F.count("*").alias("n"), F.max(ts).cast("string").alias("mark")).first()
    if not loaded["n"]:
        return 0
    highest = max((x for x in (loaded["mark"], mark if done else None) if x is not None), default=None)
    spark.range(1).select(F.lit(number).cast("long").alias("version"), F.current_timestamp().alias("saved_at"), F.lit(json.dumps({"mark": highest})).alias("operation")).write.mode("overwrite").parquet(f"{root}/{name}/manifest/version={number}")
    return loaded["n"]


def read_incremental(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    done = versions(spark, f"{root}/{name}")
    return spark.read.schema(schema).parquet(*(f"{root}/{name}/data/version={v}" for v in done))


def backfill(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def rerun(source: DataFrame, path: str, partition: str, values: list, build) -> None:
    """Run a job again for some values of a partition column (ingest dates, say): their rows are built from the source anew and replace what the table has of them; one for which nothing is built is emptied."""
    spark = source.sparkSession
    fresh = build(source.where(F.col(partition).isin(values)))
    if not fresh.where(~F.coalesce(F.col(partition).isin(values), F.lit(False))).isEmpty():
        raise ValueError("the job made rows of other partitions")
    backfill(fresh, path, partition)
    built = {str(r[0]) for r in fresh.select(partition).distinct().collect()}  # at most as many as values
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in values:
        if str(value) not in built:
            store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}"), True)
