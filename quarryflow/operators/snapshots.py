"""Versioned tables in buckets: a change rewrites the buckets that it touches, and no others.

Rows are dealt into buckets by a hash of their keys.  A version is a manifest row that says, for
each bucket, which version's folder holds it; a change writes the touched buckets anew and a
manifest that points to them and, for the rest, to the folders that were there.  The manifest
comes last, so half a change is never read, and what a failed attempt left is overwritten.  Older
versions stay readable.  One writer at a time.

Take as many buckets as make one of a comfortable size for a task (some 100 MB): a change of m keys
rewrites at most m of them.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .incremental import _aligned, upsert, versions

_MANIFEST = "version long, saved_at timestamp, operation string, batch long, rows long, keys array<string>, buckets int, schema string, places map<int, struct<version: long, rows: long>>"


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/*")


def manifest(spark: SparkSession, root: str, version: int | None = None, at: str | None = None):
    """The manifest row of a version, of the one current at a time, or of the latest."""
    if at is not None:
        version = _manifests(spark, root).where(F.col("saved_at") <= F.lit(at).cast("timestamp")).agg(F.max("version")).first()[0]
        if version is None:
            raise ValueError(f"no version at {at}")
    if version is None:
        version = max(versions(spark, root))
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/version={version}").first()


def _commit(spark: SparkSession, rows: DataFrame, root: str, version: int, keys: list[str], buckets: int, kept: dict, touched: set | None, operation: str, saved_at: str | None, batch: int | None) -> int:
    """Write the rows of the touched buckets (None: all) and the manifest of the version."""
    path = f"{root}/data/version={version}"
    dealt = rows.withColumn("_bucket", _bucket(keys, buckets))
    dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
    written = spark.read.schema("_bucket int").option("basePath", path).parquet(path).groupBy("_bucket").agg(F.count("*").alias("n")).collect()  # a row for each bucket
    if touched is not None and not {r["_bucket"] for r in written} <= touched:
        raise ValueError("a change made rows of keys that neither its batch nor the touched buckets hold")
    places = kept | {r["_bucket"]: (version, r["n"]) for r in written}
    row = (version, None, operation, batch, sum(n for _, n in places.values()), keys, buckets, rows.schema.json(), places)
    made = spark.createDataFrame([row], _MANIFEST).withColumn("saved_at", F.lit(saved_at or _now()).cast("timestamp"))
    made.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return version


def _read(spark: SparkSession, root: str, of, only: set | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(of.schema))
    paths = [f"{root}/data/version={p.version}/_bucket={b}" for b, p in sorted(of.places.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create(df: DataFrame, root: str, keys: list[str], buckets: int = 64, operation: str = "CREATE", saved_at: str | None = None, batch: int | None = None) -> int:
    """The first version, or one that replaces all rows."""
    spark = df.sparkSession
    return _commit(spark, df, root, max(versions(spark, root), default=-1) + 1, keys, buckets, {}, None, operation, saved_at, batch)


def change(spark: SparkSession, root: str, batch: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], operation: str = "CHANGE", saved_at: str | None = None, number: int | None = None) -> int:
    """The next version: ``make(current, batch)`` gives the rows of the buckets that the batch's keys fall in, from what they hold now."""
    of = manifest(spark, root)
    schema = StructType.fromJson(json.loads(of.schema))
    typed = batch.withColumns({k: F.col(k).cast(schema[k].dataType) for k in of["keys"]})  # equal keys of other types hash otherwise
    touched = {r["_b"] for r in typed.select(_bucket(of["keys"], of.buckets).alias("_b")).distinct().collect()}  # at most one for each bucket
    rows = make(_read(spark, root, of, touched), typed).select(*schema.fieldNames())
    kept = {b: (p.version, p.rows) for b, p in of.places.items() if b not in touched}
    return _commit(spark, rows, root, of.version + 1, of["keys"], of.buckets, kept, touched, operation, saved_at, number)


def merge(spark: SparkSession, root: str, batch: DataFrame, update: list[str] | None = None, operation: str = "MERGE", saved_at: str | None = None, number: int | None = None) -> int:
    """Rows of known keys take the listed columns (all), others are added; keys of the batch must not repeat."""
    keys = manifest(spark, root)["keys"]
    return change(spark, root, batch, lambda current, rows: upsert(current, rows, keys, update), operation, saved_at, number)


def delete_keys(spark: SparkSession, root: str, gone: DataFrame, operation: str = "DELETE", saved_at: str | None = None) -> int:
    """Rows of the given keys leave the table; null is a key like others."""
    keys = manifest(spark, root)["keys"]
    return change(spark, root, gone, lambda current, rows: current.alias("t").join(rows.alias("s"), _aligned(keys), "left_anti"), operation, saved_at)


def read(spark: SparkSession, root: str, version: int | None = None, at: str | None = None) -> DataFrame:
    """A version by number, the one current at a time, or the latest; a time before the first version is an error."""
    return _read(spark, root, manifest(spark, root, version, at))


def history(spark: SparkSession, root: str) -> DataFrame:
    """version, saved_at, operation, rows, and how many buckets each version wrote."""
    wrote = F.size(F.filter(F.map_values("places"), lambda p: p["version"] == F.col("version")))
    return _manifests(spark, root).select("version", "saved_at", "operation", "rows", wrote.cast("long").alias("buckets_written"))
