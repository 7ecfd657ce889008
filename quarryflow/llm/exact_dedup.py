"""Exact dedup as a stateful stream.

Arrivals (digest, identifier, length, locator of the content) are a stream of small rows.  A
streaming aggregation keyed by digest keeps, in RocksDB on the executors' disks and without
expiry, the best row seen so far, its locator and the number of rows.  The state never holds
texts.  Where a digest has more than one arrival, the contents are fetched by their locators
and compared byte by byte; texts that share a digest without being equal are grouped by the
text itself.

Texts are equal when the same after deleting white space [\\x20\\x09-\\x0D].  Of equal texts the
row with the most code points stays, then the one with the smallest doc_id.

Defined cases: null text is empty, and all empty texts are equal; a null doc_id loses to any
other of the same length; of rows alike in doc_id and text one stays; texts may be of any length; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bitmap_of, in_bitmap, materialise, scratch

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # else each of many small stores reserves megabytes of disk for files that stay almost empty
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


_ARRIVAL = "doc_id long, row_key long, n_chars long, text_sha256 string, digest string, copies long"
#: Digests of more than one row in HOT are joined by a broadcast; there are fewer than HOT of them.  Contents are broadcast up to so many bytes.
HOT, BROADCAST_BYTES = 1000, 32 << 20
#: Parts that a digest of many rows is cut into where the contents are too large to broadcast.
PARTS = 64


def normalised():
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{SPACE}+", "")


def digest_of(text):
    return F.sha2(text, 256)


def arrivals(docs: DataFrame, digest=digest_of) -> DataFrame:
    """One row for each distinct (doc_id, text): digest, length, locator (doc_id and row_key) and the number of copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), F.char_length(text).cast("long").alias("n_chars"), F.sha2(normalised(), 256).alias("text_sha256"), digest(normalised()).alias("digest"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def stream_groups(spark: SparkSession, state: str, max_files: int = 1000) -> DataFrame:
    """Run the stateful stream over what has arrived below ``state`` since it ran last; per digest the row that stays and the number of rows, of all arrivals so far."""
    folder, out, checkpoint = f"{state}/arrivals", f"{state}/groups", f"{state}/checkpoint"
    schema = "digest string, best struct<n_chars: bigint, order: bigint, doc_id: bigint, row_key: bigint>, rows long"
    stream = spark.readStream.schema(_ARRIVAL).option("maxFilesPerTrigger", max_files).parquet(folder)
    best = F.struct("n_chars", F.bitwise_not("doc_id").alias("order"), "doc_id", "row_key")
    kept = stream.groupBy("digest").agg(F.max(best).alias("best"), F.sum("copies").alias("rows"))

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same batch again replaces itself

    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        query = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # a stream without rows publishes nothing
    found = spark.read.schema(f"{schema}, batch int").parquet(out)
    return found.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max_by("rows", "batch").alias("rows"))


def _having(bitmap):
    def run(batches):
        flags = bitmap.value
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(in_bitmap(flags, batch.column("row_key").to_numpy())))

    return run


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contents by locator: (doc_id, row_key, content, digest) of the wanted rows, without shuffling other texts."""
    flags = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "row_key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), "text")
    rows = rows.mapInArrow(_having(flags), rows.schema).select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), normalised().alias("content"))
    return rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k"))).drop("d", "k")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with the group of its digest.  Digests of more than one row in ``HOT`` - so fewer than ``HOT`` digests - are broadcast, so that no task gets all rows of one.

    Groups with contents are broadcast only if these are small together; else the rows of such a
    digest are cut into parts, and its group has a row for each.
    """
    total = groups.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") * HOT > total
    keys = F.broadcast(groups.where(hot).select("digest"))
    cold = rows.join(keys, "digest", "left_anti").join(groups.where(~hot), "digest")
    often = groups.where(hot)
    if "head_content" in groups.columns and (often.agg(F.sum(F.octet_length("head_content"))).first()[0] or 0) > BROADCAST_BYTES:
        cut = rows.join(keys, "digest", "left_semi").withColumn("part", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(PARTS)).cast("int"))
        each = often.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        warm = cut.hint("merge").join(each, ["digest", "part"]).drop("part")
    else:
        warm = rows.join(F.broadcast(often), "digest")
    return warm.unionByName(cold)


def assign(docs: DataFrame, digest=digest_of, max_files: int = 1000, state: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, keep_id, group_size, kept, text_sha256.

    With a folder ``state`` the keyed state outlives the call: the next one with this folder also
    meets the rows of this one, and reads their contents from ``earlier`` (all documents before).
    A row that stayed in an earlier call and no longer does is reported by no later one.
    """
    spark = docs.sparkSession
    state = state or scratch(spark, "state")
    arrived = materialise(arrivals(docs, digest), "arrivals")
    arrived.write.mode("append").parquet(f"{state}/arrivals")
    groups = materialise(stream_groups(spark, state, max_files), "best")
    members = _with_group(arrived, groups)
    is_head = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    # full bytes of every hit against those of the row that stays, which may be an earlier one
    shared = groups.where("rows > 1")
    all_arrived = arrived if earlier is None else spark.read.schema(_ARRIVAL).parquet(f"{state}/arrivals").groupBy(*(c for c in arrived.columns if c != "copies")).agg(F.sum("copies").alias("copies"))
    known = docs.select("doc_id", "text") if earlier is None else docs.select("doc_id", "text").unionByName(earlier.select("doc_id", "text"))
    hits = _with_group(all_arrived, shared).select("doc_id", "row_key", "digest", is_head.alias("head"))
    contents = materialise(_fetch(known, hits).dropDuplicates(["doc_id", "row_key"]), "hits")
    heads = contents.where("head").select("digest", F.col("content").alias("head_content")).join(shared.select("digest", "rows"), "digest")
    clashes = _with_group(contents.where("not head"), heads).where("content != head_content").select("digest").distinct()
    clashes = materialise(clashes, "clashes")
    if not clashes.isEmpty():
        mixed = contents.join(clashes, "digest", "left_semi").join(all_arrived.select("doc_id", "row_key", "n_chars", "copies", "text_sha256").withColumnsRenamed({"doc_id": "d", "row_key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k"))).drop("d", "k")
        best = mixed.groupBy("content").agg(F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("order"), "doc_id", "row_key")).alias("best"), F.sum("copies").alias("rows"))
        apart = mixed.join(best, "content").select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), F.col("best").alias("own_best"), F.col("rows").alias("own_rows"))
        mended = members.join(clashes, "digest", "left_semi").join(apart, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")))
        columns = ["doc_id", "row_key", "copies", "text_sha256"]
        members = members.join(clashes, "digest", "left_anti").select(*columns, "best", "rows").unionByName(mended.select(*columns, F.col("own_best").alias("best"), F.col("own_rows").alias("rows")))
    each = members.select("doc_id", "row_key", "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("rows").alias("group_size"), is_head.alias("head"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "row_key", "keep_id", "group_size", (F.col("head") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    from .common import keep_rows

    marks = assign(docs).groupBy("doc_id", "row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    return keep_rows(docs, materialise(marks.where("not kept or copies > 1"), "dropped"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
