"""Helpers shared by the operators: shared scratch folders, fixed-size bitmaps, safe column names."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (local tests) a temporary folder is chosen and
    remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarryflow.scratch.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-quarryflow-")
        spark.conf.set("quarryflow.scratch.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Slots of a bitmap made by ``bitmap_of``: 2**27 bits at most, so 16 MB to send, whatever the input size; for few keys, some SLOTS for each.
BITMAP_BITS, SLOTS = 27, 256


def bitmap_of(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit for each of 2**bits slots, set where a key falls: a one-hash Bloom filter of bounded size.

    The driver gets at most 2**(bits - 6) rows of 16 bytes, so the size does not grow with the
    input.  Each executor keeps a copy on its disk, so a bitmap of few keys is folded to fewer
    slots.  A lookup never misses a key; it may accept others, so callers use it only to skip
    work, never to decide.
    """
    words = (
        keys.selectExpr(f"{column} & {(1 << bits) - 1}L as slot")
        .selectExpr("slot >> 6 as at", "shiftleft(1L, cast(slot & 63L as int)) as bit")
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
    ).toArrow()
    at, found = words["at"].to_numpy(), words["bits"].to_numpy().view(np.uint64)
    bits = min(bits, max(12, (SLOTS * int(np.bitwise_count(found).sum())).bit_length()))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    np.bitwise_or.at(out, at & (len(out) - 1), found)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20):
    """Consecutive parts of an Arrow batch with about ``most`` bytes of text each (one row at least)."""
    text = batch.column(column)
    if not len(text):
        return
    offsets = text_offsets(text)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    raw = np.frombuffer(text.buffers()[1], dtype=kind)
    return raw[text.offset : text.offset + len(text) + 1].astype(np.int64)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them; null counts as empty."""
    if text.null_count:
        text = text.fill_null("")
    offsets = text_offsets(text)
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_key() -> F.Column:
    """Hash of a row's text: with doc_id it says which text is meant where ids repeat."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``marks`` (doc_id, row_key, kept) rejects.

    A row of ``docs`` that ``marks`` does not name stays.  One that it names with kept = true
    stays once, however often it is repeated.  Rows outside a bitmap of the marked keys pass
    without a shuffle; only the others are joined.
    """
    flags = docs.sparkSession.sparkContext.broadcast(bitmap_of(marks, "row_key"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), row_key().alias("key"))
    flagged = packed.mapInArrow(_split(flags), StructType([*packed.schema.fields, StructField("marked", BooleanType())]))
    clear = flagged.where("not marked").select("row.*")
    named = marks.select(F.col("doc_id").alias("m_id"), F.col("row_key").alias("m_key"), F.col("kept").alias("m_kept"))
    joined = flagged.where("marked").join(named, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left")
    once = joined.where("m_kept").dropDuplicates(["id", "key"])
    return clear.unionByName(joined.where("m_kept is null").select("row.*")).unionByName(once.select("row.*"))


def _split(bitmap):
    def run(batches):
        flags = bitmap.value
        for batch in batches:
            marked = pa.array(in_bitmap(flags, batch.column("key").to_numpy()) if batch.num_rows else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([*batch.columns, marked], ["row", "id", "key", "marked"])

    return run
