"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

*Shards.*  Documents are put in order of doc_id and encoded by the tokenizers library.  Their ids,
each document's followed by the end id 0, lie in files of blocks.  A block is a header (16 bytes:
documents, those of them without doc_id, ids), the doc_ids (8 bytes each), their counts of ids
(4 bytes each) and the raw ids, of 2 bytes where the vocabulary has at most 65,536 and of 4
otherwise; all little-endian.  Spark's text sink writes a block as one record.  The id 0 that ends
a block is the sink's record separator, so the files hold nothing else, a task that is run again
leaves no second copy, and any file system that Spark knows will do.  A file has at most
``FILE_BLOCKS`` blocks of about ``BLOCK`` ids; a longer document is a block of its own.

*Index.*  A key is (doc_id, copy); documents that share a doc_id are copies 0, 1, ... in order.
Keys are dealt into buckets of about ``BUCKET`` keys.  A bucket's minimal perfect hash is a
cascade of bit arrays: a key alone in its slot of a level is settled there, the others go to the
next level, and the rank of the key's bit is its place in arrays of fingerprints, files, offsets
and counts.  A lookup reads one bucket, tests a few bits, compares the stored fingerprint and then
knows file, offset and length of the ids: a constant number of reads.

Defined cases: null text is empty and has the end id only; a null doc_id is a key like others and
comes first; rows that share a doc_id are copies of one key, in an order by hashes of their texts,
and each gets a row; texts of any length are encoded whole; a special token's string is that token,
as the library has it; other columns play no part, whatever their names; an empty table has no
shards and gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices
from .textkernel import mix

#: Ids of a block, blocks of a file, keys of an index bucket (mean).
BLOCK, FILE_BLOCKS, BUCKET = 1 << 19, 16, 1024
#: Bytes of text that a shard's task gets, on average, and the largest number of such tasks.
SHARD_TEXT, MOST_SHARDS = 16 << 20, 100_000
#: Bytes that a worker keeps for pieces and their ids, and letters of the longest piece among them.
KEPT_BYTES, KEPT_PIECE = 24 << 20, 256
#: Bytes of text worked on at once, pieces that go to the library in one call.
SLICE, CALL = 4 << 20, 128
END = 0
_LEVELS, _ROOM = 64, 2
_HEAD = 16
# A text may be cut before a blank or line feed that follows no white space (taken widely): no token spans such a place.
_WHITE = "\u180e\u200b\ufeff"
_WIDE = f"\\s{_WHITE}"
_CUT = re.compile(f"(?<=[^{_WIDE}])(?=[ \n])")


# --- encoding ---------------------------------------------------------------------------------


class PieceEncoder:
    """Encodes texts piece by piece through the tokenizers library, each distinct piece once while it is kept.

    No token spans a blank or line feed and what precedes it, so texts are cut there; Arrow splits
    them and finds the pieces that are known, numpy puts the ids together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            special = json.load(f)["added_tokens"]
        self.between = special[0] if special else None
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.forget()

    def forget(self) -> None:
        """The pieces kept, as Arrow strings, whether each ends open to white space, and their ids in one array with the place of each."""
        self.words = pa.array([], pa.large_string())
        self.open_end = np.zeros(0, dtype=bool)
        self.ids, self.sizes, self.starts = np.zeros(0, self.kind), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)

    def _library(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by itself; many go in one call, with a special token between them."""
        mark = self.between and self.between["content"]
        found = {"": b""}
        for piece in pieces:
            if piece and (mark is None or mark in piece or len(piece) > KEPT_PIECE) and piece not in found:
                found[piece] = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()
        rest = [p for p in dict.fromkeys(pieces) if p not in found]
        for at in range(0, len(rest), CALL):
            part = rest[at : at + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = [*np.flatnonzero(ids == self.between["id"]).tolist(), len(ids)]
            if len(ends) != len(part):
                raise RuntimeError("pieces and their ids do not match")
            start = 0
            for piece, end in zip(part, ends):
                found[piece] = ids[start:end].tobytes()
                start = end + 1
        return [found[p] for p in pieces]

    def _learn(self, words: list[str]) -> None:
        """Encode later words of texts (each begins at a line feed or at the blank before it) and keep them."""
        ids = self._library([w if w[:1] == "\n" else f" {w}" for w in words])
        sizes = np.array([len(x) for x in ids], dtype=np.int32) // self.kind.itemsize
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        self.open_end = np.concatenate((self.open_end, np.array([not w or w[-1] in _WHITE or w[-1].isspace() for w in words], dtype=bool)))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), self.kind)))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int32)))

    def _shrink(self) -> None:
        """Beyond ``KEPT_BYTES`` the pieces that were met again stay, unless these are many, and no long ones."""
        if self.words.nbytes + self.ids.nbytes + 13 * len(self.words) <= KEPT_BYTES:
            return
        stay = (self.used > 1) & (pc.utf8_length(self.words).to_numpy() <= KEPT_PIECE)
        if self.sizes[stay].sum() > len(self.ids) // 2:
            self.forget()
            return
        self.words, self.open_end, self.used = self.words.filter(pa.array(stay)), self.open_end[stay], self.used[stay] // 2
        self.ids = self.ids[_ragged(self.starts[stay], self.sizes[stay])]
        self.sizes = self.sizes[stay]
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def texts(self, text: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        self._shrink()
        text = text.cast(pa.large_string()).fill_null("")
        words = pc.split_pattern(pc.replace_substring(text, "\n", " \n"), " ")
        offsets = words.offsets.to_numpy()
        offsets = offsets - offsets[0]
        words = words.flatten()
        place = pc.index_in(words, value_set=self.words)
        codes = place.fill_null(0).to_numpy().copy()
        if place.null_count:
            new = words.filter(place.is_null()).dictionary_encode()
            codes[place.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + new.indices.to_numpy()
            self._learn(new.dictionary.to_pylist())
        self.used += np.bincount(codes, minlength=len(self.used)).astype(np.int32)
        # a later word is no piece by itself if white space or nothing precedes the place where it begins
        first, last = offsets[:-1], offsets[1:] - 1
        joined = self.open_end[codes]
        opening = [w.as_py() for w in words.take(pa.array(first))]
        joined[first] &= np.array([w != "" for w in opening], dtype=bool)
        joined[last] = False
        # the first word of a text begins without a blank
        openings = self._library(opening)
        size = np.array([len(x) for x in openings], dtype=np.int32) // self.kind.itemsize
        ids = np.concatenate((self.ids, np.frombuffer(b"".join(openings), self.kind)))
        starts, sizes = self.starts[codes], self.sizes[codes]
        starts[first], sizes[first] = len(self.ids) + np.cumsum(size) - size, size
        ids = ids[_ragged(starts, sizes)]
        edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))[offsets].tolist()
        out = [ids[a:b] for a, b in zip(edges, edges[1:])]
        for row in np.unique(np.searchsorted(offsets, np.flatnonzero(joined), side="right") - 1).tolist():
            parts = _CUT.split(text[row].as_py())
            known = dict.fromkeys(parts)
            known.update(zip(known, self._library(list(known))))
            out[row] = np.frombuffer(b"".join(map(known.__getitem__, parts)), self.kind)
        return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans of these starts and sizes, one after the other."""
    upto = np.cumsum(sizes, dtype=np.int64)
    kind = np.int32 if not len(upto) or max(upto[-1], starts.max()) < 1 << 31 else np.int64
    places = np.repeat((starts - (upto - sizes)).astype(kind), sizes)
    places += np.arange(len(places), dtype=kind)
    return places


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_encoders: dict[str, PieceEncoder] = {}


def _encoder(name: str) -> PieceEncoder:
    """One per worker process; the file comes with Spark, by name."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = PieceEncoder(SparkFiles.get(name))
    return _encoders[name]


# --- shards -----------------------------------------------------------------------------------


def block_of(doc_ids: list, texts: list[np.ndarray], kind: np.dtype) -> bytes:
    """A block without its last id, which the record separator gives; ids that are null come first."""
    sizes = np.array([len(x) + 1 for x in texts], dtype="<u4")
    nulls = sum(x is None for x in doc_ids)
    head = np.array([len(doc_ids), nulls], dtype="<u4").tobytes() + np.array([sizes.sum(dtype=np.int64)], dtype="<i8").tobytes()
    end = np.full(1, END, kind)
    payload = np.concatenate([x for own in texts for x in (own, end)][:-1])
    return b"".join((head, np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), sizes.tobytes(), payload.astype(kind).tobytes()))


def blocks_of(content: bytes, width: int):
    """(number of documents without id, doc_ids, sizes, place of the first id in the file) of each block of a file."""
    at = 0
    while at < len(content):
        n, nulls = np.frombuffer(content, "<u4", 2, at).tolist()
        total = int(np.frombuffer(content, "<i8", 1, at + 8)[0])
        doc_ids = np.frombuffer(content, "<i8", n, at + _HEAD)
        sizes = np.frombuffer(content, "<u4", n, at + _HEAD + 8 * n).astype(np.int64)
        start = at + _HEAD + 12 * n
        yield nulls, doc_ids, sizes, start
        at = start + total * width


def _blocks(name: str, block: int):
    def run(batches):
        encoder = _encoder(name)
        doc_ids, texts, held = [], [], 0
        for batch in batches:
            for part in slices(batch, most=SLICE):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.texts(part.column("text"))):
                    if texts and held + len(ids) >= block:
                        yield pa.RecordBatch.from_arrays([pa.array([block_of(doc_ids, texts, encoder.kind)], pa.binary())], ["value"])
                        doc_ids, texts, held = [], [], 0
                    doc_ids.append(doc_id)
                    texts.append(ids)
                    held += len(ids) + 1
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([block_of(doc_ids, texts, encoder.kind)], pa.binary())], ["value"])

    return run


def write_shards(docs: DataFrame, vocabulary_path: str, root: str, block: int = BLOCK, shard_text: int = SHARD_TEXT) -> int:
    """Encode every text into files below ``root``/shards, in ascending doc_id order; returns the bytes of an id."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary_path)
    width = id_type(Tokenizer.from_file(vocabulary_path).get_vocab_size()).itemsize
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_SHARDS, max(1, -(-size // shard_text))))
    # a doc_id of many rows is split by its texts, and equal rows by where they come from
    order = ["doc_id", "_hash", "_row"]
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = rows.mapInArrow(_blocks(os.path.basename(vocabulary_path), block), "value binary")
    writer = blocks.select(F.col("value").cast("string")).write.option("lineSep", "\0" * width).option("maxRecordsPerFile", FILE_BLOCKS)
    writer.text(f"{root}/shards")
    return width


def _walk(width: int, digest: bool):
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                content = content.as_buffer()
                start = row = 0
                last, same = (), 0  # the id that the row before has, and how many rows before have it
                for nulls, doc_ids, sizes, at in blocks_of(content, width):
                    n = len(sizes)
                    known = np.arange(n) >= nulls
                    ends = np.cumsum(sizes)
                    begins = ends - sizes
                    offsets = at + begins * width
                    new = np.ones(n, dtype=bool)
                    new[1:] = (doc_ids[1:] != doc_ids[:-1]) | (known[1:] != known[:-1])
                    opening = (int(doc_ids[0]), bool(known[0]))
                    if opening == last:
                        new[0] = False
                    run_at = np.maximum.accumulate(np.where(new, np.arange(n), -same))
                    copy = np.arange(n) - run_at
                    columns = {
                        "file": pa.array(np.full(n, file)),
                        "row": pa.array(np.arange(row, row + n)),
                        "doc_id": pa.array(doc_ids, mask=~known),
                        "offset": pa.array(offsets),
                        "begin": pa.array(start + begins),
                        "n": pa.array(sizes),
                        "copy": pa.array(copy),
                    }
                    if digest:
                        ids = np.frombuffer(content, kind, int(ends[-1]), at).astype("<u4")
                        edges = [0, *ends.tolist()]
                        columns["crc"] = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())
                    yield pa.RecordBatch.from_pydict(columns)
                    last, same = (int(doc_ids[-1]), bool(known[-1])), int(copy[-1]) + 1
                    start, row = start + int(ends[-1]), row + n

    return run


def scan(spark: SparkSession, root: str, width: int, digest: bool = False) -> DataFrame:
    """What the shard files hold: file, row, doc_id, offset (byte of the first id), begin (ids before it in the file), n, copy (rows of its doc_id before it in the file); with ``digest`` also crc, of the ids as 32-bit integers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{root}/shards").where("length > 0")
    number = lambda i: F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)[^/]*$", i).cast("long")
    files = files.select((number(1) * 1_000_000 + number(2)).alias("file"), "content")
    return files.mapInArrow(_walk(width, digest), "file long, row long, doc_id long, offset long, begin long, n long, copy long" + (", crc long" if digest else ""))


# --- the index --------------------------------------------------------------------------------


def key_hash(doc_ids: np.ndarray, known: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the keys, another for each seed; of keys with one copy number it is a bijection, so doc_ids never clash."""
    own = mix(copies.astype(np.uint64) * np.uint64(2) + known.astype(np.uint64) + np.uint64(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    return mix(np.where(known, doc_ids, 0).astype(np.int64).view(np.uint64) ^ own)


def build_bucket(doc_ids: np.ndarray, known: np.ndarray, copies: np.ndarray, values: list[np.ndarray]) -> bytes:
    """The minimal perfect hash of distinct keys, with a fingerprint and the ``values`` (longs) of each, as bytes."""
    left = np.arange(len(doc_ids))
    levels, place, settled = [], np.zeros(len(doc_ids), dtype=np.int64), 0
    for level in range(_LEVELS):
        if not len(left):
            break
        size = -(-len(left) * _ROOM // 64) * 64
        slot = (key_hash(doc_ids[left], known[left], copies[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        mine = alone[slot]
        place[left[mine]] = settled + np.cumsum(alone)[slot[mine]] - 1
        settled += int(alone.sum())
        levels.append(np.packbits(alone, bitorder="little"))
        left = left[~mine]
    if len(left):
        raise ValueError("the index holds a key twice")
    head = np.array([len(doc_ids), len(levels), *(len(x) for x in levels)], dtype="<i8")
    rows = np.empty((len(values) + 1, len(doc_ids)), dtype="<i8")
    for at, column in enumerate([key_hash(doc_ids, known, copies, _LEVELS).view(np.int64), *values]):
        rows[at, place] = column
    return b"".join((head.tobytes(), *(x.tobytes() for x in levels), rows.tobytes()))


def find_in_bucket(blob: bytes, doc_ids: np.ndarray, known: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the bucket holds, and the values of those."""
    n, depth = np.frombuffer(blob, "<i8", 2).tolist()
    sizes = np.frombuffer(blob, "<i8", depth, 16).tolist()
    at, before = 16 + 8 * depth, 0
    place, left = np.full(len(doc_ids), -1, dtype=np.int64), np.arange(len(doc_ids))
    for level, size in enumerate(sizes):
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), bitorder="little")
        slot = (key_hash(doc_ids[left], known[left], copies[left], level) % np.uint64(size * 8)).astype(np.int64)
        hit = bits[slot] == 1
        place[left[hit]] = before + np.cumsum(bits, dtype=np.int64)[slot[hit]] - 1
        before += int(bits.sum())
        left = left[~hit]
        at += size
    rows = np.frombuffer(blob, "<i8", offset=at).reshape(-1, n) if n else np.zeros((1, 0), dtype=np.int64)
    found = place >= 0
    found[found] = rows[0, place[found]] == key_hash(doc_ids[found], known[found], copies[found], _LEVELS).view(np.int64)
    return found, rows[1:, place[found]]


def _keys_of(table: pa.Table):
    doc_ids = table.column("doc_id").combine_chunks()
    return doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), table.column("copy").to_numpy()


_VALUES = ["file", "offset", "start", "n"]


def _bucket(table: pa.Table) -> pa.Table:
    blob = build_bucket(*_keys_of(table), [table.column(c).to_numpy() for c in _VALUES])
    return pa.table({"bucket": table.column("bucket")[:1].combine_chunks(), "blob": pa.array([blob], pa.binary())})


def _find(keys: pa.Table, blobs: pa.Table) -> pa.Table:
    if not keys.num_rows or not blobs.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ["doc_id", "copy", *_VALUES]})
    found, values = find_in_bucket(blobs.column("blob")[0].as_py(), *_keys_of(keys))
    hit = keys.filter(pa.array(found))
    return pa.table({"doc_id": hit.column("doc_id"), "copy": hit.column("copy")} | {c: pa.array(v) for c, v in zip(_VALUES, values)})


def _bucket_of(count: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(count)).cast("int")


def build_index(spark: SparkSession, root: str, width: int) -> None:
    """Write the index of the shards below ``root``: index (a row for each bucket), repeats (doc_ids of several rows), about."""
    rows = scan(spark, root, width)
    rows.write.parquet(f"{root}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    # what each file starts with: ids before it, and rows before it that share the doc_id of its first row
    files = rows.groupBy("file").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"), F.min_by(F.struct("doc_id"), "row").alias("low"), F.max_by(F.struct("doc_id", (F.col("row") - F.col("copy")).alias("at")), "row").alias("high"))
    order = Window.orderBy("file")  # a row for each file
    files = files.withColumns({"base": F.sum("ids").over(order) - F.col("ids"), "at": F.sum("docs").over(order) - F.col("docs"), "goes_on": F.col("low.doc_id").eqNullSafe(F.lag("high.doc_id").over(order)) & (F.row_number().over(order) > 1)})
    begun = F.when((F.col("high.at") > 0) | ~F.col("goes_on"), F.col("at") + F.col("high.at"))
    files = files.withColumn("begun", F.last(begun, True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    files = files.select(F.col("file").alias("f"), "base", F.when(F.col("goes_on"), F.col("at") - F.col("begun")).otherwise(0).alias("carried"), F.col("low.doc_id").alias("opening"))
    count = rows.count()
    buckets = max(1, -(-count // BUCKET))
    more = F.when((F.col("row") == F.col("copy")) & F.col("doc_id").eqNullSafe(F.col("opening")), F.col("carried")).otherwise(0)
    keys = rows.join(files, F.col("file") == F.col("f")).select("doc_id", (F.col("copy") + more).alias("copy"), "file", "offset", (F.col("base") + F.col("begin")).alias("start"), "n")
    keys.withColumn("bucket", _bucket_of(buckets)).groupBy("bucket").applyInArrow(_bucket, "bucket int, blob binary").write.parquet(f"{root}/index")
    keys.where("copy > 0").groupBy("doc_id").agg((F.max("copy") + 1).alias("copies")).write.parquet(f"{root}/repeats")
    spark.createDataFrame([(width, buckets)], "width int, buckets int").coalesce(1).write.parquet(f"{root}/about")


def lookup(spark: SparkSession, root: str, doc_ids: DataFrame) -> DataFrame:
    """Where the ids of the given documents (distinct doc_id) lie: a row (doc_id, copy, file, offset, start, n) for each of their copies; unknown ones have none."""
    about = spark.read.schema("width int, buckets int").parquet(f"{root}/about").first()
    repeats = spark.read.schema("doc_id long, copies long").parquet(f"{root}/repeats").select(F.col("doc_id").alias("r"), "copies")
    keys = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id"))
    keys = keys.join(repeats, F.col("doc_id").eqNullSafe(F.col("r")), "left")
    keys = keys.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy")).withColumn("bucket", _bucket_of(about.buckets))
    blobs = spark.read.schema("bucket int, blob binary").parquet(f"{root}/index")
    kinds = ", ".join(f"{c} long" for c in ["doc_id", "copy", *_VALUES])
    return keys.groupBy("bucket").cogroup(blobs.groupBy("bucket")).applyInArrow(_find, kinds)


def write_tokens(docs: DataFrame, vocabulary_path: str, root: str | None = None) -> str:
    """Shards and index of all documents below ``root`` (a new folder in the shared place); returns it."""
    root = root or scratch(docs.sparkSession, "tokens")
    build_index(docs.sparkSession, root, write_shards(docs, vocabulary_path, root))
    return root


def get_ids(spark: SparkSession, root: str, doc_id: int | None, copy: int = 0) -> list[int] | None:
    """The ids of one document, end id included, or None: one row of the index and one file are read."""
    about = spark.read.schema("width int, buckets int").parquet(f"{root}/about").first()
    key = spark.createDataFrame([(doc_id, copy)], "doc_id long, copy long").withColumn("bucket", _bucket_of(about.buckets))
    blob = spark.read.schema("bucket int, blob binary").parquet(f"{root}/index").where(F.col("bucket") == key.first().bucket).first()
    if blob is None:
        return None
    found, values = find_in_bucket(bytes(blob.blob), np.array([doc_id or 0]), np.array([doc_id is not None]), np.array([copy]))
    if not found[0]:
        return None
    file, offset, _, n = values[:, 0].tolist()
    name = f"part-{file // 1_000_000:05d}-*-c{file % 1_000_000:03d}*"
    content = spark.read.format("binaryFile").option("pathGlobFilter", name).load(f"{root}/shards").select("content").first()[0]
    return np.frombuffer(content, "<u2" if about.width == 2 else "<u4", n, offset).tolist()


def read_tokens(spark: SparkSession, root: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the given documents, each found through the index and read from its shard."""
    width = spark.read.schema("width int, buckets int").parquet(f"{root}/about").first().width
    held = scan(spark, root, width, digest=True).select("file", "offset", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    places = lookup(spark, root, doc_ids).select("doc_id", "file", "offset", "start")
    return places.join(held, ["file", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_token_ids(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = write_tokens(docs, vocabulary_path)
    return read_tokens(spark, root, docs.select("doc_id").distinct())
