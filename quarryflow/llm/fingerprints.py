"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, for two primes, the array of prefix sums of code point * base**position.
From it any span's hash comes in constant time, so spans of two texts are compared without
reading them, and the longest common extension of two positions is found by binary search.

A document's fingerprint is a string of fixed length: the hash of the whole text (16 hex
digits), then the smallest span hash in each of ``BINS`` bins (4 hex digits a bin), first over all
spans of five consecutive words, then over all spans of five code points.  Of either kind the share
of equal bins among those that one of two fingerprints fills is a likeness; the two are weighed by
how many of the bins of words are filled.  So a long text is compared by words, one of a few words
by code points, and nothing changes at once between.
Beside the likeness stand ``same_edited`` and ``same_next``, the lengths of the longest common
beginnings of the two texts, found by binary search over the prefix arrays.

Each text meets the next document's by one shuffle: rows are dealt into ranges of doc_id and
the first row of each range is also sent to the range before.  The ranges' first ids, one a
partition, are all that the driver sees.

Defined cases: null text is empty; an empty text has an empty set of spans and is like another
empty text only; null doc_ids come first; rows that share a doc_id are ordered by text; one row
alone is its own next; rows that are alike follow each other and each get a row; texts may
be of any length; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .textkernel import mix

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
BINS, SPAN = 64, 5
#: Code points of a span of letters.
LETTERS = 5
_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    have = _tables.get((base, prime))
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1] = base
        at = 2
        while at < size:  # base**(at+i) = base**at * base**i
            step = np.uint64(int(have[at - 1]) * base % prime)
            have[at : 2 * at] = have[:at] * step % np.uint64(prime)
            at *= 2
        _tables[base, prime] = have
    return have[:n]


class PrefixHash:
    """Modular prefix arrays of a sequence of code points."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.sums = []
        shifted = symbols.astype(np.uint64) + np.uint64(1)
        for base, prime in zip(BASES, PRIMES):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(shifted * _powers(base, prime, self.n) % np.uint64(prime), out=sums[1:])
            sums %= np.uint64(prime)
            self.sums.append(sums)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [starts, ends); equal spans have equal hashes wherever they stand."""
        parts = []
        for base, prime, sums in zip(BASES, PRIMES, self.sums):
            p = np.uint64(prime)
            back = _powers(pow(base, -1, prime), prime, self.n + 1)[starts]
            parts.append((sums[ends] + p - sums[starts]) % p * back % p)
        return parts[0] << np.uint64(31) | parts[1]

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        """Whether two spans are equal; each sum is moved to the other's place, so that nothing is divided."""
        for base, prime, mine, theirs in zip(BASES, PRIMES, self.sums, other.sums):
            table = _powers(base, prime, max(start, at) + 1)
            here = (int(mine[start + length]) - int(mine[start])) * int(table[at])
            if (here - (int(theirs[at + length]) - int(theirs[at])) * int(table[start])) % prime:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common stretch from ``start`` here and ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprint(symbols: np.ndarray, hashes: PrefixHash | None = None) -> str:
    """The fingerprint of a text given as code points (and its prefix arrays, where they are at hand)."""
    n = len(symbols)
    hashes = hashes or PrefixHash(symbols)
    whole = mix(hashes.spans(np.array([0]), np.array([n])) ^ np.uint64(n))
    space = (symbols == 32) | ((symbols >= 9) & (symbols <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    starts, ends = starts[: max(0, len(starts) - SPAN + 1)], ends[SPAN - 1 :]
    width = min(n, LETTERS)
    letters = np.arange(n - width + 1 if n else 0)
    return f"{int(whole[0]):016x}" + _bins(hashes, starts, ends) + _bins(hashes, letters, letters + width)


def _bins(hashes: PrefixHash, starts: np.ndarray, ends: np.ndarray) -> str:
    bins = np.zeros(BINS, dtype=np.uint64)
    if len(starts):
        mixed = np.sort(mix(hashes.spans(starts, ends) + np.uint64(1)))
        limits = np.arange(BINS, dtype=np.uint64) << np.uint64(58)
        first = np.searchsorted(mixed, limits)
        found = np.flatnonzero(first < len(mixed))
        values = mixed[first[found]]
        own = (values >> np.uint64(58)).astype(np.int64) == found
        bins[found[own]] = values[own] % np.uint64(65535) + np.uint64(1)
    return bins.astype(">u2").tobytes().hex()


def likeness(one: str, other: str) -> float:
    """0 to 1 from two fingerprints alone; 1 for equal ones."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x[16:]), dtype=">u2").reshape(2, BINS) for x in (one, other))
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    words, letters = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1)
    weight = filled[0] / BINS
    return float(weight * words + (1 - weight) * letters)


def edited(symbols: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter of ``symbols`` replaced by as many first code points of ``following`` (or all)."""
    cut = len(symbols) // 4
    return np.concatenate((symbols[: len(symbols) - cut], following[:cut]))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _OUT.split(", ")])


def _pairs(batches):
    """Rows in order; each but the borrowed ones is answered as its next comes in."""
    last = None
    out: list[list] = []
    for batch in batches:
        ids, texts, buckets, borrowed = (batch.column(c) for c in ("doc_id", "text", "bucket", "borrowed"))
        for i in range(batch.num_rows):
            bucket, guest = buckets[i].as_py(), borrowed[i].as_py()
            if guest and (last is None or last[0] != bucket):
                last = None
                continue  # a later row with the id of the one borrowed
            symbols = code_points(texts[i].as_py() or "")
            hashes = PrefixHash(symbols)
            mark = fingerprint(symbols, hashes)
            if last is not None and last[0] == bucket:
                _, doc_id, own, own_hashes, own_mark = last
                changed = edited(own, symbols)
                changed_hashes = PrefixHash(changed)
                changed_mark = fingerprint(changed, changed_hashes)
                digest = hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                out.append([doc_id, len(own), digest, own_mark, changed_mark, likeness(own_mark, changed_mark), likeness(own_mark, mark), own_hashes.common_extension(0, changed_hashes, 0), own_hashes.common_extension(0, hashes, 0)])
            last = None if guest else (bucket, ids[i].as_py(), symbols, hashes, mark)
            if len(out) >= 2000:
                yield _rows(out)
                out = []
    if out:
        yield _rows(out)


def _rows(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


def _buckets(limits: list[int]):
    """How many limits lie below an id (none below null), by binary search."""

    @F.arrow_udf("int")
    def run(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(np.array(limits, dtype=np.int64), ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, found).astype(np.int32))

    return run


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    limits = base.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    limits = sorted({int(x) for x in limits})
    # bucket 0: nulls and ids up to the first limit
    bucket = _buckets(limits)("doc_id") if limits else F.lit(0)
    base = base.withColumn("bucket", bucket)
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))
    heads = sorted(((r.bucket, r.head.doc_id) for r in base.groupBy("bucket").agg(F.min(key).alias("head")).collect()), key=lambda x: x[0])
    before = [(heads[i][0], heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    heads = spark.createDataFrame(before, "head_bucket int, head_id long, to int")
    # at most one row a partition: always small enough to broadcast
    dealt = base.join(F.broadcast(heads), (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("head_id")), "left")
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("borrowed")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("borrowed")))
    dealt = dealt.select("doc_id", "text", F.explode(F.filter(places, lambda x: x.bucket.isNotNull())).alias("at")).select("doc_id", "text", "at.bucket", "at.borrowed")
    dealt = dealt.repartitionById(max(n, 1), F.col("bucket")).sortWithinPartitions("bucket", "borrowed", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return dealt.mapInArrow(_pairs, _OUT)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
