"""Substring dedup: Rabin-Karp hashes of fixed-length token windows, counted in Spark.

A word goes if a window of ``width`` consecutive words that covers it also starts in a document
with a smaller doc_id.  Every window is hashed.  Shipping every hash would cost several times
the input, so windows are first thinned without loss: a window's *anchor* is the smallest hash
among its ``gram``-word parts; equal windows have equal anchors and neighbouring windows mostly
share one, so the anchors are about one in twenty of the words.  Only windows whose anchor
occurs under two doc_ids or more are counted.

Steps: (1) anchors with their smallest and largest doc_id, grouped; (2) repeated anchors as a
bitmap of fixed size; (3) windows under these anchors, one row for a run of neighbours, grouped
by anchor, each compared with the smallest doc_id of its hash; (4) ranges of removed words
joined to the documents and merged into maximal intervals.

Within a slice of rows a window is sent once, under its smallest doc_id, so a passage that a
third of all documents hold costs one row a slice.  Keys are the 64-bit anchor and the 64-bit
window hash together, of words hashed from a seed that each call draws anew.

Defined cases: null text has no words; rows with a null doc_id stay whole and remove nothing;
rows that share a doc_id never remove from each other; a repeated window inside one document
stays; texts shorter than a window stay; very long texts and words are taken whole; other columns
play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, scratch, slices
from .textkernel import fresh_seed, mix, ngram_hashes, sliding_min, words_of

WIDTH, GRAM = 50, 12
_TOP = np.iinfo(np.uint64).max


def _windows(words, width: int, gram: int):
    """Anchor of each window, which starts are real windows, and the row of each."""
    grams, whole = ngram_hashes(words, gram)
    grams = mix(grams)
    grams[~whole] = _TOP
    anchors = sliding_min(grams, width - gram + 1)
    count = len(anchors)
    rows = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))[:count]
    return anchors, words.offsets[rows + 1] - np.arange(count) >= width, rows


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_rows(width: int, gram: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                anchors, real, rows = _windows(words_of(part.column("text"), seed=seed), width, gram)
                starts = np.flatnonzero(real)
                if not len(starts):
                    continue
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (anchors[starts[1:]] != anchors[starts[:-1]]) | (rows[starts[1:]] != rows[starts[:-1]])
                starts = starts[new]
                ids, keys = _ids(part)[rows[starts]], anchors[starts]
                order = np.lexsort((ids, keys))
                ids, keys = ids[order], keys[order]
                edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                last = np.concatenate((edge[1:], [len(keys)])) - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[edge].view(np.int64)), pa.array(ids[edge]), pa.array(ids[last])], ["anchor", "low", "high"])

    return run


def _runs(anchors, rows, at):
    """First index and length of each run of neighbouring window starts with one anchor in one row."""
    if not len(at):
        return at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchors[at[1:]] != anchors[at[:-1]]) | (rows[at[1:]] != rows[at[:-1]])
    first = np.flatnonzero(new)
    return first, np.diff(np.concatenate((first, [len(at)])))


_RUN = "anchor long, doc_id long, row_key long, pos long, size long, hashes binary"


def _run_rows(bitmap, width: int, gram: int, seed: int):
    def run(batches):
        flags = bitmap.value
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), seed=seed)
                anchors, real, rows = _windows(words, width, gram)
                at = np.flatnonzero(real)
                at = at[in_bitmap(flags, anchors[at])]
                if not len(at):
                    continue
                hashes = mix(ngram_hashes(words, width)[0][at])
                ids = _ids(part)[rows[at]]
                order = np.lexsort((ids, hashes))
                new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
                least = np.empty(len(at), dtype=np.int64)
                least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                keys = part.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64)
                # windows that this slice shows to be repeats need no comparison; the others send their hashes
                for chosen, compare in ((ids > least, False), (ids == least, True)):
                    kept, own = at[chosen], hashes[chosen]
                    first, size = _runs(anchors, rows, kept)
                    if not len(first):
                        continue
                    start = kept[first]
                    row = rows[start]
                    raw = own.tobytes()
                    blobs = [raw[8 * a : 8 * (a + n)] for a, n in zip(first.tolist(), size.tolist())] if compare else [None] * len(first)
                    yield pa.RecordBatch.from_arrays(
                        # what needs no comparison is dealt by document, so that no anchor's key gets a row from each of its documents
                        [pa.array(anchors[start].view(np.int64) if compare else keys[row]), pa.array(_ids(part)[row]), pa.array(keys[row]), pa.array(start - words.offsets[row]), pa.array(size.astype(np.int64)), pa.array(blobs, pa.binary())],
                        ["anchor", "doc_id", "row_key", "pos", "size", "hashes"],
                    )

    return run


def _resolve(table: pa.Table):
    """Runs of whole anchors in, ranges of window starts that an earlier doc_id also has out."""
    blobs = table["hashes"].combine_chunks()
    known = blobs.is_valid().to_numpy(zero_copy_only=False)
    ids, keys, pos, size, anchor = (table[c].to_numpy() for c in ("doc_id", "row_key", "pos", "size", "anchor"))
    out = [(ids[~known], keys[~known], pos[~known], size[~known])]
    at = np.flatnonzero(known)
    if len(at):
        hashes = np.frombuffer(b"".join(blobs.filter(blobs.is_valid()).to_pylist()), dtype=np.uint64)
        n = size[at]
        run = np.repeat(at, n)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((ids[run], hashes, anchor[run]))
        h, a = hashes[order], anchor[run][order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])))
        least = np.empty(len(run), dtype=np.int64)
        least[order] = ids[run][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.flatnonzero(ids[run] > least)
        if len(gone):
            r, o = run[gone], offset[gone]
            edge = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1))))
            r, o = r[edge], o[edge]
            out.append((ids[r], keys[r], pos[r] + o, np.diff(np.concatenate((edge, [len(gone)])))))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(4)], ["doc_id", "row_key", "pos", "size"])


def _resolve_rows(batches):
    """Batches come sorted by anchor; whole anchors are resolved together, about a million windows at a time."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += int(batch.column("size").to_numpy().sum())
        if count < 1 << 20:
            continue
        table = pa.concat_tables(held)
        anchor = table["anchor"].to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield _resolve(table.slice(0, cut))
            table = table.slice(cut)
        held, count = [table], int(table["size"].to_numpy().sum())
    if held:
        yield _resolve(pa.concat_tables(held))


def removal_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_key, first, last): word ranges to remove, one row each; they may overlap."""
    spark, seed = docs.sparkSession, fresh_seed()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key")).where("doc_id is not null and text is not null")
    seen = base.select("doc_id", "text").mapInArrow(_anchor_rows(width, gram, seed), "anchor long, low long, high long")
    again = seen.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    bitmap = spark.sparkContext.broadcast(bitmap_of(again, "anchor"))
    runs = base.mapInArrow(_run_rows(bitmap, width, gram, seed), _RUN).repartition("anchor").sortWithinPartitions("anchor")
    gone = runs.mapInArrow(_resolve_rows, "doc_id long, row_key long, pos long, size long")
    return gone.select("doc_id", "row_key", F.col("pos").alias("first"), (F.col("pos") + F.col("size") + width - 1).alias("last"))


def _cut(batches):
    """Per document: its words without the merged ranges, joined by one space."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"))
            ranges = part.column("ranges")
            kept_text, removed, total = [], [], []
            for row in range(part.num_rows):
                low, high = int(words.offsets[row]), int(words.offsets[row + 1])
                n = high - low
                keep = np.ones(n, dtype=bool)
                if ranges[row].is_valid and n:
                    flat = ranges[row].values
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, flat.field("first").to_numpy(), 1)
                    np.add.at(edge, flat.field("last").to_numpy(), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                total.append(n)
                removed.append(n - int(keep.sum()))
                if n:
                    s, e = words.starts[low:high][keep], words.ends[low:high][keep]
                    if len(s):
                        # bytes of kept words plus one place after each, filled with a blank
                        size = e - s + 1
                        place = np.cumsum(size) - size
                        index = np.arange(int(size.sum())) - np.repeat(place - s, size)
                        raw = words.data[np.minimum(index, len(words.data) - 1)]
                        raw[place + size - 1] = 32
                        kept_text.append(raw[:-1].tobytes())
                        continue
                kept_text.append(b"")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept_text]), pa.array(kept_text, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))
    ranges = removal_ranges(docs, width, gram).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    joined = base.join(ranges.hint("shuffle_hash"), ["doc_id", "row_key"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).drop("kept_text")
