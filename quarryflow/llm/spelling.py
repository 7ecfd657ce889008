"""Spelling variants: which words differ by one letter, and the form that each is a variant of.

Words are near if one inserted, deleted or replaced letter leads from one to the other.  Near words
are found by blocked Gram matrices: of a block's words the letters are counted, the product of
that matrix with its transpose gives all squared distances of the counts, and one edit makes a
distance of 1 (lengths that differ by one) or 2 (equal lengths).  Pairs that pass are verified letter
by letter.

*Blocks.*  Lengths are worked off in adjacent pairs, (L, L + 1), from L = 7 on.  Cut into a
beginning of L // 3 letters, a middle as long and an end, a word keeps two of the three in one
edit, counted from its own side: so near words share beginning and middle, or beginning and end,
or middle and end.  Each word sends these three keys for (L, L + 1) and three for (L - 1, L); a
block is the words of one key.  A pair is taken in the first of its keys only.

*Hot blocks.*  Keys of more than ``HOT`` words do without their block: their words send, for each
letter of the third that is free, what is left without it.  Such a block is at most an alphabet
times a word's length, so no block grows with the number of words.

Defined cases: null and empty texts have no words; a null doc_id is written as an empty string in
the hash; rows that are alike in doc_id and text count each; the largest n of near words may be
shared, then the smallest in code-point order is taken; texts and words may be of any length; an empty
table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, materialise

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: Words of a block up to which it is multiplied; rows of a product; letters that a task counts before it sends them on.
HOT, TILE, COUNTED = 4096, 256, 16 << 20
_RUN = re.compile(f"[A-Za-z\xc0-\xff]{{{LEAST_LENGTH},}}")
_LOWER = {c: c + 32 for c in range(65, 91)}
_COLUMN = np.zeros(256, dtype=np.int64)
_COLUMN[97:123] = np.arange(26)
_COLUMN[192:256] = np.arange(26, 90)
_LETTERS = 90
_BEGIN_MIDDLE, _BEGIN_END, _MIDDLE_END = 0, 1, 2
_SENT = "key long, kind int, cls int, word string, n long"


# --- words ------------------------------------------------------------------------------------


def words_of_text(doc_id, text: str) -> Counter:
    """The words of a text with their numbers; one in 31, by document and word, has lost a letter."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(word.encode(), seed)
        if h % 31 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        out[word] += n
    return out


def _count(batches):
    seen: Counter = Counter()
    letters = 0

    def sent():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if text:
                before = len(seen)
                own = words_of_text(doc_id, text)
                seen.update(own)
                if own:
                    letters += (len(seen) - before) * (sum(map(len, own)) // len(own) + 64)
                if letters > COUNTED:
                    yield sent()
                    seen.clear()
                    letters = 0
    if seen:
        yield sent()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur often enough."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- blocks -----------------------------------------------------------------------------------


def keys(words: DataFrame) -> DataFrame:
    """Rows (key, kind, cls, word, n): the six keys of each word, three for each pair of lengths that it belongs to."""
    size = F.char_length("word")
    third = F.floor(F.col("cls") / 3).cast("int")
    both = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("cls")).where(F.col("cls") >= LEAST_LENGTH)
    end = F.col("cls") - 2 * third
    part = lambda start, length: F.substring("word", start, length)
    last = lambda length: part(size - length + 1, length)
    parts = {_BEGIN_MIDDLE: part(F.lit(1), 2 * third), _BEGIN_END: F.concat(part(F.lit(1), third), last(end)), _MIDDLE_END: last(F.col("cls") - third)}
    each = F.array(*(F.struct(F.lit(k).alias("kind"), p.alias("part")) for k, p in parts.items()))
    out = both.withColumn("k", F.explode(each))
    return out.select(F.xxhash64("k.kind", "cls", "k.part").alias("key"), F.col("k.kind").alias("kind"), "cls", "word", "n")


def _free(kind: int, cls: int, size: int) -> range:
    """The letters of a word that a key of this kind leaves open."""
    third = cls // 3
    if kind == _BEGIN_MIDDLE:
        return range(2 * third, size)
    if kind == _BEGIN_END:
        return range(third, size - (cls - 2 * third))
    return range(0, size - (cls - third))


def finer(kind: int, cls: int, word: str) -> set[int]:
    """Keys of a word of a hot block: the word without one free letter, or for the shorter length the word itself."""
    free = _free(kind, cls, len(word))
    seed = zlib.crc32(f"{kind}:{cls}:".encode())
    names = {f"-{word[:i]}{word[i + 1:]}" for i in free} if len(word) > cls else {f"-{word}"} | {f"{i}:{word[:i]}{word[i + 1:]}" for i in free}
    return {int.from_bytes(_digest(seed, x), "little", signed=True) for x in names}


def _digest(seed: int, name: str) -> bytes:
    return hashlib.blake2b(name.encode(), digest_size=8, salt=seed.to_bytes(4, "little")).digest()


def _split_hot(flags):
    def run(batches):
        hot = flags.value
        for batch in batches:
            here = in_bitmap(hot, batch.column("key").to_numpy()) if batch.num_rows else np.zeros(0, dtype=bool)
            yield batch.filter(pa.array(~here))
            for at in np.flatnonzero(here).tolist():
                _, kind, cls, word, n = (batch.column(i)[at].as_py() for i in range(5))
                own = list(finer(kind, cls, word))
                many = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((own, [kind] * many, [cls] * many, [word] * many, [n] * many), batch.schema)], schema=batch.schema)

    return run


# --- products ---------------------------------------------------------------------------------


def letter_counts(words: list[str]) -> np.ndarray:
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    cells = np.repeat(np.arange(len(words)) * _LETTERS, sizes) + _COLUMN[codes]
    counts = np.bincount(cells, minlength=len(words) * _LETTERS).reshape(-1, _LETTERS)
    return counts.astype(np.float32 if sizes.max() <= 2000 else np.float64)  # either holds the products exactly


def close_pairs(counts: np.ndarray, sizes: np.ndarray, block: np.ndarray):
    """Rows (i, j), i < j, of one block whose counts are as far apart as one edit makes them; products of ``TILE`` rows at a time."""
    square = (counts * counts).sum(axis=1)
    for at in range(0, len(counts), TILE):
        to = min(at + TILE, len(counts))
        apart = square[at:to, None] + square[None, at:] - 2 * (counts[at:to] @ counts[at:].T)
        longer = np.abs(sizes[at:to, None] - sizes[None, at:])
        i, j = np.nonzero((apart == 2 - longer) & (longer <= 1) & (block[at:to, None] == block[None, at:]))
        keep = i < j
        yield from zip((i[keep] + at).tolist(), (j[keep] + at).tolist())


def shared(x: str, y: str) -> tuple[int, int]:
    """Letters that two words share at their beginning and at their end."""
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i] != y[i]), least)
    tail = next((i for i in range(least) if x[-1 - i] != y[-1 - i]), least)
    return head, tail


def near_by(x: str, y: str, cls: int, kind: int) -> bool:
    """Whether two different words are near, and this is the first kind of key of theirs that is equal."""
    if len(x) > cls and len(y) > cls:
        return False
    head, tail = shared(x, y)
    if head + tail < cls - (len(x) == len(y)):
        return False
    third = cls // 3
    if head >= 2 * third:
        return kind == _BEGIN_MIDDLE
    if head >= third and tail >= cls - 2 * third:
        return kind == _BEGIN_END
    return kind == _MIDDLE_END


def _multiply(block: np.ndarray, kinds: list[int], classes: list[int], words: list[str], counts: list[int]):
    """(word, near words found, the largest n among them, its word) of the rows of some whole blocks."""
    sizes = np.array([len(w) for w in words])
    found: dict[tuple[int, str], tuple[int, int, str]] = {}
    for i, j in close_pairs(letter_counts(words), sizes, block):
        x, y = words[i], words[j]
        if x != y and near_by(x, y, classes[i], kinds[i]) and kinds[i] == kinds[j] and classes[i] == classes[j]:
            for word, other, n in ((x, y, counts[j]), (y, x, counts[i])):
                many, least, best = found.get(word, (0, 0, ""))
                if not many or (-n, other) < (least, best):
                    least, best = -n, other
                found[word] = (many + 1, least, best)
    return found


def _pairs(batches):
    """Rows sorted by key in; for each word of a block that has near words there, their number and the best of them, out."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held is None:
            continue
        key = held.column("key").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        whole = len(key) if batch is None else int(edges[-1])  # the last key may go on
        if not whole:
            continue
        ends = np.concatenate((edges[1:], [len(key)]))
        done = ends <= whole
        starts, sizes = edges[done], (ends - edges)[done]
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]
        rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        part = held.slice(0, whole).take(pa.array(rows))
        block = np.repeat(np.arange(len(sizes)), sizes)
        kinds, classes, words, counts = (part.column(c).to_pylist() for c in ("kind", "cls", "word", "n"))
        upto = np.cumsum(sizes)
        at = first = 0
        out = []
        while first < len(sizes):
            after = max(first + 1, int(np.searchsorted(upto, at + TILE, side="right")))
            to = int(upto[after - 1])
            found = _multiply(block[at:to], kinds[at:to], classes[at:to], words[at:to], counts[at:to])
            out += [(w, many, -least, best) for w, (many, least, best) in found.items()]
            at, first = to, after
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "near", "best_n", "best"])
        held = held.slice(whole) if whole < len(key) else None


def _then_none(batches):
    yield from batches
    yield None


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words."""
    spark = words.sparkSession
    sent = keys(words)
    many = sent.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > hot)
    # a bitmap may take other keys for hot; all rows of a key are treated alike, so it costs time only
    flags = spark.sparkContext.broadcast(bitmap_of(many, "key"))
    blocks = sent.mapInArrow(_split_hot(flags), _SENT).repartition("key").sortWithinPartitions("key")
    found = blocks.mapInArrow(_pairs, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the chain of forms, by joining chains with themselves; counts grow tenfold by step, so a few rounds end it."""
    reached = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("via"), F.col("root").alias("further"))
        step = reached.join(onward, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("via").isNotNull().alias("moved"))
        step = materialise(step, "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per word: form (the near word of largest n, if ten times as frequent), root (the end of the chain of forms), n, n_near, form_n."""
    words = materialise(count_words(docs), "words")
    near = near_words(words, hot).withColumnRenamed("word", "w")
    formed = F.col("best_n") >= FORM_RATIO * F.col("n")
    each = words.join(near, F.col("word") == F.col("w"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    each = materialise(each, "forms")
    ends = roots(each.where("form is not null")).withColumnRenamed("word", "w")
    return each.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
