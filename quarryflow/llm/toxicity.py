"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

The bag of a text holds its words and the character n-grams of each word between two boundary
marks, hashed into a fixed number of embedding rows.  The text's vector is the mean over the
bag; a softmax over two classes follows.  Unseen misspellings share n-grams with words seen,
hence their vectors.

The model is trained on a bounded sample of labelled rows: of those with texts of at most
``MOST_CHARS``, the ``SAMPLE`` of label 1 and twice as many of label 0 that have the smallest
seeded hash, taken only from rows whose crc32 of doc_id is not 2 modulo 4.  Every fifth of them is set aside to choose the number
of steps and to place the decision at a score of ``CUT``.  Nothing but the text is an input.

Scoring covers every row and the whole text, in one pass without a shuffle; only the texts
leave the JVM.  As everything after the embedding is linear, a row's share of the logit is one
number, and the bags of many texts are looked up and summed by a few array operations over at
most ``PIECE`` code points.  A longer text is cut between words and its sums are added up.

Defined cases: null and empty texts, and any without a letter or digit, get the share of label 1 as
score, or half of ``CUT`` or the bias if that is less, and a short text starts from there; a word of more than ``PIECE``
letters counts as several; labels that are null or of no document are ignored; a doc_id labelled
more than once counts with its larger label, and one that several rows share with the least of
their texts; without both labels in the sample every score is the share of label 1 (0 if none);
a null doc_id is not held out; rows alike have the same score; an empty table gives an empty
result; other columns are kept and play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkernel import WORD_BASE, mix, span_hashes

SAMPLE, MOST_CHARS, SEED = 1200, 4_000, 17
BITS, DIM, GRAMS = 18, 2, (3, 4, 5)
STEPS, RATE, MOMENTUM, PATIENCE = 90, 0.5, 0.9, 10
#: A bag's mean is multiplied by this before the softmax, as toxic words are a few in a hundred.
SCALE = 50.0
#: Units that every bag holds besides, so that a few letters decide nothing; they speak for the share of label 1.
PRIOR = 60
CUT = 0.3
#: Code points looked up at once.
PIECE = 1 << 17
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters or digits."""
    if not _letter:
        _letter.append(np.array([chr(i).isalnum() for i in range(0x110000)], dtype=bool))
    return _letter[0]


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all units of the texts, and the text of each."""
    symbols = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    inside = _letters()[symbols]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # and the first mark after each word
    seq = np.where(inside, symbols, 0)[keep].astype(np.uint64)
    owner = owner[keep]
    seq = np.concatenate(([np.uint64(0)], seq)) + np.uint64(1)
    owner = np.concatenate((owner[:1], owner))
    n = len(seq)
    marks = np.flatnonzero(seq == 1)
    # the mark that ends the word begun at or around each place
    ahead = marks[np.minimum(np.searchsorted(marks, np.arange(n), side="right"), len(marks) - 1)]
    rows, owners = [], []
    total = seq * _MIX[0]
    for width in range(2, max(GRAMS) + 1):
        total = total[: n - width + 1] + (seq[width - 1 :] * _MIX[width - 1])
        if width in GRAMS and len(total):
            real = np.flatnonzero(ahead[: len(total)] >= np.arange(len(total)) + width - 1)
            rows.append(((total[real] + np.uint64(width)) * _MIX[1]) >> np.uint64(64 - BITS))
            owners.append(owner[real + 1])
    if len(marks) > 1:
        words = span_hashes(seq, marks[:-1] + 1, marks[1:], WORD_BASE)
        rows.append((mix(words) * _MIX[1]) >> np.uint64(64 - BITS))
        owners.append(owner[marks[1:]])
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


class Model(NamedTuple):
    #: Share of each embedding row in the logit of label 1, and the bias.
    share: np.ndarray
    bias: float
    #: Logit of a text without units: what a short text starts from, while a long one starts from the bias.
    base: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """One logit a text; letters are lowered here."""
        total, many = np.zeros(len(texts)), np.zeros(len(texts))
        for of, pieces in _portions(texts):
            rows, owners = bags(pieces)
            of = np.array(of)[owners]
            total += np.bincount(of, weights=self.share[rows], minlength=len(texts))
            many += np.bincount(of, minlength=len(texts))
        return (self.bias * many + self.base * PRIOR + SCALE * total) / (many + PRIOR)


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of at most ``PIECE`` code points, each but the last cut after a mark between words if it has one."""
    at = 0
    while len(text) - at > PIECE:
        marks = np.flatnonzero(~_letters()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)])
        to = at + (int(marks[-1]) + 1 if len(marks) else PIECE)
        yield text[at:to]
        at = to
    yield text[at:]


def _portions(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The lowered pieces of the texts and the text of each, about ``PIECE`` code points at a time."""
    of: list[int] = []
    held: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if held and size + len(piece) > PIECE:
                yield of, held
                of, held, size = [], [], 0
            of.append(i)
            held.append(piece.lower())
            size += len(piece)
    if held:
        yield of, held


class _Bags:
    """The bags of some texts as sparse rows, a hundred texts at a time, to multiply by and by their transpose."""

    def __init__(self, texts: list[str]):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        used = np.zeros(1 << BITS, dtype=bool)
        for at in range(0, len(texts), 100):
            rows, owners = bags([t.lower() for t in texts[at : at + 100]])
            pairs, times = np.unique(owners.astype(np.int64) << BITS | rows, return_counts=True)
            of, unit = pairs >> BITS, (pairs & ((1 << BITS) - 1)).astype(np.int32)
            used[unit] = True
            value = times * SCALE / (np.bincount(owners, minlength=100) + PRIOR)[of]
            self.parts.append((unit, value.astype(np.float32), np.bincount(of, minlength=min(100, len(texts) - at))))
        self.used = np.flatnonzero(used)
        place = np.cumsum(used, dtype=np.int32) - 1
        self.parts = [(place[unit], value, many) for unit, value, many in self.parts]

    def dot(self, table: np.ndarray) -> np.ndarray:
        out = []
        for unit, value, many in self.parts:
            sums = np.zeros((len(many), table.shape[1]), dtype=np.float32)
            if len(unit):
                sums[many > 0] = np.add.reduceat(table[unit] * value[:, None], (np.cumsum(many) - many)[many > 0], axis=0)
            out.append(sums)
        return np.concatenate(out)

    def back_dot(self, slope: np.ndarray) -> np.ndarray:
        out = np.zeros((slope.shape[1], len(self.used)))
        at = 0
        for unit, value, many in self.parts:
            own = np.repeat(slope[at : at + len(many)], many, axis=0)
            for k in range(slope.shape[1]):
                out[k] += np.bincount(unit, weights=own[:, k] * value, minlength=len(self.used))
            at += len(many)
        return out.T.astype(np.float32)


def _softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, prior: float, steps: int = STEPS, seed: int = SEED) -> Model:
    """Embeddings and softmax, trained together by full-batch gradient steps with momentum.

    ``prior`` is the share of label 1 among all labelled rows; the sample's labels are weighed
    so as to have it.
    """
    labels = np.asarray(labels, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        logit = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model(np.zeros(1 << BITS, dtype=np.float32), logit, logit)
    docs = _Bags(texts)
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.01, (len(docs.used), DIM)).astype(np.float32)
    # the two classes start well apart, so that the first steps already move the embeddings
    soft = np.sign(random.normal(size=(DIM, 1))).astype(np.float32) * np.array([[-1, 1]], dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    aside = np.arange(len(texts)) % 5 == 4
    if labels[aside].sum() in (0, aside.sum()) or labels[~aside].sum() in (0, (~aside).sum()):
        aside[:] = False
    share = labels.mean()
    mass = np.where(labels == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    # both labels weigh the same while learning; the decision is placed at their true shares
    learn = np.where(labels == 1, 1 / share, 1 / (1 - share)) * ~aside
    learn = (learn / learn.sum()).astype(np.float32)
    truth = np.eye(2, dtype=np.float32)[labels]
    moving = [np.zeros_like(x) for x in (table, soft, bias)]
    largest = [0.0, 0.0, 0.0]
    best = (np.inf, table, soft, bias)
    since = 0
    for _ in range(steps):
        vectors = docs.dot(table)
        odds = _softmax(vectors @ soft + bias)
        judged = aside if aside.any() else ~aside
        loss = float(-np.log(odds[np.arange(len(labels)), labels] + 1e-9)[judged].mean())
        if loss < best[0]:
            best, since = (loss, table.copy(), soft.copy(), bias.copy()), 0
        elif (since := since + 1) >= PATIENCE:
            break
        slope = (odds - truth) * learn[:, None]
        steps_ = (docs.back_dot(slope @ soft.T), vectors.T @ slope, slope.sum(axis=0))
        for k, (param, grad, rate) in enumerate(zip((table, soft, bias), steps_, (RATE, RATE / 10, RATE / 10))):
            # one scale for a whole matrix, so rows that many texts move go further than rare ones
            largest[k] = max(largest[k], float(np.abs(grad).max()), 1e-12)
            moving[k] = MOMENTUM * moving[k] + (1 - MOMENTUM) * grad / largest[k]
            param -= rate * moving[k]
    _, table, soft, bias = best
    lean = soft[:, 1] - soft[:, 0]
    logits = docs.dot(table) @ lean + bias[1] - bias[0]
    judged = aside if aside.any() else ~aside
    cut, scale = _place(logits[judged], labels[judged], mass[judged])
    full = np.zeros(1 << BITS, dtype=np.float32)
    full[docs.used] = table @ lean * scale
    start = float((bias[1] - bias[0] - cut) * scale + np.log(CUT / (1 - CUT)))
    usual = min(max(prior, 1e-6), CUT / 2)  # a text that says nothing is not called toxic, whatever the share
    return Model(full, start, min(start, float(np.log(usual / (1 - usual)))))


def _place(logits, labels, mass) -> tuple[float, float]:
    """The logit at which to decide (largest F1, the middle of the best gap) and the slope of a logistic fit."""
    order = np.argsort(-logits)
    hit = np.cumsum((mass * labels)[order])
    f1 = 2 * hit / (np.cumsum(mass[order]) + hit[-1])
    at = int(np.argmax(f1))
    here, below = logits[order][at], logits[order][min(at + 1, len(order) - 1)]
    spread = float(np.std(logits)) or 1.0
    return float((here + below) / 2), min(50.0, 4.0 / spread)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of the bounded training sample, and the share of label 1 among all labelled rows allowed."""
    key = F.col("doc_id").cast("long").alias("doc_id")
    allowed = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    known = labels.where("toxic is not null and doc_id is not null").groupBy(key).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(allowed)
    known = materialise(known, "labels")
    prior = known.agg(F.avg("toxic")).first()[0]
    if prior is None:
        return [], np.zeros(0), 0.0
    texts = docs.select(key, F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.char_length("text") <= MOST_CHARS)
    known = known.join(texts.where(allowed).select("doc_id"), "doc_id", "left_semi").withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(SEED)))
    first = lambda label, n: known.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(n)
    ids = [(int(r.doc_id), int(r.toxic)) for r in first(1, most).unionByName(first(0, 2 * most)).collect()]
    ids = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    # the ids are at most 3 * most rows, so the texts come by a broadcast join
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r.doc_id).encode()))
    return [r.text for r in rows], np.array([r.toxic for r in rows]), float(prior)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    return train(*sample(docs, labels, most))


def _scores(shared):
    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model = shared.value
        for texts in columns:
            logits = [model.logits([x or "" for x in texts.slice(at, 256).to_pylist()]) for at in range(0, len(texts), 256)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *logits]), -60, 60))))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, with the score of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _scores(shared)("text").alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score below ``CUT``, with all their columns."""
    return score(docs, fit(docs, labels)).where(F.col("score") < CUT).select("row.*")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
