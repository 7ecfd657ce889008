"""Token counts as delta-maintained rollups.

A change says that a document's count for one tokenizer version appears (insert), disappears
(delete) or becomes another (revise); it carries the old and the new count, so it turns into a
signed row without looking anything up.  A batch of changes is aggregated to one delta row for
each (source, lang, version) and committed under its batch number: the delta is written first,
then a marker.  A batch that has its marker is not applied again, and one that failed half way
is overwritten by its next attempt, so commits are idempotent.  Totals are the sum of the
committed deltas; ``compact`` replaces old batches by one.

Defined cases: null source or lang is a group of its own; null counts count as 0; an empty batch
is committed and changes nothing; groups whose documents are all gone stay with zeros, so that a
reader sees that they were emptied; every row is a document of its own, also where doc_ids are
null or repeated; other columns play no part; an empty table gives empty totals.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_lexicon import count_tokens
from .common import WORD, materialise, scratch

#: Tokenizer versions of the query: words between white space, and a public BPE vocabulary.
WORDS, BPE = "words-1", "word_bpe_49k"
#: Letters of a token that a document brings before it is encoded.
LETTERS = 4
_DELTA = "source string, lang string, version string, d_docs long, d_tokens long"


def changes(op: str, rows: DataFrame, old: str | None = None, new: str | None = None) -> DataFrame:
    """Change rows of one kind from (source, lang, version) and the named count columns; a row is a document."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c else F.lit(0).cast("long")
    return rows.select(F.lit(op).alias("op"), "source", "lang", "version", count(old).alias("old_tokens"), count(new).alias("new_tokens"))


def delta(batch: DataFrame) -> DataFrame:
    """Signed sums of a batch of changes; partial sums meet before the shuffle, so a hot source costs a row a task."""
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return batch.groupBy("source", "lang", "version").agg(F.sum(docs).cast("long").alias("d_docs"), F.sum(F.col("new_tokens") - F.col("old_tokens")).alias("d_tokens"))


def committed(spark: SparkSession, root: str) -> set[int]:
    """Numbers of the batches that count."""
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/committed")
    store = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(marks):
        return set()
    return {int(s.getPath().getName().split("=")[1]) for s in store.listStatus(marks)}


def commit(spark: SparkSession, root: str, number: int, batch: DataFrame) -> bool:
    """Apply a batch once; False if it was applied before."""
    if number in committed(spark, root):
        return False
    delta(batch).write.mode("overwrite").parquet(f"{root}/deltas/batch={number}")
    spark.range(1).write.mode("overwrite").parquet(f"{root}/committed/batch={number}")
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, version, docs, tokens over all committed batches."""
    done = sorted(committed(spark, root))
    rows = spark.createDataFrame([], _DELTA)
    if done:
        rows = spark.read.schema(_DELTA).parquet(*(f"{root}/deltas/batch={n}" for n in done))
    return rows.groupBy("source", "lang", "version").agg(F.sum("d_docs").alias("docs"), F.sum("d_tokens").alias("tokens"))


def compact(spark: SparkSession, root: str, to: str) -> str:
    """The totals so far as batch 0 of a new store."""
    rows = totals(spark, root).select("source", "lang", "version", F.col("docs").alias("d_docs"), F.col("tokens").alias("d_tokens"))
    rows.write.parquet(f"{to}/deltas/batch=0")
    spark.range(1).write.parquet(f"{to}/committed/batch=0")
    return to


def counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """source, lang, n_words, n_guess and n_tokens of every row: words, tokens as its length suggests, and tokens as encoded."""
    docs.sparkSession.sparkContext.addFile(vocabulary_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    guess = F.ceil(F.char_length(text) / LETTERS).cast("long")
    return docs.select("source", "lang", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), guess.alias("n_guess"), count_tokens(os.path.basename(vocabulary_path))("text").alias("n_tokens"))


#: Documents with fewer words are deleted again by the query's second batch.
SHORT = 20


def op10_token_rollups(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    """All documents arrive, with words and a guess of their tokens; short ones are deleted; the guesses of the others are revised to the counts of the encoder; a batch comes twice."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("word_bpe_49k.json")
    root = scratch(spark, "rollups")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = materialise(counts(docs, vocabulary_path), "counts")

    def of(rows: DataFrame, version: str, *columns: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("version"), *columns)

    def both(op: str, rows: DataFrame, which: str) -> DataFrame:
        kinds = [changes(op, of(rows, v, c), **{which: c}) for v, c in ((WORDS, "n_words"), (BPE, "n_guess"))]
        return kinds[0].unionByName(kinds[1])

    short = F.col("n_words") < SHORT
    commit(spark, root, 1, both("insert", seen, "new"))
    gone = both("delete", seen.where(short), "old")
    commit(spark, root, 2, gone)
    commit(spark, root, 3, changes("revise", of(seen.where(~short), BPE, "n_guess", "n_tokens"), old="n_guess", new="n_tokens"))
    commit(spark, root, 2, gone)  # delivered again: nothing happens
    return totals(spark, root)
