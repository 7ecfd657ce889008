"""Mixing sources to target weights by hierarchical budgets.

Documents hang from a tree: domain, language, source.  A token budget enters at the root and is
dealt downwards by the weights of the children.  A child that cannot use its share (its capacity
is its tokens times ``max_epochs``) takes what it can; the rest goes to its siblings by weight.
Since each node's share is cut to the capacity of its subtree before it is dealt further, a
shortage is spread among siblings first and reaches the ancestors' siblings only when none of
them has room.  Each leaf then takes whole epochs and, of the last, the prefix of documents in a
seeded order whose tokens fit its quota (the document that crosses the line is taken).

The shares are found for all families at once by running sums over the children ordered by
capacity per weight.  The prefix of a leaf needs no sort of the leaf: documents fall by their
seeded hash into bins, the bins' tokens are summed, and only the bin that holds the line is
ordered, so a leaf with a third of all rows is never in one task.

A token is a word ``[^\\x20\\x09-\\x0D]+``.  Defined cases: null text has no tokens and is taken
with the first bin it falls in; null lang or source is a leaf of its own; a document's order
depends on seed, epoch, doc_id and text; rows alike in both are ordered arbitrarily, which no
result shows; weights that are missing count 1, weights of 0 get nothing unless all siblings
have 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep_rows, materialise, row_key

SEED, SHARE, EPOCHS = 29, 0.8, 1
#: Documents in a bin, on average.
BIN = 2048
LEVELS = ("domain", "lang", "source")
#: Target weights of the query and the pipeline: node path -> weight.  Nodes that are not named weigh 1.
WEIGHTS = {("web",): 3.0, ("books",): 2.0, ("code",): 1.0, ("web", "en"): 4.0, ("books", "en"): 4.0, ("code", "en"): 4.0, ("web", "en", "src0"): 2.0}


def domain_of(source: Column) -> Column:
    """The domain of a source, by its number: web, books or code; other names are web."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long")
    return F.when(number % 3 == 1, "books").when(number % 3 == 2, "code").otherwise("web")


def _share(children: DataFrame, parent: list[str], of: Column) -> DataFrame:
    """Deal ``of`` (the parent's budget) among children with weight and capacity; adds ``budget``."""
    every = Window.partitionBy(*parent)
    weight = F.when(F.max("weight").over(every) > 0, F.col("weight")).otherwise(F.lit(1.0))
    ratio = F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(float("inf")))
    order = every.orderBy("ratio", "child")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = children.withColumn("w", weight).withColumn("ratio", ratio).withColumn("given", of)
    x = x.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # a child is full if its capacity per weight is below the level that the rest would reach without it
    x = x.withColumn("full", F.col("ratio") * F.col("rest") <= F.col("given") - F.col("taken"))
    open_ = F.when(~F.col("full"), F.col("w"))
    level = F.coalesce(F.try_divide(F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(every), F.lit(0)), F.sum(open_).over(every)), F.lit(0.0))
    return x.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.col("w") * level)).cast("long")).drop("w", "ratio", "given", "taken", "rest", "full")


def quotas(leaves: DataFrame, weights: dict, share: float = SHARE, max_epochs: int = EPOCHS) -> DataFrame:
    """Budgets of the leaves (domain, lang, source, tokens, docs): adds ``quota``.  Works level by level on the tree's nodes."""
    spark = leaves.sparkSession
    named = spark.createDataFrame([(len(k), "\x1f".join(k), float(v)) for k, v in weights.items()] or [(0, "", 1.0)], "depth int, path string, weight double")
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    path = lambda d: F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\x00")) for c in LEVELS[:d]))
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long").alias("given"))
    above = total.select(F.lit("").alias("parent"), "given")
    for depth in range(1, len(LEVELS) + 1):
        nodes = leaves.groupBy(path(depth - 1).alias("parent"), path(depth).alias("child")).agg(F.sum("capacity").alias("capacity"))
        # the weights are a parameter of a few rows
        nodes = nodes.join(F.broadcast(named.where(F.col("depth") == depth).select(F.col("path").alias("child"), "weight")), "child", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        dealt = _share(nodes.join(above, "parent"), ["parent"], F.col("given"))
        above = dealt.select(F.col("child").alias("parent"), F.col("budget").alias("given"))
    return leaves.withColumn("parent", path(len(LEVELS))).join(above, "parent").select(*LEVELS, "tokens", "docs", F.col("given").alias("quota"), F.col("parent").alias("leaf"))


def mix(docs: DataFrame, weights: dict | None = None, share: float = SHARE, max_epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row for each document and epoch taken: doc_id, row_key, domain, lang, source, n_tokens, epoch, quota."""
    weights = WEIGHTS if weights is None else weights
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), domain_of(F.col("source")).alias("domain"), "lang", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialise(rows, "tokens")
    leaves = materialise(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    plan = quotas(leaves, weights, share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens")).withColumn("bins", F.ceil(F.col("docs") / BIN))
    plan = materialise(plan, "plan")
    same = lambda a, b: F.coalesce(a, F.lit("\x00")) == F.coalesce(b, F.lit("\x00"))
    p = plan.select(*(F.col(c).alias(f"p_{c}") for c in LEVELS), "quota", "whole", "rest", "bins", "leaf")
    rows = rows.join(p, same(F.col("domain"), F.col("p_domain")) & same(F.col("lang"), F.col("p_lang")) & same(F.col("source"), F.col("p_source"))).drop(*(f"p_{c}" for c in LEVELS))
    # place in the seeded order of the epoch that is taken in part
    rows = rows.withColumn("at", F.xxhash64(F.lit(seed), "whole", "doc_id", "row_key")).withColumn("bin", F.floor((F.shiftrightunsigned("at", 33)) * F.col("bins") / F.lit(float(1 << 31))))
    bins = rows.groupBy("leaf", "bin").agg(F.sum("n_tokens").alias("in_bin"))
    ahead = F.coalesce(F.sum("in_bin").over(Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = materialise(bins.withColumn("ahead", ahead).select(F.col("leaf").alias("b_leaf"), F.col("bin").alias("b_bin"), "in_bin", "ahead"), "bins")
    rows = rows.join(bins, (F.col("leaf") == F.col("b_leaf")) & (F.col("bin") == F.col("b_bin"))).drop("b_leaf", "b_bin")
    inside = rows.where((F.col("rest") > 0) & (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("in_bin") > F.col("rest")))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("leaf", "bin").orderBy(F.shiftrightunsigned("at", 1), "at", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("part", F.when(F.col("ahead") + before < F.col("rest"), 1).otherwise(0))
    outside = rows.where(~((F.col("rest") > 0) & (F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("in_bin") > F.col("rest")))).withColumn("part", F.when((F.col("rest") > 0) & (F.col("ahead") + F.col("in_bin") <= F.col("rest")), 1).otherwise(0))
    taken = outside.unionByName(inside).withColumn("times", F.col("whole") + F.col("part")).where("times > 0")
    return taken.select("doc_id", "row_key", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"), "quota")


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes in its one epoch, with all their columns."""
    taken = mix(docs, max_epochs=1, **options).groupBy("doc_id", "row_key").agg(F.count("*").alias("n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), row_key().alias("k")).groupBy("d", "k").agg(F.count("*").alias("rows"))
    marks = rows.join(taken, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("row_key")), "left").where("n is null").select(F.col("d").alias("doc_id"), F.col("k").alias("row_key"), F.lit(False).alias("kept"))
    return keep_rows(docs, materialise(marks, "left_out"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), max_epochs=2).drop("row_key")
