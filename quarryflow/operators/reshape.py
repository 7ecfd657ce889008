"""Sorting, paging, set operations and reshaping."""

from __future__ import annotations

import math

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import scratch


def order_by_list(df: DataFrame, c: str, values: list, then: list | None = None) -> DataFrame:
    """Sort by a business order; values that the list lacks come last."""
    rank = F.array_position(F.array(*(F.lit(v) for v in values)), F.col(c))
    return df.orderBy(F.when(rank > 0, rank).otherwise(len(values) + 1), *(then or []))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def pivot_wide(df: DataFrame, index: list[str], column: str, value: str, values: list, agg=F.sum, fill=0) -> DataFrame:
    """Long to wide with the values given, which spares a job to find them; empty cells get ``fill``."""
    return df.groupBy(*index).pivot(column, values).agg(agg(value)).na.fill(fill)


def melt_long(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def walk_hierarchy(spark: SparkSession, df: DataFrame, node: str, parent: str, roots: DataFrame, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) of all ancestors or descendants of ``roots``, down to ``max_depth`` if that is given.

    One join a level; each level is written to the shared folder, so lineage stays short and
    survives lost executors.  A cycle ends at the second visit.
    """
    edges = df.select(F.col(parent).alias("_from"), F.col(node).alias("_to")) if direction == "down" else df.select(F.col(node).alias("_from"), F.col(parent).alias("_to"))
    edges = edges.where("_from is not null and _to is not null")
    root = scratch(spark, "walk")
    level = roots.select(F.col(node).alias("root"), F.col(node).alias("node"), F.lit(0).alias("depth"))
    schema = level.schema
    level.write.parquet(f"{root}/level=0")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        seen = spark.read.schema(schema).parquet(f"{root}/level=*")
        last = seen.where(F.col("depth") == depth - 1)
        step = last.join(edges, F.col("node") == F.col("_from")).select("root", F.col("_to").alias("node"), F.lit(depth).alias("depth")).distinct()
        step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "depth")
        step.write.parquet(f"{root}/level={depth}")
        if spark.read.schema(schema).parquet(f"{root}/level={depth}").isEmpty():
            break
    return spark.read.schema(schema).parquet(f"{root}/level=*")


def _links(df: DataFrame, node: str, parent: str) -> DataFrame:
    return df.where(F.col(node).isNotNull() & F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up")).dropDuplicates(["node"])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tree_roots(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) of every node: the end of its chain of parents.

    Pointer doubling: each round joins the paths with themselves, so paths of length 2^k take k
    rounds, and a round has a row a node.  Nodes on a cycle, or below one, have no root: theirs is
    null, with a null depth.  A parent that is no node itself is a root.
    """
    links = _links(df, node, parent)
    nodes = df.where(F.col(node).isNotNull()).select(F.col(node).alias("node")).unionByName(links.select(F.col("up").alias("node"))).distinct()
    at = _written(nodes.join(links.hint("merge"), "node", "left").select("node", F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")), "paths")
    ends = nodes.join(links.hint("merge"), "node", "left_anti")
    rounds = max(1, math.ceil(math.log2(max(2, nodes.count()))) + 1)  # longer paths go round a cycle
    for _ in range(rounds):
        jump = at.select(F.col("node").alias("via"), F.col("root").alias("further"), F.col("depth").alias("more")).where("more > 0")
        step = at.join(jump.hint("merge"), F.col("root") == F.col("via"), "left")
        at = _written(step.select("node", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), "paths")
        moved = not at.where("moved").isEmpty()
        at = at.drop("moved")
        if not moved:
            break
    good = ends.select(F.col("node").alias("end"))
    return at.join(good.hint("merge"), F.col("root") == F.col("end"), "left").select("node", F.when(F.col("end").isNotNull(), F.col("root")).alias("root"), F.when(F.col("end").isNotNull(), F.col("depth")).alias("depth"))


def ancestors(df: DataFrame, node: str, parent: str, of: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): each node (or those in the column of ``of``) as ``root``, with itself and all its ancestors.

    Pointer doubling: round k joins what is known up to 2^k levels with the jumps of 2^k levels, so
    the rounds are as many as the depth has binary digits.  On a cycle a walk ends before it comes to
    a node again.  The result has a row for each pair, which for a chain is quadratic in its length.
    """
    jump = _written(_links(df, node, parent).select("node", "up"), "jumps")
    start = (df if of is None else of).where(F.col(node).isNotNull()).select(F.col(node).alias("root")).distinct()
    known = _written(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "known")
    looped = not tree_roots(df, node, parent).where("root is null").isEmpty()
    length = 1
    while not jump.isEmpty():
        more = known.join(jump.withColumnRenamed("node", "via").hint("merge"), F.col("node") == F.col("via")).select("root", F.col("up").alias("node"), (F.col("depth") + length).alias("depth"))
        both = known.unionByName(more)
        if looped:  # a pair may be met again, further away
            both = both.groupBy("root", "node").agg(F.min("depth").alias("depth"))
        grown = _written(both.select("root", "node", "depth"), "known")
        if looped and grown.count() == known.count():
            return grown
        known = grown
        further = jump.select(F.col("node").alias("via"), F.col("up").alias("next"))
        jump = _written(jump.join(further.hint("merge"), F.col("up") == F.col("via")).select("node", F.col("next").alias("up")), "jumps")
        length *= 2
    return known


def hash_sample(df: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose key hashes below a bound, about ``fraction`` of them: the same rows on every run and under retries, however the table is partitioned.  Null keys hash as empty text."""
    if fraction >= 1:
        return df
    bound = f"{math.ceil(max(fraction, 0.0) * 16**8):08x}"
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return df.where(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8) < bound)
