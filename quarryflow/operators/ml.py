"""Training and comparing classifiers with Spark's own library."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch

#: Partitions that training rows are dealt into, more of them above so many rows in each; they follow from the number of rows alone, so that a forest does not depend on how a table is laid out.
PARTS, PART_ROWS = 32, 500_000


def split_by_key(df: DataFrame, keys: list[str], share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): a row's side follows from a hash of its keys, whatever the partitions are."""
    held_out = _held_out(keys, share, seed)
    return df.where(~held_out), df.where(held_out)


def _held_out(keys: list[str], share: float, seed: int) -> Column:
    """Whether a row is for testing: those that ``hash_sample`` takes."""
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8) < f"{math.ceil(share * 16**8):08x}"


def confusion(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Rows by label and prediction."""
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def train_variants(df: DataFrame, features: list[str], label: str, variants: list[dict], keys: list[str] | None = None, seed: int = 42):
    """Fit a forest for each variant; returns (best model, table of runs).  The best has the largest F1 on held-out rows.

    Rows are split by their keys (without any, by features and label, so rows alike are on one
    side) and laid out by them, so the marks are the same for any partitioning.  Both sides are
    laid out once, on the executors' disks, for all passes of all variants.  ``referee`` is the
    accuracy that a count of the written predictions gives, which must be the evaluator's.
    """
    keys = keys or [*features, label]
    data = df.select(*dict.fromkeys([*keys, *features, label])).dropna(subset=features).withColumn("_test", _held_out(keys, 0.2, seed))
    sizes = tuple(data.agg(F.count_if(~F.col("_test")), F.count_if("_test"), F.count_if(F.col("_test") & (F.col(label) == 1))).first())
    train = data.where("not _test").repartition(max(PARTS, math.ceil(sizes[0] / PART_ROWS)), *keys).sortWithinPartitions(*keys)
    ready = VectorAssembler(inputCols=features, outputCol="features")
    train, test = (ready.transform(x).select("features", label).persist(StorageLevel.DISK_ONLY) for x in (train, data.where("_test")))
    try:
        best, runs = _fit_all(train, test, label, variants, sizes, seed)
    finally:
        train.unpersist()
        test.unpersist()
    return best, df.sparkSession.createDataFrame(runs, "run int, params string, rows_train long, rows_test long, positives_test long, accuracy double, f1 double, referee double")


def _fit_all(train: DataFrame, test: DataFrame, label: str, variants: list[dict], sizes: tuple, seed: int):
    """(best model, rows of runs)."""
    spark, runs, best = train.sparkSession, [], (None, -1.0)
    for k, params in enumerate(variants):
        model = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed, **params).fit(train)
        path = scratch(spark, "predictions")
        model.transform(test).select(label, "prediction").write.parquet(path)
        scored = spark.read.parquet(path)
        marks = {m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(scored) for m in ("accuracy", "f1")}
        counts = confusion(scored, label).collect()  # a row for each pair of labels
        right = sum(r["n"] for r in counts if r["label"] == r["prediction"]) / max(1, sum(r["n"] for r in counts))
        runs.append((k, str(params), *sizes, float(marks["accuracy"]), float(marks["f1"]), right))
        if marks["f1"] > best[1]:
            best = (model, marks["f1"])
    return best[0], runs


def score_rows(model, df: DataFrame, features: list[str], out: str = "prediction") -> DataFrame:
    """New rows with the label that a fitted model gives them; null where a feature is null."""
    made = {"_features", "_raw", "_probability"}
    ready = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df)
    scored = model.copy().setFeaturesCol("_features").setPredictionCol("_p").setRawPredictionCol("_raw").setProbabilityCol("_probability").transform(ready)
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    return scored.withColumn(out, F.when(whole, F.col("_p"))).drop(*made, "_p")
