"""A wide analytical table from several sources, behind gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import check, dup_report
from ..sources.io import read_table, write_table


def build_dataset(spark: SparkSession, fact: DataFrame, sides: list[tuple[DataFrame, str]], path: str, clean: Callable[[DataFrame], DataFrame], aggregate: Callable[[DataFrame], DataFrame], rules: dict) -> DataFrame:
    """Clean the fact, join each side on its key (inner), aggregate, check, write and read back.

    A side whose keys repeat would multiply the fact, so it raises before anything is joined; the
    aggregate is published only if its rules hold.
    """
    wide = clean(fact)
    for side, key in sides:
        wide = wide.join(side, key)
    for side, key in sides:
        repeated = dup_report(side.dropna(subset=[key]), [key]).count()
        if repeated:
            raise ValueError(f"{repeated} keys of {key} repeat")
    staged = f"{path}_staged"
    write_table(aggregate(wide), staged, mode="overwrite")
    bad = check(read_table(spark, staged), **rules).where("violations > 0").collect()  # one row a rule
    if bad:
        raise ValueError(f"the table breaks {[(r.rule, r.violations) for r in bad]}")
    write_table(read_table(spark, staged), path, mode="overwrite")
    return read_table(spark, path)
