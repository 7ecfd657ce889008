"""Two-pass scans: the same rows as plain windows, for keys of any size, and no task with most of a large key."""

import random

import pytest
from pyspark.sql import functions as F

from quarryflow.operators import scan as S
from quarryflow.operators import windows as W

NEVER = 10**9


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([1, 1, 2, 3, None]) if i % 3 else i // 7, i, r.choice([None, 1.5, 2.0, -4.0, 8.25]), r.random() < 0.1) for i in range(400)]
    data += [("one", 1, 1000, None, False), ("two", 1, 1001, 2.0, True), ("two", 1, 1002, None, False)]
    return spark.createDataFrame(data, "k string, t int, id int, v double, reset boolean").repartition(7)


CASES = {
    "sum": lambda d, n: W.running(d, ["k"], ["t", "id"], "v", large=n),
    "count": lambda d, n: W.running(d, ["k"], ["-t", "id"], "v", "count", large=n),
    "min": lambda d, n: W.running(d, ["k"], ["t", "id"], "v", "min", large=n),
    "max": lambda d, n: W.running(d, ["k"], ["t", "id"], "v", "max", large=n),
    "avg": lambda d, n: W.running(d, ["k"], ["t", "id"], "v", "avg", large=n),
    "lag": lambda d, n: W.lag_delta(d, ["k"], ["t", "id"], "v", large=n),
    "pct": lambda d, n: W.pct_change(d, ["k"], ["t", "id"], "v", large=n),
    "reset": lambda d, n: W.running_with_reset(d, ["k"], ["t", "id"], "v", F.col("reset"), large=n),
    "ffill": lambda d, n: W.fill_forward(d, ["k"], ["t", "id"], "v", large=n),
    "bfill": lambda d, n: W.fill_forward(d, ["k"], ["t", "id"], "v", backward=True, large=n),
    "ranks": lambda d, n: W.rank_all(d, ["k"], ["t"], ["id"], large=n),
    "down": lambda d, n: W.rank_all(d, ["k"], ["-t"], ["id"], large=n),
    "share": lambda d, n: W.rank_share(d, ["k"], ["t"], large=n),
    "average": lambda d, n: W.rank_pct(d, ["k"], ["t"], large=n),
    "tiles": lambda d, n: W.ntile_band(d, ["k"], ["t", "id"], list("pqrs"), large=n),
    "transitions": lambda d, n: W.transitions(d, ["k"], ["t", "id"], "v", large=n),
    "two keys": lambda d, n: W.running(d, ["k", "reset"], ["t", "id"], "v", large=n),
}


def plain(df):
    return sorted(tuple("-" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("name", CASES)
def test_scan_equals_window(rows, name):
    expected = plain(CASES[name](rows, NEVER))
    assert plain(CASES[name](rows, 0)) == expected  # every key over parts
    if name in ("sum", "lag", "ranks"):
        assert plain(CASES[name](rows, 50)) == expected  # large keys only


def test_resets_over_many_parts(spark):
    """A key that ends, resets and goes on in other parts, with parts that hold no reset at all."""
    df = spark.range(300).select(F.lit(1).alias("k"), F.col("id"), F.col("id").cast("double").alias("v"), F.col("id").isin(0, 7, 250).alias("reset"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.running for r in W.running_with_reset(df, ["k"], ["id"], "v", F.col("reset"), large=0).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, expected = 0.0, {}
    for i in range(300):
        total = (0.0 if i in (0, 7, 250) else total) + i
        expected[i] = total
    assert got == expected


def test_a_large_key_is_spread_over_the_tasks(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id", F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = S.large_keys(df, ["k"])
        assert [r["_k0"] for r in hot.collect()] == [0]
        layout = S.Layout(df.where("k = 0"), ["k"], ["id"])
        sizes = [r["count"] for r in layout.df.groupBy("_part").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
        got = W.running(df, ["k"], ["id"], "v")
        assert got.where("k = 0").agg(F.max("running")).first()[0] == 10000.0 and got.count() == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, t int, id int, v double, reset boolean")
    for name in ("sum", "lag", "reset", "ranks", "tiles"):
        assert CASES[name](df, NEVER).count() == 0 and CASES[name](df, 0).count() == 0


def test_several_running_values_place_the_rows_once(spark, rows, monkeypatch):
    from quarryflow import queries

    placed, own = [], S.Layout.__init__
    monkeypatch.setattr(S.Layout, "__init__", lambda self, *a: (placed.append(1), own(self, *a))[1])
    queries.queries()["win_running_hot_key"](spark, "/root/testdata/sf0.01")
    assert len(placed) == 1
    wanted = {fn: ("v", fn) for fn in ("sum", "count", "min", "max", "avg")}
    got = [W.running_all(rows, ["k"], ["t", "id"], wanted, large=n).select("id", *wanted) for n in (5, NEVER)]
    one, other = ({r[0]: r[1:] for r in x.collect()} for x in got)
    assert len(placed) == 2 and len(one) == rows.count() and one.keys() == other.keys()
    for i in one:
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(one[i], other[i], strict=True))
