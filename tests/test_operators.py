"""Small worked cases: nulls, ties, repeats, empty tables, plans."""

import datetime
import inspect
import os
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarryflow.functions import columns as X
from quarryflow.operators import aggregates, incremental, joins, quality, reshape, scoring, snapshots, warehouse, windows
from quarryflow.plans import medallion
from quarryflow.plans.dataset import build_dataset
from quarryflow.queries import basics
from quarryflow.sources import io
from quarryflow.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_rejects_repeated_source_keys(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        incremental.upsert(t, t.union(t), ["k"])


def test_upsert_keeps_columns_that_are_not_listed(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    s = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, v string, w int")
    assert sorted(map(str, rows(incremental.upsert(t, s, ["k"], update=["v"])))) == ["(1, 'a', 1)", "(2, None, 2)", "(3, 'c', 3)"]


def test_delete_keeps_rows_where_the_condition_is_null(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "x int")
    assert {r[0] for r in incremental.delete(df, F.col("x") > 3).collect()} == {1, None}


def test_islands_count_repeated_months_once(spark):
    days = ["2024-01-03", "2024-01-20", "2024-02-01", "2024-03-09", "2024-06-01", "2024-07-02"]
    df = spark.createDataFrame([("a", datetime.date.fromisoformat(d)) for d in days], "k string, d date")
    assert sorted(r["length"] for r in windows.islands(df, ["k"], "d").collect()) == [2, 3]


def test_moving_avg_waits_for_enough_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0)], "i int, x double")
    assert [r.moving_avg for r in windows.moving_avg(df, [], ["i"], "x", 2, 2).orderBy("i").collect()] == [None, 2.0, 4.0]


def test_hierarchy_has_no_limit_unless_one_is_given(spark):
    assert inspect.signature(reshape.walk_hierarchy).parameters["max_depth"].default is None
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id int, parent int")
    walk = lambda *limit: [r[2] for r in rows(reshape.walk_hierarchy(spark, t, "id", "parent", t.where("parent is null"), "down", *limit))]
    assert walk() == [0, 1, 2, 3] and walk(2) == [0, 1, 2]


def test_cut_is_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (None,)], "x double").select(X.cut("x", [0, 1, 2], ["low", "high"]).alias("b"))
    assert [r.b for r in df.collect()] == [None, "low", "high", None]


def test_hash_key_separates_parts_and_null(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(X.hash_key(["x", "y"])).distinct().count() == 4


def test_walk_hierarchy_ends_on_a_cycle(spark):
    t = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent long")
    assert rows(reshape.walk_hierarchy(spark, t, "id", "parent", t.where("id = 1"), "up").select("node", "depth")) == [(1, 0), (2, 2), (3, 1)]


def test_scd2_applied_twice_changes_nothing(spark):
    src = spark.createDataFrame([(1, "x"), (2, None)], "k int, a string")
    day = lambda d: F.lit(d).cast("date")
    dim = warehouse.scd2_init(src, ["k"], ["a"], day("2024-01-01"))
    new = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "k int, a string")
    once = warehouse.scd2_apply(dim, new, ["k"], ["a"], day("2024-02-01"))
    assert sorted(map(str, rows(warehouse.scd2_apply(once, new, ["k"], ["a"], day("2024-03-01"))))) == sorted(map(str, rows(once)))
    assert once.count() == 4


def test_validate_split_treats_null_as_broken(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    good, bad = quality.validate_split(df, {"positive": F.col("x") > 0})
    assert good.count() == 1 and bad.first()["errors"] == ["positive"]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, x double, d date")
    assert aggregates.value_counts(e, "k").count() == 0
    assert windows.islands(e, ["k"], "d").count() == 0
    assert warehouse.surrogate_key(e, ["k"]).count() == 0
    assert quality.check(e, ["k"]).where("rule = 'not_empty'").first()["violations"] == 1
    assert joins.fanout_report(e, e, ["k"]).count() == 1


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([("A", i) for i in range(80)] + [("B", i) for i in range(5)], "k string, i int")
    small = spark.createDataFrame([("A", "x"), ("C", "y")], "k string, v string")
    assert rows(joins.salted_join(big, small, "k", 4)) == rows(big.join(small, "k"))


def test_partition_filter_reaches_the_scan(spark, capsys):
    path = io.scratch(spark, "prune")
    io.write_table(spark.range(10).withColumn("p", F.col("id") % 2), path, partition_by=["p"])
    io.read_table(spark, path).where("p = 1").select("id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(p" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_top_n_limits_groups_before_the_shuffle(spark, capsys):
    windows.top_n(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], ["id"], 2).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_jdbc_options():
    o = io.jdbc_options("jdbc:x", "t", "id", 1, 100, 4)
    assert o["numPartitions"] == "4" and o["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        io.jdbc_options("jdbc:x", "t", "id")


def test_a_database_in_memory_is_for_one_process_only():
    session = lambda master, url=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: url or default), sparkContext=SimpleNamespace(master=master))
    for master in ("local", "local[*]", "local[4, 2]"):
        assert basics._database(session(master)).startswith("jdbc:derby:memory:")
    for master in ("local-cluster[3,4,10240]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError, match="quarryflow.jdbc.url"):
            basics._database(session(master))
        assert basics._database(session(master, "jdbc:x")) == "jdbc:x"


def test_incremental_runs_are_idempotent(spark):
    root = io.scratch(spark, "inc")
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 2))], "id int, ts timestamp")
    assert incremental.incremental(df, root, "t", "ts") == 2
    assert incremental.incremental(df, root, "t", "ts") == 0
    assert incremental.read_incremental(spark, root, "t", df.schema).count() == 2


def test_reading_before_the_first_version_is_an_error(spark):
    root = io.scratch(spark, "versions")
    incremental.save_version(spark.range(5), root, saved_at="2024-01-01 00:00:00")
    incremental.save_version(spark.range(7), root, saved_at="2024-02-01 00:00:00")
    assert incremental.read_version(spark, root, at="2024-01-15 00:00:00").count() == 5
    with pytest.raises(ValueError):
        incremental.read_version(spark, root, at="2020-01-01 00:00:00")


def test_null_keys_are_keys(spark):
    t = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    s = spark.createDataFrame([(None, "x"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(str(tuple(r)) for r in incremental.insert_missing(t, s, ["k"]).collect()) == ["(1, 'b')", "(2, 'c')", "(None, 'a')"]
    assert [r.op for r in incremental.cdc_diff(t, t, ["k"]).collect()] == []
    assert [r.op for r in incremental.cdc_diff(t.where("k is null"), s.where("k is null"), ["k"]).collect()] == ["UPDATE"]


def test_time_intel_counts_missing_months(spark):
    months = [datetime.date(2020 + i // 12, i % 12 + 1, 1) for i in range(15) if i != 5]
    df = spark.createDataFrame([(m, float(100 * (m.year - 2020) + m.month)) for m in months], "m date, v double")
    got = {r.m: r for r in scoring.time_intel(df, "m", "v").collect()}
    assert len(got) == 14 and got[datetime.date(2021, 1, 1)].yoy == 100.0
    assert got[datetime.date(2020, 7, 1)].qoq == 3.0 and got[datetime.date(2020, 9, 1)].qoq is None


def test_silver_events_ask_open_first_and_drop_null_money(spark):
    df = spark.createDataFrame([(1, "5", None, None), (2, "5", "2024-01-01", None), (3, "5", "2024-01-01", "a"), (4, None, "2024-01-01", "a"), (5, "-1", None, "a")], "id int, amount string, closed string, owner string")
    assert {r.id: r.quality_flag for r in medallion.silver_events(df, ["amount"], ["closed"], "closed", "owner").collect()} == {1: "OPEN", 2: "MISSING", 3: "CLEAN"}


def test_scd2_rejects_repeated_source_keys(spark):
    src = spark.createDataFrame([(1, "x")], "k int, a string")
    dim = warehouse.scd2_init(src, ["k"], ["a"], F.lit("2024-01-01").cast("date"))
    with pytest.raises(ValueError):
        warehouse.scd2_apply(dim, src.union(src), ["k"], ["a"], F.lit("2024-02-01").cast("date"))


def test_validate_split_keeps_a_column_named_errors(spark):
    good, bad = quality.validate_split(spark.createDataFrame([(1, "own"), (-1, "own")], "x int, errors string"), {"positive": F.col("x") > 0})
    assert good.first().errors == "own" and bad.first().errors == ["positive"] and bad.first().reason == "positive"


def test_hash_key_escapes_its_separator(spark):
    df = spark.createDataFrame([("a||b", "c"), ("a", "b||c"), ("a\\", "|b"), ("a", "|b")], "x string, y string")
    assert df.select(X.hash_key(["x", "y"]), X.row_checksum(["x", "y"])).distinct().count() == 4


def test_handle_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 3.0), (None, "a", 9.0), (4, None, None), (5, None, 8.0)], "id int, g string, v double")
    got = {r.id: (r.v, r.v_was_null) for r in quality.handle_nulls(df, drop=["id"], flag=["v"], fill={"v": ("mean", "g")}).collect()}
    assert got == {1: (1.0, False), 2: (2.0, True), 3: (3.0, False), 4: (8.0, True), 5: (8.0, False)}
    assert {r.v for r in quality.handle_nulls(df, fill={"v": ("median", None), "g": "none"}).where("id in (2, 4)").collect()} == {5.5}


def test_surrogate_keys_are_dense_after_one_shuffle(spark, capsys):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = warehouse.surrogate_key(df, ["k"])
    assert rows(out) == [(k, k + 1) for k in range(1000)]
    out.explain()
    assert "hashpartitioning(k" not in capsys.readouterr().out


def test_active_counts_equal_a_comparison_of_all_pairs(spark):
    day = datetime.date
    facts = [(1, "x", "p", day(1990, 1, 1), None), (2, "y", "p", day(2024, 1, 20), day(2024, 2, 10)), (3, "x", "p", day(1990, 1, 1), day(1991, 1, 1)), (4, "y", "p", day(2024, 2, 20), day(2024, 3, 2)), (5, None, "q", day(2024, 3, 1), None), (6, "z", None, day(2024, 5, 1), None), (7, "z", "q", None, None), (8, "z", "q", day(2024, 1, 31), day(2024, 2, 1))]
    periods = [(day(2024, 1, 1), day(2024, 1, 31)), (day(2024, 2, 1), day(2024, 2, 29)), (day(2024, 3, 1), day(2024, 3, 31))]
    f = spark.createDataFrame(facts, "id int, account string, plan string, a date, b date")
    p = spark.createDataFrame(periods, "p date, q date")
    expected = {}
    for _, account, plan, a, b in facts:
        for low, high in periods:
            if a is not None and a <= high and (b is None or b > low):
                expected.setdefault((plan, low), []).append(account)
    got = {(r.plan, r.p): r.active for r in joins.active_counts(f, p, "a", "b", "p", "q", ["plan"]).collect()}
    assert got == {k: len(v) for k, v in expected.items()}
    got = {(r.plan, r.p): r.active for r in joins.active_counts(f, p, "a", "b", "p", "q", ["plan"], "account").collect()}
    assert got == {k: len(set(v) - {None}) for k, v in expected.items() if set(v) - {None}}
    assert joins.active_counts(f.limit(0), p, "a", "b", "p", "q").count() == 0 and joins.active_counts(f, p.limit(0), "a", "b", "p", "q").count() == 0
    with pytest.raises(ValueError):
        joins.active_counts(f, p.unionByName(spark.createDataFrame([(day(2024, 1, 2), day(2024, 1, 3))], "p date, q date")), "a", "b", "p", "q")


def test_salted_join_repeats_hot_keys_alone(spark):
    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 300).cast("string"))).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3), ("k7", 4), (None, 5)], "k string, v int")
    hot = {r.k: r.n for r in joins.heavy_hitters(big, "k", 0.1).collect()}
    assert set(hot) == {"hot"} and hot["hot"] >= 2000
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = big.join(small, "k", how), joins.salted_join(big, small, "k", 8, how, share=0.1)
        assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_a_change_writes_the_buckets_it_touches(spark):
    root = io.scratch(spark, "buckets")
    table = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("a" * 20).alias("v"))
    assert snapshots.create(table, root, ["k"], 50, saved_at="2024-01-01 00:00:00") == 0
    batch = spark.createDataFrame([(7, "new"), (99999, "more"), (None, "null")], "k int, v string")  # another type than the table's
    assert snapshots.merge(spark, root, batch, saved_at="2024-02-01 00:00:00") == 1
    assert snapshots.delete_keys(spark, root, spark.createDataFrame([(8,), (123456,)], "k long"), saved_at="2024-03-01 00:00:00") == 2
    now = {r.k: r.v for r in snapshots.read(spark, root).collect()}
    assert len(now) == 5000 and now[7] == "new" and now[99999] == "more" and now[None] == "null" and 8 not in now
    assert {r.v for r in snapshots.read(spark, root, 0).collect()} == {"a" * 20} and snapshots.read(spark, root, at="2024-02-15 00:00:00").where("k = 8").count() == 1
    log = [(r.version, r.operation, r.rows, r.buckets_written) for r in snapshots.history(spark, root).orderBy("version").collect()]
    assert [x[:3] for x in log] == [(0, "CREATE", 5000), (1, "MERGE", 5001), (2, "DELETE", 5000)] and log[1][3] <= 3 and log[2][3] <= 2
    size = lambda v: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(f"{root}/data/version={v}") for f in names)
    assert size(1) < size(0) / 5
    with pytest.raises(ValueError):
        snapshots.change(spark, root, batch.where("k = 7"), lambda current, rows: current.unionByName(table))
    empty = io.scratch(spark, "empty")
    snapshots.create(table.limit(0), empty, ["k"], 4)
    assert snapshots.read(spark, empty).count() == 0
    snapshots.merge(spark, empty, batch)
    assert snapshots.read(spark, empty).count() == 3


def test_slowly_changing_dimension_in_buckets(spark):
    root = io.scratch(spark, "dim")
    date = lambda x: F.lit(x).cast("date")
    first = spark.createDataFrame([(i, "a") for i in range(200)] + [(None, "n")], "k int, v string")
    snapshots.create(warehouse.scd2_init(first, ["k"], ["v"], date("2024-01-01")), root, ["k"], 20)
    batch = spark.createDataFrame([(5, "b"), (300, "c"), (None, "n")], "k int, v string")
    snapshots.change(spark, root, batch, lambda dim, rows: warehouse.scd2_apply(dim, rows, ["k"], ["v"], date("2024-02-01")))
    dim = snapshots.read(spark, root)
    assert dim.count() == 203 and dim.where("is_current").count() == 202
    assert sorted((r.v, r.is_current) for r in dim.where("k = 5").collect()) == [("a", False), ("b", True)] and dim.where("k is null").count() == 1


def test_null_keys_are_keys(spark):
    t = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    same = lambda df: sorted(map(str, df.collect()))
    assert same(warehouse.scd1(t, t, ["k"], ["v"])) == same(t)
    dim = warehouse.scd2_init(t, ["k"], ["v"], F.lit("2024-01-01").cast("date"))
    assert same(warehouse.scd2_apply(dim, t, ["k"], ["v"], F.lit("2024-02-01").cast("date"))) == same(dim)
    log = spark.createDataFrame([(None, 9, "UPDATE", 1), (2, 0, "DELETE", 2)], "k int, v int, op string, seq int")
    assert [tuple(r) for r in incremental.cdc_apply(t, log, ["k"], "seq").collect()] == [(None, 9)]
    assert {r.k: (r.v, r.prev_v) for r in warehouse.scd3(t, spark.createDataFrame([(None, 5), (2, None)], "k int, v int"), "k", "v").collect()} == {None: (5, 1), 2: (2, None)}


def test_periodic_snapshot_counts_earlier_events_and_null_keys(spark):
    day = datetime.date
    events = spark.createDataFrame([("a", day(2023, 11, 5), 10.0), ("a", day(2024, 2, 3), 1.0), (None, day(2024, 1, 9), 4.0), ("b", day(2024, 9, 1), 7.0), ("b", None, 3.0)], "k string, at date, v double")
    ends = spark.createDataFrame([(day(2024, 1, 31),), (day(2024, 2, 29),)], "e date")
    got = {(r.k, r.e.month): (r.total, r.events) for r in warehouse.periodic_snapshot(events, ends, "k", "at", "v", "e").collect()}
    assert got == {("a", 1): (10.0, 1), ("a", 2): (11.0, 2), (None, 1): (4.0, 1), (None, 2): (4.0, 1), ("b", 1): (0.0, 0), ("b", 2): (0.0, 0)}


def test_loads_take_ties_late_rows_and_rows_without_time_once(spark):
    root = io.scratch(spark, "ties")
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    days = [[(1, at(5)), (2, None)], [(3, at(5)), (4, None)], [(5, at(4)), (6, at(1)), (7, at(9))], []]
    seen, loaded = [], []
    for day in days:
        seen += day
        source = spark.createDataFrame(seen, "id int, ts timestamp")
        loaded.append(incremental.incremental(source, root, "t", "ts", ["id"], "2 hours"))
    assert loaded == [2, 2, 2, 0]
    got = sorted(r.id for r in incremental.read_incremental(spark, root, "t", source.schema).collect())
    assert got == [1, 2, 3, 4, 5, 7]  # 6 is later than the overlap


def test_pointer_doubling(spark, monkeypatch):
    written = []
    monkeypatch.setattr(reshape, "_written", lambda df, name, real=reshape._written: written.append(name) or real(df, name))
    chain = spark.range(3000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = reshape.tree_roots(chain, "id", "parent")
    assert got.where("root = 0 and depth = node").count() == 3000 and len(written) <= 15
    edges = [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (10, 11), (11, 12), (12, 10), (13, 12), (14, 14), (None, 1)]
    t = spark.createDataFrame(edges, "id int, parent int")
    assert {r.node: (r.root, r.depth) for r in reshape.tree_roots(t, "id", "parent").collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (99, 1), 99: (99, 0)} | {x: (None, None) for x in (10, 11, 12, 13, 14)}
    parents = {a: b for a, b in edges if a is not None}
    expected = set()
    for a in parents:
        node, depth, seen = a, 0, set()
        while node is not None and node not in seen:
            expected.add((a, node, depth))
            seen.add(node)
            node, depth = parents.get(node), depth + 1
    assert {tuple(r) for r in reshape.ancestors(t, "id", "parent").collect()} == expected
    assert {r.node for r in reshape.ancestors(t, "id", "parent", t.where("id = 4")).collect()} == {1, 2, 3, 4}


def test_resample_from_first_to_last(spark):
    e = spark.createDataFrame([("2024-01-30 10:00:00",), ("2024-02-02 09:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    got = {str(r.period): r.n for r in scoring.resample(e, "ts", "day", [F.count("*").alias("n")], dense=True).collect()}
    assert got == {"2024-01-30": 1, "2024-01-31": None, "2024-02-01": None, "2024-02-02": 1}
    with pytest.raises(ValueError):
        scoring.resample(e, "ts", "day", [F.count("*").alias("n")], spark.createDataFrame([("2024-01-30",)], "d string").select(F.col("d").cast("date").alias("period")))


def test_streamed_upsert_ignores_older_rows_and_keeps_times(spark):
    root = io.scratch(spark, "upsert")
    for day in ((1, 5, "new"), (1, 3, "old")):
        spark.createDataFrame([day], "k int, at int, v string").write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema("k int, at int, v string").parquet(f"{root}/in")
        streams.stream_upsert(source, f"{root}/table", ["k"], "at", f"{root}/checkpoint").awaitTermination()
    assert rows(snapshots.read(spark, f"{root}/table")) == [(1, 5, "new")]
    times = [r.saved_at for r in snapshots.history(spark, f"{root}/table").orderBy("version").collect()]
    assert len(times) == 2 and times[0] < times[1]


def test_quantiles_equal_percentile(spark):
    data = [(k, v) for k, values in {"a": [1.0, 2.0, 2.0, 2.0, 9.5, None], "b": [4.0] * 500 + [float(i) for i in range(300)], None: [7.0, 8.0], "empty": [None]}.items() for v in values]
    df, probs = spark.createDataFrame(data, "k string, v double").repartition(3), [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    plain = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", probs).alias("q")).where("q is not null").collect()}
    assert {r.k: r.quantiles for r in aggregates.quantiles(df, "v", probs, ["k"]).collect()} == plain
    assert aggregates.quantiles(df, "v", probs).first().quantiles == df.agg(F.percentile("v", probs)).first()[0]
    assert {r.k: r.m for r in aggregates.medians(df, ["k"], "v", "m").collect()} == {"a": 2.0, "b": 4.0, None: 7.5, "empty": None}
    assert aggregates.quantiles(df.limit(0), "v", [0.5]).first().quantiles == [None]
    assert aggregates.quantiles(df.limit(0), "v", [0.5], ["k"]).count() == 0


def test_asof_join_equals_plain_comparison(spark):
    at = lambda y, m=1, d=1: datetime.datetime(y, m, d)
    facts = [(1, "a", at(2020, 5)), (2, "a", at(2021, 1)), (3, "a", at(2019)), (4, "b", at(2023)), (5, None, at(2020)), (6, "a", None), (7, "c", at(2020)), (8, "a", at(2024, 12, 31))]
    versions = [("a", at(2020), at(2021), 10), ("a", at(2021), None, 11), ("b", at(2010), at(2022), 12), ("b", at(2022), at(2030), 13), ("c", None, None, 14), ("a", at(2019, 6), at(2019, 6), 15)]
    f, v = spark.createDataFrame(facts, "id int, k string, ts timestamp"), spark.createDataFrame(versions, "k string, f timestamp, t timestamp, sk int")
    for how in ("left", "inner"):
        got = sorted((r.id, r.sk) for r in joins.asof_join(f, v, "k", "ts", "f", "t", how).collect())
        wanted = [(i, next((s for vk, a, b, s in versions if k == vk and ts and a and a <= ts and (b is None or ts < b)), None)) for i, k, ts in facts]
        assert sorted(got, key=str) == sorted([w for w in wanted if how == "left" or w[1] is not None], key=str)
    assert joins.asof_join(f.limit(0), v, "k", "ts", "f", "t").count() == 0 and joins.asof_join(f, v.limit(0), "k", "ts", "f", "t").count() == 8


def test_parity_counts_rows_that_differ(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, None, None), (3, 1, None), (4, 2, 3)], "k int, a int, b int")
    assert tuple(quality.parity(df, "k", F.col("a"), F.col("b")).first()) == (2, 4, 3)
    assert tuple(quality.parity(df.limit(0), "k", F.col("a"), F.col("b")).first()) == (0, 0, None)


def test_check_compares_row_counts(spark):
    assert {r.rule: r.violations for r in quality.check(spark.range(5), same_rows_as=spark.range(7)).collect()}["row_count"] == 2


def test_build_dataset_gates(spark):
    fact = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None)], "k int, v double")
    side = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (None, "z")], "k int, name string")
    total = lambda x: x.groupBy("name").agg(F.sum("v").alias("v"))
    whole = lambda x: x.dropna(subset=["v"])
    rules = {"not_null": ["v"]}
    assert rows(build_dataset(spark, fact, [(side, "k")], io.scratch(spark, "wide"), whole, total, rules)) == [("x", 5.0)]
    with pytest.raises(ValueError):
        build_dataset(spark, fact, [(side.unionByName(side), "k")], io.scratch(spark, "wide"), whole, total, rules)
    with pytest.raises(ValueError):
        build_dataset(spark, fact, [(side, "k")], io.scratch(spark, "wide"), lambda x: x, total, rules)


def test_explode_array_and_bucket(spark):
    df = spark.createDataFrame([(1, [5, None]), (2, []), (3, None)], "k int, a array<int>")
    assert sorted(map(str, rows_of(X.explode_array(df, "a", "x"), "k", "x"))) == ["(1, 5)", "(1, None)"]
    assert X.explode_array(df, "a", "x", keep_empty=True).count() == 4 and X.explode_array(df, ["p", "q"], "x").count() == 6
    day = spark.createDataFrame([(datetime.date(2024, 5, 17),), (None,)], "d date")
    assert rows_of(X.bucket(day, "d", "year", "yyyy"), "bucket", "bucket_label") == [(datetime.date(2024, 1, 1), "2024"), (None, None)]


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_hash_sample_is_repeatable(spark):
    df = spark.range(5000)
    a = {r.id for r in reshape.hash_sample(df, ["id"], 0.1, 3).collect()}
    assert a == {r.id for r in reshape.hash_sample(df.repartition(7), ["id"], 0.1, 3).collect()} and 400 < len(a) < 600
    assert reshape.hash_sample(df, ["id"], 0.0).count() == 0 and reshape.hash_sample(df, ["id"], 1.0).count() == 5000


def test_scorecard_of_a_table(spark):
    claims = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 1.0), (None, 9.0)], "k int, v double")
    side = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    got = scoring.scorecard(claims, [(side, "k")], ["name"], [F.count("*").alias("n"), F.sum("v").alias("v")], [(F.col("n") > 1, "HIGH")], "LOW")
    assert rows(got) == [("x", 2, 11.0, "HIGH"), ("y", 1, 1.0, "LOW")]


def test_forest_scores_new_rows(spark):
    from quarryflow.operators.ml import score_rows, train_variants

    df = spark.createDataFrame([(float(i), float(i % 7), float(i > 50)) for i in range(100)], "a double, features double, label double")
    best, runs = train_variants(df.select(F.col("a"), F.col("features").alias("b"), "label"), ["a", "b"], "label", [{"numTrees": 3, "maxDepth": 3}])
    new = spark.createDataFrame([(1.0, 2.0, "own"), (99.0, 2.0, "own"), (None, 1.0, "own")], "a double, b double, features string")
    assert [(r.prediction, r.features) for r in score_rows(best, new, ["a", "b"]).orderBy(F.asc_nulls_last("a")).collect()] == [(0.0, "own"), (1.0, "own"), (None, "own")]
    assert runs.count() == 1


def test_a_batch_goes_to_the_database_once(spark):
    url, table = "jdbc:derby:memory:once;create=true", "t" + uuid.uuid4().hex[:8]
    write = io.foreach_batch_jdbc(url, table)
    one = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    for number, batch in ((0, one), (0, one), (1, one.limit(0)), (2, one.where("k = 1")), (0, one)):
        write(batch, number)
    assert sorted(str(tuple(r)) for r in io.read_jdbc(spark, url, table).collect()) == ["(1, 'a')", "(1, 'a')", "(None, 'b')"]
    assert [r[0] for r in rows(io.read_jdbc(spark, url, f"{table}_batches"))] == [0, 1, 2]
    # an attempt that fails before its transaction ends leaves nothing but a staging table
    io.write_jdbc(one, url, f"{table}_stage", "overwrite")
    with pytest.raises(Exception):
        io._sql(spark, url, [f"INSERT INTO {table} SELECT * FROM {table}_stage", "INSERT INTO no_such_table VALUES (1)"])
    assert io.read_jdbc(spark, url, table).count() == 3
    write(one.where("k = 1"), 3)
    assert io.read_jdbc(spark, url, table).count() == 4


def test_kept_distinct_counts_roll_up(spark):
    df = spark.range(30000).select((F.col("id") % 12).alias("month"), F.when(F.col("id") % 50 > 0, (F.col("id") * 7919) % 9001 * 1000 - 4_000_000).alias("k"))
    exact = {r.half: r.n for r in df.groupBy((F.col("month") % 2).alias("half")).agg(F.countDistinct("k").alias("n")).collect()}
    parts = [aggregates.distinct_state(df.where(c), ["month"], "k") for c in ("k % 3 = 0", "k % 3 != 0")]
    state = aggregates.merge_distinct(*parts, ["month"]).withColumn("half", F.col("month") % 2)
    assert {r.half: r.n for r in aggregates.distinct_counts(state, ["half"]).collect()} == exact
    assert {r.month: r.n for r in aggregates.distinct_counts(state, ["month"]).collect()} == {r.month: r.n for r in df.groupBy("month").agg(F.countDistinct("k").alias("n")).collect()}
    sketches = aggregates.distinct_sketch(df, ["month"], "k").withColumn("half", F.col("month") % 2)
    for r in aggregates.sketch_counts(sketches, ["half"]).collect():
        assert abs(r.n / exact[r.half] - 1) < 4 * 0.016
    assert aggregates.distinct_counts(aggregates.distinct_state(df.limit(0), ["month"], "k"), ["month"]).count() == 0


def test_training_does_not_depend_on_partitions(spark):
    from quarryflow.operators import ml

    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("double").alias("label"))
    runs = [[tuple(r) for r in ml.train_variants(df.repartition(n), ["a", "b"], "label", [{"numTrees": 3, "maxDepth": 3}], ["id"])[1].collect()] for n in (1, 5)]
    assert runs[0] == runs[1] and runs[0][0][5] == runs[0][0][7] > 0.9
    train, test = ml.split_by_key(df, ["id"])
    assert train.count() + test.count() == 600 and train.join(test, "id").count() == 0


def test_rerun_replaces_the_partitions_it_builds(spark):
    path = io.scratch(spark, "rerun")
    job = lambda x: x.groupBy("day").agg(F.count("*").alias("n"))
    source = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "day string")
    io.write_table(job(source), path, partition_by=["day"])
    incremental.rerun(source.where("day != '3'").unionByName(source.where("day = '2'")), path, "day", ["2", "3"], job)
    assert sorted((r.day, r.n) for r in io.read_table(spark, path, schema="n long, day string").collect()) == [("1", 1), ("2", 4)]
    with pytest.raises(ValueError):
        incremental.rerun(source, path, "day", ["2"], lambda x: job(source))


def test_a_folder_of_many_rows_is_written_by_several_tasks(spark):
    path, advised = io.scratch(spark, "one_day"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advised)
    spark.conf.set(advised, "64k")
    try:
        medallion.land(medallion.bronze(spark.range(0, 200_000, 1, 8), "erp", 7, "2024-03-01 06:00:00"), path)
    finally:
        spark.conf.set(advised, before)
    back = io.read_table(spark, path)
    assert back.agg(F.count("*"), F.countDistinct("id"), F.countDistinct("_ingestion_date")).first()[:] == (200_000, 200_000, 1)
    assert back.select(F.input_file_name()).distinct().count() > 2


def test_hierarchies_send_no_table_to_the_driver(spark, monkeypatch):
    plans, own = [], reshape._written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, name)

    monkeypatch.setattr(reshape, "_written", written)
    tree = spark.range(1, 40).select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent"))
    up = reshape.ancestors(tree, "id", "parent")
    roots = reshape.tree_roots(tree, "id", "parent")
    plans.append(roots._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]
    assert up.count() == sum(i.bit_length() for i in range(1, 40)) and roots.where("root = 1").count() == 39


def test_training_reads_its_rows_as_often_for_one_variant_as_for_three(spark, monkeypatch):
    from quarryflow.operators import ml

    monkeypatch.setattr(ml, "PART_ROWS", 10)  # and more partitions for more rows, whatever the table's
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return float(x % 7)

    one, found = {"numTrees": 3, "maxDepth": 3}, []
    for n, variants in ((1, [one]), (5, [one] * 3)):
        df = spark.range(0, 600, 1, n).select("id", F.udf(seen, "double").asNondeterministic()("id").alias("a"), (F.col("id") % 7 > 3).cast("double").alias("label"))
        before = read.value
        runs = ml.train_variants(df, ["a"], "label", variants, ["id"])[1]
        found.append((read.value - before, {tuple(r)[2:] for r in runs.collect()}))
    assert found[0] == found[1] and len(found[0][1]) == 1
    assert 0 < found[0][0] <= 3 * 600
