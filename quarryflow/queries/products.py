"""Layers, scores and metrics, streams (sections 2.13 to 2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import scoring as S
from ..operators import snapshots
from ..operators.ml import score_rows, train_variants
from ..plans import medallion as M
from ..plans.dataset import build_dataset
from ..sources import io
from ..streaming import streams as T
from .base import Section, load

q = Section()
QUERIES, ORACLES = q.queries, q.oracles


# --- 2.13 layers
@q("SELECT o_orderkey, 'erp' AS _source_system, 7 AS _batch_id, DATE '2024-03-01' AS _ingestion_date FROM orders")
def bronze_land(spark, d):
    path = io.scratch(spark, "bronze")
    M.land(M.bronze(load(spark, d, "orders"), "erp", 7, "2024-03-01 06:00:00"), path)
    return io.read_table(spark, path).select("o_orderkey", "_source_system", "_batch_id", "_ingestion_date")


@q("""WITH c AS (SELECT upper(trim(c_mktsegment)) AS seg, c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 9000)
SELECT seg, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY c_acctbal DESC, c_custkey) AS rn FROM c) WHERE rn = 1""")
def silver_master(spark, d):
    c = load(spark, d, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("seg"), "c_custkey", "c_acctbal")
    return M.silver_master(c, "seg", {"c_acctbal": (0, 9000)}, [F.desc("c_acctbal"), "c_custkey"])


@q("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'OPEN' WHEN user_id % 7 = 0 THEN 'MISSING' ELSE 'CLEAN' END AS quality_flag FROM events WHERE event_type <> 'error' AND value >= 0""")
def silver_events(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "PENDING").otherwise(F.col("value").cast("string")).alias("amount"), F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd")).alias("closed"), F.when(F.pmod("user_id", F.lit(7)) != 0, F.col("user_id")).alias("owner"))
    return M.silver_events(e, ["amount"], ["closed"], "closed", "owner").select("event_id", "quality_flag")


_RISK = """WITH o AS (SELECT o_custkey AS k, count(*) AS claims FROM orders GROUP BY 1), e AS (SELECT user_id AS k, count(*) FILTER (WHERE event_type = 'error') AS incidents FROM events GROUP BY 1),
r AS (SELECT c_custkey, round(abs(c_acctbal) / 10000 * 40 + coalesce(claims, 0)::DOUBLE / greatest(c_nationkey, 1) * 30 + coalesce(incidents, 0)::DOUBLE / greatest(c_nationkey, 1) * 30, 4) AS score FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey)
SELECT c_custkey, score, CASE WHEN score < 40 THEN 'LOW' WHEN score < 70 THEN 'MEDIUM' WHEN score < 100 THEN 'HIGH' ELSE 'CRITICAL' END AS tier FROM r"""


def _risk(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("claims"))
    e = load(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(X.count_if(F.col("event_type") == "error").alias("incidents"))
    c = load(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal") / 10000).alias("emr"), F.col("c_nationkey").alias("employees"))
    score = lambda x: S.score_weighted(x, {"emr": 40, "claims": 30, "incidents": 30}, "employees", ["claims", "incidents"], [40, 70, 100], ["LOW", "MEDIUM", "HIGH", "CRITICAL"])
    return M.gold_risk(c, {"claims": o, "incidents": e}, "c_custkey", score)


@q(_RISK)
def gold_entity_risk(spark, d):
    return _risk(spark, d).select("c_custkey", "score", "tier")


@q("SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def gold_monthly(spark, d):
    return M.gold_monthly(load(spark, d, "lineitem"), "l_shipdate", [F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")])


@q("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_totalprice >= 0 GROUP BY 1")
def run_medallion(spark, d):
    silver = lambda b: b.where("o_totalprice >= 0").select("o_orderkey", "o_orderdate", "o_totalprice")
    gold = lambda s: M.gold_monthly(s, "o_orderdate", [F.count("*").alias("n")])
    return M.run_pipeline(spark, load(spark, d, "orders"), io.scratch(spark, "layers"), silver, gold, {"not_null": ["month"], "unique": [["month"]]})


@q("""SELECT n_name, c_mktsegment, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 0 GROUP BY 1, 2""")
def analytical_dataset(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount")
    sides = [
        (load(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey"),
        (load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"), "c_custkey"),
        (load(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey"),
    ]
    whole = lambda x: x.dropna(subset=["l_extendedprice", "l_discount"])
    total = lambda x: x.groupBy("n_name", "c_mktsegment").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"))
    return build_dataset(spark, lines, sides, io.scratch(spark, "dataset"), whole, total, {"not_null": ["n_name", "net"], "unique": [["n_name", "c_mktsegment"]]})


# --- 2.14 scores and metrics
@q("""WITH x AS (SELECT s_suppkey, round(abs(s_acctbal) / 1000 * 5 + count(l_orderkey)::DOUBLE / greatest(s_nationkey, 1) * 2, 4) AS score FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal, s_nationkey)
SELECT s_suppkey, score, CASE WHEN score < 40 THEN 'LOW' WHEN score < 70 THEN 'MEDIUM' WHEN score < 100 THEN 'HIGH' ELSE 'CRITICAL' END AS tier FROM x""")
def score_weighted_gold(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("l_orderkey").alias("lines"))
    s = load(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 1000).alias("balance"), "s_nationkey").join(n, "s_suppkey", "left")
    return S.score_weighted(s, {"balance": 5, "lines": 2}, "s_nationkey", ["lines"], [40, 70, 100], ["LOW", "MEDIUM", "HIGH", "CRITICAL"]).select("s_suppkey", "score", "tier")


@q("""SELECT c_custkey, round(greatest((least(greatest((abs(c_acctbal) / 5000 - 0.5) / 1.5, 0), 1) * 10 * 0.4 + CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'MACHINERY' THEN 10.0 ELSE 5.0 END * 0.3 - least(c_nationkey, 20)::DOUBLE / 20 * 10 * 0.2) * 10 / 4, 0), 2)::DOUBLE AS score FROM customer""")
def score_composite(spark, d):
    c = load(spark, d, "customer").withColumn("rate", F.abs("c_acctbal") / 5000)
    return S.score_composite(c, "rate", "c_mktsegment", "c_nationkey", penalties={"BUILDING": 0.0, "MACHINERY": 10.0}).select("c_custkey", "score")


@q("SELECT o_orderkey, least((CASE WHEN o_totalprice > 300000 THEN 50 ELSE 0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 40 ELSE 0 END) + (CASE WHEN o_orderstatus = 'P' THEN 30 ELSE 0 END), 100)::INT AS points FROM orders")
def score_fraud(spark, d):
    rules = [(F.col("o_totalprice") > 300000, 50), (F.col("o_orderpriority") == "1-URGENT", 40), (F.col("o_orderstatus") == "P", 30)]
    return S.score_rules(load(spark, d, "orders"), rules).select("o_orderkey", F.col("points").cast("int").alias("points"))


@q("""WITH x AS (SELECT p_partkey, round(p_size / 50.0::DOUBLE * 0.6 + least(p_retailprice / 2000, 1) * 0.4, 4) AS score FROM part) SELECT p_partkey, CASE WHEN score >= 0.7 THEN 'GO' WHEN score >= 0.4 THEN 'CONDITIONAL' ELSE 'NO GO' END AS decision FROM x""")
def decision_go_nogo(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), F.least(F.col("p_retailprice") / 2000, F.lit(1.0)).alias("b"))
    return S.decide(p, {"a": 0.6, "b": 0.4}, 0.7, 0.4).select("p_partkey", "decision")


@q("SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'HIGH' WHEN c_acctbal > 2000 THEN 'MEDIUM' ELSE 'LOW' END AS flag FROM customer")
def risk_flag(spark, d):
    return load(spark, d, "customer").select("c_custkey", X.band([(F.col("c_acctbal") > 8000, "HIGH"), (F.col("c_acctbal") > 2000, "MEDIUM")], "LOW").alias("flag"))


@q("WITH a AS (SELECT l_suppkey AS k, sum(l_extendedprice * l_discount) AS losses FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey AS k, sum(s_acctbal) AS premiums FROM supplier GROUP BY 1) SELECT k, round(losses / nullif(premiums, 0), 4) AS ratio FROM a FULL JOIN b USING (k)")
def loss_ratio(spark, d):
    a = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_extendedprice") * F.col("l_discount")).alias("loss"))
    return S.loss_ratio(a, load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("premium")), "k", "loss", "premium").select("k", "ratio")


_SUBS = "s AS (SELECT o_orderkey, o_custkey AS account, o_orderpriority AS plan, CASE o_orderpriority WHEN '1-URGENT' THEN 999 WHEN '2-HIGH' THEN 199 ELSE 49 END AS price, o_orderdate AS a, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 60 DAY END AS b FROM orders)"


def _subs(spark, d):
    price = F.when(F.col("o_orderpriority") == "1-URGENT", 999).when(F.col("o_orderpriority") == "2-HIGH", 199).otherwise(49)
    return load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("plan"), price.alias("price"), F.col("o_orderdate").alias("a"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("interval 60 days")).alias("b"))


@q(f"""WITH {_SUBS}, m AS (SELECT unnest(generate_series(low, high, INTERVAL 1 MONTH)) AS p FROM (SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP AS low, max(o_orderdate)::TIMESTAMP AS high FROM orders)) SELECT p::DATE AS month, plan, count(DISTINCT account) AS accounts, count(DISTINCT account) * any_value(price) AS mrr
FROM s JOIN m ON a <= last_day(p) AND (b IS NULL OR b > p) GROUP BY 1, 2""")
def mrr_by_plan(spark, d):
    months = X.calendar_of(load(spark, d, "orders"), "o_orderdate", "1 month").select(F.col("d").alias("month"), F.last_day("d").alias("month_end"))
    return S.mrr(_subs(spark, d), months, "a", "b", "plan", "price", "account").withColumn("mrr", F.col("mrr").cast("long"))


@q("SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS churned, round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(*), 2) AS churn_pct FROM customer GROUP BY 1")
def churn_by_segment(spark, d):
    return S.churn(load(spark, d, "customer"), ["c_mktsegment"], F.col("c_acctbal") < 0, F.lit(True))


@q(f"WITH {_SUBS}, x AS (SELECT *, lag(price) OVER (PARTITION BY account ORDER BY a, o_orderkey) AS before FROM s) SELECT o_orderkey, CASE WHEN price > before THEN 'upgrade' WHEN price < before THEN 'downgrade' ELSE 'lateral' END AS change FROM x WHERE before IS NOT NULL")
def plan_changes(spark, d):
    return S.plan_changes(_subs(spark, d), "account", ["a", "o_orderkey"], "price").select("o_orderkey", "change")


@q("WITH x AS (SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 2) AS success_pct FROM events GROUP BY 1) SELECT user_id, success_pct, CASE WHEN success_pct >= 95 THEN 'healthy' WHEN success_pct >= 80 THEN 'watch' ELSE 'poor' END AS health FROM x")
def health_score(spark, d):
    return S.health_score(load(spark, d, "events"), "user_id", F.col("event_type") != "error", [(95, "healthy"), (80, "watch")], "poor")


@q("""WITH x AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'F' THEN (epoch(l_shipdate) - epoch(o_orderdate)) / 3600 END AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, round(avg(h), 3) AS avg_hours, round(median(h), 3) AS median_hours, count(h) AS resolved, count(*) FILTER (WHERE h IS NULL) AS open FROM x GROUP BY 1""")
def resolution_time(spark, d):
    x = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.resolution_time(x, "l_returnflag", F.col("o_orderdate").cast("timestamp"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate").cast("timestamp")))


@q("WITH x AS (SELECT c_mktsegment AS plan, event_type AS feature, count(DISTINCT user_id) AS accounts, count(*) AS uses FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2) SELECT *, rank() OVER (PARTITION BY plan ORDER BY accounts DESC)::INT AS rank FROM x")
def feature_adoption(spark, d):
    x = load(spark, d, "events").join(load(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"))
    return S.feature_adoption(x.select(F.col("c_mktsegment").alias("plan"), F.col("event_type").alias("feature"), "user_id"), "plan", "feature", "user_id")


_CARD = "SELECT s_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS loss, CASE WHEN count(*) > 650 THEN 'HIGH' WHEN count(*) > 600 THEN 'MEDIUM' ELSE 'LOW' END AS flag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"


@q(_CARD)
def broker_scorecard(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice")
    sums = [F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("loss")]
    return S.scorecard(lines, [(load(spark, d, "supplier").select("s_suppkey"), "s_suppkey")], ["s_suppkey"], sums, [(F.col("n") > 650, "HIGH"), (F.col("n") > 600, "MEDIUM")], "LOW")


@q("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS reported, round(sum(l_extendedprice * (1 + l_tax)), 2) AS audited, round(sum(l_extendedprice * (1 + l_tax) - l_extendedprice), 2) AS variance FROM lineitem GROUP BY 1")
def payroll_variance(spark, d):
    return S.payroll_variance(load(spark, d, "lineitem").withColumn("audited", F.col("l_extendedprice") * (1 + F.col("l_tax"))), "l_returnflag", "l_extendedprice", "audited")


@q("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-06-01' AND DATE '1996-07-01'")
def expiring_items(spark, d):
    return S.expiring(load(spark, d, "orders"), "o_orderdate", "1996-06-01", 30).select("o_orderkey")


@q("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) SELECT month, round(sum(v) OVER (PARTITION BY year(month) ORDER BY month), 2) AS ytd, round(v - lag(v, 3) OVER (ORDER BY month), 2) AS qoq, round(v - lag(v, 12) OVER (ORDER BY month), 2) AS yoy FROM m""")
def time_intel(spark, d):
    m = load(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return S.time_intel(m, "month", "v").select("month", *(F.round(c, 2).alias(c) for c in ("ytd", "qoq", "yoy")))


@q("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)")
def row_level_security(spark, d):
    rights = spark.createDataFrame([("ann", 1), ("ann", 2), ("bob", 3)], "user string, n_regionkey int")
    x = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.restrict(x, rights, "ann", "n_regionkey").select("c_custkey")


@q("SELECT t AS threshold, count(*) FILTER (WHERE c_acctbal >= t) AS hits, count(*) AS n FROM customer, (VALUES (0.0::DOUBLE), (5000.0), (9000.0)) v(t) GROUP BY 1")
def what_if_thresholds(spark, d):
    return S.what_if(load(spark, d, "customer"), "c_acctbal", spark.createDataFrame([(0.0,), (5000.0,), (9000.0,)], "threshold double"))


@q("SELECT d::DATE AS period, count(event_id) AS n FROM (SELECT unnest(generate_series(low, high, INTERVAL 1 DAY)) AS d FROM (SELECT date_trunc('day', min(ts))::TIMESTAMP AS low, max(ts)::TIMESTAMP AS high FROM events)) LEFT JOIN events ON ts::DATE = d::DATE GROUP BY 1")
def resample_period(spark, d):
    return S.resample(load(spark, d, "events"), "ts", "day", [F.count("*").alias("n")], dense=True).na.fill(0)


@q("""WITH x AS (SELECT l_extendedprice > 40000 AS hit, substr(md5('42:' || (l_orderkey || '|' || l_linenumber)), 1, 8) < '33333334' AS test FROM lineitem),
c AS (SELECT count(*) FILTER (WHERE NOT test) AS rows_train, count(*) FILTER (WHERE test) AS rows_test, count(*) FILTER (WHERE test AND hit) AS positives_test, count(*) AS rows_scored FROM x)
SELECT run::INT AS run, c.*, true AS referee_agrees FROM c, range(3) t(run)""")
def train_classifier(spark, d):
    """Sizes of the split by key, and whether the counted accuracy is the evaluator's."""
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") > 40000).cast("double").alias("label"))
    features = ["l_quantity", "l_discount", "l_tax"]
    variants = [{"numTrees": 5, "maxDepth": 3}, {"numTrees": 10, "maxDepth": 4}, {"numTrees": 10, "maxDepth": 5}]
    best, runs = train_variants(x, features, "label", variants, ["l_orderkey", "l_linenumber"])
    scored = score_rows(best, x, features).agg(F.count("prediction").alias("rows_scored"))
    marks = runs.crossJoin(F.broadcast(scored))  # one row
    return marks.select("run", "rows_train", "rows_test", "positives_test", "rows_scored", (F.abs(F.col("accuracy") - F.col("referee")) < 1e-9).alias("referee_agrees"))


# --- 2.15 streams: each runs to the end of its files, so its rows are those of the batch twin
def _events(spark, d, slices: int = 4):
    path = io.scratch(spark, "incoming")
    e = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return T.stream_source(spark, path, e.schema, max_files=_arrive(e, path, slices))


#: Rows of one file that arrives, on average.
FILE_ROWS = 1_000_000


def _arrive(e, path: str, slices: int = 4) -> int:
    """Write slices that come in order of time, each as so many files of a bounded number of rows; gives that number, so that a batch can take a slice.  Rows without a time are in the first."""
    files = max(1, -(-e.count() // (slices * FILE_ROWS)))
    ends = e.select(F.unix_timestamp("ts").alias("s")).stat.approxQuantile("s", [i / slices for i in range(1, slices)], 0.01)
    cuts = [F.timestamp_seconds(F.lit(x)) for x in sorted(set(ends))]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = e if low is None else e.where(F.col("ts") >= low)
        if high is not None:
            part = part.where((F.col("ts") < high) | F.col("ts").isNull()) if low is None else part.where(F.col("ts") < high)
        part.repartition(files).write.mode("append").json(path)
    return files


def _run(spark, stream, schema=None):
    out = io.scratch(spark, "stream")
    T.stream_sink(stream, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return io.read_table(spark, f"{out}/data", schema=schema or stream.schema)


@q("SELECT event_id, user_id, event_type FROM events")
def stream_file_source(spark, d):
    return _run(spark, _events(spark, d).select("event_id", "user_id", "event_type"))


@q("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def stream_append_sink(spark, d):
    return _run(spark, _events(spark, d).where("event_type = 'purchase'").select("event_id", "value"))


@q("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return _run(spark, T.enrich(_events(spark, d), c, "user_id").select("event_id", "c_mktsegment"))


_WINDOW = "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


def _windows(events, delay=None):
    return T.tumbling(events, "ts", "6 hours", delay, ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")])


@q(f"SELECT * FROM ({_WINDOW}) WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling_agg(spark, d):
    # windows that the watermark has passed; rows come in order of time, so none is late
    return _run(spark, _windows(_events(spark, d, 6), "1 hour").drop("window_end")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@q(_WINDOW)
def stream_tumbling_batch_twin(spark, d):
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _windows(e).drop("window_end").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@q("""WITH x AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, n_name, count(*) AS n, round(sum(value), 3) AS total FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT *, CASE WHEN n > 2 THEN 'HIGH' WHEN n > 1 THEN 'MEDIUM' ELSE 'LOW' END AS flag FROM x WHERE window_start + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events JOIN customer ON user_id = c_custkey)""")
def stream_scorecard(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("k"))
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    sums = [F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")]
    card = S.scorecard(_events(spark, d), [(c, "user_id"), (n, "k")], ["n_name"], sums, [(F.col("n") > 2, "HIGH"), (F.col("n") > 1, "MEDIUM")], "LOW", "ts", "30 minutes", "1 hour")
    return _run(spark, card.drop("window_end")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@q("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert_sink(spark, d):
    root = io.scratch(spark, "upserts")
    T.stream_upsert(_events(spark, d).select("user_id", "event_id"), f"{root}/table", ["user_id"], "event_id", f"{root}/checkpoint").awaitTermination()
    return snapshots.read(spark, f"{root}/table")


@q(f"SELECT * FROM ({_WINDOW}) WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def late_data_policy(spark, d):
    """Rows that come a day or more late, in the last files, are dropped once their window is closed."""
    path = io.scratch(spark, "late")
    e = load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    files = _arrive(e, path)
    late = e.where("event_type = 'error'").withColumn("ts", F.col("ts") - F.expr("interval 20 days"))
    late.repartition(files).write.mode("append").json(path)
    return _run(spark, _windows(T.stream_source(spark, path, e.schema, max_files=files), "1 hour").drop("window_end")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
