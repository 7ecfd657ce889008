"""Warehouse modelling, data quality and incremental loads (sections 2.10 to 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import incremental as I
from ..operators import quality as Q
from ..operators import snapshots as B
from ..operators import warehouse as H
from ..sources import io
from .base import Section, load

q = Section()
QUERIES, ORACLES = q.queries, q.oracles
# two versions of customer: every seventh balance changes, every eleventh key is gone, keys of suppliers with 900000 added are new
OLD = "old AS (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer)"
NEW = "new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT s_suppkey + 900000, s_acctbal, 'NEW' FROM supplier)"


def old(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))


def new(spark, d):
    o = old(spark, d)
    moved = o.where(F.col("k") % 11 != 0).withColumn("bal", F.when(F.col("k") % 7 == 0, F.col("bal") + 1).otherwise(F.col("bal")))
    return moved.unionByName(load(spark, d, "supplier").select((F.col("s_suppkey") + 900000).alias("k"), F.col("s_acctbal").alias("bal"), F.lit("NEW").alias("seg")))


UPSERT = f"WITH {OLD}, {NEW} SELECT coalesce(new.k, old.k) AS k, CASE WHEN new.k IS NULL THEN old.bal ELSE new.bal END AS bal, CASE WHEN new.k IS NULL THEN old.seg ELSE new.seg END AS seg FROM old FULL JOIN new ON old.k = new.k"


# --- 2.10 warehouse
@q(UPSERT)
def scd1_upsert(spark, d):
    return H.scd1(old(spark, d), new(spark, d), ["k"], ["bal", "seg"])


def _dim(spark, d):
    return H.scd2_init(old(spark, d), ["k"], ["bal", "seg"], F.lit("2024-01-01").cast("date"))


def _applied(spark, d):
    return H.scd2_apply(_dim(spark, d), new(spark, d), ["k"], ["bal", "seg"], F.lit("2024-02-01").cast("date"))


_CHANGED = "n.k IS NOT NULL AND (o.bal IS DISTINCT FROM n.bal OR o.seg IS DISTINCT FROM n.seg)"
SCD2 = f"""{OLD}, {NEW}, dim AS (SELECT o.k, o.bal, o.seg, DATE '2024-01-01' AS valid_from, CASE WHEN {_CHANGED} THEN DATE '2024-02-01' END AS valid_to, NOT ({_CHANGED}) AS is_current FROM old o LEFT JOIN new n ON o.k = n.k
UNION ALL SELECT n.k, n.bal, n.seg, DATE '2024-02-01', NULL, true FROM new n LEFT JOIN old o ON o.k = n.k WHERE o.k IS NULL OR ({_CHANGED}))"""


@q(f"WITH {OLD} SELECT k, bal, seg, DATE '2024-01-01' AS valid_from, NULL::DATE AS valid_to, true AS is_current FROM old")
def scd2_initial(spark, d):
    return _dim(spark, d)


@q(f"WITH {SCD2} SELECT * FROM dim")
def scd2_apply(spark, d):
    return _applied(spark, d)


@q(f"WITH {SCD2} SELECT k, count(*) AS versions FROM dim GROUP BY 1")
def scd2_history(spark, d):
    return _applied(spark, d).groupBy("k").agg(F.count("*").alias("versions"))


@q(f"WITH {SCD2} SELECT * FROM dim WHERE valid_from <= DATE '2024-01-15' AND (valid_to IS NULL OR valid_to > DATE '2024-01-15')")
def scd2_as_of(spark, d):
    return H.scd2_as_of(_applied(spark, d), F.lit("2024-01-15").cast("date"))


@q(f"WITH {OLD}, {NEW} SELECT o.k, coalesce(n.bal, o.bal) AS bal, CASE WHEN n.bal <> o.bal THEN o.bal END AS prev_bal FROM old o LEFT JOIN new n ON o.k = n.k")
def scd3_prev_value(spark, d):
    return H.scd3(old(spark, d), new(spark, d), "k", "bal")


@q(f"WITH {SCD2} SELECT 'now' AS part, count(*) AS n, count(*) FILTER (WHERE NOT is_current) AS closed FROM dim WHERE is_current UNION ALL SELECT 'history', count(*), count(*) FILTER (WHERE NOT is_current) FROM dim WHERE NOT is_current")
def scd4_split(spark, d):
    # the two tables that are written, each read again by itself
    root = io.scratch(spark, "scd4")
    parts = []
    for name, table in zip(("now", "history"), H.scd4_split(_applied(spark, d))):
        io.write_table(table, f"{root}/{name}")
        parts.append(io.read_table(spark, f"{root}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.count(F.when(~F.col("is_current"), 1)).alias("closed")))
    return parts[0].unionByName(parts[1])


@q("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS sk FROM orders")
def surrogate_key(spark, d):
    return H.surrogate_key(load(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("sk").cast("long").alias("sk"))


@q("SELECT DISTINCT md5(o_custkey::VARCHAR) AS hk, o_custkey, 'orders' AS record_source FROM orders")
def vault_hub(spark, d):
    return H.hub(load(spark, d, "orders"), "o_custkey", "orders")


@q(f"WITH {OLD}, {NEW} SELECT md5(n.k::VARCHAR) AS hk, n.seg FROM new n LEFT JOIN old o ON o.k = n.k WHERE o.k IS NULL OR o.seg <> n.seg OR o.bal <> n.bal")
def vault_satellite(spark, d):
    at = F.lit("2024-01-01").cast("timestamp")
    known = H.satellite(old(spark, d), "k", ["bal", "seg"], "crm", at)
    return H.satellite(new(spark, d), "k", ["bal", "seg"], "crm", at, known).select("hk", "seg")


@q("SELECT DISTINCT md5(l_partkey || '||' || l_suppkey) AS lk, md5(l_partkey::VARCHAR) AS hk_l_partkey, md5(l_suppkey::VARCHAR) AS hk_l_suppkey, 'lines' AS record_source FROM lineitem")
def vault_link(spark, d):
    return H.link(load(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "lines")


@q(f"WITH {OLD}, {NEW} SELECT md5(k::VARCHAR) AS hk, k, 'crm' AS record_source, coalesce(n.bal, o.bal) AS bal FROM old o LEFT JOIN new n USING (k)")
def vault_current_view(spark, d):
    at = lambda day: F.lit(day).cast("timestamp")
    sat = H.satellite(old(spark, d), "k", ["bal", "seg"], "crm", at("2024-01-01"))
    sat = sat.unionByName(H.satellite(new(spark, d), "k", ["bal", "seg"], "crm", at("2024-02-01"), sat))
    return H.vault_current(H.hub(old(spark, d), "k", "crm"), sat, ["bal"])


@q("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS sk FROM customer")
def star_dim(spark, d):
    return H.surrogate_key(load(spark, d, "customer").select("c_custkey"), ["c_custkey"]).select("c_custkey", F.col("sk").cast("long").alias("sk"))


@q("WITH dim AS (SELECT c_custkey, c_custkey + 10 AS sk FROM customer WHERE c_acctbal > 0) SELECT o_orderkey, coalesce(sk, -1) AS customer_sk FROM orders LEFT JOIN dim ON o_custkey = c_custkey")
def star_fact(spark, d):
    dim = load(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", (F.col("c_custkey") + 10).alias("sk"))
    return H.star_fact(load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer")), {"customer": (dim, "c_custkey", "sk")}).select("o_orderkey", "customer_sk")


@q("""WITH p AS (SELECT last_day(m)::DATE AS e FROM (SELECT unnest(generate_series(low, high, INTERVAL 1 MONTH)) AS m FROM (SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP AS low, max(o_orderdate)::TIMESTAMP AS high FROM orders))), k AS (SELECT DISTINCT o_orderpriority FROM orders)
SELECT k.o_orderpriority, e AS month_end, round(coalesce(sum(o_totalprice), 0), 2) AS total, count(o_orderkey) AS events FROM k CROSS JOIN p LEFT JOIN orders o ON o.o_orderpriority = k.o_orderpriority AND o_orderdate::DATE <= e GROUP BY 1, 2""")
def fact_periodic_snapshot(spark, d):
    o = load(spark, d, "orders")
    ends = X.calendar_of(o, "o_orderdate", "1 month").select(F.last_day("d").alias("month_end"))
    return H.periodic_snapshot(o, ends, "o_orderpriority", "o_orderdate", "o_totalprice", "month_end").withColumn("total", F.round("total", 2))


@q("SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS signup, min(ts) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def fact_accumulating(spark, d):
    return H.accumulating(load(spark, d, "events"), "user_id", "event_type", "ts", ["signup", "purchase"])


@q("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, ((1 - grouping(year(o_orderdate))) + (1 - grouping(month(o_orderdate))))::INT AS level FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate))")
def olap_drill_rollup(spark, d):
    o = load(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"))
    return H.rollup_levels(o, ["y", "m"], [F.count("*").alias("n")])


@q("SELECT l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber IN (1, 2) GROUP BY 1")
def olap_slice_dice(spark, d):
    return H.slice_dice(load(spark, d, "lineitem"), {"l_returnflag": "R", "l_linenumber": [1, 2]}, ["l_linestatus"], [F.round(F.sum("l_quantity"), 2).alias("qty")])


_MART = "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def _mart(o):
    return o.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q(_MART)
def agg_table_monthly(spark, d):
    return _mart(load(spark, d, "orders"))


@q("""WITH o AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1), e AS (SELECT user_id AS k, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(errors, 0) AS errors FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey""")
def agg_table_entity(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    e = load(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(X.count_if(F.col("event_type") == "error").alias("errors"))
    return load(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left").na.fill(0)


@q("SELECT date_trunc('month', o_orderdate)::DATE AS month, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) AS pct FROM orders GROUP BY 1")
def agg_table_compliance(spark, d):
    return load(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(X.rate_pct(X.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("pct"))


@q("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, round(sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN o_totalprice + 1 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def mart_incremental_refresh(spark, d):
    o = load(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("date"))
    late = o.withColumn("o_totalprice", F.when(F.col("o_orderdate") >= "1997-01-01", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return H.refresh_mart(_mart(o), late, "month", _mart, since="1997-01-01")


# --- 2.11 quality
@q("SELECT unnest(['user_id', 'v']) AS column_name, unnest([count(*) FILTER (WHERE user_id IS NULL), count(*) FILTER (WHERE event_type = 'error')]) AS nulls, unnest([0.0, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 2)])::DOUBLE AS pct FROM events")
def null_profile(spark, d):
    return Q.null_profile(load(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v")))


@q("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_latest(spark, d):
    return Q.dedup_latest(load(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@q("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def dedup_first(spark, d):
    return load(spark, d, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@q("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_report(spark, d):
    return Q.dup_report(load(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@q("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def distinct_on(spark, d):
    return Q.dedup_latest(load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@q("WITH f AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey FROM orders, f WHERE o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)")
def outlier_iqr(spark, d):
    return Q.outliers(load(spark, d, "orders"), "o_totalprice", "iqr", 0.5).where("outlier").select("o_orderkey")


@q("WITH f AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey FROM orders, f WHERE abs(o_totalprice - m) > 1.5 * s")
def outlier_zscore(spark, d):
    return Q.outliers(load(spark, d, "orders"), "o_totalprice", "zscore", 1.5).where("outlier").select("o_orderkey")


@q("SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 40 THEN p_size END AS p_size FROM part")
def range_nullify(spark, d):
    return load(spark, d, "part").select("p_partkey", X.nullify_outside("p_size", 5, 40).alias("p_size"))


@q("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind FROM events")
def allowed_values(spark, d):
    return load(spark, d, "events").select("event_id", X.enforce_domain("event_type", ["view", "click"], "other").alias("kind"))


@q("SELECT o_orderkey, concat_ws('; ', CASE WHEN NOT o_totalprice > 20000 THEN 'price' END, CASE WHEN o_orderstatus = 'P' THEN 'status' END) AS reason FROM orders WHERE NOT o_totalprice > 20000 OR o_orderstatus = 'P'")
def validate_split(spark, d):
    _, bad = Q.validate_split(load(spark, d, "orders"), {"price": F.col("o_totalprice") > 20000, "status": F.col("o_orderstatus") != "P"})
    return bad.select("o_orderkey", "reason")


@q("""SELECT 'not_empty' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'not_null:o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders UNION ALL SELECT 'check:cheap', count(*) FILTER (WHERE o_totalprice >= 300000) FROM orders
UNION ALL SELECT 'unique:o_custkey', (count(*) - count(DISTINCT o_custkey))::BIGINT FROM orders""")
def assert_rules(spark, d):
    return Q.check(load(spark, d, "orders"), ["o_custkey"], [["o_custkey"]], {"cheap": F.col("o_totalprice") < 300000})


@q("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def ref_integrity(spark, d):
    return Q.orphans(load(spark, d, "orders"), load(spark, d, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@q("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def cross_field_rule(spark, d):
    x = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.validate_split(x, {"dates": F.col("l_shipdate") >= F.col("o_orderdate")})[1].select("l_orderkey", "l_linenumber")


@q("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def composite_key_check(spark, d):
    return Q.dup_report(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@q("""SELECT 'not_empty' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'not_null:o_orderkey', 0 UNION ALL SELECT 'check:status', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'unique:o_orderkey', (count(*) - count(DISTINCT o_orderkey))::BIGINT FROM orders UNION ALL SELECT 'foreign:o_custkey', count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders""")
def constraint_check(spark, d):
    return Q.check_schema(load(spark, d, "orders"), {"not_null": ["o_orderkey"], "unique": [["o_orderkey"]], "check": {"status": "o_orderstatus in ('F', 'O')"}, "foreign": {"o_custkey": (load(spark, d, "customer"), "c_custkey")}})


@q("SELECT p_partkey, p_size::DOUBLE AS height_cm, (DATE '1970-01-01' + p_size) AS born_date, p_brand AS born_place FROM part")
def extract_semistructured(spark, d):
    born = F.concat(F.date_format(F.date_add(F.lit("1970-01-01"), F.col("p_size")), "d MMMM yyyy"), F.lit(" in "), "p_brand", F.lit(", X (ABC)"))
    x = load(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(" cm / 70 kg")).alias("Measurements"), born.alias("Born"))
    return Q.parse_profile(x).select("p_partkey", "height_cm", "born_date", "born_place")


@q("WITH s AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN t >= 2000000 THEN 'gold' WHEN t >= 1000000 THEN 'silver' ELSE 'bronze' END AS tier FROM s")
def tier_record(spark, d):
    s = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return s.select("o_custkey", X.band([(F.col("t") >= 2000000, "gold"), (F.col("t") >= 1000000, "silver")], "bronze").alias("tier"))


# --- 2.12 incremental loads
@q(f"WITH {NEW} SELECT * FROM new")
def full_refresh(spark, d):
    path = io.scratch(spark, "full")
    io.write_table(old(spark, d), path, mode="overwrite")
    io.write_table(new(spark, d), path, mode="overwrite")
    return io.read_table(spark, path)


@q("SELECT event_id, ts FROM events")
def watermark_incremental(spark, d):
    root, e = io.scratch(spark, "loads"), load(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    half = e.where("ts <= timestamp'2024-01-15 00:00:00'")
    for source in (half, e, e):  # the last run finds nothing new
        I.incremental(source, root, "events", "ts", ["event_id"])
    return I.read_incremental(spark, root, "events", e.schema)


@q("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def incremental_additive(spark, d):
    per = lambda o: o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    o = load(spark, d, "orders")
    return I.merge_add(per(o.where("o_orderdate < '1996-01-01'")), per(o.where("o_orderdate >= '1996-01-01'")), ["o_orderpriority"], ["n"])


@q(f"WITH {OLD}, {NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_ignore(spark, d):
    return I.insert_missing(old(spark, d), new(spark, d), ["k"])


@q(f"WITH {OLD}, {NEW} SELECT coalesce(old.k, new.k) AS k, coalesce(new.bal, old.bal) AS bal, coalesce(old.seg, new.seg) AS seg FROM old FULL JOIN new ON old.k = new.k")
def merge_upsert(spark, d):
    root = io.scratch(spark, "merged")
    B.create(old(spark, d), root, ["k"], 16)
    B.merge(spark, root, new(spark, d), update=["bal"])
    return B.read(spark, root)


@q(f"""WITH {OLD}, {NEW}, b AS (SELECT * FROM new WHERE k % 100 = 7) SELECT coalesce(old.k, b.k) AS k, CASE WHEN b.k IS NULL THEN old.bal ELSE b.bal END AS bal, CASE WHEN b.k IS NULL THEN old.seg ELSE b.seg END AS seg FROM old FULL JOIN b ON old.k = b.k WHERE coalesce(old.k, b.k) % 100 <> 11""")
def merge_buckets(spark, d):
    """A small batch and a few deletions: only the buckets of their keys are written again."""
    root = io.scratch(spark, "buckets")
    B.create(old(spark, d), root, ["k"], 16)
    B.merge(spark, root, new(spark, d).where("k % 100 = 7"))
    B.delete_keys(spark, root, old(spark, d).where("k % 100 = 11").select("k"))
    return B.read(spark, root)


@q(f"WITH {SCD2} SELECT * FROM dim")
def scd2_buckets(spark, d):
    root = io.scratch(spark, "dimension")
    B.create(_dim(spark, d), root, ["k"], 16)
    B.change(spark, root, new(spark, d), lambda dim, batch: H.scd2_apply(dim, batch, ["k"], ["bal", "seg"], F.lit("2024-02-01").cast("date")))
    return B.read(spark, root)


@q(f"WITH {NEW} SELECT * FROM new")
def merge_delete_missing(spark, d):
    return I.upsert(old(spark, d), new(spark, d), ["k"], delete_missing=True)


@q("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_where(spark, d):
    return I.update(load(spark, d, "orders"), F.col("o_orderstatus") == "P", {"o_totalprice": F.lit(0.0)}).select("o_orderkey", "o_totalprice")


@q("SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'HOLD' ELSE o_orderstatus END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def update_from(spark, d):
    x = load(spark, d, "orders").join(load(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return I.update(x.withColumn("status", F.col("o_orderstatus")), F.col("c_acctbal") < 0, {"status": F.lit("HOLD")}).select("o_orderkey", "status")


@q("SELECT o_orderkey FROM orders WHERE o_totalprice <= 100000")
def delete_where(spark, d):
    return I.delete(load(spark, d, "orders"), F.col("o_totalprice") > 100000).select("o_orderkey")


@q(f"""WITH {OLD}, {NEW} SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'INSERT' WHEN n.k IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, o.k IS NOT NULL AS has_old, n.k IS NOT NULL AS has_new
FROM old o FULL JOIN new n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.bal IS DISTINCT FROM n.bal OR o.seg IS DISTINCT FROM n.seg""")
def cdc_diff(spark, d):
    return I.cdc_diff(old(spark, d), new(spark, d), ["k"]).select("k", "op", F.col("old_row").isNotNull().alias("has_old"), F.col("new_row").isNotNull().alias("has_new"))


@q("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 2 ELSE c_acctbal END AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0")
def cdc_apply(spark, d):
    o = old(spark, d)
    log = o.where("k % 5 = 0").select("k", (F.col("bal") + 1).alias("bal"), "seg", F.lit("UPDATE").alias("op"), F.lit(1).alias("seq"))
    log = log.unionByName(o.where("k % 5 = 0").select("k", (F.col("bal") + 2).alias("bal"), "seg", F.lit("UPDATE").alias("op"), F.lit(2).alias("seq")))
    return I.cdc_apply(o, log.unionByName(o.where("k % 3 = 0").select("k", "bal", "seg", F.lit("DELETE").alias("op"), F.lit(3).alias("seq"))), ["k"], "seq")


def _versions(spark, d):
    root = io.scratch(spark, "versions")
    B.create(old(spark, d), root, ["k"], 16, saved_at="2024-01-01 00:00:00")
    B.create(new(spark, d), root, ["k"], 16, operation="REPLACE", saved_at="2024-02-01 00:00:00")
    return root


@q(f"WITH {NEW} SELECT * FROM new")
def version_snapshot(spark, d):
    return B.read(spark, _versions(spark, d))


@q(f"WITH {OLD} SELECT * FROM old")
def time_travel(spark, d):
    return B.read(spark, _versions(spark, d), at="2024-01-15 00:00:00")


@q(f"WITH {OLD}, {NEW} SELECT seg, count(*) AS n, 0 AS version FROM old GROUP BY 1 UNION ALL SELECT seg, count(*), 1 FROM new GROUP BY 1")
def version_compare(spark, d):
    root = _versions(spark, d)
    each = [B.read(spark, root, v).groupBy("seg").agg(F.count("*").alias("n")).withColumn("version", F.lit(v)) for v in (0, 1)]
    return each[0].unionByName(each[1])


@q(f"WITH {OLD}, {NEW} SELECT *, NULL AS origin FROM old UNION ALL SELECT *, 'batch' FROM new")
def schema_evolution(spark, d):
    return I.append_evolve(old(spark, d), new(spark, d).withColumn("origin", F.lit("batch")))


@q("SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def backfill_partition(spark, d):
    path, o = io.scratch(spark, "backfill"), load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    io.write_table(o, path, partition_by=["o_orderstatus"])
    I.backfill(o.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), path, "o_orderstatus")
    return io.read_table(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_totalprice FROM orders), e AS (SELECT min(month) AS low, max(month) AS high FROM m)
SELECT month, count(*) AS n, round(sum(CASE WHEN month = high THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM m, e WHERE month <> low GROUP BY month""")
def backfill_rerun(spark, d):
    """A job by month, run again for two months after their source changed: one month's prices doubled, one month's rows gone."""
    path = io.scratch(spark, "monthly")
    o = load(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), "o_totalprice")
    job = lambda rows: rows.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    io.write_table(job(o), path, partition_by=["month"])
    ends = o.agg(F.min("month").alias("low"), F.max("month").alias("high")).first()
    changed = o.where(F.col("month") != F.lit(ends.low)).withColumn("o_totalprice", F.when(F.col("month") == F.lit(ends.high), 2 * F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    I.rerun(changed, path, "month", [ends.low, ends.high], job)
    return io.read_table(spark, path, schema="n long, total double, month date").select("month", "n", "total")


@q(f"WITH {OLD}, {NEW} SELECT 0::BIGINT AS version, TIMESTAMP '2024-01-01' AS saved_at, 'CREATE' AS operation, count(*) AS rows FROM old UNION ALL SELECT 1, TIMESTAMP '2024-02-01', 'REPLACE', count(*) FROM new")
def history_log(spark, d):
    return B.history(spark, _versions(spark, d)).select("version", F.col("saved_at").cast("timestamp_ntz").alias("saved_at"), "operation", "rows")
