"""Windows, sorting and reshaping, scalar functions, UDF surface (sections 2.6 to 2.9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import aggregates as A
from ..operators import quality as D
from ..operators import reshape as R
from ..operators import windows as W
from .base import Section, load

q = Section()
QUERIES, ORACLES = q.queries, q.oracles
BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
KEYS, ORDER = ["o_custkey"], ["o_orderdate", "o_orderkey"]


def orders(spark, d):
    return load(spark, d, "orders")


def events(spark, d):
    return load(spark, d, "events")


# --- 2.6 windows
@q("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS row_number, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rank, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dense_rank FROM orders")
def win_rank_trio(spark, d):
    return W.rank_all(orders(spark, d), KEYS, ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", *(F.col(c).cast("long").alias(c) for c in ("row_number", "rank", "dense_rank")))


@q("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def win_topn_per_group(spark, d):
    return W.top_n(orders(spark, d), KEYS, [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@q("SELECT c_custkey, CASE ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) WHEN 1 THEN 'low' WHEN 2 THEN 'mid' WHEN 3 THEN 'high' ELSE 'top' END AS band FROM customer")
def win_ntile(spark, d):
    return W.ntile_band(load(spark, d, "customer"), ["c_mktsegment"], ["c_acctbal", "c_custkey"], ["low", "mid", "high", "top"]).select("c_custkey", "band")


@q("SELECT c_custkey, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS pr, cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS cd FROM customer")
def win_pct_rank(spark, d):
    return W.rank_share(load(spark, d, "customer"), ["c_mktsegment"], ["c_acctbal"]).select("c_custkey", F.col("percent_rank").alias("pr"), F.col("cume_dist").alias("cd"))


@q("SELECT o_orderkey, (rank() OVER w + (count(*) OVER (PARTITION BY o_custkey, o_orderstatus) - 1) / 2.0) / count(*) OVER (PARTITION BY o_custkey) AS pct FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
def win_rank_pct_pandas(spark, d):
    return W.rank_pct(orders(spark, d), KEYS, ["o_orderstatus"]).select("o_orderkey", "pct")


@q(f"SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS next, o_totalprice - lag(o_totalprice) OVER w AS delta FROM orders WINDOW w AS ({BY})")
def win_lag_lead(spark, d):
    return W.lag_delta(orders(spark, d), KEYS, ORDER, "o_totalprice").select("o_orderkey", "prev", "next", "delta")


@q(f"SELECT o_orderkey, 100 * (o_totalprice - lag(o_totalprice) OVER w) / nullif(lag(o_totalprice) OVER w, 0) AS pct_change FROM orders WINDOW w AS ({BY})")
def win_pct_change(spark, d):
    return W.pct_change(orders(spark, d), KEYS, ORDER, "o_totalprice").select("o_orderkey", "pct_change")


@q(f"SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running FROM orders WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)")
def win_running_total(spark, d):
    return W.running(orders(spark, d), KEYS, ORDER, "o_totalprice").select("o_orderkey", F.round("running", 2).alias("running"))


@q(f"SELECT o_orderkey, CASE WHEN count(*) OVER w >= 3 THEN round(avg(o_totalprice) OVER w, 3) END AS moving_avg FROM orders WINDOW w AS ({BY} ROWS 2 PRECEDING)")
def win_moving_avg(spark, d):
    return W.moving_avg(orders(spark, d), KEYS, ORDER, "o_totalprice", 3, 3).select("o_orderkey", F.round("moving_avg", 3).alias("moving_avg"))


q.sql("win_rows_vs_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey ROWS UNBOUNDED PRECEDING) AS by_rows, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus RANGE UNBOUNDED PRECEDING) AS by_range FROM orders")


@q("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 2) AS moving FROM orders")
def win_range_days(spark, d):
    o = orders(spark, d).withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return W.moving_range(o, KEYS, "ts", "o_totalprice", 30).select("o_orderkey", F.round("moving", 2).alias("moving"))


q.sql("win_first_last", f"SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key FROM orders WINDOW w AS ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
q.sql("win_group_avg_diff", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS diff, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
q.sql("win_named", f"SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS ({BY})")


@q("""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events)
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM g""")
def win_conditional_reset(spark, d):
    return W.running_with_reset(events(spark, d), ["user_id"], ["ts", "event_id"], "value", F.col("event_type") == "error").select("event_id", F.round("running", 3).alias("running"))


# keys that hold a large share of all rows: two-pass scans
@q("SELECT o_orderkey, (sum(o_totalprice::DECIMAL(18, 2)) OVER w)::DOUBLE AS running, count(o_totalprice) OVER w AS n, max(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def win_running_hot_key(spark, d):
    price = F.col("o_totalprice").cast("decimal(18, 2)").alias("price")  # exact, in whatever order parts are added up
    x = orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderdate", price)
    x = W.running_all(x, ["o_orderstatus"], ORDER, {"running": ("price", "sum"), "n": ("price", "count"), "top": ("price", "max")})
    return x.select("o_orderkey", F.col("running").cast("double").alias("running"), "n", F.col("top").cast("double").alias("top"))


@q("SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS next, o_totalprice - lag(o_totalprice) OVER w AS delta FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def win_lag_lead_hot_key(spark, d):
    return W.lag_delta(orders(spark, d), ["o_orderpriority"], ORDER, "o_totalprice").select("o_orderkey", "prev", "next", "delta")


@q("""WITH g AS (SELECT *, sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events)
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM g""")
def win_reset_hot_key(spark, d):
    return W.running_with_reset(events(spark, d), ["event_type"], ["ts", "event_id"], "value", F.col("value") > 90).select("event_id", F.round("running", 3).alias("running"))


@q("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS row_number, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS rank, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS dense_rank FROM orders")
def win_rank_hot_key(spark, d):
    return W.rank_all(orders(spark, d), ["o_orderstatus"], ["o_orderdate"], ["o_orderkey"]).select("o_orderkey", "row_number", "rank", "dense_rank")


@q("""WITH e AS (SELECT event_id, event_type, ts, CASE WHEN user_id % 5 = 0 THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS before, first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM e""")
def ffill_bfill_hot_key(spark, d):
    e = events(spark, d).withColumn("before", F.when(F.pmod("user_id", F.lit(5)) == 0, F.col("value"))).withColumn("after", F.col("before"))
    for c in ("before", "after"):
        e = W.fill_forward(e, ["event_type"], ["ts", "event_id"], c, backward=c == "after")
    return e.select("event_id", "before", "after")


@q("""WITH m AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS p FROM events), g AS (SELECT *, epoch(p)::BIGINT // 3600 - row_number() OVER (PARTITION BY event_type ORDER BY p) AS i FROM m)
SELECT event_type, min(p)::TIMESTAMP AS island_start, max(p)::TIMESTAMP AS island_end, count(*) AS length FROM g GROUP BY event_type, i""")
def win_gap_islands_hours(spark, d):
    return W.islands(events(spark, d), ["event_type"], "ts", "hour")


@q("""WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS p FROM orders), g AS (SELECT *, year(p) * 12 + month(p) - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS i FROM m)
SELECT o_custkey, min(p)::TIMESTAMP AS island_start, max(p)::TIMESTAMP AS island_end, count(*) AS length FROM g GROUP BY o_custkey, i""")
def win_gap_islands(spark, d):
    return W.islands(orders(spark, d), KEYS, "o_orderdate")


@q(f"SELECT o_custkey, n::DATE AS next_day, date_diff('day', o_orderdate, n)::INT AS gap_days FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n FROM orders) WHERE date_diff('day', o_orderdate, n) > 365")
def win_event_gap(spark, d):
    # rows of one day have the same next day or a gap of 0, so ties change nothing
    return W.event_gaps(orders(spark, d), KEYS, "o_orderdate", 365).select("o_custkey", F.col("next_ts").cast("date").alias("next_day"), "gap_days")


@q("SELECT event_id, event_type, prev FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev <> event_type")
def win_transitions(spark, d):
    return W.transitions(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "prev")


@q(f"SELECT o_orderkey, change FROM (SELECT *, o_totalprice - lag(o_totalprice) OVER ({BY}) AS change FROM orders) WHERE change IS NOT NULL ORDER BY change, o_custkey, o_orderdate, o_orderkey LIMIT 10")
def win_drop_rank(spark, d):
    return W.top_changes(orders(spark, d), KEYS, ORDER, "o_totalprice", 10).select("o_orderkey", "change")


# --- 2.7 sorting, sets, reshaping
q.sql("sort_multi", "SELECT p_partkey, p_brand FROM part ORDER BY p_brand DESC NULLS LAST, p_retailprice ASC NULLS LAST, p_partkey")


@q("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey")
def sort_custom(spark, d):
    return R.order_by_list(orders(spark, d).select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["P", "O", "F"], ["o_orderkey"])


@q("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def limit_offset(spark, d):
    return R.page(orders(spark, d), [F.desc("o_totalprice"), "o_orderkey"], 20, 40).select("o_orderkey")


q.sql("topk_global", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
q.sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q.sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")


@q("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_by_name(spark, d):
    a = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


q.sql("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
q.sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")


@q("SELECT o_orderstatus, coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS \"1-URGENT\", coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH'), 0) AS \"2-HIGH\", coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '3-MEDIUM'), 0) AS \"3-MEDIUM\", coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED'), 0) AS \"4-NOT SPECIFIED\", coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 0) AS \"5-LOW\" FROM orders GROUP BY 1")
def pivot_wide(spark, d):
    return R.pivot_wide(orders(spark, d), ["o_orderstatus"], "o_orderpriority", "o_totalprice", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@q("SELECT l_orderkey, l_linenumber, unnest(['l_tax', 'l_discount']) AS variable, unnest([l_tax, l_discount]) AS value FROM lineitem")
def melt_long(spark, d):
    return R.melt_long(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


@q("WITH x AS (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'F') AS F FROM lineitem GROUP BY 1) SELECT l_returnflag, unnest(['O', 'F']) AS l_linestatus, unnest([O, F]) AS n FROM x")
def stack_unstack(spark, d):
    wide = R.pivot_wide(load(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_orderkey", ["O", "F"], agg=F.count)
    return R.melt_long(wide, ["l_returnflag"], ["O", "F"], "l_linestatus", "n")


# --- 2.8 scalars
@q("SELECT p_partkey, replace(upper(trim(p_name)), 'A', '4') AS name FROM part")
def str_clean(spark, d):
    return load(spark, d, "part").select("p_partkey", X.str_clean("p_name", ["trim", "upper", ("replace", "A", "4")]).alias("name"))


@q("SELECT n_nationkey, concat_ws('-', n_nationkey, n_name, n_regionkey) AS label FROM nation")
def str_concat_label(spark, d):
    return load(spark, d, "nation").select("n_nationkey", X.label(["n_nationkey", "n_name", "n_regionkey"], "-").alias("label"))


q.sql("str_length_position", "SELECT p_partkey, length(p_name)::INT AS n, substring(p_name, 2, 3) AS part, instr(p_name, 'a')::INT AS at FROM part".replace(" AS at", " AS place"))


@q("SELECT s_suppkey, nullif(regexp_extract(s_name, '([A-Za-z]+)#?0*([0-9]+)', 1), '') AS word, nullif(regexp_extract(s_name, '([A-Za-z]+)#?0*([0-9]+)', 2), '') AS number FROM supplier")
def regex_extract(spark, d):
    return X.extract_cols(load(spark, d, "supplier"), "s_name", "([A-Za-z]+)#?0*([0-9]+)", ["word", "number"]).select("s_suppkey", "word", "number")


@q("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[aeiou]', '', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g') AS name FROM part")
def regex_replace(spark, d):
    return load(spark, d, "part").select("p_partkey", X.regex_clean("p_name", [("[aeiou]", ""), ("([a-z])([A-Z])", "$1 $2")]).alias("name"))


@q("SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n FROM documents")
def regex_find_all(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(X.find_all("text", "[A-Z][a-z]+")).cast("long").alias("n"))


@q("SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE value::VARCHAR END AS DOUBLE) AS value FROM events")
def cast_safe(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string")))
    return X.cast_safe(e, {"value": "double"}).select("event_id", "value")


@q("SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS kind FROM events")
def null_coalesce(spark, d):
    return events(spark, d).select("event_id", X.null_if("event_type", ["error"], "none").alias("kind"))


@q("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_type <> 'error' OR event_id % 2 = 0 THEN value END AS v, CASE WHEN event_type <> 'view' THEN value END AS w FROM events WHERE user_id % 11 <> 0), m AS (SELECT event_type, avg(v) AS a FROM e GROUP BY 1)
SELECT event_id, v IS NULL AS v_was_null, round(coalesce(v, a), 5) AS v, round(coalesce(w, (SELECT median(w) FROM e)), 5) AS w FROM e JOIN m USING (event_type)""")
def null_drop_fill_flag(spark, d):
    e = events(spark, d).withColumns({"v": F.when((F.col("event_type") != "error") | (F.pmod("event_id", F.lit(2)) == 0), F.col("value")), "w": F.when(F.col("event_type") != "view", F.col("value")), "u": F.nullif(F.pmod("user_id", F.lit(11)), F.lit(0))})
    x = D.handle_nulls(e, drop=["u"], flag=["v"], fill={"v": ("mean", "event_type"), "w": ("median", None)})
    return x.select("event_id", "v_was_null", F.round("v", 5).alias("v"), F.round("w", 5).alias("w"))


@q("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def ffill_bfill(spark, d):
    e = events(spark, d).withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return W.fill_forward(e, ["user_id"], ["ts", "event_id"], "v").select("event_id", "v")


@q("SELECT o_orderkey, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, month(o_orderdate)::INT AS month, dayname(o_orderdate) AS day_name FROM orders")
def date_parts(spark, d):
    return orders(spark, d).select("o_orderkey", *(c.alias(n) for n, c in X.date_parts("o_orderdate", ["year", "quarter", "month", "day_name"]).items()))


@q("SELECT date_trunc('month', o_orderdate)::DATE AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def date_trunc_bucket(spark, d):
    return X.bucket(orders(spark, d), "o_orderdate", "month", "yyyy-MM").groupBy(F.col("bucket").alias("month"), F.col("bucket_label").alias("label")).agg(F.count("*").alias("n"))


@q("SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate)::INT AS days, (l_shipdate + INTERVAL 30 DAY)::DATE AS due, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600 AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_diff_arith(spark, d):
    x = load(spark, d, "lineitem").join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("l_orderkey", "l_linenumber", X.diff("o_orderdate", "l_shipdate", "days").alias("days"), F.date_add("l_shipdate", 30).alias("due"), X.diff(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"), "hours").alias("hours"))


@q("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def date_parse_multi(spark, d):
    t = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders(spark, d).select("o_orderkey", X.parse_date(t, ["yyyy-MM-dd", "dd/MM/yyyy"]).alias("day"))


@q("SELECT event_id, ((ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'Europe/Paris')::TIMESTAMP AS local_ts FROM events")
def tz_convert(spark, d):
    return events(spark, d).select("event_id", X.convert_tz(F.col("ts").cast("timestamp"), "America/New_York", "Europe/Paris").cast("timestamp_ntz").alias("local_ts"))


@q("SELECT d::DATE AS d, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(low, high, INTERVAL 1 DAY)) AS d FROM (SELECT date_trunc('day', min(o_orderdate))::TIMESTAMP AS low, max(o_orderdate)::TIMESTAMP AS high FROM orders)) LEFT JOIN orders ON o_orderdate::DATE = d::DATE WHERE isodow(d) < 6 GROUP BY 1")
def calendar_dim(spark, d):
    days = X.calendar_of(orders(spark, d), "o_orderdate", business=True)
    return days.join(orders(spark, d), F.col("o_orderdate").cast("date") == F.col("d"), "left").groupBy("d").agg(F.count("o_orderkey").alias("n"))


@q("SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clipped, abs(c_acctbal) AS size FROM customer")
def math_round_bounds(spark, d):
    return load(spark, d, "customer").select("c_custkey", X.clip("c_acctbal", 0.0, 5000.0).alias("clipped"), F.abs("c_acctbal").alias("size"))


@q("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'medium' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS bin FROM part")
def bin_fixed(spark, d):
    return load(spark, d, "part").select("p_partkey", X.cut("p_size", [0, 10, 30, 50], ["small", "medium", "large"]).alias("bin"))


@q("WITH e AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'q1' WHEN c_acctbal <= b THEN 'q2' WHEN c_acctbal <= c THEN 'q3' ELSE 'q4' END AS bin FROM customer, e")
def bin_quantile(spark, d):
    return X.qcut(load(spark, d, "customer"), "c_acctbal", ["q1", "q2", "q3", "q4"], "bin").select("c_custkey", "bin")


@q("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def array_explode(spark, d):
    return X.explode_array(load(spark, d, "embeddings"), "embedding", "x").select("vec_id", F.col("x").cast("double").alias("x"))


@q("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_extract(spark, d):
    return events(spark, d).select("event_id", X.json_get("props", {"k": "$.k"})["k"].cast("int").alias("k"))


@q("SELECT user_id, unnest(list_sort(list(DISTINCT event_type))) AS kind FROM events GROUP BY user_id")
def json_array_flatten(spark, d):
    packed = events(spark, d).groupBy("user_id").agg(F.to_json(F.struct(F.array_sort(F.collect_set("event_type")).alias("kinds"))).alias("doc"))
    return X.json_explode(packed, "doc", "$.kinds", "string", "kind").select("user_id", "kind")


@q("SELECT l_orderkey, l_linenumber, md5(l_orderkey || '||' || l_linenumber) AS key FROM lineitem")
def hash_key(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.hash_key(["l_orderkey", "l_linenumber"]).alias("key"))


@q("SELECT n_nationkey, sha256(n_nationkey || '||' || n_name || '||' || n_regionkey) AS checksum FROM nation")
def row_checksum(spark, d):
    return load(spark, d, "nation").select("n_nationkey", X.row_checksum(["n_nationkey", "n_name", "n_regionkey"]).alias("checksum"))


@q("SELECT l_suppkey, count(*) AS n, 1::BIGINT AS partitions FROM lineitem GROUP BY 1")
def partition_profile(spark, d):
    # after a repartition by key the rows of a key are in one partition
    per = A.partition_profile(load(spark, d, "lineitem").select("l_suppkey").repartition(6, "l_suppkey"), ["l_suppkey"])
    return per.groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.count("*").alias("partitions"))


# --- 2.9 UDF surface
_SIDE = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM customer"


@q(_SIDE)
def udf_scalar(spark, d):
    side = F.udf(lambda b: "debt" if b < 0 else "credit", "string")
    return load(spark, d, "customer").select("c_custkey", side("c_acctbal").alias("side"))


@q(_SIDE)
def udf_pandas(spark, d):
    @F.pandas_udf("string")
    def side(b: pd.Series) -> pd.Series:
        return (b < 0).map({True: "debt", False: "credit"})

    return load(spark, d, "customer").select("c_custkey", side("c_acctbal").alias("side"))


@q(_SIDE)
def udf_sql(spark, d):
    spark.udf.register("balance_side", lambda b: "debt" if b < 0 else "credit", "string")
    load(spark, d, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, balance_side(c_acctbal) AS side FROM customer")


@q("SELECT 0::BIGINT AS mismatches, count(*) AS n FROM customer")
def udf_native_parity(spark, d):
    side = F.udf(lambda b: "debt" if b < 0 else "credit", "string")
    return D.parity(load(spark, d, "customer"), "c_custkey", side("c_acctbal"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit")).select("mismatches", "n")
