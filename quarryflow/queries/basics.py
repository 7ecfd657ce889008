"""Sources, projection, filters, joins, aggregates, subqueries (sections 2.1 to 2.5)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import reshape as R
from ..sources import io
from .base import Section, load

q = Section()
QUERIES, ORACLES = q.queries, q.oracles


@q("""SELECT c_mktsegment, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS flag,
count(*) AS n_lines, round(avg(l_extendedprice), 2) AS avg_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2""")
def priority_flags(spark, d):
    lines = load(spark, d, "lineitem").where(F.col("l_shipdate") >= "1995-01-01")
    x = lines.join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = F.col("o_orderpriority")
    flag = X.band([(p == "1-URGENT", "CRITICAL"), (p == "2-HIGH", "HIGH"), (p == "3-MEDIUM", "MEDIUM")], "LOW")
    return x.groupBy("c_mktsegment", flag.alias("flag")).agg(F.count("*").alias("n_lines"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"))


# --- 2.1 sources and sinks
@q("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def read_parquet(spark, d):
    return io.read_table(spark, f"{d}/orders.parquet").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderdate::DATE AS o_orderdate FROM orders")
def read_csv_typed(spark, d):
    from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

    path = io.scratch(spark, "csv")
    messy = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate"))
    io.write_table(messy, path, fmt="csv", header=True)
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()), StructField("o_totalprice", DoubleType()), StructField("o_orderdate", DateType())])
    return io.read_csv_typed(spark, path, schema, date_cols={"o_orderdate": "dd/MM/yyyy"})


@q("SELECT event_id, user_id, event_type, value FROM events")
def read_json_lines(spark, d):
    path = io.scratch(spark, "json")
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    io.write_table(rows, path, fmt="json")
    return io.read_table(spark, path, fmt="json", schema=rows.schema)


@q("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1")
def chunked_aggregate(spark, d):
    return io.read_table(spark, f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@q("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier")
def write_modes(spark, d):
    path, rows = io.scratch(spark, "modes"), load(spark, d, "supplier").select("s_suppkey", "s_name")
    for mode in ("error", "overwrite", "append", "ignore"):
        io.write_table(rows, path, mode=mode)
    return io.read_table(spark, path)


@q("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def write_partitioned(spark, d):
    path = io.scratch(spark, "parts")
    io.write_table(load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return io.read_table(spark, path).where("o_orderstatus = 'F'")


@q("SELECT count(*) AS n, true AS at_most_two_files FROM part")
def write_coalesced(spark, d):
    path = io.scratch(spark, "files")
    io.write_table(load(spark, d, "part").repartition(6), path, files=2)
    return io.read_table(spark, path).withColumn("file", F.input_file_name()).agg(F.count("*").alias("n"), (F.countDistinct("file") <= 2).alias("at_most_two_files"))


def _database(spark) -> str:
    """JDBC address of the database: the setting quarryflow.jdbc.url, or one in this process's memory, with the driver that Spark brings along."""
    url = spark.conf.get("quarryflow.jdbc.url", None)
    if url is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors in other processes
        raise RuntimeError("quarryflow.jdbc.url must name a database that all executors reach")
    return url or "jdbc:derby:memory:quarryflow;create=true"


_CUSTOMERS = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"


def _fresh(name: str) -> str:
    """A table name that no other run uses."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


def _customers(spark, d, table):
    rows = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    io.write_jdbc(rows, _database(spark), table, "overwrite")
    return rows


@q(_CUSTOMERS)
def read_jdbc(spark, d):
    table = _fresh("plain_customer")
    _customers(spark, d, table)
    return io.read_jdbc(spark, _database(spark), table)


@q(_CUSTOMERS)
def read_jdbc_partitioned(spark, d):
    table = _fresh("split_customer")
    ends = _customers(spark, d, table).agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high")).first()
    return io.read_jdbc(spark, _database(spark), table, "c_custkey", ends.low, ends.high, 4)


@q("SELECT s_suppkey, s_acctbal FROM supplier")
def write_jdbc_batch(spark, d):
    rows = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    table = _fresh("batch_supplier")
    write = io.foreach_batch_jdbc(_database(spark), table)
    for number in (0, 1, 1, 0):  # batches that come again change nothing
        write(rows.where(F.pmod("s_suppkey", F.lit(2)) == number), number)
    return io.read_jdbc(spark, _database(spark), table)


@q("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def write_csv_json(spark, d):
    one, two = io.scratch(spark, "csv"), io.scratch(spark, "json")
    rows = load(spark, d, "nation")
    io.write_table(rows, one, fmt="csv", header=True)
    io.write_table(io.read_table(spark, one, fmt="csv", schema=rows.schema, header=True), two, fmt="json")
    return io.read_table(spark, two, fmt="json", schema=rows.schema)


@q("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def multi_table_land(spark, d):
    names = ["customer", "part", "supplier"]
    paths = io.land_tables({n: load(spark, d, n) for n in names}, io.scratch(spark, "land"))
    out = None
    for n, p in zip(names, paths):
        x = io.read_table(spark, p).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
        out = x if out is None else out.unionByName(x)
    return out


# --- 2.2 projection and filters
q.sql("project_alias", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")


@q("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def derived_columns(spark, d):
    return X.with_columns(load(spark, d, "lineitem"), {"net": "l_extendedprice * (1 - l_discount)", "gross": "net * (1 + l_tax)"}).select("l_orderkey", "l_linenumber", "net", "gross")


@q("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity BETWEEN 10 AND 20 OR l_returnflag IN ('R', 'A')) AND NOT l_discount > 0.05")
def filter_compound(spark, d):
    return load(spark, d, "lineitem").where((F.col("l_quantity").between(10, 20) | F.col("l_returnflag").isin("R", "A")) & ~(F.col("l_discount") > 0.05)).select("l_orderkey", "l_linenumber")


q.sql("filter_text", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type ILIKE '%s%' AND p_brand LIKE 'Brand%'")


@q("SELECT event_id FROM events WHERE (CASE WHEN event_type = 'error' THEN NULL ELSE value END) IS NULL")
def filter_null(spark, d):
    return load(spark, d, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))).where(F.col("v").isNull()).select("event_id")


@q("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def filter_query_string(spark, d):
    return load(spark, d, "orders").where("o_orderstatus = 'O' and o_totalprice > 100000").select("o_orderkey")


q.sql("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


@q("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS band FROM customer")
def case_searched(spark, d):
    b = F.col("c_acctbal")
    return load(spark, d, "customer").select("c_custkey", X.band([(b < 0, "debt"), (b < 5000, "normal")], "rich").alias("band"))


q.sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS status FROM orders")


@q("SELECT event_id, CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' END AS code FROM events")
def value_map(spark, d):
    return load(spark, d, "events").select("event_id", X.value_map("event_type", {"view": "V", "click": "C"}).alias("code"))


@q("SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' ELSE event_type END AS event_type FROM events")
def value_replace(spark, d):
    return load(spark, d, "events").select("event_id", "event_type").replace({"view": "seen"}, subset=["event_type"])


@q("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END AS qty FROM lineitem")
def where_mask(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0).alias("qty"))


@q("SELECT o_orderkey, o_totalprice FROM orders WHERE substr(md5('7:' || o_orderkey), 1, 8) < '1999999a'")
def sample_rows(spark, d):
    return R.hash_sample(load(spark, d, "orders"), ["o_orderkey"], 0.1, seed=7).select("o_orderkey", "o_totalprice")


# --- 2.3 joins
q.sql("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
q.sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
q.sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")


@q("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') a
FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def join_full_outer(spark, d):
    o = load(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    return J.reconcile(o.where("o_orderstatus = 'P'"), o.where("o_orderpriority = '1-URGENT'"), "k")


@q("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 300000")
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@q("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


q.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q.sql("join_self", "SELECT a.o_orderkey AS one, b.o_orderkey AS two FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")


@q("SELECT o_orderkey FROM orders, (SELECT 2 * avg(o_totalprice) AS t FROM orders) WHERE o_totalprice > t")
def join_nonequi(spark, d):
    o = load(spark, d, "orders")
    return o.join(F.broadcast(o.agg((2 * F.avg("o_totalprice")).alias("t"))), F.col("o_totalprice") > F.col("t")).select("o_orderkey")  # one row


@q("""WITH s AS (SELECT o_orderkey, o_orderdate AS a, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_days((o_orderkey % 90)::INT) END AS b FROM orders),
m AS (SELECT unnest(generate_series(low, high, INTERVAL 1 MONTH)) AS p FROM (SELECT date_trunc('month', min(o_orderdate))::TIMESTAMP AS low, max(o_orderdate)::TIMESTAMP AS high FROM orders)) SELECT p::DATE AS month, count(*) AS active
FROM s JOIN m ON a <= last_day(p) AND (b IS NULL OR b > p) GROUP BY 1""")
def join_interval_overlap(spark, d):
    s = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("a"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval(F.pmod("o_orderkey", F.lit(90)).cast("int"))).alias("b"))
    m = X.calendar_of(load(spark, d, "orders"), "o_orderdate", "1 month").select(F.col("d").alias("month"), F.last_day("d").alias("to"))
    return J.active_counts(s, m, "a", "b", "month", "to")


@q("""WITH v AS (SELECT o_custkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS t, o_orderkey FROM (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)),
e AS (SELECT event_id, user_id, TIMESTAMP '1995-01-01' + to_days((event_id % 1000)::INT) AS seen FROM events) SELECT event_id, o_orderkey FROM e LEFT JOIN v ON user_id = o_custkey AND seen >= f AND (t IS NULL OR seen < t)""")
def join_asof_scd2(spark, d):
    from pyspark.sql import Window

    v = load(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").alias("f")).agg(F.min("o_orderkey").alias("o_orderkey"))
    v = v.withColumn("t", F.lead("f").over(Window.partitionBy("o_custkey").orderBy("f"))).withColumnRenamed("o_custkey", "user_id")
    e = load(spark, d, "events").select("event_id", "user_id", (F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval(F.pmod("event_id", F.lit(1000)).cast("int"))).alias("at"))
    return J.asof_join(e, v, "user_id", "at", "f", "t").select("event_id", "o_orderkey")


@q("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_broadcast(spark, d):
    # nations are a fixed list
    return load(spark, d, "customer").join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@q("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return J.salted_join(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k")), s, "k", 8).drop("k")


@q("SELECT event_id, name FROM events JOIN (SELECT DISTINCT event_type, upper(event_type) AS name FROM events WHERE event_type <> 'view') USING (event_type)")
def join_salted_hot_keys(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type")
    names = e.where("event_type <> 'view'").select("event_type", F.upper("event_type").alias("name")).distinct()
    return J.salted_join(e, names, "event_type", 8).select("event_id", "name")


@q("SELECT c_custkey AS id, c_nationkey AS nation_x, c_name AS name, s_nationkey AS nation_y FROM customer JOIN supplier ON c_custkey = s_suppkey")
def join_renamed_keys(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("nation"))
    return J.join_on(c, s, {"id": "supp"})


@q("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k""")
def join_indicator(spark, d):
    return J.join_with_indicator(load(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct(), load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@q("""WITH a AS (SELECT c_custkey AS k, count(*) AS l FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS r FROM orders GROUP BY 1), j AS (SELECT coalesce(l, 0) AS l, r, coalesce(r, 0) AS r0 FROM a FULL JOIN b ON a.k = b.k)
SELECT sum(l)::BIGINT AS left_rows, sum(l * r0)::BIGINT AS inner_rows, sum(l * greatest(r0, 1))::BIGINT AS left_join_rows, count(*) FILTER (WHERE r > 1) AS duplicate_right_keys FROM j""")
def fanout_check(spark, d):
    return J.fanout_report(load(spark, d, "customer").withColumnRenamed("c_custkey", "k"), load(spark, d, "orders").withColumnRenamed("o_custkey", "k"), ["k"])


# --- 2.4 aggregates
q.sql("agg_global", "SELECT count(*) AS n, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, count(DISTINCT o_custkey) AS customers FROM orders")
q.sql("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus")
q.sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")


@q("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 END), 0)::INT AS bought FROM events GROUP BY 1")
def agg_conditional(spark, d):
    e = load(spark, d, "events").withColumn("one", F.lit(1))
    return e.groupBy("user_id").agg(X.count_if(F.col("event_type") == "error").alias("errors"), X.sum_if(F.col("event_type") == "purchase", "one").cast("int").alias("bought"))


@q("SELECT event_type, round(100.0 * count(*) FILTER (WHERE value > 50) / nullif(count(*), 0), 2) AS pct FROM events GROUP BY 1")
def agg_rate_pct(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(X.rate_pct(X.count_if(F.col("value") > 50), F.count("*")).alias("pct"))


q.sql("agg_distinct", "SELECT l_shipdate, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_shipdate")


@q("SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def distinct_rollup(spark, d):
    """Months kept as bitmaps, a late part merged in, then rolled up to years without the orders."""
    o = load(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), "o_custkey", "o_orderkey")
    early, late = (A.distinct_state(o.where(F.pmod("o_orderkey", F.lit(3)) == 0 if one else F.pmod("o_orderkey", F.lit(3)) != 0), ["month"], "o_custkey") for one in (True, False))
    path = io.scratch(spark, "distinct")
    io.write_table(A.merge_distinct(early, late, ["month"]), path)
    state = io.read_table(spark, path).withColumn("year", F.year("month"))
    return A.distinct_counts(state, ["year"], "customers")


q.sql("agg_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
q.sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
q.sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
@q("SELECT c_mktsegment, percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal) AS median_balance FROM customer GROUP BY c_mktsegment")
def agg_median(spark, d):
    return A.medians(load(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "median_balance")


@q("""SELECT 'l_quantity' AS column_name, count(l_quantity)::DOUBLE AS count, avg(l_quantity) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity)::DOUBLE AS min, max(l_quantity)::DOUBLE AS max, quantile_cont(l_quantity, 0.25) AS q25,
quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75 FROM lineitem""")
def agg_describe(spark, d):
    return A.profile(load(spark, d, "lineitem"), ["l_quantity"]).withColumn("std", F.round("std", 6))


@q("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 2) AS pct FROM events GROUP BY 1")
def agg_value_counts(spark, d):
    return A.value_counts(load(spark, d, "events"), "event_type")


@q("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def agg_group_filter(spark, d):
    return A.filter_groups(load(spark, d, "orders"), ["o_custkey"], F.count("*"), lambda n: n >= 12).select("o_orderkey")


@q("SELECT o_orderkey, round(100 * o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS pct FROM orders")
def agg_group_transform(spark, d):
    x = A.group_transform(load(spark, d, "orders"), ["o_custkey"], F.sum("o_totalprice"), "total")
    return x.select("o_orderkey", F.round(100 * F.col("o_totalprice") / F.col("total"), 4).alias("pct"))


@q("WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN s > (SELECT avg(s) FROM t) THEN 'above' ELSE 'below' END AS side FROM t")
def agg_two_level(spark, d):
    t = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    x = t.crossJoin(F.broadcast(t.agg(F.avg("s").alias("a"))))  # one row
    return x.select("o_custkey", F.when(F.col("s") > F.col("a"), "above").otherwise("below").alias("side"))


# --- 2.5 subqueries
q.sql("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
q.sql("subq_correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
q.sql("subq_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
q.sql("subq_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) x)")


@q("WITH t AS (SELECT n_name, sum(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_name FROM t WHERE s > ((SELECT sum(s) FROM t) - s) / ((SELECT count(*) FROM t) - 1)")
def leave_one_out_avg(spark, d):
    t = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("c_acctbal").alias("s"))
    return A.leave_one_out(t, "s").where("s > others_avg").select("n_name")


@q("SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def latest_per_group_max(spark, d):
    return A.latest_per_group(load(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus"])


q.sql("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT c_mktsegment, a.s FROM a JOIN customer ON c_custkey = a.o_custkey) SELECT c_mktsegment, round(max(s), 2) AS top FROM b GROUP BY c_mktsegment")


@q("SELECT d::DATE AS d, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(low, high, INTERVAL 1 DAY)) AS d FROM (SELECT date_trunc('day', min(o_orderdate))::TIMESTAMP AS low, max(o_orderdate)::TIMESTAMP AS high FROM orders)) LEFT JOIN orders ON o_orderdate = d GROUP BY 1")
def cte_recursive_dates(spark, d):
    days = X.calendar_of(load(spark, d, "orders"), "o_orderdate")
    return days.join(load(spark, d, "orders"), F.col("o_orderdate") == F.col("d").cast("timestamp"), "left").groupBy("d").agg(F.count("o_orderkey").alias("n"))


def _tree(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"))


_TREE = "t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer)"


@q(f"WITH RECURSIVE {_TREE}, w AS (SELECT id AS root, id AS node, 0 AS depth FROM t UNION ALL SELECT root, t.parent, depth + 1 FROM w JOIN t ON t.id = w.node WHERE t.parent IS NOT NULL) SELECT root, node, depth FROM w")
def hierarchy_up(spark, d):
    return R.ancestors(_tree(spark, d), "id", "parent")


@q(f"WITH RECURSIVE {_TREE}, w AS (SELECT id AS root, id AS node, 0::BIGINT AS depth FROM t WHERE parent IS NULL UNION ALL SELECT root, t.id, depth + 1 FROM w JOIN t ON t.parent = w.node) SELECT root, node, depth FROM w")
def hierarchy_down(spark, d):
    return R.tree_roots(_tree(spark, d), "id", "parent").select("root", "node", "depth")


@q(f"WITH RECURSIVE {_TREE}, w AS (SELECT id AS root, id AS node, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT root, t.id, depth + 1 FROM w JOIN t ON t.parent = w.node WHERE depth < 3) SELECT root, node, depth FROM w")
def hierarchy_bounded(spark, d):
    t = _tree(spark, d)
    return R.walk_hierarchy(spark, t, "id", "parent", t.where("parent is null"), "down", 3)
