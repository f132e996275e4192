"""Joins and top-k reports over branches, customers, accounts and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, branches, customers, dealt, level, load, parts_for, total, transactions


@query(SQL + "SELECT branch, count(*) AS n FROM acct JOIN cust USING (customer_id) JOIN branch USING (branch_id) GROUP BY branch, branch_id ORDER BY n DESC, branch LIMIT 10")
def top_branches_by_accounts(spark: SparkSession, d: str) -> DataFrame:
    """The ten branches with most accounts; ties by name. Counts by branch id before the name is joined."""
    n = accounts(spark, d).join(customers(spark, d), "customer_id").groupBy("branch_id").agg(F.count("*").alias("n"))
    return n.join(branches(spark, d), "branch_id").select("branch", "n").orderBy(F.desc("n"), "branch").limit(10)


@query(SQL + "SELECT branch, count(*) AS n FROM acct JOIN cust USING (customer_id) JOIN branch USING (branch_id) WHERE level = 'high' GROUP BY branch ORDER BY n DESC, branch LIMIT 10")
def top_high_risk_branches(spark: SparkSession, d: str) -> DataFrame:
    high = customers(spark, d).filter(level(F.col("score")) == "high").select("customer_id", "branch_id")
    n = accounts(spark, d).join(high, "customer_id").groupBy("branch_id").agg(F.count("*").alias("n"))
    return n.join(branches(spark, d), "branch_id").select("branch", "n").orderBy(F.desc("n"), "branch").limit(10)


@query(SQL + "SELECT branch, count(c.customer_id) AS n FROM branch LEFT JOIN (SELECT * FROM cust WHERE score < 0) c USING (branch_id) GROUP BY branch")
def txn_by_branch_left(spark: SparkSession, d: str) -> DataFrame:
    """Overdrawn customers by branch; branches without any have 0."""
    low = customers(spark, d).filter("score < 0").groupBy("branch_id").agg(F.count("*").alias("n"))
    return branches(spark, d).join(low, "branch_id", "left").select("branch", F.coalesce("n", F.lit(0)).alias("n"))


@query(SQL + ", s AS (SELECT date_created, p_brand FROM txn LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON part_id = p_partkey) SELECT coalesce(p_brand, 'Unknown') AS currency, count(*) AS n FROM s GROUP BY 1")
def txn_by_currency_coalesce(spark: SparkSession, d: str) -> DataFrame:
    dim = load(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("part_id"), "p_brand")
    return transactions(spark, d).join(dim, "part_id", "left").groupBy(F.coalesce("p_brand", F.lit("Unknown")).alias("currency")).agg(F.count("*").alias("n"))


@query(SQL + "SELECT branch, p_brand AS product, s_name AS supplier, CAST(sum(amount) AS DOUBLE) AS amount FROM txn JOIN acct USING (account_id) JOIN cust USING (customer_id) JOIN branch USING (branch_id) JOIN part ON part_id = p_partkey JOIN supplier ON channel_id = s_suppkey GROUP BY 1, 2, 3 ORDER BY amount DESC, branch, product, supplier LIMIT 10")
def top_products_5way(spark: SparkSession, d: str) -> DataFrame:
    """A star join over five dimensions. Lines meet accounts, parts and suppliers dealt to tasks of a bounded number of rows; they are summed where their supplier's other lines are, as few
    lines share branch, part and channel."""
    parts, few = parts_for(load(spark, d, "lineitem")), parts_for(load(spark, d, "orders"))
    a = dealt(accounts(spark, d).select("account_id", "customer_id"), few, "customer_id").join(customers(spark, d).select("customer_id", "branch_id"), "customer_id").select("account_id", "branch_id")
    part = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("product"))
    lines = dealt(transactions(spark, d).select("account_id", "part_id", "channel_id", "amount"), parts, "account_id").join(a, "account_id").select("branch_id", "part_id", "channel_id", "amount")
    sold = dealt(dealt(lines, parts, "part_id").join(part, "part_id").select("branch_id", "product", "channel_id", "amount"), parts, "channel_id")
    sums = sold.groupBy("branch_id", "product", "channel_id").agg(F.sum("amount").alias("amount"))
    named = sums.join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"), F.col("s_name").alias("supplier")), "channel_id").join(F.broadcast(branches(spark, d)), "branch_id")
    return dealt(named, parts, "branch", "product", "supplier").groupBy("branch", "product", "supplier").agg(F.sum("amount").cast("double").alias("amount")).orderBy(F.desc("amount"), "branch", "product", "supplier").limit(10)


@query(SQL + "SELECT count(*) AS n, CAST(sum(score) AS DOUBLE) AS score FROM cust WHERE NOT EXISTS (SELECT 1 FROM acct WHERE acct.customer_id = cust.customer_id)")
def never_screened_antijoin(spark: SparkSession, d: str) -> DataFrame:
    idle = customers(spark, d).join(accounts(spark, d).select("customer_id"), "customer_id", "left_anti")
    return idle.agg(F.count("*").alias("n"), total("score").alias("score"))


@query("SELECT p_partkey AS part_id, p_brand AS brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_partkey IS NOT NULL)")
def dead_stock_not_in(spark: SparkSession, d: str) -> DataFrame:
    """Parts without a movement this year; null keys on the moved side are left out, for NOT IN would then hold for none."""
    moved = load(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz '2001-01-01'").select(F.col("l_partkey").alias("p_partkey")).filter("p_partkey is not null")
    return load(spark, d, "part").join(moved, "p_partkey", "left_anti").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"))


@query(SQL + "SELECT sector, count(*) AS n FROM cust WHERE customer_id IN (SELECT customer_id FROM acct WHERE balance > 200000) GROUP BY sector")
def semi_in(spark: SparkSession, d: str) -> DataFrame:
    rich = accounts(spark, d).filter("balance > 200000").select("customer_id")
    return customers(spark, d).join(rich, "customer_id", "left_semi").groupBy("sector").agg(F.count("*").alias("n"))


@query(SQL + ", e AS (SELECT DISTINCT event_type AS channel FROM events) SELECT customer_id, channel FROM cust CROSS JOIN e WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = customer_id AND event_type = channel)")
def channel_matrix_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers' missing channels: those of all that a customer's own set lacks. The set of all channels is one row, told to all tasks."""
    events = load(spark, d, "events")
    every = events.agg(F.collect_set("event_type").alias("all"))
    have = events.groupBy(F.col("user_id").alias("customer_id")).agg(F.collect_set("event_type").alias("own"))
    both = customers(spark, d).select("customer_id").join(have, "customer_id", "left").join(F.broadcast(every), how="cross")
    return both.select("customer_id", F.explode(F.array_except("all", F.coalesce("own", F.array().cast("array<string>")))).alias("channel"))


@query("SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase, max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events GROUP BY user_id")
def channel_pivot(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("value"))


@query(SQL + ", a AS (SELECT branch_id, count(*) AS n FROM cust WHERE level = 'high' GROUP BY 1), b AS (SELECT s_nationkey AS branch_id, sum(s_suppkey % 30)::BIGINT AS m FROM supplier GROUP BY 1) SELECT branch_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(n, 0) * coalesce(n, 0) * coalesce(m, 0) AS factor FROM a FULL JOIN b USING (branch_id)")
def full_outer_factor(spark: SparkSession, d: str) -> DataFrame:
    """The square of a branch's cases times its days, with branches of either side."""
    a = customers(spark, d).filter(level(F.col("score")) == "high").groupBy("branch_id").agg(F.count("*").alias("n"))
    b = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("branch_id")).agg(F.sum(F.col("s_suppkey") % 30).alias("m"))
    n, m = (F.coalesce(c, F.lit(0)) for c in ("n", "m"))
    return a.join(b, "branch_id", "full").select("branch_id", n.alias("n"), m.alias("m"), (n * n * m).alias("factor"))


@query("SELECT c_custkey AS customer_id, min(n_name) AS branch FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey GROUP BY 1")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """A lookup gives one value a key, the smallest, and null on a miss."""
    table = branches(spark, d).filter("region_id < 3").groupBy("branch_id").agg(F.min("branch").alias("branch"))
    return customers(spark, d).join(table, "branch_id", "left").select("customer_id", "branch")


@query("""
WITH raw AS (SELECT c_custkey AS row_id, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN CAST(n_nationkey AS VARCHAR) WHEN 2 THEN lower(n_name) ELSE 'nowhere' END AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT row_id, coalesce((SELECT n_nationkey FROM nation WHERE n_name = ref), (SELECT n_nationkey FROM nation WHERE CAST(n_nationkey AS VARCHAR) = ref), (SELECT n_nationkey FROM nation WHERE upper(n_name) = upper(ref))) AS branch_id FROM raw""")
def relation_cascade(spark: SparkSession, d: str) -> DataFrame:
    """References resolve by exact name, then by id, then by name in any case; else null, an error of the row."""
    own = branches(spark, d)
    raw = customers(spark, d).join(own, "branch_id")
    ref = F.when(F.col("customer_id") % 4 == 0, F.col("branch")).when(F.col("customer_id") % 4 == 1, F.col("branch_id").cast("string")).when(F.col("customer_id") % 4 == 2, F.lower("branch")).otherwise("nowhere")
    raw = raw.select(F.col("customer_id").alias("row_id"), ref.alias("ref"))
    keys = {"by_name": F.col("branch"), "by_id": F.col("branch_id").cast("string"), "by_case": F.upper("branch")}
    for name, key in keys.items():
        table = own.groupBy(key.alias("key")).agg(F.min("branch_id").alias(name))
        raw = raw.join(table, (F.upper("ref") if name == "by_case" else F.col("ref")) == F.col("key"), "left").drop("key")
    return raw.select("row_id", F.coalesce(*keys).alias("branch_id"))


@query(SQL + "SELECT a.account_id, CASE WHEN a.product IS NULL THEN 'none' ELSE a.product END AS product, b.branch FROM acct a LEFT JOIN cust c USING (customer_id) LEFT JOIN branch b ON b.branch_id = c.branch_id WHERE a.balance > 300000")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with their branch's name filled in through the customer."""
    big = accounts(spark, d).filter("balance > 300000")
    return big.join(customers(spark, d).select("customer_id", "branch_id"), "customer_id", "left").join(branches(spark, d), "branch_id", "left").select("account_id", F.coalesce("product", F.lit("none")).alias("product"), "branch")


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_field_group(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, a, b, CAST(unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(date_trunc('month', b) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM s)
SELECT month, CAST(sum(datediff('day', greatest(month, a), least(CAST(month + INTERVAL 1 MONTH AS DATE), b))) AS BIGINT) AS days FROM m GROUP BY 1""")
def interval_days_month(spark: SparkSession, d: str) -> DataFrame:
    """Intervals exploded into calendar months, with their days in each."""
    s = transactions(spark, d).groupBy("account_id").agg(F.min("date_created").alias("a"), F.max("date_created").alias("b"))
    m = s.withColumn("month", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))))
    days = F.datediff(F.least(F.add_months("month", 1), F.col("b")), F.greatest("month", "a"))
    return m.groupBy("month").agg(F.sum(days).cast("long").alias("days"))
