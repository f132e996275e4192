"""Risk scores by rule, matching, matrices, dashboards, calendars and filters of the compliance reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, EVENTS_AS_OF, SQL, accounts, branches, customers, load, total, transactions


@query(SQL + "SELECT date_created AS day, coalesce(p_brand, 'Unknown') AS currency, CAST(sum(amount) AS DOUBLE) AS total FROM txn LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = part_id GROUP BY 1, 2")
def txn_volume_day_currency(spark: SparkSession, d: str) -> DataFrame:
    """Amount per day and currency (here a part's brand), with a label for transactions without one."""
    known = load(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("part_id"), "p_brand")
    t = transactions(spark, d).select("date_created", "part_id", "amount").join(known, "part_id", "left")
    return t.groupBy(F.col("date_created").alias("day"), F.coalesce("p_brand", F.lit("Unknown")).alias("currency")).agg(total("amount").alias("total"))


#: Rules of the fixtures: name, score, what holds for a customer's account.
RULES = (("large_balance", 8, "balance > 300000"), ("failed_state", 3, "state = 'F'"), ("urgent", 5, "product = '1-URGENT' AND balance > 150000"), ("never", 9, "balance < 0"))
_HITS_SQL = " UNION ALL ".join(f"SELECT customer_id, '{n}' AS rule, {s} AS score FROM cust c WHERE EXISTS (SELECT 1 FROM acct a WHERE a.customer_id = c.customer_id AND {w})" for n, s, w in RULES)


def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """(customer_id, rule, score) of the rules that hold for any account of a customer. One scan and one shuffle for all rules: each rule is a bool_or."""
    held = accounts(spark, d).groupBy("customer_id").agg(*(F.bool_or(F.expr(w)).alias(n) for n, _, w in RULES))
    each = F.array(*(F.when(F.col(n), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("score"))) for n, s, _ in RULES))
    return held.select("customer_id", F.explode(F.array_compact(each)).alias("hit")).select("customer_id", "hit.*")


@query(SQL + _HITS_SQL)
def risk_rule_hits_exists(spark: SparkSession, d: str) -> DataFrame:
    """The hits of existing customers; EXISTS is a semi-join."""
    return rule_hits(spark, d).join(customers(spark, d).select("customer_id"), "customer_id", "left_semi")


def _combined(spark: SparkSession, d: str, how: Column) -> DataFrame:
    scored = rule_hits(spark, d).groupBy("customer_id").agg(how.alias("score"))
    return customers(spark, d).select("customer_id").join(scored, "customer_id", "left").select("customer_id", F.coalesce("score", F.lit(0)).cast("double").alias("score"))


def _combined_sql(how: str) -> str:
    return SQL + f", hits AS ({_HITS_SQL}) SELECT customer_id, CAST(coalesce({how}, 0) AS DOUBLE) AS score FROM cust LEFT JOIN hits USING (customer_id) GROUP BY 1"


@query(_combined_sql("max(hits.score)"))
def risk_score_max(spark: SparkSession, d: str) -> DataFrame:
    """The highest score of a customer's hits; no hit is 0."""
    return _combined(spark, d, F.max("score"))


@query(_combined_sql("round(CAST(sum(hits.score) FILTER (WHERE hits.score > 0) AS DOUBLE) / nullif(count(hits.score) FILTER (WHERE hits.score > 0), 0), 4)"))
def risk_score_avg(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the scores above 0."""
    positive = F.when(F.col("score") > 0, F.col("score"))
    return _combined(spark, d, F.round(F.try_divide(F.sum(positive).cast("double"), F.count(positive)), 4))


@query(_combined_sql("sum(hits.score) FILTER (WHERE hits.score > 0)"))
def risk_score_sum(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d, F.sum(F.when(F.col("score") > 0, F.col("score"))))


@query("SELECT c_custkey AS customer_id, CASE WHEN c_acctbal IS NULL OR c_acctbal <= 3000 THEN 'low' WHEN c_acctbal <= 6000 THEN 'medium' ELSE 'high' END AS band FROM customer")
def risk_band(spark: SparkSession, d: str) -> DataFrame:
    """Bands with upper limits included; no score is low."""
    s = F.col("score")
    return customers(spark, d).select("customer_id", F.when(s.isNull() | (s <= 3000), "low").when(s <= 6000, "medium").otherwise("high").alias("band"))


@query("SELECT c_custkey AS customer_id, CASE WHEN c_acctbal <= 3000 THEN 'low' WHEN c_acctbal <= 6000 THEN 'medium' WHEN c_acctbal <= 9000 THEN 'high' ELSE 'low' END AS band FROM customer")
def risk_band_bulk(spark: SparkSession, d: str) -> DataFrame:
    """The bulk variant: scores above its last limit fall back to low."""
    s = F.col("score")
    return customers(spark, d).select("customer_id", F.when(s <= 3000, "low").when(s <= 6000, "medium").when(s <= 9000, "high").otherwise("low").alias("band"))


_LIST_SQL = ", listed AS (SELECT customer_id AS list_id, CASE WHEN customer_id % 2 = 0 THEN upper(name) ELSE '  ' || name || ' ' END AS entry, ' ' || CAST(customer_id AS VARCHAR) || ' ' AS number FROM cust WHERE score > 9000) "


def watchlist(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for a watch list: the customers of the largest balances, with noise of case and space in name and number."""
    c = customers(spark, d).filter("score > 9000")
    name = F.when(F.col("customer_id") % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit("  "), "name", F.lit(" ")))
    return c.select(F.col("customer_id").alias("list_id"), name.alias("entry"), F.concat(F.lit(" "), F.col("customer_id").cast("string"), F.lit(" ")).alias("number"))


@query(SQL + _LIST_SQL + "SELECT customer_id, list_id FROM cust JOIN listed ON lower(trim(name)) = lower(trim(entry))")
def screen_name_exact(spark: SparkSession, d: str) -> DataFrame:
    """Customers on the list by normalised name: an equi-join on computed keys."""
    key = lambda c: F.lower(F.trim(c))
    listed = watchlist(spark, d).select("list_id", key("entry").alias("key"))
    return customers(spark, d).select("customer_id", key("name").alias("key")).join(listed, "key").select("customer_id", "list_id")


@query(SQL + _LIST_SQL + "SELECT customer_id, list_id, CAST(customer_id AS VARCHAR) = number AS exact FROM cust JOIN listed ON CAST(customer_id AS VARCHAR) = trim(number)")
def screen_bvn_trim(spark: SparkSession, d: str) -> DataFrame:
    """Bank numbers equal after trimming, and whether they were equal as they stood."""
    own = customers(spark, d).select("customer_id", F.col("customer_id").cast("string").alias("key"))
    hit = own.join(watchlist(spark, d).select("list_id", "number", F.trim("number").alias("key")), "key")
    return hit.select("customer_id", "list_id", (F.col("key") == F.col("number")).alias("exact"))


@query(SQL + _LIST_SQL + "SELECT customer_id, NOT EXISTS (SELECT 1 FROM listed WHERE list_id = customer_id) AS stale FROM cust")
def stale_matches(spark: SparkSession, d: str) -> DataFrame:
    """Recorded matches (here of all customers), stale where the list's row has disappeared."""
    still = watchlist(spark, d).select(F.col("list_id").alias("customer_id"), F.lit(True).alias("on"))
    return customers(spark, d).join(still, "customer_id", "left").select("customer_id", F.col("on").isNull().alias("stale"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 50) DESC, ts DESC, event_id) AS i FROM events) WHERE i = 1")
def dedupe_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's events of a type one stays: a large value first, then the latest. An aggregate of structs, so copies fold before the shuffle."""
    rank = F.struct((F.col("value") > 50).cast("int").alias("large"), F.col("ts"), (-F.col("event_id")).alias("low"), "event_id", "value")
    best = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(rank).alias("b"))
    return best.select("user_id", "event_type", "b.event_id", "b.value")


@query("""
WITH jobs AS (SELECT event_id, user_id, event_type AS state, '["' || (event_id + 1) || '","' || (event_id + 7) || '"]' AS children FROM events),
links AS (SELECT event_id AS parent, CAST(json_extract_string(x, '$') AS BIGINT) AS child FROM jobs, unnest(CAST(children::JSON AS JSON[])) AS u(x))
SELECT parent, count(*) AS n_children, bool_and(e.event_type = 'view') AS all_view FROM links JOIN events e ON e.event_id = child GROUP BY 1""")
def json_array_lateral(spark: SparkSession, d: str) -> DataFrame:
    """Jobs and the children named in their JSON array, exploded and joined; whether all children are in one state."""
    e = load(spark, d, "events").select("event_id", "event_type")
    children = F.concat(F.lit('["'), F.col("event_id") + 1, F.lit('","'), F.col("event_id") + 7, F.lit('"]'))
    jobs = e.select(F.col("event_id").alias("parent"), children.alias("children"))
    links = jobs.select("parent", F.explode(F.from_json("children", "array<string>")).alias("child")).select("parent", F.col("child").cast("long").alias("event_id"))
    return links.join(e, "event_id").groupBy("parent").agg(F.count("*").alias("n_children"), F.bool_and(F.col("event_type") == "view").alias("all_view"))


@query(SQL + ", span AS (SELECT account_id, min(date_created) AS a, max(date_created) AS b FROM txn GROUP BY 1) SELECT account_id, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS month FROM span")
def month_explode(spark: SparkSession, d: str) -> DataFrame:
    """One row for each month that an account's interval of transactions touches."""
    span = transactions(spark, d).groupBy("account_id").agg(F.min("date_created").alias("a"), F.max("date_created").alias("b"))
    return span.select("account_id", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("month"))


@query(f"""
WITH run AS (SELECT event_type, user_id % 7 AS source, CAST(value AS DECIMAL(18,2)) AS value, event_type <> 'error' AND value < 90 AS ok FROM events WHERE ts >= DATE '{EVENTS_AS_OF}' - INTERVAL 30 DAY)
SELECT source, count(event_type) AS runs, coalesce(round(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) * 100 / nullif(count(event_type), 0), 4), 0) AS success_rate,
  round(CAST(sum(value) AS DOUBLE) / count(value), 4) AS avg_minutes, CAST(coalesce(sum(value), 0) AS DOUBLE) AS minutes
FROM (SELECT range AS source FROM range(8)) LEFT JOIN run USING (source) GROUP BY 1""")
def etl_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Runs, success rate and minutes of the last 30 days per source; sources without runs have zeros."""
    e = load(spark, d, "events").filter(F.col("ts") >= F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), 30))
    ok = (F.col("event_type") != "error") & (F.col("value") < 90)
    minutes = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    stats = e.groupBy((F.col("user_id") % 7).alias("source")).agg(F.count("*").alias("runs"), F.round(F.count_if(ok).cast("double") * 100 / F.count("*"), 4).alias("success_rate"), F.round(minutes / F.count("*"), 4).alias("avg_minutes"), minutes.alias("minutes"))
    return spark.range(8).select(F.col("id").alias("source")).join(stats, "source", "left").na.fill(0, ["runs", "success_rate", "minutes"])


@query(SQL + "SELECT DISTINCT customer_id, upper(name) AS name FROM cust JOIN acct USING (customer_id) WHERE balance > 100000 ORDER BY 2")
def distinct_upper_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Customers with open items, once each, by upper-cased name. A semi-join needs no distinct."""
    rich = accounts(spark, d).filter("balance > 100000").select("customer_id")
    return customers(spark, d).join(rich, "customer_id", "left_semi").select("customer_id", F.upper("name").alias("name")).orderBy("name", "customer_id")


@query(SQL + "SELECT flag AS tax, CAST(sum(CASE WHEN kind = 'D' THEN amount ELSE -amount END) AS DOUBLE) AS balance, CAST(sum(CASE WHEN quantity > 10 THEN amount ELSE 0 END) AS DOUBLE) AS base FROM txn GROUP BY 1")
def tax_net(spark: SparkSession, d: str) -> DataFrame:
    """Debit less credit per tax, and the base that the tax was due on."""
    t = transactions(spark, d)
    return t.groupBy(F.col("flag").alias("tax")).agg(total(F.when(F.col("kind") == "D", F.col("amount")).otherwise(-F.col("amount"))).alias("balance"), total(F.when(F.col("quantity") > 10, F.col("amount")).otherwise(0)).alias("base"))


@query(SQL + "SELECT customer_id, CAST(sum(balance) FILTER (WHERE state = 'O') AS DOUBLE) AS receivable, CAST(sum(balance) FILTER (WHERE state = 'F') AS DOUBLE) AS payable FROM acct GROUP BY 1")
def residual_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Residual per partner, receivable beside payable; the pivot's values are stated, so no extra job looks for them."""
    a = accounts(spark, d).select("customer_id", "balance", F.when(F.col("state") == "O", "receivable").when(F.col("state") == "F", "payable").alias("type"))
    return a.groupBy("customer_id").pivot("type", ["receivable", "payable"]).agg(total("balance"))


@query(SQL + "SELECT CAST(date_trunc('month', date_created) AS DATE) AS month, coalesce(CAST(sum(amount) FILTER (WHERE kind = 'C') AS DOUBLE), 0) AS income, coalesce(CAST(sum(amount) FILTER (WHERE kind = 'D') AS DOUBLE), 0) AS expense FROM txn WHERE date_created >= DATE '2001-01-01' GROUP BY 1")
def income_expense_month(spark: SparkSession, d: str) -> DataFrame:
    """Income and expense of this year's months in one pass."""
    t = transactions(spark, d).filter(F.col("date_created") >= F.trunc(F.lit(AS_OF).cast("date"), "year"))
    side = lambda k: F.coalesce(total(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0.0))
    return t.groupBy(F.trunc("date_created", "month").alias("month")).agg(side("C").alias("income"), side("D").alias("expense"))


@query(SQL + f"""
, m AS (SELECT CAST(unnest(generate_series(DATE '2000-12-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS month),
j AS (SELECT CAST(date_trunc('month', opened) AS DATE) AS month, count(*) AS n FROM acct GROUP BY 1),
r AS (SELECT CAST(date_trunc('month', last) AS DATE) AS month, count(*) AS n FROM (SELECT account_id, max(date_created) AS last FROM txn GROUP BY 1) GROUP BY 1)
SELECT m.month, coalesce(j.n, 0) AS joined, coalesce(r.n, 0) AS resigned FROM m LEFT JOIN j USING (month) LEFT JOIN r USING (month)""")
def monthly_join_resign(spark: SparkSession, d: str) -> DataFrame:
    """Joins and leaves per month of the last twelve, with zeros where there were none."""
    first = F.add_months(F.trunc(F.lit(AS_OF).cast("date"), "month"), -11)
    months = spark.range(12).select(F.add_months(first, F.col("id").cast("int")).alias("month"))
    joined = accounts(spark, d).filter(F.col("opened") >= first).groupBy(F.trunc("opened", "month").alias("month")).agg(F.count("*").alias("joined"))
    last = transactions(spark, d).groupBy("account_id").agg(F.max("date_created").alias("last"))
    left = last.groupBy(F.trunc("last", "month").alias("month")).agg(F.count("*").alias("resigned"))
    return months.join(joined, "month", "left").join(left, "month", "left").na.fill(0)


@query(SQL + "SELECT account_id, CAST(sum(CASE WHEN flag = 'R' THEN -amount ELSE amount END) AS DOUBLE) AS net, sum(CASE WHEN flag = 'R' THEN -quantity ELSE quantity END) AS days FROM txn GROUP BY 1")
def signed_case_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums in which credit notes count with a turned sign."""
    signed = lambda c: F.when(F.col("flag") == "R", -F.col(c)).otherwise(F.col(c))
    return transactions(spark, d).groupBy("account_id").agg(total(signed("amount")).alias("net"), F.sum(signed("quantity")).alias("days"))


@query(SQL + "SELECT strftime(opened, '%B %Y') AS label, count(*) AS n, string_agg(DISTINCT product, chr(10) ORDER BY product) AS names FROM acct WHERE state = 'F' GROUP BY 1")
def names_joined(spark: SparkSession, d: str) -> DataFrame:
    """Finished accounts per month, and the distinct product names joined by newlines."""
    a = accounts(spark, d).filter("state = 'F'")
    return a.groupBy(F.date_format("opened", "MMMM yyyy").alias("label")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("product")), "\n").alias("names"))


@query("SELECT event_type AS level, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30' GROUP BY 1")
def log_level_hist(spark: SparkSession, d: str) -> DataFrame:
    """One day's log rows by level; the day is a range on ts, so the scan can skip."""
    day = (F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz"))
    return load(spark, d, "events").filter(day).groupBy(F.col("event_type").alias("level")).agg(F.count("*").alias("n"))


@query(SQL + "SELECT account_id, line FROM txn WHERE (kind = 'D' AND amount < -50000) OR (kind = 'C' AND amount > 50000)")
def ctr_threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    """Currency transaction report: debits below minus the limit, or credits above it."""
    return transactions(spark, d).filter("(kind = 'D' AND amount < -50000) OR (kind = 'C' AND amount > 50000)").select("account_id", "line")


@query(SQL + "SELECT account_id, length(CAST(account_id AS VARCHAR)) = 4 AS internal FROM acct WHERE length(CAST(account_id AS VARCHAR)) IN (4, 5)")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    """Accounts told apart by the length of their number."""
    n = F.length(F.col("account_id").cast("string"))
    return accounts(spark, d).filter(n.isin(4, 5)).select("account_id", (n == 4).alias("internal"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) <> CAST(o_orderdate AS DATE)")
def date_part_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Transactions whose date differs from the value date of their account."""
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("a"))
    return t.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("b")), "l_orderkey").filter("a <> b").select("l_orderkey", "l_linenumber")


def contains_any(columns: list[str], text: str) -> Column:
    """Any of the columns holds the text, whatever its case; % and _ in it are plain characters."""
    plain = "".join("\\" + c if c in "%_\\" else c for c in text)
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{plain}%"), F.lit(False)) for c in columns))


@query(SQL + "SELECT customer_id FROM cust JOIN branch USING (branch_id) WHERE name ILIKE '%00012%' OR sector ILIKE '%mach%' OR branch ILIKE '%land%'")
def name_search_ilike(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d).join(branches(spark, d), "branch_id")
    return c.filter(contains_any(["name"], "00012") | contains_any(["sector"], "mach") | contains_any(["branch"], "land")).select("customer_id")


def decay(days: Column) -> Column:
    """Weight of an item so many days old: 1, 0.8, 0.6 and 0.4 from limits of 30, 90 and 365 days."""
    return F.when(days <= 30, 1.0).when(days <= 90, 0.8).when(days <= 365, 0.6).otherwise(0.4)


@query(SQL + f"SELECT account_id, line, CASE WHEN DATE '{AS_OF}' - date_created <= 30 THEN 1.0 WHEN DATE '{AS_OF}' - date_created <= 90 THEN 0.8 WHEN DATE '{AS_OF}' - date_created <= 365 THEN 0.6 ELSE 0.4 END::DOUBLE * quantity AS score FROM txn")
def recency_decay_score(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).select("account_id", "line", (decay(F.datediff(F.lit(AS_OF).cast("date"), "date_created")) * F.col("quantity")).alias("score"))


@query(SQL + "SELECT account_id, strftime(opened, '%B %Y') AS label, strftime(opened, '%m') AS mm, strftime(opened, '%y') AS yy, dayofyear(opened)::INT AS doy FROM acct")
def month_label(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("opened")
    return accounts(spark, d).select("account_id", F.date_format(o, "MMMM yyyy").alias("label"), F.date_format(o, "MM").alias("mm"), F.date_format(o, "yy").alias("yy"), F.dayofyear(o).alias("doy"))


@query(SQL + f"SELECT account_id, days::INT AS days FROM (SELECT account_id, (dayofyear(opened) - dayofyear(DATE '{AS_OF}') + dayofyear(make_date(year(DATE '{AS_OF}'), 12, 31))) % dayofyear(make_date(year(DATE '{AS_OF}'), 12, 31)) AS days FROM acct) WHERE days BETWEEN 0 AND 15")
def doy_distance(spark: SparkSession, d: str) -> DataFrame:
    """Anniversaries in the next 15 days, across the end of the year, whatever its length."""
    today = F.lit(AS_OF).cast("date")
    days = F.pmod(F.dayofyear("opened") - F.dayofyear(today), F.dayofyear(F.make_date(F.year(today), F.lit(12), F.lit(31))))
    return accounts(spark, d).select("account_id", days.alias("days")).filter("days BETWEEN 0 AND 15")


_STEPS = ("minute", "hour", "day", "week", "month", "year")


@query("SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN ts + to_{u}s(CAST(1 + event_id % 3 AS INT))" for i, u in enumerate(_STEPS)) + " END AS next FROM events")
def next_check(spark: SparkSession, d: str) -> DataFrame:
    """The time of the next run, by each row's own unit and period; months clamp to their last day."""
    unit, n = F.col("event_id") % 6, "cast(1 + event_id % 3 as int)"
    at = reduce(lambda acc, i: acc.when(unit == i, F.expr(f"timestampadd({_STEPS[i]}, {n}, ts)")), range(1, 6), F.when(unit == 0, F.expr(f"timestampadd(minute, {n}, ts)")))
    return load(spark, d, "events").select("event_id", at.alias("next"))


@query("SELECT CAST(event_id % 3 AS INT) AS kind, CAST(to_timestamp(CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 - 900 * i) AT TIME ZONE 'UTC' AS TIMESTAMP) AS start, count(*) AS n FROM events, range(4) AS r(i) GROUP BY 1, 2")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Counts in windows of one hour that begin every 15 minutes."""
    e = load(spark, d, "events").select((F.col("event_id") % 3).cast("int").alias("kind"), "ts")
    return e.groupBy("kind", F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select("kind", F.col("w.start").alias("start"), "n")
