"""Account statistics, risk aggregates, calendars and accounting statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, EVENTS_AS_OF, SQL, accounts, branches, customers, level, load, total, transactions


def mean_sql(total: str, n: str) -> str:
    """SQL for a mean rounded half up to cents, of a total in cents and a count, in whole numbers."""
    return f"CAST(sign({total}) * ((2 * abs({total}) + {n}) // (2 * {n})) AS DOUBLE) / 100"


def mean(amount) -> F.Column:
    """The mean of money, rounded half up to cents; decimals keep it exact."""
    return F.round(F.try_divide(F.sum(amount), F.count(amount)), 2).cast("double")


def _stat_sql(kind: str, start: str, name: str) -> str:
    own = f"FILTER (WHERE kind = '{kind}' AND date_created >= {start})"
    cents = f"sum(CAST(amount * 100 AS BIGINT)) {own}"
    average = f"coalesce({mean_sql(cents, f'nullif(count(amount) {own}, 0)')}, 0) AS avg_{name}"
    return f"count(amount) {own} AS n_{name}, coalesce(CAST(sum(amount) {own} AS DOUBLE), 0) AS sum_{name}, coalesce(CAST(max(amount) {own} AS DOUBLE), 0) AS max_{name}, {average}"


STATS = [("C", 6, "c6"), ("C", 12, "c12"), ("D", 6, "d6"), ("D", 12, "d12")]


@query(SQL + "SELECT a.account_id, " + ", ".join(_stat_sql(k, f"DATE '{AS_OF}' - INTERVAL {m} MONTH", n) for k, m, n in STATS) + f" FROM acct a LEFT JOIN txn t ON t.account_id = a.account_id AND t.date_created >= DATE '{AS_OF}' - INTERVAL 12 MONTH GROUP BY 1")
def account_stats_6m_1y_now(spark: SparkSession, d: str) -> DataFrame:
    """Count, average, maximum and sum of credits and debits in the last 6 and 12 months; accounts without any have zeros. The date limit is on the scan."""
    since = lambda m: F.add_months(F.lit(AS_OF).cast("date"), -m)
    recent = transactions(spark, d).filter(F.col("date_created") >= since(12)).select("account_id", "kind", "date_created", "amount")
    out = []
    for kind, months, name in STATS:
        own = F.when((F.col("kind") == kind) & (F.col("date_created") >= since(months)), F.col("amount"))
        s = F.sum(own).cast("double")
        out += [F.count(own).alias(f"n_{name}"), s.alias(f"sum_{name}"), F.max(own).cast("double").alias(f"max_{name}"), mean(own).alias(f"avg_{name}")]
    stats = recent.groupBy("account_id").agg(*out)
    return accounts(spark, d).select("account_id").join(stats, "account_id", "left").na.fill(0)


_LATEST = [(kind, days, f"{kind.lower()}{days}") for kind in "CD" for days in (180, 365)]


def _latest_sql(kind: str, days: int, name: str) -> str:
    own = f"FILTER (WHERE kind = '{kind}' AND date_created >= latest - {days})"
    average = f"coalesce({mean_sql(f'sum(CAST(amount * 100 AS BIGINT)) {own}', f'nullif(count(*) {own}, 0)')}, 0)"
    return f"count(*) {own} AS n_{name}, coalesce(CAST(sum(amount) {own} AS DOUBLE), 0) AS sum_{name}, coalesce(CAST(max(amount) {own} AS DOUBLE), 0) AS max_{name}, {average} AS avg_{name}"


@query(SQL + ", m AS (SELECT account_id, max(date_created) AS latest FROM txn GROUP BY 1) SELECT account_id, " + ", ".join(_latest_sql(*x) for x in _LATEST) + " FROM txn JOIN m USING (account_id) GROUP BY 1")
def account_stats_180_365_latest(spark: SparkSession, d: str) -> DataFrame:
    """Credits and debits in windows that end at each account's latest transaction. Days are summed first, so the window sees a row per account, kind and day."""
    days = transactions(spark, d).groupBy("account_id", "kind", "date_created").agg(F.count("*").alias("n"), F.sum("amount").alias("s"), F.max("amount").alias("m"))
    days = days.withColumn("latest", F.max("date_created").over(Window.partitionBy("account_id")))
    out = []
    for kind, span, name in _LATEST:
        on = lambda c: F.when((F.col("kind") == kind) & (F.col("date_created") >= F.date_sub("latest", span)), F.col(c))  # noqa: B023, E731
        n, total_ = F.coalesce(F.sum(on("n")), F.lit(0)), F.sum(on("s"))
        average = F.round(F.try_divide(total_, F.nullif(n, F.lit(0))), 2)
        out += [n.alias(f"n_{name}"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"{k}_{name}") for k, c in (("sum", total_), ("max", F.max(on("m"))), ("avg", average)))]
    return days.groupBy("account_id").agg(*out)


#: Currency and account type stand in for columns that the tables lack.
_DIMS = "SELECT branch_id, product, sector AS currency, CASE WHEN balance > 200000 THEN 'corporate' ELSE 'retail' END AS account_type, state, level, count(*) AS n, sum(CAST(score * 100 AS BIGINT)) AS cents FROM acct JOIN cust USING (customer_id) GROUP BY ALL"


@query(SQL + f", g AS ({_DIMS}) SELECT branch_id, product, currency, account_type, state, sum(n)::BIGINT AS n, sum(CASE WHEN level = 'high' THEN n ELSE 0 END)::BIGINT AS n_high, sum(CASE WHEN level = 'medium' THEN n ELSE 0 END)::BIGINT AS n_medium, sum(CASE WHEN level = 'low' THEN n ELSE 0 END)::BIGINT AS n_low, {mean_sql('sum(cents)', 'sum(n)')} AS value FROM g GROUP BY ALL")
def agg_risk_by_dims(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean risk by branch, product, currency, account type and state, with counts by level, of customers with a level."""
    return _by_dims(spark, d)


def _by_dims(spark: SparkSession, d: str) -> DataFrame:
    rows = accounts(spark, d).join(customers(spark, d).withColumn("level", level(F.col("score"))), "customer_id").filter("level IN ('high', 'medium', 'low')")
    kind = F.when(F.col("balance") > 200000, "corporate").otherwise("retail")
    counts = (F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("high", "medium", "low"))
    return rows.groupBy("branch_id", "product", F.col("sector").alias("currency"), kind.alias("account_type"), "state").agg(F.count("*").alias("n"), *counts, mean("score").alias("value"))


@query(SQL + f", g AS ({_DIMS}), v AS (SELECT branch_id, sum(n) AS n, CAST(sign(sum(cents)) * ((2 * abs(sum(cents)) + sum(n)) // (2 * sum(n))) AS BIGINT) AS value FROM g GROUP BY branch_id, product, currency, account_type, state) SELECT branch_id, sum(n)::BIGINT AS n, {mean_sql('sum(value * n)', 'sum(n)')} AS value FROM v GROUP BY 1")
def agg_risk_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The aggregate by dimensions rolled up to branches: rounded values weighted by their counts."""
    v = _by_dims(spark, d).withColumn("value", F.col("value").cast("decimal(18,2)"))
    return v.groupBy("branch_id").agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")), 2).cast("double").alias("value"))


@query(SQL + f", g AS (SELECT branch_id, product, count(*) AS n, sum(CAST(score * 100 AS BIGINT)) AS cents FROM acct JOIN cust USING (customer_id) GROUP BY ALL) SELECT count(*) AS groups, sum(n)::BIGINT AS n, CAST(sum(cents) AS DOUBLE) / 100 AS total FROM g")
def agg_of_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Totals over an aggregate: its groups, their rows and sums."""
    g = accounts(spark, d).join(customers(spark, d), "customer_id").groupBy("branch_id", "product").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"))


@query(SQL + "SELECT coalesce(branch, 'No Branch') || '(' || count(*) || ')' AS label, round(CAST(sum(coalesce(score, 0)) AS DOUBLE) / count(*), 4) AS value FROM cust LEFT JOIN (SELECT * FROM branch WHERE region_id <> 4) USING (branch_id) GROUP BY branch")
def branch_weighted_avg(spark: SparkSession, d: str) -> DataFrame:
    """Mean score by branch, labelled with its size; customers without a branch together."""
    rows = customers(spark, d).join(branches(spark, d).filter("region_id <> 4"), "branch_id", "left")
    g = rows.groupBy("branch").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(0))).cast("double").alias("s"))
    return g.select(F.concat(F.coalesce("branch", F.lit("No Branch")), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("label"), F.round(F.col("s") / F.col("n"), 4).alias("value"))


@query(f"WITH days AS (SELECT CAST(unnest(generate_series(DATE '{EVENTS_AS_OF}' - 39, DATE '{EVENTS_AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM days LEFT JOIN n USING (day)")
def gap_filled_daily(spark: SparkSession, d: str) -> DataFrame:
    """A count for each of the last 40 days, zero where nothing happened."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(EVENTS_AS_OF).cast("date"), 39), F.lit(EVENTS_AS_OF).cast("date"))).alias("day"))
    n = load(spark, d, "events").filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query(SQL + "SELECT CAST(date_trunc('month', opened) AS DATE) AS month, string_agg(CAST(account_id AS VARCHAR), ',' ORDER BY account_id) AS ids, count(*) AS n FROM acct WHERE balance > 350000 GROUP BY 1")
def array_agg_ids(spark: SparkSession, d: str) -> DataFrame:
    g = accounts(spark, d).filter("balance > 350000").groupBy(F.trunc("opened", "month").alias("month")).agg(F.array_sort(F.collect_list("account_id")).alias("a"), F.count("*").alias("n"))
    return g.select("month", F.array_join(F.col("a").cast("array<string>"), ",").alias("ids"), "n")


_SIDES = "SELECT s_suppkey AS account, sum(CASE WHEN kind = 'D' THEN amount ELSE 0 END) AS debit, sum(CASE WHEN kind = 'C' THEN amount ELSE 0 END) AS credit FROM supplier LEFT JOIN txn ON channel_id = s_suppkey AND line > 1 GROUP BY 1"
_MODES = {"all": "true", "not_zero": "coalesce(debit, 0) <> coalesce(credit, 0)", "movement": "coalesce(debit, 0) <> 0 OR coalesce(credit, 0) <> 0"}


@query(SQL + f", s AS ({_SIDES}) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, account, CAST(coalesce(debit, 0) AS DOUBLE) AS debit, CAST(coalesce(credit, 0) AS DOUBLE) AS credit, CAST(coalesce(debit, 0) - coalesce(credit, 0) AS DOUBLE) AS balance FROM s WHERE {w}" for m, w in _MODES.items()))
def trial_balance(spark: SparkSession, d: str) -> DataFrame:
    """Debit, credit and balance by account: all accounts, those not in balance, and those with movement. One aggregate serves the three modes."""
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("amount")).otherwise(0)).alias({"D": "debit", "C": "credit"}[k])
    s = transactions(spark, d).filter("line > 1").groupBy(F.col("channel_id").alias("account")).agg(side("D"), side("C"))
    every = load(spark, d, "supplier").select(F.col("s_suppkey").alias("account")).join(s, "account", "left")
    modes = F.array_compact(F.array(*(F.when(F.expr(w), m) for m, w in _MODES.items())))
    zero = lambda c: F.coalesce(c, F.lit(0))
    balance = (zero(F.col("debit")) - zero(F.col("credit"))).cast("double").alias("balance")
    return every.select(F.explode(modes).alias("mode"), "account", *(zero(F.col(c)).cast("double").alias(c) for c in ("debit", "credit")), balance)


FROM_DAY = "1997-01-01"


@query(SQL + f""", j AS (SELECT *, CASE WHEN kind = 'D' THEN amount ELSE -amount END AS x FROM txn), o AS (SELECT account_id, sum(x) AS opening FROM j WHERE date_created < DATE '{FROM_DAY}' GROUP BY 1)
SELECT account_id, 0 AS line, 'opening balance' AS label, CAST(opening AS DOUBLE) AS balance FROM o
UNION ALL SELECT account_id, line, 'line', CAST(coalesce(opening, 0) + sum(x) OVER (PARTITION BY account_id ORDER BY date_created, line, part_id, channel_id, x ROWS UNBOUNDED PRECEDING) AS DOUBLE) FROM j LEFT JOIN o USING (account_id) WHERE date_created >= DATE '{FROM_DAY}'""")
def general_ledger_running(spark: SparkSession, d: str) -> DataFrame:
    """The running balance of each account by date and line from FROM_DAY on, after a row with the balance before it.

    Running totals are taken by day first and then within a day, so a busy account is no single task's sort of all its lines.
    """
    x = F.when(F.col("kind") == "D", F.col("amount")).otherwise(-F.col("amount"))
    lines = transactions(spark, d).withColumn("x", x)
    early = F.col("date_created") < F.lit(FROM_DAY).cast("date")
    late = lines.filter(~early)
    # one sum a day from then on, and one for all days before, of which the opening balance is the first of an account's running sums
    since = F.when(~early, F.col("date_created"))
    days = lines.groupBy("account_id", since.alias("date_created")).agg(F.sum("x").alias("day"))
    before = F.sum("day").over(Window.partitionBy("account_id").orderBy(F.col("date_created").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    starts = days.select("account_id", "date_created", "day", F.coalesce(before, F.lit(0)).alias("start"))
    opening = days.filter("date_created is null").select("account_id", F.col("day").alias("opening"))
    inside = F.sum("x").over(Window.partitionBy("account_id", "date_created").orderBy("line", "part_id", "channel_id", "x").rowsBetween(Window.unboundedPreceding, 0))
    detail = late.withColumn("inside", inside).join(starts, ["account_id", "date_created"])
    rows = detail.select("account_id", "line", F.lit("line").alias("label"), (F.col("start") + F.col("inside")).cast("double").alias("balance"))
    return opening.select("account_id", F.lit(0).alias("line"), F.lit("opening balance").alias("label"), F.col("opening").cast("double").alias("balance")).unionByName(rows)


AGED_ON, AGED_LENGTH = "1998-03-31", 30
_BUCKETS = {"not_due": (None, 0), "b4": (1, 30), "b3": (31, 60), "b2": (61, 90), "b1": (91, 120), "b0": (121, None)}
_aged = lambda lo, hi: " AND ".join([f"age >= {lo}"] * (lo is not None) + [f"age <= {hi}"] * (hi is not None))


@query(SQL + f""", paid AS (SELECT account_id, sum(amount) AS paid FROM txn WHERE kind = 'D' AND date_created <= DATE '{AGED_ON}' GROUP BY 1),
r AS (SELECT customer_id, balance - coalesce(paid, 0) AS rest, datediff('day', opened + 14, DATE '{AGED_ON}') AS age FROM acct LEFT JOIN paid USING (account_id) WHERE opened <= DATE '{AGED_ON}' AND state <> 'P'),
b AS (SELECT customer_id, {', '.join(f"coalesce(sum(rest) FILTER (WHERE {_aged(*v)}), 0) AS {k}" for k, v in _BUCKETS.items())}, sum(rest) AS total FROM r WHERE rest <> 0 GROUP BY 1)
SELECT customer_id, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in (*_BUCKETS, 'total'))} FROM b WHERE {' OR '.join(f'{k} <> 0' for k in _BUCKETS)}""")
def aged_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Receivables by customer and age on a day: what is not due, four buckets of 30 days, and older. What is left of an account is its balance less the payments
    (its debits) up to that day; settled accounts and customers with nothing in any bucket are left out. Accounts fall due 14 days after they open.
    """
    on = F.lit(AGED_ON).cast("date")
    paid = transactions(spark, d).filter((F.col("kind") == "D") & (F.col("date_created") <= on)).groupBy("account_id").agg(F.sum("amount").alias("paid"))
    lines = accounts(spark, d).filter((F.col("opened") <= on) & (F.col("state") != "P")).join(paid, "account_id", "left")
    lines = lines.select("customer_id", (F.col("balance") - F.coalesce("paid", F.lit(0))).alias("rest"), F.datediff(on, F.date_add("opened", 14)).alias("age")).filter("rest <> 0")
    bucket = lambda lo, hi: F.coalesce(F.sum(F.when(F.expr(_aged(lo, hi)), F.col("rest"))), F.lit(0))
    g = lines.groupBy("customer_id").agg(*(bucket(*v).alias(k) for k, v in _BUCKETS.items()), F.sum("rest").alias("total"))
    return g.filter(" OR ".join(f"{k} <> 0" for k in _BUCKETS)).select("customer_id", *(F.col(k).cast("double").alias(k) for k in (*_BUCKETS, "total")))


_FLOW = "CAST(sum(CASE WHEN kind = 'C' THEN amount ELSE 0 END) AS DOUBLE) AS income, CAST(sum(CASE WHEN kind = 'D' THEN amount ELSE 0 END) AS DOUBLE) AS expense, CAST(sum(CASE WHEN kind = 'C' THEN amount ELSE -amount END) AS DOUBLE) AS net"


@query(SQL + f"SELECT strftime(date_created, '%Y-%m') AS month, channel_id AS account, state AS journal, {_FLOW}, grouping(channel_id)::INT + grouping(state)::INT AS level FROM txn GROUP BY GROUPING SETS ((month), (month, channel_id), (month, channel_id, state))")
def cash_flow_month(spark: SparkSession, d: str) -> DataFrame:
    """Income, expense and net by month (level 2), month and account (1), and month, account and journal (0). One scan; the coarser levels roll up the finest."""
    on = lambda k: F.when(F.col("kind") == k, F.col("amount")).otherwise(0)
    fine = transactions(spark, d).groupBy(F.date_format("date_created", "yyyy-MM").alias("month"), F.col("channel_id").alias("account"), F.col("state").alias("journal")).agg(F.sum(on("C")).alias("income"), F.sum(on("D")).alias("expense"))
    sets = fine.groupingSets([["month"], ["month", "account"], ["month", "account", "journal"]], "month", "account", "journal")
    out = sets.agg(F.sum("income").alias("income"), F.sum("expense").alias("expense"), (F.grouping("account") + F.grouping("journal")).cast("int").alias("level"))
    return out.select("month", "account", "journal", F.col("income").cast("double").alias("income"), F.col("expense").cast("double").alias("expense"), (F.col("income") - F.col("expense")).cast("double").alias("net"), "level")


@query(SQL + ", i AS (SELECT customer_id, sum(balance) AS x FROM acct WHERE state = 'F' GROUP BY 1), r AS (SELECT customer_id, sum(balance) AS y FROM acct WHERE state = 'P' GROUP BY 1) SELECT customer_id, CAST(x - coalesce(y, 0) AS DOUBLE) AS net FROM i LEFT JOIN r USING (customer_id) ORDER BY net DESC, customer_id LIMIT 10")
def net_top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The ten customers of the largest invoices less refunds; one pass with conditional sums."""
    s = lambda v: F.sum(F.when(F.col("state") == v, F.col("balance")))
    g = accounts(spark, d).filter(F.col("state").isin("F", "P")).groupBy("customer_id").agg(s("F").alias("x"), s("P").alias("y")).filter("x is not null")
    return g.select("customer_id", (F.col("x") - F.coalesce("y", F.lit(0))).cast("double").alias("net")).orderBy(F.desc("net"), "customer_id").limit(10)


@query(SQL + "SELECT account_id, line, (line = min(line) OVER (PARTITION BY account_id)) AS first FROM txn")
def first_installment_flag(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).select("account_id", "line", (F.col("line") == F.min("line").over(Window.partitionBy("account_id"))).alias("first"))


@query("SELECT strftime(ts, '%B %Y') AS month, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, min(user_id) AS first_user FROM events GROUP BY 1, 2")
def multi_key_conditional(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.date_format("ts", "MMMM yyyy").alias("month"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.min("user_id").alias("first_user"))


@query("SELECT text AS question, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, question LIMIT 5")
def top_questions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").filter("role = 'user'").groupBy(F.col("text").alias("question")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(5)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new) AS i FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after 30 minutes of silence."""
    return load(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
