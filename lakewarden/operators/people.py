"""Head counts, attrition, taxes by bridge, income by day, residual risk, and the window and date functions that other reports lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, SQL, accounts, load, total, transactions


def _employees(spark: SparkSession, d: str) -> DataFrame:
    """Accounts as employees: their product is the department, their last line the day they left (those of state O stay)."""
    last = transactions(spark, d).groupBy("account_id").agg(F.max("date_created").alias("last"))
    return accounts(spark, d).join(last, "account_id", "left").select("account_id", F.col("product").alias("department"), F.col("opened").alias("joined"), F.when(F.col("state") != "O", F.col("last")).alias("resigned"))


_STAFF = SQL + ", e AS (SELECT a.account_id, product AS department, opened AS joined, CASE WHEN a.state <> 'O' THEN last END AS resigned FROM acct a LEFT JOIN (SELECT account_id, max(date_created) AS last FROM txn GROUP BY 1) t USING (account_id))"


@query(_STAFF + f" SELECT department, count(*) FILTER (WHERE resigned IS NULL OR resigned > DATE '{AS_OF}') AS staff, count(*) AS ever FROM e GROUP BY 1")
def department_headcount(spark: SparkSession, d: str) -> DataFrame:
    here = F.col("resigned").isNull() | (F.col("resigned") > F.lit(AS_OF).cast("date"))
    return _employees(spark, d).groupBy("department").agg(F.count_if(here).alias("staff"), F.count("*").alias("ever"))


@query(_STAFF + """, m AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS DATE) AS month), c AS (SELECT month, count(*) FILTER (WHERE resigned > month OR resigned IS NULL AND joined < month) AS n, count(*) FILTER (WHERE date_trunc('month', joined) = month) AS j, count(*) FILTER (WHERE date_trunc('month', resigned) = month) AS r FROM m, e GROUP BY 1)
SELECT month, n AS staff, j AS joined, r AS resigned, round(CASE WHEN (n + j - r + n) / 2.0 <> 0 THEN r / ((n + j - r + n) / 2.0) * 100 ELSE 0 END, 2) AS rate FROM c""")
def attrition_rate(spark: SparkSession, d: str) -> DataFrame:
    """Who was there, joined and left by month, and the share that left of the mean of the month's two ends; one pass counts all months."""
    months = [f"1997-{m:02d}-01" for m in range(1, 13)]
    counts = []
    for text in months:
        month = F.lit(text).cast("date")
        there = (F.col("resigned") > month) | F.col("resigned").isNull() & (F.col("joined") < month)
        counts.append(F.struct(month.alias("month"), F.count_if(there).alias("staff"), F.count_if(F.trunc("joined", "month") == month).alias("joined"), F.count_if(F.trunc("resigned", "month") == month).alias("resigned")))
    rows = _employees(spark, d).agg(F.array(*counts).alias("c")).select(F.inline("c"))
    mean = (2 * F.col("staff") + F.col("joined") - F.col("resigned")) / 2
    return rows.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("resigned"), mean) * 100, F.lit(0.0)), 2))


@query(SQL + """, b AS (SELECT account_id, line, part_id, CASE WHEN kind = 'D' THEN amount ELSE -amount END AS x, flag, quantity, discount FROM txn), t AS (SELECT flag AS tax, abs(coalesce(sum(x), 0)) AS tax_amount FROM b WHERE flag <> 'N' GROUP BY 1),
r AS (SELECT x, 'A' AS tax FROM b WHERE quantity > 10 UNION ALL SELECT x, 'R' FROM b WHERE discount > 0.05 UNION ALL SELECT x, 'Z' FROM b WHERE line = 7), n AS (SELECT tax, abs(coalesce(sum(x), 0)) AS net FROM r GROUP BY 1)
SELECT coalesce(t.tax, n.tax) AS tax, CAST(coalesce(tax_amount, 0) AS DOUBLE) AS tax_amount, CAST(coalesce(net, 0) AS DOUBLE) AS net FROM t FULL JOIN n ON t.tax = n.tax""")
def tax_by_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The amount of each tax from its own lines, and the net amount from the lines that a bridge table ties to it, a line to several."""
    x = F.when(F.col("kind") == "D", F.col("amount")).otherwise(-F.col("amount"))
    lines = transactions(spark, d).withColumn("x", x)
    taxes = lines.filter("flag <> 'N'").groupBy(F.col("flag").alias("tax")).agg(F.abs(F.sum("x")).alias("t"))
    ties = F.array_compact(F.array(F.when(F.col("quantity") > 10, "A"), F.when(F.col("discount") > 0.05, "R"), F.when(F.col("line") == 7, "Z")))
    nets = lines.select("x", F.explode(ties).alias("tax")).groupBy("tax").agg(F.abs(F.sum("x")).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return taxes.join(nets, "tax", "full").select("tax", zero(F.col("t")).alias("tax_amount"), zero(F.col("n")).alias("net"))


@query(SQL + """, m AS (SELECT CAST(unnest(generate_series(DATE '1996-04-01', DATE '1996-05-31', INTERVAL 1 DAY)) AS DATE) AS day), t AS (SELECT date_created AS day, sum(amount) FILTER (WHERE kind = 'C') AS i, sum(amount) FILTER (WHERE kind = 'D') AS e FROM txn GROUP BY 1)
SELECT m.day, CASE WHEN m.day >= DATE '1996-05-01' THEN 'this' ELSE 'last' END AS month, CAST(coalesce(i, 0) AS DOUBLE) AS income, CAST(coalesce(e, 0) AS DOUBLE) AS expense FROM m LEFT JOIN t USING (day)""")
def income_expense_day(spark: SparkSession, d: str) -> DataFrame:
    """Income and expense by day of a month and the one before, with zeros for days without any."""
    first, last = F.lit("1996-04-01").cast("date"), F.lit("1996-05-31").cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    side = lambda k: total(F.when(F.col("kind") == k, F.col("amount")))
    t = transactions(spark, d).filter(F.col("date_created").between(first, last)).groupBy(F.col("date_created").alias("day")).agg(side("C").alias("income"), side("D").alias("expense"))
    month = F.when(F.col("day") >= F.trunc(last, "month"), "this").otherwise("last")
    return days.join(t, "day", "left").select("day", month.alias("month"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("income", "expense")))


def residual(inherent: Column, control: Column, most: float) -> dict[str, Column]:
    """probability (of 100), impact and residual score of a risk under a control of some effectiveness; without a scale nothing is controlled. A null inherent risk or control is 0."""
    share = 1 - F.coalesce(control, F.lit(0.0)) / most if most else F.lit(1.0)
    impact = F.coalesce(inherent, F.lit(0.0)) * share
    return {"probability": share * 100, "impact": impact, "residual": share * impact}


@query(SQL + ", a AS (SELECT account_id, CASE WHEN account_id % 7 > 0 THEN CAST(balance AS DOUBLE) / 10000 END AS i, CASE WHEN account_id % 5 > 0 THEN CAST(account_id % 10 AS DOUBLE) END AS c FROM acct) SELECT account_id, round((1 - coalesce(c, 0) / 9) * 100, 6) AS probability, round(coalesce(i, 0) * (1 - coalesce(c, 0) / 9), 6) AS impact, round((1 - coalesce(c, 0) / 9) * coalesce(i, 0) * (1 - coalesce(c, 0) / 9), 6) AS residual FROM a")
def residual_risk(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("account_id")
    scores = residual(F.when(n % 7 > 0, F.col("balance").cast("double") / 10000), F.when(n % 5 > 0, (n % 10).cast("double")), 9.0)
    return accounts(spark, d).select("account_id", *(F.round(c, 6).alias(name) for name, c in scores.items()))


@query(SQL + """SELECT account_id, ntile(4) OVER w AS quarter, last_value(balance::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, CAST(sum(balance) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS near, count(*) OVER (PARTITION BY customer_id ORDER BY opened RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS within,
round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS upto, nth_value(account_id, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM acct WINDOW w AS (PARTITION BY customer_id ORDER BY opened, account_id)""")
def tiles_and_frames(spark: SparkSession, d: str) -> DataFrame:
    """Tiles, last and nth values, shares, and sums over row and time frames of each customer's accounts."""
    w = Window.partitionBy("customer_id").orderBy("opened", "account_id")
    whole, days = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("customer_id").orderBy(F.unix_date("opened")).rangeBetween(-90, 0)
    balance = F.col("balance").cast("double")
    return accounts(spark, d).select("account_id", F.ntile(4).over(w).alias("quarter"), F.last(balance).over(whole).alias("last"), F.sum("balance").over(w.rowsBetween(-2, 1)).cast("double").alias("near"), F.count("*").over(days).alias("within"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.cume_dist().over(w), 6).alias("upto"), F.nth_value("account_id", 2).over(whole).alias("second"))


@query("""SELECT event_id, extract(year FROM ts) AS y, extract(quarter FROM ts) AS q, extract(week FROM ts) AS w, extract(doy FROM ts) AS doy, isodow(ts) AS dow, extract(hour FROM ts) AS h, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minutes,
rpad(strftime(ts, '%B'), 9, ' ') || ' ' || strftime(ts, '%Y') AS padded, strftime(ts, '%m') || '/' || strftime(ts, '%y') AS short, concat(event_type, NULL, '-', CAST(nullif(user_id % 3, 0) AS VARCHAR)) AS joined, event_type || CAST(nullif(user_id % 3, 0) AS VARCHAR) AS strict, format('{:,}', user_id * 1000) AS whole, format('{:,.2f}', user_id * 1234.5) AS money,
round_even(user_id / 8.0, 2) AS half_even, md5(to_json([coalesce(event_type, '<NULL>'), coalesce(CAST(nullif(user_id % 3, 0) AS VARCHAR), '<NULL>')])) AS row_md5 FROM events""")
def parts_and_forms(spark: SparkSession, d: str) -> DataFrame:
    """Parts of times, padded month names, both ways to join texts with nulls, both number formats, rounding of halves to even, and the hash of a row as a JSON array."""
    user, some = F.col("user_id"), F.nullif(F.col("user_id") % 3, F.lit(0)).cast("string")
    part = lambda p: F.extract(F.lit(p), F.col("ts")).cast("long")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    as_row = F.to_json(F.array(*(F.coalesce(c, F.lit("<NULL>")) for c in (F.col("event_type"), some))))
    return load(spark, d, "events").select(
        "event_id", part("YEAR").alias("y"), part("QUARTER").alias("q"), part("WEEK").alias("w"), part("DOY").alias("doy"), part("DOW_ISO").alias("dow"), part("HOUR").alias("h"), seconds.alias("epoch"), F.floor(seconds / 60).alias("minutes"),
        F.concat(F.rpad(F.date_format("ts", "MMMM"), 9, " "), F.lit(" "), F.date_format("ts", "yyyy")).alias("padded"), F.date_format("ts", "MM/yy").alias("short"), F.concat_ws("", "event_type", F.lit(None).cast("string"), F.lit("-"), some).alias("joined"), F.concat("event_type", some).alias("strict"),
        F.format_number(user * 1000, 0).alias("whole"), F.format_number(user * 1234.5, 2).alias("money"), F.bround(user / 8.0, 2).alias("half_even"), F.md5(as_row).alias("row_md5"),
    )
