"""Accounting statements, budgets, stock and scalar indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.operators.aggregations import mean_sql
from lakewarden.operators.hierarchy import rollup
from lakewarden.plans.secure import run_user_query, secured
from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, SQL, accounts, branches, customers, load, total, transactions


_TREE_SQL = SQL + """, leaf AS (SELECT 'n' || branch_id AS node, count(*) AS n, sum(balance) AS s FROM acct JOIN cust USING (customer_id) GROUP BY 1),
edge AS (SELECT 'n' || branch_id AS node, 'r' || region_id AS parent FROM branch UNION ALL SELECT 'r' || r_regionkey, 'all' FROM region),
up AS (SELECT l.node AS top, l.n, l.s FROM leaf l UNION ALL SELECT e.parent, l.n, l.s FROM leaf l JOIN edge e ON e.node = l.node UNION ALL SELECT 'all', n, s FROM leaf)
"""


@query(_TREE_SQL + "SELECT top AS node, sum(n)::BIGINT AS n, -CAST(sum(s) AS DOUBLE) AS balance FROM up GROUP BY 1")
def statement_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Balances rolled up a tree of report lines (branch, region, all), with the sign of a liability."""
    leaves = accounts(spark, d).join(customers(spark, d).select("customer_id", "branch_id"), "customer_id").groupBy(F.concat(F.lit("n"), F.col("branch_id").cast("string")).alias("node")).agg(F.count("*").alias("n"), F.sum("balance").alias("s"))
    b = branches(spark, d).select(F.concat(F.lit("n"), F.col("branch_id").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("parent"))
    r = load(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("all").alias("parent"))
    return rollup(leaves, b.unionByName(r), ["n", "s"]).select("node", "n", (-F.col("s")).cast("double").alias("balance"))


@query(SQL + f"""SELECT channel_id AS account, CASE WHEN channel_id % 4 = 0 THEN 'asset' WHEN channel_id % 4 = 1 THEN 'liability' WHEN channel_id % 4 = 2 THEN 'income' ELSE 'expense' END AS class,
CAST(sum(CASE WHEN kind = 'D' THEN amount ELSE -amount END) AS DOUBLE) AS balance, CAST(sum(CASE WHEN kind = 'D' THEN amount ELSE -amount END) FILTER (WHERE date_created >= DATE '{AS_OF}' - INTERVAL 3 YEAR OR channel_id % 4 < 2) AS DOUBLE) AS shown FROM txn GROUP BY ALL""")
def balance_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Balances by account: assets and liabilities over all time, income and expense over the last three years."""
    signed = F.when(F.col("kind") == "D", F.col("amount")).otherwise(-F.col("amount"))
    k = F.col("account") % 4
    recent = F.col("date_created") >= F.add_months(F.lit(AS_OF).cast("date"), -36)
    rows = transactions(spark, d).withColumn("account", F.col("channel_id")).withColumn("x", signed)
    named = F.when(k == 0, "asset").when(k == 1, "liability").when(k == 2, "income").otherwise("expense")
    return rows.groupBy("account", named.alias("class")).agg(F.sum("x").cast("double").alias("balance"), F.sum(F.when(recent | (k < 2), F.col("x"))).cast("double").alias("shown"))


@query(SQL + """SELECT CAST(sum(balance) FILTER (WHERE state = 'F') AS DOUBLE) AS invoiced, count(*) FILTER (WHERE state = 'F') AS n_invoices, CAST(sum(balance) FILTER (WHERE state = 'O') AS DOUBLE) AS bills,
CAST(sum(balance) FILTER (WHERE state = 'P') AS DOUBLE) AS refunds, count(*) FILTER (WHERE state <> 'F') AS unreconciled, CAST(coalesce(sum(balance) FILTER (WHERE state = 'F'), 0) - coalesce(sum(balance) FILTER (WHERE state = 'O'), 0) AS DOUBLE) AS profit FROM acct""")
def scalar_totals(spark: SparkSession, d: str) -> DataFrame:
    """Invoices, bills, refunds, open items and profit in one pass; each is a conditional aggregate."""
    s = lambda v: F.sum(F.when(F.col("state") == v, F.col("balance")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = [s("F").cast("double").alias("invoiced"), F.count_if(F.col("state") == "F").alias("n_invoices"), s("O").cast("double").alias("bills"), s("P").cast("double").alias("refunds"), F.count_if(F.col("state") != "F").alias("unreconciled"), (zero(s("F")) - zero(s("O"))).cast("double").alias("profit")]
    return accounts(spark, d).agg(*out)


@query("SELECT min(event_id) AS id, user_id, CAST(ts AS DATE) AS day, event_type FROM events GROUP BY ALL")
def attendance_view(spark: SparkSession, d: str) -> DataFrame:
    """One row per user, day and kind, with its smallest id."""
    return load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.min("event_id").alias("id")).select("id", "user_id", "day", "event_type")


_BUDGET = "budget AS (SELECT n_nationkey AS branch_id, make_date(1996, 1 + n_nationkey % 6, 1) AS start, make_date(1997, 1 + n_nationkey % 12, 1) AS finish, 1000.0 * (n_nationkey + 1) AS planned FROM nation)"


@query(SQL + f""", {_BUDGET}, p AS (SELECT b.branch_id, sum(balance) AS practical FROM budget b JOIN cust USING (branch_id) JOIN acct USING (customer_id) WHERE opened BETWEEN start AND finish GROUP BY 1)
SELECT branch_id, CAST(coalesce(practical, 0) AS DOUBLE) AS practical, round(CASE WHEN DATE '1996-12-31' <= start THEN 0 WHEN DATE '1996-12-31' >= finish THEN planned ELSE CAST(planned AS DOUBLE) * datediff('day', start, DATE '1996-12-31') / datediff('day', start, finish) END, 4) AS theoretical FROM budget LEFT JOIN p USING (branch_id)""")
def budget_lines(spark: SparkSession, d: str) -> DataFrame:
    """What was booked in each budget's interval, and the planned amount's share of time that has passed."""
    n = F.col("branch_id")
    budget = branches(spark, d).select(n, F.make_date(F.lit(1996), 1 + n % 6, F.lit(1)).alias("start"), F.make_date(F.lit(1997), 1 + n % 12, F.lit(1)).alias("finish"), ((n + 1) * 1000).cast("double").alias("planned"))
    booked = accounts(spark, d).join(customers(spark, d).select("customer_id", "branch_id"), "customer_id").groupBy("branch_id", "opened").agg(F.sum("balance").alias("s"))
    practical = booked.join(budget, "branch_id").filter("opened between start and finish").groupBy("branch_id").agg(F.sum("s").alias("practical"))
    on = F.lit("1996-12-31").cast("date")
    share = F.when(on <= F.col("start"), 0.0).when(on >= F.col("finish"), F.col("planned")).otherwise(F.col("planned") * F.datediff(on, "start") / F.datediff("finish", "start"))
    return budget.join(practical, "branch_id", "left").select("branch_id", F.coalesce("practical", F.lit(0)).cast("double").alias("practical"), F.round(share, 4).alias("theoretical"))


@query(SQL + "SELECT p_brand AS product, state AS location, CAST(sum(CASE WHEN kind = 'C' THEN quantity ELSE -quantity END) AS DOUBLE) AS on_hand, sum(CASE WHEN kind = 'C' THEN quantity ELSE -quantity END) <= 0 AS out_of_stock FROM txn JOIN part ON p_partkey = part_id GROUP BY ALL")
def stock_levels(spark: SparkSession, d: str) -> DataFrame:
    """Quantity on hand by product and location, and whether it has run out; parts are summed before the join."""
    moved = F.when(F.col("kind") == "C", F.col("quantity")).otherwise(-F.col("quantity"))
    by_part = transactions(spark, d).groupBy("part_id", "state").agg(F.sum(moved).alias("q"))
    g = by_part.join(load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), "p_brand"), "part_id").groupBy(F.col("p_brand").alias("product"), F.col("state").alias("location")).agg(F.sum("q").alias("on_hand"))
    return g.withColumn("out_of_stock", F.col("on_hand") <= 0)


@query(SQL + "SELECT customer_id, count(*) AS n, CAST(sum(balance) AS DOUBLE) AS equity, bool_or(state = 'P') AS any_unverified, bool_or(balance > 300000) AS any_high_risk, string_agg(DISTINCT product, '; ' ORDER BY product) AS summary FROM acct GROUP BY 1")
def ubo_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Owners of a customer: number, equity, whether any is unverified or of high risk, and their roles."""
    g = accounts(spark, d).groupBy("customer_id").agg(F.count("*").alias("n"), total("balance").alias("equity"), F.bool_or(F.col("state") == "P").alias("any_unverified"), F.bool_or(F.col("balance") > 300000).alias("any_high_risk"), F.array_sort(F.collect_set("product")).alias("_p"))
    return g.withColumn("summary", F.array_join("_p", "; ")).drop("_p")


def is_owner(role: Column, control: Column, equity: Column, votes: Column, threshold: float = 25.0) -> Column:
    """A beneficial owner: by role, by control, or with shares or votes of at least the threshold."""
    return F.coalesce(role | control | (equity >= threshold) | (votes >= threshold), F.lit(False))


@query(SQL + "SELECT account_id, line, coalesce(flag = 'R' OR state = 'X' OR quantity >= 40 OR discount * 100 >= 9, false) AS is_owner FROM txn")
def ubo_flag(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return t.select("account_id", "line", is_owner(F.col("flag") == "R", F.col("state") == "X", F.col("quantity") - 15, F.col("discount") * 100 + 16).alias("is_owner"))


def residual(inherent: Column, control: Column, most: float) -> Column:
    """The risk that a control of some strength leaves."""
    return inherent * (1 - control / most)


@query(SQL + "SELECT account_id, round(max(quantity * (1 - discount * 100 / 12)), 4) AS highest, round(avg(quantity * (1 - discount * 100 / 12)), 4) AS average, CASE WHEN max(quantity * (1 - discount * 100 / 12)) > 30 THEN 'high' WHEN max(quantity * (1 - discount * 100 / 12)) > 10 THEN 'medium' ELSE 'low' END AS band FROM txn GROUP BY 1")
def assessment_rating(spark: SparkSession, d: str) -> DataFrame:
    """A risk assessment's rating from its lines' residual risks: the highest and the mean."""
    rest = transactions(spark, d).select("account_id", residual(F.col("quantity"), F.col("discount") * 100, 12.0).alias("r"))
    g = rest.groupBy("account_id").agg(F.max("r").alias("m"), F.avg("r").alias("a"))
    return g.select("account_id", F.round("m", 4).alias("highest"), F.round("a", 4).alias("average"), F.when(F.col("m") > 30, "high").when(F.col("m") > 10, "medium").otherwise("low").alias("band"))


_LOGS = "logs AS (SELECT l_suppkey AS table_id, l_orderkey AS id, CAST(l_shipdate AS DATE) AS day, l_quantity AS minutes, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END AS status FROM lineitem)"


def sync_logs(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for logs of table loads."""
    status = F.when(F.col("l_returnflag") == "R", "failed").otherwise("success")
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("table_id"), F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("minutes"), status.alias("status"))


@query(f"WITH {_LOGS} SELECT table_id, count(*) AS attempts, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'failed') AS failures, max(day) AS latest, max(minutes) AS longest FROM logs WHERE day >= DATE '1998-06-01' GROUP BY 1")
def sync_statistics(spark: SparkSession, d: str) -> DataFrame:
    logs = sync_logs(spark, d).filter("day >= date '1998-06-01'")
    return logs.groupBy("table_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"), F.max("day").alias("latest"), F.max("minutes").alias("longest"))


@query(f"""WITH {_LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY day DESC, id DESC, minutes DESC) AS i FROM logs)
SELECT count(*) AS tables, count(*) FILTER (WHERE status = 'success') AS successes, CAST(sum(minutes) AS DOUBLE) AS minutes, round(avg(minutes), 4) AS average, round(100.0 * count(*) FILTER (WHERE status = 'success') / count(*), 4) AS rate FROM r WHERE i = 1""")
def daily_etl_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the latest log of each table; max_by keeps the aggregate partial."""
    last = sync_logs(spark, d).groupBy("table_id").agg(F.max_by(F.struct("status", "minutes"), F.struct("day", "id", "minutes")).alias("l")).select("table_id", "l.*")
    good = F.count_if(F.col("status") == "success")
    return last.agg(F.count("*").alias("tables"), good.alias("successes"), F.sum("minutes").alias("minutes"), F.round(F.avg("minutes"), 4).alias("average"), F.round(good * 100.0 / F.count("*"), 4).alias("rate"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def counts_per_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))


def kpi(df: DataFrame) -> DataFrame:
    """The value of an indicator's query as text, one row: the first column if the query is one aggregate over all rows, else its number of rows; null is 0."""
    plan = df._jdf.queryExecution().analyzed()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "SubqueryAlias", "View", "Sort", "WithCTE"):
        plan = plan.plan() if kind == "WithCTE" else plan.child()
    whole = plan.getClass().getSimpleName() == "Aggregate" and plan.groupingExpressions().isEmpty()
    value = F.coalesce(F.first(df[df.columns[0]]).cast("string"), F.lit("0")) if whole else F.count("*").cast("string")
    return df.agg(value.alias("value"))


_CARDS = (("open_cases", "SELECT count(*) AS n FROM acct WHERE state = 'O'"), ("failed", "SELECT account_id FROM acct WHERE state = 'F'"), ("none", "SELECT max(account_id) AS m FROM acct WHERE account_id < 0"), ("largest", "SELECT max(account_id) AS m FROM acct"))


@query(SQL + "SELECT 1 AS position, 'open_cases' AS card, CAST(count(*) AS VARCHAR) AS value FROM acct WHERE state = 'O' UNION ALL SELECT 2, 'failed', CAST(count(*) AS VARCHAR) FROM acct WHERE state = 'F' UNION ALL SELECT 3, 'none', '0' UNION ALL SELECT 4, 'largest', CAST(max(account_id) AS VARCHAR) FROM acct")
def kpi_cards(spark: SparkSession, d: str) -> DataFrame:
    """An ordered list of indicators, each from a user's query over a secured view."""
    views = {"acct": secured(accounts(spark, d))}
    rows = [kpi(run_user_query(spark, sql, views)).select(F.lit(i + 1).alias("position"), F.lit(name).alias("card"), "value") for i, (name, sql) in enumerate(_CARDS)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


MEASURES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def measured(df: DataFrame, rows: list[str], measures: dict[str, str], columns: str | None = None, values: list | None = None) -> DataFrame:
    """A report over chosen dimensions and measures (column: sum, avg, min or max), perhaps with a dimension's values as columns."""
    grouped = df.groupBy(*rows)
    if columns:
        grouped = grouped.pivot(columns, values)
    return grouped.agg(*(MEASURES[how](c).alias(f"{c}_{how}") for c, how in measures.items()))


@query(SQL + "SELECT sector, " + ", ".join(f"CAST(max(score) FILTER (WHERE branch_id = {b}) AS DOUBLE) AS b{b}_score_max, CAST(sum(branch_id) FILTER (WHERE branch_id = {b}) AS BIGINT) AS b{b}_branch_id_sum" for b in (1, 2, 3)) + " FROM cust GROUP BY 1")
def chosen_measures(spark: SparkSession, d: str) -> DataFrame:
    out = measured(customers(spark, d), ["sector"], {"score": "max", "branch_id": "sum"}, "branch_id", [1, 2, 3])
    return out.select("sector", *(F.col(f"{b}_{c}").cast(t).alias(f"b{b}_{c}") for b in (1, 2, 3) for c, t in (("score_max", "double"), ("branch_id_sum", "bigint"))))


@query(SQL + "SELECT account_id, line, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, lag(CAST(amount AS DOUBLE)) OVER v AS previous, lead(CAST(amount AS DOUBLE)) OVER v AS following, first_value(CAST(amount AS DOUBLE)) OVER v AS first FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY quantity DESC), v AS (PARTITION BY account_id ORDER BY date_created, line, part_id, channel_id, amount)")
def ranks_and_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w, v = Window.partitionBy("account_id").orderBy(F.desc("quantity")), Window.partitionBy("account_id").orderBy("date_created", "line", "part_id", "channel_id", "amount")
    amount = F.col("amount").cast("double")
    return transactions(spark, d).select("account_id", "line", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.lag(amount).over(v).alias("previous"), F.lead(amount).over(v).alias("following"), F.first(amount).over(v).alias("first"))


@query(SQL + "SELECT branch, sector, coalesce(p_brand, 'none') AS brand, r_name AS region, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM txn JOIN acct USING (account_id) LEFT JOIN cust USING (customer_id) LEFT JOIN branch USING (branch_id) LEFT JOIN region ON r_regionkey = region_id LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON p_partkey = part_id GROUP BY ALL")
def ledger_six_way(spark: SparkSession, d: str) -> DataFrame:
    """A ledger over six tables, inner and left. Lines are summed by account and part first, and dimensions are joined to each other before they meet the sums."""
    part = load(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"))
    region = load(spark, d, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))
    own = customers(spark, d).join(branches(spark, d), "branch_id", "left").join(region, "region_id", "left").select("customer_id", "branch", "sector", "region")
    lines = transactions(spark, d).join(part, "part_id", "left").groupBy("account_id", F.coalesce("brand", F.lit("none")).alias("brand")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    rows = lines.join(accounts(spark, d).select("account_id", "customer_id").join(own, "customer_id", "left"), "account_id")
    return rows.groupBy("branch", "sector", "brand", "region").agg(F.sum("n").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query(SQL + "SELECT a.account_id, CAST(a.balance - coalesce(sum(t.amount) FILTER (WHERE t.date_created <= a.opened + 30), 0) AS DOUBLE) AS rest FROM acct a LEFT JOIN txn t ON t.account_id = a.account_id AND t.date_created BETWEEN a.opened AND a.opened + 60 GROUP BY a.account_id, a.balance")
def interval_join_rest(spark: SparkSession, d: str) -> DataFrame:
    """What is left of an account after the lines of its first 30 days: a range predicate beside the key, so the join stays a hash join."""
    a = accounts(spark, d).select("account_id", "opened", "balance")
    t = transactions(spark, d).select("account_id", "date_created", "amount")
    within = t.join(a.select("account_id", "opened"), "account_id").filter("date_created between opened and date_add(opened, 30)").groupBy("account_id").agg(F.sum("amount").alias("s"))
    return a.join(within, "account_id", "left").select("account_id", (F.col("balance") - F.coalesce("s", F.lit(0))).cast("double").alias("rest"))


@query(SQL + f"SELECT branch_id, {mean_sql('sum(CAST(score * 100 AS BIGINT))', 'count(*)')} AS cents, CAST(sum(score) AS DOUBLE) AS total FROM cust GROUP BY 1")
def rounded_means(spark: SparkSession, d: str) -> DataFrame:
    """Means rounded half up on decimals, as a database rounds; scalars.bankers rounds half to even, as Python does."""
    return customers(spark, d).groupBy("branch_id").agg(F.round(F.sum("score") / F.count("score"), 2).cast("double").alias("cents"), total("score").alias("total"))
