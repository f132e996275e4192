"""Rules written as SQL templates, pay rules, report items, re-screening and the ageing of cases."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators.rules import RANK, Rule, hits, screen_names
from lakewarden.plans.secure import _each, check_query
from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, SQL, accounts, branches, customers, dealt, load, parts_for, transactions

#: Placeholders of a rule's SQL and the transaction's columns that they stand for.
PLACEHOLDERS = {"#TRANSACTION_ID#": "id", "#AMOUNT#": "amount", "#ACCOUNT_ID#": "account_id", "#CUSTOMER_ID#": "customer_id", "#TRAN_DATE#": "date_created", "#BRANCH_ID#": "branch_id", "#CURRENCY_ID#": "currency_id"}


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _lookup(spark: SparkSession, sql: str) -> tuple[str, str, tuple[tuple[str, str], ...], str] | None:
    """(table, alias, (its column, the row's column) pairs, the rest of the condition) of a rule that looks for a row of one table by equalities; None for any other.

    All columns must be qualified, and the select list plain: an aggregate returns a row whatever it finds.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if _kind(plan) != "Project" or _kind(plan.child()) != "Filter" or any(_kind(x) not in ("Literal", "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "Alias") or _holds(x, ("UnresolvedFunction",)) for x in _each(plan.projectList())):
        return None
    below = plan.child().child()
    if _kind(below) != "SubqueryAlias" or _kind(below.child()) != "UnresolvedRelation":
        return None
    alias, table = str(below.alias()), ".".join(str(x) for x in _each(below.child().multipartIdentifier()))
    pairs, rest, waiting = [], [], [plan.child().condition()]
    while waiting:
        node = waiting.pop()
        if _kind(node) == "And":
            waiting += [node.right(), node.left()]
            continue
        if _holds(node, ("ScalarSubquery", "Exists", "InSubquery", "ListQuery")) or not _qualified(node):
            return None
        sides = [[str(x) for x in _each(n.nameParts())] if _kind(n) == "UnresolvedAttribute" else [] for n in _each(node.children())]
        if _kind(node) == "EqualTo" and sorted(len(x) for x in sides) == [2, 2] and {sides[0][0], sides[1][0]} == {alias, "screened_row"}:
            own, outer = sides if sides[0][0] == alias else sides[::-1]
            pairs.append((own[1], outer[1]))
        else:
            rest.append(f"({node.sql()})")
    return (table, alias, tuple(sorted(pairs)), " AND ".join(rest) or "true") if pairs else None


def _holds(node, kinds: Sequence[str]) -> bool:
    return _kind(node) in kinds or any(_holds(x, kinds) for x in _each(node.children()))


def _qualified(node) -> bool:
    return (_kind(node) != "UnresolvedAttribute" or len(_each(node.nameParts())) == 2) and all(map(_qualified, _each(node.children())))


BITS = 10  #: rules whose hits are the bits of one number; with more, generated code would be too long to be compiled


def hit_lists(rows: DataFrame, rules: Sequence[Rule], tables: dict[str, DataFrame], keys: Sequence[str], parts: int = 0) -> DataFrame:
    """keys, hits: for rows with any, the rules (rule, priority, level) whose SQL (their condition, with placeholders for the row's values) returns any row; keys tell rows apart.

    A placeholder is the outer row's column, and a rule's SQL is checked like a user's query. Rules that look into one table by the same key are one join, whatever their number; any
    other rule is a semi-join of its own. Hits are bits until the end, and only rows with any are grouped; parts: tasks that rows are dealt to for each look-up and the grouping, if not Spark's number.
    """
    spark = rows.sparkSession
    own_names = {name: f"rule_{uuid.uuid4().hex}" for name in [*tables, "screened_rows"]}  # views of this call alone
    for name, df in {**tables, "screened_rows": rows}.items():
        df.createTempView(own_names[name])
    seen = ", ".join(f"`{name}` AS (TABLE {own_names[name]})" for name in tables)
    words = [f"_m{w}" for w in range(-(-len(rules) // BITS))]
    none, bit = F.lit(0).cast("long"), lambda i: F.lit(1 << i % BITS).cast("long")
    mask = lambda m, on: reduce(Column.bitwiseOR, (F.when(c, bit(i)).otherwise(none) for i, c in on if words[i // BITS] == m), none).alias(m)
    found, alike = [], {}
    for i, r in enumerate(rules):
        sql = reduce(lambda s, p: s.replace(p, f"screened_row.{PLACEHOLDERS[p]}"), PLACEHOLDERS, r.condition)
        check_query(spark, sql, list(tables))
        if (shape := _lookup(spark, sql)) and shape[0] in tables:
            alike.setdefault(shape[:3], []).append((i, shape[3]))
        else:
            own = spark.sql(f"WITH {seen} SELECT {', '.join(keys)} FROM {own_names['screened_rows']} AS screened_row WHERE EXISTS ({sql})")
            found.append(own.select(*keys, *(mask(m, [(i, F.lit(True))]) for m in words)))
    for (table, alias, pairs), group in alike.items():
        on = reduce(lambda a, b: a & b, (F.col(f"{alias}.{c}") == F.col(f"screened_row.{o}") for c, o in pairs))
        by = list(dict.fromkeys(o for _, o in pairs))
        met, tests = dealt(rows, parts, *by).alias("screened_row").join(tables[table].alias(alias), on), [(i, F.expr(rest)) for i, rest in group]
        if len(tests) <= BITS:
            met = met.filter(reduce(Column.__or__, (c for _, c in tests)))
        own = list(dict.fromkeys(words[i // BITS] for i, _ in tests))
        if parts and not set(by) <= set(keys):
            met = met.select(*(F.col(f"screened_row.{k}").alias(k) for k in keys), *(mask(m, tests) for m in own))
            flags = dealt(met, parts, *keys).groupBy(*keys).agg(*(F.bit_or(m).alias(m) for m in own))
        else:
            flags = met.groupBy(*(F.col(f"screened_row.{k}").alias(k) for k in keys)).agg(*(F.bit_or(mask(m, tests)).alias(m) for m in own))
        found.append(flags.filter(" or ".join(f"{m} != 0" for m in own)).select(*keys, *(F.col(m) if m in own else none.alias(m) for m in words)))
    for name in own_names.values():
        spark.catalog.dropTempView(name)
    every = found[0]
    if len(found) > 1 or not alike:
        every = dealt(reduce(DataFrame.unionByName, found), parts, *keys).groupBy(*keys).agg(*(F.bit_or(m).alias(m) for m in words))
    told = lambda r: F.struct(F.lit(r.id).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.level).alias("level"))
    each = F.array_compact(F.array(*(F.when(F.col(words[i // BITS]).bitwiseAND(bit(i)) != 0, told(r)) for i, r in enumerate(rules))))
    return every.select(*keys, each.alias("hits"))


def template_hits(rows: DataFrame, rules: Sequence[Rule], tables: dict[str, DataFrame], keys: Sequence[str], parts: int = 0) -> DataFrame:
    """keys, rule, priority, level: a row for each hit of hit_lists."""
    return hit_lists(rows, rules, tables, keys, parts).select(*keys, F.inline("hits"))


SQL_RULES = [
    Rule(1, 1, "medium", "SELECT 1 FROM known_accounts a WHERE a.account_id = #ACCOUNT_ID# AND a.balance < #AMOUNT#"),
    Rule(2, 2, "high", "SELECT a.account_id FROM known_accounts a WHERE a.account_id = #ACCOUNT_ID# AND a.opened > #TRAN_DATE# AND #AMOUNT# > 1000"),
    Rule(3, 3, "low", "SELECT 1 FROM known_accounts a WHERE a.account_id = #ACCOUNT_ID# AND a.state = 'P'"),
]


@query(SQL + """, h AS (SELECT t.account_id, line, part_id, channel_id, date_created, a.balance < amount AS h1, a.opened > date_created AND amount > 1000 AS h2, a.state = 'P' AS h3 FROM txn t JOIN acct a USING (account_id))
SELECT account_id, line, part_id, channel_id, date_created, CASE WHEN h3 THEN 3 WHEN h2 THEN 2 ELSE 1 END AS rule_id, CASE WHEN h2 THEN 'high' WHEN h1 THEN 'medium' ELSE 'low' END AS level, h1::INT + h2::INT + h3::INT AS n_hits FROM h WHERE h1 OR h2 OR h3""")
def sql_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with a hit of a SQL rule: the last by priority, the highest level, and how many there are."""
    keys = ["account_id", "line", "part_id", "channel_id", "date_created"]  # lines have no id of their own
    parts = parts_for(load(spark, d, "lineitem"))
    found = hit_lists(transactions(spark, d), SQL_RULES, {"known_accounts": accounts(spark, d)}, keys, parts)
    rank = F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))))
    last = F.array_max(F.transform("hits", lambda h: F.struct(h["priority"].alias("priority"), h["rule"].alias("rule"))))["rule"]
    highest = F.array_max(F.transform("hits", lambda h: F.struct(F.element_at(rank, h["level"]).alias("rank"), h["level"].alias("level"))))["level"]
    return found.select(*keys, last.alias("rule_id"), highest.alias("level"), F.size("hits").alias("n_hits"))


def pay_lines(rows: DataFrame, rules: Sequence[tuple[str, str, str, Column, Column | None]]) -> DataFrame:
    """rows with a column per pay rule (code, category, kind, amount, condition), in order. kind: fix, or percent of a base that may name earlier rules
    and categories; a rule whose condition does not hold gives 0. A category is the sum of its rules so far, in a column of its name."""
    for category in dict.fromkeys(c for _, c, *_ in rules):
        rows = rows.withColumn(category, F.lit(0.0))
    for code, category, kind, amount, condition in rules:
        value = amount if kind == "fix" else amount / 100
        own = F.coalesce(F.when(condition, value), F.lit(0.0)) if condition is not None else value
        rows = rows.withColumn(code, F.round(own, 4)).withColumn(category, F.col(category) + F.col(code))
    return rows


@query(SQL + """, b AS (SELECT customer_id, CAST(coalesce(sum(balance), 0) AS DOUBLE) AS base FROM cust LEFT JOIN acct USING (customer_id) GROUP BY 1),
x AS (SELECT *, round(base, 4) AS basic, round(CASE WHEN base BETWEEN 100000 AND 900000 THEN base * 10 / 100 ELSE 0 END, 4) AS bonus FROM b), y AS (SELECT *, round((basic + bonus) * 20 / 100, 4) AS tax FROM x)
SELECT customer_id, basic, bonus, tax, round(basic + bonus - tax, 2) AS net FROM y""")
def pay_rules(spark: SparkSession, d: str) -> DataFrame:
    """A pay slip's lines: a basic amount, a bonus for a range of it, and a tax on the sum of both."""
    a = accounts(spark, d).groupBy("customer_id").agg(F.sum("balance").alias("b"))
    rows = customers(spark, d).select("customer_id").join(a, "customer_id", "left").select("customer_id", F.coalesce("b", F.lit(0)).cast("double").alias("base"))
    rules = [("basic", "gross", "fix", F.col("base"), None), ("bonus", "gross", "percent", F.col("base") * 10, F.col("base").between(100000, 900000)), ("tax", "deduction", "percent", F.col("gross") * 20, None)]
    return pay_lines(rows, rules).select("customer_id", "basic", "bonus", "tax", F.round(F.col("gross") - F.col("deduction"), 2).alias("net"))


def report_items(spark: SparkSession, items: Sequence[tuple[str, str, str]], views: dict[str, DataFrame]) -> DataFrame:
    """name, row, value (as text) of a report's items: static texts, the first value of a query (sql_single), or all rows of its first column (sql_multi, by value)."""
    from pyspark.sql import Window

    from lakewarden.plans.secure import run_user_query

    out = []
    for name, kind, text in items:
        if kind == "static":
            out.append(spark.range(1).select(F.lit(name).alias("name"), F.lit(1).alias("row"), F.lit(text).alias("value")))
            continue
        df = run_user_query(spark, text, views)
        values = df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value"))
        if kind == "sql_single":
            out.append(values.limit(1).select(F.lit(name).alias("name"), F.lit(1).alias("row"), "value"))
        else:
            grouped = values.groupBy("value").agg(F.count("*").alias("n"))  # numbers are given to distinct values, of which a report has few
            first = F.coalesce(F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            out.append(grouped.withColumn("f", first).select(F.lit(name).alias("name"), F.explode(F.sequence((F.col("f") + 1).cast("int"), (F.col("f") + F.col("n")).cast("int"))).alias("row"), "value"))
    return reduce(DataFrame.unionByName, out)


@query(SQL + "SELECT 'title' AS name, 1 AS row, 'Customers' AS value UNION ALL SELECT 'count', 1, CAST(count(*) AS VARCHAR) FROM cust UNION ALL SELECT 'sectors', row_number() OVER (ORDER BY sector)::INT, sector FROM (SELECT DISTINCT sector FROM cust)")
def report_values(spark: SparkSession, d: str) -> DataFrame:
    items = [("title", "static", "Customers"), ("count", "sql_single", "SELECT count(*) FROM report_customer"), ("sectors", "sql_multi", "SELECT DISTINCT sector FROM report_customer")]
    return report_items(spark, items, {"report_customer": customers(spark, d)})


def screen_backlog(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows(state, rule_id, ...) with rule_id and state set where they are new and have no rule: one pass for all rules; it is the same projection for a batch and a stream."""
    last = F.try_element_at(hits(list(rules)), F.lit(-1))["rule"]
    waiting = (F.col("state") == "new") & F.col("rule_id").isNull()
    return rows.withColumns({"rule_id": F.when(waiting, last).otherwise(F.col("rule_id")), "state": F.when(waiting, "done").otherwise(F.col("state"))})


_BACKLOG = [Rule(1, 1, "high", "amount > 50000"), Rule(2, 2, "medium", "quantity > 45")]


@query(SQL + ", b AS (SELECT account_id, line, amount, quantity, CASE WHEN date_created >= DATE '1997-01-01' THEN 'new' ELSE 'done' END AS state, CASE WHEN line = 1 THEN 9 END AS rule_id FROM txn) SELECT account_id, line, CASE WHEN state = 'new' AND b.rule_id IS NULL THEN CASE WHEN quantity > 45 THEN 2 WHEN amount > 50000 THEN 1 END ELSE rule_id END AS rule_id, CASE WHEN state = 'new' AND b.rule_id IS NULL THEN 'done' ELSE state END AS state FROM b")
def backlog_screening(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("date_created") >= F.lit("1997-01-01").cast("date"), "new").otherwise("done")
    rows = transactions(spark, d).withColumn("state", new).withColumn("rule_id", F.when(F.col("line") == 1, 9))
    return screen_backlog(rows, _BACKLOG).select("account_id", "line", "rule_id", "state")


def rescreen(people: DataFrame, listed: DataFrame, lists: DataFrame) -> DataFrame:
    """The matches of people against entries of lists(list, last_updated, last_screening) that changed since they were screened, or never were."""
    changed = lists.filter("last_screening is null or last_updated > last_screening").select("list")
    return screen_names(people, listed.join(F.broadcast(changed), "list", "left_semi"))


@query(SQL + ", e AS (SELECT customer_id AS entry, lower(name) AS name, sector FROM cust WHERE score > 9000 AND sector IN ('BUILDING', 'MACHINERY')) SELECT c.customer_id AS id, min(entry) AS entry FROM cust c JOIN e ON replace(lower(c.name), ' ', '') = replace(e.name, ' ', '') GROUP BY 1")
def rescreen_changed_lists(spark: SparkSession, d: str) -> DataFrame:
    """Customers against the lists (here sectors of rich customers) that changed; the third list is up to date and is left out."""
    c = customers(spark, d)
    people = c.select(F.col("customer_id").alias("id"), F.col("name").alias("first"), F.lit("").alias("last"))
    listed = c.filter("score > 9000").select(F.col("customer_id").alias("entry"), F.upper("name").alias("name"), F.lit("").alias("first"), F.lit("").alias("last"), F.col("sector").alias("list"))
    lists = c.select(F.col("sector").alias("list")).distinct().select("list", F.lit(2).alias("last_updated"), F.when(F.col("list") == "BUILDING", 1).when(F.col("list") != "MACHINERY", 3).alias("last_screening"))
    return rescreen(people, listed, lists)


def aged(state: Column, day: Column, today: Column, overdue: int = 30, archived: int = 365) -> Column:
    """A case's state by its age: open ones are overdue after some days, closed ones are archived after more."""
    age = F.datediff(today, day)
    return F.when((state == "open") & (age > overdue), "overdue").when((state == "closed") & (age > archived), "archived").otherwise(state)


@query(SQL + f", c AS (SELECT account_id, opened, CASE WHEN state = 'O' THEN 'open' ELSE 'closed' END AS s FROM acct) SELECT account_id, CASE WHEN s = 'open' AND DATE '1998-06-01' - opened > 30 THEN 'overdue' WHEN s = 'closed' AND DATE '1998-06-01' - opened > 365 THEN 'archived' ELSE s END AS state FROM c")
def case_ageing(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("state") == "O", "open").otherwise("closed")
    return accounts(spark, d).select("account_id", aged(state, F.col("opened"), F.lit("1998-06-01").cast("date")).alias("state"))


def key_match(people: DataFrame, listed: DataFrame) -> DataFrame:
    """people(id, key) with entry of listed(entry, key): of an equal key, else of one that is equal once both are trimmed; the smallest of several. Blank keys match nothing."""
    exact = listed.groupBy("key").agg(F.min("entry").alias("exact"))
    near = listed.select("entry", F.trim("key").alias("t")).filter("t <> ''").groupBy("t").agg(F.min("entry").alias("near"))
    both = people.filter("trim(key) <> ''").join(exact, "key", "left").withColumn("t", F.trim("key")).join(near, "t", "left")
    return both.select("id", F.coalesce("exact", "near").alias("entry")).filter("entry is not null")


@query("""WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END || c_nationkey || '-' || c_mktsegment AS key, c_acctbal FROM customer), e AS (SELECT id AS entry, key FROM k WHERE c_acctbal > 8000),
x AS (SELECT key, min(entry) AS exact FROM e GROUP BY 1), n AS (SELECT trim(key) AS t, min(entry) AS near FROM e GROUP BY 1)
SELECT id, coalesce(exact, near) AS entry FROM k LEFT JOIN x USING (key) LEFT JOIN n ON t = trim(key) WHERE coalesce(exact, near) IS NOT NULL""")
def exact_then_trimmed(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    key = F.concat(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(""), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_mktsegment"))
    rows = c.select(F.col("c_custkey").alias("id"), key.alias("key"), "c_acctbal")
    return key_match(rows.select("id", "key"), rows.filter("c_acctbal > 8000").select(F.col("id").alias("entry"), "key"))


@query(SQL + f"SELECT account_id, datediff('day', opened, DATE '{AS_OF}') AS age FROM acct WHERE state = 'P' AND datediff('day', opened, DATE '{AS_OF}') > 0")
def pending_age(spark: SparkSession, d: str) -> DataFrame:
    a = accounts(spark, d).filter("state = 'P'")
    return a.select("account_id", F.datediff(F.lit(AS_OF).cast("date"), "opened").alias("age")).filter("age > 0")


def merge_matches(kept: DataFrame, found: DataFrame) -> DataFrame:
    """kept(customer_id, list, match_id, state, reviewed_by) after a run that found(customer_id, list, match_id): one active match for each customer and list.

    A first match is pending; the same one again changes nothing; another takes its place, pending and unreviewed; one not found again stays. Of several
    found in a run the last by match_id counts.
    """
    last = found.groupBy("customer_id", "list").agg(F.max("match_id").alias("_found"))
    both = kept.join(last, ["customer_id", "list"], "full")
    stays = F.col("_found").isNull() | F.coalesce(F.col("match_id") == F.col("_found"), F.lit(False))
    return both.select("customer_id", "list", F.coalesce("_found", "match_id").alias("match_id"), F.when(stays, F.col("state")).otherwise("pending").alias("state"), F.when(stays, F.col("reviewed_by")).alias("reviewed_by"))


_RUNS = ("score > 7000", "score > 4000 AND branch_id < 20", "score > 5000 AND branch_id > 3")
_MATCH = ("customer_id", "customer_id + CASE WHEN customer_id % 2 = 0 THEN 0 ELSE 1 END", "customer_id + CASE WHEN customer_id % 4 < 2 THEN 0 ELSE 1 END")
_REVIEW = "CASE WHEN state = 'pending' AND customer_id % 3 = 0 THEN 'confirmed' WHEN state = 'pending' AND customer_id % 3 = 1 THEN 'dismissed' ELSE state END"


def _merge_sql() -> str:
    run = lambda i: f"SELECT customer_id, sector AS list, {_MATCH[i]} AS m FROM cust WHERE {_RUNS[i]}"
    ctes = [f"k0 AS (SELECT customer_id, list, m AS match_id, 'pending' AS state, NULL AS reviewed_by FROM ({run(0)}))"]
    for i in (1, 2):
        reviewed = f"SELECT customer_id, list, match_id, {_REVIEW} AS state, CASE WHEN state = 'pending' AND customer_id % 3 < 2 THEN 'officer {i}' ELSE reviewed_by END AS reviewed_by FROM k{i - 1}"
        same = "f.m IS NULL OR f.m = k.match_id"
        ctes.append(f"k{i} AS (SELECT coalesce(k.customer_id, f.customer_id) AS customer_id, coalesce(k.list, f.list) AS list, coalesce(f.m, k.match_id) AS match_id, CASE WHEN {same} THEN k.state ELSE 'pending' END AS state, CASE WHEN {same} THEN k.reviewed_by END AS reviewed_by FROM ({reviewed}) k FULL JOIN ({run(i)}) f ON k.customer_id = f.customer_id AND k.list = f.list)")
    return ", ".join(ctes)


@query(SQL + ", " + _merge_sql() + " SELECT * FROM k2")
def screening_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of customers against lists, with officers' reviews between them."""
    c = customers(spark, d)
    kept = spark.createDataFrame([], "customer_id long, list string, match_id long, state string, reviewed_by string")
    for i, (on, match) in enumerate(zip(_RUNS, _MATCH)):
        if i:
            waiting = F.col("state") == "pending"
            by = F.when(waiting & (F.col("customer_id") % 3 < 2), f"officer {i}").otherwise(F.col("reviewed_by"))
            kept = kept.select("customer_id", "list", "match_id", F.expr(_REVIEW).alias("state"), by.alias("reviewed_by"))
        kept = merge_matches(kept, c.filter(on).select("customer_id", F.col("sector").alias("list"), F.expr(match).alias("match_id")))
    return kept


_MANY = [Rule(i, i, "low", f"SELECT 1 FROM known_accounts a WHERE a.account_id = #ACCOUNT_ID# AND a.balance * {i} < #AMOUNT# * 10") for i in range(1, 41)] + [Rule(i, i, "high", f"SELECT 1 FROM known_customers c WHERE #CUSTOMER_ID# = c.customer_id AND c.score > {250 * (i - 40)} AND #AMOUNT# > 70000") for i in range(41, 51)]


@query(SQL + ", b AS (SELECT t.account_id, line, part_id, channel_id, date_created, amount, balance, score FROM txn t JOIN acct USING (account_id) JOIN cust USING (customer_id)), h AS (SELECT *, " + " + ".join([f"(balance * {i} < amount * 10)::INT" for i in range(1, 41)] + [f"(score > {250 * (i - 40)} AND amount > 70000)::INT" for i in range(41, 51)]) + " AS n FROM b) SELECT n, count(*) AS rows FROM h WHERE n > 0 GROUP BY 1")
def sql_rules_many(spark: SparkSession, d: str) -> DataFrame:
    """Fifty SQL rules over two tables, as two joins: how many transactions have how many hits."""
    keys = ["account_id", "line", "part_id", "channel_id", "date_created"]
    parts = parts_for(load(spark, d, "lineitem"))
    rows = dealt(transactions(spark, d), parts, "account_id").join(accounts(spark, d).select("account_id", "customer_id"), "account_id")
    found = hit_lists(rows, _MANY, {"known_accounts": accounts(spark, d), "known_customers": customers(spark, d)}, keys, parts)
    return found.groupBy(F.size("hits").alias("n")).agg(F.count("*").alias("rows"))


def plan_scores(people: DataFrame, lines: Sequence[tuple[str, str, str, float, float | None]], tables: dict[str, DataFrame]) -> DataFrame:
    """customer_id, line, score of people(customer_id) for each plan line (name, sql, kind, score, rating) whose SQL, with %s for the customer, returns a row.

    kind: static gives the line's score, dynamic the first column's value (the largest of several rows; a null counts as no score), risk_assessment the rating of the line's assessment, or
    its score if there is none. Each line's SQL is checked like a user's query and is one join.
    """
    spark = people.sparkSession
    own_names = {name: f"plan_{uuid.uuid4().hex}" for name in [*tables, "scored_people"]}
    for name, df in {**tables, "scored_people": people}.items():
        df.createTempView(own_names[name])
    seen = ", ".join(f"`{name}` AS (TABLE {own_names[name]})" for name in tables)
    found = []
    for name, sql, kind, score, rating in lines:
        text = sql.replace("%s", "scored_person.customer_id")
        check_query(spark, text, list(tables))
        met = spark.sql(f"WITH {seen} SELECT scored_person.customer_id AS _person, plan_row.* FROM {own_names['scored_people']} AS scored_person JOIN LATERAL ({text}) AS plan_row")
        value = F.max(F.col(met.columns[1]).cast("double")) if kind == "dynamic" else F.lit(float(score if kind == "static" or rating is None else rating))
        found.append(met.groupBy(F.col("_person").alias("customer_id")).agg(value.alias("score")).filter("score is not null").select("customer_id", F.lit(name).alias("line"), "score"))
    for name in own_names.values():
        spark.catalog.dropTempView(name)
    return reduce(DataFrame.unionByName, found)


_LINES = [
    ("large", "SELECT a.balance / 100000 AS s FROM known_accounts a WHERE a.customer_id = %s AND a.state = 'P'", "dynamic", 1.0, None),
    ("urgent", "SELECT a.account_id FROM known_accounts a WHERE a.customer_id = %s AND a.product = '1-URGENT' AND a.balance > 300000", "static", 4.5, 9.0),
    ("assessed", "SELECT b.branch_id FROM known_branches b JOIN known_people p ON p.branch_id = b.branch_id WHERE p.customer_id = %s AND b.region_id = 2", "risk_assessment", 2.0, 7.25),
    ("unassessed", "SELECT p.customer_id FROM known_people p WHERE p.customer_id = %s AND p.score < 0", "risk_assessment", 3.0, None),
]


@query(SQL + """, l AS (SELECT customer_id, 'large' AS line, CAST(max(balance / 100000) AS DOUBLE) AS score FROM acct WHERE state = 'P' GROUP BY 1 UNION ALL SELECT DISTINCT customer_id, 'urgent', 4.5 FROM acct WHERE product = '1-URGENT' AND balance > 300000
UNION ALL SELECT customer_id, 'assessed', 7.25 FROM cust JOIN branch USING (branch_id) WHERE region_id = 2 UNION ALL SELECT customer_id, 'unassessed', 3.0 FROM cust WHERE score < 0)
SELECT l.customer_id, line, round(l.score, 4) AS score FROM l JOIN cust USING (customer_id)""")
def plan_line_scores(spark: SparkSession, d: str) -> DataFrame:
    tables = {"known_accounts": accounts(spark, d), "known_people": customers(spark, d), "known_branches": branches(spark, d)}
    return plan_scores(customers(spark, d).select("customer_id"), _LINES, tables).withColumn("score", F.round("score", 4))
