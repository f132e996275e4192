"""Transaction screening, customer risk scores and list screening.

Rules are (id, priority, level, condition): all conditions of a rule set are evaluated in one pass over the rows, as an array of
hits, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, customers, transactions

RANK = {"low": 1, "medium": 2, "high": 3}


@dataclass(frozen=True)
class Rule:
    """condition is a SQL expression over the rows; a null or false one is no hit."""

    id: int
    priority: int
    level: str
    condition: str
    score: float = 0.0
    universe: str | None = None
    subject: str | None = None


def hits(rules: list[Rule]) -> Column:
    """The array of rules that hold for a row, by priority, then id."""
    ordered = sorted(rules, key=lambda r: (r.priority, r.id))
    each = [F.when(F.expr(r.condition), F.struct(F.lit(r.id).alias("rule"), F.lit(r.level).alias("level"), F.lit(RANK[r.level]).alias("rank"), F.lit(r.score).alias("score"), F.lit(r.universe).cast("string").alias("universe"), F.lit(r.subject).cast("string").alias("subject"))) for r in ordered]
    return F.array_compact(F.array(*each))


def screen(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with hits, rule_id (the last hit by priority, null without one) and level (the highest hit; low without one)."""
    out = rows.withColumn("hits", hits(rules))
    top = F.array_max(F.transform("hits", lambda h: h["rank"]))
    return out.withColumn("rule_id", F.try_element_at("hits", F.lit(-1))["rule"]).withColumn("level", F.when(top == 3, "high").when(top == 2, "medium").otherwise("low"))


def combine(scores: str, how: str) -> Column:
    """Of an array of scores: max of all, avg or sum of those above 0; 0 without any."""
    positive = F.filter(scores, lambda x: x > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce({"max": F.array_max(scores), "sum": total, "avg": F.try_divide(total, F.size(positive))}[how], F.lit(0.0))


def composite(hits_column: str, rules: list[Rule], weights: dict[str, float], how: str = "avg") -> Column:
    """The weighted composite of an array of hits. Scores add up by universe and subject; a universe's score is the mean, maximum or sum of its subjects' sums above
    0, times its weight in percent. Hits without a subject and universes without a weight above 0 add nothing; rounded half up to cents.
    """

    def part(universe: str, weight: float) -> Column:
        subjects = sorted({r.subject for r in rules if r.universe == universe and r.subject})
        of = lambda subject: F.filter(hits_column, lambda h: (h["universe"] == universe) & (h["subject"] == subject))
        own = [F.aggregate(of(s), F.lit(0.0), lambda a, h: a + h["score"]) for s in subjects]
        positive = F.filter(F.array(*own), lambda x: x > 0)
        total = F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)
        value = {"sum": total, "avg": F.try_divide(total, F.size(positive)), "max": F.array_max(positive)}[how]
        return F.coalesce(value, F.lit(0.0)) * weight / 100

    parts = [part(u, w) for u, w in weights.items() if w > 0]
    return F.round(sum(parts[1:], parts[0]), 2) if parts else F.lit(0.0)


def band(score: Column, limits: tuple[float, float]) -> Column:
    """low up to the first limit, medium up to the second, else high; null is low."""
    return F.when(score <= limits[0], "low").when(score <= limits[1], "medium").when(score.isNull(), "low").otherwise("high")


TXN_RULES = [Rule(1, 1, "high", "amount > 50000"), Rule(2, 2, "medium", "quantity > 45"), Rule(3, 3, "low", "discount >= 0.09"), Rule(4, 4, "high", "flag = 'R' and amount > 20000")]
PLANS = [
    Rule(1, 1, "high", "score > 8000", 9.0, "customer", "wealth"), Rule(2, 2, "medium", "score > 4000", 5.0, "customer", "wealth"), Rule(3, 3, "low", "sector = 'BUILDING'", 2.0, "product", "sector"),
    Rule(4, 4, "high", "n_accounts > 15", 7.0, "product", "accounts"), Rule(5, 5, "high", "score > 1000000", 10.0, "customer", "wealth"), Rule(6, 6, "medium", "score < 0", 4.0, "customer", "debt"), Rule(7, 7, "low", "branch_id = 3", 6.0, "customer"),
]
_COND = ["amount > 50000", "quantity > 45", "discount >= 0.09", "flag = 'R' AND amount > 20000"]
_HITS = " UNION ALL ".join(f"SELECT customer_id, {p.score}::DOUBLE AS s, '{p.universe}' AS universe, {repr(p.subject) if p.subject else 'NULL'} AS subject FROM base WHERE {p.condition}" for p in PLANS)
_PLANS = SQL + f", n AS (SELECT customer_id, count(*) AS n_accounts FROM acct GROUP BY 1), base AS (SELECT * FROM cust LEFT JOIN n USING (customer_id)), h AS ({_HITS})"


@query(SQL + f", h AS (SELECT account_id, line, {', '.join(f'({c}) AS h{i + 1}' for i, c in enumerate(_COND))} FROM txn) SELECT account_id, line, CASE WHEN h4 THEN 4 WHEN h3 THEN 3 WHEN h2 THEN 2 WHEN h1 THEN 1 END AS rule_id, CASE WHEN h1 OR h4 THEN 'high' WHEN h2 THEN 'medium' ELSE 'low' END AS level, h1::INT + h2::INT + h3::INT + h4::INT AS n_hits FROM h")
def txn_screening_rules(spark: SparkSession, d: str) -> DataFrame:
    return screen(transactions(spark, d), TXN_RULES).select("account_id", "line", "rule_id", "level", F.size("hits").alias("n_hits"))


@query(SQL + ", h AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS rule FROM txn WHERE {c}" for i, c in enumerate(_COND)) + ") SELECT rule, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, rule LIMIT 10")
def top_rules_hits(spark: SparkSession, d: str) -> DataFrame:
    each = transactions(spark, d).select(F.explode(hits(TXN_RULES)).alias("h")).groupBy(F.col("h.rule").alias("rule")).agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "rule").limit(10)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    n = accounts(spark, d).groupBy("customer_id").agg(F.count("*").alias("n_accounts"))
    rows = customers(spark, d).join(n, "customer_id", "left").withColumn("hits", hits(PLANS))
    return rows.withColumn("scores", F.transform("hits", lambda h: h["score"]))


@query(_PLANS + """, s AS (SELECT customer_id, coalesce(max(h.s), 0) AS score_max, coalesce(sum(h.s) FILTER (WHERE h.s > 0), 0) AS score_sum, coalesce(avg(h.s) FILTER (WHERE h.s > 0), 0) AS score_avg FROM cust LEFT JOIN h USING (customer_id) GROUP BY 1)
SELECT customer_id, score_max, score_sum, score_avg, CASE WHEN score_max <= 3 THEN 'low' WHEN score_max <= 6 THEN 'medium' ELSE 'high' END AS band FROM s""")
def risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """The customers' plan scores combined by maximum, sum and mean, and the band of the maximum."""
    s = _scored(spark, d).select("customer_id", combine("scores", "max").alias("score_max"), combine("scores", "sum").alias("score_sum"), combine("scores", "avg").alias("score_avg"))
    return s.withColumn("band", band(F.col("score_max"), (3.0, 6.0)))


@query(_PLANS + """, t AS (SELECT customer_id, universe, subject, sum(s) AS s FROM h WHERE subject IS NOT NULL GROUP BY ALL HAVING sum(s) > 0), u AS (SELECT customer_id, universe, avg(s) AS s FROM t GROUP BY ALL),
c AS (SELECT customer_id, round(coalesce(sum(s * CASE universe WHEN 'customer' THEN 60 ELSE 40 END / 100), 0), 2) AS composite FROM cust LEFT JOIN u USING (customer_id) GROUP BY 1)
SELECT customer_id, composite, CASE WHEN composite <= 2 THEN 'low' WHEN composite <= 4 THEN 'medium' ELSE 'high' END AS band FROM c""")
def risk_composite(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("customer_id", composite("hits", PLANS, {"customer": 60.0, "product": 40.0}).alias("composite"))
    return s.withColumn("band", band(F.col("composite"), (2.0, 4.0)))


@query(SQL + """, r AS (SELECT customer_id, product, balance, row_number() OVER (PARTITION BY customer_id, product ORDER BY opened DESC, account_id DESC) AS i FROM acct WHERE product = '1-URGENT' AND balance > 50000 OR product = '2-HIGH' AND state = 'F')
SELECT c.customer_id, CAST(coalesce(a.balance, e.balance, c.score) AS DOUBLE) AS score FROM cust c LEFT JOIN r a ON a.customer_id = c.customer_id AND a.product = '1-URGENT' AND a.i = 1 LEFT JOIN r e ON e.customer_id = c.customer_id AND e.product = '2-HIGH' AND e.i = 1""")
def risk_override_latest(spark: SparkSession, d: str) -> DataFrame:
    """A customer's latest assessment overrides the score, else the latest approved due diligence does; urgent and high accounts stand in for them. max_by keeps the aggregate partial."""
    latest = lambda on: F.max_by("balance", F.when(F.expr(on), F.struct("opened", "account_id")))
    last = accounts(spark, d).groupBy("customer_id").agg(latest("product = '1-URGENT' and balance > 50000").alias("assessed"), latest("product = '2-HIGH' and state = 'F'").alias("diligence"))
    return customers(spark, d).join(last, "customer_id", "left").select("customer_id", F.coalesce("assessed", "diligence", "score").cast("double").alias("score"))


def normal(name: Column) -> Column:
    """A name's normal form: lower case without blanks."""
    return F.replace(F.lower(name), F.lit(" "))


def screen_names(people: DataFrame, listed: DataFrame) -> DataFrame:
    """people(id, first, last) against listed(entry, name, first, last): equal full names, or equal first and last; the smallest entry of each. Empty names match nothing.

    The either-or match is two hash joins, for one join on a disjunction would compare all pairs; the list has one row per name, so a common name multiplies nothing.
    """
    p = people.select("id", normal(F.concat("first", "last")).alias("full"), normal(F.col("first")).alias("f"), normal(F.col("last")).alias("l"))
    e = listed.select("entry", normal(F.col("name")).alias("full"), normal(F.col("first")).alias("f"), normal(F.col("last")).alias("l"))
    by_full = e.filter("full != ''").groupBy("full").agg(F.min("entry").alias("entry"))
    by_parts = e.filter("f != '' and l != ''").groupBy("f", "l").agg(F.min("entry").alias("entry"))
    both = p.join(by_full, "full").select("id", "entry").unionByName(p.join(by_parts, ["f", "l"]).select("id", "entry"))
    return both.groupBy("id").agg(F.min("entry").alias("entry"))


@query("""WITH p AS (SELECT c_custkey AS id, split_part(c_name, '#', 1) AS first, split_part(c_name, '#', 2) AS last FROM customer),
e AS (SELECT c_custkey AS entry, CASE WHEN c_custkey % 2 = 0 THEN upper(replace(c_name, '#', ' ')) ELSE 'x' END AS name, split_part(c_name, '#', 1) AS first, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' || split_part(c_name, '#', 2) || ' ' END AS last FROM customer WHERE c_acctbal > 9000)
SELECT p.id, min(e.entry) AS entry FROM p JOIN e ON (replace(lower(p.first || p.last), ' ', '') = replace(lower(e.name), ' ', '') AND trim(e.name) <> '') OR (trim(e.first) <> '' AND trim(e.last) <> '' AND replace(lower(p.first), ' ', '') = replace(lower(e.first), ' ', '') AND replace(lower(p.last), ' ', '') = replace(lower(e.last), ' ', '')) GROUP BY 1""")
def screen_name_or(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    first, last = F.split_part("name", F.lit("#"), F.lit(1)), F.split_part("name", F.lit("#"), F.lit(2))
    people = c.select(F.col("customer_id").alias("id"), first.alias("first"), last.alias("last"))
    even = F.col("customer_id") % 2 == 0
    listed = c.filter("score > 9000").select(F.col("customer_id").alias("entry"), F.when(even, F.upper(F.replace("name", F.lit("#"), F.lit(" ")))).otherwise("x").alias("name"), first.alias("first"), F.when(even, "").otherwise(F.concat(F.lit(" "), last, F.lit(" "))).alias("last"))
    return screen_names(people, listed)


@query(SQL + ", r AS (SELECT account_id, customer_id, row_number() OVER (PARTITION BY customer_id, opened ORDER BY account_id) AS i FROM acct) SELECT account_id, CASE WHEN i > 1 THEN 'duplicate' ELSE 'pending' END AS status FROM r")
def dup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("customer_id", "opened").orderBy("account_id")
    return accounts(spark, d).select("account_id", F.when(F.row_number().over(w) > 1, "duplicate").otherwise("pending").alias("status"))


@query(SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY opened DESC, account_id DESC) AS i FROM acct) SELECT customer_id, account_id, CAST(balance AS DOUBLE) AS balance FROM r WHERE i = 1")
def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    last = accounts(spark, d).groupBy("customer_id").agg(F.max_by(F.struct("account_id", "balance"), F.struct("opened", "account_id")).alias("r"))
    return last.select("customer_id", "r.account_id", F.col("r.balance").cast("double").alias("balance"))
