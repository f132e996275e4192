"""Predicates: text to domain, dotted paths, origins, periods, drill-downs, alert routing."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators.hierarchy import below
from lakewarden.plans.secure import Refused, _each, domain
from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, EVENTS_AS_OF, SQL, accounts, branches, customers, load, transactions

_COMPARE = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
_FLIP = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def where_domain(spark: SparkSession, text: str) -> list:
    """The WHERE text of a query as a domain in prefix notation. Spark's parser reads it, so precedence, parentheses and quotes are its own; what no domain can say is refused."""

    def literal(node):
        kind = node.getClass().getSimpleName()
        if kind == "UnaryMinus":
            return -literal(node.child())
        if kind != "Literal":
            raise Refused(f"{kind} is no plain value")
        value = node.value()
        return None if value is None else value if isinstance(value, (bool, int, float)) else int(str(value)) if str(value).lstrip("-").isdigit() and "String" not in node.dataType().toString() else float(str(value)) if "Decimal" in node.dataType().toString() else str(value)

    def field(node) -> str:
        if node.getClass().getSimpleName() != "UnresolvedAttribute":
            raise Refused("no field")
        return ".".join(str(x) for x in _each(node.nameParts()))

    def walk(node) -> list:
        kind = node.getClass().getSimpleName()
        if kind in ("And", "Or"):
            return ["&" if kind == "And" else "|", *walk(node.left()), *walk(node.right())]
        if kind == "Not":
            inner = walk(node.child())
            if len(inner) == 1 and inner[0][1] in ("=", "in", "ilike"):
                field_, op, value = inner[0]
                negated = (field_, {"=": "!=", "in": "not in", "ilike": "not ilike"}[op], value)
                return [negated] if value is None else ["&", negated, (field_, "!=", None)]  # a domain's negation keeps nulls, SQL's does not
            return ["!", *inner]
        if kind in _COMPARE:
            op = _COMPARE[kind]
            if node.left().getClass().getSimpleName() == "UnresolvedAttribute":
                return [(field(node.left()), op, literal(node.right()))]
            return [(field(node.right()), _FLIP[op], literal(node.left()))]
        if kind == "In":
            return [(field(node.value()), "in", [literal(x) for x in _each(node.list())])]
        if kind in ("IsNull", "IsNotNull"):
            return [(field(node.child()), "=" if kind == "IsNull" else "!=", None)]
        if kind in ("Like", "ILike"):
            pattern = literal(node.right())
            return [(field(node.left()), "=like" if kind == "Like" else "=ilike", pattern)]
        if kind == "Between" or kind == "UnresolvedFunction" and str(_each(node.nameParts())[0]).lower() == "between":
            value, low, high = _each(node.children())
            return ["&", (field(value), ">=", literal(low)), (field(value), "<=", literal(high))]
        raise Refused(f"{kind} has no place in a domain")

    return walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(text))


@query(SQL + "SELECT customer_id FROM cust WHERE (sector = 'BUILDING' OR branch_id IN (1, 2, 3) AND NOT sector = 'MACHINERY') AND score BETWEEN 1000 AND 8000 OR name LIKE '%9'")
def where_to_domain(spark: SparkSession, d: str) -> DataFrame:
    text = "(sector = 'BUILDING' OR branch_id IN (1, 2, 3) AND NOT sector = 'MACHINERY') AND score BETWEEN 1000 AND 8000 OR name LIKE '%9'"
    return customers(spark, d).filter(domain(where_domain(spark, text))).select("customer_id")


def with_paths(df: DataFrame, paths: Sequence[str], related: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """df with a column `a.b` (or `a.b.c`, ..) for each dotted path: field b of the table that related names for a (table, key), null where a has no row there. A table is joined once."""
    for link in sorted({p.split(".")[0] for p in paths}):
        if link not in related:
            raise ValueError(f"{link} leads to no table")
        table, key = related[link]
        inner = sorted({p.split(".", 1)[1] for p in paths if p.split(".")[0] == link})
        table = with_paths(table, [p for p in inner if "." in p], related)
        own = table.select(F.col(key).alias("_key"), *(F.col(f"`{p}`").alias(f"{link}.{p}") for p in inner)).dropDuplicates(["_key"])
        df = df.join(own, df[link] == F.col("_key"), "left").drop("_key")
    return df


@query(SQL + "SELECT account_id FROM acct JOIN cust USING (customer_id) LEFT JOIN branch USING (branch_id) WHERE sector = 'BUILDING' AND region_id <> 2 OR customer_id < 20")
def dotted_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = ["customer_id.sector", "customer_id.branch_id.region_id"]
    a = with_paths(accounts(spark, d), paths, {"customer_id": (customers(spark, d), "customer_id"), "branch_id": (branches(spark, d), "branch_id")})
    terms = ["|", "&", ("`customer_id.sector`", "=", "BUILDING"), ("`customer_id.branch_id.region_id`", "!=", 2), ("customer_id", "<", 20)]
    return a.filter(domain(terms)).select("account_id")


def under(df: DataFrame, field: str, roots: Sequence, edges: DataFrame) -> DataFrame:
    """child_of: rows whose field is one of the roots or lies below one, at any depth, in edges(node, parent)."""
    every = below(edges, edges.sparkSession.createDataFrame([(r,) for r in roots], edges.select("node").schema))
    return df.join(every, df[field] == every["node"], "left_semi")


@query(SQL + "SELECT customer_id FROM cust JOIN branch USING (branch_id) WHERE region_id IN (1, 3) OR branch_id = 5")
def child_of_branch(spark: SparkSession, d: str) -> DataFrame:
    """Customers of branches below two regions, or of one branch. Branches and regions share a tree of texts."""
    b = branches(spark, d).select(F.concat(F.lit("b"), F.col("branch_id").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("region_id").cast("string")).alias("parent"))
    c = customers(spark, d).withColumn("node_id", F.concat(F.lit("b"), F.col("branch_id").cast("string")))
    return under(c, "node_id", ["r1", "r3", "b5"], b).select("customer_id")


#: Origins of customers that reports show.
ORIGINS = ("demo", "test", "prod")


def of_origins(df: DataFrame, column: str = "origin", origins: Sequence[str] = ORIGINS) -> DataFrame:
    """The rows of shown origins; a null one is not shown. Views are wrapped once, so every query over them has the filter."""
    return df.filter(F.col(column).isin(*origins))


@query(SQL + "SELECT origin, count(*) AS n FROM (SELECT CASE sector WHEN 'BUILDING' THEN 'prod' WHEN 'MACHINERY' THEN 'demo' WHEN 'FURNITURE' THEN 'old' END AS origin FROM cust) WHERE origin IN ('demo', 'test', 'prod') GROUP BY 1")
def origin_filter(spark: SparkSession, d: str) -> DataFrame:
    origin = F.when(F.col("sector") == "BUILDING", "prod").when(F.col("sector") == "MACHINERY", "demo").when(F.col("sector") == "FURNITURE", "old")
    return of_origins(customers(spark, d).withColumn("origin", origin)).groupBy("origin").agg(F.count("*").alias("n"))


def in_period(c: Column, days: int, today: datetime.date, kind: str = "chart") -> Column:
    """Whether a time is in a period that ends today. chart: 0 today, 1 yesterday alone, 7 the last seven days, else the last thirty; kpi: today
    less the days up to today, both included; week: the same in dates for seven days."""
    at = lambda k: F.lit(today - datetime.timedelta(k)).cast("timestamp_ntz")
    if kind == "chart":
        first, last = {0: (0, 0), 1: (1, 1), 7: (6, 0)}.get(days, (29, 0))
    else:
        first, last = (7 if kind == "week" else days), 0
    return (c >= at(first)) & (c < at(last - 1))


@query(f"WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, DATE '{EVENTS_AS_OF}' AS today FROM events) SELECT event_type, count(*) FILTER (WHERE day = today - 1) AS chart_1, count(*) FILTER (WHERE day BETWEEN today - 29 AND today) AS chart_90, count(*) FILTER (WHERE day BETWEEN today - 3 AND today) AS kpi_3, count(*) FILTER (WHERE day BETWEEN today - 7 AND today) AS week FROM e GROUP BY 1")
def period_variants(spark: SparkSession, d: str) -> DataFrame:
    today, ts = datetime.date.fromisoformat(EVENTS_AS_OF), F.col("ts")
    kinds = {"chart_1": (1, "chart"), "chart_90": (90, "chart"), "kpi_3": (3, "kpi"), "week": (7, "week")}
    return load(spark, d, "events").groupBy("event_type").agg(*(F.count_if(in_period(ts, n, today, k)).alias(name) for name, (n, k) in kinds.items()))


def regulatory(kind: Column, amount: Column, limit: float) -> Column:
    """A currency or funds transfer report's condition: debits below minus the limit, credits above it."""
    return (kind == "D") & (amount < -limit) | (kind == "C") & (amount > limit)


@query(SQL + "SELECT account_id, line, kind = 'C' AND amount > 60000 AS ctr, kind = 'C' AND amount > 80000 AND product IN ('1-URGENT', '2-HIGH') AS ftr, coalesce(flag = 'R' AND discount >= 0.08, false) AS str FROM txn JOIN acct USING (account_id)")
def regulatory_reports(spark: SparkSession, d: str) -> DataFrame:
    """Which of the three reports a transaction belongs to: currency, foreign funds, suspicious."""
    t = transactions(spark, d).join(accounts(spark, d).select("account_id", "product"), "account_id")
    kind, amount = F.col("kind"), F.col("amount")
    return t.select("account_id", "line", regulatory(kind, amount, 60000).alias("ctr"), (regulatory(kind, amount, 80000) & F.col("product").isin("1-URGENT", "2-HIGH")).alias("ftr"), F.coalesce((F.col("flag") == "R") & (F.col("discount") >= 0.08), F.lit(False)).alias("str"))


#: Drill-downs: who, what state of review, since when, and which currency.
SCOPES = {"who": {"customer": "length = 10", "internal": "length <> 10"}, "review": {"all": "true", "awaiting": "state = 'O'", "reviewed": "state = 'F'"}, "since": {"today": 0, "week": 6}, "currency": {"local": "currency = 'NGN'", "other": "currency <> 'NGN' or currency is null"}}


def drill_down(df: DataFrame, who: str, review: str, since: str, currency: str, today: Column, branch_ids: Sequence[int] | None = None) -> DataFrame:
    """One of the named drill-downs over df(length, state, day, currency, branch_id); branch_ids None is no scope, an empty list sees nothing."""
    return df.filter(drill_condition(who, review, since, currency, today, branch_ids))


def drill_condition(who: str, review: str, since: str, currency: str, today: Column, branch_ids: Sequence[int] | None = None) -> Column:
    """The condition of a named drill-down, so that many can be counted in one pass."""
    out = F.expr(SCOPES["who"][who]) & F.expr(SCOPES["review"][review]) & F.expr(SCOPES["currency"][currency]) & F.col("day").between(F.date_sub(today, SCOPES["since"][since]), today)
    return out if branch_ids is None else out & (F.col("branch_id").isin(list(branch_ids)) if branch_ids else F.lit(False))


_DRILL = SQL + ", b AS (SELECT account_id, line, CASE WHEN channel_id % 3 = 0 THEN 14 ELSE 10 END AS length, state, date_created AS day, CASE WHEN quantity > 30 THEN 'NGN' WHEN quantity > 10 THEN 'USD' END AS currency, channel_id % 7 AS branch_id FROM txn)"
_NAMED = [(w, r, s, c) for w in SCOPES["who"] for r in SCOPES["review"] for s in SCOPES["since"] for c in SCOPES["currency"]]


@query(_DRILL + " " + " UNION ALL ".join(f"SELECT '{w}_{r}_{s}_{c}' AS name, count(*) AS n FROM b WHERE {SCOPES['who'][w]} AND {SCOPES['review'][r]} AND ({SCOPES['currency'][c]}) AND day BETWEEN DATE '1996-05-05' - {SCOPES['since'][s]} AND DATE '1996-05-05' AND branch_id IN (1, 2, 3)" for w, r, s, c in _NAMED))
def drill_downs(spark: SparkSession, d: str) -> DataFrame:
    """The row counts of all 24 named drill-downs in a scope of branches, in one pass."""
    quantity = F.col("quantity")
    t = transactions(spark, d).select("account_id", "line", F.when(F.col("channel_id") % 3 == 0, 14).otherwise(10).alias("length"), "state", F.col("date_created").alias("day"), F.when(quantity > 30, "NGN").when(quantity > 10, "USD").alias("currency"), (F.col("channel_id") % 7).alias("branch_id"))
    today = F.lit("1996-05-05").cast("date")
    counts = [F.struct(F.lit("_".join(x)).alias("name"), F.count_if(drill_condition(*x, today, [1, 2, 3])).alias("n")) for x in _NAMED]
    return t.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def in_list(c: Column, email: str, negated: bool = False) -> Column:
    """Whether a comma list holds an address, in any case, blanks aside; a null list holds none. Negation is the complement, null included."""
    found = F.coalesce(F.array_contains(F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x)), email.strip().lower()), F.lit(False))
    return ~found if negated else found


@query("WITH r AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN ' Ann@x.org, bob@x.org' END AS t, CASE WHEN c_nationkey = 3 THEN 'carl@x.org ,ann@X.org' ELSE 'joann@x.org' END AS c FROM customer), m AS (SELECT id, coalesce(list_contains(list_transform(string_split(lower(t), ','), lambda x: trim(x)), 'ann@x.org'), false) AS a, coalesce(list_contains(list_transform(string_split(lower(c), ','), lambda x: trim(x)), 'ann@x.org'), false) AS b FROM r) SELECT id, a OR b AS told, NOT a AND NOT b AS untold FROM m")
def email_membership(spark: SparkSession, d: str) -> DataFrame:
    to = F.when(F.col("c_mktsegment") == "BUILDING", " Ann@x.org, bob@x.org")
    cc = F.when(F.col("c_nationkey") == 3, "carl@x.org ,ann@X.org").otherwise("joann@x.org")
    told = in_list(to, "ann@x.org") | in_list(cc, "ann@x.org")
    untold = in_list(to, "ann@x.org", True) & in_list(cc, "ann@x.org", True)
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), told.alias("told"), untold.alias("untold"))


@query(SQL + "SELECT account_id, CASE WHEN branch IN ('CHINA', 'FRANCE', 'INDIA', 'PERU') THEN lower(branch) || '@bank.org' ELSE 'general' END AS sent_to FROM acct JOIN cust USING (customer_id) LEFT JOIN branch USING (branch_id) WHERE balance > 350000")
def alert_routing(spark: SparkSession, d: str) -> DataFrame:
    """An alert's rows to the officers of their branches; rows of branches without one, or of none, to the general list. The officers are a small table."""
    officers = branches(spark, d).filter("branch in ('CHINA', 'FRANCE', 'INDIA', 'PERU')").select("branch_id", F.concat(F.lower("branch"), F.lit("@bank.org")).alias("officer"))
    rows = accounts(spark, d).filter("balance > 350000").join(customers(spark, d).select("customer_id", "branch_id"), "customer_id")
    return rows.join(officers, "branch_id", "left").select("account_id", F.coalesce("officer", F.lit("general")).alias("sent_to"))


def branch_rows(df: DataFrame, branch_id, link: tuple[str, DataFrame] | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """An alert's rows of a branch, in their order (else by id, the largest first); a query without branch_id gets it through link (column, table with branch_id)."""
    if "branch_id" not in df.columns and link:
        df = df.join(link[1].select(link[0], "branch_id"), link[0], "left")
    out = df.filter(F.col("branch_id") == branch_id)
    return out.orderBy(*order) if order else out.orderBy(F.desc(out.columns[0]))


@query(SQL + "SELECT account_id, customer_id, branch_id FROM acct JOIN cust USING (customer_id) WHERE branch_id = 4 AND state = 'P' ORDER BY account_id DESC")
def alert_of_branch(spark: SparkSession, d: str) -> DataFrame:
    rows = accounts(spark, d).filter("state = 'P'").select("account_id", "customer_id")
    return branch_rows(rows, 4, ("customer_id", customers(spark, d))).select("account_id", "customer_id", "branch_id")


@query(SQL + "SELECT customer_id, coalesce(tier, '3') AS tier_level FROM cust LEFT JOIN (SELECT customer_id AS k, CASE WHEN max(balance) > 300000 THEN '1' WHEN max(balance) > 200000 THEN '2' END AS tier FROM acct GROUP BY 1) ON k = customer_id WHERE coalesce(tier, '3') IN ('1', '3')")
def tier_search(spark: SparkSession, d: str) -> DataFrame:
    """A search on a derived level, where no level means the third."""
    tiers = accounts(spark, d).groupBy("customer_id").agg(F.max("balance").alias("m")).select("customer_id", F.when(F.col("m") > 300000, "1").when(F.col("m") > 200000, "2").alias("tier"))
    level = F.coalesce("tier", F.lit("3"))
    return customers(spark, d).join(tiers, "customer_id", "left").select("customer_id", level.alias("tier_level")).filter("tier_level in ('1', '3')")


@query(SQL + "SELECT customer_id, CASE WHEN branch IS NULL THEN 'NULL' ELSE branch END AS branch FROM cust LEFT JOIN (SELECT * FROM branch WHERE region_id = 1) USING (branch_id)")
def null_display(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and empty texts shown as the word NULL."""
    c = customers(spark, d).join(branches(spark, d).filter("region_id = 1"), "branch_id", "left")
    return c.select("customer_id", F.when(F.col("branch").isNull() | (F.col("branch") == ""), "NULL").otherwise(F.col("branch")).alias("branch"))


@query(SQL + "SELECT account_id FROM acct ORDER BY CASE state WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, balance - 2 * (account_id % 10) DESC, account_id LIMIT 10")
def order_by_expression(spark: SparkSession, d: str) -> DataFrame:
    """The first ten rows by expressions: a sorted top-k, no full sort."""
    by = F.when(F.col("state") == "F", 0).when(F.col("state") == "O", 1).otherwise(2)
    return accounts(spark, d).orderBy(by, (F.col("balance") - 2 * (F.col("account_id") % 10)).desc(), "account_id").limit(10).select("account_id")


def preview(df: DataFrame, size: int = 30) -> DataFrame:
    """The first rows of an ordered query, each with whether there are more."""
    rows = df.limit(size + 1).withColumn("_i", F.monotonically_increasing_id()).coalesce(1)
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy())
    return rows.withColumn("truncated", n > size).orderBy("_i").limit(size).drop("_i")


@query(SQL + "SELECT account_id, (SELECT count(*) FROM (SELECT 1 FROM acct LIMIT 31)) > 30 AS truncated FROM acct ORDER BY account_id DESC LIMIT 30")
def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    return preview(accounts(spark, d).select("account_id").orderBy(F.desc("account_id")))


@query(SQL + "SELECT branch_id, count(*) AS n, CAST(max(score) AS DOUBLE) AS top FROM cust GROUP BY 1 ORDER BY top DESC, n DESC, branch_id LIMIT 7")
def ordered_groups(spark: SparkSession, d: str) -> DataFrame:
    g = customers(spark, d).groupBy("branch_id").agg(F.count("*").alias("n"), F.max("score").cast("double").alias("top"))
    return g.orderBy(F.desc("top"), F.desc("n"), "branch_id").limit(7)


@query(SQL + "SELECT customer_id, EXISTS (SELECT 1 FROM acct a WHERE a.customer_id = cust.customer_id AND balance > 400000) AS has_large FROM cust")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    """Existence per row: a semi-join on distinct keys, in place of a LIMIT 1 query each."""
    large = accounts(spark, d).filter("balance > 400000").select("customer_id").distinct().withColumn("has_large", F.lit(True))
    return customers(spark, d).select("customer_id").join(large, "customer_id", "left").select("customer_id", F.coalesce("has_large", F.lit(False)).alias("has_large"))


@query(SQL + f"SELECT customer_id FROM cust WHERE score > 5000 EXCEPT SELECT customer_id FROM acct WHERE opened > DATE '{AS_OF}' - 500")
def recordset_difference(spark: SparkSession, d: str) -> DataFrame:
    recent = accounts(spark, d).filter(F.col("opened") > F.date_sub(F.lit(AS_OF).cast("date"), 500)).select("customer_id")
    return customers(spark, d).filter("score > 5000").select("customer_id").subtract(recent)


@query(SQL + "SELECT sector AS label, 'sector' AS kind FROM cust UNION SELECT branch, 'branch' FROM branch")
def union_rows(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select(F.col("sector").alias("label"), F.lit("sector").alias("kind")).union(branches(spark, d).select("branch", F.lit("branch"))).distinct()


@query(SQL + "SELECT branch AS label, CAST(count(*) AS DOUBLE) AS value, branch_id AS id FROM cust JOIN branch USING (branch_id) GROUP BY branch, branch_id ORDER BY value DESC, label LIMIT 10")
def chart_payload(spark: SparkSession, d: str) -> DataFrame:
    g = customers(spark, d).join(branches(spark, d), "branch_id").groupBy("branch", "branch_id").agg(F.count("*").alias("n"))
    return chart(g.orderBy(F.desc("n"), "branch").limit(10))


def chart(df: DataFrame, x: str | None = None, y: str | None = None, id_: str | None = None) -> DataFrame:
    """A chart's label, value and id: the configured columns, else the first, the first numeric one that is no id, and the first `_id`; a value that is no number is 0."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    x = x or df.columns[0]
    others = [c for c in df.columns if c != x]
    y = y or next((c for c in others if dict(df.dtypes)[c].startswith(numeric) and not c.endswith("id")), others[0] if others else x)
    id_ = id_ or next((c for c in df.columns if c.endswith("_id")), None)
    return df.select(F.col(x).cast("string").alias("label"), F.coalesce(F.col(y).try_cast("double"), F.lit(0.0)).alias("value"), (F.col(id_) if id_ else F.lit(None)).alias("id"))


def column_of(field: str, columns: Sequence[str]) -> str | None:
    """The column of a result that a configured field means: its last name, exactly, in any case, or as a part of a column's; without `_id` as a column or its beginning; `id` may be branch_id."""
    name = field.split(".", 1)[-1]
    low = name.lower()
    base = low.removesuffix("_id") if low.endswith("_id") else None
    tests = [lambda c: c == name, lambda c: c.lower() == low, lambda c: low in c.lower(), lambda c: base is not None and c.lower().startswith(base), lambda c: low == "id" and c == "branch_id"]
    return next((c for t in tests for c in columns if t(c)), None)


#: Parts of names of columns that hold a chart's measure.
MEASURE_NAMES = ("count", "amount", "total", "sum", "value", "risk", "hit")


def branch_column(columns: Sequence[str], wanted: str | None = None) -> str | None:
    """The column by which a result is cut to branches: the wanted one in any case, else branch_id, id or branch, else any with branch in its name."""
    name = (wanted or "").split(".")[-1]
    tests = [lambda c: c == name, lambda c: c.lower() == name.lower(), *(lambda c, p=p: c == p for p in ("branch_id", "id", "branch")), lambda c: "branch" in c.lower()]
    return next((c for t in tests for c in columns if t(c)), None)


def sort_column(columns: Sequence[str], wanted: str | None = None) -> str | None:
    """The column by which a chart is sorted: the wanted one in any case, else the first that is named like a measure."""
    name = (wanted or "").split(".")[-1]
    tests = [lambda c: c == name, lambda c: c.lower() == name.lower(), lambda c: any(m in c.lower() for m in MEASURE_NAMES)]
    return next((c for t in tests for c in columns if t(c)), None)


_LIMITS = (("C", 10_000, 60_000, "large credit"), ("D", 20_000, 70_000, "large debit"), ("D", 0, 1_000, "small debit"), ("X", 0, 1, "never"))


@query(SQL + f", v(kind, lo, hi, label) AS (VALUES {', '.join(map(str, _LIMITS))}), s AS (SELECT unnest(['O', 'F']) AS state) SELECT label, s.state, count(t.account_id) AS n, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount FROM v CROSS JOIN s LEFT JOIN txn t ON t.kind = v.kind AND t.state = s.state AND amount >= lo AND amount < hi GROUP BY ALL")
def inline_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits and states given with the call, as relations: each pair with what falls within, also nothing. Facts are tested once against all pairs and summed before the join."""
    limits = spark.createDataFrame(_LIMITS, "kind string, lo int, hi int, label string")
    states = F.explode(F.array(F.lit("O"), F.lit("F"))).alias("state")
    hit = F.array_compact(F.array(*(F.when((F.col("kind") == k) & (F.col("amount") >= lo) & (F.col("amount") < hi), label) for k, lo, hi, label in _LIMITS)))
    sums = transactions(spark, d).select("state", "amount", F.explode(hit).alias("label")).groupBy("label", "state").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    return limits.select("label", states).join(sums, ["label", "state"], "left").select("label", "state", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).cast("double").alias("amount"))


def search_text(name: Column, aliases: Column, keywords: Column) -> Column:
    """The query that a news search takes: ("name" OR "alias") AND ("word" OR "word"). aliases is a comma list, keywords an array; null without a name or without keywords."""
    quoted = lambda a: F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    listed = F.filter(F.transform(F.split(F.coalesce(aliases, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    names = quoted(F.concat(F.array(name), listed))
    either = F.when(F.size(names) > 1, F.concat(F.lit("("), F.array_join(names, " OR "), F.lit(")"))).otherwise(names[0])
    return F.when((F.coalesce(name, F.lit("")) != "") & (F.size(F.coalesce(keywords, F.array().cast("array<string>"))) > 0), F.concat(either, F.lit(" AND ("), F.array_join(quoted(keywords), " OR "), F.lit(")")))


@query(SQL + """, k AS (SELECT customer_id, list_sort(list_distinct(list(product))) AS words FROM acct WHERE state = 'P' GROUP BY 1), n AS (SELECT customer_id, name, CASE customer_id % 3 WHEN 0 THEN lower(name) || ', ,x' || customer_id WHEN 1 THEN ' ' END AS aliases, coalesce(words, []) AS words FROM cust LEFT JOIN k USING (customer_id)),
a AS (SELECT *, list_filter(list_transform(string_split(coalesce(aliases, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM n)
SELECT customer_id, CASE WHEN len(words) > 0 THEN CASE WHEN len(l) > 0 THEN '("' || array_to_string(list_prepend(name, l), '" OR "') || '")' ELSE '"' || name || '"' END || ' AND ("' || array_to_string(words, '" OR "') || '")' END AS search FROM a""")
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """A news search for each customer, by name, aliases and the products of partial accounts as keywords."""
    words = accounts(spark, d).filter("state = 'P'").groupBy("customer_id").agg(F.sort_array(F.collect_set("product")).alias("words"))  # products are few
    n = F.col("customer_id")
    aliases = F.when(n % 3 == 0, F.concat(F.lower("name"), F.lit(", ,x"), n.cast("string"))).when(n % 3 == 1, " ")
    return customers(spark, d).join(words, "customer_id", "left").select("customer_id", search_text(F.col("name"), aliases, F.col("words")).alias("search"))
