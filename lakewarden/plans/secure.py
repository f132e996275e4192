"""Secured views and user-authored queries.

A user's query runs against temp views that already hold the branch, tenant and period filters, so nobody edits SQL text, and
the filters reach the scans. Spark's own parser decides what a statement is.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import EVENTS_AS_OF, SQL, accounts, branches, customers, load

#: Functions that a user query may call; any other is refused. None makes rows, long texts or arrays, and none reaches outside the data.
FUNCTIONS = frozenset(
    "count count_if sum avg mean min max min_by max_by any_value first last median stddev stddev_pop stddev_samp variance var_pop var_samp bool_and bool_or every some approx_count_distinct corr grouping "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value "
    "lower lcase upper ucase trim ltrim rtrim btrim substring substr left right length char_length character_length octet_length concat concat_ws replace initcap instr position locate split_part translate startswith endswith contains like ilike rlike regexp regexp_like reverse "
    "abs round bround floor ceil ceiling sqrt power pow mod pmod exp ln log log10 sign signum greatest least isnan "
    "coalesce ifnull nullif nvl nvl2 if isnull isnotnull "
    "year month day dayofmonth dayofweek dayofyear weekofyear weekday quarter hour minute second date date_trunc trunc date_add dateadd date_sub datediff date_diff months_between add_months last_day next_day to_date to_timestamp date_format extract date_part make_date "
    "now current_timestamp current_date localtimestamp curdate int bigint double float string boolean decimal timestamp between struct named_struct".split()
)
#: Expressions of a parsed plan that a user query may hold.
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedFunction UnresolvedAlias Alias Literal EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not IsNull IsNotNull IsUnknown IsNotUnknown In InSubquery Between "
    "Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Cast CaseWhen Add Subtract Multiply Divide Remainder IntegralDivide UnaryMinus UnaryPositive Concat StringTrim StringTrimLeft StringTrimRight "
    "SortOrder UnresolvedOrdinal UnresolvedWindowExpression WindowExpression WindowSpecDefinition WindowSpecReference SpecifiedWindowFrame UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ "
    "ScalarSubquery Exists ListQuery LateralSubquery CreateNamedStruct NamePlaceholder$ UnresolvedExtractValue CurrentDate CurrentTimestamp LocalTimestamp Now Extract".split()
)
#: Names that Spark reads as functions where no column has them.
NAMELESS = ("current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "grouping__id")
#: Nodes of a parsed plan that a query may have; commands, table functions, transforms, unions and all else are refused.
PLANS = frozenset("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation Join LateralJoin UnresolvedWith UnresolvedHaving WithWindowDefinition OneRowRelation UnresolvedInlineTable Except Intersect Pivot UnresolvedHint UnresolvedOrderBy".split())
QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`", re.S)


class Refused(ValueError):
    """A user query that may not run."""


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


#: Functions of the time of day, which a chart's query may not call.
CLOCK = ("now", "current_timestamp", "current_date", "localtimestamp", "curdate")


def _check(node, views: set[str] | None, known: frozenset[str], chart: bool) -> None:
    """Refuse what a parsed node and all below it may not hold: any plan, expression or function that is not listed. known: names of common table expressions in scope."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        for cte in _each(node.cteRelations()):
            _check(cte._2(), views, known, chart)
            known |= {cte._1().lower()}
        return _check(node.child(), views, known, chart)
    plan = _is_plan(node)
    if kind not in (PLANS if plan else EXPRESSIONS):
        raise Refused(f"{kind} is not allowed")
    if kind == "UnresolvedFunction":
        name = [str(x).lower() for x in _each(node.nameParts())]
        if len(name) > 1 or name[0] not in FUNCTIONS or chart and name[0] in CLOCK:
            raise Refused(f"function {'.'.join(name)} is not allowed")
    elif kind == "UnresolvedRelation":
        name = [str(x).lower() for x in _each(node.multipartIdentifier())]
        if name[0] in ("information_schema", "pg_catalog", "sys") or views is not None and ".".join(name) not in views and not (len(name) == 1 and name[0] in known):
            raise Refused(f"unknown table {'.'.join(name)}")
    elif kind == "UnresolvedAttribute":  # a function that needs no parentheses reads like a column
        name = [str(x).lower() for x in _each(node.nameParts())]
        if len(name) == 1 and (name[0] in NAMELESS or chart and name[0] in CLOCK):
            raise Refused(f"{name[0]} is not allowed")
    elif kind == "Or" and any(map(_idle, _each(node.children()))):
        raise Refused("a condition that lets all rows pass")
    elif chart and kind in ("CaseWhen", "CurrentTimestamp", "CurrentDate", "LocalTimestamp", "Now"):
        raise Refused(f"{kind} is not allowed in a chart")
    below = _each(node.children())
    if plan:
        below += _each(node.expressions())
    elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        below.append(node.plan())
    elif kind == "InSubquery":
        below.append(node.query())
    for x in below:
        _check(x, views, known, chart)


def _is_plan(node) -> bool:
    jvm = SparkSession.active()._jvm
    return jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan").isInstance(node)


def _constant(node) -> bool:
    """Whether an expression refers to no column, function or subquery."""
    kind = node.getClass().getSimpleName()
    return not kind.startswith("Unresolved") and kind not in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery") and all(map(_constant, _each(node.children())))


def _idle(node) -> bool:
    """Whether a branch of an OR judges no row by a value: a constant, a comparison of a term with itself, or one column equal to another."""
    kind, below = node.getClass().getSimpleName(), _each(node.children())
    if kind in ("And", "Or"):
        return (all if kind == "And" else any)(map(_idle, below))
    if kind in ("EqualTo", "EqualNullSafe", "LessThanOrEqual", "GreaterThanOrEqual") and below[0].equals(below[1]):
        return True
    return _constant(node) or kind in ("EqualTo", "EqualNullSafe") and all(x.getClass().getSimpleName() == "UnresolvedAttribute" for x in below)


def check_query(spark: SparkSession, sql: str, views: Sequence[str] | None = None, chart: bool = False, prohibited: Sequence[str] = ()) -> str:
    """sql if it is a single SELECT over the allowed views, of listed clauses, expressions and functions alone, without comments, unions and an OR that lets all rows pass; else Refused.

    A chart's query may hold no CASE and no clock either; `prohibited` words may stand nowhere outside quotes. What the query holds is read off Spark's parsed plan, so text in quotes, names of columns and common table expressions mislead nothing.
    """
    text = sql.strip().rstrip("; \n\t")
    bare = QUOTED.sub("''", text)
    if ";" in bare or "--" in bare or "/*" in bare:
        raise Refused("several statements or a comment")
    if found := {w.lower() for w in prohibited} & set(re.findall(r"\w+", bare.lower())):
        raise Refused(f"{sorted(found)[0]} is prohibited")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise Refused(f"no valid SQL: {str(error).splitlines()[0]}") from None
    _check(plan, None if views is None else {v.lower() for v in views}, frozenset(), chart)
    return text


def secured(df: DataFrame, branch: str | None = None, allowed: Sequence[int] | None = None, asked: Sequence[int] | None = None, date: str | None = None, period: tuple[datetime.date, datetime.date] | None = None) -> DataFrame:
    """df with its filters: branches both allowed and asked for (none allowed: no rows; allowed None: all), and days of the period, both inclusive. A filter without its column is an error."""
    if (allowed is not None or asked) and not branch or period and not date:
        raise ValueError("a filter has no column")
    if asked and allowed is None:
        df = df.filter(F.col(branch).isin(sorted(set(asked))))
    if branch and allowed is not None:
        own = set(allowed) & set(asked) if asked else set(allowed)
        df = df.filter(F.col(branch).isin(sorted(own)) if own else F.lit(False))
    if date and period:
        df = df.filter((F.col(date) >= F.lit(period[0])) & (F.col(date) < F.lit(period[1] + datetime.timedelta(1))))
    return df


def run_user_query(spark: SparkSession, sql: str, views: dict[str, DataFrame], chart: bool = False, most: int | None = None) -> DataFrame:
    """A checked user query over secured views, of `most` rows at most if given. Each call has views of its own, so queries that run side by side never see another's."""
    text = check_query(spark, sql, list(views), chart)
    own = {name: f"user_{uuid.uuid4().hex}" for name in views}
    for name, view in own.items():
        views[name].createTempView(view)
    try:
        out = spark.sql(f"WITH {', '.join(f'`{name}` AS (TABLE {view})' for name, view in own.items())} SELECT * FROM (\n{text}\n)" if own else text)
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)
    return out if most is None else out.limit(most)


def period(days: int, today: datetime.date) -> tuple[datetime.date, datetime.date] | None:
    """The chart period of a number of days: 0 today, 1 yesterday, 7 and 30 the days that end today; None for any other."""
    if days == 1:
        return today - datetime.timedelta(1), today - datetime.timedelta(1)
    return (today - datetime.timedelta(max(days, 1) - 1), today) if days in (0, 7, 30) else None


OPERATORS = {
    "=": lambda c, v: c.isNull() if v in (None, False) else c == v,
    "!=": lambda c, v: c.isNotNull() if v in (None, False) else (c != v) | c.isNull(),
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v) if v else F.lit(False),
    "not in": lambda c, v: ~c.isin(*v) | c.isNull() if v else F.lit(True),
    "like": lambda c, v: c.like(f"%{v}%"), "ilike": lambda c, v: c.ilike(f"%{v}%"), "not like": lambda c, v: ~c.like(f"%{v}%") | c.isNull(), "=like": lambda c, v: c.like(v),
    "not ilike": lambda c, v: ~c.ilike(f"%{v}%") | c.isNull(), "=ilike": lambda c, v: c.ilike(v),
}


def domain(terms: Sequence) -> Column:
    """A prefix-notation predicate, (field, operator, value) tuples with '&', '|' and '!', as a column; adjacent terms are joined by and."""
    stack: list[Column] = []
    for t in reversed(list(terms)):
        if t == "!":
            stack.append(~stack.pop())
        elif t in ("&", "|"):
            a, b = stack.pop(), stack.pop()
            stack.append(a & b if t == "&" else a | b)
        else:
            stack.append(OPERATORS[t[1]](F.col(t[0]), t[2]))
    out = F.lit(True)
    while stack:
        out = out & stack.pop()
    return out


@query(SQL + "SELECT branch_id, count(*) AS n, CAST(sum(score) AS DOUBLE) AS score FROM cust WHERE branch_id IN (3, 5) GROUP BY 1")
def secured_branch(spark: SparkSession, d: str) -> DataFrame:
    """A user's query over a view that holds the branches the user may see, cut to those asked for."""
    views = {"secured_customer": secured(customers(spark, d), "branch_id", [1, 3, 5, 7], [3, 5, 9])}
    return run_user_query(spark, "SELECT branch_id, count(*) AS n, CAST(sum(score) AS DOUBLE) AS score FROM secured_customer GROUP BY branch_id", views)


@query(SQL + "SELECT customer_id FROM cust WHERE 1 = 0")
def secured_none(spark: SparkSession, d: str) -> DataFrame:
    return secured(customers(spark, d), "branch_id", []).select("customer_id")


@query(f"SELECT event_type, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '{EVENTS_AS_OF}') AS p0, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '{EVENTS_AS_OF}' - 1) AS p1, count(*) FILTER (WHERE CAST(ts AS DATE) BETWEEN DATE '{EVENTS_AS_OF}' - 6 AND DATE '{EVENTS_AS_OF}') AS p7, count(*) FILTER (WHERE CAST(ts AS DATE) BETWEEN DATE '{EVENTS_AS_OF}' - 29 AND DATE '{EVENTS_AS_OF}') AS p30 FROM events GROUP BY 1")
def period_filters(spark: SparkSession, d: str) -> DataFrame:
    today = datetime.date.fromisoformat(EVENTS_AS_OF)
    day = F.to_date("ts")
    counts = [F.count_if(day.between(F.lit(p[0]), F.lit(p[1]))).alias(f"p{n}") for n in (0, 1, 7, 30) if (p := period(n, today))]
    return load(spark, d, "events").groupBy("event_type").agg(*counts)


@query(SQL + "SELECT customer_id FROM cust WHERE (sector ILIKE '%build%' OR score > 9000) AND NOT (branch_id IN (1, 2, 3))")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    terms = ["&", "|", ("sector", "ilike", "build"), ("score", ">", 9000), "!", ("branch_id", "in", [1, 2, 3])]
    return customers(spark, d).filter(domain(terms)).select("customer_id")


@query(SQL + "SELECT DISTINCT branch_id FROM cust WHERE level = 'high' INTERSECT SELECT branch_id FROM branch WHERE region_id = 1")
def intersect_branches(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).filter("score >= 6000").select("branch_id").intersect(branches(spark, d).filter("region_id = 1").select("branch_id"))


@query(SQL + "SELECT customer_id FROM cust WHERE score > 9000 UNION SELECT customer_id FROM acct WHERE balance > 400000")
def union_distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).filter("score > 9000").select("customer_id").union(accounts(spark, d).filter("balance > 400000").select("customer_id")).distinct()


@query(SQL + """SELECT x.sector, count(*) AS n, CAST(sum(y.total) AS DOUBLE) AS total FROM (SELECT customer_id AS id, sector FROM cust WHERE branch_id IN (3, 5, 7) AND sector IN ('BUILDING', 'MACHINERY') AND score > 0) x
JOIN (SELECT customer_id, sum(balance) AS total FROM acct JOIN (SELECT customer_id FROM cust WHERE branch_id IN (3, 5, 7)) USING (customer_id) GROUP BY 1) y ON x.id = y.customer_id GROUP BY 1""")
def secured_derived(spark: SparkSession, d: str) -> DataFrame:
    """A user's query that joins derived tables: the filters of origin and branches are in the views, so they reach each of them."""
    from lakewarden.plans.predicates import of_origins

    people = customers(spark, d).withColumn("origin", F.when(F.col("sector") == "BUILDING", "prod").when(F.col("sector") == "MACHINERY", "demo").otherwise("old"))
    own = accounts(spark, d).join(customers(spark, d).select("customer_id", "branch_id"), "customer_id")
    views = {"client": secured(of_origins(people), "branch_id", [3, 5, 7]), "deposit": secured(own, "branch_id", [3, 5, 7])}
    sql = "SELECT x.sector, count(*) AS n, CAST(sum(y.total) AS DOUBLE) AS total FROM (SELECT customer_id AS id, sector FROM client WHERE score > 0) x JOIN (SELECT customer_id, sum(balance) AS total FROM deposit GROUP BY customer_id) y ON x.id = y.customer_id GROUP BY x.sector"
    return run_user_query(spark, sql, views)
