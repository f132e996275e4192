"""From a chart's query to the rows behind it: the main table and a domain over it, read off Spark's analyzed plan.

Predicates come down to the main table through projections, subqueries, common table expressions and joins to a table's key, where they become dotted paths.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.plans.predicates import _COMPARE, _FLIP, with_paths
from lakewarden.plans.secure import Refused, _each, domain, run_user_query
from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, branches, customers

OWN_VIEW = re.compile(r"user_[0-9a-f]{32}")


@dataclass
class Part:
    """What is known of a part of a plan: its main table, the path of each attribute from there, and the terms that its rows meet."""

    table: str
    paths: dict[int, str]
    terms: list[list] = field(default_factory=list)
    waiting: list[Part] = field(default_factory=list)  #: tables of a comma join whose key is not yet met
    grouped: bool = False


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _id(attribute) -> int:
    return attribute.exprId().id()


def _conjuncts(node) -> list:
    return _conjuncts(node.left()) + _conjuncts(node.right()) if _kind(node) == "And" else [node]


def _holds(node, kinds: frozenset[str]) -> bool:
    return _kind(node) in kinds or any(_holds(x, kinds) for x in _each(node.children()))


class DrillDown:
    """A walk over one analyzed plan. keys: the key of each table, by which other tables may point to it."""

    MEASURES = frozenset(("Sum", "Average", "Min", "Max"))

    def __init__(self, keys: dict[str, str]):
        self.keys, self.defs, self.links = keys, {}, {}

    def walk(self, node) -> Part | None:
        """None for a query with a sum, mean, minimum or maximum; Refused for one whose rows have no way back to a table's."""
        kind = _kind(node)
        if kind == "WithCTE":
            self.defs |= {d.id(): d.child() for d in _each(node.cteDefs())}
            return self.walk(node.plan())
        if kind == "CTERelationRef":
            return self._common(node)
        if kind == "Join":
            return self._join(node)
        below = _each(node.children())
        if len(below) != 1 or kind not in ("SubqueryAlias", "View", "Project", "Filter", "Aggregate", "Sort", "Distinct", "GlobalLimit", "LocalLimit", "Offset", "Window"):
            raise Refused(f"{kind} has no rows of one table behind it")
        if kind == "Aggregate" and any(_holds(e, self.MEASURES) for e in _each(node.aggregateExpressions())):
            return None
        part = self.walk(below[0])
        if part is None:
            return None
        if kind in ("Project", "Aggregate"):
            for e in _each(node.projectList() if kind == "Project" else node.aggregateExpressions()):
                if _kind(e) == "Alias" and _kind(e.child()) == "AttributeReference" and _id(e.child()) in part.paths:
                    part.paths[_id(e)] = part.paths[_id(e.child())]
            part.grouped |= kind == "Aggregate"
        elif kind == "Filter":
            self._filter(part, node.condition())
        return part

    def _common(self, node) -> Part | None:
        """A view of the query's own, or a common table expression that is walked in its place."""
        child, out = self.defs[node.cteId()], _each(node.output())
        names = []
        at = child
        while _kind(at) in ("SubqueryAlias", "View", "Project") and len(_each(at.children())) == 1:
            if _kind(at) == "SubqueryAlias":
                names.append(str(at.alias()))
            at = _each(at.children())[0]
        if own := [i for i, n in enumerate(names) if OWN_VIEW.fullmatch(n)]:
            return Part(names[own[0] - 1], {_id(a): str(a.name()) for a in out})
        part = self.walk(child)
        if part is not None:
            part.paths |= {_id(a): part.paths[_id(b)] for a, b in zip(out, _each(child.output())) if _id(b) in part.paths}
        return part

    def _filter(self, part: Part, condition) -> None:
        rest = [c for c in _conjuncts(condition) if not self._link_waiting(part, c)]
        for c in rest:
            try:
                part.terms.append(self._term(c, part.paths))
            except Refused:
                if not part.grouped:  # what groups must meet says nothing of their rows
                    raise

    def _link_waiting(self, part: Part, condition) -> bool:
        return any(self._link(part, other, condition, True) and (part.waiting.remove(other) or True) for other in list(part.waiting))

    def _join(self, node) -> Part | None:
        left, right = self.walk(node.left()), self.walk(node.right())
        if left is None or right is None:
            return None
        how = str(node.joinType())
        if how not in ("Inner", "Cross", "LeftOuter") or right.grouped or left.grouped:
            raise Refused(f"a {how} join of these has no rows of one table behind it")
        terms = _conjuncts(node.condition().get()) if node.condition().isDefined() else []
        linked = next((c for c in terms if self._link(left, right, c, how != "LeftOuter")), None)
        if linked is None:
            if how == "LeftOuter":
                raise Refused("an outer join without a key")
            left.waiting.append(right)
        for c in terms:
            if c is not linked:
                if how == "LeftOuter":
                    raise Refused("an outer join by more than a key")
                self._filter(left, c)
        return left

    def _link(self, part: Part, other: Part, condition, inner: bool) -> bool:
        """Whether an equality points from part to other's key; if so, other's attributes and terms hang below part's field."""
        if _kind(condition) != "EqualTo":
            return False
        a, b = (self._bare(x) for x in (condition.left(), condition.right()))
        if _kind(a) != "AttributeReference" or _kind(b) != "AttributeReference":
            return False
        if _id(a) in other.paths and _id(b) in part.paths:
            a, b = b, a
        if _id(a) not in part.paths or _id(b) not in other.paths or other.paths[_id(b)] != self.keys.get(other.table):
            return False
        path = part.paths[_id(a)]
        if self.links.setdefault(path.rsplit(".", 1)[-1], other.table) != other.table:
            raise Refused(f"{path} points to two tables")
        part.paths |= {i: f"{path}.{p}" for i, p in other.paths.items()}
        if inner:
            part.terms.append([(f"{path}.{self.keys[other.table]}", "!=", None)])
            part.terms += [[(f"{path}.{t[0]}", *t[1:]) if isinstance(t, tuple) else t for t in term] for term in other.terms]
        elif other.terms:
            raise Refused("an outer join to filtered rows")
        part.waiting += other.waiting
        return True

    @staticmethod
    def _bare(node):
        while _kind(node) == "Cast":
            node = node.child()
        return node

    def _literal(self, node):
        node = self._bare(node)
        if _kind(node) == "UnaryMinus":
            return -self._literal(node.child())
        if _kind(node) != "Literal":
            raise Refused(f"{_kind(node)} is no plain value")
        value, kind = node.value(), node.dataType().typeName()
        if value is None or isinstance(value, bool):
            return value
        if kind == "date":
            return datetime.date.fromordinal(719_163 + int(value))
        if kind.startswith("decimal"):
            return float(str(value))
        return str(value) if kind == "string" else value if isinstance(value, (int, float)) else int(str(value))

    def _term(self, node, paths: dict[int, str]) -> list:
        kind = _kind(node)
        of = lambda x: self._term(x, paths)

        def path(x) -> str:
            x = self._bare(x)
            if _kind(x) != "AttributeReference" or _id(x) not in paths:
                raise Refused("no field of the table")
            return paths[_id(x)]

        if kind in ("And", "Or"):
            return ["&" if kind == "And" else "|", *of(node.left()), *of(node.right())]
        if kind == "Not":
            inner = of(node.child())
            if len(inner) == 1 and inner[0][1] in ("=", "in"):
                f, op, value = inner[0]
                out = (f, {"=": "!=", "in": "not in"}[op], value)
                return [out] if value is None else ["&", out, (f, "!=", None)]
            return ["!", *inner]
        if kind in _COMPARE:
            if _kind(self._bare(node.left())) == "AttributeReference":
                return [(path(node.left()), _COMPARE[kind], self._literal(node.right()))]
            return [(path(node.right()), _FLIP[_COMPARE[kind]], self._literal(node.left()))]
        if kind == "In":
            return [(path(node.value()), "in", [self._literal(x) for x in _each(node.list())])]
        if kind in ("IsNull", "IsNotNull"):
            return [(path(node.child()), "=" if kind == "IsNull" else "!=", None)]
        if kind in ("Like", "ILike"):
            return [(path(node.left()), "=like" if kind == "Like" else "=ilike", self._literal(node.right()))]
        if kind == "Between":
            low, high = (self._literal(x) for x in (node.lower(), node.upper()))
            return ["&", (path(node.input()), ">=", low), (path(node.input()), "<=", high)]
        if kind == "AttributeReference":
            return [(path(node), "=", True)]
        raise Refused(f"{kind} has no place in a domain")


def table_and_domain(df: DataFrame, keys: dict[str, str]) -> tuple[str, list, dict[str, str]] | None:
    """(table, domain, tables that its dotted paths lead to by field) of a user's query; None if it sums, averages or takes extremes."""
    walk = DrillDown(keys)
    part = walk.walk(df._jdf.queryExecution().analyzed())
    if part is None:
        return None
    if part.waiting:
        raise Refused(f"{part.waiting[0].table} is joined by no key")
    terms = list(dict.fromkeys(map(repr, part.terms)))
    kept = [next(t for t in part.terms if repr(t) == r) for r in terms]
    return part.table, reduce(lambda a, b: ["&", *a, *b], kept) if kept else [], walk.links


def drill_down(spark: SparkSession, sql: str, views: dict[str, DataFrame], keys: dict[str, str], chart: bool = False) -> tuple[str, DataFrame] | None:
    """The main table of a user's query and its rows behind the query's result."""
    found = table_and_domain(run_user_query(spark, sql, views, chart), keys)
    if found is None:
        return None
    table, terms, links = found
    dotted = sorted({t[0] for t in terms if isinstance(t, tuple) and "." in t[0]})
    rows = with_paths(views[table], dotted, {f: (views[to], keys[to]) for f, to in links.items()})
    quoted = [(f"`{t[0]}`", *t[1:]) if isinstance(t, tuple) else t for t in terms]
    return table, rows.filter(domain(quoted)).select(*views[table].columns)


KEYS = {"acct": "account_id", "cust": "customer_id", "branch": "branch_id"}
#: Charts: their query, and the rows behind it as SQL over the same tables.
CHARTS: Sequence[tuple[str, str, str]] = (
    ("by_state", "SELECT state, count(*) AS n FROM acct WHERE balance > 100000 AND state IN ('O', 'F') GROUP BY state", "SELECT account_id AS id FROM acct WHERE balance > 100000 AND state IN ('O', 'F')"),
    ("precedence", "SELECT product, count(*) AS n FROM acct WHERE state = 'P' OR balance >= 200000 AND NOT product = '1-URGENT' GROUP BY product ORDER BY n DESC LIMIT 3", "SELECT account_id AS id FROM acct WHERE state = 'P' OR balance >= 200000 AND NOT product = '1-URGENT'"),
    ("joined", "SELECT c.sector, count(*) AS n FROM acct a JOIN cust c ON a.customer_id = c.customer_id WHERE c.sector LIKE 'B%' AND a.state = 'O' GROUP BY c.sector", "SELECT account_id AS id FROM acct JOIN cust USING (customer_id) WHERE sector LIKE 'B%' AND acct.state = 'O'"),
    ("two_joins", "SELECT b.branch, count(*) AS n FROM acct a JOIN cust c ON a.customer_id = c.customer_id JOIN branch b ON b.branch_id = c.branch_id WHERE b.region_id = 2 AND c.score > 1000 GROUP BY b.branch", "SELECT account_id AS id FROM acct JOIN cust USING (customer_id) JOIN branch USING (branch_id) WHERE region_id = 2 AND score > 1000"),
    ("comma", "SELECT b.branch, count(*) AS n FROM cust c, branch b WHERE c.branch_id = b.branch_id AND b.branch IN ('CHINA', 'PERU') AND c.score BETWEEN 0 AND 5000 GROUP BY b.branch", "SELECT customer_id AS id FROM cust JOIN branch USING (branch_id) WHERE branch IN ('CHINA', 'PERU') AND score BETWEEN 0 AND 5000"),
    ("subquery", "SELECT s, count(*) AS n FROM (SELECT sector AS s, score AS v FROM cust WHERE branch_id <> 3) x WHERE v < 500 GROUP BY s", "SELECT customer_id AS id FROM cust WHERE branch_id <> 3 AND score < 500"),
    ("common", "WITH late AS (SELECT product AS p, opened AS o FROM acct WHERE opened >= date '1997-01-01') SELECT p, count(*) AS n FROM late WHERE o < date '1998-01-01' GROUP BY p", "SELECT account_id AS id FROM acct WHERE opened >= DATE '1997-01-01' AND opened < DATE '1998-01-01'"),
    ("having", "SELECT branch_id, count(*) AS n FROM cust WHERE score IS NOT NULL AND NOT (score < 0 OR sector = 'MACHINERY') GROUP BY branch_id HAVING count(*) > 2 AND branch_id > 4", "SELECT customer_id AS id FROM cust WHERE NOT (score < 0 OR sector = 'MACHINERY') AND branch_id > 4"),
    ("outer", "SELECT a.state, count(*) AS n FROM acct a LEFT JOIN cust c ON c.customer_id = a.customer_id WHERE -5 <= a.balance GROUP BY a.state", "SELECT account_id AS id FROM acct WHERE balance >= -5"),
    ("plain", "SELECT DISTINCT sector FROM cust", "SELECT customer_id AS id FROM cust"),
)


@query(SQL + " UNION ALL ".join(f"SELECT '{name}' AS chart, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ({rows})" for name, _, rows in CHARTS))
def drill_down_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many rows stand behind each chart, and the sum of their keys."""
    views = {"acct": accounts(spark, d), "cust": customers(spark, d), "branch": branches(spark, d)}
    out = []
    for name, sql, _ in CHARTS:
        table, rows = drill_down(spark, sql, views, KEYS, chart=True)
        out.append(rows.agg(F.count("*").alias("n"), F.sum(KEYS[table]).cast("long").alias("ids")).select(F.lit(name).alias("chart"), "n", "ids"))
    return reduce(DataFrame.unionByName, out)
