"""Rules written as Python snippets, compiled to Column expressions: a snippet is never run, so it costs no Python and can do nothing else.

A snippet is assignments and ifs; its outcome is what `result` holds at the end. It sees records (transaction, customer, ..), which are struct columns, and
follows their relations by dots. What is not in the small language below is refused.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, NumericType, StringType, StructType

from lakewarden.plans.secure import Refused
from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, branches, customers, transactions


@dataclass(frozen=True)
class Value:
    """A compiled value: its column, and its kind: bool, num, text, other, or none for None alone."""

    c: Column
    kind: str


def _none() -> Value:
    return Value(F.lit(None), "none")


def _kind(t: DataType) -> str:
    return "bool" if isinstance(t, BooleanType) else "num" if isinstance(t, NumericType) else "text" if isinstance(t, StringType) else "other"


def truth(v: Value) -> Column:
    """Whether a value counts as true: not null, not false, not 0, not an empty text."""
    if v.kind == "none":
        return F.lit(False)
    yes = v.c if v.kind == "bool" else v.c != 0 if v.kind == "num" else v.c != "" if v.kind == "text" else v.c.isNotNull()
    return F.coalesce(yes, F.lit(False))


def _joined(test: Column, a: Value, b: Value) -> Value:
    """a where the test holds, else b."""
    kinds = {a.kind, b.kind} - {"none"}
    if len(kinds) > 1:
        raise Refused(f"a value that is {a.kind} or {b.kind}")
    return Value(F.when(test, a.c).otherwise(b.c), kinds.pop() if kinds else "none")


def _numbers(*values: Value) -> list[Column]:
    if any(v.kind not in ("num", "bool", "none") for v in values):
        raise Refused("arithmetic on what is no number")
    return [v.c.cast("int") if v.kind == "bool" else v.c.cast("double") if v.kind == "none" else v.c for v in values]


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), ast.FloorDiv: _floor_divide, ast.Mod: lambda a, b: a - b * _floor_divide(a, b), ast.Pow: lambda a, b: F.pow(a, b),
}
ORDER: dict[type, Callable[[Column, Column], Column]] = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
FUNCTIONS = {
    "abs": (1, 1), "min": (2, 9), "max": (2, 9), "round": (1, 2), "len": (1, 1), "float": (1, 1), "int": (1, 1), "str": (1, 1), "bool": (1, 1),
}
METHODS = {"lower": (0, 0), "upper": (0, 0), "strip": (0, 0), "startswith": (1, 1), "endswith": (1, 1)}


class Snippet:
    """A compiler over records: columns of a schema that are structs, and relations: {record: {field: record}}."""

    def __init__(self, schema: StructType, relations: dict[str, dict[str, str]] | None = None):
        self.records = {f.name: f.dataType for f in schema if isinstance(f.dataType, StructType)}
        self.relations = relations or {}

    def compile(self, text: str, outcomes: Sequence[str] = ("result",), given: dict[str, Value] | None = None) -> dict[str, Value]:
        """What the outcomes hold at a snippet's end, None if it never sets them. given: further names that it may read."""
        try:
            tree = ast.parse(text.strip())
        except SyntaxError as error:
            raise Refused(f"no valid snippet: {error.msg}") from None
        names = self._block(tree.body, dict(given or {}))
        return {o: names.get(o, _none()) for o in outcomes}

    def _block(self, body: list[ast.stmt], names: dict[str, Value]) -> dict[str, Value]:
        for s in body:
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                names = {**names, self._free(s.targets[0].id): self._value(s.value, names)}
            elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                own = ast.BinOp(ast.Name(s.target.id), s.op, s.value)
                names = {**names, self._free(s.target.id): self._value(own, names)}
            elif isinstance(s, ast.If):
                test = truth(self._value(s.test, names))
                yes, no = self._block(s.body, names), self._block(s.orelse, names)
                names = {n: yes[n] if yes.get(n) is no.get(n) else _joined(test, yes.get(n, _none()), no.get(n, _none())) for n in {**yes, **no}}
            elif not isinstance(s, ast.Pass):
                raise Refused(f"{type(s).__name__} is not allowed in a snippet")
        return names

    def _free(self, name: str) -> str:
        if name in self.records or name in FUNCTIONS:
            raise Refused(f"{name} cannot be set")
        return name

    def _record(self, e: ast.expr) -> str | None:
        """The record that an expression names, itself or by a relation."""
        if isinstance(e, ast.Name):
            return e.id if e.id in self.records else None
        if isinstance(e, ast.Attribute) and (owner := self._record(e.value)):
            return self.relations.get(owner, {}).get(e.attr)
        return None

    def _value(self, e: ast.expr, names: dict[str, Value]) -> Value:
        of = lambda x: self._value(x, names)
        if isinstance(e, ast.Constant):
            kind = {bool: "bool", int: "num", float: "num", str: "text", type(None): "none"}.get(type(e.value))
            if kind is None:
                raise Refused(f"a value of {type(e.value).__name__}")
            return Value(F.lit(e.value), kind)
        if isinstance(e, ast.Name):
            if e.id in names:
                return names[e.id]
            if e.id in self.records:  # a record as such is true if it is there
                return Value(F.col(e.id), "other")
            raise Refused(f"{e.id} is not known")
        if isinstance(e, ast.Attribute):
            owner = self._record(e.value)
            if owner is None or e.attr.startswith("_"):
                raise Refused(f"no field {e.attr}")
            if e.attr in self.records[owner].names:
                field = self.records[owner][e.attr].dataType
                c = F.col(f"`{owner}`.`{e.attr}`")
                return Value(c.cast("double") if isinstance(field, DecimalType) else c, _kind(field))
            if (related := self._record(e)) is not None:
                return Value(F.col(related), "other")
            raise Refused(f"no field {e.attr}")
        if isinstance(e, ast.BoolOp):  # a value, not only whether it is true: `x or 0` is x or 0
            parts = [of(v) for v in e.values]
            out = parts[-1]
            for p in reversed(parts[:-1]):
                if {p.kind, out.kind} - {"none"} != {p.kind} - {"none"}:
                    p, out = Value(truth(p), "bool"), Value(truth(out), "bool")
                out = _joined(truth(p), p, out) if isinstance(e.op, ast.Or) else _joined(truth(p), out, p)
            return out
        if isinstance(e, ast.UnaryOp):
            v = of(e.operand)
            if isinstance(e.op, ast.Not):
                return Value(~truth(v), "bool")
            if isinstance(e.op, (ast.USub, ast.UAdd)):
                (c,) = _numbers(v)
                return Value(-c if isinstance(e.op, ast.USub) else c, "num")
        if isinstance(e, ast.BinOp) and type(e.op) in ARITHMETIC:
            a, b = of(e.left), of(e.right)
            if isinstance(e.op, ast.Add) and a.kind == b.kind == "text":
                return Value(F.concat(a.c, b.c), "text")
            return Value(ARITHMETIC[type(e.op)](*_numbers(a, b)), "num")
        if isinstance(e, ast.IfExp):
            return _joined(truth(of(e.test)), of(e.body), of(e.orelse))
        if isinstance(e, ast.Compare):
            terms, left = [], e.left
            for op, right in zip(e.ops, e.comparators):
                terms.append(self._compare(op, left, right, of))
                left = right
            return Value(F.coalesce(self._all(terms), F.lit(False)), "bool")
        if isinstance(e, ast.Call) and not e.keywords:
            return self._call(e, of)
        raise Refused(f"{type(e).__name__} is not allowed in a snippet")

    @staticmethod
    def _all(terms: list[Column]) -> Column:
        out = terms[0]
        for t in terms[1:]:
            out = out & t
        return out

    def _compare(self, op: ast.cmpop, left: ast.expr, right: ast.expr, of) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            a = of(left)
            if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                found = F.lit(False)
                for x in right.elts:
                    found = found | self._same(a, of(x))
            elif (b := of(right)).kind == a.kind == "text":
                found = F.contains(b.c, a.c)
            else:
                raise Refused("in what is no list or text")
            return found if isinstance(op, ast.In) else ~found
        a, b = of(left), of(right)
        if isinstance(op, (ast.Eq, ast.Is)):
            return self._same(a, b)
        if isinstance(op, (ast.NotEq, ast.IsNot)):
            return ~self._same(a, b)
        if type(op) in ORDER and ({a.kind, b.kind} <= {"num", "bool", "none"} or len({a.kind, b.kind} - {"none"}) == 1):
            return ORDER[type(op)](a.c, b.c)  # against None there is no order, and nothing holds
        raise Refused(f"{a.kind} and {b.kind} have no order")

    @staticmethod
    def _same(a: Value, b: Value) -> Column:
        """Equal values; None is None, and an unset field is also False."""
        for x, y in ((a, b), (b, a)):
            if x.kind == "none":
                return y.c.isNull()
        if a.kind != b.kind and {a.kind, b.kind} != {"num", "bool"}:
            return F.lit(False)
        x, y = (_numbers(a, b) if a.kind != b.kind else [a.c, b.c])
        return x.eqNullSafe(y)

    def _call(self, e: ast.Call, of) -> Value:
        if isinstance(e.func, ast.Attribute) and e.func.attr in METHODS:
            least, most = METHODS[e.func.attr]
            own = of(e.func.value)
            args = [of(a) for a in e.args]
            if own.kind != "text" or not least <= len(args) <= most or any(a.kind != "text" for a in args):
                raise Refused(f"{e.func.attr} of what is no text")
            if args:
                return Value(getattr(F, e.func.attr)(own.c, args[0].c), "bool")
            return Value({"lower": F.lower, "upper": F.upper, "strip": F.trim}[e.func.attr](own.c), "text")
        name = e.func.id if isinstance(e.func, ast.Name) else None
        if name not in FUNCTIONS:
            raise Refused(f"function {name or type(e.func).__name__} is not allowed")
        least, most = FUNCTIONS[name]
        args = [of(a) for a in e.args]
        if not least <= len(args) <= most:
            raise Refused(f"{name} of {len(args)} values")
        if name == "bool":
            return Value(truth(args[0]), "bool")
        if name == "len":
            if args[0].kind != "text":
                raise Refused("len of what is no text")
            return Value(F.length(args[0].c), "num")
        if name == "str":
            return Value(args[0].c.cast("string"), "text")
        if name in ("int", "float") and args[0].kind == "text":
            return Value(args[0].c.try_cast("double" if name == "float" else "bigint"), "num")
        numbers = _numbers(*args)
        if name in ("min", "max"):
            missing = self._all([c.isNotNull() for c in numbers])
            return Value(F.when(missing, (F.least if name == "min" else F.greatest)(*numbers)), "num")
        if name == "round":  # halves to the even neighbour
            places = e.args[1].value if len(e.args) > 1 and isinstance(e.args[1], ast.Constant) and isinstance(e.args[1].value, int) else 0
            if len(e.args) > 1 and not isinstance(e.args[1], ast.Constant):
                raise Refused("round to a computed number of places")
            return Value(F.bround(numbers[0], places), "num")
        return Value({"abs": F.abs, "int": lambda c: c.cast("bigint"), "float": lambda c: c.cast("double")}[name](numbers[0]), "num")


@dataclass(frozen=True)
class SnippetRule:
    id: int
    priority: int
    level: str
    text: str


def snippet_hits(rows: DataFrame, rules: Sequence[SnippetRule], relations: dict[str, dict[str, str]]) -> Column:
    """An array of (rule, level), by priority, of the rules whose `result` is true; one projection for all rules."""
    own = Snippet(rows.schema, relations)
    hit = [F.when(truth(own.compile(r.text)["result"]), F.struct(F.lit(r.id).alias("rule"), F.lit(r.level).alias("level"))) for r in sorted(rules, key=lambda r: (r.priority, r.id))]
    return F.filter(F.array(*hit), lambda h: h.isNotNull())


RELATIONS = {"transaction": {"account_id": "account", "customer_id": "customer", "branch_id": "branch"}, "account": {"customer_id": "customer"}, "customer": {"branch_id": "branch"}}
_TXN_SNIPPETS = [
    SnippetRule(1, 1, "high", "result = transaction.amount > 50000 and customer.sector in ('BUILDING', 'MACHINERY')"),
    SnippetRule(2, 2, "medium", "limit = 40 if account.state == 'O' else 45\nresult = transaction.quantity > limit"),
    SnippetRule(3, 3, "low", "if transaction.kind == 'D':\n    result = transaction.account_id.customer_id.branch_id.branch.startswith('U')\nelif transaction.discount >= 0.09:\n    result = not (100 < transaction.amount <= 60000)\nelse:\n    pass"),
    SnippetRule(4, 4, "high", "share = transaction.amount / (account.balance or 1)\nresult = share > 0.9 and customer.score < 0"),
]


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Each transaction with the records that its rules see."""
    whole = lambda df, name, key: df.select(F.col(key).alias(f"_{name}"), F.struct("*").alias(name))
    t = transactions(spark, d).select(F.struct("*").alias("transaction"))
    a, c, b = whole(accounts(spark, d), "account", "account_id"), whole(customers(spark, d), "customer", "customer_id"), whole(branches(spark, d), "branch", "branch_id")
    out = t.join(a, F.col("transaction.account_id") == F.col("_account"), "left").join(c, F.col("account.customer_id") == F.col("_customer"), "left").join(b, F.col("customer.branch_id") == F.col("_branch"), "left")
    return out.select("transaction", "account", "customer", "branch")


@query(SQL + """, h AS (SELECT account_id, line, part_id, amount > 50000 AND sector IN ('BUILDING', 'MACHINERY') AS h1, quantity > CASE WHEN acct.state = 'O' THEN 40 ELSE 45 END AS h2,
CASE WHEN kind = 'D' THEN starts_with(branch, 'U') WHEN discount >= 0.09 THEN NOT (100 < amount AND amount <= 60000) ELSE false END AS h3, CAST(amount AS DOUBLE) / CAST(CASE WHEN balance = 0 THEN 1 ELSE balance END AS DOUBLE) > 0.9 AND score < 0 AS h4
FROM txn JOIN acct USING (account_id) JOIN cust USING (customer_id) JOIN branch USING (branch_id))
SELECT account_id, line, part_id, CASE WHEN h4 THEN 4 WHEN h3 THEN 3 WHEN h2 THEN 2 ELSE 1 END AS rule_id, CASE WHEN h1 OR h4 THEN 'high' WHEN h2 THEN 'medium' ELSE 'low' END AS level, h1::INT + h2::INT + h3::INT + h4::INT AS n_hits FROM h WHERE h1 OR h2 OR h3 OR h4""")
def snippet_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with a hit of a rule written in Python: the last by priority, the highest level, the number of hits."""
    rows = _records(spark, d)
    found = rows.withColumn("hits", snippet_hits(rows, _TXN_SNIPPETS, RELATIONS)).filter(F.size("hits") > 0)
    levels = F.col("hits.level")
    top = F.when(F.array_contains(levels, "high"), "high").when(F.array_contains(levels, "medium"), "medium").otherwise("low")
    return found.select("transaction.account_id", "transaction.line", "transaction.part_id", F.element_at("hits", -1)["rule"].alias("rule_id"), top.alias("level"), F.size("hits").alias("n_hits"))


_PLAN_SNIPPETS = [
    "if customer.score > 8000:\n    result = 9\nelif customer.score > 4000:\n    result = 5",
    "base = min(customer.score / 1000, 8) if customer.score > 0 else 0\nif branch.region_id == 3:\n    base += 1.5\nresult = round(base, 1)",
    "result = 2.5 if customer.sector.lower() == 'building' and len(branch.branch) > 5 else None",
]


@query(SQL + """, p AS (SELECT customer_id, CASE WHEN score > 8000 THEN 9.0 WHEN score > 4000 THEN 5.0 END AS s1, round_even(CASE WHEN score > 0 THEN least(CAST(score AS DOUBLE) / 1000, 8) ELSE 0 END + CASE WHEN region_id = 3 THEN 1.5 ELSE 0 END, 1) AS s2,
CASE WHEN lower(sector) = 'building' AND length(branch) > 5 THEN 2.5 END AS s3 FROM cust JOIN branch USING (branch_id))
SELECT customer_id, CAST(greatest(s1, s2, s3) AS DOUBLE) AS highest, CAST(coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) AS DOUBLE) AS total FROM p""")
def snippet_risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores that plan lines written in Python give each customer, by maximum and sum; a line without a result does not count."""
    rows = customers(spark, d).join(branches(spark, d).withColumnRenamed("branch_id", "_b"), F.col("branch_id") == F.col("_b")).select("customer_id", F.struct("customer_id", "score", "sector", "branch_id").alias("customer"), F.struct("branch", "region_id").alias("branch"))
    own = Snippet(rows.schema, RELATIONS)
    scores = [own.compile(t)["result"].c.cast("double") for t in _PLAN_SNIPPETS]
    return rows.select("customer_id", F.greatest(*scores).alias("highest"), sum((F.coalesce(s, F.lit(0.0)) for s in scores[1:]), F.coalesce(scores[0], F.lit(0.0))).alias("total"))


def snippet_pay(rows: DataFrame, rules: Sequence[tuple[str, str, str]], relations: dict[str, dict[str, str]]) -> DataFrame:
    """rows with a column per pay rule (code, condition, amount), both snippets, in order: result * result_qty * result_rate / 100, or 0 where the condition does not
    hold. Later rules see earlier amounts by their codes."""
    for code, condition, amount in rules:
        own = Snippet(rows.schema, relations)
        given = {c: Value(F.col(c), "num") for c, _, _ in rules if c in rows.columns}
        got = own.compile(amount, ("result", "result_qty", "result_rate"), given)
        part = lambda name, default: F.lit(default) if got[name].kind == "none" else F.coalesce(got[name].c.cast("double"), F.lit(default))
        value = part("result", 0.0) * part("result_qty", 1.0) * part("result_rate", 100.0) / 100
        rows = rows.withColumn(code, F.when(truth(own.compile(condition, given=given)["result"]), value).otherwise(0.0))
    return rows


@query(SQL + """, p AS (SELECT customer_id, CASE WHEN score > 0 THEN CAST(score AS DOUBLE) * 0.5 ELSE 0.0 END AS basic, sector FROM cust), q AS (SELECT *, CASE WHEN sector = 'BUILDING' OR basic > 3000 THEN 100.0 * 2 * 15 / 100 ELSE 0.0 END AS allowance FROM p)
SELECT customer_id, basic, allowance, CASE WHEN basic + allowance <> 0 THEN (basic + allowance) * -10 / 100 ELSE 0.0 END AS tax FROM q""")
def snippet_pay_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = customers(spark, d).select("customer_id", F.struct("*").alias("customer"))
    rules = [
        ("basic", "result = customer.score > 0", "result = customer.score\nresult_rate = 50"),
        ("allowance", "result = customer.sector == 'BUILDING' or basic > 3000", "result = 100\nresult_qty = 2\nresult_rate = 15"),
        ("tax", "result = basic + allowance", "result = basic + allowance\nresult_rate = -10"),
    ]
    return snippet_pay(rows, rules, RELATIONS).select("customer_id", "basic", "allowance", "tax")
