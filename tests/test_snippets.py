"""Python snippets compiled to columns give what Python gives, row by row."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lakewarden.plans import snippets
from lakewarden.plans.secure import Refused

ROWS = [(1, 10.0, "Ab", True), (2, -3.5, " x ", False), (3, 0.0, "", True), (4, 2.5, "abc", False), (5, 1e6, "Zz", None), (6, None, None, None)]
SNIPPETS = [
    "result = t.n * 2 - t.x if t.x is not None else None", "result = (t.x or 7) > 5", "result = t.s and t.s.upper() + '!'", "result = not t.ok", "result = t.n in (1, 3) or t.s in ['abc']", "result = 1 < t.n <= 4", "result = t.n // 2 + t.n % 3 - -t.n // 2",
    "if t.n > 3:\n    result = 1\nelif t.ok:\n    result = 2\n    result += t.n\n", "x = 1\nif t.ok:\n    x = 2\nelse:\n    pass\nresult = x * t.n", "result = round(t.n / 4, 1) + round(t.n / 2)", "result = min(t.n, 3) + max(t.n, 4, 2) + abs(-t.n)", "result = t.s is None or len(t.s) == 2",
    "result = t.s == 'Ab' or t.n == 2.0", "result = t.s != 'Ab'", "result = None", "pass", "result = 'b' in (t.s or '')", "result = bool(t.s) and t.s.strip().startswith('x')", "result = int('12') + float('0.5') + t.n", "result = t.n ** 2", "result = str(t.n) + 'a'", "result = t.ok == None",
]
BAD = [
    "import os", "result = __import__('os')", "result = t.__class__", "for i in [1]:\n    result = i", "result = [x for x in [1]]", "result = lambda: 1", "result = open('x')", "result = env['a']", "t = 1", "result = nobody", "result = t.s + 1", "result = t.gone", "def f():\n    pass",
    "while True:\n    pass", "result = t.s.format(1)", "result = abs(t.n, 2)", "result = 1 if t.ok else 'a'", "result = t.n < 'a'", "result = (", "del t", "a.b = 1", "result = f'{t.n}'", "result = eval('1')", "abs = 3",
]


@pytest.mark.parametrize("text", SNIPPETS)
def test_equal_to_python(spark, text):
    df = spark.createDataFrame(ROWS, "n int, x double, s string, ok boolean").select(F.struct("*").alias("t"))
    got = df.select("t.n", snippets.Snippet(df.schema).compile(text)["result"].c.alias("r")).collect()
    for (n, x, s, ok), row in zip(ROWS, got):
        names = {"t": SimpleNamespace(n=n, x=x, s=s, ok=ok)}
        exec(text, {}, names)  # the test's own snippets
        assert row.r == names.get("result"), (text, row)


@pytest.mark.parametrize("text", BAD)
def test_refused(spark, text):
    df = spark.createDataFrame(ROWS, "n int, x double, s string, ok boolean").select(F.struct("*").alias("t"))
    with pytest.raises(Refused):
        snippets.Snippet(df.schema).compile(text)


def test_division_by_zero_and_relations(spark):
    df = spark.sql("SELECT struct(1 AS n, 7 AS b_id) AS a, struct(0 AS m) AS b")
    own = snippets.Snippet(df.schema, {"a": {"b_id": "b", "c_id": "b"}})
    got = df.select(own.compile("result = a.n / a.c_id.m")["result"].c, own.compile("result = a.c_id.m == 0 and a.b_id == 7")["result"].c, snippets.truth(own.compile("result = a.c_id")["result"])).first()
    assert tuple(got) == (None, True, True)
