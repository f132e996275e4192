"""Gates, predicates, functions, files and streams that have no SQL to compare with."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import coercions, scalars
from lakewarden.operators import hierarchy, rules, screening, statements
from lakewarden.plans import drill, etl, loads, predicates, secure
from lakewarden.sources import files
from lakewarden.streaming import alerts


VIEWS = ["ledger", "branch_day", "v"]
#: Statements that must be refused, by what is wrong with them, and ones that must pass.
REFUSED = {
    "second statement": ["SELECT total FROM ledger; SELECT 1", "SELECT total FROM ledger; TRUNCATE TABLE ledger", "SELECT 1 FROM v;;SELECT 2"],
    "comment": ["SELECT total FROM ledger -- all of it", "SELECT /* hidden */ total FROM ledger"],
    "no query": ["INSERT INTO ledger VALUES (1)", "ALTER VIEW v AS SELECT 1", "CREATE TABLE t AS SELECT 1", "DESCRIBE ledger", "CACHE TABLE ledger", "USE somewhere", "REFRESH TABLE v", "SELEC total"],
    "all rows pass": ["SELECT * FROM ledger WHERE total = 5 OR 2 > 1", "SELECT * FROM ledger WHERE total = 5 OR 'q' = 'q'", "SELECT * FROM v WHERE a = 1 OR a = a", "SELECT * FROM v WHERE a = 1 OR a >= a", "SELECT * FROM v WHERE a = 1 OR b = c", "SELECT * FROM v WHERE a = 1 OR (true AND b <=> b)", "SELECT * FROM v WHERE a = 1 OR v.a + 1 = v.a + 1", "SELECT a FROM v WHERE NOT (a = 1) OR NOT false"],
    "union": ["SELECT total FROM ledger UNION SELECT secret FROM v", "SELECT total FROM ledger UNION ALL (SELECT 1)"],
    "table": ["SELECT * FROM payroll", "SELECT * FROM json.`/etc/hosts`", "SELECT (SELECT min(pay) FROM payroll) FROM v", "SELECT * FROM v WHERE EXISTS (SELECT 1 FROM payroll)", "WITH x AS (SELECT * FROM payroll) SELECT * FROM x", "SELECT * FROM explode(array(1))", "SELECT * FROM information_schema.columns", "SELECT * FROM IDENTIFIER('pay' || 'roll')", "SELECT * FROM v JOIN LATERAL (SELECT * FROM payroll) p", "SELECT * FROM v WHERE a IN (WITH v AS (SELECT * FROM payroll) SELECT a FROM v)"],
    "function": ["SELECT java_method('java.lang.Math', 'random') FROM v", "SELECT `reflect`('java.lang.Math', 'random') FROM v", "SELECT version() FROM v", "SELECT user FROM v", "SELECT user() FROM v", "SELECT current_catalog FROM v", "SELECT explode(sequence(1, 1000000000)) FROM v", "SELECT repeat(b, 1000000000) FROM v", "SELECT uuid() FROM v", "SELECT raise_error('x') FROM v", "SELECT my_schema.f(a) FROM v", "SELECT collect_list(a) FROM v", "SELECT input_file_name() FROM v", "SELECT read_files('x') FROM v"],
    "name from an expression": ["SELECT IDENTIFIER('re' || 'flect')('java.lang.Math', 'random') FROM v", "SELECT IDENTIFIER('java_method')('java.lang.Math', 'random') FROM v", "SELECT IDENTIFIER('no' || 'w')() FROM v", "SELECT IDENTIFIER('a') FROM v"],
    "form": ["SELECT TRANSFORM(a) USING 'sh' AS (b) FROM v", "SELECT transform(array(a), x -> x + 1) FROM v", "SELECT a FROM v TABLESAMPLE (5 PERCENT)", "FROM v |> WHERE a = 1 |> SELECT a"],
}
ALLOWED = [
    "SELECT count(*) FROM ledger WHERE posted", "SELECT branch, total FROM ledger WHERE branch NOT IN ('a', 'b') AND total BETWEEN 1 AND 9", "SELECT DISTINCT kind FROM ledger ORDER BY kind DESC LIMIT 3", "SELECT coalesce(sum(total), 0) AS t FROM ledger WHERE day >= date '2024-05-06'",
    "SELECT l.branch, max(d.day) FROM ledger l LEFT JOIN branch_day d ON l.branch = d.branch AND l.day = d.day GROUP BY l.branch HAVING count(*) > 2", "WITH big AS (SELECT * FROM ledger WHERE total > 9), few AS (SELECT * FROM big) SELECT count(*) FROM few",
    "SELECT `table`, insert, update FROM v", "SELECT a FROM v WHERE b = 'x; drop -- y /* z */'", "SELECT a, row_number() OVER (PARTITION BY b ORDER BY a ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) FROM v", "SELECT CASE WHEN a > 1 THEN 'p' ELSE 'q' END, now() FROM v",
    "SELECT * FROM v WHERE a = 1 OR b = 2", "SELECT * FROM (SELECT a FROM v) s WHERE a IN (SELECT a FROM v)", "SELECT v.user FROM v", "SELECT extract(year FROM c), trim(b), b || 'x', CAST(a AS decimal(9,2)), -a, a % 2 FROM v WHERE b LIKE 'x%' AND c IS NOT NULL",
    "SELECT sum(a) FILTER (WHERE b = 1), (SELECT max(a) FROM v) FROM v", "SELECT a FROM v WHERE EXISTS (SELECT 1 FROM ledger WHERE ledger.total = v.a)", "SELECT * FROM v a JOIN v b USING (a) EXCEPT SELECT * FROM v a JOIN v b USING (a)",
]


@pytest.mark.parametrize("sql", [s for kind in REFUSED.values() for s in kind])
def test_blocked(spark, sql):
    with pytest.raises(secure.Refused):
        secure.check_query(spark, sql, VIEWS)


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    assert secure.check_query(spark, sql, VIEWS) == sql


def test_chart_gate(spark):
    for sql in ("SELECT CASE WHEN a > 1 THEN 1 END FROM v", "SELECT now() FROM v", "SELECT current_date FROM v", "SELECT localtimestamp() FROM v", "SELECT curdate() FROM v"):
        assert secure.check_query(spark, sql, ["v"])
        with pytest.raises(secure.Refused):
            secure.check_query(spark, sql, ["v"], chart=True)
    with pytest.raises(secure.Refused):
        secure.check_query(spark, "SELECT salary FROM v", ["v"], prohibited=["Salary"])
    assert secure.check_query(spark, "SELECT 'salary' FROM v", ["v"], prohibited=["salary"])


def test_user_queries_side_by_side(spark):
    """Views of one name in two calls stay apart, leave nothing behind, and rows can be bounded."""
    sql = "WITH t AS (SELECT n FROM v) SELECT sum(n) AS s FROM t JOIN (SELECT max(n) AS m FROM v) ON n <= m ORDER BY s"
    first = secure.run_user_query(spark, sql, {"v": spark.range(3).toDF("n")})
    second = secure.run_user_query(spark, sql, {"v": spark.range(5).toDF("n")})
    assert (first.first()[0], second.first()[0]) == (3, 10) and not [t for t in spark.catalog.listTables() if t.name.startswith("user_")]
    assert [r.n for r in secure.run_user_query(spark, "SELECT n FROM v ORDER BY n DESC", {"v": spark.range(9).toDF("n")}, most=2).collect()] == [8, 7]


def test_trees(spark):
    """Chains of any depth, rings, and nodes of two parents."""
    edges = lambda *rows: spark.createDataFrame(rows, "node int, parent int")
    chain = edges(*((i, i + 1) for i in range(120)))
    leaf = spark.createDataFrame([(0, 1), (7, 5), (500, 2)], "node int, x int")
    got = {r.node: r.x for r in hierarchy.rollup(leaf, chain, ["x"]).collect()}
    assert got == {**{i: 1 for i in range(7)}, **{i: 6 for i in range(7, 121)}, 500: 2}
    roots = spark.createDataFrame([(118,), (900,)], "node int")
    assert {r.node for r in hierarchy.below(chain, roots).collect()} == {*range(119), 900}
    assert predicates.under(spark.range(200), "id", [100], chain).count() == 101
    for ring in (edges((1, 2), (2, 3), (3, 1)), edges((1, 1))):
        with pytest.raises(ValueError, match="ring"):
            hierarchy.rollup(leaf, ring, ["x"])
        with pytest.raises(ValueError, match="ring"):
            hierarchy.below(ring, roots)
    with pytest.raises(Exception, match="two parents"):
        hierarchy.rollup(leaf, edges((1, 2), (1, 3)), ["x"])


def test_secured_needs_its_column(spark):
    df = spark.range(3)
    for wrong in ({"allowed": []}, {"asked": [1]}, {"period": (datetime.date(2024, 1, 1),) * 2}):
        with pytest.raises(ValueError):
            secure.secured(df, **wrong)
    assert secure.secured(df, "id", None, [1]).count() == 1 and secure.secured(df, "id", [0, 1], [1, 2]).count() == 1


def test_period():
    day = datetime.date(2024, 1, 31)
    assert secure.period(1, day) == (datetime.date(2024, 1, 30),) * 2
    assert secure.period(7, day)[0] == datetime.date(2024, 1, 25) and secure.period(3, day) is None


def test_domain_and_empty_branches(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "xy")], "id int, s string")
    assert [r.id for r in df.filter(secure.domain(["|", ("s", "=", None), ("s", "ilike", "A")])).orderBy("id").collect()] == [1, 2]
    assert df.filter(secure.domain([])).count() == 3 and secure.secured(df, "id", []).count() == 0


def test_dates(spark):
    """The thirteen forms, years and months alone, days before months, and texts that are no date."""
    want = {
        "2020-12-31": "2020-12-31", "31/12/2020": "2020-12-31", "12/31/2020": "2020-12-31", "31-12-2020": "2020-12-31", "12-31-2020": "2020-12-31", "2020/12/31": "2020-12-31", "31.12.2020": "2020-12-31", "03.25.2020": "2020-03-25",
        "2020.12.31": "2020-12-31", "Dec 31, 2020": "2020-12-31", "31 dec 2020": "2020-12-31", "December 31, 2020": "2020-12-31", "31 December 2020": "2020-12-31", "05/04/2020": "2020-04-05", "5/1/2020": "2020-01-05", "1990": "1990-01-01",
        "1990-7": "1990-7-01", "20200325": "20200325", "soon": "soon", " 2020-02-30 ": "2020-02-30", "May 3, 2021": "2021-05-03", None: None, "": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(scalars.parse_date(F.col("t"))).collect()] == list(want.values())


def test_booleans(spark):
    """Each word with its value in the four ways to read it."""
    want = {
        "true": (True, True, True, True), " Yes ": (True, False, True, None), "t": (True, False, True, None), "x": (True, True, None, None), "checked": (True, True, None, None), "active": (True, False, None, None), "OFF": (False, False, None, None),
        "f": (True, False, False, None), "0": (False, False, False, None), "inactive": (False, False, None, None), "'False'": (True, False, None, False), "": (True, False, None, None), None: (True, False, None, None), "maybe": (True, False, None, None),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "i int, t string")
    c = F.col("t")
    got = df.orderBy("i").select(scalars.bool_active(c), scalars.bool_listed(c), scalars.bool_typed(c), scalars.bool_quoted(c)).collect()
    assert [tuple(r) for r in got] == list(want.values())


def test_scalars(spark):
    df = spark.createDataFrame([("EUR -3,50 due", "a@b, c@d,,a@b", 2.5, " m "), ("none", "", 3.5, "X"), (None, None, None, None)], "n string, e string, x double, g string")
    got = df.select(scalars.first_number(F.col("n")), scalars.integer_in(F.col("n")), scalars.emails(F.col("e")), coercions.bankers(F.col("x"), 0), coercions.gender(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(-3.5, -3, "a@b, c@d", 2.0, "Male"), (None, None, "", 4.0, "X"), (None, None, None, None, None)]


def test_fingerprint_tells_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("NULL", "c"), ("a ", "c"), ("a", "c"), ("", "c")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(etl.fingerprint(["x", "y"])).distinct().count() == len(rows)
    assert df.select(etl.fingerprint(["x", "y"], trimmed=True)).distinct().count() == len(rows) - 1
    assert df.select(etl.fingerprint(["y", "x"])).first() == df.select(etl.fingerprint(["x", "y"])).first()


def test_merge_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 1)], "id int, v string, n int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "x", 1), (2, "x", 1)], "id int, v string, n int")
    assert sorted(map(tuple, etl.merge(new, old, ["id"], ["n"]).collect())) == [(1, "c", 2), (2, "x", 1)]
    assert {(r.id, r.v): r.status for r in loads.insert_ignore(new.limit(2), old, ["id"]).collect()} == {(1, "b"): "duplicate", (1, "c"): "duplicate"}
    assert sorted(r.status for r in loads.insert_ignore(new.filter("id = 2"), old, ["id"]).collect()) == ["duplicate", "success"]


def test_alert_state(spark):
    run = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    state, told = spark.createDataFrame([], "fingerprint string"), []
    for rows in (run(1, 2), run(2), run(1, 2), run(), run(2)):
        new, state = alerts.since_last_run(rows, state)
        told.append(sorted(r.id for r in new.collect()))
        state = spark.createDataFrame(state.collect(), "fingerprint string")
    assert told == [[1, 2], [], [], [], [2]]  # without news the state stays, and it is emptied with the rows


def test_empty_names_match_nothing(spark):
    people = spark.createDataFrame([(1, "", ""), (2, "Ann", "Lee"), (3, None, "x")], "id int, first string, last string")
    listed = spark.createDataFrame([(9, "", "", ""), (8, "ann LEE", "", ""), (7, "z", "ann", "lee")], "entry int, name string, first string, last string")
    assert [tuple(r) for r in rules.screen_names(people, listed).collect()] == [(2, 7)]


def test_where_text(spark):
    assert predicates.where_domain(spark, "a = 1 OR b = 'x y' AND NOT c IN (1, 2)") == ["|", ("a", "=", 1), "&", ("b", "=", "x y"), "&", ("c", "not in", [1, 2]), ("c", "!=", None)]
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "i int, s string")
    for text in ("NOT s = 'x'", "s NOT IN ('x')", "NOT s IS NULL", "NOT (s = 'x' OR i = 3)", "s <> 'x'", "NOT s ILIKE 'X'"):  # as SQL judges nulls
        assert df.filter(secure.domain(predicates.where_domain(spark, text))).collect() == df.filter(text).collect(), text
    deep = predicates.with_paths(df, ["i.s", "i.i.s"], {"i": (df.filter("i < 3"), "i")}).orderBy("i")
    assert [tuple(r)[2:] for r in deep.collect()] == [("x", "x"), (None, None), (None, None)]
    with pytest.raises(ValueError, match="no table"):
        predicates.with_paths(df, ["s.t"], {"i": (df, "i")})


def test_drill_down(spark):
    views = {"v": spark.createDataFrame([(1, 2, "x", True), (2, 9, None, False), (3, 2, "y", True)], "id int, w_id int, s string, ok boolean"), "w": spark.createDataFrame([(2, 5), (3, 6)], "id int, n int")}
    keys = {"v": "id", "w": "id"}
    ids = lambda sql: (lambda t, rows: (t, sorted(r.id for r in rows.collect())))(*drill.drill_down(spark, sql, views, keys))
    assert ids("SELECT count(*) FROM v WHERE ok AND s <> 'x'") == ("v", [3])
    assert ids("SELECT count(*) FROM v JOIN w ON v.w_id = w.id") == ("v", [1, 3]) and ids("SELECT count(*) FROM v LEFT JOIN w ON v.w_id = w.id WHERE n IS NULL") == ("v", [2])
    assert ids("SELECT count(*) FROM v WHERE NOT s = 'x'") == ("v", [3]) and ids("SELECT s FROM (SELECT s, w_id AS k FROM v) t JOIN (SELECT * FROM w WHERE n > 5 OR n = 5) u ON t.k = u.id") == ("v", [1, 3])
    assert ids("SELECT a.s, count(*) FROM v a, w b WHERE b.n = 5 AND b.id = a.w_id GROUP BY a.s HAVING count(*) > 9") == ("v", [1, 3])
    for measure in ("sum(id)", "avg(id)", "1 + min(id)", "max(id) FILTER (WHERE ok)"):
        assert drill.drill_down(spark, f"SELECT {measure} FROM v WHERE ok", views, keys) is None
    for odd in ("SELECT count(*) FROM v JOIN w ON v.id = w.n", "SELECT count(*) FROM v, w", "SELECT count(*) FROM v FULL JOIN w ON v.w_id = w.id", "SELECT count(*) FROM v WHERE id + 1 = 2", "SELECT count(*) FROM v WHERE id IN (SELECT id FROM w)"):
        with pytest.raises(secure.Refused):
            drill.drill_down(spark, odd, views, keys)
    assert predicates.where_domain(spark, "(a = 1 OR b IS NULL) AND 3 < t.c") == ["&", "|", ("a", "=", 1), ("b", "=", None), ("t.c", ">", 3)]
    with pytest.raises(secure.Refused):
        predicates.where_domain(spark, "a = b")


def test_kpi(spark):
    df = spark.range(5)
    assert [statements.kpi(x).first()[0] for x in (df, df.agg(F.max("id")), df.filter("id > 9"), df.filter("id > 9").agg(F.max("id")), df.groupBy("id").count())] == ["5", "4", "0", "0", "5"]


def test_cdc(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (4, "x", 1), (4, "y", 2)], "id int, v string, n int")
    got = {r.id: (r.v, r.op) for r in etl.classify(new, old.withColumn("n", F.lit(1)), ["id"], order="n").collect()}
    assert got == {1: ("a", "unchanged"), 2: ("b", "updated"), 4: ("y", "new")}
    assert etl.merge(new.filter("id = 1").drop("n"), old, ["id"]).count() == 3
    assert etl.project(old, {"ID": "key", "gone": "x"}).columns == ["key"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;First Name\n1;x\n2;\n")
    rows = files.read_file(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["id", "First Name"] and rows.count() == 2 and rows.filter("`First Name` = ''").count() == 1
    assert files.match_columns(rows.columns, {"id": "Id", "first_name": "Given"}) == {"id": "id", "First Name": "first_name"}
    (tmp_path / "b.xml").write_text("<all><entity><n>1</n></entity><entity><n>2</n></entity></all>")
    assert files.read_file(spark, str(tmp_path / "b.xml")).count() == 2
    (tmp_path / "c.xml").write_text("<all>" + "".join(f"<sdnEntry><n>{i}</n></sdnEntry>" for i in range(2000)) + "</all>")
    assert files.read_file(spark, str(tmp_path / "c.xml")).count() == 2000
    assert files.record_tag("<party/><target/>") == "party" and files.record_tag("<row/>") is None


def test_stream_unseen(spark, tmp_path):
    src, day = str(tmp_path / "in"), datetime.datetime(2024, 1, 1)
    rows = [(1, "a", day), (1, "a", day), (2, "b", day)]
    spark.createDataFrame(rows, "id int, s string, ts timestamp").write.parquet(src)
    stream = alerts.stream_unseen(spark.readStream.schema("id int, s string, ts timestamp").parquet(src), "ts", ["id", "s"])
    q = stream.writeStream.format("memory").queryName("unseen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unseen").count() == 2


def test_csv_forms(spark, tmp_path):
    """Encodings, separators, fields with line ends, missing and empty files."""
    (tmp_path / "a.csv").write_bytes("\ufeffid;name\n1;Zoë\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,name\n1,Zoë\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes('id\tname\n1\t"a\nb ""c"""\n'.encode())
    (tmp_path / "d.csv").write_bytes("id,name\n1,Zoë\n".encode("utf-16"))
    (tmp_path / "e.csv").write_bytes(b"")
    got = [files.read_file(spark, str(tmp_path / f"{x}.csv")) for x in "abcd"]
    assert [df.columns for df in got] == [["id", "name"]] * 4
    assert [tuple(df.first()) for df in got] == [("1", "Zoë"), ("1", "Zoë"), ("1", 'a\nb "c"'), ("1", "Zoë")]
    with pytest.raises(ValueError):
        files.read_file(spark, str(tmp_path / "e.csv"))
    (tmp_path / "f.csv").write_text('36, "AERO", "-0- "\n37,"B ""x""",Cuba,more\n')
    assert sorted(map(tuple, files.read_feed(spark, str(tmp_path / "f.csv"), ["n", "name", "land"]).collect())) == [("36", "AERO", None), ("37", 'B "x"', "Cuba")]
    (tmp_path / "g.txt").write_bytes(b"\xef\xbb\xbfa\x00b\r\r\nc\r\n")
    assert [r[0] for r in files.clean_lines(spark, str(tmp_path / "g.txt")).collect()] == ["a b", "c"]


def test_records_that_span_lines(spark, tmp_path):
    """Quoted line ends far from the beginning, at the edges of splits, with doubled and stray quotes, blank lines and malformed records."""
    import csv
    import random

    rng = random.Random(1)
    texts = ["plain", 'say ""hi""', "two\nlines", 'a\n\n"",""\nb', "", ",", '5" pipe', "x" * 300, "\n", 'ends ""']
    rows = [[str(i), rng.choice(texts[:1] if i < 800 else texts), rng.choice(texts[:1] if i < 800 else texts)] for i in range(2000)]
    quoted = lambda t: t if t in ("plain", '5" pipe') or len(t) == 300 else f'"{t}"'
    body = "".join(",".join([r[0], quoted(r[1]), quoted(r[2])]) + "\n" for r in rows)
    (tmp_path / "a.csv").write_text("id,p,q\n" + body[: len(body) // 2].rsplit("\n", 1)[0] + body[len(body[: len(body) // 2].rsplit("\n", 1)[0]) :] + "\nbad,1\nbad,1,2,3\n")
    want = sorted(tuple(r) for r in csv.reader((tmp_path / "a.csv").open(newline=""), doublequote=True) if len(r) == 3 and r[0] != "id")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = files.read_csv(spark, str(tmp_path / "a.csv"))
            assert df.columns == ["id", "p", "q"] and sorted(map(tuple, df.collect())) == want and len(want) == 2000
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sheets(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>Ann</t></si></sst>")
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="s"><v>2</v></c><c r="D2" t="b"><v>1</v></c></row><row r="3"><c r="A3"><v>2</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    df = files.read_file(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["id", "name", "column_3", "ok"] and sorted(map(tuple, df.collect())) == [("1.5", "Ann", None, "true"), ("2", None, None, None)]
    from lakewarden.sources.sheets import read_sheet

    assert read_sheet(spark, str(tmp_path / "a.xlsx"), rows=1).count() == 1 and read_sheet(spark, str(tmp_path / "a.xlsx"), skip=1).columns[1] == "Ann"
    cell = lambda t, n=1: f'<t:table-cell t:number-columns-repeated="{n}">' + (f"<x:p>{t}</x:p>" if t else "") + "</t:table-cell>"
    with zipfile.ZipFile(tmp_path / "b.ods", "w") as z:
        body = f'<t:table-row>{cell("id")}{cell("v", 2)}{cell("", 5000)}{cell("far")}{cell("", 9000)}</t:table-row><t:table-row t:number-rows-repeated="3">{cell("", 4)}</t:table-row><t:table-row t:number-rows-repeated="2">{cell("1")}{cell("")}{cell("z")}</t:table-row><t:table-row t:number-rows-repeated="99999">{cell("", 9)}</t:table-row>'
        z.writestr("content.xml", f'<d xmlns:t="urn:t" xmlns:x="urn:x"><t:table>{body}</t:table><t:table><t:table-row>{cell("other")}</t:table-row></t:table></d>')
    from lakewarden.sources.sheets import sheet_rows

    assert [(r.row, r.cells) for r in sheet_rows(spark, str(tmp_path / "b.ods")).orderBy("row").collect()] == [(0, ["id", "v", "v", *[None] * 5000, "far"]), (4, ["1", None, "z"]), (5, ["1", None, "z"])]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b & c"), (2, None)], "id int, s string")
    assert files.html_table(df.orderBy("id")).first()[0] == "<table><tr><th>id</th><th>s</th></tr><tr><td>1</td><td>a&lt;b &amp; c</td></tr><tr><td>2</td><td></td></tr></table>"
    files.write_report(df, str(tmp_path / "r.xml"), "reports", "record")
    assert files.read_xml(spark, str(tmp_path / "r.xml") + "/part-*").count() == 2


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, '=1+1 "x"'), (3, None), (4, "two\nlines"), (5, "-5")], "id int, s string")
    files.write_csv(df, str(tmp_path / "out"))
    got = {r.id: r.s for r in files.read_csv(spark, str(tmp_path / "out") + "/part-*").collect()}
    assert got == {"1": "a,b", "2": '\'=1+1 "x"', "3": "", "4": "two\nlines", "5": "'-5"}


def test_stored_view(spark, tmp_path):
    """Each refresh is a version of its own; one that is not whole is not read."""
    path = str(tmp_path / "view")
    for n in (3, 4, 5):
        df = loads.user_view(spark, "stored_test", "SELECT count(*) AS n FROM v", {"v": spark.range(n)}, path)
        assert df.first().n == n == spark.table("stored_test").first().n
    assert loads.versions(spark, path) == [1, 2]
    (tmp_path / "view/v=3").mkdir()
    assert loads.stored_view(spark, path).first().n == 5


def test_columns_of_results():
    have = ["Branch", "customer_name", "branch_id", "Total_Hits"]
    assert [predicates.column_of(f, have) for f in ("x.branch_id", "BRANCH", "name", "customer_id", "id", "zip")] == ["branch_id", "Branch", "customer_name", "customer_name", "branch_id", None]
    assert [predicates.branch_column(c, w) for c, w in ((have, "t.BRANCH"), (have, None), (["id", "n"], None), (["sub_branch"], "x"), (["n"], None))] == ["Branch", "branch_id", "id", "sub_branch", None]
    assert [predicates.sort_column(have, w) for w in ("total_hits", None, "q")] == ["Total_Hits"] * 3 and predicates.sort_column(["a"]) is None


def test_rules_of_other_forms(spark):
    """Rules that are no plain look-up are semi-joins of their own, with the same hits."""
    rows, t = spark.createDataFrame([(1, 5, 10), (2, 6, 1)], "id int, account_id int, amount int"), spark.createDataFrame([(5, 7), (5, 8), (9, 1)], "account_id int, x int")
    r = lambda i, sql: rules.Rule(i, i, "low", sql)
    given = [r(1, "SELECT 1 FROM t a WHERE a.account_id = #ACCOUNT_ID# AND a.x < #AMOUNT#"), r(2, "SELECT 1 FROM t WHERE t.account_id = #ACCOUNT_ID#"), r(3, "SELECT count(*) FROM t a WHERE a.account_id = #ACCOUNT_ID#"), r(4, "SELECT 1 FROM t a WHERE a.x = 1 AND #AMOUNT# < 5"), r(5, "SELECT 1 FROM t a WHERE a.account_id = #ACCOUNT_ID# AND x > 7")]
    got = sorted((h.id, h.rule) for h in screening.template_hits(rows, given, {"t": t}, ["id"]).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 3), (2, 4)]


def test_log_tail(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    (src / "1.log").write_text("2024-01-01 10:00:00,1 12 ERROR db: lost\nplain\n")

    def run():
        q = files.tail_logs(spark, str(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.level or "", r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("", "plain"), ("ERROR", "lost")]
    (src / "2.log").write_text("2024-01-01 10:00:01,1 12 INFO db: back\n")
    assert run() == [("", "plain"), ("ERROR", "lost"), ("INFO", "back")]  # after a restart only what is new is read
