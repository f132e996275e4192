"""Surrogate numbers, interval joins, work calendars, nested reports and matches over runs against plain versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import calendars, ranges, regulatory, screening


def test_numbers_without_gaps(spark):
    """Half of the rows have one key, some none; no task has more than twice the mean."""
    n = F.col("id")
    df = spark.range(0, 4000, 1, 5).select(F.when(n % 2 == 0, 7).when(n % 11 == 0, None).otherwise((n * 7919) % 1000).alias("k"), (n % 3).alias("v"))
    out = ranges.numbered(df, ["k", F.desc("v")], partitions=8)
    rows = sorted(out.collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(1, 4001))
    order = [(r.k is not None, r.k or 0, -r.v) for r in rows]
    assert order == sorted(order)
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) <= 2 * 4000 / 8
    assert ranges.numbered(df.limit(0), ["k"]).collect() == []


@pytest.mark.parametrize("by", [[], ["g"]])
def test_interval_join(spark, by):
    rng = random.Random(4)
    points = [(i, rng.choice([5.0, rng.random() * 100, None]), i % 3) for i in range(400)]
    intervals = [(j, a, a + rng.choice([0.0, 3.0, 90.0]), j % 3) for j in range(40) for a in [rng.choice([5.0, rng.random() * 100])]] + [(90, None, 4.0, 0), (91, 9.0, 2.0, 0), (92, -1e9, 1e9, 1)]
    p, q = spark.createDataFrame(points, "i int, x double, g int"), spark.createDataFrame(intervals, "j int, a double, b double, g int")
    got = ranges.interval_join(p, "x", q if by else q.drop("g"), "a", "b", by, bins=9)
    want = [(i, j) for i, x, g in points for j, a, b, h in intervals if x is not None and a is not None and a <= x <= b and (not by or g == h)]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bins(spark):
    values = [0.0, 1.0, 1.5, 2.0, 3.9, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(ranges.bin_of(F.col("x"), [1.0, 2.0, 4.0])).collect()] == [0, 1, 1, 2, 2, 3, 3]
    assert df.select(ranges.bin_of(F.col("x"), [])).distinct().collect() == [(0,)]


def test_interval_join_of_days(spark):
    day = datetime.date
    p = spark.createDataFrame([(1, day(2024, 1, 5)), (2, day(2024, 2, 1)), (3, None)], "i int, d date")
    q = spark.createDataFrame([("x", day(2024, 1, 5), day(2024, 2, 1)), ("y", day(2023, 1, 1), day(2024, 1, 5))], "j string, a date, b date")
    assert sorted((r.i, r.j) for r in ranges.interval_join(p, "d", q, "a", "b").collect()) == [(1, "x"), (1, "y"), (2, "x")]


def test_work_days(spark):
    """Against a walk over every day."""
    rng = random.Random(6)
    rows, at = [], datetime.datetime(1969, 12, 20)
    for i in range(300):
        a = at + datetime.timedelta(minutes=rng.randrange(60 * 24 * 900))
        rows.append((i, i % 4, a, a + datetime.timedelta(minutes=rng.choice([-5, 0, 30, 600, 3000, 40_000]))))

    def plain(calendar, a, b):
        days, day = 0.0, datetime.datetime.combine(a.date(), datetime.time())
        while day < b:
            own = [(f, t) for c, w, f, t in calendars.CALENDARS if c == calendar and w == day.weekday()]
            lo, hi = max(0.0, (a - day).total_seconds() / 3600), (b - day).total_seconds() / 3600
            hours = sum(max(0.0, min(hi, t) - max(lo, f)) for f, t in own)
            if own and a < b:
                days += int(16 * hours / sum(t - f for f, t in own) + 0.5) / 16
            day += datetime.timedelta(1)
        return days

    cal = spark.createDataFrame(calendars.CALENDARS, "calendar_id int, weekday int, hour_from double, hour_to double")
    df = spark.createDataFrame(rows, "i int, calendar_id int, a timestamp_ntz, b timestamp_ntz").join(calendars.weeks(cal), "calendar_id")
    got = {r.i: r.d for r in df.select("i", calendars.work_days(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: plain(c, a, b) for i, c, a, b in rows if c < 3}


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="report"><xs:complexType><xs:sequence>
<xs:element name="rentity_id" type="xs:long"/><xs:element name="submission_date" type="xs:date"/><xs:element name="reason" type="xs:string"/>
<xs:element name="account" maxOccurs="unbounded"><xs:complexType><xs:sequence><xs:element name="account_id" type="xs:long"/><xs:element name="transaction" maxOccurs="unbounded"><xs:complexType><xs:sequence>
<xs:element name="transactionnumber" type="xs:string"/><xs:element name="transaction_description" type="xs:string"/><xs:element name="amount_local" type="xs:decimal"/><xs:any minOccurs="0" maxOccurs="2" processContents="skip"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>
<xs:element name="report_indicators"><xs:complexType><xs:sequence><xs:element name="indicator" type="xs:string" minOccurs="1" maxOccurs="9"/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""


def test_nested_reports(spark, tmp_path):
    day = datetime.date(2024, 3, 1)
    lines = [(1, day, 10, 1, 60000, "D", 5, "a <b> & c"), (1, day, 10, 2, -70, "C", 6, "plain"), (1, day, 11, 1, 80, "C", None, "no party"), (2, day, 12, 1, 5, "D", 5, "small")]
    made = regulatory.reports(
        spark.createDataFrame(lines, "branch_id long, day date, account_id long, line int, amount int, kind string, person_id int, description string"),
        spark.createDataFrame([(5, "Ann", None), (6, "Bo", "GH")], "person_id int, name string, country string"),
    )
    regulatory.write_reports(made, str(tmp_path / "out"))
    (tmp_path / "report.xsd").write_text(XSD)
    back, bad = regulatory.read_reports(spark, str(tmp_path / "out"), made.schema)
    assert bad.count() == 0 and sorted(back.collect(), key=lambda r: r[0])[0] == made.filter("rentity_id = 1").first()
    assert back.filter("rentity_id = 1").select(F.col("account.transaction")[0][0]["t_from"]["person"]).first()[0] == ("Ann", "NG")
    good, bad = regulatory.read_reports(spark, str(tmp_path / "out"), made.schema, str(tmp_path / "report.xsd"))  # the second report has no indicator
    assert [r.rentity_id for r in good.select("rentity_id").collect()] == [1] and "<rentity_id>2" in bad.first().record


def test_matches_over_runs(spark):
    kept = spark.createDataFrame([(1, "pep", 5, "confirmed", "x"), (2, "pep", 5, "dismissed", "x"), (3, "pep", 5, "pending", None), (4, "pep", None, "confirmed", "y")], "customer_id int, list string, match_id int, state string, reviewed_by string")
    found = spark.createDataFrame([(1, "pep", 5), (2, "pep", 6), (2, "pep", 5), (4, "pep", 1), (1, "watch", 5), (9, "pep", 2)], "customer_id int, list string, match_id int")
    got = sorted(map(tuple, screening.merge_matches(kept, found).collect()))
    assert got == [(1, "pep", 5, "confirmed", "x"), (1, "watch", 5, "pending", None), (2, "pep", 6, "pending", None), (3, "pep", 5, "pending", None), (4, "pep", 1, "pending", None), (9, "pep", 2, "pending", None)]
    assert screening.merge_matches(kept, found.limit(0)).count() == 4
