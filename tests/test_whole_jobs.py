"""Queries do their whole job on tables made for it."""

import datetime

import numpy as np
import pytest

from lakewarden import catalog
from lakewarden.functions import phrases
from lakewarden.sources import tables

SF = "/root/testdata/sf0.001"


def test_except_rows_looks_at_all_days_before(spark, tmp_path):
    """What was seen on any earlier day is not new, however long ago that was."""
    day = lambda n: datetime.datetime(2024, 1, n, 12)
    rows = [(day(2), 1, "click"), (day(20), 1, "click"), (day(14), 2, "view"), (day(16), 2, "view"), (day(2), 3, "view"), (day(15), 3, "click"), (day(16), 3, "click")]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in catalog.queries()["except_rows"](spark, str(tmp_path)).collect()] == [(3, "click")]
    assert "2024-01-14" not in catalog.oracle_sql()["except_rows"]


@pytest.mark.parametrize("name", ["sql_rules_many", "sql_rule_hits", "top_products_5way"])
def test_rows_are_dealt_to_bounded_tasks(spark, monkeypatch, name):
    """Tables of more rows than a task should hold are dealt to more tasks, with the same result."""
    few = sorted(map(tuple, catalog.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(tables, "ROWS_IN_TASK", 500)
    df = catalog.queries()[name](spark, SF)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == few


def test_rows_are_dealt_below_sparks_own_number(spark, monkeypatch):
    """What a task holds does not hang on Spark's number of shuffle partitions, whether that is above or below the tasks that rows are dealt to."""
    lines = tables.load(spark, SF, "lineitem")
    monkeypatch.setattr(tables, "ROWS_IN_TASK", -(-lines.count() // 12))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for own in ("4", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", own)
        try:
            assert tables.parts_for(lines) == 12
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    monkeypatch.setattr(tables, "ROWS_IN_TASK", lines.count())
    assert tables.parts_for(lines) == 0


def test_phrases_send_a_row_for_each_text_and_phrase(spark, monkeypatch):
    """No row is made for a place of a text; a filter that lets everything pass changes nothing; texts of one id are added up."""
    monkeypatch.setattr(phrases, "_list_filter", lambda listed: np.full(phrases.FILTER_BITS // 64, -1))
    texts = spark.createDataFrame([(1, "Ab cd, ab CD " * 5_000), (1, "ab cd"), (2, "İ ab  cd é"), (None, "é é")], "id int, text string")
    df = phrases.find_phrases(texts, spark.createDataFrame([("AB cd",), ("é",), ("ab",)], "phrase string"))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r)[:4] for r in df.collect()), key=repr) == sorted([(None, "é", 2, 1), (1, "AB cd", 10_001, 1), (1, "ab", 10_001, 1), (2, "ab", 1, 3), (2, "é", 1, 10)], key=repr)
