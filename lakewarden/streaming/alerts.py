"""Alerts that tell only rows not told before, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.plans.etl import fingerprint
from lakewarden.registry import query
from lakewarden.sources.tables import load


def unseen(rows: DataFrame, seen: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The distinct rows whose fingerprint is not in seen(fingerprint), with it."""
    marked = rows.withColumn("fingerprint", fingerprint(columns or rows.columns)).dropDuplicates(["fingerprint"])
    return marked.join(seen.select("fingerprint"), "fingerprint", "left_anti")


def stream_unseen(rows: DataFrame, time: str, columns: Sequence[str], keep: str = "7 days") -> DataFrame:
    """A stream's rows, each fingerprint once within `keep` of event time; the state of older ones is dropped with the watermark."""
    return rows.withColumn("fingerprint", fingerprint(columns)).withWatermark(time, keep).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(rows: DataFrame, time: str, key: str, size: str, late: str = "1 hour") -> DataFrame:
    """Counts of a key by event-time window; rows later than `late` are dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def since_last_run(rows: DataFrame, last: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that the last run had not, and the state to keep: last(fingerprint) holds the rows of the last run with news alone, so a row that leaves and
    comes back is news again. The state is replaced when there is news, emptied when there are no rows, and else stays."""
    marked = rows.withColumn("fingerprint", fingerprint(columns or rows.columns)).dropDuplicates(["fingerprint"])
    new = marked.join(last.select("fingerprint"), "fingerprint", "left_anti")
    any_, news = marked.limit(1).select(F.lit(1).alias("_any")), new.limit(1).select(F.lit(1).alias("_news"))
    stays = last.select("fingerprint").join(any_, how="left_semi").join(news, how="left_anti")
    return new, marked.select("fingerprint").join(news, how="left_semi").unionByName(stays)


@query("WITH r AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) SELECT user_id, event_type FROM r WHERE day = DATE '2024-01-11' EXCEPT SELECT user_id, event_type FROM r WHERE day = DATE '2024-01-10'")
def alert_last_run(spark: SparkSession, d: str) -> DataFrame:
    """Three runs of an alert on one day each: what came back on the third day after a day's absence is told again."""
    e = load(spark, d, "events")
    on = lambda day: e.filter(F.to_date("ts") == F.lit(day).cast("date")).select("user_id", "event_type")
    state = spark.createDataFrame([], "fingerprint string")
    for day in ("2024-01-09", "2024-01-10", "2024-01-11"):
        new, state = since_last_run(on(day), state)
    return new.select("user_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15' EXCEPT SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15'")
def except_rows(spark: SparkSession, d: str) -> DataFrame:
    """What was not seen on any day before."""
    e = load(spark, d, "events")
    old = e.filter("ts < timestamp_ntz '2024-01-15'").select("user_id", "event_type")
    new = e.filter("ts >= timestamp_ntz '2024-01-15'").select("user_id", "event_type")
    seen = old.select(fingerprint(["user_id", "event_type"]).alias("fingerprint")).distinct()
    return unseen(new, seen, ["user_id", "event_type"]).select("user_id", "event_type")
