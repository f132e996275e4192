"""Polled jobs as streams: each micro-batch is a run with a number, whose output and state are folders of that number.

A run reads the state of the one before and overwrites its own folders, so one that is repeated after a crash gives the same files, and nothing is told twice or lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakewarden.operators.rules import Rule
from lakewarden.operators.screening import screen_backlog
from lakewarden.plans.etl import fingerprint
from lakewarden.streaming.alerts import since_last_run

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run_with_state(stream: DataFrame, step: Step, folder: str, state: str) -> StreamingQuery:
    """Starts `step(rows of a run, state) -> (what it tells, the next state)` for each micro-batch of what the stream has.

    What is told lands in folder/told/run=<n>; `state` is the DDL of the state's columns, of which the last two versions are kept. The run number is the
    micro-batch's, which the stream's checkpoint hands out again when a run did not end.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(state).parquet(f"{folder}/state/{number - 1}") if number else spark.createDataFrame([], state)
        told, new = step(batch, old)
        new.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        told.write.mode("overwrite").parquet(f"{folder}/told/run={number}")
        if number > 1:
            _delete(spark, f"{folder}/state/{number - 2}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def alert_runs(stream: DataFrame, columns: Sequence[str], folder: str) -> StreamingQuery:
    """An alert as a stream of polls: a run tells the rows that the last run with news had not."""
    return run_with_state(stream, lambda rows, last: since_last_run(rows, last, columns), folder, "fingerprint string")


def changes(rows: DataFrame, store: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, op) of rows against the hash store(keys, fingerprint): new, updated or unchanged, and the store with their hashes. A key's last row by all columns counts."""
    others = [c for c in columns if c not in keys]
    hashed = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in others)).select(*keys, fingerprint([*keys, *others]).alias("fingerprint"))
    both = hashed.join(store.withColumnRenamed("fingerprint", "_old"), list(keys), "full")
    op = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("fingerprint"), "unchanged").otherwise("updated")
    told = both.filter("fingerprint is not null").select(*keys, op.alias("op"))
    return told, both.select(*keys, F.coalesce("fingerprint", "_old").alias("fingerprint"))


def change_runs(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], folder: str) -> StreamingQuery:
    """Change detection as a stream: a run tells how its rows differ from all runs before, of which a store keeps one hash a key."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    return run_with_state(stream, lambda rows, store: changes(rows, store, keys, columns), folder, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "fingerprint string"]))


def screen_on_insert(stream: DataFrame, rules: Sequence[Rule], folder: str, looked_up: DataFrame | None = None, by: str | None = None) -> StreamingQuery:
    """New rows are screened as they come in, with the fields of a table joined by a key if given, and land once in folder/told/run=<n>."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch if looked_up is None else batch.join(looked_up, by, "left")
        screen_backlog(rows, rules).write.mode("overwrite").parquet(f"{folder}/told/run={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
