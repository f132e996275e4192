"""Helpers shared by the operators: shared-folder tables, size checks and word rules."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def text_hash(text: Column) -> Column:
    """What tells apart the texts of rows of one doc_id; null and empty are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark is one local process, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lakewarden-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_MADE = threading.local()  #: paths of the tables that this thread has stashed and not deleted


def _made() -> list[str]:
    if not hasattr(_MADE, "paths"):
        _MADE.paths = []
    return _MADE.paths


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation.

    Spark is asked to delete the step's shuffle files when it is done, for nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _made().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(tables: Sequence[DataFrame]) -> set[str]:
    return {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in tables for f in df.inputFiles()}


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    names = _folders(tables)
    _delete(tables[0].sparkSession, [p for p in _made() if p.rsplit("/", 1)[1] in names])


def mark() -> int:
    """A place in the list of stashed tables, for drop_since."""
    return len(_made())


def drop_since(place: int, *keep: DataFrame) -> None:
    """Delete the tables stashed since then, but for those that `keep` reads."""
    names = _folders(keep)
    _delete(keep[0].sparkSession, [p for p in _made()[place:] if p.rsplit("/", 1)[1] not in names])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made().remove(p)


_HELD: dict[str, list] = {}  #: what this worker keeps between tasks, by step


def held(step: str) -> list:
    """What a worker keeps between tasks of a step. A task of another step lets go of it, for workers outlive steps and share an executor's memory."""
    for other in [k for k in _HELD if k != step]:
        del _HELD[other]
    return _HELD.setdefault(step, [])


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has at most so many rows; else leave the join to a shuffle. df should be cheap to count (a stashed table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def buckets_for(rows: int, each: int = 20_000, least: int = 64) -> int:
    """A bucket count that keeps about `each` rows in a bucket at any input size."""
    return max(least, -(-rows // each))


def running_total(df: DataFrame, group: str, bucket: str, amount: str, out: str) -> DataFrame:
    """Per (group, bucket): the total of `amount` in the group's earlier buckets. The window sees one row per bucket, not per input row."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(amount).alias("_sum"))
    return sums.select(group, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias(out))


ROWS = 1_000  #: of a batch that map_column turns into Python objects at a time


def map_column(df: DataFrame, keep: Sequence[str], column: str, start: Callable[[], Callable[[list], dict]], out: str) -> DataFrame:
    """The columns `keep` of df as they are, and those named in out: start() gives, once a task, the function from a batch's values of `column` to them."""
    made = StructType.fromDDL(out)
    schema = StructType([df.schema[c] for c in keep] + made.fields)
    kinds = to_arrow_schema(made)
    sent = [F.col(c) for c in keep] + ([] if column in keep else [F.col(column).alias("_in")])  # a column that is kept anyway is sent once
    at_column = [*keep, column].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):  # a batch's values as Python objects take several times its memory
                batch = whole.slice(at, ROWS)
                found = step(batch.column(at_column).to_pylist())
                new = [pa.array(found[f.name], f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, *kinds.names])

    return df.select(*sent).mapInArrow(run, schema)


FILTER_BITS = 1 << 26  #: of a membership filter: 8 MB at any input size; a fuller one lets more pass, which an exact join removes


def membership(keys: DataFrame, column: str) -> np.ndarray:
    """A one-hash Bloom filter of a long column, as FILTER_BITS bits in bytes; the driver gets FILTER_BITS / 64 words at most."""
    at = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (as unsigned numbers) the filter lets pass."""
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
