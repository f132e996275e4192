"""Prefix doubling over all positions in Spark: a slow second opinion on repeated strings, and the figures of the plain method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import stash


def repeated(docs: DataFrame, length: int = 100, first: int = 4) -> DataFrame:
    """docs(doc_id, text of ASCII letters) -> d, p: the starts of all strings of `length` bytes that start earlier too.

    Ranks begin as strings of `first` bytes; at each round (rank, rank at the offset) pairs are ranked anew, a rank being the first position of its
    string, and positions whose string is unique drop out, so that all longer ones that begin there are unique too.
    """
    size = first
    starts = docs.filter(F.length("text") >= length).select(F.col("doc_id").alias("d"), "text", F.explode(F.sequence(F.lit(0), F.length("text") - size)).alias("p"))
    ranked = starts.select("d", "p", F.substring("text", F.col("p") + 1, F.lit(size)).alias("key"))
    while True:
        where = F.struct("d", "p")
        kinds = ranked.groupBy("key").agg(F.min(where).alias("rank"), F.count("*").alias("n")).filter("n > 1")
        now = stash(ranked.join(kinds.select("key", "rank"), "key").select("d", "p", "rank"), f"doubling-{size}")
        if size == length:
            return now.filter(where != F.col("rank")).select("d", "p")
        step = min(size, length - size)
        ahead = now.select("d", (F.col("p") - step).alias("p"), F.col("rank").alias("after"))
        ranked = now.join(ahead, ["d", "p"]).select("d", "p", F.struct("rank", "after").alias("key"))
        size += step
