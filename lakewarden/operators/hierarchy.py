"""Trees of any depth by pointer doubling: each round a node's pointer jumps twice as far up, so a tree of depth n takes log2(n) rounds of one row a node."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import SQL, customers


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir; where that is unset and Spark is one local process, as in tests, to a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="lakewarden-"))
    return df.checkpoint()


def _nodes(edges: DataFrame) -> DataFrame:
    """node and up, its parent or null, of every node in edges(node, parent). A node of two parents is an error."""
    named = edges.filter("node is not null").select("node", F.col("parent").alias("up"))
    tops = edges.filter("parent is not null").select(F.col("parent").alias("node"), F.lit(None).cast(edges.schema["parent"].dataType).alias("up"))
    found = named.unionByName(tops).groupBy("node").agg(F.max("up").alias("up"), (F.min("up") != F.max("up")).alias("_two"))
    return found.withColumn("up", F.when(F.col("_two"), F.raise_error(F.concat(F.lit("two parents of "), F.col("node").cast("string")))).otherwise(F.col("up"))).drop("_two")


def _doubled(state: DataFrame, step) -> DataFrame:
    """state(node, up, ..) -> its rows when no pointer is left. step(state) gives each node's new columns for one round; its pointer becomes its pointer's pointer.

    A ring never runs out of pointers: one that is left after as many levels as there are nodes is an error.
    """
    state, far = cut_lineage(state), 1
    size = state.count()
    while not state.filter("up is not null").isEmpty():
        if far > size:
            raise ValueError("the tree has a ring")
        over = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), *(F.col(c).alias(f"_{c}") for c in state.columns if c not in ("node", "up")))
        state, far = cut_lineage(step(state, state.join(over, "up", "left"))), far * 2
    return state


def rollup(leaves: DataFrame, edges: DataFrame, values: Sequence[str]) -> DataFrame:
    """leaves(node, values) and edges(node, parent) -> node and the sums of all that is at the node or below it, for every node with anything there.

    Each round adds to a node the sums of those that point to it, which lie just as far below it as it has been summed. A ring is an error, as is a node of two parents.
    """
    own = leaves.groupBy("node").agg(*(F.sum(v).alias(v) for v in values))
    spare = own.join(_nodes(edges), "node", "full").select("node", "up", *values)

    def step(state: DataFrame, jumped: DataFrame) -> DataFrame:
        more = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(*(F.sum(v).alias(f"_{v}_more") for v in values))
        added = [F.when(F.col(v).isNull(), F.col(f"_{v}_more")).otherwise(F.col(v) + F.coalesce(F.col(f"_{v}_more"), F.lit(0))).cast(state.schema[v].dataType).alias(v) for v in values]
        return jumped.join(more, "node", "left").select("node", F.col("_up").alias("up"), *added)

    return _doubled(spare, step).filter(" or ".join(f"`{v}` is not null" for v in values)).select("node", *values)


def below(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots(node), and every node of edges(node, parent) that lies below one of them."""
    marked = _nodes(edges).join(roots.distinct().withColumn("hit", F.lit(True)), "node", "full").select("node", "up", F.coalesce("hit", F.lit(False)).alias("hit"))
    either: Column = F.col("hit") | F.coalesce("_hit", F.lit(False))
    found = _doubled(marked, lambda state, jumped: jumped.select("node", F.col("_up").alias("up"), either.alias("hit")))
    return found.filter("hit").select("node")


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """A tree of chains of up to 50: each customer was introduced by the one before, but for the first of each fifty."""
    parent = F.when(F.col("customer_id") % 50 != 0, F.col("customer_id") - 1)
    return customers(spark, d).select(F.col("customer_id").alias("node"), parent.alias("parent"))


@query(SQL + "SELECT customer_id AS node, count(*) OVER w AS n, CAST(sum(score) OVER w AS DOUBLE) AS score FROM cust WINDOW w AS (PARTITION BY customer_id // 50 ORDER BY customer_id DESC)")
def introducer_rollup(spark: SparkSession, d: str) -> DataFrame:
    """For every customer the number and the balances of those that it introduced, directly or not, and its own: chains of 50 levels."""
    leaves = customers(spark, d).select(F.col("customer_id").alias("node"), F.lit(1).cast("long").alias("n"), "score")
    return rollup(leaves, _chains(spark, d), ["n", "score"]).select("node", "n", F.col("score").cast("double").alias("score"))


@query(SQL + "SELECT customer_id AS node FROM cust a WHERE EXISTS (SELECT 1 FROM cust b WHERE b.score > 9500 AND b.customer_id // 50 = a.customer_id // 50 AND b.customer_id <= a.customer_id)")
def introduced_below(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a large balance and all that they introduced, directly or not."""
    return below(_chains(spark, d), customers(spark, d).filter("score > 9500").select(F.col("customer_id").alias("node")))
