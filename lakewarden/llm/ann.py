"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

A vector's hash string in a tree is the signs of BITS random projections, packed into a number. Vectors are dealt to chunks of
bounded size by a hash; in a chunk each tree is a sorted array of hash strings. A query descends every tree to its longest
common prefix, then ascends all trees together, one bit at a time, taking what shares the prefix, until it has enough
candidates, which are scored exactly; the chunks' best are merged. Queries are dealt out in blocks, so a task holds one chunk and one
block whatever the input. Equal vectors are indexed once, with as many of their smallest ids as an answer can hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import stash

TREES = 64
BITS = 24
CHUNK = 16_384  #: vectors in a chunk, on average
BLOCK = 16_384  #: queries in a block, on average; a chunk's forest is built once for each block
CANDIDATES = 0.27  #: share of a chunk that the prefix matches of a query sum to in half at least; fixes recall (0.92 on unit vectors of 64 dimensions in all directions, by 42 % of a chunk)
LEAST = 1000


def planes(dim: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, TREES * BITS))


def hashes(x: np.ndarray) -> np.ndarray:
    """Hash strings [tree, vector] of the rows of x, the first bit the highest."""
    signs = (x @ planes(x.shape[1]) > 0).reshape(len(x), TREES, BITS)
    return (signs @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))).T.astype(np.uint64)


def usable(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, v (doubles): those with an id that are not null, empty, zero or hold null or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & fine).dropDuplicates(["vec_id", "v"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest of vectors(vec_id, embedding) for each of queries(vec_id, embedding): query_id, rank, vec_id, score.

    A query's own id is left out; ties go to the smaller id; vectors that usable() drops take no part; vectors of another length
    than the query's are no candidates; repeated rows count once; other columns are ignored; empty tables give an empty result.
    """
    smallest = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k + 1).alias("ids")
    parts = usable(vectors).groupBy("v", F.pmod(F.hash("vec_id"), F.lit(512)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    index = stash(parts.groupBy("v").agg(smallest("ids")), "annindex")
    asked = stash(usable(queries).withColumnRenamed("vec_id", "query_id"), "annqueries")
    n, q = index.count(), asked.count()
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-q // BLOCK))
    every = lambda c, size: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(c)
    left = index.select(F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int").alias("chunk"), every("block", blocks), "v", "ids")
    right = asked.select(every("chunk", chunks), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "v")

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dim, part in ask.groupby(ask["v"].map(len)):
            mine = own[own["v"].map(len) == dim]
            if len(mine):
                out += nearest(np.stack(mine["v"].tolist()), mine["ids"].tolist(), part["query_id"].to_numpy(), np.stack(part["v"].tolist()), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(x: np.ndarray, ids: list, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The best of one chunk for a block of queries."""
    own, asked = hashes(x), hashes(queries)
    order = np.argsort(own, axis=1, kind="stable")
    arrays = np.take_along_axis(own, order, axis=1)
    enough = min(len(x), max(LEAST, int(CANDIDATES * len(x))))
    # ascend: at each prefix length, the range of every tree's array, for all queries at once
    lo = np.zeros((TREES, len(queries)), np.int64)
    hi = np.full((TREES, len(queries)), len(x), np.int64)
    open_ = np.ones(len(queries), bool)
    for bits in range(BITS, -1, -1):
        if not open_.any():
            break
        shift = np.uint64(BITS - bits)
        at = np.flatnonzero(open_)
        total = np.zeros(len(at), np.int64)
        for t in range(TREES):
            first = (asked[t, at] >> shift) << shift
            lo[t, at] = np.searchsorted(arrays[t], first, "left")
            hi[t, at] = np.searchsorted(arrays[t], first + ((np.uint64(1) << shift) - np.uint64(1)), "right")
            total += hi[t, at] - lo[t, at]
        open_[at[total >= enough * 2]] = False
    out: list[tuple[int, int, float]] = []
    seen = np.zeros(len(x), bool)
    for i in range(len(queries)):
        for t in range(TREES):
            seen[order[t, lo[t, i] : hi[t, i]]] = True
        at = np.flatnonzero(seen)
        seen[at] = False
        score = x[at] @ queries[i]
        if len(at) > k + 1:
            least = np.partition(score, len(at) - k - 1)[len(at) - k - 1]
            at, score = at[score >= least], score[score >= least]
        exact = [(float(np.dot(x[j], queries[i])), j) for j in at]
        rows = [(int(query_ids[i]), int(v), s) for s, j in exact for v in ids[j] if v != query_ids[i]]
        rows.sort(key=lambda r: (-r[2], r[1]))
        out += rows[:k]
    return out
