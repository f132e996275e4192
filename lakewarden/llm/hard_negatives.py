"""Hard negatives: for each anchor and positive, the closest rows of other labels that are not too close.

Scores are integer inner products of tiles of anchors and candidates, multiplied by Strassen's recursion. Arithmetic in int64 wraps
around, and Strassen's sums are exact in it whatever passes through between, so a score is exact if it fits itself. Two passes: anchors meet the rows
of their own label, and heaps of the best become their positives; then they meet all rows, and each positive's window has a heap of its
own. Heaps of different tiles and tasks merge by taking the best of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import stash

CHUNK = 32_768  #: candidates that meet in one task, on average
BLOCK = 4_096  #: anchors that meet in one task, on average
TILE = (512, 2_048)  #: anchors and candidates of a tile: 8 MB of scores
LEAF = 32  #: products of at most so many rows, columns or components are taken directly
NONE = -(2**63) + 1


def padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return x if x.shape == (rows, columns) else np.pad(x, ((0, rows - x.shape[0]), (0, columns - x.shape[1])))


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in int64 by seven products of halves; odd sides get a row or column of zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = padded(a, 2 * hm, 2 * hk), padded(b, 2 * hk, 2 * hn)
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22)
    p4, p5 = strassen(a22, b21 - b11), strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * hm, 2 * hn), np.int64)
    out[:hm, :hn] = p1 + p4 - p5 + p7
    out[:hm, hn:] = p3 + p5
    out[hm:, :hn] = p2 + p4
    out[hm:, hn:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The k best of each row, by score, ties to the smaller id; what is offered merges with what is there."""

    def __init__(self, rows: int, k: int):
        self.k, self.scores, self.ids = k, np.full((rows, k), NONE, np.int64), np.zeros((rows, k), np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, base: int = 0) -> None:
        """Scores [row, id] of the rows from `base`, where allowed."""
        rows = slice(base, base + len(scores))
        allowed = allowed & (scores >= self.scores[rows, -1:])
        if scores.shape[1] > self.k and allowed.sum() > 4 * self.k * len(scores):  # most are beaten in their own tile
            left = np.where(allowed, scores, NONE)
            allowed &= scores >= np.partition(left, -self.k, axis=1)[:, -self.k, None]
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        had = np.nonzero(self.scores[rows] != NONE)
        row, own = np.concatenate((row, had[0])), np.concatenate((ids[column], self.ids[rows][had]))
        score = np.concatenate((scores[allowed], self.scores[rows][had]))
        order = np.lexsort((own, ~score, row))
        row, own, score = row[order], own[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.scores[base + row[best], place[best]] = score[best]
        self.ids[base + row[best], place[best]] = own[best]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, id, score of all that is there."""
        row, place = np.nonzero(self.scores != NONE)
        return row, self.ids[row, place], self.scores[row, place]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, shorter ones with zeros behind."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def tiles(anchors: np.ndarray, candidates: np.ndarray):
    """Places and scores of all tiles of anchors x candidates; raises if a score could pass 63 bits."""
    wide = max(anchors.shape[1], candidates.shape[1])
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    if most(anchors) * most(candidates) * wide >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit in 63 bits; scale them down")
    a, c = padded(anchors, len(anchors), wide), padded(candidates, len(candidates), wide)
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(c), TILE[1]):
            yield slice(i, i + TILE[0]), slice(j, j + TILE[1]), strassen(a[i : i + TILE[0]], c[j : j + TILE[1]].T)


def split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The anchors and the candidates of a group."""
    role = table["role"].to_numpy()
    return table.filter(pa.array(role == 1)), table.filter(pa.array(role == 0))


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, label, v: floor(scale * x) of those without nulls and non-finite components; of rows of one id the smallest."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    one = F.min(F.struct("label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))).alias("r")
    return rows.groupBy("vec_id").agg(one).select("vec_id", "r.label", "r.v")


def merged(rows: DataFrame, by: list[str], other: str, k: int) -> DataFrame:
    """Heaps of all tasks merged: the k best of each group, with their rank."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), other)
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x) components. is_anchor judges vec_id and label. An anchor's positives are its best
    `positives` other rows of its label; for each, the best `negatives` rows of other labels follow whose score is `least` to `most` hundredths of
    the positive's. Ties go to the smaller vec_id. Rows of a null vec_id, label, vector or component, or of non-finite ones, take no part; of rows of
    one vec_id the smallest by label and vector counts; vectors of different lengths are compared as if zeros followed; other columns are
    ignored; an empty table gives an empty result. Products past 63 bits raise ValueError.
    """
    rows = stash(usable(vectors, scale).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "negrows")
    total, asked = rows.agg(F.count("*"), F.count_if("anchor")).first()
    by_label = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).filter("a > 0")
    buckets, most_small = max(1, -(-total // CHUNK)), CHUNK // 4
    large = F.col("n") > most_small  # a label of its own tasks; smaller ones share some
    parts, blocks = F.when(large, F.ceil(F.col("n") / CHUNK)).otherwise(1), F.when(large, F.ceil(F.col("a") / BLOCK)).otherwise(1)
    dealt = by_label.select("label", F.when(large, F.col("label")).alias("own"), parts.alias("parts"), blocks.alias("blocks"), F.pmod(F.xxhash64("label"), F.lit(buckets)).alias("bucket"))
    placed = rows.join(dealt, "label")
    at = lambda size: F.pmod(F.xxhash64("vec_id"), size)
    columns = ["own", "part", "block", "role", "vec_id", "label", "v"]
    part = lambda p: F.when(F.col("own").isNull(), F.col("bucket")).otherwise(p).cast("long").alias("part")
    kin = placed.select("*", part(at(F.col("parts"))), every(F.col("blocks")).alias("block"), F.lit(0).alias("role")).select(columns)
    ask = placed.filter("anchor").withColumn("_p", every(F.col("parts"))).select("*", part(F.col("_p")), at(F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role")).select(columns)

    def best(table: pa.Table) -> pa.Table:
        anchors, others = split(table)
        heaps, ids, other_ids = Heaps(len(anchors), positives), column(anchors, "vec_id"), column(others, "vec_id")
        labels, other_labels = column(anchors, "label"), column(others, "label")
        for i, j, scores in tiles(matrix(anchors["v"]), matrix(others["v"])):
            allowed = (labels[i, None] == other_labels[j]) & (ids[i, None] != other_ids[j])
            heaps.offer(scores, other_ids[j], allowed, i.start)
        row, own, score = heaps.entries()
        return pa.table({"anchor_id": pa.array(ids[row], pa.int64()), "positive_id": pa.array(own, pa.int64()), "score": pa.array(score, pa.int64())})

    found = kin.unionByName(ask).groupBy("own", "part", "block").applyInArrow(best, "anchor_id long, positive_id long, score long")
    top = merged(found, ["anchor_id"], "positive_id", positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p"))
    ready = rows.join(top, rows["vec_id"] == top["anchor_id"]).select("vec_id", "label", "v", F.col("p.positive_id").alias("p_ids"), F.col("p.score").alias("p_scores"))
    ready = stash(ready, "negpositives")
    chunks, groups = buckets, max(1, -(-asked // BLOCK))
    none = F.lit(None).cast("array<long>")
    cell = ["part", "block", "role", "vec_id", "label", "v", "p_ids", "p_scores"]
    left = rows.select(at(F.lit(chunks)).cast("int").alias("part"), every(F.lit(groups)).alias("block"), F.lit(0).alias("role"), "vec_id", "label", "v", none.alias("p_ids"), none.alias("p_scores"))
    right = ready.select(every(F.lit(chunks)).alias("part"), "*").select("*", at(F.lit(groups)).cast("int").alias("block"), F.lit(1).alias("role")).select(cell)

    def within(table: pa.Table) -> pa.Table:
        anchors, others = split(table)
        other_ids, labels, other_labels = column(others, "vec_id"), column(anchors, "label"), column(others, "label")
        own, scored = matrix(anchors["p_ids"]), matrix(anchors["p_scores"])
        known = np.arange(own.shape[1]) < np.array(anchors["p_ids"].combine_chunks().value_lengths(), np.int64)[:, None]
        share = lambda x, p: p * (x // 100) + p * (x % 100) // 100  # noqa: E731  floor of p hundredths, without a large product
        lo, hi = -share(-scored, least), share(scored, most)
        windows = [Heaps(len(anchors), negatives) for _ in range(own.shape[1])]
        for i, j, scores in tiles(matrix(anchors["v"]), matrix(others["v"])):
            apart = labels[i, None] != other_labels[j]
            for p, heaps in enumerate(windows):
                heaps.offer(scores, other_ids[j], apart & known[i, p, None] & (scores >= lo[i, p, None]) & (scores <= hi[i, p, None]), i.start)
        out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": [], "negative_id": [], "score": []}
        for p, heaps in enumerate(windows):
            row, negative, score = heaps.entries()
            for c, v in zip(out, (column(anchors, "vec_id")[row], own[row, p], scored[row, p], negative, score)):
                out[c].append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in out.items()})

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"
    met = left.select(cell).unionByName(right).groupBy("part", "block").applyInArrow(within, schema)
    chosen = merged(met, ["anchor_id", "positive_id", "positive_score"], "negative_id", negatives)
    return chosen.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
