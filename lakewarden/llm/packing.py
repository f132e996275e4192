"""Packing by non-negative least squares.

Documents are cut into full windows and a tail. Tails fall into length classes of UNIT tokens; every way to fill a window with at
most DEPTH classes is a strategy, and least squares with non-negative repeat counts against the class histogram picks
the counts. Counts are rounded to what the histogram holds; the residual classes are packed greedily, cutting the last piece of a
window to fit. The driver sees the histogram (WINDOW / UNIT numbers) and the slots of the plan alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import buckets_for, held, running_total, stash

WINDOW = 2048
UNIT = 8
DEPTH = 3
CACHE_WORDS = 700_000  #: token ids of words kept by a Python worker
_ODD = re.compile("[\x1c-\x1f]")


def encoder(path: str):
    """A function from a list of texts to their token ids as arrays; words between white space are encoded once while in the cache."""
    from tokenizers import Tokenizer

    last = held("packing")  # the path of the last task's tokenizer, the tokenizer and the ids of words
    if not last or last[0] != path:
        last[:] = [path, Tokenizer.from_file(path), {}]
    _, tokenizer, cache = last
    mark = next((t.content for t in tokenizer.get_added_tokens_decoder().values()), None)
    mark_id = tokenizer.token_to_id(mark) if mark else None

    def encode(texts: list[str]) -> list[bytes]:
        split = [None if _ODD.search(t) else t.split() for t in texts]
        fresh = list(set().union(*(words for words in split if words)).difference(cache))
        own = cache if len(cache) + len(fresh) <= CACHE_WORDS else {}
        plain = [w for w in fresh if mark and "<|" not in w]
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            ids = np.array(tokenizer.encode(mark.join(part), add_special_tokens=False).ids, "<u2")
            ends = [*(2 * np.flatnonzero(ids == mark_id)).tolist(), 2 * len(ids)]
            raw = ids.tobytes()
            own.update(zip(part, (raw[lo:hi] for lo, hi in zip([0, *(e + 2 for e in ends[:-1])], ends, strict=True)), strict=True))
        for w in fresh:
            if w not in own:  # it holds a special token
                own[w] = np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u2").tobytes()
        get = own.__getitem__ if own is cache else lambda w: own[w] if w in own else cache[w]
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]

    return encode


def tokenize(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """docs(doc_id, text) -> row, doc_id, n, ids: the document's token ids and the end id, as little-endian 16-bit numbers; a null text is empty."""
    last = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                ids = [b + last for b in encode([t or "" for t in part["text"]])]
                yield pd.DataFrame({"row": part["row"], "doc_id": part["doc_id"], "n": [len(b) // 2 for b in ids], "ids": ids})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "row long, doc_id string, n long, ids binary").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def strategies(cap: int) -> np.ndarray:
    """All ways to fill cap units with at most DEPTH classes, one column each."""
    found: list[tuple[int, ...]] = []

    def fill(prefix: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(prefix)
        elif len(prefix) < DEPTH:
            for c in range(min(left, most), 0, -1):
                if c * (DEPTH - len(prefix)) < left:
                    break
                fill((*prefix, c), left - c, c)

    fill((), cap, cap)
    a = np.zeros((cap, len(found)))
    for j, parts in enumerate(found):
        for c in parts:
            a[c - 1, j] += 1
    return a


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |ax - b| with x >= 0, by the active-set method; the residual is kept, so nothing larger than a itself is formed."""
    x, rest = np.zeros(a.shape[1]), b.astype(float)
    active: list[int] = []
    most = max(1.0, np.abs(a.T @ rest).max())
    for _ in range(3 * len(b)):
        w = a.T @ rest
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-6 * most:
            break
        active.append(j)
        while active:
            own = np.array(active)
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if s.min() > 1e-12:
                x[:] = 0
                x[own] = s
                break
            low = s <= 1e-12
            step = np.min(x[own][low] / np.maximum(x[own][low] - s[low], 1e-300))
            x[own] += np.clip(step, 0, 1) * (s - x[own])
            active = [k for k in active if x[k] > 1e-12]
            x[[k for k in own if k not in active]] = 0
        rest = b - a[:, active] @ x[active]
    return x


def plan(histogram: np.ndarray, cap: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Slots (class, first rank, end rank, first unit, end unit, first sequence, place in it) for the tails counted by class; the number of sequences.

    The tails of ranks lo to hi of a class lie one each in the sequences from the first on.
    """
    slots: list[tuple[int, int, int, int, int, int, int]] = []
    used, sequences = np.zeros(cap, np.int64), 0
    if histogram.sum():
        a = strategies(cap)
        weight = np.sqrt(np.arange(1, cap + 1))
        x = least_squares(a * weight[:, None], histogram * weight)
        for j in np.argsort(-x, kind="stable"):
            parts = np.flatnonzero(a[:, j])
            n = int(min(round(float(x[j])), *((histogram[c] - used[c]) // int(a[c, j]) for c in parts)))
            if x[j] <= 0:
                break
            if n > 0:
                place = 0
                for c in parts[::-1]:
                    for _ in range(int(a[c, j])):
                        slots.append((int(c) + 1, int(used[c]), int(used[c]) + n, 0, int(c) + 1, sequences, place))
                        used[c] += n
                        place += 1
                sequences += n
    groups = [[c + 1, 0, int(used[c]), int(histogram[c] - used[c])] for c in range(cap) if histogram[c] > used[c]]  # class, first unit, first rank, count
    while groups:
        groups.sort(key=lambda g: g[1] - g[0])
        take: list[list] = []  # group, units
        count: dict[int, int] = {}
        need = cap
        while need:
            free = [i for i, g in enumerate(groups) if g[3] > count.get(i, 0)]
            i = next((i for i in free if groups[i][0] - groups[i][1] <= need), None)
            if i is None and free:
                i = free[-1]
            if i is None:
                break
            units = min(need, groups[i][0] - groups[i][1])
            take.append([i, units])
            count[i] = count.get(i, 0) + 1
            need -= units
        n = min(groups[i][3] // k for i, k in count.items())
        for place, (i, units) in enumerate(take):
            c, first, lo, left = groups[i]
            slots.append((c, lo, lo + n, first, first + units, sequences, place))
            groups[i][2:] = [lo + n, left - n]
            if first + units < c:
                groups.append([c, first + units, lo, n])
        groups = [g for g in groups if g[3]]
        sequences += n
    return slots, sequences


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary).

    Null and empty texts hold the end id alone; repeated rows are documents of their own; null doc_ids stay null; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cap = window // UNIT
    tokens = stash(tokenize(docs, tokenizer), "tokens")
    b = buckets_for(tokens.count())
    tail = F.col("n") % window
    rows = tokens.select("row", "n", F.expr(f"n div {window}").alias("full"), F.ceil(tail / UNIT).cast("int").alias("cls"), F.pmod(F.xxhash64("row"), F.lit(b)).cast("int").alias("bucket"))
    rows = stash(rows, "tails")
    histogram = np.zeros(cap + 1, np.int64)
    for c, n in rows.groupBy("cls").count().collect():
        histogram[c] = n
    slots, tails = plan(histogram[1:], cap)
    # tails: a rank within the class, in two levels so that no class is one task's work
    inside = Window.partitionBy("cls", "bucket").orderBy("row")
    base = running_total(rows.withColumn("one", F.lit(1)), "cls", "bucket", "one", "base")
    ranked = rows.filter("cls > 0").withColumn("in", F.row_number().over(inside) - 1).join(base, ["cls", "bucket"]).select("row", "n", "cls", (F.col("base") + F.col("in")).alias("rank"))
    table = spark.createDataFrame(slots, "cls int, lo long, hi long, first long, end long, sequence long, place int")
    placed = ranked.join(F.broadcast(table), (ranked["cls"] == table["cls"]) & (ranked["rank"] >= table["lo"]) & (ranked["rank"] < table["hi"]))
    whole = F.expr(f"n div {window} * {window}")
    cut = placed.select("row", (whole + F.col("first") * UNIT).alias("start"), (F.least(F.col("end") * UNIT, tail) - F.col("first") * UNIT).alias("length"), (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "place")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("row", "start", "length", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    # full windows
    own = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    base_full = running_total(rows.withColumn("all", F.lit(0)), "all", "bucket", "full", "base").select("bucket", "base")
    long = rows.filter("full > 0").withColumn("in", F.coalesce(F.sum("full").over(own), F.lit(0))).join(base_full, "bucket")
    each = long.select("row", F.explode(F.expr("sequence(0L, full - 1)")).alias("i"), (F.col("base") + F.col("in")).alias("at"))
    full = each.select("row", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("at") + F.col("i") + tails).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = cut.unionByName(full)
    out = tokens.join(pieces, "row")
    return out.select("doc_id", "start", "length", F.col("n").alias("doc_tokens"), "sequence_id", "offset", F.expr("substring(ids, cast(start * 2 + 1 as int), cast(length * 2 as int))").alias("ids"))
