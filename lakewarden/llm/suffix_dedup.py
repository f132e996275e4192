"""Suffix-array dedup by distributed prefix doubling, pruned by anchors.

Ranks of prefixes start at ANCHOR bytes and grow to LENGTH. At the first offset only anchors are ranked: for each LENGTH-byte string,
the position of its smallest ANCHOR-byte rank. All equal strings have equal anchors at equal places, so a string whose anchor is unique
is unique, and drops out. The remaining anchors are ranked with the bytes of all strings that they stand for; an anchor equal to
an earlier one in all of them is settled. Those that share neither what precedes nor what follows with another drop out, and the strings of the others are ranked at LENGTH, pairing the ranks of two
shorter prefixes; a rank here is the first position that holds the string, so a later one repeats it.
Ranks are 128-bit hashes (two of 64 bits) of the bytes, doubled in the same way inside a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import drop, drop_since, held, map_column, mark, may_hold, membership, stash, text_hash

LENGTH = 100
ANCHOR = 32
HALF = (LENGTH - ANCHOR) // 2  #: a string holds as many bytes before its anchor, or as many after it
_SPAN = LENGTH - ANCHOR + 1  #: anchors that a string chooses from
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ADD = np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64(0xFFFFFFFF)
_BYTES = np.random.default_rng(3).integers(1, 2**64, 256, np.uint64)
_FACTORS = {2**k: f | np.uint64(1) for k, f in enumerate(np.random.default_rng(4).integers(1, 2**64, 8, np.uint64))}
CHUNK = 1 << 15  #: bytes of texts ranked at once; few enough for a processor's cache
NONE = 2**63 - 1  #: the order of a null doc_id: after all others


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of two neighbouring prefixes' ranks."""
    return mixed(a * _ADD + (b ^ (b >> np.uint64(32))))


def ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of all ANCHOR-byte strings of data. Pairs are summed, with an odd factor for each size, and mixed once."""
    rank, size = _BYTES[data], 1
    while size < ANCHOR:
        rank, size = rank[:-size] * _FACTORS[size] + rank[size:], 2 * size
    return mixed(rank)


def ranks_at(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the 2 * ANCHOR-byte strings that begin at some places."""
    return paired(rank[at], rank[at + ANCHOR])


def smallest(rank: np.ndarray, span: int) -> np.ndarray:
    """For each start of `span` neighbours, the place of the one whose rank's first half is smallest, the first of equals."""
    x = (rank & ~_LOW) | np.arange(len(rank), dtype=np.uint64)
    size = 1
    while size < span:
        step = min(size, span - size)
        x, size = np.minimum(x[:-step], x[step:]), size + step
    return (x & _LOW).astype(np.int64)


def anchors(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each anchor of documents of LENGTH bytes or more, whose bytes follow each other in data: its document's number, the first
    string that it stands for, how many more, the anchor's place and rank, the rank of all the bytes in the strings, and of the
    anchor with HALF bytes before it and after it. Strings that cross documents are left out."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    short = ranks(data)
    place = smallest(short, _SPAN)
    # the first string of a document, and those whose anchor is another than their neighbour's
    first = np.zeros(len(place) + 1, bool)
    first[1:-1] = place[1:] != place[:-1]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends - LENGTH + 1] -= 1
    inside = np.cumsum(inside[: len(place)], dtype=np.int8) > 0
    first[begins] = True
    lo = np.flatnonzero(first[:-1] & inside)
    doc = np.searchsorted(ends, lo, "right")
    hi = np.minimum(np.concatenate((lo[1:], [len(data)])) - 1, ends[doc] - LENGTH)
    end = hi + LENGTH - 2 * ANCHOR  # where the last 64 bytes begin
    at = place[lo]
    whole = paired(paired(ranks_at(short, lo), ranks_at(short, np.minimum(lo + 52, end))), paired(ranks_at(short, end), ((hi - lo) * 256 + at - lo).astype(np.uint64)))
    before, after = np.maximum(at - HALF, begins[doc]), np.minimum(at, ends[doc] - ANCHOR - HALF)
    left, right = (paired(ranks_at(short, x), short[x + HALF]) for x in (before, after))
    return doc, lo - begins[doc], hi - lo, at - begins[doc], short[at], whole, left, right


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def together(texts: Iterable[str | None], least: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """The numbers of texts of at least so many bytes, with their sizes and bytes one after the other, CHUNK or one text at a time."""
    rows: list[int] = []
    found: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        data = _bytes(text)
        if len(data) < least:
            continue
        if rows and size + len(data) > CHUNK:
            yield rows, np.array([len(x) for x in found]), np.frombuffer(b"".join(found), np.uint8)
            rows, found, size = [], [], 0
        rows.append(i)
        found.append(data)
        size += len(data)
    if rows:
        yield rows, np.array([len(x) for x in found]), np.frombuffer(b"".join(found), np.uint8)


def gathered(parts: Iterable[tuple[np.ndarray, ...]], rows: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Parts of a table, put together to about so many rows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _keyed_columns(docs: DataFrame) -> list[Column]:
    """text, and d and th: a document's order, and what tells documents of one doc_id apart."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    order = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id").bitwiseAND(F.lit(NONE - 1))
    return [F.col("text"), F.when(F.col("doc_id").isNotNull(), order).otherwise(F.lit(NONE)).alias("d"), text_hash(F.col("text")).alias("th")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_keyed_columns(docs))


def anchor_rows(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """The anchors of all documents; those alone that a membership filter lets pass, if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("suffix_dedup")
        for pdf in batches:
            d, th = pdf["d"].to_numpy(), pdf["th"].to_numpy()

            def found() -> Iterator[tuple[np.ndarray, ...]]:
                for rows, sizes, data in together(pdf["text"], LENGTH):
                    doc, *own = anchors(sizes, data)
                    if shared.value is not None:
                        keep = may_hold(shared.value, own[3])
                        doc, own = doc[keep], [x[keep] for x in own]
                    yield np.array(rows)[doc], *own

            for doc, *own in gathered(found()):
                yield pd.DataFrame({"d": d[doc], "th": th[doc]} | {k: x.view(np.int64) for k, x in zip(("lo", "more", "at", "a", "w", "left", "right"), own)})

    return _keyed(docs).select("d", "th", "text").mapInPandas(run, "d long, th long, lo int, more int, at int, a long, w long, left long, right long")


def merged(spans: DataFrame) -> DataFrame:
    """d, th, spans: the union of a document's ranges [lo, hi), as maximal ranges. First within stretches of 64 kB, so that no long document is one task's sort."""

    def union(rows: Column) -> Column:
        last = lambda acc: F.element_at(acc, -1)
        step = lambda acc, r: F.when(F.size(acc) == 0, F.array(r)).when(r["lo"] <= last(acc)["hi"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["lo"].alias("lo"), F.greatest(last(acc)["hi"], r["hi"]).alias("hi"))))).otherwise(F.concat(acc, F.array(r)))
        return F.aggregate(F.sort_array(rows), F.expr("cast(array() as array<struct<lo:int,hi:int>>)"), step)

    span = F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    parts = spans.groupBy("d", "th", F.expr("lo div 65536").alias("part")).agg(union(F.collect_set(span)).alias("spans"))
    return parts.select("d", "th", "spans")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """d, th, spans: byte ranges of documents that strings found earlier cover; several rows a document, whose union is exact."""
    counted = anchor_rows(docs).groupBy("a").agg(F.count("*").alias("n"), F.min("w").alias("w0"), F.max("w").alias("w1")).filter("n > 1")
    repeated = stash(counted.select("a", (F.col("w0") != F.col("w1")).alias("varied")), "repeats")
    found = anchor_rows(docs, membership(repeated, "a")).join(repeated, "a")
    live = stash(found.select("d", "th", "lo", "more", "a", "w", "varied", *(F.when(F.col("varied"), F.col(c)).alias(c) for c in ("at", "left", "right"))), "anchors")
    where = F.struct("d", "th", "lo")
    # tables of what repeats are written before they are joined, so that the join may split a hot key's rows
    kinds = live.groupBy("a", "w").agg(F.min(where).alias("first"), F.count("*").alias("n"), F.first("varied").alias("varied")).filter("n > 1 or varied")
    kinds = stash(kinds, "kinds")
    later = live.select("d", "th", "lo", "more", "a", "w").join(kinds.filter("n > 1").select("a", "w", "first"), ["a", "w"]).filter(where != F.col("first"))
    settled = stash(merged(later.select("d", "th", "lo", (F.col("lo") + F.col("more") + LENGTH).alias("hi"))), "settled")
    # what is left: strings of the first of each kind, where an anchor has several kinds
    first = live.filter("varied").join(kinds.filter("varied").select("a", "w", "first"), ["a", "w"]).filter(where == F.col("first"))
    left = stash(first.select("d", "th", "lo", "more", "at", "a", "left", "right"), "open")
    drop(repeated, live, kinds)
    before, after = (stash(left.groupBy("a", side).agg(F.count("*").alias("n")).filter("n > 1").select("a", side, F.lit(True).alias(f"on_{side}")), f"on-{side}") for side in ("left", "right"))
    shared = left.join(before, ["a", "left"], "left").join(after, ["a", "right"], "left").filter("on_left or on_right")
    flags = (F.coalesce(f"on_{side}", F.lit(False)).cast("int").alias(f"on_{side}") for side in ("left", "right"))
    asked = shared.groupBy("d", "th").agg(F.collect_list(F.struct("lo", "more", "at", "a", *flags)).alias("asked"))
    names = ("lo", "more", "at", "a", "on_left", "on_right")
    asked = stash(asked.select("d", "th", *(F.col("asked")[c].alias(c) for c in names)), "asked")
    texts = _keyed(docs).select("d", "th", "text")

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d, th, own = pdf["d"].to_numpy(), pdf["th"].to_numpy(), [pdf[c].to_numpy() for c in names]

            def found() -> Iterator[tuple[np.ndarray, ...]]:
                for rows, sizes, data in together(pdf["text"], LENGTH):
                    rank = ranks(data)
                    doc = np.repeat(np.arange(len(rows)), [len(own[0][i]) for i in rows])
                    start = (np.cumsum(sizes) - sizes)[doc]
                    first, more, place, anchor, on_left, on_right = (np.concatenate([x[i] for i in rows]).astype(np.int64) for x in own)
                    begin = np.where(on_left > 0, first, np.maximum(first, place - HALF + 1))
                    end = np.where(on_right > 0, first + more, np.minimum(first + more, place - HALF))
                    count = np.maximum(end - begin + 1, 0)
                    at = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                    lo = at + np.repeat(start, count)
                    yield np.array(rows)[np.repeat(doc, count)], at, np.repeat(anchor, count), paired(ranks_at(rank, lo), ranks_at(rank, lo + LENGTH - 2 * ANCHOR))

            for doc, at, anchor, w in gathered(found()):
                yield pd.DataFrame({"d": d[doc], "th": th[doc], "lo": at.astype(np.int32), "a": anchor, "w": w.view(np.int64)})

    windows = stash(texts.join(asked, ["d", "th"]).mapInPandas(strings, "d long, th long, lo int, a long, w long"), "strings")
    again = stash(windows.groupBy("a", "w").agg(F.min(where).alias("first"), F.count("*").alias("n")).filter("n > 1").select("a", "w", "first"), "again")
    found = windows.join(again, ["a", "w"]).filter(where != F.col("first")).select("d", "th", "lo", (F.col("lo") + LENGTH).alias("hi"))
    late = stash(merged(found), "late")
    drop(left, before, after, asked, windows, again)
    return settled.unionByName(late)


def dedup(docs: DataFrame, keep: Sequence[str] = ("doc_id",), whole_characters: bool = False) -> DataFrame:
    """docs(doc_id, text) -> the columns `keep`, n_bytes, removed (maximal byte ranges [lo, hi)), kept (the remaining bytes).

    A byte goes if a LENGTH-byte string covers it that starts earlier too, in a document of smaller doc_id or further
    up in the same one. Null texts are empty; texts under LENGTH bytes stay; null doc_ids come after all others, ids that are no whole numbers are ordered by a hash; rows alike in
    doc_id and text are one document and share its result, others of one doc_id are ordered by a hash; other columns are ignored;
    an empty table gives an empty result. With whole_characters, a character that loses a byte goes whole. Texts of any length are read whole; each is one row of a task.
    """
    place = mark()
    spans = stash(repeated_spans(docs), "spans")
    drop_since(place, spans)
    own = spans.groupBy("d", "th").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))

    def start() -> Callable[[list], dict]:
        def step(rows: list[dict]) -> dict:
            sizes, removed, kept = [], [], []
            for r in rows:
                data = _bytes(r["text"])
                sizes.append(len(data))
                runs: list[list[int]] = []
                for lo, hi in zip(r["lo"] or (), r["hi"] or ()):  # in order of lo
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                if whole_characters:
                    runs = widened(data, runs)
                removed.append([{"lo": lo, "hi": hi} for lo, hi in runs])
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            return {"n_bytes": sizes, "removed": removed, "kept": kept}

        return step

    keyed = docs.select(*_keyed_columns(docs), *(F.col(c).alias(f"_{c}_") for c in keep))
    joined = keyed.join(own, ["d", "th"], "left").select(*(F.col(f"_{c}_").alias(c) for c in keep), F.struct("text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi")).alias("_row"))
    return map_column(joined, keep, "_row", start, "n_bytes bigint, removed array<struct<lo:bigint,hi:bigint>>, kept binary")


def widened(data: bytes, runs: list[list[int]]) -> list[list[int]]:
    """The byte ranges, made to begin and end between UTF-8 characters."""
    out: list[list[int]] = []
    for lo, hi in runs:
        while lo and data[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
