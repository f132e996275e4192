"""Similarity join of documents on 5-word shingles by parity sketches.

Every shingle of a document flips one bit of a sketch, so the Hamming distance of two documents whose sets differ in d shingles is at
most d. For the join, the shingles are dealt to blocks as well, a few to each; at most d blocks differ, so by pigeonhole similar
documents agree on the others. A block's key is the XOR of its shingles' hashes. Per size band, documents are joined on the first D + 1
blocks in one global order (common keys last), of which two similar ones must share one; a passage that two other documents share seldom
fills a block. Size, Hamming distance and then the sets themselves verify.
Documents with equal sets are one class throughout, named by a 128-bit hash. Every member of a key's group is tried against the group's
few leaders first, in large groups against a few and against more where that leaves them apart; of the others, only members that are in different
components after that are tried against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import broadcast_if_small, drop, drop_since, held, mark, may_hold, membership, stash, text_hash

SHINGLE = 5
PERCENT = 80  #: least Jaccard similarity, in hundredths
LEAST_PARTS = 64  #: bits of a sketch
LEAST_BLOCKS = 8
LOAD = 3  #: shingles that a block holds on average at a band's upper end; over 3.9, a set would have too few occupied blocks
HOT = 64  #: classes with a key from which it comes last in the global order
HOT_KEYS = 200_000  #: hot keys told to all tasks; further ones keep their place, which changes speed alone
LEADERS, BIG, BIG_LEADERS = 4, 64, 16  #: members of a key's group at most that all its others are tried against first; and in a group of more than BIG
LESS = 32  #: keys of a set that are told to its other keys, which changes speed alone
BROADCAST = 250_000  #: classes told to all tasks at most; more are joined by a shuffle
_MIX, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_BYTE = np.random.default_rng(9).integers(1, 2**64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x2545F4914F6CDD1D)
_KEPT: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the word hash's base, and of its inverse; kept for the next texts, but for very long ones."""
    if len(_KEPT[0]) >= n:
        return _KEPT[0], _KEPT[1]
    made = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1 << 18), base, np.uint64)))) for base in (_P, _inverse(int(_P))))
    if n <= 1 << 22:
        _KEPT[:] = made
    return made


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _ADD + (b ^ (b >> np.uint64(32))))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of texts with fewer words, one of all words; of texts without, none."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))[:-1]
    code = np.frombuffer(b"\n".join(data).lower() + b"\n", np.uint8)
    space = _SPACE[code]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    power, back = _powers(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_BYTE[code] * power[: len(code)], out=total[1:])
    word = mixed((total[last] - total[first]) * back[first])
    doc = np.searchsorted(starts, first, "right") - 1
    count = np.bincount(doc, minlength=len(data))
    if len(word) >= SHINGLE:
        n = len(word) - SHINGLE + 1
        h = word[:n]
        for i in range(1, SHINGLE):
            h = paired(h, word[i : i + n])
        own = np.flatnonzero(doc[:n] == doc[SHINGLE - 1 :])
        h, of = h[own], doc[own]
    else:
        h, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    edges = np.searchsorted(of, np.arange(len(data) + 1))
    sets = [np.unique(h[edges[i] : edges[i + 1]]) for i in range(len(data))]
    word_edges = np.concatenate(([0], np.cumsum(count)))
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        whole = np.full(1, count[i], np.uint64)
        for w in word[word_edges[i] : word_edges[i + 1]]:
            whole = paired(whole, np.full(1, w, np.uint64))
        sets[i] = whole
    return sets


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    if not len(h):
        return 0, 0
    m = mixed(h)
    return int(np.bitwise_xor.reduce(m).view(np.int64) ^ np.int64(len(h))), int(np.add.reduce(mixed(m ^ _ADD)).view(np.int64))


def bands(n: int) -> list[int]:
    """The size bands of a set: that of its size, and the next one if a set there can be similar."""
    k = n.bit_length() - 1
    return [k, k + 1] if 100 * n >= PERCENT * 2 ** (k + 1) else [k]


def blocks_in(band: int) -> int:
    return max(LEAST_BLOCKS, -(-(2 ** (band + 1)) // LOAD))


def block_keys(h: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The occupied blocks of a sorted set in a band, and their keys. Blocks are ranges of hashes, so that a sorted set needs no other order."""
    at = ((h >> np.uint64(32)) * np.uint64(blocks_in(band))) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    at = at[begin]
    return at, paired(mixed(np.bitwise_xor.reduceat(h, begin)), at + np.uint64(band << 40))


def sketch(h: np.ndarray, band: int) -> list[int]:
    """A bit for each part, the parity of its shingles, as 64-bit numbers."""
    parts = max(LEAST_PARTS, 2 ** (band + 1))
    parity = np.bincount(((h >> np.uint64(7)) & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(parity.astype(np.uint8)).view(">i8").tolist()


def prefix(h: np.ndarray, band: int, hot: np.ndarray) -> np.ndarray:
    """The keys that a set is joined on in a band."""
    at, keys = block_keys(h, band)
    need = (100 - PERCENT) * len(h) // PERCENT + 1  # as |A ^ B| <= 0.25 |A| if |B| <= 1.25 |A| and the similarity is 0.8
    if len(keys) < need:  # so few occupied blocks that empty ones may be all that two sets share
        empty = np.setdiff1d(np.arange(blocks_in(band), dtype=np.uint64), at)
        return np.concatenate((keys, paired(np.zeros(len(empty), np.uint64), empty + np.uint64(band << 40))))
    common = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)
    order = (keys >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63))
    return keys[np.argpartition(order, need - 1)[:need]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text")


def _sets(pdf: pd.DataFrame, step: int = 100) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for i in range(0, len(pdf), step):
        part = pdf.iloc[i : i + step]
        yield part, shingle_sets(part["text"].tolist())


def _sid() -> Column:
    return F.struct("s0", "s1").alias("sid")


def first_pass(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, sid: each document, a hash of its text, its set's size and class. Besides, rows key, met: a key that a task met in several documents, and in how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: list[np.ndarray] = []
        held("ngram_join")
        for pdf in batches:
            for part, sets in _sets(pdf):
                met += [prefix(h, band, np.empty(0, np.uint64)) for h in sets if len(h) for band in bands(len(h))]
                s0, s1 = zip(*map(fingerprint, sets))
                yield pd.DataFrame({"doc_id": part["doc_id"], "th": part["th"], "n": [len(h) for h in sets], "s0": s0, "s1": s1, "key": 0, "met": 0})
        if met:
            keys, n = np.unique(np.concatenate(met), return_counts=True)
            yield pd.DataFrame({"doc_id": None, "th": 0, "n": 0, "s0": 0, "s1": 0, "key": keys[n > 1].view(np.int64), "met": n[n > 1]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_hash(F.col("text")).alias("th"), "text").mapInPandas(run, "doc_id string, th long, n long, s0 long, s1 long, key long, met long")
    return rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "th", "n", _sid(), "key", "met")


def common_keys(first: DataFrame) -> np.ndarray:
    """Keys of many documents, sorted: those that tasks met more than once, over HOT times in all. They order the others' prefixes, which changes speed alone."""
    counted = first.filter("met > 0").groupBy("key").agg(F.sum("met").alias("n")).filter(F.col("n") > HOT)
    return np.sort(np.array([r[0] for r in counted.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").collect()], np.int64).view(np.uint64))


def all_keys(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """key, s: what each document is joined on, with half of its class's hash."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = shared.value
        for pdf in batches:
            for _, sets in _sets(pdf):
                own = [h for h in sets if len(h)]
                if own:
                    keys = [np.concatenate([prefix(h, band, hot) for band in bands(len(h))]) for h in own]
                    yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "s": np.repeat([fingerprint(h)[0] for h in own], [len(k) for k in keys])})

    return _texts(docs).mapInPandas(run, "key long, s long")


def join_keys(docs: DataFrame, hot: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """band, key, sid, n: what each document is joined on, less what a membership filter says no other document has."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, wanted = shared.value
        for pdf in batches:
            for _, sets in _sets(pdf):
                out = [(band, h, keys[may_hold(wanted, keys)]) for h in sets if len(h) for band in bands(len(h)) for keys in [prefix(h, band, hot)]]
                out = [(band, fingerprint(h), len(h), keys) for band, h, keys in out if len(keys)]
                if out:
                    many = [len(k) for *_, k in out]
                    band, s0, s1, n = (np.repeat(x, many) for x in zip(*((band, *sid, n) for band, sid, n, _ in out)))
                    yield pd.DataFrame({"band": band.astype(np.int32), "key": np.concatenate([k for *_, k in out]).view(np.int64), "s0": s0, "s1": s1, "n": n})

    return _texts(docs).mapInPandas(run, "band int, key long, s0 long, s1 long, n long").select("band", "key", _sid(), "n")


def candidate_sets(docs: DataFrame, wanted: DataFrame, first: DataFrame) -> DataFrame:
    """sid, n, h (the set), sketches (by band) of the classes in wanted(sid). Only texts that may be of one of them (the least by hash, by first(th, sid, met)) are cut again."""
    texts = first.filter("met = 0").join(broadcast_if_small(wanted, BROADCAST), "sid", "left_semi").groupBy("sid").agg(F.min("th").alias("th"))
    shared = docs.sparkSession.sparkContext.broadcast(membership(texts, "th"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for whole in batches:
            pdf = whole[may_hold(bits, whole["th"].to_numpy(np.int64).view(np.uint64))]
            for _, sets in _sets(pdf):
                own = [h for h in sets if len(h)]
                if not own:
                    continue
                s0, s1 = zip(*map(fingerprint, own))
                yield pd.DataFrame({"s0": s0, "s1": s1, "n": [len(h) for h in own], "h": [h.view(np.int64) for h in own], "sketches": [{b: sketch(h, b) for b in bands(len(h))} for h in own]})

    sets = docs.select(text_hash(F.col("text")).alias("th"), "text").mapInPandas(run, "s0 long, s1 long, n long, h array<bigint>, sketches map<int,array<bigint>>")
    return sets.select(_sid(), "n", "h", "sketches").join(broadcast_if_small(wanted, BROADCAST), "sid", "left_semi").groupBy("sid").agg(*(F.first(c).alias(c) for c in ("n", "h", "sketches")))


def _near(n1: Column, n2: Column) -> Column:
    return (n1 * 100 >= n2 * PERCENT) & (n2 * 100 >= n1 * PERCENT)


def _hamming_fits(s1: str | Column, s2: str | Column, n1: str | Column, n2: str | Column) -> Column:
    """Whether the sketches' distance leaves room for the similarity: |A ^ B| <= (|A| + |B|) / 9."""
    distance = F.aggregate(F.zip_with(s1, s2, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    n1, n2 = (F.col(n) if isinstance(n, str) else n for n in (n1, n2))
    return distance * (100 + PERCENT) <= (n1 + n2) * (100 - PERCENT)


def _similar(close: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b), those that are similar. Few sets of all are in pairs, and those alone are shuffled."""
    wanted = broadcast_if_small(close.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), BROADCAST)
    own = sets.select("sid", "n", "h").join(wanted, "sid", "left_semi")
    one, two = (own.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("h").alias(f"h_{s}")) for s in "ab")
    both = F.size(F.array_intersect("h_a", "h_b"))
    return close.join(one, "a").join(two, "b").filter(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * PERCENT).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs(a, b, band), distinct (a, b) that are similar, enough of them to connect all that the similar ones connect.

    Each set is tried against the least of its partners first. What that puts under one set, within four steps, is connected; only the other pairs are tried after it.
    """
    one, two = (sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketches").alias(f"k_{s}")) for s in "ab")
    near = pairs.join(one, "a").join(two, "b").withColumn("s_a", F.col("k_a")[F.col("band")]).withColumn("s_b", F.col("k_b")[F.col("band")])
    close = stash(near.filter(_near(F.col("n_a"), F.col("n_b")) & _hamming_fits("s_a", "s_b", "n_a", "n_b")).select("a", "b").distinct(), "close")
    tried = stash(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "least")
    first = stash(_similar(tried, sets), "linked")
    step = lambda t, up: t.join(up.select(F.col("b").alias("a"), F.col("a").alias("_up")), "a", "left").select("b", F.coalesce("_up", "a").alias("a"))
    twice = stash(step(first, first), "under")
    under = stash(step(twice, twice), "under")
    rest = close
    for c in "ab":
        rest = rest.join(under.select(F.col("b").alias(c), F.col("a").alias(f"_{c}")), c, "left")
    rest = stash(rest.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).join(tried, ["a", "b"], "left_anti").select("a", "b"), "others")
    return first.unionByName(_similar(rest, sets))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, comp: the smallest node that each can reach, by large-star and small-star steps until all are stars."""
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        # in stars, no node has two centres, and no centre has one
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
        open_ = ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.max("e.in").alias("in")).filter("out + in > 1 and out > 0")
        if open_.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.join(least, "u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        old, now = now, stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        drop(old)


def _pairs(found: DataFrame) -> DataFrame:
    """The distinct pairs of (x, y, band), the smaller class first."""
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "band").distinct()


def component_of_classes(docs: DataFrame, first: DataFrame) -> DataFrame:
    """node, comp: for each class that is similar to another, the smallest class that it can reach. first: that of first_pass.

    A key's leaders are tried against all its members, which settles small groups and those of near copies. What is left of a key, where it is of
    several components, is joined: members outside its largest component with all, less pairs of one component, of unfit sizes or of distant sketches,
    and mostly a pair at the least key alone that both have there, for near copies share most of their keys.
    """
    hot = common_keys(first)
    shared = stash(all_keys(docs, hot).groupBy("key").agg(F.min("s").alias("s0"), F.max("s").alias("s1")).filter("s0 != s1").select("key"), "shared")
    rows = stash(join_keys(docs, hot, membership(shared, "key")).join(shared, "key").distinct(), "candidates")
    sets = stash(candidate_sets(docs, rows.select("sid").distinct(), first), "sets")
    led = stash(rows.join(_leaders(rows), "key"), "led")
    near = lambda l: (F.col("sid") != l["sid"]) & _near(F.col("n"), l["n"])
    star = led.select("sid", "n", "band", F.explode(F.slice("leaders", 1, LEADERS)).alias("l")).filter(near(F.col("l")))
    comp = stash(components(linked(_ends(star), sets)), "comp")
    tried = F.col("leaders")
    places = led.filter(~_among(F.slice(tried, 1, LEADERS))).select("key", "band", "sid", "n", (F.size(tried) > LEADERS).alias("big"), _among(tried).alias("leads"))
    open_ = stash(_open(places, comp).drop("top"), "apart")
    open_ = stash(_sketched(open_, sets), "open")
    drop(rows, led)
    comp = _with_more(comp, open_, sets)
    rest = _once(stash(_open(open_.filter("NOT leads").select("key", "band", "sid", "n", "s"), comp), "rest"))
    one, two = (rest.select("key", *(F.col(c).alias(f"{c}_{t}") for c in ("band", "sid", "n", "comp", "top", "s", "less"))) for t in "xy")
    once = (F.col("comp_x") != F.col("comp_y")) & ((F.col("comp_y") == F.col("top_y")) | (F.col("comp_x") < F.col("comp_y")))
    fits = once & _near(F.col("n_x"), F.col("n_y")) & _hamming_fits("s_x", "s_y", "n_x", "n_y") & ~F.arrays_overlap("less_x", "less_y")
    cross = one.filter("comp_x != top_x").join(two.withColumnRenamed("key", "key_y"), (F.col("key") == F.col("key_y")) & fits).select(F.col("sid_x").alias("x"), F.col("sid_y").alias("y"), F.col("band_x").alias("band"))
    return _with_edges(comp, linked(_pairs(cross), sets))


def _leaders(rows: DataFrame) -> DataFrame:
    """key, leaders: a few members of each key (sid, n), those of the least hashes; more of keys of many members, which few keys are."""

    def led(own: DataFrame, n: int) -> DataFrame:
        chosen = F.array(*(F.min_by(F.struct("sid", "n"), F.xxhash64("sid", F.lit(i))) for i in range(n)))
        return own.groupBy("key").agg(F.array_distinct(chosen).alias("leaders"))

    big = stash(rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > BIG).select("key"), "big")
    big = broadcast_if_small(big, BROADCAST)
    return led(rows.join(big, "key", "left_anti"), LEADERS).unionByName(led(rows.join(big, "key", "left_semi"), BIG_LEADERS))


def _once(rows: DataFrame) -> DataFrame:
    """rows(key, band, sid, ...) with less, the LESS least keys of a sid in the band as far as they are below the row's: members that have one of them in common meet at a lesser key already."""
    own = rows.groupBy("sid", "band").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LESS).alias("keys"))
    return rows.join(own, ["sid", "band"]).select(*rows.columns, F.filter("keys", lambda k: k < F.col("key")).alias("less"))


def _among(leaders: Column) -> Column:
    return F.exists(leaders, lambda x: x["sid"] == F.col("sid"))


def _open(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows(key, sid, ...) of keys whose members are in several components, with comp, a member's component, and top, that of most members of the key."""
    placed = rows.join(comp, F.col("sid") == F.col("node"), "left").select(*rows.columns, F.coalesce("comp", "sid").alias("comp"))
    counted = placed.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("most"), F.count("*").alias("comps"))
    return placed.join(counted.filter("comps > 1").select("key", F.col("most.comp").alias("top")), "key")


def _sketched(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows(sid, band, ...) with s, the sketch of sid in the band. Few sets of all are in rows, and those alone are shuffled."""
    wanted = broadcast_if_small(rows.select("sid").distinct(), BROADCAST)
    own = sets.select("sid", "sketches").join(wanted, "sid", "left_semi")
    return rows.join(own, "sid").select(*rows.columns, F.col("sketches")[F.col("band")].alias("s"))


def _ends(star: DataFrame) -> DataFrame:
    """The pairs of members and leaders (sid, band, l)."""
    return _pairs(star.select(F.col("sid").alias("x"), F.col("l.sid").alias("y"), "band"))


def _with_more(comp: DataFrame, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """The components once members of large groups are tried against those leaders past the first few that they are not connected with. Only pairs whose sketches are near become rows."""
    big = open_.filter("big")
    leaders = big.filter("leads").groupBy("key").agg(F.collect_list(F.struct("sid", "n", "comp", "s")).alias("more"))
    fits = lambda l: (l["comp"] != F.col("comp")) & _near(F.col("n"), l["n"]) & _hamming_fits(F.col("s"), l["s"], F.col("n"), l["n"])
    star = big.join(leaders, "key").select("sid", "band", F.explode(F.filter("more", fits)).alias("l"))
    pairs = stash(_ends(star.select("sid", "band", F.struct("l.sid").alias("l"))), "more")
    return comp if pairs.isEmpty() else stash(_with_edges(comp, linked(pairs, sets)), "comp")


def _with_edges(comp: DataFrame, late: DataFrame) -> DataFrame:
    """The components (node, comp) once late(a, b) are connected too. Those are between components, so the second graph is small."""
    for c in "ab":
        late = late.join(comp.select(F.col("node").alias(c), F.col("comp").alias(f"c_{c}")), c, "left").withColumn(c, F.coalesce(f"c_{c}", c)).drop(f"c_{c}")
    more = components(late).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    moved = comp.join(more, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return moved.unionByName(more.select(F.col("comp").alias("node"), F.col("top").alias("comp")).join(comp, "node", "left_anti"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, n_shingles, class (of equal sets; null for an empty one), component (the class that names it; null likewise), component_id.

    Texts without words have an empty set and are linked with nothing; a component's id is its smallest doc_id, null if
    all are null; rows alike in doc_id give a row each; other columns are ignored; an empty table gives an empty result.
    """
    place = mark()
    first = stash(first_pass(docs), "setids")
    ids = first.filter("met = 0").select("doc_id", "th", "n", "sid")
    comp = component_of_classes(docs, first)
    least = ids.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least")).join(comp, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("comp", "sid").alias("comp"))
    least = stash(least, "classes")
    drop_since(place, first, least)
    top = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = least.join(top, "comp").select("sid", "comp", "component_id")
    out = ids.join(classes.withColumnRenamed("sid", "class"), (F.col("sid") == F.col("class")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), "class", F.col("comp").alias("component"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
