"""Hard negatives, winnowing and fill-in-middle against plain versions, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from lakewarden.llm import fim, hard_negatives, winnowing

#: Columns whose names the operators use inside.
MORE = "words array<string>, hashes array<long>, fp long, at int, key string, form string, job string, own int, part int, block int, role int, v array<int>, rank int, n int"
EXTRA = (["x"], [1], 1, 1, "k", "f", "j", 1, 1, 1, 1, [1], 1, 1)


def wide(spark, rows, schema):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"{schema}, {MORE}")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "Beta", "gämma", "x1", "the", "of"])  # noqa: E731  few words, so that chance matches occur
    other = lambda: f"w{rng.randrange(10**6)}"
    items = [(i, " ".join(other() for _ in range(n))) for i, n in enumerate([10, 11, 25, 60, 9, 3, 1])]
    items += [(20, items[2][1].upper().replace(" ", ", ")), (21, " ".join(word() for _ in range(14))), (22, None), (23, ""), (24, "...!"), (None, " ".join(other() for _ in range(12))), (2, items[2][1])]
    items += [(25, "same " * 15), (26, "der of"), (27, "one two")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice([word, other])() for _ in range(rng.randrange(30)))]
        if i % 3 == 0:
            taken = (items[rng.randrange(len(items))][1] or "").split()
            lo = rng.randrange(max(1, len(taken) - 9))
            parts += [" ".join(taken[lo : lo + rng.choice([9, 10, 11, 40])]), other()]
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, " \n-- "), (103, items[0][1]), (103, items[1][1]), (103, items[1][1]), (None, items[3][1]), (104, "same " * 3000), (105, items[0][1] + " " + items[0][1])]
    docs += [(106, ("noise " * 7 + items[2][1] + " ") * 40), (107, "one-two THREE"), (108, items[3][1][5:]), (109, " ".join(word() for _ in range(400)))]
    return docs, items


def test_winnowing(spark, corpus):
    docs, items = corpus
    out = winnowing.contaminated(wide(spark, docs, "doc_id long, text string"), wide(spark, items, "item_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids)) for r in out), key=repr)
    assert got == sorted(brute.contaminated(docs, items), key=repr)
    assert any(r.n_hit for r in out) and not all(r.n_hit for r in out)


def test_winnowing_by_shuffle(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(winnowing, "BROADCAST", 3)
    out = winnowing.contaminated(wide(spark, docs, "doc_id long, text string"), wide(spark, items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids)) for r in out), key=repr) == sorted(brute.contaminated(docs, items), key=repr)


def test_winnowing_empty(spark, corpus):
    docs, items = corpus
    none = wide(spark, [], "doc_id long, text string")
    assert winnowing.contaminated(none, wide(spark, items, "item_id long, text string")).collect() == []
    out = winnowing.contaminated(wide(spark, docs, "doc_id long, text string"), wide(spark, [], "item_id long, text string")).collect()
    assert len(out) == len(docs) and not any(r.n_hit or r.item_ids for r in out)


TEXTS = [None, "", "a", " ", "  \n ", "ab cd", " ab  cd ", "tail \n", "<P>mark", "x<S>", "é ö z b", "\x0b\x0cq\x1fr", "a b " * 30_000, "𝔘 𝔙\t𝔚", "one\ntwo\r\nthree", "<P >fine", "z" * 20_000]


def test_fill_in_middle(spark):
    rows = [(i, t) for i in range(40) for t in TEXTS] + [(None, "one two three"), (-5, "four five"), (3, "ab cd")]
    out = fim.fill_in_middle(wide(spark, rows, "doc_id long, text string"))
    got = out.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted((brute.fill_in_middle(*r) for r in rows), key=repr)
    assert sorted((r.back for r in got)) == sorted(t or "" for _, t in rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(wide(spark, [], "doc_id long, text string")).collect() == []


def test_cuts_split_batches(monkeypatch):
    monkeypatch.setattr(fim, "AT_ONCE", 50)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(40))) for _ in range(200)]
    draws = np.array([(rng.getrandbits(32), rng.getrandbits(32)) for _ in texts])
    n, places = fim.cut_places(texts, draws)
    for t, (a, b), units, (first, last) in zip(texts, draws.tolist(), n.tolist(), places.tolist()):
        found = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        lo, hi = sorted((a % (len(found) + 1), b % (len(found) + 1)))
        assert (units, t[:first], t[:last]) == (len(found), "".join(found[:lo]), "".join(found[:hi]))


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 8, 1000).astype(np.uint8)
    matrix, at = fim.WaveletMatrix(sequence), np.arange(1001)
    for s in range(8):
        assert (matrix.rank(s, at) == np.concatenate(([0], np.cumsum(sequence == s)))).all()
    assert (fim.WaveletMatrix(sequence[:0]).rank(3, np.zeros(2, np.int64)) == 0).all()


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 40), (70, 35, 129), (64, 64, 64), (5, 200, 3)])
def test_strassen(shape):
    rng = np.random.default_rng(2)
    m, k, n = shape
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
    assert (hard_negatives.strassen(a, b) == a @ b).all()


def test_strassen_recurses(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 3)
    rng = np.random.default_rng(3)
    a, b = rng.integers(-300, 300, (37, 29)), rng.integers(-300, 300, (29, 50))
    assert (hard_negatives.strassen(a, b) == a @ b).all()


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # several tasks and tiles for every anchor
        for name, value in (("CHUNK", 40), ("BLOCK", 4), ("TILE", (3, 7)), ("LEAF", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(5, 6))
    rows = []
    for i in range(300):
        label = int(rng.choice(5, p=[0.4, 0.3, 0.1, 0.1, 0.1]))
        rows.append((i, [float(x) for x in 0.3 * centre[rng.integers(5)] + 0.2 * rng.normal(size=6)], label))
    same = [0.5, 0.25, -0.5, 0.1, 0.0, 0.3]
    rows += [(400 + i, same, i % 3) for i in range(40)]  # ties
    rows += [(500, None, 1), (501, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1), (502, [float("nan")] * 6, 1), (503, [float("inf")] * 6, 1), (504, same, None), (None, same, 1), (505, [], 1), (510, [0.0] * 6, 2), (520, [0.4, 0.1], 1), (20, rows[20][1], rows[20][2]), (30, same, 4), (530, same, 77)]
    got = hard_negatives.mine(wide(spark, rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0).collect()
    want = list(brute.hard_negatives(rows, lambda i: i % 10 == 0))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_hard_negatives_edges(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert hard_negatives.mine(wide(spark, [], schema), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(wide(spark, [(0, [1.0], 1), (1, [1.0], 2)], schema), F.col("vec_id") % 10 == 0).collect() == []
    with pytest.raises(Exception, match="63 bits"):
        hard_negatives.mine(wide(spark, [(0, [1e9], 1), (1, [1e9], 1)], schema), F.col("vec_id") % 10 == 0).collect()


def test_digests(spark):
    """The query's hashes are those of the whole texts."""
    out = fim.fill_in_middle(wide(spark, [(1, "a b c"), (2, "")], "doc_id long, text string")).select("output", F.sha2(F.col("output").cast("binary"), 256).alias("h")).collect()
    assert all(r.h == hashlib.sha256(r.output.encode()).hexdigest() for r in out)
