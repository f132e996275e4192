"""Each stage of the pipeline on rows with null, repeated and clashing doc_ids, against plain versions."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

import corpus_pipeline as pipeline
from lakewarden.llm import mixing
from lakewarden.llm.common import text_hash
from lakewarden.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, len(t or ""), 7) for i, t, s in rows], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    a, b, c, d = (sentence(rng, n) for n in (120, 90, 60, 40))
    near = a.split()
    near[60] = "edited"
    passage = sentence(rng, 60)
    return [
        (1, a, "s"), (1, a, "s"), (1, b, "t"), (None, a, "s"), (None, c, None), (None, c, None), (5, " ".join(near), "s"), (6, d, "t"), (6, d, "u"),
        (7, f"{sentence(rng, 20)} {passage} {sentence(rng, 9)}", "s"), (8, f"{sentence(rng, 12)} {passage} é {sentence(rng, 30)}", "t"), (8, f"{sentence(rng, 33)} é{passage}", None),
        (None, f"{passage} {sentence(rng, 5)}", "s"), (20, None, "s"), (20, "", "s"), (None, None, None), (21, " \n", "t"),
    ]


def contents(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_drop_toxic(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 20) + (" moronic" if i % 5 == 0 else ""), "s") for i in range(300)]
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, "some m0r0nic words", "s"), (None, "some words", "s"), (300, "moronic", None), (300, "fine", None), (300, "fine", None), (None, None, None)]
    out = pipeline.drop_toxic(spark, frame(spark, rows + more), str(tmp_path))
    assert out.columns == list(pipeline.COLUMNS)
    got = contents(out)
    assert got == Counter(r for i, r in enumerate(rows + more) if not (i < 300 and i % 5 == 0 or i in (300, 302)))


def test_one_of_each(spark, rows):
    out = pipeline.one_of_each(spark, frame(spark, rows), "")
    of = brute.similar([(k, t) for k, (_, t, _) in enumerate(rows)])
    groups = {}
    for k, (n, c) in of.items():
        groups.setdefault(c if n else ("none", k), []).append(k)
    got = contents(out)
    assert sum(got.values()) == len(groups)
    for ks in groups.values():  # one of each group, of the smallest doc_id
        least = min((rows[k][0] is None, rows[k][0] or 0) for k in ks)
        assert any(got[rows[k]] for k in ks if (rows[k][0] is None, rows[k][0] or 0) == least)
    assert pipeline.one_of_each(spark, frame(spark, []), "").count() == 0


def plain_cut(texts):
    """Texts without the characters of which a byte is covered by a 100-byte string that starts earlier."""
    seen, out = set(), []
    for t in texts:
        data, gone = t.encode(), set()
        for k in range(len(data) - 99):
            gone |= set(range(k, k + 100)) if data[k : k + 100] in seen else set()
            seen.add(data[k : k + 100])
        at, left = 0, ""
        for c in t:
            n = len(c.encode())
            left += "" if gone & set(range(at, at + n)) else c
            at += n
        out.append(left)
    return out


def test_cut_repeats(spark, rows):
    docs = frame(spark, rows)
    out = pipeline.cut_repeats(spark, docs, "")
    # rows alike in doc_id and text are one document; texts of one doc_id come in the order of their hashes
    order = docs.select("doc_id", "text", text_hash(docs["text"]).alias("th")).distinct().collect()
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.th, r.text or "") for r in order})
    cut = {o[:2] + o[3:]: t for o, t in zip(order, plain_cut([o[3] for o in order]))}
    want = [(i, cut[i is None, i or 0, t or ""], s) for i, t, s in rows]
    assert contents(out) == Counter(w for w, (_, t, _) in zip(want, rows) if w[1] or not t)
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_cut_inside_characters(spark):
    rng = random.Random(1)
    passage = "é" + sentence(rng, 40) + "é"
    rows = [(i, f"{sentence(rng, 9)} {passage[i % 2 :]}{'èé'[i % 2]} {sentence(rng, 7)}", "s") for i in range(6)]
    got = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, frame(spark, rows), "").collect()}
    assert list(map(got.get, range(6))) == plain_cut([t for _, t, _ in rows])


def test_mix_sources(spark, rows):
    docs = frame(spark, rows)
    got = contents(pipeline.mix_sources(spark, docs, ""))
    want = {r.source: round(r.target) for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    words = Counter()
    for (_, text, source), n in got.items():
        words[source] += n * len(text.split())
    assert all(abs(words[s] - n) <= 1 for s, n in want.items())
    for i, text, source in got:  # each is made of the words of a row of that doc_id and source, twice at most
        own = [Counter((t or "").split()) for j, t, s in rows if (j, s) == (i, source)]
        assert any(all(n <= 2 * o[w] for w, n in Counter(text.split()).items()) for o in own)
    assert sum(got.values()) <= sum(bool((t or "").split()) for _, t, _ in rows)


def test_pack_sequences(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want, got, lengths = {}, {}, Counter()
    for i, t, _ in rows:
        want[i] = want.get(i, Counter()) + Counter([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for p in pipeline.pack_sequences(spark, frame(spark, rows), "").collect():
        got[p.doc_id] = got.get(p.doc_id, Counter()) + Counter(np.frombuffer(bytes(p.ids), "<u2").tolist())
        lengths[p.sequence_id] += p.length
    assert got == want and max(lengths.values()) <= 2048


def test_run(spark, rows, tmp_path):
    frame(spark, rows).drop("extra").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(pipeline.COLUMNS), name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    by_hand = pipeline.pack_sequences(spark, docs, "").count()
    assert by_hand and pipeline.run(spark, str(tmp_path)).count() == by_hand
