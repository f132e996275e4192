"""The operators against plain versions, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from lakewarden.llm import ann, html_extract, language_id, mixing, ngram_join, packing, suffix_dedup, toxicity, url_filter
from lakewarden.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, d string, n int, h string, sid string"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, "x", 1, "y", "z") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            copy = list(words)
            for _ in range(max(1, len(copy) // 60)):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((100 + i, " ".join(copy)))
        if i % 7 == 0:
            rows.append((200 + i, rows[-1][1]))
        if i % 5 == 0:
            rows.append((300 + i, f"{' '.join(words[:30])} {passage} {' '.join(words[30:60])}"))
    rows += [(500, ""), (501, None), (502, "one two"), (503, "one two"), (504, "a" * 700), (505, "é" * 130), (506, "  \t\n"), (507, "ab" * 300), (508, "x " * 5000)]
    return rows


def test_ngram_join(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs(spark, [(i, t, None, None) for i, t in texts])).collect()}
    assert got == brute.similar(texts)


def test_suffix_dedup(spark, texts):
    out = suffix_dedup.dedup(docs(spark, [(i, t, None, None) for i, t in texts])).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.hi - s.lo for s in r.removed), len(r.removed), suffix_dedup.sha256(bytes(r.kept))) for r in out}
    assert got == brute.dedup(texts)


def test_mixing(spark, texts):
    sources = [None, "a", "b", "c", "d"]
    rows = [(i, t, None, sources[i % 5]) for i, t in texts] + [(1, texts[0][1], None, "a")] * 2
    got = mixing.taken(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(docs(spark, rows)).collect()))
    assert all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.target, [0, r.source_size])[0] += r.taken
    assert all(abs(t - taken) <= 1 and t <= 2 * size for t, (taken, size) in by.items() if [r.target for r in got].count(t))
    assert abs(sum({(r.target, r.source_size) for r in got} and (r.taken for r in got)) - 1.5 * sum(r.size for r in got)) <= 5


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    pieces = packing.pack(docs(spark, [(i, t, None, None) for i, t in texts]), tokenizer_path()).collect()
    found, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(found.setdefault(p.doc_id, [])) and p.length > 0
        found[p.doc_id] += np.frombuffer(bytes(p.ids), "<u2").tolist()
    assert found == want
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) <= 2048


def test_least_squares():
    a = packing.strategies(12)
    x = packing.least_squares(a, a @ np.arange(a.shape[1]))
    assert np.allclose(a @ x, a @ np.arange(a.shape[1])) and x.min() >= 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow")], "rule string, verdict string")
    listed = spark.createDataFrame([("bad.org/",)], "url string")
    urls = ["HTTP://A.Example.NET/en/1?x", "http://x.net", "http://x.net/", "http://xnet/", "http://www.bad.org/q", "http://bad.org/fr/", None, "nothing", "http://h#/a"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(1, urls[1], "x", "y")], "page_id long, url string, host string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, listed).collect()}
    assert got == {(0, "a.example.net", "/en/1", "example.net/en/", "allow"), (1, "x.net", "", None, "allow"), (2, "x.net", "/", "net/", "block"), (3, "xnet", "/", None, "allow"), (4, "www.bad.org", "/q", None, "block"), (5, "bad.org", "/fr/", "org/fr/", "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "h", "", None, "allow")}


def test_html():
    page = "<html><head><title>t</title></head><body><header>top</header><nav><a href=x>m</a></nav><article><h1>Head &amp; line</h1><p>One <b>two</b>,\n three.<p>Four &#233; five, six.<aside>side</aside><form>f</form></article><div class='comments'>no</div><footer>f</footer><script>var a='<p>';</script></body></html>"
    assert html_extract.extract(page) == "Head & line One two, three. Four é five, six."
    assert html_extract.extract(None) == "" and html_extract.extract("") == "" and html_extract.extract("<div></div>") == ""


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[5], x[6], x[7] = x[4], x[4], 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(4000, None), (4001, [float("nan")] * 16), (4002, [None] * 16), (3, x[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(vectors, vectors.filter("vec_id % 100 = 0 or vec_id in (4, 7)")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert r.score == pytest.approx(float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)), abs=1e-12)
    assert 7 not in found and [v for _, v in sorted(found[4])[:2]] == [5, 6] and all(len(f) == 20 for f in found.values())
    recall = [len({v for _, v in f} & set([j for j in np.lexsort((np.arange(3000), -(x.astype(float) @ x[q].astype(float)))) if j not in (q, 7)][:20])) / 20 for q, f in found.items()]
    assert np.mean(recall) >= 0.9


def test_language(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(i, make("abcde" if i % 2 else "vwxyzé"), "aa" if i % 2 else "vv", None) for i in range(60)]
    out = language_id.predict_language(docs(spark, [*rows, (100, None, "aa", None), (101, "12 !", "vv", None), (102, "", None, None)]), docs(spark, rows[:30]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert all(got[i][0] == lang and 0 < got[i][1] <= 1 for i, _, lang, _ in rows) and all(got[i] == ("und", 0.0) for i in (100, 101, 102))
    assert {r.lang_pred for r in language_id.predict_language(docs(spark, rows[:3]), docs(spark, [])).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(4)
    words = ["the", "quick", "brown", "house", "water", "letter", "some", "other", "people", "think"]
    make = lambda extra: " ".join([*(rng.choice(words) for _ in range(30)), *extra])
    rows = [(i, make(["moron"] if i % 5 == 0 else []), None, None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    more = [(1000, "the quick m0r0n", None, None), (1001, "some m o r o n water", None, None), (1002, "the moooron", None, None), (1003, None, None, None), (1004, "", None, None), (1005, "the letter", None, None)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, rows + more), labels).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(300))
    assert all(got[i] >= 0.5 for i in (1000, 1001, 1002)) and all(got[i] < 0.5 for i in (1003, 1004, 1005))


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert ngram_join.similar_documents(none).count() == 0 and suffix_dedup.dedup(none).count() == 0
    assert mixing.taken(none).count() == 0 and packing.pack(none, tokenizer_path()).count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0 and language_id.predict_language(none, none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(vectors, vectors).count() == 0


def test_crc():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")


def wav(x, rate=11025, channels=1):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat(np.clip(x, -32767, 32767).astype("<i2"), channels).tobytes())
    return out.getvalue()


def melody(seed, notes=24, rate=11025):
    rng = np.random.default_rng(seed)
    t = np.arange(rate // 3) / rate
    return np.concatenate([6000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) + 3000 * np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in rng.integers(0, 24, notes)])


def test_audio(spark):
    from lakewarden.llm import audio

    base, rng = melody(1), np.random.default_rng(0)
    noisy = base + rng.normal(0, 60, len(base))
    lead = melody(9, 6)[: 40 * audio.HOP]
    rows = [(100, wav(base)), (1, wav(base)), (2, wav(noisy)), (3, wav(np.concatenate([lead, base]))), (4, wav(base[30 * audio.HOP :], channels=2)), (5, wav(melody(2))), (6, wav(np.zeros(90_000))), (7, b""), (8, None), (9, b"no sound"), (None, wav(base)), (200, wav(melody(2))), (200, wav(melody(2)))]
    df = spark.createDataFrame([(i, b, 1, "x") for i, b in rows], "rec long, sound binary, offset int, print string")
    got = audio.search(df, "rec", audio.F.col("rec") % 100 == 0, "sound").collect()
    own = [(r.id, r.class_id) for r in got if r.kind == "recording"]
    assert sorted(own) == sorted([(100, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (200, 5), (200, 5)])
    match = {(r.id, r.class_id): r for r in got if r.kind == "match"}
    assert set(match) == {(1, 2), (1, 3), (1, 4)}
    assert match[1, 3].offset == 40 and match[1, 4].offset == -30 and match[1, 2].offset == 0
    # the pairs against a plain version
    codes = {i: audio.codes_of(*audio.samples_of(b, "wav")) for i, b in rows if i in (1, 2, 3, 4, 5, 6)}
    assert brute.aligned(codes, [1, 5], audio) == {(r.id, r.class_id): (r.offset, r.votes, r.aligned, r.bit_error) for r in match.values()}
    assert audio.search(df.limit(0), "rec", audio.F.col("rec") % 100 == 0, "sound").count() == 0


def test_audio_filters():
    from lakewarden.llm import audio

    chroma = np.rint(audio.pitch_classes(melody(4, 8), 11025) * audio.SCALE)
    image = np.tile(np.concatenate([chroma, np.repeat(chroma[-1:], audio.REACH - 1, 0)]), 2)
    codes = audio.codes_of(melody(4, 8), 11025)
    for at in range(0, len(chroma), 7):
        code = 0
        for kind, p, h, w in audio.FILTERS:
            box = image[at : at + w, p : p + h]
            part = {"pitch": box[:, : h // 2], "time": box[: w // 2], "mid": box[:, h // 4 : h // 4 + h // 2]}.get(kind)
            a = part.sum() if part is not None else box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum()
            share = h // 2 / h if kind == "mid" else 0.5
            code = code << 2 | int(audio.GRAY[np.searchsorted(audio.LEVELS, (a - share * box.sum()) / max(box.sum(), 1))])
        assert code == codes[at]


def test_audio_noise(spark):
    """A recording under strong noise, within the bounds of aligned frames and bit error, has few equal codes and hardly two in a row."""
    from lakewarden.llm import audio

    base, rng = melody(1), np.random.default_rng(0)
    rows = [(100, wav(base)), (2, wav(base + rng.normal(0, 2000, len(base)))), (3, wav(base[: 5 * audio.HOP]))]
    got = audio.search(spark.createDataFrame(rows, "rec long, sound binary"), "rec", audio.F.col("rec") % 100 == 0, "sound").filter("kind = 'match'").collect()
    codes = {i: audio.codes_of(*audio.samples_of(b, "wav")) for i, b in rows}
    assert {(r.id, r.class_id): (r.offset, r.votes, r.aligned, r.bit_error) for r in got} == brute.aligned(codes, [100], audio)
    assert [(r.class_id, r.offset) for r in got] == [(2, 0)] and 0.1 < got[0].bit_error <= audio.MAX_ERROR


def test_toxicity_disguises(spark):
    """Signs after quotes, dashes and slashes or in last place, words cut by any separators, and letters all doubled."""
    rng = random.Random(4)
    words = ["the", "quick", "brown", "house", "water", "letter", "some", "other", "people", "think"]
    make = lambda extra: " ".join([*(rng.choice(words) for _ in range(30)), *extra])
    rows = [(i, make([("moron", "hate")[i % 10 // 5]] if i % 5 == 0 else []), None, None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    tokens = ['"m0ron"', "-m0ron", "water/m0ron", "some-m0ron", "(m0r0n)", "hat3", "mo.ron", "mor-on", "m.o.ron", "m..o..r..o..n", "m~o~r~o~n", "mo--ron", "(m o r o n)", "m  o  r  o  n", "mmoorroonn", "moroon"]
    more = [(1000 + i, f"the {t} water", None, None) for i, t in enumerate(tokens)]
    fine = [(2000 + i, f"the {t} water", None, None) for i, t in enumerate(['"house"', "brown-letter", "some/other", "(people)", "the 2nd letter", "1-2-3"])]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, rows + more + fine), labels).collect()}
    assert [t for i, t in enumerate(tokens) if got[1000 + i] < 0.5] == []
    assert all(got[2000 + i] < 0.5 for i in range(len(fine)))


def test_html_links_and_wrappers():
    """Links inside paragraphs stay, wrappers that only mention boilerplate or hold the page's text stay, and so do formulas; link lists go."""
    para = "<p>The committee met on Monday, and it agreed on most of the plan; details follow, as promised.</p>"
    links = "<ul><li><a href=a>Home</a></li><li><a href=b>About us</a></li></ul>"
    body = f"<h1>Title</h1>{para * 3}<p>For more, see <a href=x>the report</a> of last year, which is long.</p><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>"
    want = "Title " + (para[3:-4] + " ") * 3 + "For more, see the report of last year, which is long. Here x=2 holds."
    for start, end in (("<div class='no-sidebar'>", "</div>"), ("<div class='content-sidebar-wrap'>", "</div>"), ("<div id='has-comments'>", "</div>"), ("<div class='sidebar'>", "</div>"), ("<div>", "</div>"), ("<article>" + links, "</article>")):
        assert html_extract.extract(f"<body>{links}{start}{body}{end}<div class='sidebar'><p>Side text.</p></div>{links}</body>") == want, start


def test_url_canonical(spark):
    """Listed URLs and pages in any spelling; rules fit the host and path as they stand."""
    rules = spark.createDataFrame([("net/", "allow"), ("bad.org/", "allow")], "rule string, verdict string")
    listed = spark.createDataFrame([(u,) for u in ("HTTPS://u:p@Evil.COM.:443/X?q", "free.example.com", "http://odd.net", "http://bad.org", None, "", "/x")], "url string")
    urls = ["http://evil.com/X/1", "http://www.EVIL.com.:80/X", "http://me@evil.com/X?y", "http://evil.com/x", "http://free.example.com", "http://free.example.com:8080?z", "http://odd.net", "http://odd.net/a", "http://bad.org/a", "http://bad.org", None, "x", "http:///x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules, listed).collect()}
    assert [i for i in range(len(urls)) if got[i] == "block"] == [0, 1, 2, 4, 5, 6, 9] and len(got) == len(urls)


def test_html_by_ratios(monkeypatch):
    """A page of unlabelled divs: the ratios find the text, and no others do. Attributes of other names mark nothing; deep nesting is no harm."""
    para = "The committee met on Monday, and it agreed on most of the plan; details follow, as promised, in a week."
    menu = "".join(f"<div><a href=x{i}>Item {i}</a></div>" for i in range(8))
    box = "".join(f"<div><span>Tag {i}</span></div>" for i in range(12))
    page = f"<body><div><div>{menu}</div></div><div><div><h1>Title</h1>{f'<p>{para}</p>' * 5}</div><div>{box}</div></div><div>{menu}</div></body>"
    want = " ".join(["Title", *[para] * 5])
    assert html_extract.extract(page) == want
    ratios, rng = html_extract.path_ratios, np.random.default_rng(0)
    monkeypatch.setattr(html_extract, "path_ratios", lambda nodes, paths, title: np.where(ratios(nodes, paths, title) > 0, rng.random(paths), 0))
    assert sum(html_extract.extract(page) == want for _ in range(20)) < 10
    monkeypatch.undo()
    for marks in ("title='the hidden gems'", "data-id=legal", "class=side-effects", "alt='ads'"):
        assert html_extract.extract(f"<body><div>{menu}</div><div {marks}>{f'<p>{para}</p>' * 3}</div></body>") == " ".join([para] * 3), marks
    assert html_extract.extract(f"<body><div class='content has-sidebar'><article>{f'<p>{para}</p>' * 3}</article></div><div class=sidebar><p>{para}</p></div></body>") == " ".join([para] * 3)
    assert html_extract.extract("<div>" * 50_000 + para + "</x></div>" * 50_000) == para


def test_html_against_articles(spark, monkeypatch):
    """On all test pages the text is the article's, but for articles of a few words; with one ratio for all paths, names still counting, most texts are others."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    got = [html_extract.extract(h) for h in pages]
    want = [brute.article_text(h) for h in pages]
    assert all(g == w or len(w) < 60 for g, w in zip(got, want)) and sum(g == w for g, w in zip(got, want)) >= 0.99 * len(pages)

    def one_ratio(nodes, paths, title):
        out = np.zeros(paths)
        for n in nodes:
            if n.text.strip():
                out[n.element.path] = 1 if n.element.container and n.element.good else html_extract.PENALTY
        return out

    monkeypatch.setattr(html_extract, "path_ratios", one_ratio)
    assert sum(html_extract.extract(h) != g for h, g in zip(pages, got)) >= len(pages) / 3


def test_html_without_names():
    """A page of plain divs, with a footer longer than its short article: the title tells which branch is meant. Halves of an article both stay."""
    foot = "All rights are with their owners, and nobody else has any of them; write to us, if you must."
    short = "<h1>Rain on Monday night</h1><p>Heavy rain fell, and the river rose. Nobody was hurt.</p>"
    page = f"<head><title>Rain on Monday night</title></head><body><div><div><a href=x>Home</a></div></div><div><b>Buy now, pay later.</b></div><section>{short}</section><div class=x>{foot}</div></body>"
    assert html_extract.extract(page) == "Rain on Monday night Heavy rain fell, and the river rose. Nobody was hurt."
    para = "<p>The committee met on Monday, and it agreed on most of the plan; details follow, as promised.</p>"
    halves = f"<body><div><a href=x>Home</a></div><div class=one>{para * 3}</div><div class=two>{para * 3}</div></body>"
    assert html_extract.extract(halves) == " ".join([para[3:-4]] * 6)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One, two.</p>", 5), (1, "u", "<p>One, two.</p>", 5), (None, None, None, 6), (3, "v", "", 7)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_extract.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", "One, two.")] * 2 + [(None, None, ""), (3, "v", "")], key=str)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_toxicity_decoding_matters(spark, monkeypatch):
    """Disguised words alone are evidence only once they are decoded, and addresses, keys and very long tokens are neither changed nor slow."""
    rng = random.Random(5)
    words = ["the", "quick", "brown", "house", "water", "letter", "some", "other", "people", "think"]
    make = lambda extra: " ".join([*(rng.choice(words) for _ in range(30)), *extra])
    rows = [(i, make(["moron"] if i % 5 == 0 else []), None, None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    hidden = [(1000 + i, make([w]), None, None) for i, w in enumerate(["m0r0n", "mo.ron", "m o r o n", "mooooron", "m0ron!", "m*o*r*o*n"])]
    long = [(2000, "a1b2" * 50_000, None, None), (2001, "ab" * 100_000, None, None)]
    score = lambda: {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, rows + hidden + long), labels).collect()}
    got = score()
    assert sum(got[1000 + i] >= 0.5 for i in range(len(hidden))) == len(hidden) and got[2000] < 0.5 and got[2001] < 0.5
    monkeypatch.setattr(toxicity, "LEET", {})
    model = np.zeros(toxicity.SYMBOLS**3).tolist()
    assert toxicity.decode("m0r0n", model) != "moron"  # without the readings of signs there is nothing to decode to


def test_suffix_dedup_against_doubling(spark, texts):
    """The anchored ranks find what prefix doubling over all positions finds."""
    import doubling

    rows = [(i, t, None, None) for i, t in texts if t and t.isascii() and len(t) < 3000]
    df = docs(spark, rows)
    gone = {}
    for r in doubling.repeated(df).collect():
        gone.setdefault(r.d, set()).update(range(r.p, r.p + 100))
    got = {r.doc_id: set(x for s in r.removed for x in range(s.lo, s.hi)) for r in suffix_dedup.dedup(df).collect()}
    assert {i: s for i, s in got.items() if s} == gone and gone
