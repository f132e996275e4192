from pyspark.sql import functions as F

from lakewarden.llm import ngram_join


def test_pairs_already_connected_are_not_tried(spark):
    """All pairs of near copies are a star under the least set; a set that is like another than the least is found too."""
    texts = {k: " ".join(f"w{i if i != 10 * k else -k}" for i in range(200)) for k in range(8)}
    own = [ngram_join.shingle_sets([t])[0] for t in texts.values()]
    band = ngram_join.bands(len(own[0]))[0]
    rows = [((k, k), len(h), [int(x) for x in h.view("int64")], {band: ngram_join.sketch(h, band)}) for k, h in enumerate(own)]
    sets = spark.createDataFrame(rows, "sid struct<s0: bigint, s1: bigint>, n bigint, h array<bigint>, sketches map<int, array<bigint>>")
    x, y = sets.select(F.col("sid").alias("a")), sets.select(F.col("sid").alias("b"))
    every = x.join(y, F.col("a") < F.col("b")).withColumn("band", F.lit(band))
    got = lambda pairs: sorted((r.a.s0, r.b.s0) for r in ngram_join.linked(pairs, sets).collect())
    assert got(every) == [(0, k) for k in range(1, 8)]
    assert got(every.filter("b.s0 = 3 and a.s0 < 3 or a.s0 = 4 and b.s0 = 7")) == [(0, 3), (1, 3), (2, 3), (4, 7)]


def test_more_leaders_are_tried_where_the_first_leave_members_apart(spark, monkeypatch):
    """Of a large group of near copies only the first leaders' pairs are tried; two kinds of texts that share keys are still told apart, and each connected."""
    tried = []
    whole = ngram_join.linked

    def counted(pairs, sets):
        tried.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(ngram_join, "linked", counted)
    near = [" ".join(f"w{i if i != 7 + k % 190 else f'x{k}'}" for i in range(200)) for k in range(120)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(near)], "doc_id long, text string")
    got = ngram_join.similar_documents(docs).select("doc_id", "component_id").collect()
    assert len(got) == 120 and {r.component_id for r in got} == {0}
    few = sum(tried)
    tried.clear()
    monkeypatch.setattr(ngram_join, "LEADERS", ngram_join.BIG_LEADERS)
    assert {r.component_id for r in ngram_join.similar_documents(docs).collect()} == {0}
    assert few < 0.6 * sum(tried)


def test_a_shared_passage_makes_no_pairs_with_more_leaders(spark, monkeypatch):
    """Texts of a large group that share a passage and are not alike: the further leaders' pairs are told from their sketches, and none is tried."""
    tried = []
    whole = ngram_join.linked

    def counted(pairs, sets):
        tried.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(ngram_join, "linked", counted)
    monkeypatch.setattr(ngram_join, "BIG", 16)
    passage = " ".join(f"w{i}" for i in range(150))
    texts = [passage + " " + " ".join(f"x{k}-{i}" for i in range(50)) for k in range(100)]
    texts += [t.replace("x7-0", "y") for t in texts[7:8]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs).select("doc_id", "component_id").collect()}
    assert got == {k: k for k in range(100)} | {100: 7}
    assert tried[0] > 300 and sum(tried[1:]) < 10, tried


def test_a_pair_of_many_common_keys_is_made_about_once(spark, monkeypatch):
    """Texts that are almost alike enough share many keys of a large group; what is left apart makes a row a pair, not one for each key."""
    made = []
    whole = ngram_join._pairs

    def counted(found):
        out = whole(found)
        made.append((found.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_pairs", counted)
    passage = " ".join(f"w{i}" for i in range(175))
    texts = [passage + " " + " ".join(f"x{k}-{i}" for i in range(25)) for k in range(40)]
    texts += [texts[30].replace("x30-24", "y")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs).select("doc_id", "component_id").collect()}
    assert got == {k: k for k in range(40)} | {40: 30}
    rows, pairs = made[-1]
    assert pairs > 300 and rows < 2 * pairs, made


def test_workers_let_go_of_other_steps(spark):
    from lakewarden.llm import common

    common.held("toxicity").append("kept")
    assert common.held("toxicity") == ["kept"]
    assert common.held("ngram_join") == [] and common.held("toxicity") == []
