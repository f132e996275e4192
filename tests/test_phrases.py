import random
import re

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import phrases

TEXTS = ["Money laundering and MONEY  laundering", "", None, " leading money laundering", "anti-money-laundering, fraud. Fraud", "fraudster frauds _fraud fraud", "é fraudé Étude étude", "a b a b a b a", "x" * 300 + " fraud " + "y" * 300]
LIST = ["money laundering", "Fraud", "anti-money-laundering", "étude", "a b a", "a", "nothing here", "fraud", "  ", "é"]


def test_against_regex(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "fraud", "money", "laundering,", "étude"]) for _ in range(60)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.phrase): (r.n, r.position, r.context) for r in phrases.find_phrases(df, spark.createDataFrame([(p,) for p in LIST], "phrase string")).collect()}
    want = {}
    for i, t in enumerate(texts):
        for p in filter(None, map(str.strip, LIST)):
            hits = list(re.finditer(rf"(?=\b{re.escape(p)}\b)", t or "", re.I))
            if hits:
                at = hits[0].start()
                want[i, p] = (len(hits), at + 1, t[max(0, at - 100) : at + len(p) + 100])
    assert got == want


def test_shuffled_list_and_errors(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    listed = spark.createDataFrame([(p,) for p in LIST], "phrase string")
    whole = sorted(map(tuple, phrases.find_phrases(df, listed).collect()))
    monkeypatch.setattr(phrases, "BROADCAST", 2)
    assert sorted(map(tuple, phrases.find_phrases(df, listed).collect())) == whole
    assert phrases.find_phrases(df, listed.filter("phrase = ''")).collect() == []
    with pytest.raises(Exception, match="no phrase of words"):
        phrases.find_phrases(df, spark.createDataFrame([("c++",)], "phrase string")).collect()


def test_highlight(spark):
    df = spark.createDataFrame([("A Fraud, frauds and fraud", "fraud"), ("a.b", "a.b")], "c string, p string")
    assert [r[0] for r in df.select(phrases.highlighted(F.col("c"), F.col("p"))).collect()] == ["A <mark>Fraud</mark>, frauds and <mark>fraud</mark>", "<mark>a.b</mark>"]
