"""What workers keep between tasks is bounded, and other steps let go of it."""

import pytest

from lakewarden.llm import common, packing, toxicity
from lakewarden.llm.queries import tokenizer_path


def test_another_step_lets_go_of_the_tokenizer():
    assert packing.encoder(tokenizer_path())(["some words", ""])[0]
    assert any(isinstance(x, dict) and "words" in x for x in common.held("packing"))
    common.held("toxicity")
    assert common.held("packing") == []


def test_words_are_let_go_of_in_turns(monkeypatch: pytest.MonkeyPatch):
    monkeypatch.setattr(toxicity, "KEPT", 10)
    evidence = toxicity.Evidence({"w7": 0.5, "w123*": 0.25})
    for i in range(200):
        assert evidence[f"w{i}"] == {7: 0.5, 123: 0.25}.get(i, 0.0)
        assert evidence["w7"] == 0.5
        assert len(evidence) + len(evidence.before) <= 20
    assert "w7" in evidence or "w7" in evidence.before  # asked for in each turn


def test_a_kept_column_is_sent_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    out = common.map_column(rows, ["k", "t"], "t", lambda: lambda texts: {"n": [len(t or "") for t in texts]}, "n int")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 1), (2, None, 0)]
    assert "_in" not in out._jdf.queryExecution().toString()
