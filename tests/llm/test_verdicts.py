import numpy as np

from lakewarden.llm import toxicity


def test_tokens_are_judged_as_the_restored_text_is(monkeypatch):
    """Signs behind letters are read once for each two letters before them, as the whole token would be; a text's evidence is that of its restored words."""
    model = np.log(np.random.default_rng(5).dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS, toxicity.SYMBOLS))).astype(np.float32)
    flat = model.ravel().tolist()
    heads, tails = ["idiot", "grit", "Ärger", "no", "i", "moron", "ball", "a-bit"], ["***", "!!", "$$$", ".***", "1", "@!", "*)"]
    tokens = [h + t for h in heads for t in tails]
    expected = [toxicity.decode(t, flat) for t in tokens]
    calls = []
    decode = toxicity.decode
    monkeypatch.setattr(toxicity, "decode", lambda token, *a, **k: calls.append(token) or decode(token, *a, **k))
    readings = toxicity.Readings(flat)
    assert [readings[t] for t in tokens] == expected
    before = len(calls)
    assert readings["bit***"] == decode("bit***", flat) and len(calls) == before  # as in grit***
    weight = {"idiot": 0.9, "moro*": 0.8, "no": 0.5, "b": 0.3}
    text = "No no IDIOT, x a.b i d i o t moronic*** no-no mo_ron " + " ".join(tokens)
    words = set(toxicity._LETTERS.findall(toxicity.restore(text, readings).lower()))
    evidence = toxicity.Evidence(weight)
    assert toxicity.Verdicts(readings, weight).of(text) == sorted(filter(None, map(evidence.__getitem__, words)), reverse=True) != []
