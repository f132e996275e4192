"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a trigram is the product of its letters' vectors, rotated by their place; a text is
the sum of its trigrams' vectors, a language the sum of its texts. A text's language is the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import map_column

DIM = 1024
LETTERS = 4096  #: rows of the table of letter vectors; a letter's row is its code point modulo this
LANGUAGES = 500  #: learned languages at most; more is an error


def letter_vectors(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, DIM))


def gram_vectors(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes."""
    a, b, c = grams // LETTERS**2, grams // LETTERS % LETTERS, grams % LETTERS
    return np.roll(table[a], 2, axis=1) * np.roll(table[b], 1, axis=1) * table[c]


_LETTER = np.zeros(0x110000, np.uint16)


def _letter_table() -> np.ndarray:
    if not _LETTER.any():
        for i in range(len(_LETTER)):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                _LETTER[i] = i % LETTERS or 1
    return _LETTER


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of lower-cased text and their counts; 0 is the edge of a word."""
    code = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate(([0], code, [0])).astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:], return_counts=True)


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their bundled vectors, from docs(text, lang). Tasks send one vector for each language they met, summed by dimension in Spark."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}
        table = letter_vectors()

        def fold(lang: str) -> None:
            own = counts.pop(lang)
            grams, n = np.fromiter(own.keys(), np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own))
            total = sums.setdefault(lang, np.zeros(DIM, np.int64))
            for i in range(0, len(grams), 4096):
                total += n[i : i + 4096] @ gram_vectors(grams[i : i + 4096], table).astype(np.int64)

        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                texts = texts.tolist()
                for i in range(0, len(texts), 100):
                    own = counts.setdefault(lang, {})
                    for g, n in zip(*(x.tolist() for x in grams_of("\n".join(texts[i : i + 100])))):
                        own[g] = own.get(g, 0) + n
                    if len(own) > 100_000:
                        fold(lang)
        for lang in list(counts):
            fold(lang)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = docs.select("text", "lang").filter("lang is not null and text is not null").mapInPandas(bundle, "lang string, vector array<bigint>")
    rows = parts.select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    whole = rows.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("vector"))
    got = whole.orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(got) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return [r[0] for r in got], np.array([r[1] for r in got], np.float64).reshape(len(got), DIM)


def predict_language(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, with prototypes of learned(text, lang).

    score is the cosine, cut to 0 to 1. Null texts, texts without a letter, and all texts if nothing could be learned, are `und`
    with score 0; ties go to the smaller language; repeated rows are judged alike; other columns are ignored.
    """
    langs, bundle = prototypes(learned)
    norms = np.linalg.norm(bundle, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((langs, bundle / np.where(norms == 0, 1, norms)))

    def start() -> Callable[[list], dict]:
        names, proto = shared.value
        table = letter_vectors()
        row: dict[int, int] = {}  # of each trigram met, its row in vectors
        vectors = np.zeros((1024, DIM), np.float32)

        def step(texts: list[str | None]) -> dict:
            nonlocal vectors
            out_lang, out_score = [], []
            for text in texts:
                grams, n = grams_of(text) if text else ((), ())
                if not len(grams) or not names:
                    out_lang.append("und")
                    out_score.append(0.0)
                    continue
                listed = grams.tolist()
                new = np.array([g for g in listed if g not in row], np.int64)
                if len(new):
                    if len(row) + len(new) > 16_384:
                        row.clear()
                        new = grams
                    while len(row) + len(new) > len(vectors):
                        vectors = np.concatenate((vectors, np.zeros_like(vectors)))
                    vectors[len(row) : len(row) + len(new)] = gram_vectors(new, table)
                    row.update(zip(new.tolist(), range(len(row), len(row) + len(new))))
                vector = n.astype(np.float32) @ vectors[[row[g] for g in listed]]
                size = float(np.linalg.norm(vector))
                cosine = proto @ vector / size if size else np.zeros(len(names))
                best = int(np.argmax(cosine))
                out_lang.append(names[best])
                out_score.append(float(np.clip(cosine[best], 0, 1)))
            return {"lang_pred": out_lang, "score": out_score}

        return step

    return map_column(docs, ["doc_id"], "text", start, "lang_pred string, score double")
