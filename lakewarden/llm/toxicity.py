"""Toxicity by noisy-channel deobfuscation.

A character language model (letter trigrams counted over all documents) scores the lattice of readings of every suspicious
token (leetspeak, words split by separators, repeated letters); Viterbi picks the likeliest reading, and the restored text is scored by
word evidence learned from labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import held, map_column, stash

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
SYMBOLS = 64  #: symbols of the language model: 0 for non-letters, a-z, then other letters by code point
FIT_ROWS = 20_000  #: labelled rows that the word evidence is fitted on at most
PREFIXES = (4, 6, 7)  #: letters of the word beginnings that count as features beside whole words
LEET_COST = 1.0  #: nats for reading a sign as a letter
KEEP_COST = (3.0, 6.0, 0.0)  #: nats for reading a sign as itself before, among and after the token's letters
DROP_COST = 7.0  #: nats for reading a sign as nothing
LEAST_RATE = 0.8  #: least share of toxic documents among those with a feature
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(re.escape(c) for c in LEET)
#: Single letters or signs, three at least, with one or two separators between them.
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGNS}])(?:(?:[^\w\n{_SIGNS}]|[_*]){{1,2}}(?:[^\W_]|[{_SIGNS}])){{2,}}(?![^\W_])")
#: Tokens with a letter and a sign anywhere, a letter twice or more, or separators inside; what they mean is left to decode.
TOKEN = re.compile(rf"(?<!\S)(?=\S*?[^\W\d_])(?:\S*?[{_SIGNS}]|\S*?([^\W\d_])\1|\S*?[^\W_](?:[^\w\s]|_)+[^\W_])\S*", re.I)
_UNITS = re.compile(rf"([^\W\d_])\1*|(?:[^\w\s{_SIGNS}]|_)+|.", re.S)
_DOUBLED = re.compile(r"([^\W\d_])\1+")
JOIN_COST = 3.0  #: nats for reading separators among a token's letters as nothing
SPLIT_COST = 2.0  #: nats for reading separators between single letters as themselves
SINGLE_COST = 2.5  #: nats for reading a letter written twice as one


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (SYMBOLS - 27) if c.isalpha() else 0


_TABLE = np.array([symbol(chr(i)) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x3000)], np.uint8)


def symbols(text: str) -> np.ndarray:
    """The symbol of each character of lower-cased text; characters from U+3000 on are all letters to the model."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < len(_TABLE), _TABLE[np.minimum(code, len(_TABLE) - 1)], 27 + code % (SYMBOLS - 27)).astype(np.int32)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """docs(text) -> gram, n: letter trigrams of all texts, with a word boundary as a symbol. Each task sends a row per trigram at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, np.int64)
        held("toxicity").clear()  # what an earlier model gave
        for pdf in batches:
            texts = [t for t in pdf["text"] if t]
            for i in range(0, len(texts), 200):
                s = np.concatenate(([0], symbols("\n".join(texts[i : i + 200]).lower()), [0]))
                keep = np.ones(len(s), bool)
                keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
                s = s[keep]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})

    return docs.select("text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b; SYMBOLS cubed at any input size."""
    counts = np.zeros(SYMBOLS**3)
    for gram, n in trigram_counts(docs).collect():
        counts[gram] = n
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2 = c3.sum(0)
    p1 = (c2.sum(0) + 1) / (c2.sum() + SYMBOLS)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def decode(token: str, model: list[float], spaced: bool = False, before: tuple[int, int] = (0, 0)) -> str:
    """The likeliest reading of a token under the model (flat): a Viterbi pass over (two last symbols, written text) states, all of which are kept.

    A run of one letter may stand for one or two; separators among letters may stand for nothing, and between single letters
    mostly do; a sign may be itself, a letter or nothing. Linear in the token's length. before: the symbols of the two letters in front, of a tail of signs.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {before: (0.0, ())}  # a written text is what was last written, after a text
    letters = [i for i, c in enumerate(token) if c.isalpha()] or [0]
    for m in _UNITS.finditer(token.lower()):
        run = m[0]
        c = run[0]
        where = 0 if m.start() < letters[0] else 1 if m.start() < letters[-1] else 2
        if c.isalpha():
            options = [(c, 0.0 if len(run) != 2 else SINGLE_COST)] + ([(c * 2, 0.5 if len(run) > 2 else 0.0)] if len(run) > 1 else [])
        elif spaced and (c == "*" or c not in LEET and not c.isdigit()):
            options = [("", 0.0), (run, SPLIT_COST)]
        elif c not in LEET and not c.isdigit():
            options = [(run, 0.0)] + ([("", JOIN_COST)] if where == 1 else [])
        else:
            keep = KEEP_COST[where] + 2.5 * (where == 2 and c in "$@€" or c.isdigit())
            options = [(c, keep), *((x, LEET_COST) for x in LEET.get(c, "")), ("", JOIN_COST if c == "*" and where == 1 else DROP_COST)]
        coded = [(written, extra, [symbol(x) for x in written]) for written, extra in options]
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, text) in states.items():
            for written, extra, zs in coded:
                x, y, total = a, b, cost + extra
                for z in zs:
                    if z or y:
                        total -= model[(x * SYMBOLS + y) * SYMBOLS + z]
                        x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (text, written) if written else text)
        states = after
    ends = [(cost - (model[(a * SYMBOLS + b) * SYMBOLS] if b else 0), text) for (a, b), (cost, text) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_written(text) for cost, text in ends if cost == least)


def _written(text: tuple) -> str:
    """The text of a chain of pieces, last first."""
    pieces = []
    while text:
        text, piece = text
        pieces.append(piece)
    return "".join(reversed(pieces))


def undouble(token: str, model: list[float], memo: dict[str, str]) -> str:
    """decode for a token of letters alone with one run of two: the reading depends on the two letters on either side."""
    m = _DOUBLED.search(token.lower())
    near = token[max(m.start() - 2, 0) : m.end() + 2].lower()
    key = f"{'' if m.start() > 1 else '^'}{near}{'' if m.end() + 2 <= len(token) else '$'} {m.start() and min(m.start(), 2)}"
    if key not in memo:
        a, b = ([0, 0] + [symbol(c) for c in near[: m.start() if m.start() < 2 else 2]])[-2:]
        c, tail = symbol(m[1]), [symbol(x) for x in near[min(m.start(), 2) + 2 :]]
        tail += [0] * (len(tail) < 2)

        def cost(run: list[int]) -> float:
            x, y, total = a, b, 0.0
            for z in run + tail:
                total -= model[(x * SYMBOLS + y) * SYMBOLS + z]
                x, y = y, z
            return total

        memo[key] = "1" if cost([c]) + SINGLE_COST < cost([c, c]) else "2"
    return token.lower() if memo[key] == "2" else token[: m.start()].lower() + token[m.end() - 1 :].lower()


KEPT = 150_000  #: words whose readings, or evidence, a worker keeps between texts, and as many of the time before; most words of large inputs are met once
CORES = 400_000  #: tokens without the signs around them, whose readings take longest to make


class Kept(dict):
    """What was made of words when first asked for; when there are KEPT of them, those not asked for until there are as many again are let go of."""

    def __init__(self):
        super().__init__()
        self.before: dict = {}

    def made(self, word: str):
        raise NotImplementedError

    def __missing__(self, word: str):
        if len(self) >= KEPT:
            self.before = dict(self)
            self.clear()
        out = self.before[word] if word in self.before else self.made(word)
        if len(word) <= 1_000:
            self[word] = out
        return out

    def let_go(self) -> None:
        self.clear()
        self.before = {}


class Readings(Kept):
    """The readings of tokens and of the white space between them; apart from it, those of tokens' cores, emptied when there are very many."""

    def __init__(self, model: list[float]):
        super().__init__()
        self.model, self.near, self.cores, self.tails = model, {}, {}, {}

    def made(self, token: str) -> str:
        if not TOKEN.match(token):
            return token
        core = token.rstrip(TAIL)  # what ends a token is written as it is, at no cost, so tokens that differ in it alone are read once
        return self.read(core) + token[len(core) :] if any(map(str.isalpha, core)) else decode(token, self.model)

    def read(self, token: str) -> str:
        low = token.lower()
        if low not in self.cores:
            if len(self.cores) + len(self.near) + len(self.tails) > CORES:
                self.cores.clear()
                self.near.clear()
                self.tails.clear()
            runs = _DOUBLED.findall(low) if token.isalpha() and len(low) == len(token) else []
            alone = len(runs) == 1 and len(_DOUBLED.search(low)[0]) == 2
            out = undouble(token, self.model, self.near) if alone else self.tailed(low) if len(low) == len(token) else decode(token, self.model)
            if len(token) > 1_000:
                return out
            self.cores[low] = out
        return self.cores[low]

    def tailed(self, low: str) -> str:
        """decode for a token in lower case; letters that have one reading alone leave the signs behind them a matter of the last two letters."""
        n = len(low)
        while n and not low[n - 1].isalpha():
            n -= 1
        head, tail = low[:n], low[n:]
        if n < 2 or not tail or not head.isalpha() or _DOUBLED.search(head):
            return decode(low, self.model)
        key = (tail, symbol(head[-2]), symbol(head[-1]))
        if key not in self.tails:
            self.tails[key] = decode(tail, self.model, before=key[1:])
        return head + self.tails[key]


TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET)  #: signs that stand for nothing but themselves behind a word
_PARTS = re.compile(r"(\s+)")


def readings_of(model: np.ndarray) -> Readings:
    """The readings under a model (as broadcast: a worker's tasks see one object), made in this or an earlier task of the worker."""
    last = held("toxicity")  # the model of the last task and its readings; then the evidence of that task and its verdicts
    if not last or last[0] is not model:
        last[:] = [model, Readings(model.ravel().tolist())]
    return last[1]


def verdicts_of(readings: Readings, weight: dict[str, float]) -> Verdicts:
    """The verdicts by some evidence (as broadcast) on what readings_of gave, made in this or an earlier task of the worker."""
    last = held("toxicity")
    if len(last) < 4 or last[2] is not weight:
        readings.let_go()  # those of whole tokens; what is made of them is kept from here on
        last[2:] = [weight, Verdicts(readings, weight)]
    return last[3]


def joined(text: str, readings: Readings) -> str:
    """text with its spaced single letters read by decode."""

    def join(m: re.Match) -> str:
        return decode(m[0], readings.model, True) if any(c.isalpha() for c in m[0]) else m[0]

    return SPACED.sub(join, text)


def restore(text: str, readings: Readings) -> str:
    """text with its suspicious tokens read by decode."""
    return "".join(map(readings.__getitem__, _PARTS.split(joined(text, readings))))


def features(text: str) -> set[str]:
    """Words of restored text, and their beginnings marked by a star."""
    words = set(_LETTERS.findall(text.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) >= k} for k in PREFIXES))


class Evidence(Kept):
    """P(toxic | feature) of a word, by the strongest of itself and its beginnings (0 if none is evidence)."""

    def __init__(self, weight: dict[str, float]):
        super().__init__()
        self.weight = weight

    def made(self, word: str) -> float:
        return max(self.weight.get(word, 0.0), *(self.weight.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) >= k), 0.0)

    def of(self, text: str) -> tuple[tuple[str, float], ...]:
        """The words of restored text that are evidence, with theirs."""
        return tuple((word, found) for word in set(_LETTERS.findall(text.lower())) if (found := self[word]))


class Verdicts(Kept):
    """The evidence among the words of tokens, once they are read."""

    def __init__(self, readings: Readings, weight: dict[str, float]):
        super().__init__()
        self.readings, self.evidence = readings, Evidence(weight)

    def made(self, token: str) -> tuple[tuple[str, float], ...]:
        return self.evidence.of(self.readings.made(token))

    def of(self, text: str) -> list[float]:
        """The evidence of a text's words, each once, strongest first. A word ends where its token does, so no text is put together again."""
        found = set(map(self.__getitem__, set(joined(text, self.readings).split())))
        return sorted({word: p for each in found for word, p in each}.values(), reverse=True)


def evidence(docs: DataFrame, labels: DataFrame, model: np.ndarray, rows: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """Features that point to toxic documents, with P(toxic | feature); the base rate. Fitted on `rows` labelled rows at most, those of the smallest hashes."""
    own = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("_y") > 0).cast("int").alias("y"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        readings = readings_of(shared.value)
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                seen[y].update(features(restore(text, readings)))
                seen[y][""] += 1
        keys = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pd.DataFrame({"feature": part, "n0": [seen[0][k] for k in part], "n1": [seen[1][k] for k in part]})

    counts = train.mapInPandas(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = stash(counts, "evidence")
    n0, n1 = next(iter(sums.filter("feature = ''").select("n0", "n1").collect()), (1, 0))
    base = (n1 + 0.5) / (n0 + n1 + 1)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("n0") + F.col("n1")) * p))).otherwise(0.0)
    gain = 2 * (part("n1", base) + part("n0", 1 - base))  # of likelihood; by chance the best of all features gains about twice the log of their number
    strong = sums.filter((F.col("feature") != "") & (F.col("n1") >= LEAST_RATE * (F.col("n0") + F.col("n1")))).withColumn("gain", gain).filter(F.col("gain") >= 2 * np.log(max(2, sums.count())))
    got = strong.orderBy(F.desc("gain"), "feature").collect()  # no more than the fitted rows, whose number is bounded, can bear out
    return {r["feature"]: (r["n1"] + 0.2 * base) / (r["n0"] + r["n1"] + 0.2) for r in got}, base


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """docs(doc_id, text) -> the columns `keep`, score, n_evidence (and the restored text, if asked for), scored with evidence fitted on labels(doc_id, toxic).

    The score is 1 - product of (1 - P(toxic | feature)) over all the document's evidence, of which a word and its beginnings
    count once, by the strongest; and half the base rate at most without any. Null and empty texts have no evidence; texts of any length are
    read whole, in time linear in it; repeated rows are scored alike; null doc_ids are scored, but have no label; other columns are
    ignored; an empty table gives an empty result; without labels nothing is toxic.
    """
    model = language_model(docs)
    found, base = evidence(docs, labels, model)
    spark = docs.sparkSession
    shared, weights = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(found)
    floor = min(base, 0.5) / 2

    def start() -> Callable[[list], dict]:
        readings = readings_of(shared.value)
        verdicts = verdicts_of(readings, weights.value)

        def step(texts: list[str | None]) -> dict:
            restored, scores, counts = [], [], []
            for t in texts:
                hits = verdicts.of(t) if t else []
                scores.append(1 - float(np.prod([1 - p for p in hits])) if hits else floor)
                counts.append(len(hits))
                if with_text:
                    restored.append(restore(t, readings) if t else "")
            return {"score": scores, "n_evidence": counts} | ({"restored": restored} if with_text else {})

        return step

    return map_column(docs, keep, "text", start, "score double, n_evidence int" + ", restored string" * with_text)
