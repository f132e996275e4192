"""Fill-in-middle: texts are cut in three at two units, and the middle is moved to the end behind marks.

The code points of many texts become one sequence of character classes in a wavelet matrix. A unit begins where a run of white space
does, so the number of units before a place is a sum of rank queries over the classes that open one; each cut is found by bisection on these
counts, for all texts at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import map_column

MARKS = ("<P>", "<S>", "<M>")
AT_ONCE = 1 << 22  #: code points in one wavelet matrix; a longer text has one of its own
#: Classes, by bits: white space, first of its run, and line end (of white space) or ASCII letter or digit (of the rest).
SPACE, FIRST, MINOR = 4, 2, 1
OPENS = (SPACE | FIRST, SPACE | FIRST | MINOR)  #: the classes that open a unit


def _of_ascii() -> np.ndarray:
    c = np.arange(129)
    space = (c == 0x20) | (c >= 9) & (c <= 13)
    plain = (c >= 48) & (c <= 57) | (c >= 65) & (c <= 90) | (c >= 97) & (c <= 122)
    return (SPACE * space + MINOR * (plain | (c == 10) | (c == 13))).astype(np.uint8)


ASCII = _of_ascii()


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each code point; runs end where a text does."""
    found = ASCII[np.minimum(points, 128)]
    space = found >= SPACE
    first = np.ones(len(points), bool)
    first[1:] = space[1:] != space[:-1]
    first[starts[starts < len(points)]] = True
    found[first] += FIRST
    return found


class WaveletMatrix:
    """Ranks over a sequence of small numbers: a bit vector a level, the highest bit first, each with counts by 64 bits."""

    def __init__(self, sequence: np.ndarray, levels: int = 3):
        self.levels, self.n = [], len(sequence)
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            words = packed.view("<u8")
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((level, words, counts, self.n - int(counts[-1])))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before `at`."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        lo, hi = np.zeros_like(at), at
        for level, words, counts, zeros in self.levels:
            ones_lo, ones_hi = self._ones(words, counts, lo), self._ones(words, counts, hi)
            lo, hi = (zeros + ones_lo, zeros + ones_hi) if symbol >> level & 1 else (lo - ones_lo, hi - ones_hi)
        return hi - lo


def cut_places(texts: Sequence[str], draws: np.ndarray, opens: Sequence[int] = OPENS) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its number of units n, and the code points before the two cuts, which stand after min and max of draws % (n + 1) units."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    found = classes(points, starts)
    matrix = WaveletMatrix(found)
    opened = lambda at: sum(matrix.rank(s, at) for s in opens)
    base = opened(np.minimum(starts + 1, ends))  # white space that begins a text opens no further unit
    n = np.where(sizes > 0, opened(ends) - base + 1, 0)
    units = np.sort(draws % (n + 1)[:, None], axis=1)
    goal = (base[:, None] + units).ravel()
    lo, hi = np.repeat(starts, 2), np.repeat(ends, 2)
    while (lo < hi).any():  # the least place with `units` units opened up to and with it
        mid = (lo + hi) >> 1
        enough = opened(np.minimum(mid + 1, matrix.n)) >= goal
        lo, hi = np.where(enough | (lo >= hi), lo, mid + 1), np.where(enough, mid, hi)
    places = lo.reshape(-1, 2) - starts[:, None]
    return n, np.where(units == 0, 0, np.where(units == n[:, None], sizes[:, None], places))


def arranged(text: str, form: str, first: int, last: int) -> str:
    p, s, m = MARKS
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output.

    The draws come from the sha256 of seed and doc_id, so reruns agree: `rate` of 100 texts are cut, `spm` of 100 of these with the suffix first.
    Empty texts (null is empty) and those that hold a mark stay plain, with null lengths. A null doc_id draws as an empty one; repeated rows each get their
    row; other columns are ignored; an empty table gives an empty result; a very long text is cut whole, in memory in proportion to it.
    """
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(MARKS[0]) | text.contains(MARKS[1]) | text.contains(MARKS[2])
    form = F.when((text == "") | marked | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", F.struct(text.alias("text"), form.alias("form"), draw(0).alias("a"), draw(1).alias("b")).alias("job"))

    def start():
        def step(jobs: list[dict]) -> dict:
            out: dict[str, list] = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            held, size = [], 0
            for job in [*jobs, None]:
                if held and (job is None or size + len(job["text"]) > AT_ONCE):
                    n, places = cut_places([x["text"] for x in held], np.array([(x["a"], x["b"]) for x in held], np.int64))
                    for x, units, (first, last) in zip(held, n.tolist(), places.tolist()):
                        plain = x["form"] == "plain"
                        got = (units, x["form"], None if plain else first, None if plain else last - first, x["text"] if plain else arranged(x["text"], x["form"], first, last))
                        for c, v in zip(out, got):
                            out[c].append(v)
                    held, size = [], 0
                if job is not None:
                    held.append(job)
                    size += len(job["text"])
            return out

        return step

    return map_column(rows, ["doc_id"], "job", start, "n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of."""
    p, s, m = MARKS
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)  # a cut text holds no mark itself
    after = lambda c, mark: F.substring_index(c, mark, -1)
    psm = F.concat(after(F.substring_index(head, s, 1), p), middle, after(head, s))
    spm = F.concat(after(head, p), middle, after(F.substring_index(head, p, 1), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
