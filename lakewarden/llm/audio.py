"""Chroma audio fingerprints, and alignment of recordings by them.

A recording's samples become frames of energy per pitch class; box filters over an integral image of the frames give 16 values of
two bits each, packed into one 32-bit code a frame. Two recordings are aligned at the offset where most codes are equal (the
peak of an offset histogram), and match when few bits differ over their overlap there.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import map_column, may_hold, membership, stash
from lakewarden.llm.ngram_join import paired

FRAME, HOP = 2048, 512  #: samples
RATE = 8000  #: of raw samples; WAV files name their own
LOWEST, HIGHEST = 110.0, 3520.0  #: Hz that count towards pitch classes
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25]) / 3
REACH = 8  #: frames under the widest filter
LEVELS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2])
SCALE = 1 << 16  #: energies become whole numbers, whose sums are exact and alike at any place of a recording
#: Filters (kind, first pitch class, classes, frames), by rule: each kind at turning heights and widths.
FILTERS = [(("pitch", "time", "cross", "mid")[k % 4], 5 * k % 12, (4, 6, 12, 6)[k // 4], (2, 4, 6, REACH)[k // 4 if k % 2 else 3 - k // 4]) for k in range(16)]
TIMES = [0, 1, 2, 3, 4, 6, 8]  #: frames at which filters begin, turn or end
MIN_VOTES, MIN_ALIGNED, MAX_ERROR = 2, 8, 0.15
BLOCK = 64  #: frames transformed at a time
CELLS = 1 << 20  #: pairs of a recording's votes made at a time


def samples_of(audio: bytes | None, encoding: str) -> tuple[np.ndarray, int]:
    """Mono samples around 0 and their rate. Encodings: u8 and s16 (raw, RATE), wav (8 or 16 bits, channels averaged); bytes that are no WAV file give no samples."""
    if not audio:
        return np.zeros(0, np.float32), RATE
    channels, rate = 1, RATE
    if encoding == "wav":
        try:
            with wave.open(io.BytesIO(audio)) as w:
                channels, rate, width = w.getnchannels(), w.getframerate(), w.getsampwidth()
                audio = w.readframes(w.getnframes())
        except (wave.Error, EOFError):
            return np.zeros(0, np.float32), RATE
        encoding = {1: "u8", 2: "s16"}.get(width, "")
        if not encoding:
            return np.zeros(0, np.float32), RATE
    if encoding == "u8":
        x = np.frombuffer(audio, np.uint8).astype(np.float32) - 128
    else:
        x = np.frombuffer(audio[: len(audio) // 2 * 2], "<i2").astype(np.float32)
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


@functools.cache
def bins(rate: int) -> tuple[slice, np.ndarray, np.ndarray]:
    """The spectrum's bins from LOWEST to HIGHEST, the pitch class of each as a matrix, and the frames' window."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = slice(*np.searchsorted(hz, (LOWEST, HIGHEST)))
    of = np.round(12 * np.log2(hz[use] / LOWEST)).astype(int) % 12
    return use, np.eye(12, dtype=np.float32)[of], np.hanning(FRAME).astype(np.float32)


def pitch_classes(x: np.ndarray, rate: int) -> np.ndarray:
    """One row a frame: the smoothed, normalised energies of 12 pitch classes. The last frame is filled up with silence; silent frames are zero."""
    n = -(-max(len(x) - FRAME, 0) // HOP) + 1
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), x.dtype)])
    use, to_class, window = bins(rate)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    chroma = np.empty((n + 4, 12))
    for i in range(0, n, BLOCK):
        own = frames[i : i + BLOCK]
        spectrum = np.fft.rfft((own - own.mean(1, keepdims=True)) * window, axis=1)[:, use]
        chroma[2 + i : 2 + i + len(own)] = (spectrum.real**2 + spectrum.imag**2) @ to_class
    chroma[:2] = chroma[-2:] = 0
    chroma = sum(c * chroma[k : k + n] for k, c in enumerate(SMOOTH))
    norm = np.sqrt((chroma**2).sum(1, keepdims=True))
    return np.where(norm > 1e-3, chroma / np.maximum(norm, 1e-3), 0)


@functools.cache
def filter_corners() -> tuple[np.ndarray, np.ndarray]:
    """The filters as sums over an integral image's corners at TIMES: a column each for the part of a filter that counts, and for its whole box; and the share of the part."""
    corners, share = np.zeros((len(TIMES), 25, 32)), np.full(16, 0.5)

    def box(k: int, t0: int, t1: int, p0: int, p1: int) -> None:
        for t, p, sign in ((t1, p1, 1), (t0, p1, -1), (t1, p0, -1), (t0, p0, 1)):
            corners[TIMES.index(t), p, k] += sign

    for k, (kind, p, h, w) in enumerate(FILTERS):
        box(16 + k, 0, w, p, p + h)
        if kind == "pitch":
            box(k, 0, w, p, p + h // 2)
        elif kind == "time":
            box(k, 0, w // 2, p, p + h)
        elif kind == "cross":
            box(k, 0, w // 2, p, p + h // 2)
            box(k, w // 2, w, p + h // 2, p + h)
        else:
            box(k, 0, w, p + h // 4, p + h // 4 + h // 2)
            share[k] = h // 2 / h
    return corners.reshape(-1, 32), share


def codes_of(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The 32-bit codes of a recording, one a frame; 0 where the frame is silent; none if there are no samples."""
    if not len(x):
        return np.zeros(0, np.int64)
    chroma = np.rint(pitch_classes(x, rate) * SCALE)
    n = len(chroma)
    image = np.concatenate([chroma, np.repeat(chroma[-1:], REACH - 1, 0)])
    integral = np.zeros((len(image) + 1, 25))
    integral[1:, 1:] = np.tile(image, 2).cumsum(0).cumsum(1)  # twice, for pitch classes go round
    corners, share = filter_corners()
    out = np.zeros(n, np.int64)
    for i in range(0, n, 16 * BLOCK):
        m = min(16 * BLOCK, n - i)
        at = np.concatenate([integral[i + t : i + t + m] for t in TIMES], 1) @ corners  # whole numbers, so sums are exact
        part, whole = at[:, :16], at[:, 16:]
        level = np.searchsorted(LEVELS, (part - share * whole) / np.maximum(whole, 1))
        out[i : i + m] = (GRAY[level] << np.arange(30, -1, -2)).sum(1)
    return np.where(chroma.any(1), out, 0)


def fingerprint(recordings: DataFrame, key: str, audio: str, encoding: str = "wav") -> DataFrame:
    """recordings(key, audio binary) -> key, print (a hash of the codes), codes (array of long, one a frame), one row per row.

    Null, empty and unreadable audio has no codes; a null key stays null; repeated rows stay; other columns are ignored.
    """

    def start() -> Callable[[list], dict]:
        def step(audios: list[bytes | None]) -> dict:
            codes = [codes_of(*samples_of(b, encoding)) for b in audios]
            return {"print": [hashlib.blake2b(c.tobytes(), digest_size=16).hexdigest() for c in codes], "codes": codes}

        return step

    return map_column(recordings, [key], audio, start, "print string, codes array<bigint>")


def vote_pairs(classes: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """classes(class_id, codes) -> class_id, pos, both, gap, h: every two votes of a recording (where the first is, both codes, frames between them, a hash of codes and gap), less what a membership filter says no query has."""
    shared = classes.sparkSession.sparkContext.broadcast(wanted)
    kind = classes.schema["class_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in batches:
            for name, codes in zip(pdf["class_id"], pdf["codes"]):
                code = np.asarray(codes, np.uint64)
                at = np.flatnonzero((code != 0) & np.concatenate(([True], code[1:] != code[:-1])))
                step = max(1, CELLS // max(len(at), 1))
                for lo in range(0, len(at), step):
                    i, j = np.triu_indices(min(step, len(at) - lo), 1, len(at) - lo)
                    i, j = at[i + lo], at[j + lo]
                    both = code[i] << np.uint64(32) | code[j]
                    h = paired(both, (j - i).astype(np.uint64))
                    own = slice(None) if bits is None else may_hold(bits, h)
                    if len(i := i[own]):
                        yield pd.DataFrame({"class_id": name, "pos": i.astype(np.int32), "both": both[own].view(np.int64), "gap": (j[own] - i).astype(np.int32), "h": h[own].view(np.int64)})

    return classes.select("class_id", "codes").mapInPandas(run, f"class_id {kind}, pos int, both long, gap int, h long")


def votes_of(classes: DataFrame, min_votes: int) -> DataFrame:
    """classes(class_id, codes, _query) -> id (a query), class_id, offset, votes: offsets of min_votes equal codes or more.

    Two votes at one offset are two codes and a gap that both recordings have, so those are joined, and n votes are n (n - 1) / 2 such pairs; single
    equal codes, which any two recordings may share, become no rows. With a min_votes of 1 they are votes and are joined by themselves.
    """
    offset = (F.col("pos") - F.col("_at")).alias("offset")
    if min_votes < 2:
        seed = "filter(transform(codes, (c, i) -> struct(i AS pos, c AS code)), s -> s.code != 0 AND (s.pos = 0 OR get(codes, s.pos - 1) != s.code))"
        seeds = classes.select("class_id", "_query", F.explode(F.expr(seed)).alias("s")).select("class_id", "_query", "s.pos", "s.code")
        asked = seeds.filter("_query").select(F.col("class_id").alias("id"), F.col("pos").alias("_at"), "code")
        hits = asked.join(seeds.select("class_id", "pos", "code"), "code").filter("id != class_id")
        return hits.groupBy("id", "class_id", offset).agg(F.count("*").alias("votes"))
    asked = stash(vote_pairs(classes.filter("_query")), "asked")
    told = vote_pairs(classes, membership(asked, "h")).drop("h")
    hits = asked.select(F.col("class_id").alias("id"), F.col("pos").alias("_at"), "both", "gap").join(told, ["both", "gap"]).filter("id != class_id")
    votes = F.round((1 + F.sqrt(1 + 8 * F.count("*"))) / 2).cast("long")
    return hits.groupBy("id", "class_id", offset).agg(votes.alias("votes")).filter(F.col("votes") >= min_votes)


def search(recordings: DataFrame, key: str, is_query, audio: str, encoding: str = "wav", min_votes: int = MIN_VOTES, min_aligned: int = MIN_ALIGNED, max_error: float = MAX_ERROR) -> DataFrame:
    """Align every recording for which the condition is_query on key holds with all others.

    Recordings of equal codes form a class, named by its smallest key. The result has two kinds of rows: `recording` (id, class_id:
    membership, one per input row with a key) and `match` (id: the class of a query, class_id: another class, offset: frames
    by which the other is late, votes: equal codes at that offset, aligned: frames of overlap, bit_error: share of differing bits there).
    The offset is that of most votes (ties: the smallest shift, then the smaller offset); a pair matches with min_votes votes,
    min_aligned frames and a bit error of max_error at most. Silent frames, and frames that repeat the code before, give no vote.
    Recordings of fewer than min_aligned frames cannot match and are not voted on.
    Recordings without codes match nothing and are classes of their own. An empty table gives an empty result.
    """
    prints = stash(fingerprint(recordings.filter(F.col(key).isNotNull()), key, audio, encoding), "prints")
    named = prints.filter("size(codes) > 0")
    classes = named.groupBy("print").agg(F.min(key).alias("class_id"), F.first("codes").alias("codes"), F.max(is_query).alias("_query"))
    classes = stash(classes, "print-classes")
    votes = votes_of(classes.filter(F.size("codes") >= min_aligned), min_votes)
    best = F.max(F.struct("votes", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("low"))).alias("b")
    pairs = votes.groupBy("id", "class_id").agg(best).filter(F.col("b.votes") >= min_votes)
    pairs = pairs.select("id", "class_id", (-F.col("b.low")).alias("offset"), F.col("b.votes").alias("votes"))
    both = pairs.join(classes.select(F.col("class_id").alias("id"), F.col("codes").alias("_q")), "id").join(classes.select("class_id", F.col("codes").alias("_d")), "class_id")
    both = both.withColumn("_n", F.least(F.size("_q") - F.greatest(F.lit(0), -F.col("offset")), F.size("_d") - F.greatest(F.lit(0), F.col("offset"))))
    both = both.filter(F.col("_n") >= min_aligned)
    wrong = "aggregate(zip_with(slice(_q, greatest(0, -offset) + 1, _n), slice(_d, greatest(0, offset) + 1, _n), (a, b) -> bit_count(a ^ b)), 0, (s, x) -> s + x)"
    both = both.withColumn("bit_error", F.round(F.expr(wrong) / (F.col("_n") * 32), 6)).filter(F.col("bit_error") <= max_error)
    found = both.select(F.lit("match").alias("kind"), "id", "class_id", "offset", "votes", F.col("_n").alias("aligned"), "bit_error")
    own = prints.select(F.col(key).alias("id"), "print", (F.size("codes") > 0).alias("_some")).join(classes.select("print", "class_id"), "print", "left")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("offset", "int"), ("votes", "long"), ("aligned", "int"), ("bit_error", "double"))]
    return own.select(F.lit("recording").alias("kind"), "id", F.coalesce("class_id", "id").alias("class_id"), *none).unionByName(found)
