"""Large lists of phrases over texts in one pass: runs of words with what stands between them are told by a filter of the list's hashes, then meet the list itself.

A text is words and gaps in turn. A phrase of n words is found where n words and the gaps between them are its own, in any case; that is a match with
word boundaries at both ends. The list's phrases are grouped by their number of words, so each place of a text asks once for each length, not once for each phrase.
Hashes of runs are differences of a sum over a text's bytes; hits are added up within a text, so what is shuffled is a row for each text and phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import load

AROUND = 100  #: characters of context on either side
BROADCAST = 200_000  #: phrases that are broadcast; a longer list is joined by a shuffle
ROWS = 200  #: texts looked through at a time
FILTER_BITS = 1 << 26  #: of the list's filter: 8 MB for any list; a fuller one lets more pass, which the join removes
MOST_WORDS = 12  #: of a phrase; one of more is an error
_P, _BYTE = 0x2545F4914F6CDD1D, np.random.default_rng(7).integers(1, 2**64, 256, np.uint64)


def parts_of(text: Column) -> Column:
    """Words and gaps in turn, a word first (an empty gap is put before a text that begins with none): runs of letters, digits and underscores, and of all else."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    return F.when(text.rlike(r"(?U)^\W"), F.concat(F.array(F.lit("")), found)).otherwise(found)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each begins (and the last ends)."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = strings.buffers()
    at = np.frombuffer(at, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over data up to each place, and what their differences are multiplied by so that equal runs are alike."""
    power, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), x, np.uint64)))) for x in (_P, pow(_P, -1, 2**64)))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1]))), back


def _places(sums: np.ndarray, back: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The filter's bits for runs of bytes."""
    h = (sums[last] - sums[first]) * back[first]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _list_filter(listed: DataFrame) -> np.ndarray:
    """listed(low) as FILTER_BITS bits in bytes; the driver gets FILTER_BITS / 64 words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = _bytes(b.column(0))
            yield pa.record_batch({"place": _places(*_hashes(data), at[:-1], at[1:])})

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    got = listed.select("low").mapInArrow(run, "place long").groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def find_phrases(texts: DataFrame, phrases: DataFrame, with_context: bool = True) -> DataFrame:
    """texts(id, text) and phrases(phrase) -> id, phrase, n (hits), position (of the first, from 1) and context: the first hit with AROUND characters on either side (null if not asked for).

    Case does not count. A phrase begins and ends with a word character; blank ones and repeated ones are left out, any other is an error. Hits of one phrase
    may overlap. Rows of one id are one text each, but their hits are added up: ids should be unique. Null texts have no hits.
    """
    spark = texts.sparkSession
    asked = phrases.select(F.trim("phrase").alias("phrase")).filter("phrase <> ''").distinct().withColumn("_parts", F.transform(parts_of(F.col("phrase")), lambda p: F.lower(p)))
    bad = (F.col("phrase") != "") & ((F.size("_parts") % 2 == 0) | (F.size("_parts") >= 2 * MOST_WORDS) | (F.get("_parts", F.lit(0)) == ""))  # a join may ask before blank ones are left out
    listed = asked.withColumn("_parts", F.when(bad, F.raise_error(F.concat(F.lit("no phrase of words: "), F.col("phrase")))).otherwise(F.col("_parts")))
    listed = listed.select("phrase", F.size("_parts").alias("parts"), F.array_join("_parts", "").alias("low"))
    sizes = sorted(r[0] for r in listed.select("parts").distinct().collect())  # MOST_WORDS values at most
    if not sizes:
        return spark.createDataFrame([], f"id {texts.schema['id'].dataType.simpleString()}, phrase string, n long, position int, context string")
    small = listed.limit(BROADCAST + 1).count() <= BROADCAST
    shared = spark.sparkContext.broadcast(_list_filter(listed))

    def look(b: pa.RecordBatch) -> pa.RecordBatch:
        bits, low = shared.value, b.column(1)
        data, at = _bytes(low.flatten())
        count = low.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(count) - count
        of = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(of)) - begin[of]  # of a part in its text
        length = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(length) - length
        position = before - before[begin[of]] + 1 if len(of) else before
        word = (place % 2 == 0) & (at[1:] > at[:-1])
        sums, back = _hashes(data)
        raw, found = data.tobytes(), {}
        for n in sizes:
            start = np.flatnonzero(word & (place + n <= count[of]))
            first, last = at[start], at[start + n]
            bit = _places(sums, back, first, last)
            hit = np.flatnonzero((bits[bit >> 6] >> (bit & 63)) & 1)
            for doc, lo, hi, p in zip(of[start[hit]].tolist(), first[hit].tolist(), last[hit].tolist(), position[start[hit]].tolist()):
                key = (doc, n, raw[lo:hi])
                if key in found:
                    found[key][0] += 1
                else:
                    found[key] = [1, p]
        docs, parts, lows = zip(*found) if found else ((), (), ())
        hits, at_ = zip(*found.values()) if found else ((), ())
        lows, around = [x.decode() for x in lows], [None] * len(docs)
        if with_context:
            texts_ = b.column(3).to_pylist()
            around = [texts_[d][max(p - 1 - AROUND, 0) : p - 1 + len(x) + AROUND] for d, p, x in zip(docs, at_, lows)]
        own = [b.column(0).take(pa.array(docs, pa.int64())), pa.array(lows, pa.string()), pa.array(parts, pa.int32()), pa.array(hits, pa.int64()), pa.array(at_, pa.int32()), pa.array(around, pa.string())]
        return pa.RecordBatch.from_arrays(own, ["id", "low", "parts", "n", "position", "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                yield look(whole.slice(i, ROWS))

    own = texts.select("id", "text", parts_of(F.col("text")).alias("_all"))
    own = own.select("id", F.transform("_all", lambda p: F.lower(p)).alias("_low"), F.transform("_all", lambda p: F.length(p)).alias("_length"), *["text"] * with_context)
    near = own.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, low string, parts int, n long, position int, context string")
    found = near.join(F.broadcast(listed) if small else listed, ["low", "parts"])
    return found.groupBy("id", "phrase").agg(F.sum("n").alias("n"), F.min(F.struct("position", "context")).alias("_f")).select("id", "phrase", "n", "_f.position", "_f.context")


def highlighted(context: Column, phrase: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """A context with its hits of a phrase between marks, in any case."""
    quoted = F.concat(F.lit(r"(?iU)\b(\Q"), phrase, F.lit(r"\E)\b"))
    return F.regexp_replace(context, quoted, F.lit(f"{before}$1{after}"))


_PARTS = r"regexp_extract_all(lower(text), '[a-zA-Z0-9_\x{80}-\x{10FFFF}]+|[^a-zA-Z0-9_\x{80}-\x{10FFFF}]+')"


@query(f"""WITH t AS (SELECT doc_id, unnest({_PARTS}) AS w, generate_subscripts({_PARTS}, 1) AS i FROM documents), l AS (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+( [A-Za-z]+)?')) AS phrase FROM documents),
x AS (SELECT doc_id, w, w || lead(w) OVER o || lead(w, 2) OVER o AS w3, 1 + coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, position, w AS s FROM x UNION ALL SELECT doc_id, position, w3 FROM x WHERE w3 IS NOT NULL)
SELECT doc_id, phrase, count(*) AS n, CAST(min(position) AS INTEGER) AS position FROM c JOIN l ON s = phrase WHERE phrase <> '' GROUP BY ALL""")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """The beginnings of all documents (a word or two, in Latin letters) as a list of phrases, looked up in all documents."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    listed = docs.select(F.lower(F.regexp_extract("text", "^[A-Za-z]+( [A-Za-z]+)?", 0)).alias("phrase")).filter("phrase <> ''").distinct()
    return find_phrases(docs, listed, with_context=False).select(F.col("id").alias("doc_id"), "phrase", "n", "position")
