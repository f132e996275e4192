"""Benchmark decontamination by winnowing: of every window of words the least hash of its k-grams is kept, fingerprints of documents and
items are joined, and hits are extended word by word to the whole shared span.

Two equal windows have the same least hash, so a span of SPAN words or more that a document shares with an item always meets in a
fingerprint inside it: nothing shared is missed, and the extension, which compares the words themselves, lets nothing else pass. Items of fewer
words than a window are windows as a whole, found by the hash of all their words. All expressions are DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import ascii_lower, stash, text_hash

SPAN = 10  #: words of a window
GRAM = 4  #: words of a k-gram
SIDE = SPAN - GRAM  #: words on either side of a k-gram that its windows can reach
BROADCAST = 500_000  #: fingerprints of items (64 MB at most with their words) that are broadcast; more are joined by a shuffle


#: ASCII characters that are in no word.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Words of a text as they are written: runs of digits, letters and characters beyond ASCII; none in a null text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAPS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def with_gram_hashes(df: DataFrame) -> DataFrame:
    """df(words, ..) and `hashes`: at i the hash of the GRAM words from i (meaningless where fewer are left).

    Words are hashed in lower case of all letters: words that differ in A-Z alone have one hash, and what else has is told apart at the hits.
    """
    out = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    n = 1
    while n < GRAM:
        out = out.withColumn("hashes", F.zip_with("hashes", F.expr(f"slice(hashes, {n + 1}, greatest(size(hashes) - {n}, 0))"), lambda a, b: F.xxhash64(a, b)))
        n *= 2
    return out


def fingerprints(df: DataFrame) -> DataFrame:
    """df(words, ..) -> for each window whose leftmost least hash is at another place than the one's before: its columns, that hash `fp`, and the window's place `j`."""
    made = with_gram_hashes(df)  # a filter on the number of words would have them split twice
    rows = made.select("*", F.posexplode(F.slice("hashes", 1, F.greatest(F.size("words") - (SPAN - 1), F.lit(0)))).alias("j", "_first"))
    h = lambda i: F.get("hashes", F.col("j") + i)
    inner = F.least(*(h(i) for i in range(SIDE)))
    new = (F.col("j") == 0) | (h(-1) <= inner) | (h(SIDE) < inner)  # the last window's leftmost choice has left, or is beaten
    return rows.filter(new).withColumn("fp", F.least(inner, h(SIDE)))


def placed(rows: DataFrame, beyond: str) -> DataFrame:
    """Rows of fingerprints -> `at`, the place of the leftmost k-gram of hash fp, and `own`, its context: the k-gram with SIDE words before and after
    it in lower case; `beyond`, which is no word, stands where the text has none.
    """
    first = F.greatest(F.col("j") - SIDE, F.lit(0))
    kept = [c for c in rows.columns if c not in ("words", "hashes", "_first", "j")]
    near = rows.select(*kept, "j", F.slice("hashes", F.col("j") + 1, SIDE + 1).alias("_hashes"), F.slice("words", first + 1, F.col("j") + SPAN + SIDE - first).alias("_near"))
    at = near.withColumn("at", (F.col("j") + F.array_position("_hashes", F.col("fp")) - 1).cast("int"))
    own = F.transform(F.sequence(F.col("at") - SIDE, F.col("at") + (GRAM + SIDE - 1)), lambda i: F.coalesce(ascii_lower(F.get("_near", i - first)), F.lit(beyond)))
    return at.select(*kept, "at", own.alias("own"))


def extended(own: Column, other: Column) -> Column:
    """(left, right): how many words before and after the k-gram of two contexts agree in a row; null if the k-grams differ."""

    def run(places: list[int]) -> Column:
        out = F.lit(len(places))
        for n in range(len(places) - 1, -1, -1):
            out = F.when(own[places[n]] != other[places[n]], n).otherwise(out)
        return out

    same = reduce(lambda a, b: a & b, (own[i] == other[i] for i in range(SIDE, SIDE + GRAM)))
    return F.when(same, F.struct(run(list(range(SIDE - 1, -1, -1))).alias("left"), run(list(range(SIDE + GRAM, SPAN + SIDE))).alias("right")))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, text_hash, item_id, lo, hi: the spans of words of each document shared with an item.

    lo and hi are counted in words; spans of one document may overlap. Rows of equal text and doc_id are one.
    """
    low = lambda words: F.transform(words, ascii_lower)
    asked = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    grams = placed(fingerprints(asked), " ").select("fp", "item_id", F.col("own").alias("key"))
    whole = asked.filter(F.size("words") < SPAN)
    short = whole.select(F.xxhash64(low("words")).alias("fp"), "item_id", low("words").alias("key"))
    index = stash(grams.unionByName(short).distinct(), "benchgrams")
    lengths = sorted(r[0] for r in index.filter(F.size("key") < SPAN).select(F.size("key")).distinct().collect())  # under SPAN values
    keys = stash(index.select("fp", "key").distinct(), "benchkeys")
    small = keys.limit(BROADCAST + 1).count() <= BROADCAST
    own = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), words_of(F.col("text")).alias("words"))

    def listed(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(found.select("fp").distinct()), "fp", "left_semi") if small else rows

    def meet(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(found) if small else found, "fp")

    long = keys.filter(F.size("key") >= SPAN)
    met = meet(placed(listed(fingerprints(own), long), ""), long).withColumn("x", extended(F.col("own"), F.col("key")))
    out = met.filter(F.col("x.left") + F.col("x.right") >= SIDE).select("doc_id", "text_hash", "key", (F.col("at") - F.col("x.left")).alias("lo"), (F.col("at") + GRAM + F.col("x.right")).alias("hi"))
    for n in lengths:
        of_length = keys.filter(F.size("key") == n)
        rows = own.select("*", F.posexplode(F.slice("words", 1, F.greatest(F.size("words") - (n - 1), F.lit(0)))).alias("at", "_word"))
        rows = rows.withColumn("own", F.array(*(ascii_lower(F.get("words", F.col("at") + i)) for i in range(n)))).drop("words").withColumn("fp", F.xxhash64("own"))
        same = meet(listed(rows, of_length), of_length).filter("own = key")
        out = out.unionByName(same.select("doc_id", "text_hash", "key", F.col("at").alias("lo"), (F.col("at") + n).alias("hi")))
    spans = out.groupBy("doc_id", "text_hash", "key", "lo").agg(F.max("hi").alias("hi"))
    found = index.select("key", "item_id").distinct()
    return spans.join(F.broadcast(found) if small and found.limit(BROADCAST + 1).count() <= BROADCAST else found, "key").select("doc_id", "text_hash", "item_id", "lo", "hi")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> a row for each of docs: doc_id, n_words, n_hit, n_items, item_ids.

    n_hit counts the document's words inside any occurrence of a window; item_ids is the sorted array of the items with one (as strings). A null or
    wordless text has no words; an item without words never hits; one of a null id marks words but is not named; repeated items count once;
    repeated rows each get their row; other columns are ignored; empty tables give no rows, or no hits. A text is one row of one task, and its
    words are read in place, so long texts cost time and memory in proportion.
    """
    found = stash(hits(docs, items), "benchhits")
    by = ["doc_id", "text_hash"]
    spans = found.groupBy(*by, "lo").agg(F.max("hi").alias("hi"))
    before = F.max("hi").over(Window.partitionBy(*by).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(before, F.lit(0))), F.lit(0))
    marked = spans.withColumn("fresh", fresh).groupBy(*by).agg(F.sum("fresh").alias("n_hit"))
    named = found.select(*by, F.col("item_id").cast("string").alias("item")).filter("item is not null").distinct()
    named = named.groupBy(*by).agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    key = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    both = marked.join(named, key(marked, named), "left").select(marked["doc_id"], marked["text_hash"], "n_hit", "item_ids")
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(both, key(rows, both), "left").select(rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))
