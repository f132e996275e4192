"""The corpus pipeline: toxic documents go, near duplicates go, repeated passages go, sources are mixed, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and all that the stage before kept, and returns the columns of documents; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from lakewarden.llm.common import WORD, broadcast_if_small, drop, drop_since, mark, stash, text_hash
from lakewarden.llm.queries import fold, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the score is learned as in the toxicity query. Every row is judged by its own text, whatever its doc_id."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    return toxicity.score_toxicity(docs, labels, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays (null last; of one doc_id, that of the smallest text hash, and of
    equal texts the row of the smallest lang, source and n_chars); documents without words are no group and all stay.
    """
    place = mark()
    found = stash(ngram_join.similar_documents(docs).filter("component is not null"), "groups")
    drop_since(place, found)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = found.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("text_hash"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = kept.withColumn("first", F.lit(1))
    told = rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_hash"] == kept["text_hash"]), "left").select(rows["doc_id"].alias("_id"), rows["text_hash"].alias("_hash"), "n", F.coalesce("first", F.lit(0)).alias("first"))
    told = stash(told.filter("first = 0 or n > 1"), "told")  # rows to drop, and those to keep once
    drop(found)
    keyed = docs.select(*COLUMNS, text_hash(F.col("text")).alias("_th"))
    same = keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["_th"] == F.col("_hash"))
    out = keyed.join(broadcast_if_small(told.select("_id", "_hash"), ngram_join.BROADCAST), same, "left_anti").select(*COLUMNS)
    again = keyed.join(broadcast_if_small(told.filter("first = 1").select("_id", "_hash"), ngram_join.BROADCAST), same, "left_semi")
    once = again.groupBy("doc_id", "_th").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return out.unionByName(once.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text loses the bytes that repeated passages cover; a code point cut in two goes as a whole. Documents left without text go; those that
    had none stay. Every row keeps its own text: rows alike in doc_id are told apart by their texts.
    """
    cut = suffix_dedup.dedup(docs, ("doc_id", "lang", "source", "n_chars"), whole_characters=True)
    whole = F.size("removed") == 0
    out = cut.withColumn("_text", F.col("kept").cast("string")).filter(whole | (F.length("_text") > 0))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length("_text").cast("long"))
    return out.select("doc_id", F.col("_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document becomes the words that the mix takes of it, in order, a second epoch after the first; those not taken go, and so do
    texts without words. Rows are found again by doc_id, source and text, null or not, and equal rows by their number among themselves.
    """
    keys = ["doc_id", "source", "text_hash"]
    pieces = mixing.mix(docs).filter("words > 0")
    own = pieces.groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("epoch", "at", "words"))).alias("_parts"))
    own = own.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("start")))
    rows = docs.select(*COLUMNS, text_hash(F.col("text")).alias("text_hash"), mixing.n_words(F.col("text")).alias("_n"))
    rows = rows.filter("_n > 0").withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("lang", "n_chars")))
    same = rows["doc_id"].eqNullSafe(own["doc_id"]) & rows["source"].eqNullSafe(own["source"]) & (rows["text_hash"] == own["text_hash"]) & (rows["_i"] == own["_i"])
    words = rows.join(own, same).select(rows["doc_id"], "lang", rows["source"], F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("_words"), "_parts")
    joined = lambda w: F.array_join(F.transform("_parts", lambda p: F.array_join(F.slice(w, (p["at"] + 1).cast("int"), p["words"].cast("int")), " ")), " ")
    out = words.withColumn("text", F.transform(F.array("_words"), joined)[0])  # a variable of a lambda, so that a text is split once and not for each part
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids; every row is a document of its own, with its doc_id, null or not."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("ngram_join", one_of_each), ("suffix_dedup", cut_repeats), ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
