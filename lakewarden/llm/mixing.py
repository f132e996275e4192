"""Mixing sources to target weights, with DataFrame functions alone.

Each source's documents, in a fixed order, are one stream of words, cut into blocks of fixed length. A source owes its target
in words; every slot of BLOCK words it owes is dealt to an output shard by a hash, so the source counts of a shard are a
multinomial draw whose totals are the targets. A slot's number goes through the source's pseudorandom permutation
(swap-or-not rounds) to a block number, and blocks are joined by that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import WORD, buckets_for, running_total, stash, text_hash

BLOCK = 64  #: words in a block
SHARD_SLOTS = 4096  #: slots of an output shard, on average
WEIGHTS = (5, 2, 1)
TOTAL = 1.5  #: words of the mix by words of the input
MOST = 2  #: epochs of a source at most
ROUNDS = 8
CHUNK = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) -> with target: TOTAL of all words by weight, no source above MOST times its size.

    A source is full if its cap is under its share once those of smaller cap by weight are full; the others share the rest.
    The windows see one row per source.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("_i") % len(WEIGHTS) + 1).cast("int"))
    caps = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(MOST)).withColumn("_all", F.sum("source_size").over(every) * TOTAL)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    full = caps.withColumn("_full", F.col("_cap") <= left * F.col("_w"))
    rest = F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every)
    share = F.when(F.col("_full") | (open_w == 0), F.col("_cap")).otherwise(F.least(F.col("_w") * rest / F.nullif(open_w, F.lit(0.0)), F.col("_cap")))
    return full.select("source", "source_size", share.alias("target"))


def permuted(index: str, size: str, *key: str) -> Column:
    """index, a number under size, sent through a permutation of all numbers under size that key picks."""
    k = ", ".join(key)
    step = f"""aggregate(sequence(0, {ROUNDS - 1}), cast({index} as bigint), (x, r) ->
        if(xxhash64({k}, r, greatest(x, (pmod(xxhash64({k}, r), {size}) - x + {size}) % {size})) & 1 = 1,
           (pmod(xxhash64({k}, r), {size}) - x + {size}) % {size}, x))"""
    return F.when(F.col(size) > 0, F.expr(step.replace(size, f"greatest({size}, 1L)"))).otherwise(F.lit(0))


def streams(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, source) -> rows (doc_id, source, text_hash, size, start in the source's stream), and targets by source."""
    sized = stash(docs.select("doc_id", "source", text_hash(F.col("text")).alias("text_hash"), n_words(F.col("text")).alias("size")), "mixsizes")
    per = stash(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mixtargets")
    b = buckets_for(sized.count())
    rows = sized.withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), F.lit(b)).cast("int"))
    base = running_total(rows, "_src", "_bucket", "size", "_base")
    w = Window.partitionBy("_src", "_bucket").orderBy("doc_id", "size", "text_hash")
    inside = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    starts = rows.withColumn("_in", inside).join(base, ["_src", "_bucket"]).withColumn("start", F.col("_base") + F.col("_in"))
    return starts.select("doc_id", "source", "_src", "text_hash", "size", "start"), per.withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))


def slots(per: DataFrame, seed: int = 11) -> DataFrame:
    """Every slot of the mix: _src, shard, epoch, block, want (words wanted of the block)."""
    total = per.agg(F.sum(F.ceil(F.col("target") / BLOCK))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_SLOTS))
    own = (
        per.filter("source_size > 0").withColumn("_words", F.round("target").cast("long"))
        .withColumn("_full", F.expr(f"source_size div {BLOCK}")).withColumn("_n", F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}"))
        .withColumn("_epochs", F.expr("_words div source_size")).withColumn("_part", F.expr("_words % source_size"))
        .withColumn("_slots", F.expr(f"_epochs * _n + (_part + {BLOCK - 1}) div {BLOCK}")).filter("_slots > 0")
        .withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_slots - 1) div {CHUNK})")))
        .repartition(max(8, -(-int(total) // (8 * CHUNK))), "_src", "_chunk")
        .withColumn("slot", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least((_chunk + 1) * {CHUNK}, _slots) - 1)")))
        .withColumn("epoch", F.expr("slot div _n")).withColumn("_idx", F.expr("slot % _n"))
    )
    block = F.when(F.col("_idx") < F.col("_full"), permuted("_idx", "_full", str(seed), "_src", "epoch")).otherwise(F.col("_idx"))
    want = F.when(F.col("epoch") < F.col("_epochs"), F.lit(BLOCK)).otherwise(F.least(F.lit(BLOCK), F.col("_part") - F.col("_idx") * BLOCK))
    return own.select("_src", F.expr(f"pmod(xxhash64({seed}, _src, slot), {shards})").alias("shard"), "epoch", block.cast("long").alias("block"), want.cast("long").alias("want"))


def mix(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> the mix, one row for each piece of a document in a slot: doc_id, source, text_hash, size, start
    (of the document in its source's stream), source_size, target, shard, epoch, block, at (word of the document where the
    piece begins) and words. Documents of which the mix takes nothing have one row with words 0.

    Null or empty texts have size 0 and are never taken; a null source is a source of its own; repeated rows are documents of
    their own; other columns are ignored; an empty table gives an empty result. Every source gives round(target) words exactly.
    """
    rows, per = streams(docs)
    pieces = rows.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(start div {BLOCK}, (start + size - 1) div {BLOCK}), cast(null as array<bigint>))")))
    joined = pieces.join(slots(per).hint("merge"), ["_src", "block"], "left")
    lo = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    hi = F.least(F.col("start") + F.col("size") - F.col("block") * BLOCK, F.coalesce("want", F.lit(0)))
    rest = per.select("_src", "source_size", "target")
    return joined.select("doc_id", "source", "_src", "text_hash", "size", "start", "shard", "epoch", "block", (F.col("block") * BLOCK + lo - F.col("start")).alias("at"), F.greatest(hi - lo, F.lit(0)).alias("words")).join(rest, "_src")


def taken(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    keys = ["_src", "start", "doc_id", "size", "source_size", "target"]
    zero = "_copies"  # empty documents share a start, so their repeats are counted
    found = mix(docs).groupBy(*keys).agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.count("*").alias(zero))
    each = found.withColumn("_i", F.explode(F.expr(f"sequence(1L, if(size = 0, {zero}, 1L))")))
    return each.select("doc_id", "size", "source_size", "target", "taken")
