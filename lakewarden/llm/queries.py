"""The operators' queries over the driver's tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import ann, audio, fim, hard_negatives, html_extract, language_id, mixing, ngram_join, packing, suffix_dedup, toxicity, url_filter, winnowing

#: Fixed values of the URL query: rules, and hosts whose every URL is listed.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LISTED = [f"{name}.example.{top}/" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, parts: int):
    """crc32 of doc_id as text modulo parts; a null doc_id is in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_evidence")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, listed = spark.createDataFrame(RULES, "rule string, verdict string"), spark.createDataFrame([(u,) for u in LISTED], "url string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules, listed).select("page_id", "host", "path", "rule", "verdict")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(lambda b: zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes()))

    return pieces.select("doc_id", "start", "length", crc("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chroma_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound, so each text's bytes are read as 8-bit samples: equal passages are equal sound. Queries: doc_ids divisible by 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("audio"))
    return audio.search(docs, "doc_id", F.col("doc_id") % 100 == 0, "audio", "u8")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    return language_id.predict_language(docs, docs.filter(~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_url_filter, op3_html_extract, op4_packing, op5_chroma_audio, op6_mixing, op7_language_id, op8_suffix_dedup, op9_ngram_join, op10_ann, op11_hard_negatives, op12_winnowing, op13_fill_in_middle)
    return {f.__name__: f for f in own}


OP2_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), e(key, rule, verdict) AS (VALUES {", ".join([f"('{r}', '{r}', '{v}')" for r, v in RULES] + [f"('{u}', NULL, 'block')" for u in LISTED])}
), parts AS (SELECT *, split_part(key, '/', 1) AS h, substr(key, length(split_part(key, '/', 1)) + 1) AS q FROM e),
m AS (
  SELECT p.page_id, p.host, p.path, x.rule, x.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY (x.rule IS NOT NULL) DESC, length(x.key) DESC NULLS LAST, x.key) AS i
  FROM p LEFT JOIN parts x ON (p.host = x.h OR ends_with(p.host, '.' || x.h)) AND starts_with(p.path, x.q)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE i = 1
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 OR words IS NULL THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' ')) END) AS own FROM w
), classes AS (SELECT min(doc_id) AS c, own FROM s WHERE len(own) > 0 GROUP BY list_sort(own), own
), x AS (SELECT c, len(own) AS n, unnest(own) AS sh FROM classes
), shared AS (SELECT a.c AS a, b.c AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.sh = b.sh AND a.c < b.c GROUP BY 1, 2
), e AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (n + m - k)
), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(node, seen) AS (SELECT c, c FROM classes UNION SELECT g.b, r.seen FROM r JOIN g ON g.a = r.node
), k AS (SELECT node, min(seen) AS comp FROM r GROUP BY 1
), d AS (SELECT s.doc_id, len(s.own) AS n, list_sort(s.own) AS own FROM s
), o AS (SELECT list_sort(own) AS own, min(c) AS c FROM classes GROUP BY 1
), ck AS (SELECT o.own, min(k.comp) AS comp FROM o JOIN classes ON list_sort(classes.own) = o.own JOIN k ON k.node = classes.c GROUP BY 1)
SELECT d.doc_id, d.n AS n_shingles, coalesce(ck.comp, d.doc_id) AS component_id FROM d LEFT JOIN ck ON ck.own = d.own AND d.n > 0
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), places AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM places
), own_places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (SELECT doc_id, i, p.n, item_id FROM own_places p JOIN windows ON windows.n = p.n AND windows.g = array_to_string(w[i:i + p.n - 1], ' ')
), marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked ON marked.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""

OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), []) AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(u) + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 AS h4 FROM t
), c AS (
  SELECT *, array_to_string(u[:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op9_ngram_join": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_winnowing": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
