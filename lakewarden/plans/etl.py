"""Change detection, merge, staging validation and paging for table-to-table loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, load


def fingerprint(columns: Sequence[str], trimmed: bool = False) -> Column:
    """sha256 of a row as JSON text: its values as text by column name in order; null is no text, and no value runs into its neighbour."""
    text = lambda c: F.trim(F.col(c).cast("string")) if trimmed else F.col(c).cast("string")
    return F.sha2(F.to_json(F.struct(*(text(c).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def project(source: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """source's columns under their target names; mapped columns that the source lacks are left out, names match in any case."""
    have = {c.lower(): c for c in source.columns}
    return source.select(*(F.col(have[s.lower()]).alias(t) for s, t in mapping.items() if s.lower() in have))


def classify(source: DataFrame, target: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """source with op: new, updated or unchanged against target, by row hash. Of repeated keys the last by `order` counts. One full join on the keys; deletes aren't told."""
    values = [c for c in source.columns if c not in keys]
    if order:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        source = source.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")
    old = target.select(*keys, fingerprint(values).alias("_old"))
    both = source.withColumn("_new", fingerprint(values)).join(old, list(keys), "left")
    return both.withColumn("op", F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("_new"), "updated").otherwise("unchanged")).drop("_old", "_new")


def last_of_key(source: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by `order`, then the largest."""
    by = [*order, *(c for c in source.columns if c not in (*keys, *order))]
    if not by:
        return source.dropDuplicates(list(keys))
    return source.groupBy(*keys).agg(F.max(F.struct(*by)).alias("_last")).select(*keys, "_last.*").select(*source.columns)


def merge(source: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The upsert of source into target: its rows, of a repeated key the last by `order` (then the largest), and target's rows of other keys."""
    source = last_of_key(source, keys, order)
    return source.unionByName(target.join(source.select(*keys), list(keys), "left_anti"))


def key_pages(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page after a key: a sorted top-k, never a skip over earlier pages."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


_CDC = """WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS state, o_orderpriority AS product FROM orders WHERE o_orderstatus <> 'P'),
src AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS state, o_orderpriority AS product FROM orders WHERE o_orderpriority <> '5-LOW')"""


def _cdc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in for a delivery and the table it goes to: orders but those of low priority, some changed, and orders but those in process."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("product"), "o_totalprice")
    changed = F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("state"))
    return o.filter("product <> '5-LOW'").select("id", changed.alias("state"), "product"), o.filter("state <> 'P'").select("id", "state", "product")


@query(_CDC + " SELECT src.id, CASE WHEN old.id IS NULL THEN 'new' WHEN src.state IS DISTINCT FROM old.state OR src.product IS DISTINCT FROM old.product THEN 'updated' ELSE 'unchanged' END AS op FROM src LEFT JOIN old USING (id)")
def cdc_classify(spark: SparkSession, d: str) -> DataFrame:
    return classify(*_cdc(spark, d), ["id"]).select("id", "op")


@query(_CDC + " SELECT id, state, product FROM src UNION ALL SELECT id, state, product FROM old WHERE id NOT IN (SELECT id FROM src)")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return merge(*_cdc(spark, d), ["id"])


@query("SELECT o_orderkey AS id, sha256(CAST(to_json({'o_orderkey': CAST(o_orderkey AS VARCHAR), 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}) AS VARCHAR)) AS hash FROM orders")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), fingerprint(["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("hash"))


@query(SQL + "SELECT account_id FROM acct WHERE account_id > 1000 ORDER BY account_id LIMIT 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return key_pages(accounts(spark, d).select("account_id"), "account_id", 1000, 100)


@query(SQL + "SELECT account_id FROM acct ORDER BY balance DESC, account_id LIMIT 100 OFFSET 200")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return accounts(spark, d).orderBy(F.desc("balance"), "account_id").offset(200).limit(100).select("account_id")


@query("""WITH raw AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 7 = 1 THEN 'x12' WHEN l_linenumber % 7 = 2 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity, CASE WHEN l_linenumber % 7 = 3 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)
SELECT k, n, CASE WHEN flag IS NULL THEN 'error: flag is required' WHEN quantity <> '' AND TRY_CAST(quantity AS INT) IS NULL THEN 'error: quantity is no integer' WHEN row_number() OVER (PARTITION BY k, flag ORDER BY n) > 1 THEN 'duplicate' ELSE 'success' END AS status FROM raw""")
def validate_stage_status(spark: SparkSession, d: str) -> DataFrame:
    """Staged text rows cast, required and de-duplicated into one status each."""
    n = F.col("l_linenumber") % 7
    text = F.when(n == 1, "x12").when(n == 2, "").otherwise(F.col("l_quantity").cast("int").cast("string"))
    raw = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), text.alias("quantity"), F.when(n != 3, F.col("l_returnflag")).alias("flag"))
    twice = F.row_number().over(Window.partitionBy("k", "flag").orderBy("n")) > 1
    status = F.when(F.col("flag").isNull(), "error: flag is required").when((F.col("quantity") != "") & F.col("quantity").try_cast("int").isNull(), "error: quantity is no integer").when(twice, "duplicate").otherwise("success")
    return raw.select("k", "n", status.alias("status"))
