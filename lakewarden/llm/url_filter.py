"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

All expressions are DataFrame functions. A page asks for the few keys `host suffix + path prefix` whose shapes occur in the
list (numbers of host labels, lengths of paths), so an entry covers its host, all subdomains and every path that starts with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import ascii_lower, broadcast_if_small, stash

WORDS = 8  #: 32-bit words of a Bloom block; a key sets one bit in each
KEYS_PER_BLOCK = 12  #: about 21 bits a key: under 0.1 % false positives
BROADCAST_BLOCKS = 1_000_000  #: 40 MB; a larger filter, or list, is joined by a shuffle
BROADCAST_LIST = 200_000


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def canonical_host(host: Column) -> Column:
    """host without user part, port and trailing dots, A-Z lower-cased."""
    return ascii_lower(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:[0-9]*)?$", ""))


def canonical_path(path: Column) -> Column:
    """path, or / if it is empty."""
    return F.when(path == "", "/").otherwise(path)


def listed_key(url: Column) -> Column:
    """Canonical host and path of a listed URL, whose scheme may be missing; its query does not count. Null if it has no host."""
    full = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("://"), url))
    host = canonical_host(url_host(full))
    return F.when(host != "", F.concat(host, canonical_path(url_path(full))))


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, own, rule, verdict, labels, chars) of rules(rule, verdict), as they are (own), and listed(url), made canonical."""
    own = rules.select(F.col("rule").alias("key"), F.lit(True).alias("own"), F.col("rule"), F.col("verdict"))
    more = listed.select(listed_key(F.col("url")).alias("key"), F.lit(False).alias("own"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    host = F.substring_index("key", "/", 1)
    return (
        own.unionByName(more)
        .filter(F.col("key").isNotNull())
        .groupBy("key", "own")
        .agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"))
        .withColumn("labels", F.size(F.split(host, r"\.")))
        .withColumn("chars", F.length("key") - F.length(host))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row per occupied block: its number and its eight words."""
    masks = [m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))]
    return keys.select(_block(F.col("key"), blocks).alias("block"), *masks).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, bloom_hit.

    The longest fitting rule decides; without one, a listed URL blocks and any other is allowed. Rules fit the host and path as
    shown; listed URLs and pages are compared in canonical form (no user part, port or trailing dot, an empty path as /). Null or malformed URLs have
    empty host and path and are allowed; repeated rows each get their own row; other columns of pages are ignored; an empty
    table gives an empty result, an empty list allows all.
    """
    table = stash(entries(rules, listed), "urllist")
    n, labels, chars = table.agg(F.count("*"), F.collect_set("labels"), F.collect_set("chars")).first()
    own = pages.select("page_id", F.col("url").alias("_url")).select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    if not n:
        return own.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("bloom_hit"))
    blocks = -(-n // KEYS_PER_BLOCK)
    words = broadcast_if_small(stash(bloom(table, blocks), "urlbloom"), BROADCAST_BLOCKS)
    urls = own.select("host", "path").distinct()
    forms = F.array(
        F.struct(F.lit(True).alias("own"), F.col("host").alias("h"), F.col("path").alias("p")),
        F.struct(F.lit(False).alias("own"), canonical_host(F.col("host")).alias("h"), canonical_path(F.col("path")).alias("p")),
    )
    n_labels = F.size(F.split("h", r"\."))
    suffixes = F.array(*(F.when(n_labels >= k, F.substring_index("h", ".", -k)) for k in sorted(labels)))
    prefixes = F.array(*(F.when(F.length("p") >= k, F.substring("p", 1, k)) for k in sorted(chars)))
    keys = (
        urls.select("host", "path", F.inline(forms)).withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
        .select("host", "path", "own", F.concat("_suffix", "_prefix").alias("key")).filter(F.col("key").isNotNull())
        .withColumn("block", _block(F.col("key"), blocks))
    )
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) != 0)
    possible = keys.join(words, "block").filter(hit).select("host", "path", "own", "key")
    exact = broadcast_if_small(table.select("key", "own", "rule", "verdict"), BROADCAST_LIST)
    order = F.struct(F.col("rule").isNotNull(), F.length("key"), F.col("key"))
    found = possible.join(exact, ["key", "own"], "left").groupBy("host", "path").agg(F.max_by(F.col("rule"), F.when(F.col("verdict").isNotNull(), order)).alias("rule"), F.max_by(F.col("verdict"), F.when(F.col("verdict").isNotNull(), order)).alias("verdict"), F.lit(True).alias("bloom_hit"))
    return own.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("bloom_hit", F.lit(False)).alias("bloom_hit"))
