"""Cleansing and text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import load

#: Date formats in the order in which they are tried.
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%d.%m.%Y", "%m.%d.%Y", "%Y.%m.%d", "%b %d, %Y", "%d %b %Y", "%B %d, %Y", "%d %B %Y")
#: Words of the four ways to read a boolean.
ACTIVE_TRUE = ("true", "yes", "y", "1", "active", "on")
ACTIVE_FALSE = ("false", "no", "n", "0", "inactive", "off")
LISTED_TRUE = ("true", "yes", "y", "1", "x", "on", "checked")
TYPED_TRUE = ("true", "t", "yes", "y", "1")
TYPED_FALSE = ("false", "f", "no", "n", "0")
_PARTS = {"%Y": ("yyyy", r"\d{4}"), "%m": ("M", r"\d{1,2}"), "%d": ("d", r"\d{1,2}"), "%b": ("MMM", "[A-Za-z]{3}"), "%B": ("MMMM", "[A-Za-z]{3,9}")}


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def strip_special(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\s.,;:?-]", "")


def escape_html(c: Column) -> Column:
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def parse_date(c: Column) -> Column:
    """The text as yyyy-MM-dd by the first of DATE_FORMATS that fits, of one or two digits; a year alone is its first day, a year and month the same with
    -01 after it; any other text stays as it is, without white space at its ends. Null and empty are null."""
    text = F.trim(c)
    tried = []
    for f in DATE_FORMATS:
        form, shape = f, f.replace(".", r"\.")
        for k, (letters, digits) in _PARTS.items():
            form, shape = form.replace(k, letters), shape.replace(k, digits)
        own = F.initcap(text) if "M" in form and "MMM" in form else text  # month names count in any case
        tried.append(F.when(text.rlike(f"^{shape}$"), F.date_format(F.try_to_timestamp(own, F.lit(form)), "yyyy-MM-dd")))
    year = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
    month = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.concat(text, F.lit("-01")))
    return F.nullif(F.coalesce(*tried, year, month, text), F.lit(""))


def bool_active(c: Column) -> Column:
    """A flag that is true unless it says false."""
    return ~F.coalesce(F.lower(F.trim(c)).isin(*ACTIVE_FALSE), F.lit(False))


def bool_listed(c: Column) -> Column:
    """True for the listed words, in any case but with no white space; else false."""
    return F.coalesce(F.lower(c).isin(*LISTED_TRUE), F.lit(False))


def bool_typed(c: Column) -> Column:
    """True, false, or null for any other text."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TYPED_TRUE), True).when(word.isin(*TYPED_FALSE), False)


def bool_quoted(c: Column) -> Column:
    """The value of a condition's text: true and false, perhaps in quotes, in any case; else null."""
    word = F.lower(F.btrim(F.trim(c), F.lit("'\"")))
    return F.when(word == "true", True).when(word == "false", False)


def integer_in(c: Column) -> Column:
    """The first integer in a text, else null."""
    return F.nullif(F.regexp_extract(c, r"(-?\d+)", 1), F.lit("")).try_cast("bigint")


def split_name(c: Column) -> tuple[Column, Column, Column]:
    """First, middle and last name; a single word has the last name Unknown."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    n = F.size(words)
    return F.try_element_at(words, F.lit(1)), F.when(n > 2, F.array_join(F.slice(words, 2, n - 2), " ")), F.when(n > 1, F.try_element_at(words, F.lit(-1))).otherwise("Unknown")


def emails(c: Column) -> Column:
    """A comma list, trimmed, without empties and repeats, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))), ", ")


def keyword_hits(text: Column, words: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """The number of words found between word boundaries, in any case; 0 if an excluded term occurs."""
    found = sum((F.when(text.rlike(rf"(?i)\b{w}\b"), 1).otherwise(0) for w in words), F.lit(0))
    if not excluded:
        return found
    return F.when(F.lower(text).rlike("|".join(x.lower() for x in excluded)), 0).otherwise(found)


def context(text: Column, word: str, around: int = 100) -> Column:
    """The word's first hit with `around` characters on either side; null without one."""
    at = F.regexp_instr(text, F.lit(rf"(?i)\b{word}\b"))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word))))


@query("SELECT doc_id, (CASE WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\bthis\\b') THEN 1 ELSE 0 END) AS hits FROM documents")
def kw_scan_boundary(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", keyword_hits(F.col("text"), ["the", "this"]).alias("hits"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 0 ELSE CASE WHEN regexp_matches(text, '(?i)\\bfrom\\b') THEN 1 ELSE 0 END END AS hits FROM documents")
def kw_scan_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", keyword_hits(F.col("text"), ["from"], ["license"]).alias("hits"))


@query("SELECT page_id, length(replace(replace(replace(replace(url, '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS n, replace(replace(replace(replace(url, '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS url FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.length(escape_html(F.col("url"))).alias("n"), escape_html(F.col("url")).alias("url"))


@query("SELECT conv_id, turn, nullif(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS text FROM conversations")
def ws_collapse(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").select("conv_id", "turn", clean(F.col("text")).alias("text"))


_FORMS = ("%Y-%m-%d", "%d/%m/%Y", "%m.%d.%Y", "%b %d, %Y", "%d %B %Y", "%Y", "%Y-%m", "soon %d")
_RAW = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_FORMS)) + " END"
_TRIED = ", ".join(f"try_strptime(raw, '{f}')" for f in DATE_FORMATS)


@query(f"WITH r AS (SELECT o_orderkey AS id, {_RAW} AS raw FROM orders) SELECT id, coalesce(strftime(coalesce({_TRIED}), '%Y-%m-%d'), CASE WHEN regexp_full_match(raw, '\\d{{4}}') THEN raw || '-01-01' WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{1,2}}') THEN raw || '-01' ELSE raw END) AS day FROM r")
def date_parse_multi(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in eight ways and read back; what is no date stays."""
    k, t = F.col("o_orderkey") % 8, F.col("o_orderdate")
    written = (F.date_format(t, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM.dd.yyyy", "MMM dd, yyyy", "dd MMMM yyyy", "yyyy", "yyyy-MM", "'soon' dd"))
    raw = F.coalesce(*(F.when(k == i, w) for i, w in enumerate(written)))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), parse_date(raw).alias("day"))


@query("SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS first, CASE WHEN len(string_split(p_type, ' ')) > 1 THEN list_extract(string_split(p_type, ' '), -1) ELSE 'Unknown' END AS last, CAST(regexp_extract(p_brand, '(-?\\d+)', 1) AS BIGINT) AS number FROM part")
def name_split(spark: SparkSession, d: str) -> DataFrame:
    first, _, last = split_name(F.col("p_type"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), first.alias("first"), last.alias("last"), integer_in(F.col("p_brand")).alias("number"))


_WORDS = (" Yes", "OFF", "x", "t", "maybe", '"True"', "", "inactive", "checked", "1")
_word_sql = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(
    f"""WITH r AS (SELECT event_type, list_extract([{_word_sql(_WORDS)[1:-1]}], CAST(event_id % 10 + 1 AS INT)) AS raw FROM events)
    SELECT event_type, raw, coalesce(NOT lower(trim(raw)) IN {_word_sql(ACTIVE_FALSE)}, true) AS active, coalesce(lower(raw) IN {_word_sql(LISTED_TRUE)}, false) AS listed,
      CASE WHEN lower(trim(raw)) IN {_word_sql(TYPED_TRUE)} THEN true WHEN lower(trim(raw)) IN {_word_sql(TYPED_FALSE)} THEN false END AS typed,
      CASE lower(trim(trim(raw), '"')) WHEN 'true' THEN true WHEN 'false' THEN false END AS quoted, count(*) AS n FROM r GROUP BY ALL"""
)
def bool_parse_variants(spark: SparkSession, d: str) -> DataFrame:
    """The four ways to read a boolean, on words of all kinds."""
    raw = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % 10 + 1).cast("int"))
    read = load(spark, d, "events").select("event_type", raw.alias("raw"))
    kinds = {"active": bool_active, "listed": bool_listed, "typed": bool_typed, "quoted": bool_quoted}
    return read.groupBy("event_type", "raw", *(f(F.col("raw")).alias(k) for k, f in kinds.items())).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, format('{:,.2f}', c_acctbal) AS amount FROM customer")
def number_format(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.format_number("c_acctbal", 2).alias("amount"))


@query("SELECT page_id, regexp_replace(url, '[^\\w\\s.,;:?-]', '', 'g') AS url FROM pages")
def strip_special_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", strip_special(F.col("url")).alias("url"))


def first_number(c: Column) -> Column:
    """The first number in a text, a comma read as a decimal point; null if there is none."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"(-?\d+\.?\d*)", 1), F.lit("")).try_cast("double")


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract(raw, '(-?\\d+)', 1), '') AS BIGINT) AS whole, TRY_CAST(nullif(regexp_extract(replace(raw, ',', '.'), '(-?\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS number FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN 'EUR -' || CAST(event_id AS VARCHAR) || ',25 due' ELSE event_type END AS raw FROM events)")
def numeric_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first integer and the first decimal of a text."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("EUR -"), F.col("event_id").cast("string"), F.lit(",25 due"))).otherwise(F.col("event_type"))
    return load(spark, d, "events").select("event_id", integer_in(raw).alias("whole"), first_number(raw).alias("number"))


@query("SELECT c_custkey, list_aggregate(list_sort(list_distinct(list_filter([trim(x) FOR x IN string_split(c_mktsegment || ', a@x.org,, ' || c_mktsegment || ' ,b@x.org', ',')], lambda x: x <> ''))), 'string_agg', ', ') AS emails FROM customer")
def email_list_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("c_mktsegment"), F.lit(", a@x.org,, "), F.col("c_mktsegment"), F.lit(" ,b@x.org"))
    return load(spark, d, "customer").select("c_custkey", emails(raw).alias("emails"))
