"""More cleansing functions: labels, identifiers, phones, calendars, rounding, priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, SQL, accounts, load, transactions


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")


def label(c: Column) -> Column:
    """snake_case as Title Case."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def identifier(*parts: Column) -> Column:
    """A lasting id from the parts that are there, in lower case with dashes; without any, a hash of nothing, so repeats of a row agree."""
    words = F.concat_ws("-", *(F.nullif(slug(p), F.lit("")) for p in parts))
    return F.concat(F.when(words == "", "row").otherwise(words), F.lit("-"), F.substring(F.sha2(words, 256), 1, 8))


#: How genders are written, in lower case.
GENDERS = {"m": "Male", "male": "Male", "f": "Female", "female": "Female"}


def gender(c: Column) -> Column:
    """Male or Female; any other text as it is; null for an empty one."""
    word = F.lower(F.trim(c))
    known = F.coalesce(*(F.when(word == k, v) for k, v in GENDERS.items()))
    return F.coalesce(known, F.nullif(F.trim(c), F.lit("")))


def phones(c: Column) -> Column:
    """A list of phone numbers parted by commas or carets, trimmed, without empty ones."""
    each = F.transform(F.split(F.replace(c, F.lit("^"), F.lit(",")), ","), lambda x: F.trim(x))
    return F.array_join(F.filter(each, lambda x: x != ""), ", ")


def as_time(c: Column, with_time: bool = True) -> Column:
    """A date or time text in one form; null if it is none."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd HH:mm:ss" if with_time else "yyyy-MM-dd")


def bankers(c: Column, digits: int = 2) -> Column:
    """Rounded half to even, as Python's round on decimals."""
    return F.bround(c, digits)


@query("SELECT p_partkey AS id, regexp_replace(lower(trim(p_type)), '\\s+', '-', 'g') AS slug, regexp_replace(lower(trim(p_type)), '\\s+', '-', 'g') || '-' || substr(sha256(regexp_replace(lower(trim(p_type)), '\\s+', '-', 'g')), 1, 8) AS ident, left(p_name, 10) AS short FROM part")
def slugs_and_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), slug(F.col("p_type")).alias("slug"), identifier(F.col("p_type"), F.lit(" ")).alias("ident"), F.left(F.col("p_name"), F.lit(10)).alias("short"))


@query("SELECT event_id, array_to_string(list_transform(string_split(event_type || '_of_user', '_'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS label FROM events")
def column_labels(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", label(F.concat("event_type", F.lit("_of_user"))).alias("label"))


_GENDER = "CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN ' female' WHEN 2 THEN 'MALE' WHEN 3 THEN 'f' WHEN 4 THEN 'Other' ELSE '' END"


@query(f"SELECT c_custkey AS id, CASE lower(trim({_GENDER})) WHEN 'm' THEN 'Male' WHEN 'male' THEN 'Male' WHEN 'f' THEN 'Female' WHEN 'female' THEN 'Female' WHEN '' THEN NULL ELSE trim({_GENDER}) END AS gender FROM customer")
def gender_norm(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("M", " female", "MALE", "f", "Other", ""))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), gender(raw).alias("gender"))


@query("WITH r AS (SELECT c_custkey AS id, ', 0' || c_custkey || '^ ,^+44 ' || c_nationkey || ',' AS raw FROM customer) SELECT id, array_to_string(list_filter(list_transform(string_split(replace(raw, '^', ','), ','), lambda x: trim(x)), lambda x: x <> ''), ', ') AS phones FROM r")
def phone_list(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(", 0"), F.col("c_custkey").cast("string"), F.lit("^ ,^+44 "), F.col("c_nationkey").cast("string"), F.lit(","))
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), phones(raw).alias("phones"))


@query("WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'no time' END AS raw FROM events) SELECT event_id, strftime(TRY_CAST(raw AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at, strftime(TRY_CAST(raw AS TIMESTAMP), '%Y-%m-%d') AS day FROM r")
def coerced_times(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("no time")
    return load(spark, d, "events").select("event_id", as_time(raw).alias("at"), as_time(raw, False).alias("day"))


def work_days(first: Column, last: Column, holidays: Sequence[str] = ()) -> Column:
    """Days from first to last, both included, that are no Saturday, Sunday or holiday; by arithmetic on weeks, so no calendar is joined."""
    n = F.datediff(last, first) + 1
    start = F.weekday(first)
    rest = n % 7
    odd = sum(F.when((F.lit(i) < rest) & ((start + i) % 7 < 5), 1).otherwise(0) for i in range(6))
    off = sum((F.when(F.lit(h).cast("date").between(first, last) & (F.weekday(F.lit(h).cast("date")) < 5), 1).otherwise(0) for h in holidays), F.lit(0))
    return F.when(n > 0, (n - rest) / 7 * 5 + odd - off).otherwise(0).cast("int")


@query(SQL + "SELECT account_id, (SELECT count(*) FROM range(0, 61) t(i) WHERE opened + i::INT <= opened + (account_id % 60)::INT AND isodow(opened + i::INT) < 6 AND opened + i::INT NOT IN (DATE '1995-05-01', DATE '1996-12-25'))::INT AS days FROM acct")
def work_day_delta(spark: SparkSession, d: str) -> DataFrame:
    last = F.date_add("opened", (F.col("account_id") % 60).cast("int"))
    return accounts(spark, d).select("account_id", work_days(F.col("opened"), last, ["1995-05-01", "1996-12-25"]).alias("days"))


def priority(score: Column) -> Column:
    """4 to 0: critical, high, medium, low, none."""
    return F.when(score >= 90, 4).when(score >= 70, 3).when(score >= 40, 2).when(score > 0, 1).otherwise(0)


@query(SQL + f", s AS (SELECT account_id, CAST(least(sum(quantity), 100) AS DOUBLE) AS score FROM txn GROUP BY 1) SELECT account_id, score, CASE WHEN score >= 90 THEN 4 WHEN score >= 70 THEN 3 WHEN score >= 40 THEN 2 WHEN score > 0 THEN 1 ELSE 0 END AS priority, DATE '{AS_OF}' + CASE WHEN score >= 90 THEN 1 WHEN score >= 70 THEN 3 WHEN score >= 40 THEN 7 ELSE 30 END AS deadline FROM s")
def priority_and_deadline(spark: SparkSession, d: str) -> DataFrame:
    """Scores capped at a limit, their priority, and the day by which a case of it is due."""
    s = transactions(spark, d).groupBy("account_id").agg(F.least(F.sum("quantity"), F.lit(100.0)).alias("score")).withColumn("priority", priority(F.col("score")))
    days = F.element_at(F.array(*map(F.lit, (30, 30, 7, 3, 1))), F.col("priority") + 1)
    return s.withColumn("deadline", F.date_add(F.lit(AS_OF).cast("date"), days))


@query(SQL + "SELECT account_id, list_contains(list(state), 'F') AS any_f, bool_and(quantity > 5) AS all_above, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS q FROM txn GROUP BY 1")
def array_predicates(spark: SparkSession, d: str) -> DataFrame:
    """any and all over the values of a group, as partial aggregates: no group is gathered."""
    any_, all_ = F.bool_or(F.col("state") == "F").alias("any_f"), F.bool_and(F.col("quantity") > 5).alias("all_above")
    return transactions(spark, d).groupBy("account_id").agg(any_, all_, F.count("*").alias("n"), F.sum("quantity").alias("q"))


@query("SELECT event_id, regexp_full_match(v, '[0-9]+') AS digits, NOT regexp_full_match(v, '[0-9]+') AS no_digits, regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?') AS number, regexp_matches(v, '[^A-Za-z0-9 ]') AS special FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN '-' || user_id || '.5' WHEN 2 THEN event_type ELSE event_type || '!' END AS v FROM events)")
def regex_checks(spark: SparkSession, d: str) -> DataFrame:
    """Type checks of staged texts by pattern."""
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    v = F.when(k == 0, user).when(k == 1, F.concat(F.lit("-"), user, F.lit(".5"))).when(k == 2, F.col("event_type")).otherwise(F.concat("event_type", F.lit("!")))
    digits = F.col("v").rlike("^[0-9]+$")
    return load(spark, d, "events").select("event_id", v.alias("v")).select("event_id", digits.alias("digits"), (~digits).alias("no_digits"), F.col("v").rlike(r"^-?[0-9]+(\.[0-9]+)?$").alias("number"), F.col("v").rlike("[^A-Za-z0-9 ]").alias("special"))


@query("WITH e AS (SELECT event_id, json_object('a', json_object('b', json_object('c', event_type), 'k', json_extract(props, '$.k')), 'u', user_id) AS j FROM events) SELECT event_id, json_extract_string(j, '$.a.k') AS k, json_extract_string(j, '$.a.b.c') AS deep, json_extract_string(j, '$.a.x.c') AS nowhere FROM e")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Fields of an entity by dotted path; a path that leads nowhere is null."""
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    nested = F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("c")).alias("b"), k).alias("a"), F.col("user_id").alias("u")))
    return load(spark, d, "events").select("event_id", nested.alias("j")).select("event_id", dotted("j", "a.k").alias("k"), dotted("j", "a.b.c").alias("deep"), dotted("j", "a.x.c").alias("nowhere"))


def dotted(column: str, path: str) -> Column:
    return F.get_json_object(column, "$." + path)


def exposure(text: Column, name: Column, keywords: dict[str, float], excluded: Sequence[str], age: Column, most: float = 100.0) -> Column:
    """An article's risk: the scores of keywords that occur, times its recency, up to a limit; 0 unless the name occurs, or if an excluded term does."""
    low = F.lower(text)
    total = sum((F.when(low.contains(k.lower()), s).otherwise(0.0) for k, s in keywords.items()), F.lit(0.0))
    recency = F.when(age <= 30, 1.0).when(age <= 90, 0.8).when(age <= 365, 0.6).otherwise(0.4)
    barred = F.lit(False)
    for x in excluded:
        barred = barred | low.contains(x.lower())
    return F.when(low.contains(F.lower(name)) & ~barred, F.least(total * recency, F.lit(most))).otherwise(0.0)


@query("SELECT doc_id, CASE WHEN contains(lower(text), coalesce(lower(lang), 'die')) AND NOT contains(lower(text), 'license') THEN least(round((CASE WHEN contains(lower(text), 'the') THEN 50 ELSE 0 END + CASE WHEN contains(lower(text), 'an') THEN 90 ELSE 0 END) * CASE WHEN n_chars <= 30 THEN 1.0 WHEN n_chars <= 90 THEN 0.8 WHEN n_chars <= 365 THEN 0.6 ELSE 0.4 END::DOUBLE, 4), 100.0)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def media_exposure(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.round(exposure(F.col("text"), F.coalesce("lang", F.lit("die")), {"the": 50.0, "an": 90.0}, ["license"], F.col("n_chars")), 4).alias("score"))
