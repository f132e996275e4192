"""Imports of delivered rows: texts are mapped, filled, resolved, checked and told apart from those already there, and every row ends with one status and the reason for it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.plans.loads import defaulted
from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, branches, load

#: Forms of numbers in staged texts.
FORMS = {"integer": r"^-?[0-9]+$", "float": r"^-?[0-9]*\.?[0-9]*$"}
CASTS = {"integer": "int", "float": "double", "date": "date", "boolean": "boolean", "char": "string"}


@dataclass(frozen=True)
class Field:
    """A field of the target: the delivered column it comes from (None: it is not delivered), its kind, and the table that it points to, by (table, id, name)."""

    name: str
    source: str | None
    kind: str = "char"
    required: bool = False
    relation: tuple[DataFrame, str, str] | None = None


def resolved(rows: DataFrame, field: str, relation: tuple[DataFrame, str, str]) -> DataFrame:
    """rows whose text in `field` is the id of the row it names: by exact name, else by id, else by name in any case; what resolves to nothing stays. Of equal names the smallest id counts."""
    table, key, name = relation
    text, low = F.col(field), F.lower(F.col(field))
    digits = text.rlike("^[0-9]+$")
    by = {"_exact": (table.groupBy(F.col(name).alias("_k")).agg(F.min(key).alias("_exact")), text), "_id": (table.select(F.col(key).cast("string").alias("_k"), F.col(key).alias("_id")).distinct(), F.when(digits, F.regexp_replace(text, "^0+(?=.)", ""))), "_any": (table.groupBy(F.lower(name).alias("_k")).agg(F.min(key).alias("_any")), F.when(~digits, low))}
    for lookup, value in by.values():
        rows = rows.withColumn("_v", value).join(lookup, F.col("_v") == F.col("_k"), "left").drop("_k", "_v")
    return rows.withColumn(field, F.coalesce(*(F.col(c).cast("string") for c in by), text)).drop(*by)


def staged(rows: DataFrame, order: str, fields: Sequence[Field], existing: DataFrame, unique: Sequence[Sequence[str]], today: Column) -> DataFrame:
    """order, the fields as texts, status (success, duplicate or error) and error, of every delivered row; the first reason counts.

    Fields that are not delivered or are blank take their kind's default, required texts a filler. Unresolved relations, missing required numbers and numbers of another form are
    errors. Duplicates are told by unique_identifier if it is delivered, else by the shortest of the unique keys of which any field is: rows after the first of a key by `order`,
    then those whose key is in `existing`. A key with a null or blank tells nothing.
    """
    own = rows.select(order, *((F.trim(F.col(f.source)) if f.source else F.lit(None).cast("string")).alias(f.name) for f in fields))
    filled = {f.name: defaulted(F.col(f.name), f.kind, f.name, f.required, today) if f.kind in ("boolean", "date") or f.kind == "char" and f.required else F.nullif(F.col(f.name), F.lit("")) for f in fields}
    own = own.select(order, *(c.alias(n) for n, c in filled.items()))
    for f in fields:
        if f.relation:
            own = resolved(own, f.name, f.relation)
    reasons = [F.when(~F.col(f.name).rlike("^[0-9]+$"), F.concat(F.lit(f"Could not resolve relation for field {f.name}: "), F.col(f.name))) for f in fields if f.relation]
    reasons += [F.when(F.col(f.name).isNull(), F.lit(f"Invalid numeric value for required field: {f.name}")) for f in fields if f.required and f.kind in FORMS]
    reasons += [F.when(~F.col(f.name).rlike(FORMS[f.kind]), F.lit(f"Invalid {'integer' if f.kind == 'integer' else 'number'} for field {f.name}")) for f in fields if f.kind in FORMS and not f.relation]
    own = own.withColumn("_wrong", F.coalesce(*reasons) if reasons else F.lit(None).cast("string"))
    delivered = {f.name for f in fields if f.source}
    keys = [["unique_identifier"]] if "unique_identifier" in delivered else [k for u in unique if (k := [c for c in u if c in delivered])]
    if keys:
        key = min(keys, key=len)
        told = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & (F.col(c) != "") for c in key))
        first = own.filter(told).groupBy(*key).agg(F.min(order).alias("_first"))
        there = existing.select(*(F.col(c).cast("string").alias(c) for c in key)).distinct().withColumn("_there", F.lit(True))
        own = own.join(first, key, "left").join(there, key, "left")
        record = "unique_identifier" if key == ["unique_identifier"] else "record"
        again = F.when(F.col("_first") < F.col(order), f"Duplicate {record} in import batch").when(F.col("_there"), "Record with this unique_identifier already exists in database" if record != "record" else "Record already exists in database")
    else:
        again = F.lit(None).cast("string")
    status = F.when(F.col("_wrong").isNotNull(), "error").when(again.isNotNull(), "duplicate").otherwise("success")
    return own.select(order, *(f.name for f in fields), status.alias("status"), F.coalesce("_wrong", again).alias("error"))


def inserted(stage: DataFrame, fields: Sequence[Field], existing: DataFrame) -> DataFrame:
    """existing with the rows that passed, cast to their kinds."""
    new = stage.filter("status = 'success'").select(*(F.col(f.name).try_cast("bigint" if f.relation else CASTS[f.kind]).alias(f.name) for f in fields))
    return existing.unionByName(new, allowMissingColumns=True)


_RAW = """raw AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE ' ' || c_name END AS name, CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN CAST(n_nationkey AS VARCHAR) WHEN 2 THEN lower(n_name) WHEN 3 THEN 'nowhere' WHEN 4 THEN NULL ELSE '999' END AS branch,
CASE WHEN c_custkey % 10 = 0 THEN '12a' WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN '-.5' ELSE CAST(c_custkey % 40 AS VARCHAR) || '.25' END AS score, CASE WHEN c_custkey % 17 = 0 THEN 'many' WHEN c_custkey % 17 = 1 THEN NULL ELSE CAST(c_custkey % 9 AS VARCHAR) END AS visits,
CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'U' || CAST(c_custkey % 1000 AS VARCHAR) END AS uid FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {_RAW}, f AS (SELECT row_id, CASE WHEN trim(name) = '' THEN 'Required name' ELSE trim(name) END AS name, nullif(branch, '') AS branch, nullif(score, '') AS score, nullif(visits, '') AS visits, '{AS_OF}' AS since, uid AS unique_identifier FROM raw),
r AS (SELECT f.* EXCLUDE (branch), coalesce((SELECT CAST(min(n_nationkey) AS VARCHAR) FROM nation WHERE n_name = branch), (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE CAST(n_nationkey AS VARCHAR) = branch), (SELECT CAST(min(n_nationkey) AS VARCHAR) FROM nation WHERE lower(n_name) = lower(branch)), branch) AS branch_id FROM f),
w AS (SELECT *, CASE WHEN NOT regexp_full_match(branch_id, '[0-9]+') THEN 'Could not resolve relation for field branch_id: ' || branch_id WHEN visits IS NULL THEN 'Invalid numeric value for required field: visits' WHEN NOT regexp_full_match(score, '-?[0-9]*\\.?[0-9]*') THEN 'Invalid number for field score' WHEN NOT regexp_full_match(visits, '-?[0-9]+') THEN 'Invalid integer for field visits' END AS wrong,
CASE WHEN unique_identifier IS NOT NULL AND row_id > min(row_id) OVER (PARTITION BY unique_identifier) THEN 'Duplicate unique_identifier in import batch' WHEN unique_identifier IN (SELECT 'U' || CAST(s_suppkey * 7 AS VARCHAR) FROM supplier) THEN 'Record with this unique_identifier already exists in database' END AS again FROM r)
SELECT row_id, name, branch_id, score, visits, since, unique_identifier, CASE WHEN wrong IS NOT NULL THEN 'error' WHEN again IS NOT NULL THEN 'duplicate' ELSE 'success' END AS status, coalesce(wrong, again) AS error FROM w""")
def import_stage(spark: SparkSession, d: str) -> DataFrame:
    """Customers delivered as texts, through all steps of an import."""
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    ref = F.when(k % 6 == 0, F.col("n_name")).when(k % 6 == 1, F.col("n_nationkey").cast("string")).when(k % 6 == 2, F.lower("n_name")).when(k % 6 == 3, "nowhere").when(k % 6 == 5, "999")
    score = F.when(k % 10 == 0, "12a").when(k % 10 == 1, "").when(k % 10 == 2, "-.5").otherwise(F.concat((k % 40).cast("string"), F.lit(".25")))
    visits = F.when(k % 17 == 0, "many").when(k % 17 != 1, (k % 9).cast("string"))
    raw = c.select(k.alias("row_id"), F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name"))).alias("Name"), ref.alias("Branch"), score.alias("Score"), visits.alias("Visits"), F.when(k % 19 != 0, F.concat(F.lit("U"), (k % 1000).cast("string"))).alias("UID"))
    there = load(spark, d, "supplier").select(F.concat(F.lit("U"), (F.col("s_suppkey") * 7).cast("string")).alias("unique_identifier"))
    fields = [Field("name", "Name", "char", True), Field("branch_id", "Branch", relation=(branches(spark, d), "branch_id", "branch")), Field("score", "Score", "float"), Field("visits", "Visits", "integer", True), Field("since", None, "date"), Field("unique_identifier", "UID")]
    return staged(raw, "row_id", fields, there, [["name", "score"]], F.lit(AS_OF).cast("date"))
