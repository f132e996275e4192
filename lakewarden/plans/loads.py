"""Writes as table-to-table steps: insert-ignore, merge statistics, updates by id, archive, refresh, views, audit, staging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.plans.etl import fingerprint, last_of_key
from lakewarden.registry import query
from lakewarden.sources.tables import AS_OF, SQL, accounts, customers, load

_OLD = SQL + ", old AS (SELECT account_id AS id, state, product FROM acct WHERE state <> 'P'), src AS (SELECT account_id AS id, CASE WHEN balance > 200000 THEN 'X' ELSE state END AS state, product FROM acct WHERE product <> '5-LOW')"


def _old_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in for a table and a delivery to it: accounts that are not in process, and those that are not of low priority, some of them changed."""
    a = accounts(spark, d).withColumnRenamed("account_id", "id")
    old = a.filter("state <> 'P'").select("id", "state", "product")
    return old, a.filter("product <> '5-LOW'").select("id", F.when(F.col("balance") > 200000, "X").otherwise(F.col("state")).alias("state"), "product")


def insert_ignore(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """source's rows with status: success for the first of a new key, duplicate for those whose key target has, or that a smaller row of source has."""
    rest = [c for c in source.columns if c not in keys]
    first = source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
    have = target.select(*keys).distinct().withColumn("_have", F.lit(True))
    rows = source.groupBy(*source.columns).agg(F.count("*").alias("_n")).join(first, list(keys)).join(have, list(keys), "left")
    fresh = F.col("_have").isNull() & (F.struct(*rest) == F.col("_first"))
    statuses = F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda i: F.when(fresh & (i == 1), "success").otherwise("duplicate"))
    return rows.select(*source.columns, F.explode(statuses).alias("status"))


@query(_OLD + " SELECT id, state, product, CASE WHEN id IN (SELECT id FROM old) THEN 'duplicate' ELSE 'success' END AS status FROM src")
def insert_ignore_status(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_and_new(spark, d)
    return insert_ignore(new, old, ["id"])


def merge_statistics(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys a merge of source inserts, updates and leaves as they are."""
    values = [c for c in source.columns if c not in keys]
    new = last_of_key(source, keys).select(*keys, fingerprint(values).alias("_new"))
    both = new.join(target.select(*keys, fingerprint(values).alias("_old")), list(keys), "left")
    return both.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old") != F.col("_new")).alias("updated"), F.count_if(F.col("_old") == F.col("_new")).alias("unchanged"))


@query(_OLD + " SELECT count(*) FILTER (WHERE old.id IS NULL) AS inserted, count(*) FILTER (WHERE old.id IS NOT NULL AND src.state <> old.state) AS updated, count(*) FILTER (WHERE src.state = old.state) AS unchanged FROM src LEFT JOIN old USING (id)")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_and_new(spark, d)
    return merge_statistics(new, old, ["id"])


@query(_OLD + " SELECT id, coalesce(src.state, old.state) AS state, coalesce(src.product, old.product) AS product, CASE WHEN old.id IS NULL THEN 'INSERT' WHEN src.id IS NULL THEN 'KEEP' ELSE 'UPDATE' END AS action FROM old FULL JOIN src USING (id)")
def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    """A merge with the action that each row came by: one full join, no read before the write."""
    old, new = _old_and_new(spark, d)
    both = old.withColumn("_o", F.lit(1)).alias("o").join(new.withColumn("_n", F.lit(1)).alias("n"), "id", "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select("id", pick("state"), pick("product"), F.when(F.col("_o").isNull(), "INSERT").when(F.col("_n").isNull(), "KEEP").otherwise("UPDATE").alias("action"))


def update_by_id(target: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """target with the columns of values(key, ...) in place of its own, where values has the key; a null there is a value."""
    own = [c for c in values.columns if c != key]
    new = last_of_key(values, [key]).select(key, F.struct(*own).alias("_new"))
    joined = target.join(new, key, "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in target.columns))


@query(SQL + "SELECT customer_id, CAST(CASE WHEN n.m IS NOT NULL THEN n.m ELSE score END AS DOUBLE) AS score FROM cust LEFT JOIN (SELECT customer_id, max(balance) AS m FROM acct WHERE state = 'F' GROUP BY 1) n USING (customer_id)")
def bulk_update_scores(spark: SparkSession, d: str) -> DataFrame:
    values = accounts(spark, d).filter("state = 'F'").groupBy("customer_id").agg(F.max("balance").alias("score"))
    return update_by_id(customers(spark, d).select("customer_id", "score"), values, "customer_id").withColumn("score", F.col("score").cast("double"))


@query(SQL + "SELECT account_id, CASE WHEN state = 'F' AND opened < DATE '1995-01-01' THEN 'archived' ELSE state END AS state FROM acct WHERE NOT (state = 'O' AND balance < 50000)")
def batch_update_delete(spark: SparkSession, d: str) -> DataFrame:
    """A delete by predicate and an update by another, in one pass over the table."""
    kept = accounts(spark, d).filter(~F.coalesce(F.expr("state = 'O' and balance < 50000"), F.lit(False)))
    return kept.select("account_id", F.when(F.expr("state = 'F' and opened < date '1995-01-01'"), "archived").otherwise(F.col("state")).alias("state"))


def archive(target: DataFrame, identifiers: DataFrame, key: str) -> DataFrame:
    """target with active false where identifiers(key) has the row's trimmed key; a null or empty one archives nothing."""
    gone = identifiers.select(F.trim(F.col(key).cast("string")).alias("_k")).filter("_k <> ''").distinct().withColumn("_gone", F.lit(True))
    return target.join(gone, F.trim(F.col(key).cast("string")) == F.col("_k"), "left").withColumn("active", F.col("_gone").isNull()).drop("_k", "_gone")


@query(SQL + "SELECT customer_id, customer_id NOT IN (SELECT customer_id FROM acct WHERE balance > 400000) AS active FROM cust")
def archive_customers(spark: SparkSession, d: str) -> DataFrame:
    listed = accounts(spark, d).filter("balance > 400000").select(F.concat(F.lit(" "), F.col("customer_id").cast("string")).alias("customer_id"))
    return archive(customers(spark, d).select("customer_id"), listed, "customer_id")


def refreshed(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An aggregate after delete and insert: fresh groups, and stored ones of no fresh key."""
    return fresh.select(stored.columns).unionByName(stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").select(stored.columns))


@query(SQL + "SELECT sector, branch_id, count(*) AS n FROM cust WHERE branch_id < 10 GROUP BY ALL UNION ALL SELECT sector, branch_id, 0 FROM cust WHERE branch_id >= 10 GROUP BY ALL")
def refresh_aggregate(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    stored = c.groupBy("sector", "branch_id").agg(F.lit(0).cast("long").alias("n"))
    return refreshed(stored, c.filter("branch_id < 10").groupBy("sector", "branch_id").agg(F.count("*").alias("n")), ["sector", "branch_id"])


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a stored view."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    made = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(v for v in made if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/_SUCCESS")))


def stored_view(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a stored view."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def user_view(spark: SparkSession, name: str, sql: str, views: dict[str, DataFrame], path: str | None = None) -> DataFrame:
    """A view from a checked user query. With a path it is stored: each call writes a new version beside the last one, which readers keep until the new one is whole; older ones go."""
    from lakewarden.plans.secure import run_user_query

    df = run_user_query(spark, sql, views)
    if path:
        before = versions(spark, path)
        df.write.parquet(f"{path}/v={before[-1] + 1 if before else 0}")
        df = stored_view(spark, path)
        for v in before[:-1]:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    df.createOrReplaceTempView(name)
    return df


@query(SQL + "SELECT sector, count(*) AS x_n, CAST(max(score) AS DOUBLE) AS x_top FROM cust GROUP BY 1")
def bi_view(spark: SparkSession, d: str) -> DataFrame:
    return user_view(spark, "x_by_sector", "SELECT sector, count(*) AS x_n, CAST(max(score) AS DOUBLE) AS x_top FROM bi_customer GROUP BY sector", {"bi_customer": customers(spark, d)})


def audit(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every changed value between two versions: keys, field, old and new value as text, op (insert, update, delete). A row that comes or goes tells all its fields, null or not."""
    fields = [c for c in old.columns if c not in keys and c in new.columns]
    packed = lambda df, name: df.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) for c in fields)).alias(name))
    both = packed(old, "_o").join(packed(new, "_n"), list(keys), "full")
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("update")
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col("_o")[c].alias("old_value"), F.col("_n")[c].alias("new_value")) for c in fields))
    return both.select(*keys, op.alias("op"), F.inline(each)).filter((F.col("op") != "update") | ~F.col("old_value").eqNullSafe(F.col("new_value")))


@query(_OLD + """, f AS (SELECT id, old.id IS NULL AS i, src.id IS NULL AS x, old.state AS s0, src.state AS s1, old.product AS p0, src.product AS p1 FROM old FULL JOIN src USING (id)),
e AS (SELECT id, i, x, 'state' AS field, s0 AS old_value, s1 AS new_value FROM f UNION ALL SELECT id, i, x, 'product', p0, p1 FROM f)
SELECT id, CASE WHEN i THEN 'insert' WHEN x THEN 'delete' ELSE 'update' END AS op, field, old_value, new_value FROM e WHERE i OR x OR old_value IS DISTINCT FROM new_value""")
def audit_changes(spark: SparkSession, d: str) -> DataFrame:
    return audit(*_old_and_new(spark, d), ["id"])


#: What a missing value of a type becomes.
DEFAULTS = {"boolean": "false", "date": "today", "char": "", "integer": "0", "float": "0.0"}


def defaulted(c: Column, kind: str, name: str, required: bool, today: Column) -> Column:
    """A staged text, or the default of its kind where it is null or blank; a required text becomes `Required name`."""
    filler = F.lit(f"Required {name}") if required and kind == "char" else today.cast("string") if kind == "date" else F.lit(DEFAULTS[kind])
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), filler)


def coerced(c: Column, kind: str) -> tuple[Column, Column]:
    """A staged text as a value of its kind, and its error: null, or why the text is none. A whole number out of range is kept as text by its caller."""
    shape = {"integer": r"^[+-]?\d+$", "float": r"^[+-]?\d+([.,]\d+)?$", "date": r"^\d{4}-\d\d-\d\d$"}.get(kind)
    type_ = {"integer": "int", "float": "double", "date": "date"}.get(kind, "string")
    value = (F.replace(c, F.lit(","), F.lit(".")) if kind == "float" else c).try_cast(type_)
    wrong = F.when(~c.rlike(shape), f"no {kind}").when(value.isNull(), f"{kind} out of range") if shape else F.lit(None).cast("string")
    return value, wrong


_DIRTY = "SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber WHEN 1 THEN '99999999999' WHEN 2 THEN ' ' WHEN 3 THEN '12x' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS quantity, CASE WHEN l_linenumber = 4 THEN '1,5' WHEN l_linenumber = 5 THEN 'free' ELSE CAST(l_linenumber AS VARCHAR) || '.25' END AS price, CASE WHEN l_returnflag = 'N' THEN l_returnflag END AS flag, CASE WHEN l_linestatus = 'F' THEN '1996-02-30' ELSE '' END AS day FROM lineitem"


@query(f"""WITH r AS ({_DIRTY}), v AS (SELECT k, n, coalesce(nullif(trim(quantity), ''), '0') AS quantity, coalesce(nullif(trim(price), ''), '0.0') AS price, coalesce(nullif(trim(flag), ''), 'Required flag') AS flag, coalesce(nullif(trim(day), ''), '{AS_OF}') AS day FROM r)
SELECT k, n, flag, TRY_CAST(quantity AS INT) AS quantity, CASE WHEN TRY_CAST(quantity AS INT) IS NULL AND regexp_full_match(quantity, '[+-]?\\d+') THEN quantity END AS quantity_text, TRY_CAST(replace(price, ',', '.') AS DOUBLE) AS price, TRY_CAST(day AS DATE) AS day,
concat_ws('; ', CASE WHEN NOT regexp_full_match(quantity, '[+-]?\\d+') THEN 'quantity: no integer' WHEN TRY_CAST(quantity AS INT) IS NULL THEN 'quantity: integer out of range' END, CASE WHEN NOT regexp_full_match(price, '[+-]?\\d+([.,]\\d+)?') THEN 'price: no float' END, CASE WHEN TRY_CAST(day AS DATE) IS NULL THEN 'day: date out of range' END) AS errors FROM v""")
def staged_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Staged texts with defaults and required fillers, cast by kind; a failed cell is null and told, its row stays, and too large a number keeps its text."""
    n = F.col("l_linenumber")
    q = F.when(n == 1, "99999999999").when(n == 2, " ").when(n == 3, "12x").otherwise(F.col("l_quantity").cast("int").cast("string"))
    price = F.when(n == 4, "1,5").when(n == 5, "free").otherwise(F.concat(n.cast("string"), F.lit(".25")))
    raw = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), q.alias("quantity"), price.alias("price"), F.when(F.col("l_returnflag") == "N", "N").alias("flag"), F.when(F.col("l_linestatus") == "F", "1996-02-30").otherwise("").alias("day"))
    kinds = {"quantity": "integer", "price": "float", "flag": "char", "day": "date"}
    today = F.lit(AS_OF).cast("date")
    full = raw.select("k", "n", *(defaulted(F.col(c), kind, c, True, today).alias(c) for c, kind in kinds.items()))
    values = {c: coerced(F.col(c), kind) for c, kind in kinds.items()}
    errors = F.concat_ws("; ", *(F.when(wrong.isNotNull(), F.concat(F.lit(f"{c}: "), wrong)) for c, (_, wrong) in values.items()))
    large = F.when(values["quantity"][1].endswith("range"), F.col("quantity")).alias("quantity_text")
    return full.select("k", "n", "flag", values["quantity"][0].alias("quantity"), large, values["price"][0].alias("price"), values["day"][0].alias("day"), errors.alias("errors"))


def fresh_rows(new: DataFrame, existing: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """New rows that agree with no existing row in any of several composite keys: an anti-join for each, no join on a disjunction."""
    return reduce(lambda df, k: df.join(existing.select(*k).distinct(), list(k), "left_anti"), keys, new)


@query(SQL + "SELECT account_id FROM acct a WHERE NOT EXISTS (SELECT 1 FROM acct b WHERE b.state = 'P' AND (b.customer_id = a.customer_id AND b.product = a.product OR b.opened = a.opened AND b.product = a.product))")
def unique_by_either_key(spark: SparkSession, d: str) -> DataFrame:
    a = accounts(spark, d)
    return fresh_rows(a, a.filter("state = 'P'"), [["customer_id", "product"], ["opened", "product"]]).select("account_id")


def key_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """lo, hi (not included) of `parts` equal ranges of a whole-number key, as a partitioned scan takes them; the last one includes the largest key."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    step = F.ceil((F.col("hi") - F.col("lo") + 1) / parts)
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "lo", step.alias("s")).select("part", (F.col("lo") + F.col("part") * F.col("s")).alias("lo"), (F.col("lo") + (F.col("part") + 1) * F.col("s")).alias("hi"))


def read_table(spark: SparkSession, url: str, table: str, key: str, ranges: Sequence[tuple[int, int]], **options: str) -> DataFrame:
    """A database table by JDBC, one partition per range of its key; names are quoted as the database's dialect does."""
    marks = {"mysql": "``", "sqlserver": "[]"}.get(url.split(":")[1] if ":" in url else "", '""')
    name = lambda x: ".".join(marks[0] + p.replace(marks[1], marks[1] * 2) + marks[1] for p in x.split("."))
    where = [f"{name(key)} >= {int(lo)} AND {name(key)} < {int(hi)}" for lo, hi in ranges]
    return spark.read.jdbc(url, name(table), predicates=where, properties=options)


@query(SQL + "SELECT c_custkey AS customer_id, coalesce(nullif(trim(c_mktsegment), ''), 'Unknown') AS sector, coalesce(n_name, 'Head Office') AS branch, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, upper(c_name) AS display FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey")
def insert_defaults(spark: SparkSession, d: str) -> DataFrame:
    """What triggers fill in before an insert, as expressions of the load: default texts, a default branch, a status and a display name."""
    n = load(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = load(spark, d, "customer").join(n, "c_nationkey", "left")
    return c.select(F.col("c_custkey").alias("customer_id"), F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("Unknown")).alias("sector"), F.coalesce("n_name", F.lit("Head Office")).alias("branch"), F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active").alias("status"), F.upper("c_name").alias("display"))
