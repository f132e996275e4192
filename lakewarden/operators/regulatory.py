"""Nested regulatory reports: transactions with their parties below a report, as XML, checked row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakewarden.operators.hierarchy import cut_lineage
from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, branches, customers, transactions

ROW = "report"


def reports(lines: DataFrame, persons: DataFrame) -> DataFrame:
    """lines(branch_id, day, account_id, line, amount, kind, person_id, description) and persons(person_id, name, country) -> a row for each branch and day: rentity_id, submission_date, reason,
    account (an array by number, each with its transactions by line) and report_indicators.

    Two aggregations build the two levels, so a task holds the accounts of one report at most. A line without a person keeps no party.
    """
    party = F.when(F.col("name").isNotNull(), F.struct(F.lit("A").alias("funds_code"), F.struct("name", F.coalesce("country", F.lit("NG")).alias("country")).alias("person")))
    own = lines.join(persons, "person_id", "left").withColumn("_party", party)
    debit = F.col("kind") == "D"
    each = F.struct(
        F.concat_ws("-", "account_id", "line").alias("transactionnumber"), F.col("description").alias("transaction_description"), F.abs("amount").cast("decimal(18,2)").alias("amount_local"),
        F.when(debit, F.col("_party")).alias("t_from"), F.when(~debit, F.col("_party")).alias("t_to"),
    )
    first = own.groupBy("branch_id", "day", "account_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line").alias("_line"), each.alias("t")))).alias("_t"), F.max(F.abs("amount")).alias("_most"))
    account = F.struct("account_id", F.col("_t.t").alias("transaction"))
    second = first.groupBy("branch_id", "day").agg(F.sort_array(F.collect_list(account)).alias("account"), F.max("_most").alias("_most"))
    indicators = F.array_compact(F.array(F.when(F.col("_most") > 50_000, "CTR"), F.when(F.size("account") > 3, "STRUCTURED")))
    return second.select(F.col("branch_id").cast("long").alias("rentity_id"), F.col("day").alias("submission_date"), F.lit("threshold").alias("reason"), "account", F.struct(indicators.alias("indicator")).alias("report_indicators"))


def write_reports(df: DataFrame, path: str) -> None:
    df.write.format("xml").option("rootTag", "reports").option("rowTag", ROW).mode("overwrite").save(path)


def read_reports(spark: SparkSession, path: str, schema: StructType, xsd: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, what is no valid row as `record`) of written reports; each is checked by the XSD file, which goes to all tasks, if one is given."""
    reader = spark.read.format("xml").option("rowTag", ROW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "record").schema(StructType([*schema.fields, StructField("record", StringType())]))
    if xsd:
        spark.sparkContext.addFile(xsd)
        reader = reader.option("rowValidationXSDPath", xsd.rsplit("/", 1)[-1])
    df = cut_lineage(reader.load(path))  # parsed once for both
    return df.filter("record is null").drop("record"), df.filter("record is not null").select("record")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).filter("amount > 50000 or quantity > 48").join(accounts(spark, d).select("account_id", "customer_id"), "account_id").join(customers(spark, d).select("customer_id", "branch_id"), "customer_id")
    return t.select("branch_id", F.col("date_created").alias("day"), "account_id", "line", "amount", "kind", F.col("customer_id").alias("person_id"), F.concat(F.lit("<"), "flag", F.lit("> & "), "state").alias("description"))


@query(SQL + """, l AS (SELECT c.branch_id AS rentity_id, date_created AS day, t.account_id, line, amount, kind, c.name, branch FROM txn t JOIN acct USING (account_id) JOIN cust c USING (customer_id) JOIN branch USING (branch_id) WHERE amount > 50000 OR quantity > 48)
SELECT rentity_id, day AS submission_date, count(DISTINCT account_id) AS n_accounts, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, count(*) FILTER (WHERE kind = 'D') AS n_from, min(name) AS first_name, min(branch) AS country,
concat_ws(',', CASE WHEN max(amount) > 50000 THEN 'CTR' END, CASE WHEN count(DISTINCT account_id) > 3 THEN 'STRUCTURED' END) AS indicators FROM l GROUP BY 1, 2""")
def regulatory_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports as XML texts, parsed again: what is read out of them."""
    persons = customers(spark, d).join(branches(spark, d), "branch_id", "left").select(F.col("customer_id").alias("person_id"), "name", F.col("branch").alias("country"))
    made = reports(report_lines(spark, d), persons)
    texts = made.select(F.to_xml(F.struct("*")).alias("x"))
    r = texts.select(F.from_xml("x", made.schema).alias("r")).select("r.*").withColumn("t", F.flatten("account.transaction"))
    parties = F.concat("t.t_from", "t.t_to")
    named = lambda f: F.array_min(F.transform(F.filter(parties, lambda p: p.isNotNull()), lambda p: p["person"][f]))
    return r.select(
        "rentity_id", "submission_date", F.size("account").cast("long").alias("n_accounts"), F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x["amount_local"]).cast("decimal(38,2)")).cast("double").alias("amount"),
        F.size(F.filter("t", lambda x: x["t_from"].isNotNull())).cast("long").alias("n_from"), named("name").alias("first_name"), named("country").alias("country"), F.concat_ws(",", "report_indicators.indicator").alias("indicators"),
    )
