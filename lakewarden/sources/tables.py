"""Compliance entities over the star-schema tables: branches, customers, accounts, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-11-05"  #: "today" of orders and lineitem
EVENTS_AS_OF = "2024-01-31"
ROWS_IN_TASK = 500_000  #: of a large table that a task joins or groups at a time


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(table: DataFrame) -> int:
    """How many tasks a table's rows are to be dealt to, so that a task's rows do not grow with the table; 0 where one task may hold them all. The count reads file footers alone.

    Spark's own number is no measure: with a fixed one a task's rows grow with the table until they are too many.
    """
    parts = -(-table.count() // ROWS_IN_TASK)
    return max(parts, table.sparkSession.sparkContext.defaultParallelism) if parts > 1 else 0


def dealt(df: DataFrame, parts: int, *by: str) -> DataFrame:
    """df with its rows dealt to so many tasks by columns; df itself for 0."""
    return df.repartition(parts, *by) if parts else df


def money(c) -> F.Column:
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def total(c) -> F.Column:
    """An order-independent sum of money, as a double."""
    return F.sum(money(c)).cast("double")


def branches(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("branch"), F.col("n_regionkey").alias("region_id"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("branch_id"), money("c_acctbal").alias("score"), F.col("c_mktsegment").alias("sector"))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("account_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("opened"), F.col("o_orderstatus").alias("state"), money("o_totalprice").alias("balance"), F.col("o_orderpriority").alias("product"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "D").otherwise("C")
    return t.select(F.col("l_orderkey").alias("account_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("channel_id"), F.col("l_partkey").alias("part_id"), F.col("l_shipdate").cast("date").alias("date_created"), money("l_extendedprice").alias("amount"), kind.alias("kind"), F.col("l_linestatus").alias("state"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))


def level(score) -> F.Column:
    """Risk band of a score; the limits are in hundreds of the score's unit."""
    return F.when(score >= 6000, "high").when(score >= 2000, "medium").otherwise("low")


#: The same entities for oracle SQL.
SQL = f"""
WITH branch AS (SELECT n_nationkey AS branch_id, n_name AS branch, n_regionkey AS region_id FROM nation),
cust AS (SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS branch_id, CAST(c_acctbal AS DECIMAL(18,2)) AS score, c_mktsegment AS sector,
  CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) >= 6000 THEN 'high' WHEN CAST(c_acctbal AS DECIMAL(18,2)) >= 2000 THEN 'medium' ELSE 'low' END AS level FROM customer),
acct AS (SELECT o_orderkey AS account_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS opened, o_orderstatus AS state, CAST(o_totalprice AS DECIMAL(18,2)) AS balance, o_orderpriority AS product FROM orders),
txn AS (SELECT l_orderkey AS account_id, l_linenumber AS line, l_suppkey AS channel_id, l_partkey AS part_id, CAST(l_shipdate AS DATE) AS date_created, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'C' END AS kind, l_linestatus AS state, l_quantity AS quantity, l_discount AS discount, l_returnflag AS flag FROM lineitem)
"""
