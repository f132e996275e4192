"""Numbers over a total order, ranges of keys, and joins of points to intervals, none of them in one task or by comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.operators.hierarchy import cut_lineage
from lakewarden.registry import query
from lakewarden.sources.tables import SQL, accounts, branches, customers, load, total


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "id", partitions: int | None = None) -> DataFrame:
    """df with row numbers from 1 in a total order, without gaps: ranges of the order are sampled, sorted and counted in parallel, and the counts of earlier ranges added.

    Rows of one key are told apart by their place in the input, so a key that many rows share, null or not, is dealt to as many tasks as its rows need.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "_tie"]
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    kept = cut_lineage(ranged.select(*df.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))  # sampled again, the ranges might be others
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.join(F.broadcast(sizes.select("_part", "_first", before.alias("_before"))), "_part").select((F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name), *df.columns)


def bin_of(value: Column, edges: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted edges are not above a value, by halving."""
    if not edges:
        return F.lit(first)
    k = len(edges) // 2
    return F.when(value < edges[k], bin_of(value, edges[:k], first)).otherwise(bin_of(value, edges[k + 1 :], first + k + 1))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, by: Sequence[str] = (), bins: int = 64) -> DataFrame:
    """points and intervals with lo <= at <= hi (and equal `by`, if given), by an equality on bins.

    Bins are quantiles of the points, so each holds about as many; a point is in one bin, an interval in all that it touches, and those at a bin's edges are checked. Numbers, dates
    and times alike; a null matches nothing.
    """
    number = lambda c: F.unix_date(c).cast("double") if kinds[c] == "date" else F.col(c).cast("timestamp").cast("double") if kinds[c].startswith("timestamp") else F.col(c).cast("double")
    kinds = {f.name: f.dataType.simpleString() for f in (*points.schema, *intervals.schema)}
    edges = sorted(set(points.select(number(at).alias("_v")).approxQuantile("_v", [i / bins for i in range(1, bins)], 0.002)))  # fewer than `bins` numbers
    left = points.filter(F.col(at).isNotNull()).withColumn("_bin", bin_of(number(at), edges))
    touched = F.explode(F.sequence(bin_of(number(lo), edges), bin_of(number(hi), edges)))
    right = intervals.filter(F.col(lo) <= F.col(hi)).withColumn("_bin", touched)
    return left.join(right, ["_bin", *by]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders")
def surrogate_row_number(spark: SparkSession, d: str) -> DataFrame:
    return numbered(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("""WITH e AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders), r AS (SELECT p AS part, a + p * ceil((b - a + 1) / 8)::BIGINT AS lo, a + (p + 1) * ceil((b - a + 1) / 8)::BIGINT AS hi FROM e, unnest(range(8)) t(p))
SELECT part::INT AS part, lo, hi, count(o_orderkey) AS n FROM r LEFT JOIN orders ON o_orderkey >= lo AND o_orderkey < hi GROUP BY ALL""")
def key_range_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table by eight ranges of its key, with the rows of each: a row's range is arithmetic on its key."""
    from lakewarden.plans.loads import key_ranges

    o = load(spark, d, "orders").select("o_orderkey")
    r = key_ranges(o, "o_orderkey", 8)
    ends = r.filter("part = 0").select(F.col("lo").alias("_lo"), (F.col("hi") - F.col("lo")).alias("_s"))  # one row
    counts = o.filter("o_orderkey is not null").join(F.broadcast(ends)).groupBy(F.expr("cast((o_orderkey - _lo) div _s as int)").alias("part")).agg(F.count("*").alias("_n"))
    return r.join(counts, "part", "left").select("part", "lo", "hi", F.coalesce("_n", F.lit(0)).alias("n"))


@query(SQL + """, b AS (SELECT branch_id, DATE '1994-01-01' + 40 * branch_id::INT AS start, DATE '1994-01-01' + 40 * branch_id::INT + 30 * (1 + branch_id::INT % 9) AS finish FROM branch)
SELECT b.branch_id, count(*) AS n, CAST(sum(balance) AS DOUBLE) AS balance, count(*) FILTER (WHERE cust.branch_id = b.branch_id) AS own FROM b JOIN acct ON opened BETWEEN start AND finish JOIN cust USING (customer_id) GROUP BY 1""")
def campaign_accounts(spark: SparkSession, d: str) -> DataFrame:
    """What was opened in each branch's campaign, whose intervals overlap, in whatever branch: a join by interval alone. Accounts are summed by day and branch before."""
    n = F.col("branch_id").cast("int")
    start = F.date_add(F.lit("1994-01-01").cast("date"), 40 * n)
    campaigns = branches(spark, d).select("branch_id", start.alias("start"), F.date_add(start, 30 * (1 + n % 9)).alias("finish"))
    days = accounts(spark, d).join(customers(spark, d).select("customer_id", F.col("branch_id").alias("own_branch")), "customer_id").groupBy("opened", "own_branch").agg(F.count("*").alias("k"), F.sum("balance").alias("s"))
    met = interval_join(days, "opened", campaigns, "start", "finish")
    return met.groupBy("branch_id").agg(F.sum("k").alias("n"), total("s").alias("balance"), F.coalesce(F.sum(F.when(F.col("own_branch") == F.col("branch_id"), F.col("k"))), F.lit(0)).alias("own"))
