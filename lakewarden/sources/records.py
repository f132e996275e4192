"""CSV records that span lines, read in parallel: each split of a file is scanned once for what its quotes do, and splits learn from the ones before how they begin.

A line is a function of whether it begins inside a quoted field to whether it ends inside one. There are four such functions, and they
compose, so the state at a line is told by the last line before it that ends in one state whatever its beginning, and by the lines since that
turn the state around. Only lines of records with several lines are shuffled for being put together.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file, split (where it begins), at (order within a split), line: without line ends and a byte-order mark."""
    rows = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    bare = F.regexp_replace(F.regexp_replace(value, "\r$", ""), "^\ufeff", "")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), bare.alias("line"))


def ends_inside(line: Column, separator: str) -> Column:
    """Whether a line that begins outside a quoted field ends inside one. A quote opens a field only at its beginning; two in a row inside stand for one."""
    sep = re.escape(separator)
    closed = F.regexp_replace(line, f'(?<=^|{sep})"(?:[^"]|"")*+"(?={sep}|$)', "")
    return closed.rlike(f'(?<=^|{sep})"(?:[^"]|"")*+$')


def states(lines: DataFrame, separator: str) -> DataFrame:
    """lines and `inside`: whether a line begins inside a quoted field."""
    out, into = ends_inside(F.col("line"), separator), ends_inside(F.concat(F.lit('"'), F.col("line")), separator)
    marked = lines.withColumn("_turn", (out & ~into).cast("int")).withColumn("_set", F.when(out == into, out.cast("int")))
    own = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turned = marked.withColumn("_turns", F.coalesce(F.sum("_turn").over(own), F.lit(0)))
    fixed = F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", "_turns")), ignorenulls=True)
    seen = turned.withColumn("_fixed", fixed.over(own))
    # a whole split's function: what its last fixed line and the turns after it make, or its turns alone
    last = F.max_by(F.when(F.col("_set").isNotNull(), F.struct("_set", "_turns")), F.when(F.col("_set").isNotNull(), F.col("at")))
    splits = turned.groupBy("file", "split").agg(last.alias("last"), F.sum("_turn").alias("turns"))
    whole = splits.select("file", "split", F.when(F.col("last").isNotNull(), (F.col("last._set") + F.col("turns") - F.col("last._turns")) % 2).alias("_end"), (F.col("turns") % 2).alias("_flip"))
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    flips = whole.withColumn("_flips", F.coalesce(F.sum("_flip").over(by_file), F.lit(0)))
    known = flips.withColumn("_known", F.last(F.when(F.col("_end").isNotNull(), F.struct("_end", (F.col("_flips") + F.col("_flip")).alias("_then"))), ignorenulls=True).over(by_file))
    begin = known.select(F.col("file").alias("_file"), F.col("split").alias("_split"), F.when(F.col("_known").isNull(), F.col("_flips") % 2).otherwise((F.col("_known._end") + F.col("_flips") - F.col("_known._then")) % 2).alias("_begin"))
    state = F.when(F.col("_fixed").isNull(), F.col("_begin") + F.col("_turns")).otherwise(F.col("_fixed._set") + F.col("_turns") - F.col("_fixed._turns")) % 2
    both = seen.join(begin, (seen["file"] == begin["_file"]) & (seen["split"] == begin["_split"]))
    return both.select(*lines.columns, (state != 0).alias("inside"))


def records(lines: DataFrame, separator: str) -> DataFrame:
    """file, split, at (of the first line), record: the lines of each record joined again. An opened field that is never closed takes the rest of its file."""
    ruled = states(lines, separator)
    start = ~F.col("inside")
    closes = ~F.when(F.col("inside"), ends_inside(F.concat(F.lit('"'), F.col("line")), separator)).otherwise(ends_inside(F.col("line"), separator))
    single = ruled.filter(start & closes).select("file", "split", "at", F.col("line").alias("record"))
    parts = ruled.filter(~(start & closes))
    # number the records of several lines by counting their starts: within a split, and in the splits before
    own = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("file", "split").agg(F.count_if(start).alias("_n")).select(F.col("file").alias("_file"), F.col("split").alias("_split"), F.coalesce(F.sum("_n").over(by_file), F.lit(0)).alias("_before"))
    numbered = parts.withColumn("_own", F.sum(start.cast("int")).over(own)).join(counts, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    pieces = F.array_sort(F.collect_list(F.struct("split", "at", "line")))
    whole = numbered.groupBy("file", (F.col("_before") + F.col("_own")).alias("_record")).agg(pieces.alias("_p"))
    return single.unionByName(whole.select("file", F.col("_p")[0]["split"].alias("split"), F.col("_p")[0]["at"].alias("at"), F.array_join("_p.line", "\n").alias("record")))


def read_spanning(spark: SparkSession, path: str, separator: str, encoding: str) -> DataFrame:
    """A CSV file, or a folder of files with one header, as text columns: fields may hold line ends anywhere. Records of more or fewer fields than the header are dropped, and so are blank lines."""
    found = records(read_lines(spark, path, encoding), separator).filter(F.trim("record") != "")
    order = F.struct("file", "split", "at")
    first = found.select(F.min_by("record", order)).first()[0]
    names = next(csv.reader([first], delimiter=separator)) if "\n" not in first else next(csv.reader(first.split("\n"), delimiter=separator))
    heads = found.groupBy("file").agg(F.min(order).alias("_head")).select(F.col("_head.file").alias("_f"), F.col("_head.split").alias("_s"), F.col("_head.at").alias("_a"))
    body = found.join(heads, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")) & (F.col("at") == F.col("_a")), "left_anti")
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "_bad string"])
    options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1", "lineSep": "\x01"}
    rows = body.select(F.from_csv("record", F.lit(schema), options).alias("r"))
    return rows.filter("r._bad is null").select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))


def has_spanning(lines: DataFrame, separator: str) -> bool:
    """Whether any line of the files ends inside a quoted field; all lines are asked."""
    return not lines.filter(ends_inside(F.col("line"), separator)).isEmpty()
