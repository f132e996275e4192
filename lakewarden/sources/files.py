"""Readers of delivered files: separator sniffing, byte cleaning, XML record tags, and schema matching."""

from __future__ import annotations

import codecs
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.sources.records import has_spanning, read_lines, read_spanning
from lakewarden.sources.sheets import read_sheet

SEPARATORS = (",", ";", "\t", "|")
#: Record tags in the order in which ties are settled.
RECORD_TAGS = ("sdnEntry", "record", "entity", "individual", "person", "party", "target", "entry", "item")
SAMPLE = 10_240  #: bytes of a file from which its record tag is told


def head_of(spark: SparkSession, path: str) -> bytes:
    """The first SAMPLE bytes of a file, or of one of a folder's; empty if there is none."""
    head = spark.read.format("binaryFile").load(path).select(F.expr(f"substring(content, 1, {SAMPLE})").alias("head")).first()
    return bytes(head[0]) if head else b""


def sniff_encoding(head: bytes) -> str:
    """By byte-order mark, else UTF-8 if the bytes are, but for a character cut at their end, else ISO-8859-1."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def sniff_separator(text: str) -> str:
    """The first separator that gives the header line more than one column; a comma if none does."""
    line = text.splitlines()[0] if text else ""
    return next((s for s in SEPARATORS if len(line.split(s)) > 1), ",")


def read_csv(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None) -> DataFrame:
    """A file with a header as text columns; malformed lines are dropped, empty fields stay empty texts. Encoding and separator are told from the file's
    beginning if they are not given. Fields may hold line ends anywhere: files with any are put together from their lines in parallel. A file in UTF-16 is read whole."""
    head = head_of(spark, path)
    if not head.strip():
        raise ValueError(f"{path} is missing or empty")
    encoding = encoding or sniff_encoding(head)
    sep = separator or sniff_separator(head.decode(encoding, "ignore").removeprefix("\ufeff"))
    whole = encoding == "UTF-16"
    if not whole and has_spanning(read_lines(spark, path, encoding), sep):
        df = read_spanning(spark, path, sep, encoding)
    else:
        df = spark.read.csv(path, header=True, sep=sep, mode="DROPMALFORMED", inferSchema=False, encoding=encoding, multiLine=whole, escape='"')
    return df.toDF(*(c.removeprefix("\ufeff") for c in df.columns)).na.fill("")


def clean_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file without a byte-order mark and carriage returns at their ends, with control characters (NUL among them) as blanks."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r+$", "").alias("value"))
    return lines.select(F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ").alias("value"))


def record_tag(sample: str) -> str | None:
    """The most frequent record tag in the beginning of an XML file, in any case; the first of equals; None if there is none."""
    counts = {t: sample.lower().count(f"<{t.lower()}") for t in RECORD_TAGS}
    best = max(RECORD_TAGS, key=lambda t: counts[t])
    return best if counts[best] else None


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """The records of an XML file. The driver sees the file's first SAMPLE bytes alone, and takes the tag in the case that it has there."""
    sample = head_of(spark, path).decode("utf-8", "replace")
    tag = record_tag(sample)
    if tag is None:
        raise ValueError(f"no record tag in {path}")
    return spark.read.format("xml").option("rowTag", re.search(f"<({tag})", sample, re.I)[1]).load(path)


READERS = {"csv": read_csv, "txt": read_csv, "xml": read_xml, "xlsx": read_sheet, "ods": read_sheet, "json": lambda spark, path: spark.read.json(path), "parquet": lambda spark, path: spark.read.parquet(path), "orc": lambda spark, path: spark.read.orc(path)}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A reader by the file's extension; one that has none is an error, and so is a missing or empty file."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader of {kind} files")
    return READERS[kind](spark, path)


def read_feed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A feed of quoted values with no header, in any encoding, as named text columns: further values are dropped, missing ones null, white space at ends is cut, and `-0-` and empty are null."""
    lines = spark.read.csv(path, header=False, encoding=sniff_encoding(head_of(spark, path)), inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=", ".join(f"`{c}` string" for c in columns), mode="PERMISSIVE", escape='"')
    return lines.select(*(F.when(~F.trim(c).isin("-0-", ""), F.trim(c)).alias(c) for c in columns))


def tail_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The log lines of a folder as a stream: Spark's checkpoint holds how far it was read, so only new files' lines come."""
    return parse_logs(spark.readStream.text(folder))


def write_report(df: DataFrame, path: str, root: str, row: str) -> None:
    """A report in XML, a row an element."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).mode("overwrite").save(path)


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """df as CSV files with headers, quoted where needed. A text that a spreadsheet would take for a formula gets a quote before it; nulls are empty, times are in ISO form."""
    safe = [F.when(F.col(f"`{c}`").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*safe).write.csv(path, header=True, sep=separator, escape='"', mode="overwrite", nullValue="", emptyValue='""')


def html_table(df: DataFrame, rows: int = 100) -> DataFrame:
    """One row: an HTML table of a message's rows, of which the first `rows` in the order given are shown, with their texts escaped."""
    from lakewarden.functions.scalars import escape_html

    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(escape_html(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;"))), F.lit("")), F.lit("</td>"))
    head = "".join(f"<th>{c}</th>" for c in df.columns)
    lines = df.limit(rows).select(F.monotonically_increasing_id().alias("_i"), F.concat(F.lit("<tr>"), *(cell(c) for c in df.columns), F.lit("</tr>")).alias("_r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_r"))), lambda x: x["_r"]), "")
    return lines.agg(F.concat(F.lit(f"<table><tr>{head}</tr>"), body, F.lit("</table>")).alias("html"))


def match_columns(have: Sequence[str], want: dict[str, str]) -> dict[str, str]:
    """want maps fields to labels; the result maps a column to each field that it fits: by name, by name without separators, or by label."""
    plain = lambda s: re.sub(r"[\s_\-.]+", "", s).lower()
    out: dict[str, str] = {}
    for field, label in want.items():
        found = next((c for test in (lambda c: c == field, lambda c: plain(c) == plain(field), lambda c: plain(c) == plain(label)) for c in have if test(c)), None)
        if found:
            out[found] = field
    return out


def parse_logs(lines: DataFrame) -> DataFrame:
    """Log lines `time level logger: message` as columns, in batch or as a stream; lines of another form have nulls and keep their text as message."""
    pattern = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\S*\s+(?:\d+\s+)?(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+(\S+?):?\s+(.*)$"
    part = lambda i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    return lines.select(F.try_to_timestamp(part(1)).alias("time"), part(2).alias("level"), part(3).alias("logger"), F.coalesce(part(4), F.col("value")).alias("message"))
