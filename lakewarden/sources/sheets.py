"""Spreadsheet files (XLSX, ODS) as tables of text. A file is one row of a task, which reads its first sheet cell by cell."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 5_000  #: rows sent on at a time


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xlsx_rows(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """The first sheet's rows with their numbers from 0, as the sheet counts them; a cell is its text, number or truth value as text, null if empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if _name(e.tag) == "si":
                    shared.append("".join(t.text or "" for t in e.iter() if _name(t.tag) == "t"))
                    e.clear()
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]), default=None)
        if sheet is None:
            return
        number = -1
        for _, e in ElementTree.iterparse(z.open(sheet)):
            if _name(e.tag) != "row":
                continue
            number = int(e.get("r", number + 2)) - 1
            row: list[str | None] = []
            for c in e:
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                row += [None] * (max(at, len(row) + 1) - len(row))
                value = next((v.text for v in c if _name(v.tag) == "v"), None)
                kind = c.get("t")
                if kind == "s" and value:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _name(t.tag) == "t")
                elif kind == "b":
                    value = {"1": "true", "0": "false"}.get(value or "", value)
                row[-1] = value or None
            e.clear()
            if any(row):
                yield number, row


def ods_rows(data: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """The first table's rows with their numbers from 0, blank ones counted but left out; repeated cells and rows are written out, but for the empty ones at an end."""
    number = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for _, e in ElementTree.iterparse(z.open("content.xml")):
            if _name(e.tag) == "table":
                return
            if _name(e.tag) != "table-row":
                continue
            row: list[str | None] = []
            times = 1
            for k, v in e.attrib.items():
                if _name(k) == "number-rows-repeated":
                    times = int(v)
            blank = 0
            for c in e:
                again = next((int(v) for k, v in c.attrib.items() if _name(k) == "number-columns-repeated"), 1)
                text = "\n".join("".join(p.itertext()) for p in c if _name(p.tag) == "p") or None
                if text:
                    row += [None] * blank + [text] * again
                blank = 0 if text else blank + again
            e.clear()
            if row:
                for i in range(times):
                    yield number + i, list(row)
            number += times


READERS = {"xlsx": xlsx_rows, "ods": ods_rows}


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, row (from 0, as the sheet counts), cells (array of text) of all files at path, but for blank rows; files of other kinds are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                reader = READERS.get(file.rsplit(".", 1)[-1].lower())
                if reader is None:
                    raise ValueError(f"{file} is no spreadsheet")
                rows = reader(data)
                while held := list(itertools.islice(rows, BATCH)):
                    yield pd.DataFrame({"file": file, "row": [n for n, _ in held], "cells": [cells for _, cells in held]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, cells array<string>")


def read_sheet(spark: SparkSession, path: str, skip: int = 0, rows: int | None = None) -> DataFrame:
    """A spreadsheet with its header after `skip` rows, as text columns; `rows` rows after it at most, if given. Columns without a name are column_N; short rows end in nulls."""
    cells = sheet_rows(spark, path).filter(F.col("row") >= skip)
    head = cells.filter(F.col("row") == skip).select("cells").first()
    if head is None:
        raise ValueError(f"no rows in {path}")
    names = [(c or "").strip() or f"column_{i + 1}" for i, c in enumerate(head[0])]
    body = cells.filter(F.col("row") > skip)
    if rows is not None:
        body = body.filter(F.col("row") <= skip + rows)
    return body.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
