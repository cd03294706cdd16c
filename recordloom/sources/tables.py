"""Tables to import: CSV, TSV, JSON, NDJSON, Parquet, SQLite and XLSX files as DataFrames."""

from __future__ import annotations

import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import fresh_folder

#: Rows of a SQLite or XLSX file that are in memory at once.
BATCH = 10_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class Ambiguous(ValueError):
    """A file holds several tables and none was named."""


def _delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Header names, trimmed cells as text, short rows filled with nulls, a byte order mark dropped."""
    df = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, mode="PERMISSIVE", escape='"')
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def _batched(spark: SparkSession, names: list[str], rows: Iterator[tuple]) -> DataFrame:
    """Text columns out of rows of a file on the driver's disk, written in batches to the shared folder as they come; the result reads these, so neither plan nor driver grows with the file."""
    schema = ", ".join(f"`{n}` string" for n in names)
    where, held, n = fresh_folder(spark, "import"), [], 0

    def kept() -> None:
        spark.createDataFrame(held, schema).write.mode("append").parquet(where)

    for r in rows:
        held.append(tuple(None if v is None else str(v) for v in r))
        if len(held) == BATCH:
            kept()
            held, n = [], n + 1
    if held or not n:
        kept()
    return spark.read.schema(schema).parquet(where)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, fetch: int = 2000, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a database, Postgres for one: by a server-side cursor of fetch rows, and with a whole-number key in as many ranges of it as parts, each read by a task of its own."""
    options = {"fetchsize": str(fetch), **(properties or {})}
    if key is None:
        return spark.read.jdbc(url, table, properties=options)
    ends = spark.read.jdbc(url, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {table}) ends", properties=options).first()  # one row
    if ends[0] is None:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(ends[0]), upperBound=int(ends[1]) + 1, numPartitions=parts, properties=options)


def read_sqlite(spark: SparkSession, path: str, query: str) -> DataFrame:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cursor = db.execute(query)
        return _batched(spark, [d[0] for d in cursor.description], iter(cursor))


def sheets(path: str) -> dict[str, str]:
    """Names of sheets and the parts that hold them."""
    with zipfile.ZipFile(path) as z:
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        key = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        return {s.get("name"): "xl/" + rels[s.get(key)].removeprefix("/xl/") for s in book.iter(f"{_MAIN}sheet")}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    part = sheets(path)[sheet]
    with zipfile.ZipFile(path) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []

        def rows() -> Iterator[list[str | None]]:
            with z.open(part) as f:
                for _, el in ElementTree.iterparse(f):
                    if el.tag != f"{_MAIN}row":
                        continue
                    cells: list[str | None] = []
                    for c in el.iter(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value = c.find(f"{_MAIN}v")
                        text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) or None
                        cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                    yield cells
                    el.clear()

        every = rows()
        names = [str(n).strip() for n in next(every, []) if n]
        return _batched(spark, names, ((r + [None] * len(names))[: len(names)] for r in every)) if names else spark.createDataFrame([], "empty string")


def _json_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An array of objects is one table; an object of arrays is a table for each member."""
    whole = spark.read.json(path, multiLine=True)
    lists = [f.name for f in whole.schema.fields if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    if lists and len(lists) == len(whole.columns):
        return {n: whole.select(F.explode(n).alias("x")).select("x.*") for n in lists}
    return {"": whole}


def read_table(spark: SparkSession, path: str, sheet: str | None = None, query: str | None = None) -> DataFrame:
    """The table of a file; sheet names one of several, query asks a SQLite file."""
    kind = path.rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        return _delimited(spark, path, "\t" if kind == "tsv" else ",")
    if kind in ("ndjson", "jsonl"):
        return spark.read.json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("sqlite", "db", "sqlite3"):
        if query:
            return read_sqlite(spark, path, query)
        name = _one(sqlite_tables(path), sheet)
        return read_sqlite(spark, path, 'SELECT * FROM "' + name.replace('"', '""') + '"')
    if kind == "xlsx":
        return read_xlsx(spark, path, _one(list(sheets(path)), sheet))
    if kind == "json":
        found = _json_tables(spark, path)
        return found[_one(list(found), sheet)]
    raise ValueError(f"files of kind {kind} are not read")


def _one(names: list[str], wanted: str | None) -> str:
    if wanted is not None:
        if wanted not in names:
            raise KeyError(wanted)
        return wanted
    if len(names) != 1:
        raise Ambiguous(f"name one of {names}")
    return names[0]
