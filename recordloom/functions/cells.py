"""Cells of imported tables: inference, coercion, previews and names; native expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules of the importer. Fixed values.
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
TRUTH = r"(?i)^(true|false|yes|no)$"
PREVIEW = 200
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def guess_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The type of each column that all its values fit, blanks left out: one aggregation over the rows."""
    aggs = []
    for n, c in enumerate(columns):
        v = F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
        fits = lambda p, v=v: F.coalesce(F.bool_and(v.rlike(p)), F.lit(False))
        whole = F.coalesce(F.bool_and(v.try_cast("double") % 1 == 0), F.lit(False))
        kind = (
            F.when(fits(TRUTH), "true or false")
            .when(fits(_NUMBER) & whole, "whole number")
            .when(fits(_NUMBER), "number")
            .when(fits(DATE), "date")
            .when(fits(f"({DATETIME})|({DATE})"), "date and time")
            .otherwise("text")
        )
        aggs.append(kind.alias(f"k{n}"))
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k{n}").alias("kind")) for n, c in enumerate(columns)])).alias("x")).select("x.*")


def coerce(cell: Column, kind: str) -> Column:
    """A cell as text of what a schema wants, as it is where it does not fit."""
    if kind in ("number", "integer"):
        return F.when(cell.rlike(_NUMBER), F.trim(cell)).otherwise(cell)
    if kind == "boolean":
        return F.when(cell.rlike(r"(?i)^(true|yes|1)$"), "true").when(cell.rlike(r"(?i)^(false|no|0)$"), "false").otherwise(cell)
    return cell


def field_name(column: str) -> str:
    """Letters, digits and single underscores, led by no digit."""
    name = re.sub("[^A-Za-z0-9]+", "_", column.strip()).strip("_")
    return ("f_" + name if name[:1].isdigit() else name) or "field"


def preview(cell: Column, most: int = PREVIEW) -> Column:
    return F.when(F.length(cell) > most, F.concat(F.substring(cell, 1, most), F.lit("…"))).otherwise(cell)


def like_literal(text: str) -> str:
    """A LIKE pattern for a literal substring."""
    return "%" + re.sub(r"([\\%_])", r"\\\1", text.strip()[:100]) + "%"


def normalize_email(address: Column) -> Column:
    return F.lower(F.trim(address))


def looks_like_email(address: Column) -> Column:
    return (F.length(address) <= 254) & address.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def loose_name(name: Column) -> Column:
    """Letters and digits in lower case, to match columns with fields."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


#: What a guessed type asks of a field. Fixed values.
FIELDS = {
    "text": {"type": "string"},
    "number": {"type": "number"},
    "whole number": {"type": "integer"},
    "true or false": {"type": "boolean"},
    "date": {"type": "string", "format": "date"},
    "date and time": {"type": "string", "format": "date-time"},
}


def draft_schema(rows: DataFrame, id_column: str, left_out: tuple[str, ...] = ()) -> dict:
    """A schema for a table's records: a field for each column that is not blank throughout, required where it never is. One pass over the rows; a row for each column comes to the driver."""
    columns = [c for c in rows.columns if c != id_column and c not in left_out]
    kinds = {r["column"]: r["kind"] for r in guess_types(rows, columns).collect()}
    blank = rows.agg(*(F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"b{n}") for n, c in enumerate(columns)), F.count("*").alias("all")).first()
    some = [(c, blank[f"b{n}"] == 0) for n, c in enumerate(columns) if blank[f"b{n}"] < blank["all"]]
    return {"type": "object", "properties": {field_name(c): FIELDS[kinds[c]] for c, _ in some}, "required": [field_name(c) for c, full in some if full]}


def preview_data(data: Column, most: int = PREVIEW) -> Column:
    """JSON objects with their members cut for a table: long strings end in an ellipsis, long JSON becomes its beginning under $preview, file references stay; null for what is no object."""

    def cut(x: object) -> object:
        if isinstance(x, str):
            return x if len(x) <= most else x[:most] + "…"
        if isinstance(x, dict) and "$file" in x:
            return x
        raw = json.dumps(x, ensure_ascii=False, separators=(",", ":"))
        return x if len(raw) <= most else {"$preview": raw[:most] + "…"}

    def one(text: str | None) -> str | None:
        try:
            x = json.loads(text) if text is not None else None
        except ValueError:
            return None
        return json.dumps({k: cut(v) for k, v in x.items()}, ensure_ascii=False, separators=(",", ":")) if isinstance(x, dict) else None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return run(data)
