"""Uploads against a collection: checks before a commit, scripts and imports that write versions, and what a copy keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import tightened, valid
from .versions import KEY
from .write import carried_over, save

Script = Callable[..., DataFrame]


def invalid(records: DataFrame, schemas: dict[str, dict], limit: int | None = 20) -> DataFrame:
    """The first records (type, id, data), or with no limit all, that do not fit their type's schema; a type without a schema is a problem itself."""
    parts = [records.where((F.col("type") == t) & ~valid(F.col("data"), s)).select(*KEY, F.lit("schema").alias("problem")) for t, s in schemas.items()]
    out = records.where(~F.col("type").isin(list(schemas)) & ~F.col("type").startswith("$")).select(*KEY, F.lit("no schema").alias("problem"))
    for p in parts:
        out = out.unionByName(p)
    return out if limit is None else out.limit(limit)


def check_upload(upload: DataFrame, head: DataFrame, before: dict[str, dict], after: dict[str, dict], limit: int | None = 20) -> tuple[DataFrame, str]:
    """Problems of an upload and the version bump that it asks for. Records that it does not replace are read again only under schemas that became tighter."""
    tighter = {t: False if s is None else s for t, s in tightened(before, after).items()}  # of a type that went no record may stay
    old = carried_over(head.where(F.col("type").isin(list(tighter))), upload).select(*KEY, "data")
    problems = invalid(upload.where("kind = 'r'").select(*KEY, "data"), after, limit)
    problems = problems.unionByName(invalid(old, tighter, limit)) if tighter else problems
    bump = "major" if before != after else ("minor" if upload.head(1) else "patch")
    return problems if limit is None else problems.limit(limit), bump


def run_script(script: Script, reads: list[DataFrame], head: DataFrame, mode: str = "set", types: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """What a script's output changes in a collection. types and where are its scope; only what lies inside can be removed."""
    scope = F.lit(True)
    if types is not None:
        scope = scope & F.col("type").isin(types)
    if where is not None:
        scope = scope & where
    return save(head, script(*reads), mode, scope)


def check_report(check: DataFrame) -> DataFrame:
    """A row with the number of problems a check script found, and whether it failed."""
    return check.agg(F.count("*").alias("problems")).withColumn("failed", F.col("problems") > 0)


def import_plan(rows: DataFrame, decisions: DataFrame, key: str, mode: str = "set") -> tuple[DataFrame, DataFrame, str]:
    """Rows to import, rows held, and the mode: while any row is held nothing can be removed, so set turns into additions."""
    held = held_rows(rows, decisions, key)
    return rows.where("id IS NOT NULL"), held, "additions" if mode == "set" and held.head(1) else mode


def each_record(records: DataFrame, check: Callable[[Column], Column], column: str = "data") -> DataFrame:
    """Records with what a caller's check says of each, where it says anything."""
    return records.withColumn("problem", check(F.col(column))).where("problem IS NOT NULL")


def failed(check: DataFrame) -> bool:
    """Whether a check script found a problem: any row is one."""
    return bool(check.head(1))


def import_rows(rows: DataFrame, fields: dict[str, str], private: list[str] = ()) -> DataFrame:
    """Columns under their field names as JSON: empty cells left out, private columns dropped."""
    kept = {c: f for c, f in fields.items() if c not in private}
    cells = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(f) for c, f in kept.items()]
    return rows.select("id", F.to_json(F.struct(*cells), {"ignoreNullFields": "true"}).alias("data"))


def held_rows(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Rows without an id that no decision names."""
    return rows.where("id IS NULL").join(decisions.select(key), key, "left_anti")


def sweep_tallies(verdicts: DataFrame) -> DataFrame:
    """Names and bytes of each verdict of a sweep."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("names"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def kept_files(files: DataFrame, level: str, types: list[str] | None = None) -> DataFrame:
    """files (file, kind, type) that a copy keeps: all, records, records of some types, or none."""
    if level == "all":
        return files
    if level == "none":
        return files.where(F.lit(False))
    records = files.where("kind = 'record'")
    return records.where(F.col("type").isin(types or [])) if level == "types" else records


def groups_holding(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Groups of files (group, type, first, last: ids) whose range holds one of keys (type, id)."""
    inside = (files["type"] == keys["type"]) & (files["first"] <= keys["id"]) & (keys["id"] <= files["last"])
    return files.join(keys, inside, "left_semi").select("group").distinct()
