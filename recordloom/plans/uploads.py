"""Queries of uploads, scripts and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import uploads as U
from ..operators import versions as V
from .fixtures import ENTRIES, entries, state_sql, table
from .registry import ORACLES, query
from .write import sweep

W = "WITH " + ENTRIES
_NAMES = {"p_name": "name", "p_brand": "brand", "p_size": "size"}


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_type").alias("type"), F.col("p_partkey").cast("string").alias("id"), F.to_json(F.struct(F.col("p_size").alias("size"))).alias("data"), F.lit("r").alias("kind"), "p_size")


@query("M9_scan_under_schema", "SELECT p_type AS type, CAST(p_partkey AS VARCHAR) AS id, 'schema' AS problem FROM part WHERE p_type = 'SMALL' AND p_size > 20")
def scan(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"properties": {"size": {"type": "integer", "maximum": 20}}}
    return U.invalid(parts(spark, sf).where("type = 'SMALL'"), {"SMALL": schema}, None)


@query("M8_check_upload", "SELECT p_type AS type, CAST(p_partkey AS VARCHAR) AS id, 'schema' AS problem FROM part WHERE (p_partkey < 50 AND p_size > 40) OR (p_partkey >= 50 AND p_size > 30 AND p_type = 'SMALL') OR (p_partkey < 50 AND p_size > 30 AND p_type = 'SMALL')")
def check_upload(spark: SparkSession, sf: str) -> DataFrame:
    p = parts(spark, sf)
    loose = {"properties": {"size": {"type": "integer", "maximum": 40}}}
    tight = {"properties": {"size": {"type": "integer", "maximum": 30}}}
    types = ["SMALL", "MEDIUM", "LARGE", "ECONOMY", "STANDARD", "PROMO"]
    before = {t: loose for t in types}
    problems, _ = U.check_upload(p.where("cast(id as int) < 50"), p, before, before | {"SMALL": tight}, None)
    return problems


@query("X1_script", W + f", {state_sql('A', 10)}, o AS (SELECT type, id, sha256(hash) AS hash FROM A WHERE type = 'view' AND length(id) < 3) SELECT coalesce(A.type, o.type) AS type, coalesce(A.id, o.id) AS id, CASE WHEN o.hash IS NULL THEN 'removed' ELSE 'changed' END AS op, o.hash AS hash FROM A FULL JOIN o ON A.type = o.type AND A.id = o.id WHERE A.hash IS DISTINCT FROM o.hash AND (o.hash IS NOT NULL OR A.type = 'view')")
def script(spark: SparkSession, sf: str) -> DataFrame:
    head = V.state(entries(spark, sf), 10)
    return U.run_script(lambda x: x.where("type = 'view' AND length(id) < 3").withColumn("hash", F.sha2("hash", 256)), [head], head, types=["view"])


@query("F10_import_mapping", "SELECT CAST(p_partkey AS VARCHAR) AS id, '{' || CASE WHEN p_name <> '' THEN '\"name\":\"' || p_name || '\",' ELSE '' END || '\"size\":' || CAST(p_size AS VARCHAR) || '}' AS data FROM part")
def import_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return U.import_rows(table(spark, sf, "part").withColumn("id", F.col("p_partkey").cast("string")), _NAMES, ["p_brand"])


@query("A19_sweep_tallies", "WITH x AS (" + ORACLES["M14_sweep"] + ") SELECT verdict, count(*) AS names, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM x GROUP BY verdict")
def tallies(spark: SparkSession, sf: str) -> DataFrame:
    return U.sweep_tallies(sweep(spark, sf))


@query("M28_kept_files", "SELECT CAST(p_partkey AS VARCHAR) AS file FROM part WHERE p_partkey % 3 <> 0 AND p_type IN ('SMALL', 'LARGE')")
def kept_files(spark: SparkSession, sf: str) -> DataFrame:
    f = parts(spark, sf).select(F.col("id").alias("file"), F.when(F.col("id").cast("int") % 3 == 0, "asset").otherwise("record").alias("kind"), "type")
    return U.kept_files(f, "types", ["SMALL", "LARGE"]).select("file")


@query("M6_groups_holding", W + ', f AS (SELECT "commit" AS g, type, min(id) AS first, max(id) AS last FROM E GROUP BY "commit", type) SELECT DISTINCT g AS "group" FROM f WHERE (type = \'view\' AND first <= \'77\' AND last >= \'77\') OR (type = \'signup\' AND first <= \'0\' AND last >= \'0\')')
def groups_holding(spark: SparkSession, sf: str) -> DataFrame:
    files = entries(spark, sf).groupBy(F.col("commit").alias("group"), "type").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return U.groups_holding(files, spark.createDataFrame([("view", "77"), ("signup", "0")], "type string, id string"))
