"""Queries of record functions: leaf cuts, file cuts, inference, profiling, lines and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, cells, schemas
from ..operators import uploads as U
from ..operators import write as M
from .fixtures import ENTRIES, entries, table
from .registry import query

W = "WITH " + ENTRIES
LINES = "l AS (SELECT c_custkey AS k, '{\"id\":\"' || CAST(c_custkey AS VARCHAR) || '\",\"type\":\"customer\",\"data\":{\"name\":\"' || c_name || '\",\"nation\":' || CAST(c_nationkey AS VARCHAR) || '}}' AS line FROM customer)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    raw = F.to_json(F.struct(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("id"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")).alias("data")))
    return c.select(F.col("c_custkey").alias("k"), canonical.parsed(raw).alias("p")).select("k", "p.*")


@query("V1_canonical_lines", f"WITH {LINES} SELECT k, line, sha256(line) AS hash FROM l")
def canonical_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where("code IS NULL").select("k", "line", canonical.line_hash(F.col("line")).alias("hash"))


@query("V7_verify_records", f"WITH {LINES}, r AS (SELECT k, line, sha256(CASE WHEN k % 50 = 0 THEN line || ' ' ELSE line END) AS hash, CASE WHEN k % 70 = 0 THEN strlen(line) + 1 ELSE strlen(line) END AS size FROM l) SELECT k FROM r WHERE sha256(line) <> hash OR strlen(line) <> size")
def verify(spark: SparkSession, sf: str) -> DataFrame:
    told = F.when(F.col("k") % 50 == 0, F.concat("line", F.lit(" "))).otherwise(F.col("line"))
    r = lines(spark, sf).select("k", "line", canonical.line_hash(told).alias("hash"), (F.octet_length("line") + (F.col("k") % 70 == 0).cast("int")).alias("size"))
    return M.verify_records(r).select("k")


@query("V4_schema_verdicts", "SELECT c_custkey AS k, c_nationkey >= 5 AND c_nationkey % 2 = 0 AND length(c_name) <= 18 AS ok FROM customer")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    schema = {"type": "object", "required": ["name", "nation"], "properties": {"name": {"type": "string", "maxLength": 18}, "nation": {"type": "integer", "minimum": 5, "multipleOf": 2}}, "additionalProperties": False}
    data = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), schemas.valid(data, schema).alias("ok"))


@query("M15_leaf_boundaries", W + ", k AS (SELECT DISTINCT type, id FROM E) SELECT type, id FROM k WHERE CAST('0x' || substring(sha256(type || '/' || id), 13, 4) AS INTEGER) % 16 = 0")
def leaves(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select("type", "id").distinct().where(canonical.leaf_boundary(F.concat_ws("/", "type", "id"), 4))


_HASH = "list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), [CAST(ascii(c) AS HUGEINT) FOR c IN string_split(type || chr(1) || id, '')]), lambda h, u: (xor(CAST(h AS HUGEINT), CAST(CASE WHEN u = 1 THEN 0 ELSE u END AS HUGEINT)) * 16777619) % 4294967296)"


@query("O7_key_cuts", W + f""", k AS (SELECT DISTINCT type, id FROM E), a AS (SELECT type, id, {_HASH} AS h FROM k), b AS (SELECT type, id, (xor(h, h // 65536) * 2246822507) % 4294967296 AS h FROM a), c AS (SELECT type, id, (xor(h, h // 8192) * 3266489909) % 4294967296 AS h FROM b), d AS (SELECT type, id, xor(h, h // 65536) AS h FROM c) SELECT type, id FROM d WHERE h * 1000 < CAST(101 AS HUGEINT) * 4294967296""")
def key_cuts(spark: SparkSession, sf: str) -> DataFrame:
    k = entries(spark, sf).select("type", "id").distinct()
    return k.where(canonical.cuts(F.col("type"), F.col("id"), F.lit(100), 1000))


@query("A20_guessed_types", """WITH c AS (SELECT unnest(['c_custkey', 'c_acctbal', 'c_name', 'day', 'mixed', 'truth']) AS "column", unnest([CAST(c_custkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_name, '2024-02-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0'), CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'FALSE' END]) AS v FROM customer)
SELECT "column", CASE WHEN bool_and(regexp_matches(lower(v), '^(true|false|yes|no)$')) THEN 'true or false' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) % 1 = 0) THEN 'whole number' ELSE 'number' END WHEN bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) THEN 'date' ELSE 'text' END AS kind FROM c GROUP BY "column\"""")
def guessed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    day = F.concat(F.lit("2024-02-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_name", day.alias("day"), F.when(k % 9 == 0, "x").otherwise(k.cast("string")).alias("mixed"), F.when(k % 2 == 0, "yes").otherwise("FALSE").alias("truth"))
    return cells.guess_types(c, c.columns)


@query("F8_previews", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS shown FROM documents")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", cells.preview(F.col("text")).alias("shown"))


@query("G7_links", "SELECT doc_id, '/data/0' AS path, sha256(source) AS hash FROM documents")
def links(spark: SparkSession, sf: str) -> DataFrame:
    link = F.struct(F.concat(F.lit("ul:rec:"), F.sha2(F.col("source"), 256)).alias("$link"))
    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.array(link).alias("data"))).alias("j"))
    return d.select("doc_id", F.explode(canonical.links(F.col("j"))).alias("l")).select("doc_id", "l.path", "l.hash")


@query("X2_check_script", "SELECT count(*) AS problems, count(*) > 0 AS failed FROM part WHERE p_retailprice < 950 OR p_size IS NULL")
def check_script(spark: SparkSession, sf: str) -> DataFrame:
    return U.check_report(table(spark, sf, "part").where("p_retailprice < 950 OR p_size IS NULL"))
