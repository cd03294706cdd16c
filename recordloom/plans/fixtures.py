"""Versioned tables derived from the driver's: entries of a collection, a catalog over it, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, id, commit, kind, hash, size, seq): commits are days, an upload's last row of a key wins, and few hashes recur so that rewrites without a change occur."""
    e = table(spark, sf_dir, "events")
    commit = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1
    kind = F.when(F.col("event_id") % 10 == 0, "x").when(F.col("event_id") % 37 == 0, "w").otherwise("r")
    rows = e.select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("id"), commit.cast("int").alias("commit"), kind.alias("kind"), "event_id", "ts", F.length("props").cast("long").alias("size"))
    last = Window.partitionBy("type", "id", "commit").orderBy(F.desc("ts"), F.desc("event_id"))
    hashed = F.when(F.col("kind") != "x", F.sha2(F.concat_ws("|", "type", "id", (F.col("event_id") % 3).cast("string")), 256))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("type", "id", "commit", "kind", hashed.alias("hash"), F.when(F.col("kind") != "x", F.col("size")).alias("size"), F.col("event_id").alias("seq"))


ENTRIES = """E AS (SELECT type, id, "commit", kind, CASE WHEN kind <> 'x' THEN sha256(type || '|' || id || '|' || CAST(event_id % 3 AS VARCHAR)) END AS hash, CASE WHEN kind <> 'x' THEN size END AS size, event_id AS seq
FROM (SELECT event_type AS type, CAST(user_id AS VARCHAR) AS id, CAST(1 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS "commit", CASE WHEN event_id % 10 = 0 THEN 'x' WHEN event_id % 37 = 0 THEN 'w' ELSE 'r' END AS kind, event_id, CAST(length(props) AS BIGINT) AS size,
row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)"""


def state_sql(name: str, at: int) -> str:
    """A CTE of the newest entry of each key at a version, absent keys removed."""
    return f"""{name} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit" DESC) AS n FROM E WHERE "commit" <= {at}) WHERE n = 1 AND kind <> 'x')"""


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("org"), F.col("n_name").alias("org_name"))


ORGANIZATIONS = "organizations AS (SELECT CAST(n_nationkey AS BIGINT) AS org, n_name AS org_name FROM nation)"


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("collection"), F.col("c_nationkey").cast("long").alias("org"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tag"), (F.col("c_custkey") % 3 != 0).alias("public"))


COLLECTIONS = "collections AS (SELECT c_custkey AS collection, CAST(c_nationkey AS BIGINT) AS org, c_name AS name, c_mktsegment AS tag, c_custkey % 3 <> 0 AS public FROM customer)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of collections: records and bytes stand for the sizes a version was published with."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ts = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_custkey").alias("collection"), F.row_number().over(w).cast("long").alias("seq"), F.col("o_orderpriority").alias("message"), ts.alias("created"), F.col("o_orderkey").alias("version"), F.floor("o_totalprice").cast("long").alias("bytes"), (F.col("o_orderkey") % 50).alias("records"))


VERSIONS = """versions AS (SELECT o_custkey AS collection, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderpriority AS message, strftime(o_orderdate, '%Y-%m-%d') AS created, o_orderkey AS version, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderkey % 50 AS records FROM orders)"""


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection, type, seq, hash): the schema of a type as a collection's version sets it."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    v = versions(spark, sf_dir).select("collection", "seq", "version")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(v, F.col("l_orderkey") == F.col("version"))
    return rows.groupBy("collection", F.col("p_type").alias("type"), "seq").agg(F.sha2(F.min("p_brand"), 256).alias("hash"))


SCHEMA_ROWS = VERSIONS + """, schema_rows AS (SELECT collection, p_type AS type, seq, sha256(min(p_brand)) AS hash FROM lineitem JOIN part ON l_partkey = p_partkey JOIN versions ON l_orderkey = version GROUP BY collection, p_type, seq)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 25).alias("account"), F.col("user_id").alias("collection"), F.col("event_type").alias("metric"), (F.col("event_id") % 100).alias("amount"), "event_id")


USAGE = "usage AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 25 AS account, user_id AS collection, event_type AS metric, event_id % 100 AS amount, event_id FROM events)"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, collection, type, id, seq, op): a text is added to a source when its document comes, and leaves it a little later for some."""
    d = table(spark, sf_dir, "documents")
    base = d.select(F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("source").alias("collection"), F.col("lang").alias("type"), (F.col("doc_id") % 40).cast("string").alias("id"), F.col("doc_id").alias("seq"))
    gone = base.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 60).withColumn("op", F.lit("-"))
    return base.withColumn("op", F.lit("+")).unionByName(gone)


REFERENCES = """base AS (SELECT sha256(text) AS hash, source AS collection, lang AS type, CAST(doc_id % 40 AS VARCHAR) AS id, doc_id AS seq FROM documents), refs AS (SELECT *, '+' AS op FROM base UNION ALL SELECT hash, collection, type, id, seq + 60, '-' FROM base WHERE seq % 5 = 0)"""
