"""Queries of streams: each runs over what is there now and returns what it gave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import fresh_folder
from ..streaming import follow as S
from .fixtures import ENTRIES, VERSIONS, entries, state_sql, table, versions
from .registry import query

W = "WITH " + ENTRIES


def landed(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Entries in a folder that a stream can follow, some files at a time."""
    e = entries(spark, sf)
    at = fresh_folder(spark, "landed")
    e.repartition(6, "commit").write.parquet(at)
    return at, S.follow(spark, at, e.schema, files=2)


@query("T1_followed_commits", W + ' SELECT "commit", count(*) AS entries FROM E GROUP BY 1')
def followed_commits(spark: SparkSession, sf: str) -> DataFrame:
    return S.gathered(landed(spark, sf)[1]).groupBy("commit").agg(F.count("*").alias("entries"))


@query("T2_streamed_state", f"{W}, {state_sql('S', 30)} SELECT type, id, hash FROM S")
def streamed_state(spark: SparkSession, sf: str) -> DataFrame:
    """State tables kept batch by batch, in whatever order commits come."""
    at, stream = landed(spark, sf)
    S.keep_state(stream, f"{at}-state", f"{at}-checkpoint").awaitTermination()
    last = max(int(x.getPath().getName()) for x in _listed(spark, f"{at}-state"))
    return spark.read.parquet(f"{at}-state/{last}").where("kind <> 'x'").select("type", "id", "hash")


def _listed(spark: SparkSession, path: str) -> list:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return list(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at))


@query("T3_streamed_usage", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 25 AS account, user_id AS collection, event_type AS metric, CAST(sum(event_id % 100) AS BIGINT) AS amount FROM events GROUP BY 1, 2, 3, 4")
def streamed_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Events of which every fourth is delivered twice, summed by day."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("run").alias("r"), F.col("event_id").alias("i"), (F.col("user_id") % 25).alias("account"), F.col("user_id").alias("collection"), F.col("event_type").alias("metric"), (F.col("event_id") % 100).alias("amount"))
    at = fresh_folder(spark, "usage")
    e.unionByName(e.where("i % 4 = 0")).write.parquet(at)
    return S.gathered(S.daily_usage(S.follow(spark, at, e.schema), "60 days"), "update", ["day", "account", "collection", "metric"])


@query("T5_idle_sessions", "WITH x AS (SELECT user_id AS session, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), y AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT session, CAST(floor(epoch(min(ts))) AS BIGINT) AS opened, CAST(floor(epoch(max(ts) + INTERVAL 12 HOUR)) AS BIGINT) AS expires, count(*) AS uploads FROM y GROUP BY session, g")
def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session"))
    s = S.idle_sessions(e)
    return s.select("session", F.unix_seconds("opened").alias("opened"), F.unix_seconds("expires").alias("expires"), "uploads")


@query("K8_notices", f"WITH {VERSIONS}, v AS (SELECT collection, version, CASE version % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'patch' END AS bump FROM versions) SELECT 'h' || CAST(c_custkey AS VARCHAR) AS hook, v.collection, version, bump FROM v JOIN customer ON c_custkey = v.collection WHERE c_custkey % 4 <> 0 AND (bump = 'major' OR (bump = 'minor' AND c_custkey % 2 = 0)) AND version % 11 <> 0")
def notices(spark: SparkSession, sf: str) -> DataFrame:
    v = versions(spark, sf).select("collection", "version", F.element_at(F.array(F.lit("major"), F.lit("minor"), F.lit("patch")), (F.col("version") % 3 + 1).cast("int")).alias("bump"))
    k = F.col("c_custkey")
    hooks = table(spark, sf, "customer").select(F.concat(F.lit("h"), k.cast("string")).alias("hook"), k.alias("collection"), (k % 4 != 0).alias("enabled"), F.when(k % 2 == 0, F.array(F.lit("major"), F.lit("minor"))).otherwise(F.array(F.lit("major"))).alias("bumps"))
    sent = v.where("version % 11 = 0").select(F.concat(F.lit("h"), F.col("collection").cast("string")).alias("hook"), "version")
    return S.notices(v, hooks, sent)


@query("T6_retries", "SELECT o_orderkey AS delivery, o_orderkey % 7 + 1 AS attempt, CASE WHEN o_orderkey % 5 = 0 THEN 'delivered' WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 + 1 >= 5 THEN 'given up' ELSE 'again' END AS status, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 7 + 1 < 5 THEN 1000 + 60 * CAST(power(2, o_orderkey % 7) AS BIGINT) END AS next_at FROM orders")
def retries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    last = table(spark, sf, "orders").select(k.alias("delivery"), (k % 7 + 1).alias("attempt"), F.lit(1000).cast("long").alias("at"), (k % 5 == 0).alias("ok"), (k % 11 == 0).alias("terminal"))
    earlier = last.where("attempt > 1").withColumns({"attempt": F.lit(1).cast("long"), "at": F.lit(1).cast("long"), "ok": F.lit(False), "terminal": F.lit(False)})
    return S.retries(last.unionByName(earlier))


@query("T7_job_chain", "SELECT * FROM (VALUES (1, 'a,b'), (2, 'c'), (3, '')) AS t(call, ran)")
def job_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of three jobs under a budget of two, called three times."""
    ledger = fresh_folder(spark, "ledger")
    jobs = [(n, lambda: None) for n in "abc"]
    return spark.createDataFrame([(k, ",".join(S.run_chain(spark, ledger, jobs, 2))) for k in (1, 2, 3)], "call int, ran string")
