"""Queries of writes and upkeep over the entries fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions as V
from ..operators import write as M
from .fixtures import ENTRIES, VERSIONS, entries, state_sql, usage, versions
from .registry import query

W = "WITH " + ENTRIES
AB = f"{W}, {state_sql('A', 10)}, {state_sql('B', 20)}"
FULL = " FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash"


@query("M1_save_version", AB + ", X AS (SELECT coalesce(A.type, B.type) AS type, coalesce(A.id, B.id) AS id, CASE WHEN A.hash IS NULL THEN 'added' WHEN B.hash IS NULL THEN 'removed' ELSE 'changed' END AS op, B.hash AS hash" + FULL + ") SELECT * FROM X WHERE op <> 'removed' OR type IN ('view', 'click')")
def save(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.save(V.state(e, 10), V.state(e, 20), "set", F.col("type").isin("view", "click"))


@query("M2_without_no_ops", W + f', {state_sql("A", 19)} SELECT E.type, E.id, E.kind, E.hash FROM E LEFT JOIN A ON E.type = A.type AND E.id = A.id WHERE E."commit" = 20 AND E.hash IS DISTINCT FROM A.hash')
def no_ops(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.without_no_ops(e.where("commit = 20").select("type", "id", "kind", "hash"), V.state(e, 19))


@query("M3_set_routing", W + f""", {state_sql("S", 5)}, R AS (SELECT type, id, hash, CASE WHEN CAST(id AS INTEGER) % 2 = 0 THEN 'public' ELSE 'private' END AS s FROM S) SELECT type, id, s AS "set", 'upsert' AS op, hash FROM R UNION ALL SELECT type, id, CASE s WHEN 'public' THEN 'private' ELSE 'public' END, 'delete', NULL FROM R""")
def routing(spark: SparkSession, sf: str) -> DataFrame:
    s = V.state(entries(spark, sf), 5).withColumn("set", F.when(F.col("id").cast("int") % 2 == 0, "public").otherwise("private"))
    return M.route_sets(s)


@query("J4_carried_over", W + f', {state_sql("A", 19)} SELECT type, id, hash FROM A WHERE NOT EXISTS (SELECT 1 FROM E WHERE E."commit" = 20 AND E.type = A.type AND E.id = A.id)')
def carried(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.carried_over(V.state(e, 19), e.where("commit = 20")).select("type", "id", "hash")


@query("M4_rebuild_takedown", W + """, N AS (SELECT *, lead("commit") OVER (PARTITION BY type, id ORDER BY "commit") AS nx FROM E), K AS (SELECT * FROM N WHERE "commit" <= 30 AND (nx IS NULL OR nx > 20)), F AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit") AS f FROM K) SELECT type, id, "commit", CASE WHEN kind = 'r' AND substring(hash, 1, 1) = 'a' THEN 'w' ELSE kind END AS kind, hash FROM F WHERE NOT (f = 1 AND kind = 'x')""")
def rebuild(spark: SparkSession, sf: str) -> DataFrame:
    return M.rebuild(entries(spark, sf), [(20, 30)], F.col("hash").startswith("a")).select("type", "id", "commit", "kind", "hash")


@query("M13_squash", W + f""", {state_sql("A", 20)}, N AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit" DESC) AS n FROM E WHERE "commit" > 20) SELECT N.type, N.id, N.kind, N.hash FROM N LEFT JOIN A ON N.type = A.type AND N.id = A.id WHERE n = 1 AND N.hash IS DISTINCT FROM A.hash""")
def squash(spark: SparkSession, sf: str) -> DataFrame:
    return M.squash(entries(spark, sf), 20, 21).select("type", "id", "kind", "hash")


@query("A2_running_stats", W + """, L AS (SELECT "commit", hash, size, lag(hash) OVER w AS bh, lag(size) OVER w AS bs FROM E WINDOW w AS (PARTITION BY type, id ORDER BY "commit")), D AS (SELECT "commit", sum(CASE WHEN hash IS NULL AND bh IS NOT NULL THEN -1 WHEN hash IS NOT NULL AND bh IS NULL THEN 1 ELSE 0 END) AS d, sum(coalesce(size, 0) - coalesce(bs, 0)) AS b FROM L GROUP BY "commit") SELECT "commit", CAST(sum(d) OVER (ORDER BY "commit") AS BIGINT) AS records, CAST(sum(b) OVER (ORDER BY "commit") AS BIGINT) AS bytes FROM D""")
def running_stats(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("type", "id").orderBy("commit")
    e = entries(spark, sf).withColumn("bh", F.lag("hash").over(w)).withColumn("before_size", F.lag("size").over(w))
    change = F.when(F.col("hash").isNull() & F.col("bh").isNotNull(), "removed").when(F.col("hash").isNotNull() & F.col("bh").isNull(), "added").otherwise("same")
    return M.running_stats(e.select("commit", "before_size", F.col("size").alias("after_size"), change.alias("change")))


@query("M11_semvers", f"WITH {VERSIONS}, b AS (SELECT collection, seq, CASE WHEN row_number() OVER (PARTITION BY collection ORDER BY seq) = 1 OR version % 7 = 0 THEN 'major' WHEN version % 3 = 0 THEN 'minor' ELSE 'patch' END AS bump FROM versions), m AS (SELECT *, sum(CAST(bump = 'major' AS INTEGER)) OVER (PARTITION BY collection ORDER BY seq) AS a FROM b), n AS (SELECT *, sum(CAST(bump = 'minor' AS INTEGER)) OVER (PARTITION BY collection, a ORDER BY seq) AS i FROM m) SELECT collection, seq, CAST(a AS VARCHAR) || '.' || CAST(i AS VARCHAR) || '.' || CAST(sum(CAST(bump = 'patch' AS INTEGER)) OVER (PARTITION BY collection, a, i ORDER BY seq) AS VARCHAR) AS semver FROM n")
def semvers(spark: SparkSession, sf: str) -> DataFrame:
    v = versions(spark, sf).select("collection", "seq", M.bump_of(F.col("version") % 7 == 0, F.col("version") % 3 == 0).alias("bump"))
    return M.semvers(v).select("collection", "seq", "semver")


@query("M14_sweep", """WITH s AS (SELECT c_custkey AS name, CAST(floor(c_acctbal) AS BIGINT) AS bytes FROM customer WHERE c_custkey % 5 <> 0), l AS (SELECT c_custkey AS name FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT c_custkey AS name, c_custkey % 10 AS condemned FROM customer WHERE c_custkey % 4 = 0), t AS (SELECT c_custkey AS name, c_custkey % 10 AS trashed FROM customer WHERE c_custkey % 10 = 5)
SELECT name, bytes, CASE WHEN l.name IS NOT NULL AND s.name IS NULL AND t.name IS NOT NULL THEN 'restore' WHEN l.name IS NOT NULL AND s.name IS NULL THEN 'missing' WHEN l.name IS NOT NULL AND c.name IS NOT NULL THEN 'pardon' WHEN l.name IS NOT NULL THEN 'keep' WHEN t.name IS NOT NULL THEN CASE WHEN trashed + 5 <= 9 THEN 'purge' ELSE 'wait' END WHEN c.name IS NOT NULL AND s.name IS NOT NULL THEN CASE WHEN condemned + 5 <= 9 THEN 'trash' ELSE 'wait' END WHEN s.name IS NOT NULL THEN 'condemn' ELSE 'forget' END AS verdict FROM s FULL JOIN l USING (name) FULL JOIN c USING (name) FULL JOIN t USING (name)""")
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    name = F.col("c_custkey").alias("name")
    stored = c.where("c_custkey % 5 <> 0").select(name, F.floor("c_acctbal").cast("long").alias("bytes"))
    listed = c.where("c_custkey % 3 = 0").select(name)
    ledger = c.where("c_custkey % 4 = 0").select(name, (F.col("c_custkey") % 10).alias("condemned"))
    trash = c.where("c_custkey % 10 = 5").select(name, (F.col("c_custkey") % 10).alias("trashed"))
    return M.sweep(stored, listed, ledger, trash, 9, 5)


@query("U5_new_nodes", AB + " SELECT DISTINCT hash FROM B WHERE hash NOT IN (SELECT hash FROM A)")
def new_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.new_nodes(V.state(e, 20), V.state(e, 10))


@query("M25_reclaim", W + f', {state_sql("A", 10)}, {state_sql("B", 20)} SELECT type, id, "commit", hash FROM E WHERE hash IS NOT NULL AND EXISTS (SELECT 1 FROM (SELECT type, id, hash FROM A UNION SELECT type, id, hash FROM B) r WHERE r.type = E.type AND r.id = E.id AND r.hash = E.hash)')
def reclaim(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    reached = V.state(e, 10).select("type", "id", "hash").unionByName(V.state(e, 20).select("type", "id", "hash"))
    return M.reclaim(e.where("hash IS NOT NULL"), reached, ["type", "id", "hash"]).select("type", "id", "commit", "hash")


@query("J15_delta", AB + " SELECT type, id, 'upsert' AS op, hash FROM B WHERE NOT EXISTS (SELECT 1 FROM A WHERE A.type = B.type AND A.id = B.id AND A.hash = B.hash) UNION ALL SELECT type, id, 'delete', NULL FROM A WHERE NOT EXISTS (SELECT 1 FROM B WHERE A.type = B.type AND A.id = B.id)")
def delta(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.delta(V.state(e, 10), V.state(e, 20))


@query("J16_match_ids", W + f", {state_sql('S', 30)}, v AS (SELECT DISTINCT * FROM (SELECT 'custkey' AS \"column\", CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT 'segment', c_mktsegment FROM customer)), o AS (SELECT \"column\", count(*) AS of_ FROM v GROUP BY 1) SELECT 'c' AS collection, type, v.\"column\", count(*) AS hits, any_value(of_) AS \"of\" FROM v JOIN (SELECT DISTINCT type, id FROM S) s ON value = id JOIN o ON o.\"column\" = v.\"column\" GROUP BY type, v.\"column\"")
def match_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    cells = c.select(F.explode(F.create_map(F.lit("custkey"), F.col("c_custkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))).alias("column", "value"))
    ids = V.state(entries(spark, sf), 30).select(F.lit("c").alias("collection"), "type", "id")
    return M.match_ids(cells, ids)


@query("M18_reconcile", f"WITH {VERSIONS}, n AS (SELECT collection, count(*) AS actual FROM versions GROUP BY collection), k AS (SELECT c_custkey AS collection, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE actual END AS stored FROM customer LEFT JOIN n ON collection = c_custkey) SELECT coalesce(k.collection, n.collection) AS collection, CAST(stored AS BIGINT) AS stored, actual FROM k FULL JOIN n USING (collection) WHERE stored IS DISTINCT FROM actual")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    n = versions(spark, sf).groupBy("collection").agg(F.count("*").alias("n"))
    stored = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("collection")).join(n, "collection", "left")
    return M.reconcile(stored.select("collection", F.when(F.col("collection") % 9 == 0, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n")), n, "collection", "n")


@query("M19_usage_rollup", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 25 AS account, event_type AS metric, CAST(sum(event_id % 100) AS BIGINT) AS amount FROM events GROUP BY ALL")
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    twice = usage(spark, sf).unionByName(usage(spark, sf).where("event_id % 4 = 0"))  # delivered at least once
    return M.usage_rollup(twice, "event_id", ["day", "account", "metric"])


@query("A14_usage_upsert", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 25 AS account, event_type AS metric, CAST(sum(event_id % 100) AS BIGINT) AS amount FROM events GROUP BY ALL")
def usage_upsert(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["day", "account", "metric"]
    u = usage(spark, sf)
    return M.add_usage(M.usage_rollup(u.where("event_id % 3 <> 0"), "event_id", keys), u.where("event_id % 3 = 0"), keys)


@query("V8_verify_log", f"WITH {VERSIONS}, c AS (SELECT collection, CASE WHEN version % 40 = 0 THEN seq + 1 ELSE seq END AS number, version, seq FROM versions), g AS (SELECT collection, number, lag(number) OVER (PARTITION BY collection ORDER BY number) AS p FROM (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.collection = c.collection AND d.number = c.number AND d.version <> c.version AND d.seq < c.seq))) SELECT collection, number, 'gap' AS problem FROM g WHERE (p IS NULL AND number <> 1) OR number - p <> 1")
def verify_log(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    v = versions(spark, sf).withColumn("number", F.when(F.col("version") % 40 == 0, F.col("seq") + 1).otherwise(F.col("seq")))
    v = M.last_wins(v.withColumn("_o", -F.col("seq")), ["collection", "number"], ["_o"]).drop("_o")
    w = Window.partitionBy("collection").orderBy("number")
    hashed = v.withColumn("hash", F.sha2(F.col("version").cast("string"), 256))
    return M.verify_log(hashed.withColumn("previous", F.lag("hash").over(w)).withColumn("base", F.col("number") - 1))
