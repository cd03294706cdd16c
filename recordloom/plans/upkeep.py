"""Queries of trees, layouts, reserved views, manifests and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..operators import layouts as L
from ..operators import trees as T
from ..operators import uploads as U
from ..operators import versions as V
from ..operators import write as M
from ..sources.store import export_lines
from .fixtures import ENTRIES, VERSIONS, entries, state_sql, table, versions
from .registry import query

W = "WITH " + ENTRIES
S20 = f"{W}, {state_sql('S', 20)}"
_RUNS = """, b AS (SELECT *, CAST('0x' || substring(sha256(id), 13, 4) AS INTEGER) % 8 = 0 AS e, row_number() OVER (PARTITION BY type ORDER BY id) AS n FROM S), g AS (SELECT *, coalesce(max(CASE WHEN e THEN n END) OVER (PARTITION BY type ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b), l AS (SELECT type, s + ((n - 1 - s) // 6) * 6 AS run, id, hash, size FROM g), leaf AS (SELECT type, run, max(id) AS last_key, count(*) AS count, CAST(sum(size) AS BIGINT) AS bytes, sha256('{"e":[' || string_agg('["' || id || '","' || hash || '",' || CAST(size AS VARCHAR) || ']', ',' ORDER BY id) || '],"t":"leaf"}') AS hash FROM l GROUP BY type, run)"""


@query("M15_tree_leaves", S20 + _RUNS + " SELECT type, last_key, count, bytes, hash FROM leaf")
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return T.leaves(V.state(entries(spark, sf), 20), 3, 6).drop("run")


_TREE = (3, 6, 2, 16)


def _nodes_sql(level: int, below: str) -> str:
    """CTEs of a level's nodes over the level below, of types that still have several."""
    k, bits = level, 3 + 2 * level
    return f""", p{k} AS (SELECT * FROM {below} WHERE type IN (SELECT type FROM {below} GROUP BY type HAVING count(*) > 1)),
b{k} AS (SELECT *, CAST('0x' || substring(sha256(last_key), 13, 4) AS INTEGER) % {1 << bits} = 0 AS e, row_number() OVER (PARTITION BY type ORDER BY last_key) AS n FROM p{k}),
g{k} AS (SELECT *, coalesce(max(CASE WHEN e THEN n END) OVER (PARTITION BY type ORDER BY last_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b{k}),
n{k} AS (SELECT type, run, max(last_key) AS last_key, CAST(sum(count) AS BIGINT) AS count, CAST(sum(bytes) AS BIGINT) AS bytes, sha256('{{"e":[' || string_agg('["' || last_key || '","' || hash || '",' || CAST(count AS VARCHAR) || ',' || CAST(bytes AS VARCHAR) || ']', ',' ORDER BY last_key) || '],"l":{k},"t":"node"}}') AS hash FROM (SELECT type, s + ((n - 1 - s) // 16) * 16 AS run, last_key, count, bytes, hash FROM g{k}) GROUP BY type, run)"""


def roots_sql(version: int, levels: int = 5) -> str:
    """A query of the roots of a version's trees, level by level."""
    below = ["leaf", *(f"n{k}" for k in range(1, levels + 1))]
    ctes = "".join(_nodes_sql(k, below[k - 1]) for k in range(1, levels + 1))
    return f"{W}, {state_sql('S', version)}" + _RUNS + ctes + " " + " UNION ALL ".join(f"SELECT type, hash, count, bytes FROM {t} WHERE type IN (SELECT type FROM {t} GROUP BY type HAVING count(*) = 1)" for t in below)


@query("M15_tree_roots", roots_sql(20))
def tree_roots(spark: SparkSession, sf: str) -> DataFrame:
    return T.roots(V.state(entries(spark, sf), 20), *_TREE)


@query("V9_verify_tree", f"SELECT type, CASE type WHEN 'view' THEN 'count' WHEN 'click' THEN 'hash' ELSE 'not told' END AS problem FROM ({roots_sql(20)}) WHERE type IN ('view', 'click', 'error') UNION ALL SELECT 'none', 'no records'")
def verify_tree(spark: SparkSession, sf: str) -> DataFrame:
    s = V.state(entries(spark, sf), 20)
    t = T.roots(s, *_TREE).where("type <> 'error'")
    t = t.withColumn("count", F.col("count") + F.when(F.col("type") == "view", 1).otherwise(0)).withColumn("hash", F.when(F.col("type") == "click", F.lit("0")).otherwise(F.col("hash")))
    none = spark.createDataFrame([("none", "0", 1, 1)], "type string, hash string, count long, bytes long")
    return T.verify_tree(t.unionByName(none), s, *_TREE)


@query("M16_commit_roots", f"WITH now AS ({roots_sql(20)}), old AS ({roots_sql(19)}) SELECT now.type, now.hash, now.count, now.bytes, old.hash AS was FROM now LEFT JOIN old ON now.type = old.type WHERE now.hash IS DISTINCT FROM old.hash")
def commit_roots(spark: SparkSession, sf: str) -> DataFrame:
    return T.commit_roots(entries(spark, sf), 20, *_TREE)


@query("S7_leaf_scan", S20 + _RUNS + " SELECT type, run, id, hash FROM l")
def leaf_scan(spark: SparkSession, sf: str) -> DataFrame:
    return T.leaf_rows(V.state(entries(spark, sf), 20), 3, 6).orderBy("type", "run", "id").select("type", "run", "id", "hash")


@query("R13_tree_diff", f"{W}, {state_sql('A', 18)}, {state_sql('B', 20)} SELECT coalesce(A.type, B.type) AS type, coalesce(A.id, B.id) AS id, A.hash AS before_hash, B.hash AS after_hash FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash")
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return T.tree_diff(V.state(e, 18), V.state(e, 20), 3, 6)


@query("R15_reserved_views", S20 + ", R AS (SELECT CASE type WHEN 'error' THEN '$schema' WHEN 'signup' THEN '$asset' ELSE type END AS type, id, hash FROM S) SELECT type, id, hash FROM R WHERE type LIKE '$%'")
def reserved(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).replace({"error": "$schema", "signup": "$asset"}, subset=["type"])
    return V.state(e.where(F.col("type").startswith("$")), 20).select("type", "id", "hash")


@query("K1_export_lines", S20 + " SELECT '{\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"data\":' || CAST(size AS VARCHAR) || ',\"hash\":\"' || hash || '\"}' AS value FROM S WHERE kind = 'r'")
def lines(spark: SparkSession, sf: str) -> DataFrame:
    s = V.live(V.state(entries(spark, sf), 20))
    line = F.to_json(F.struct("id", "type", F.col("size").alias("data")))
    return export_lines(s.withColumn("line", line))


@query("K4_manifest_delta", f"{W}, {state_sql('A', 10)}, {state_sql('B', 20)} SELECT B.type, B.id, B.hash, A.hash AS previous_hash FROM B LEFT JOIN A ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash")
def manifest_delta(spark: SparkSession, sf: str) -> DataFrame:
    return V.diff(entries(spark, sf), 10, 20).where("after_hash IS NOT NULL").select("type", "id", F.col("after_hash").alias("hash"), F.col("before_hash").alias("previous_hash"))


@query("R17_cursor_page", S20 + " SELECT type, id, rn > 50 AS probe FROM (SELECT type, id, row_number() OVER (ORDER BY type, id) AS rn FROM S WHERE type = 'view') WHERE rn <= 51")
def cursor_page(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    page = V.page(V.state(entries(spark, sf), 20), 51, V.key_range(only="view")).select("type", "id")  # one more than asked for tells whether there is more
    return page.withColumn("probe", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("type", "id")) > 50)


@query("A3_full_stats", S20 + " SELECT count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM S")
def full_stats(spark: SparkSession, sf: str) -> DataFrame:
    return V.state(entries(spark, sf), 20).agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


@query("A15_diff_counts", f"{W}, {state_sql('A', 10)}, {state_sql('B', 20)}, X AS (SELECT coalesce(A.type, B.type) AS type, CASE WHEN A.hash IS NULL THEN 'added' WHEN B.hash IS NULL THEN 'removed' ELSE 'updated' END AS change FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash) SELECT type, change, count(*) AS n FROM X GROUP BY ALL")
def diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.diff_counts(V.diff(entries(spark, sf), 10, 20))


@query("A15_changed_fields", "SELECT p_partkey AS k, field FROM (SELECT p_partkey, unnest(list_filter(['brand', 'size', 'note'], lambda f: (f = 'brand' AND p_partkey % 3 = 0) OR (f = 'size' AND p_partkey % 2 = 0) OR (f = 'note' AND p_partkey % 5 = 0))) AS field FROM part)")
def changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    before = F.map_from_arrays(F.array(F.lit("brand"), F.lit("size")), F.array("p_brand", F.col("p_size").cast("string")))
    after = F.map_concat(
        F.map_from_arrays(F.array(F.lit("brand"), F.lit("size")), F.array(F.when(k % 3 == 0, F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand")), F.when(k % 2 == 0, F.lit("none")).otherwise(F.col("p_size").cast("string")))),
        F.when(k % 5 == 0, F.map_from_arrays(F.array(F.lit("note")), F.array(F.lit("x")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
    )
    rows = table(spark, sf, "part").select(k.alias("k"), before.alias("a"), after.alias("b"))
    return rows.select("k", F.explode(M.changed_fields(F.col("a"), F.col("b"))).alias("field"))


@query("A21_collection_stats", W + """, f AS (SELECT DISTINCT type AS collection, "commit" % 7 AS file FROM E), b AS (SELECT "commit" % 7 AS file, count(*) AS entries, CAST(coalesce(sum(size), 0) AS BIGINT) AS line_bytes FROM E GROUP BY 1) SELECT collection, count(*) AS files, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(line_bytes) AS BIGINT) AS line_bytes, CAST(sum(line_bytes // 3) AS BIGINT) AS stored_bytes FROM f JOIN b USING (file) GROUP BY collection""")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).withColumn("file", F.col("commit") % 7)
    built = e.groupBy("file").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("line_bytes"))
    files = e.select(F.col("type").alias("collection"), "file", "commit").distinct().join(built, "file").withColumn("stored_bytes", F.floor(F.col("line_bytes") / 3))
    return M.collection_stats(files)


@query("A24_drop_accounting", f"WITH {VERSIONS}, f AS (SELECT collection % 5 AS collection, version % 700 AS file, max(records) AS records, max(bytes) AS bytes FROM versions GROUP BY 1, 2) SELECT file IN (SELECT file FROM f WHERE collection <> 3) AS kept, count(*) AS files, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM f WHERE collection = 3 GROUP BY 1")
def drop_accounting(spark: SparkSession, sf: str) -> DataFrame:
    v = versions(spark, sf)
    files = v.groupBy((F.col("collection") % 5).alias("collection"), (F.col("version") % 700).alias("file")).agg(F.max("records").alias("records"), F.max("bytes").alias("bytes"))
    return L.still_needed(files, 3)


@query("M12_fork_log", f"WITH {VERSIONS} SELECT 'f' || CAST(collection AS VARCHAR) AS collection, seq AS number, version FROM versions WHERE collection = 7 AND seq <= 4")
def fork_log(spark: SparkSession, sf: str) -> DataFrame:
    return L.fork(versions(spark, sf).where("collection = 7").select(F.col("seq").alias("number"), "version"), "f7", 4)


@query("M17_reference_log", W + """, x AS (SELECT *, lag(hash) OVER (PARTITION BY type, id ORDER BY "commit") AS b FROM E) SELECT hash, type, id, "commit" AS seq, '+' AS op FROM x WHERE hash IS NOT NULL AND hash IS DISTINCT FROM b UNION ALL SELECT b, type, id, "commit", '-' FROM x WHERE b IS NOT NULL AND hash IS DISTINCT FROM b""")
def reference_log(spark: SparkSession, sf: str) -> DataFrame:
    c = V.changes_of_state(entries(spark, sf))
    ops = F.array(F.struct(F.col("hash").alias("hash"), F.lit("+").alias("op")), F.struct(F.col("before").alias("hash"), F.lit("-").alias("op")))
    return c.select("type", "id", F.col("commit").alias("seq"), F.explode(ops).alias("o")).select("o.hash", "type", "id", "seq", "o.op").where("hash IS NOT NULL")


@query("M20_offset_index_page", S20 + " SELECT type, id FROM S WHERE type = 'view' ORDER BY id LIMIT 20 OFFSET 70")
def offset_index(spark: SparkSession, sf: str) -> DataFrame:
    s = V.state(entries(spark, sf), 20)
    return L.offset_page(V.marks(s, 16), s, "view", 70, 20, 16).select("type", "id")


@query("J19_shifted_marks", S20 + f", {state_sql('N', 21)}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM S WHERE type = 'view'), d AS (SELECT coalesce(S.id, N.id) AS id, CASE WHEN S.id IS NULL THEN 1 ELSE -1 END AS delta FROM (SELECT id FROM S WHERE type = 'view') S FULL JOIN (SELECT id FROM N WHERE type = 'view') N ON S.id = N.id WHERE S.id IS NULL OR N.id IS NULL) SELECT m.id, CAST(position + coalesce((SELECT sum(delta) FROM d WHERE d.id < m.id), 0) AS BIGINT) AS position FROM m WHERE position % 16 = 0")
def shifted_marks(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).where("type = 'view'")
    marks = V.marks(V.state(e, 20), 16)
    changed = V.diff(e, 20, 21).where("change <> 'updated'").select("id", F.when(F.col("change") == "added", 1).otherwise(-1).alias("delta"))
    return L.shifted(marks, changed)


@query("M22_layered_values", W + ', k AS (SELECT DISTINCT id FROM E) SELECT id AS key, hash AS value FROM (SELECT id, hash, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM E WHERE hash IS NOT NULL AND id IN (SELECT id FROM k)) WHERE n = 1')
def layered(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).where("hash IS NOT NULL").select(F.col("seq").alias("layer"), F.col("id").alias("key"), F.col("hash").alias("value"))
    return L.layered_values(e, e)


@query("M26_sweepable", "SELECT o_orderkey AS object FROM orders WHERE o_orderkey % 9 + 3 <= 8 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 2 = 0)")
def sweepable(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("version"), F.col("l_orderkey").alias("object"))
    kept = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("version")).where("version % 2 = 0")
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("object"), (F.col("o_orderkey") % 9).alias("created"))
    return L.sweepable(stored, L.reachable(kept, l), 8, 3).select("object")


@query("O7_files_of_commits", W + ' SELECT "commit", count(*) AS entries FROM E GROUP BY "commit"')
def files(spark: SparkSession, sf: str) -> DataFrame:
    return L.files_of(entries(spark, sf), 400).groupBy("commit").agg(F.sum("entries").alias("entries"))


@query("U3_visible_files", "SELECT DISTINCT file FROM (SELECT sha256(source || lang) AS file FROM documents UNION ALL SELECT sha256(lang) FROM documents) ORDER BY file LIMIT 50")
def visible_files(spark: SparkSession, sf: str) -> DataFrame:
    """At most 50 are asked for, which is the operator's cap."""
    d = table(spark, sf, "documents")
    return M.visible_files(d.select(F.sha2(F.concat("source", "lang"), 256).alias("file")), d.select(F.sha2("lang", 256).alias("file")), True, 50)


@query("U2_merge_cumulative", "SELECT text AS file, max(length(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY text")
def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("text").alias("file"), F.length("text").cast("long").alias("size"), "doc_id")
    return M.merge_cumulative(d.where("doc_id % 3 = 0").dropDuplicates(["file"]), d.where("doc_id % 2 = 0 OR doc_id % 3 <> 0"))


@query("U1_merge_runs", W + ' SELECT type, id, hash FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit" DESC) AS n FROM E WHERE "commit" IN (3, 4, 5)) WHERE n = 1')
def merge_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.merge_runs([e.where(F.col("commit") == n) for n in (3, 4, 5)]).select("type", "id", "hash")


@query("M7_recreate_commit", W + ' SELECT type, id, kind, hash FROM E WHERE "commit" = 14')
def recreate(spark: SparkSession, sf: str) -> DataFrame:
    return M.rebuild(entries(spark, sf), [(1, 30)]).where("commit = 14").unionByName(entries(spark, sf).where("commit = 14 AND kind = 'x'")).dropDuplicates(["type", "id"]).select("type", "id", "kind", "hash")


_HOURS = 6 * 3600


@query("T4_rate_windows", f"WITH RECURSIVE h AS (SELECT user_id AS caller, CAST(floor(epoch(ts)) AS BIGINT) AS sec, count(*) AS n FROM events GROUP BY 1, 2), x AS (SELECT caller, sec, min(sec) OVER (PARTITION BY caller ORDER BY sec RANGE BETWEEN {_HOURS} FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, row_number() OVER (PARTITION BY caller ORDER BY sec) AS rn FROM h), w(caller, opened, nx) AS (SELECT caller, sec, nx FROM x WHERE rn = 1 UNION ALL SELECT x.caller, x.sec, x.nx FROM w JOIN x ON x.caller = w.caller AND x.sec = w.nx) SELECT w.caller, opened, CAST(sum(n) AS BIGINT) AS hits FROM w JOIN h ON h.caller = w.caller AND h.sec >= opened AND h.sec < opened + {_HOURS} GROUP BY w.caller, opened")
def rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    return L.windows(table(spark, sf, "events").select(F.col("user_id").alias("caller"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")), _HOURS)


@query("F9_extra_fields", "SELECT p_partkey AS k, field FROM (SELECT p_partkey, unnest(['p_brand', 'p_type']) AS field FROM part)")
def extra_fields(spark: SparkSession, sf: str) -> DataFrame:
    data = F.to_json(F.struct("p_name", "p_brand", "p_type"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), data.alias("data"))
    return rows.select("k", F.explode(schemas.extra_fields(F.col("data"), {"properties": {"p_name": {}, "p_size": {}}})).alias("field"))


@query("F9_stripped", "SELECT p_partkey AS k, '{\"p_name\":\"' || p_name || '\",\"p_size\":' || CAST(p_size AS VARCHAR) || '}' AS data FROM part")
def stripped(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.to_json(F.struct("p_name", "p_brand", "p_size")).alias("data"))
    return rows.select("k", schemas.stripped(F.col("data"), {"properties": {"p_size": {}, "p_name": {}}}).alias("data"))


@query("F11_scoped_save", W + f", {state_sql('A', 10)}, {state_sql('B', 20)} SELECT A.type, A.id, 'removed' AS op FROM A LEFT JOIN B ON A.type = B.type AND A.id = B.id WHERE B.id IS NULL AND A.type = 'click' AND CAST(A.id AS INTEGER) < 60")
def scoped_save(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    scope = (F.col("type") == "click") & (F.col("id").cast("int") < 60)
    return M.save(V.state(e, 10), V.state(e, 20), "set", scope).where("op = 'removed'").drop("hash")


@query("X3_held_rows", "SELECT o_orderkey AS k, 'additions' AS mode FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 6 = 0)")
def held_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey")).alias("id"))
    decisions = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    _, held, mode = U.import_plan(rows, decisions, "k")
    return held.select("k", F.lit(mode).alias("mode"))
