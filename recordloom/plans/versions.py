"""Queries over versions of the entries fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions as V
from .fixtures import ENTRIES, entries, state_sql
from .registry import query

W = "WITH " + ENTRIES
S15 = f"{W}, {state_sql('S', 15)} "


@query("R6_counts_by_type", S15 + "SELECT type, count(*) AS records, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM S GROUP BY type")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.counts(V.state(entries(spark, sf), 15))


@query("S1_view_entries", W + ' SELECT type, id, "commit", kind FROM E WHERE "commit" <= 12')
def view(spark: SparkSession, sf: str) -> DataFrame:
    return V.open_view(entries(spark, sf), 12, 30, [(10, 30)]).select("type", "id", "commit", "kind")


@query("R1_point_read", W + """, T AS (SELECT * FROM E WHERE type = 'view' AND id = '7' AND "commit" <= 20 ORDER BY "commit" DESC LIMIT 1) SELECT type, id, "commit", kind, hash, size FROM T WHERE kind <> 'x'""")
def point(spark: SparkSession, sf: str) -> DataFrame:
    return V.get_record(entries(spark, sf), 20, "view", "7").drop("seq")


_KEYS = [("view", "7", 0), ("click", "12", 1), ("nothing", "1", 2), ("error", "44", 3), ("view", "7", 4)]


@query("R2_states_at", S15 + ", K(type, id, ordinal) AS (VALUES " + ", ".join(f"('{t}', '{i}', {n})" for t, i, n in _KEYS) + ") SELECT ordinal, K.type, K.id, hash, size, \"commit\", kind = 'w' AS withheld FROM K LEFT JOIN S ON K.type = S.type AND K.id = S.id")
def states(spark: SparkSession, sf: str) -> DataFrame:
    return V.states_at(entries(spark, sf), 15, spark.createDataFrame(_KEYS, "type string, id string, ordinal int"))


@query("R3_merge_groups", W + """ SELECT type, id, count(*) AS n, string_agg(kind, '' ORDER BY "commit") AS kinds, string_agg(CAST("commit" AS VARCHAR), ',' ORDER BY "commit") AS commits FROM E WHERE "commit" <= 15 GROUP BY type, id""")
def merge_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = V.groups(entries(spark, sf), 15)
    return g.select("type", "id", F.size("entries").cast("long").alias("n"), F.array_join("entries.kind", "").alias("kinds"), F.array_join(F.transform("entries.commit", lambda c: c.cast("string")), ",").alias("commits"))


@query("R4_page", S15 + "SELECT type, id, hash FROM S WHERE type > 'error' OR (type = 'error' AND id > '3') ORDER BY type, id LIMIT 100")
def page(spark: SparkSession, sf: str) -> DataFrame:
    return V.page(V.state(entries(spark, sf), 15), 100, V.key_range(after=("error", "3"))).select("type", "id", "hash")


@query("F1_key_range", W + ", " + state_sql("S", 30) + " SELECT type, id FROM S WHERE (type > 'click' OR (type = 'click' AND id >= '2')) AND (type < 'view' OR (type = 'view' AND id < '30')) AND type = 'view'")
def ranged(spark: SparkSession, sf: str) -> DataFrame:
    return V.state(entries(spark, sf), 30).where(V.key_range(start=("click", "2"), stop=("view", "30"), only="view")).select("type", "id")


@query("R5_export_all", S15 + 'SELECT type, id, hash, size, "commit", kind FROM S')
def export(spark: SparkSession, sf: str) -> DataFrame:
    return V.export(V.state(entries(spark, sf), 15)).select("type", "id", "hash", "size", "commit", "kind")


_DENIED = " D AS (SELECT DISTINCT hash FROM E WHERE seq % 97 = 0 AND hash IS NOT NULL)"


@query("F2_live_records", f"{W}, {state_sql('S', 30)},{_DENIED} SELECT type, id, hash FROM S WHERE kind = 'r' AND type NOT LIKE '$%' AND hash NOT IN (SELECT hash FROM D)")
def live(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return V.live(V.state(e, 30), e.where("seq % 97 = 0 AND hash IS NOT NULL")).select("type", "id", "hash")


@query("F3_denylist_diff", f"{W}, {state_sql('A', 10)}, {state_sql('B', 20)},{_DENIED} SELECT coalesce(A.type, B.type) AS type, coalesce(A.id, B.id) AS id, B.hash AS after_hash FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash AND (B.hash IS NULL OR B.hash NOT IN (SELECT hash FROM D))")
def denied_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    denied = e.where("seq % 97 = 0 AND hash IS NOT NULL").select(F.col("hash").alias("after_hash")).distinct()
    return V.diff(e, 10, 20).join(denied, "after_hash", "left_anti").select("type", "id", "after_hash")


@query("R7_history", W + """ SELECT "commit", kind, hash, size FROM E WHERE type = 'click' AND id = '5' AND "commit" <= 25""")
def history(spark: SparkSession, sf: str) -> DataFrame:
    return V.history(entries(spark, sf), 25, "click", "5").select("commit", "kind", "hash", "size")


@query("R8_labelled_history", W + """, L AS (SELECT *, lag(hash) OVER (PARTITION BY type, id ORDER BY "commit") AS before FROM E) SELECT type, id, "commit", hash, CASE WHEN hash IS NULL THEN 'removed' WHEN before IS NULL THEN 'added' ELSE 'updated' END AS label FROM L WHERE hash IS DISTINCT FROM before""")
def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return V.changes_of_state(entries(spark, sf)).select("type", "id", "commit", "hash", "label")


@query("R9_changes", W + """, T AS (SELECT DISTINCT type, id FROM E WHERE "commit" > 18 AND "commit" <= 20), N AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit" DESC) AS n FROM E WHERE "commit" <= 20) SELECT type, id, "commit", kind, hash FROM N JOIN T USING (type, id) WHERE n = 1""")
def changed(spark: SparkSession, sf: str) -> DataFrame:
    return V.changes(entries(spark, sf), 18, 20).select("type", "id", "commit", "kind", "hash")


_DIFF = f"{W}, {state_sql('A', 10)}, {state_sql('B', 20)}, X AS (SELECT coalesce(A.type, B.type) AS type, coalesce(A.id, B.id) AS id, A.hash AS before_hash, B.hash AS after_hash, A.size AS before_size, B.size AS after_size, CASE WHEN A.hash IS NULL THEN 'added' WHEN B.hash IS NULL THEN 'removed' ELSE 'updated' END AS change FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash) "


@query("R10_diff", _DIFF + "SELECT * FROM X")
def diff(spark: SparkSession, sf: str) -> DataFrame:
    return V.diff(entries(spark, sf), 10, 20)


@query("R11_diff_page", _DIFF + ", P AS (SELECT * FROM X ORDER BY type, id LIMIT 200), R AS (SELECT *, sum(coalesce(after_size, 0)) OVER (ORDER BY type, id ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (ORDER BY type, id) AS n FROM P) SELECT type, id, change, after_hash FROM R WHERE s <= 900 OR n = 1")
def diff_page(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = V.split_diff(V.diff(entries(spark, sf), 10, 20))
    return V.pages_by_bytes(rows, "after_size", 200, 900).select("type", "id", "change", "after_hash")


@query("R11_diff_meta", W + ", R AS (SELECT CASE type WHEN 'error' THEN '$schema' WHEN 'click' THEN '$asset' ELSE type END AS type, change FROM (" + _DIFF.replace("WITH ", "WITH ", 1) + "SELECT * FROM X)) SELECT max(type = '$schema') AS schema_changed, max(type = '$meta') AS metadata_changed, CAST(count(*) FILTER (type = '$asset' AND change = 'added') AS BIGINT) AS files_added, CAST(count(*) FILTER (type = '$asset' AND change = 'removed') AS BIGINT) AS files_removed FROM R WHERE type LIKE '$%'")
def diff_meta(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).replace({"error": "$schema", "click": "$asset"}, subset=["type"])
    return V.split_diff(V.diff(e, 10, 20))[1]


_SETS = "CASE WHEN (CAST(id AS INTEGER) + \"commit\") % 4 = 0 THEN 'private' ELSE 'public' END AS \"set\""


@query("R12_diff_sets", f"{W}, {state_sql('A0', 10)}, {state_sql('B0', 20)}, A AS (SELECT *, {_SETS} FROM A0), B AS (SELECT *, {_SETS} FROM B0) SELECT coalesce(A.type, B.type) AS type, coalesce(A.id, B.id) AS id, A.hash AS before_hash, A.\"set\" AS before_set, B.hash AS after_hash, B.\"set\" AS after_set FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash OR A.\"set\" IS DISTINCT FROM B.\"set\"")
def diff_sets(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    side = F.when((F.col("id").cast("int") + F.col("commit")) % 4 == 0, "private").otherwise("public")
    return V.diff_sets(V.state(e, 10).withColumn("set", side), V.state(e, 20).withColumn("set", side), moves=True)


@query("R14_conflicts", W + """, M AS (SELECT type, id, hash AS mine FROM E WHERE "commit" = 20), T AS (SELECT type, id, hash AS theirs, "commit" AS their_commit, row_number() OVER (PARTITION BY type, id ORDER BY "commit" DESC) AS n FROM E WHERE "commit" > 16 AND "commit" <= 19) SELECT M.type, M.id, mine, theirs, their_commit FROM M JOIN T USING (type, id) WHERE n = 1""")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return V.conflicts(entries(spark, sf), 16, 20)


@query("R16_offset_page", S15 + "SELECT type, id FROM S WHERE kind = 'r' ORDER BY type, id LIMIT 50 OFFSET 200")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return V.offset_page(V.live(V.state(entries(spark, sf), 15)), 200, 50).select("type", "id")


@query("R18_rank", S15 + "SELECT count(*) FILTER (type < 'error' OR (type = 'error' AND id < '50')) AS rank, count(*) FILTER (type > 'error' OR (type = 'error' AND id > '50')) AS after FROM S")
def rank(spark: SparkSession, sf: str) -> DataFrame:
    return V.rank_of(V.state(entries(spark, sf), 15), "error", "50")


@query("R18_entry_at", S15 + "SELECT type, id, hash FROM S ORDER BY type, id LIMIT 1 OFFSET 123")
def entry_at(spark: SparkSession, sf: str) -> DataFrame:
    return V.entry_at(V.state(entries(spark, sf), 15), 123).select("type", "id", "hash")


@query("R19_merged_sets", S15 + "SELECT type, id, CASE WHEN CAST(id AS INTEGER) % 3 = 0 THEN 'private' ELSE 'public' END AS \"set\" FROM S")
def merged_sets(spark: SparkSession, sf: str) -> DataFrame:
    s = V.state(entries(spark, sf), 15).select("type", "id")
    return V.merge_sets(s.where("cast(id as int) % 3 <> 0"), s.where("cast(id as int) % 3 = 0"), True)


@query("W6_offset_marks", S15 + ", P AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS position FROM S) SELECT type, id, position FROM P WHERE position % 16 = 0")
def marks(spark: SparkSession, sf: str) -> DataFrame:
    return V.marks(V.state(entries(spark, sf), 15), 16)


@query("W4_thinned", W + """, N AS (SELECT *, lead("commit") OVER (PARTITION BY type, id ORDER BY "commit") AS nx FROM E), K AS (SELECT * FROM N WHERE ("commit" <= 12 AND (nx IS NULL OR nx > 8)) OR ("commit" <= 30 AND (nx IS NULL OR nx > 25))), F AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit") AS f FROM K) SELECT type, id, "commit", kind FROM F WHERE NOT (f = 1 AND kind = 'x')""")
def thinned(spark: SparkSession, sf: str) -> DataFrame:
    return V.visible_spans(entries(spark, sf), [(8, 12), (25, 30)]).select("type", "id", "commit", "kind")


@query("W2_last_wins", "SELECT l_orderkey, l_linenumber, l_shipdate AS shipped, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.write import last_wins as keep

    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return keep(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("shipped"), "l_partkey")


_COMMITS = ', C AS (SELECT "commit" AS number, sha256(CAST("commit" AS VARCHAR)) AS hash, \'1.\' || CAST("commit" // 3 AS VARCHAR) || \'.\' || CAST("commit" % 3 AS VARCHAR) AS semver FROM (SELECT DISTINCT "commit" FROM E))'


@query("R20_find_version", W + _COMMITS + " (SELECT 'latest' AS selector, number FROM C ORDER BY number DESC LIMIT 1) UNION ALL (SELECT 'v1.4', number FROM C WHERE semver = '1.4' OR semver LIKE '1.4.%' ORDER BY number DESC LIMIT 1) UNION ALL (SELECT 'hash', number FROM C WHERE hash = sha256('9'))")
def find_version(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    c = entries(spark, sf).select(F.col("commit").alias("number")).distinct()
    c = c.select("number", F.sha2(F.col("number").cast("string"), 256).alias("hash"), F.concat_ws(".", F.lit("1"), F.floor(F.col("number") / 3).cast("string"), (F.col("number") % 3).cast("string")).alias("semver"))
    found = [V.find_version(c, s).select(F.lit(n).alias("selector"), "number") for n, s in (("latest", "latest"), ("v1.4", "v1.4"), ("hash", "ul:ver:" + hashlib.sha256(b"9").hexdigest()))]
    return found[0].unionByName(found[1]).unionByName(found[2])
