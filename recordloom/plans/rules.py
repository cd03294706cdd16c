"""Queries of rules and policies: keys, schemas, links, ids, versions, cursors, layouts, merges and conversions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical, cells, roots, schemas
from ..operators import catalog as C
from ..operators import layouts as L
from ..operators import uploads as U
from ..operators import versions as V
from ..operators import write as M
from .fixtures import ENTRIES, VERSIONS, entries, state_sql, table, versions
from .registry import query

W = "WITH " + ENTRIES
AB = f"{W}, {state_sql('A', 10)}, {state_sql('B', 20)}"


# Reads under names of their own


@query("S2_view_at", f"{W}, {state_sql('S', 12)} SELECT type, id, hash FROM S")
def view_at(spark: SparkSession, sf: str) -> DataFrame:
    return V.state(V.open_view(entries(spark, sf), 12, 30), 12).select("type", "id", "hash")


@query("S3_cursor", f"{W}, {state_sql('S', 15)} SELECT type, id, hash FROM S WHERE type > 'error' OR (type = 'error' AND id >= '3') ORDER BY type, id LIMIT 40")
def cursor(spark: SparkSession, sf: str) -> DataFrame:
    return V.page(V.state(entries(spark, sf), 15), 40, V.key_range(start=("error", "3"))).select("type", "id", "hash")


@query("F12_kept_versions", W + ' SELECT type, id, "commit" FROM E WHERE "commit" BETWEEN 3 AND 5 OR "commit" = 9')
def kept_versions(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).where(V.kept_version([(3, 5), (9, 9)])).select("type", "id", "commit")


@query("R21_detail", f"{W}, {state_sql('S', 20)}, n AS (SELECT type, count(*) AS c, CAST(sum(size) AS BIGINT) AS b FROM S WHERE kind = 'r' GROUP BY type), k(type) AS (VALUES ('click'), ('view'), ('nothing')) SELECT k.type, coalesce(c, 0) AS count, coalesce(b, 0) AS bytes, sha256(k.type) AS schema FROM k LEFT JOIN n ON n.type = k.type")
def detail(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.createDataFrame([("click",), ("view",), ("nothing",)], "type string").withColumn("hash", F.sha2("type", 256))
    return V.type_details(V.state(entries(spark, sf), 20), s)


@query("J1_merge_files", W + """ SELECT type, id, string_agg(CAST("commit" AS VARCHAR), ',' ORDER BY "commit") AS commits FROM E WHERE "commit" <= 9 GROUP BY type, id""")
def merge_files(spark: SparkSession, sf: str) -> DataFrame:
    return V.groups(entries(spark, sf), 9).select("type", "id", F.array_join(F.transform("entries.commit", lambda c: c.cast("string")), ",").alias("commits"))


@query("J2_head_and_output", AB + " SELECT coalesce(A.type, B.type) AS type, coalesce(A.id, B.id) AS id, CASE WHEN A.hash IS NULL THEN 'added' WHEN B.hash IS NULL THEN 'removed' ELSE 'changed' END AS op FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash")
def head_and_output(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.save(V.state(e, 10), V.state(e, 20)).drop("hash")


@query("J3_mine_and_theirs", W + """, T AS (SELECT type, id, max("commit") AS c FROM E WHERE "commit" > 9 AND "commit" <= 13 GROUP BY type, id) SELECT E.type, E.id, c AS their_commit FROM E JOIN T ON E.type = T.type AND E.id = T.id WHERE E."commit" = 14""")
def mine_and_theirs(spark: SparkSession, sf: str) -> DataFrame:
    return V.conflicts(entries(spark, sf), 9, 14).select("type", "id", "their_commit")


@query("J5_joined_names", "SELECT c_custkey AS name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'keep' WHEN c_custkey % 2 = 0 THEN 'condemn' ELSE 'missing' END AS verdict FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def joined_names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    none = c.where(F.lit(False))
    stored = c.where("name % 2 = 0").withColumn("bytes", F.lit(1).cast("long"))
    return M.sweep(stored, c.where("name % 3 = 0"), none.withColumn("condemned", F.lit(0)), none.withColumn("trashed", F.lit(0)), 9, 5).select("name", "verdict")


@query("J6_full_outer", AB + " SELECT coalesce(A.type, B.type) AS type, coalesce(A.id, B.id) AS id, A.hash AS before_hash, B.hash AS after_hash FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash")
def full_outer(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    side = F.lit("public")
    return V.diff_sets(V.state(e, 10).withColumn("set", side), V.state(e, 20).withColumn("set", side)).drop("before_set", "after_set")


@query("U6_symmetric_difference", AB + " SELECT type, id, hash, 'before' AS side FROM A WHERE NOT EXISTS (SELECT 1 FROM B WHERE B.type = A.type AND B.id = A.id AND B.hash = A.hash) UNION ALL SELECT type, id, hash, 'after' FROM B WHERE NOT EXISTS (SELECT 1 FROM A WHERE B.type = A.type AND B.id = A.id AND B.hash = A.hash)")
def symmetric(spark: SparkSession, sf: str) -> DataFrame:
    sides = F.array(F.struct(F.col("before_hash").alias("hash"), F.lit("before").alias("side")), F.struct(F.col("after_hash").alias("hash"), F.lit("after").alias("side")))
    return V.diff(entries(spark, sf), 10, 20).select("type", "id", F.explode(sides).alias("s")).select("type", "id", "s.hash", "s.side").where("hash IS NOT NULL")


@query("A1_counts", f"{W}, {state_sql('S', 30)} SELECT type, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM S WHERE kind = 'r' GROUP BY type")
def live_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.counts(V.live(V.state(entries(spark, sf), 30)))


@query("W3_previous_hash", W + """ SELECT type, id, "commit", before FROM (SELECT *, lag(hash) OVER (PARTITION BY type, id ORDER BY "commit") AS before FROM E) WHERE hash IS DISTINCT FROM before""")
def previous_hash(spark: SparkSession, sf: str) -> DataFrame:
    return V.changes_of_state(entries(spark, sf)).select("type", "id", "commit", "before")


@query("W5_running_bytes", f"{W}, {state_sql('S', 20)}, P AS (SELECT type, id, size FROM S ORDER BY type, id LIMIT 300), R AS (SELECT *, sum(size) OVER (ORDER BY type, id ROWS UNBOUNDED PRECEDING) AS s FROM P) SELECT type, id FROM R WHERE s <= 1500")
def running_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return V.pages_by_bytes(V.state(entries(spark, sf), 20), "size", 300, 1500).select("type", "id")


@query("O1_sorted_rows", f"{W}, {state_sql('S', 20)} SELECT type, id, row_number() OVER (ORDER BY type, id) - 1 AS position FROM S")
def sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.positions(V.state(entries(spark, sf), 20).select("type", "id"))


@query("O2_sorted_lines", "SELECT line, count(*) AS n, min(place) AS first FROM (SELECT line, row_number() OVER (ORDER BY line) - 1 AS place FROM (SELECT source || '/' || lang AS line FROM documents)) GROUP BY line")
def sorted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted strings with their duplicates: where each begins, and how many there are."""
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("type"), F.col("doc_id").cast("string").alias("id"))
    return V.positions(d).groupBy(F.col("type").alias("line")).agg(F.count("*").alias("n"), F.min("position").alias("first"))


@query("O3_merged_runs", W + """ SELECT type, id, "commit", hash FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit" DESC) AS n FROM E WHERE "commit" IN (7, 8, 11)) WHERE n = 1""")
def merged_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return M.merge_runs([e.where(F.col("commit") == n) for n in (7, 8, 11)]).select("type", "id", "commit", "hash")


@query("O4_page_with_ties", f"WITH {VERSIONS} SELECT version, records FROM versions ORDER BY records DESC, version LIMIT 25 OFFSET 60")
def page_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """By records, of which many are equal; the id breaks ties."""
    v = versions(spark, sf).select(F.format_string("%012d", 1_000_000 - F.col("records")).alias("type"), F.format_string("%012d", "version").alias("id"), "version", "records")
    return V.offset_page(v, 60, 25).select("version", "records")


# Policies of layouts


_BY_COMMIT = W + ', b AS (SELECT "commit" AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM E GROUP BY 1)'


def by_commit(spark: SparkSession, sf: str) -> list[tuple[int, int]]:
    """Bytes of each commit, a row for each."""
    e = entries(spark, sf).groupBy("commit").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).orderBy("commit")
    return [(r["commit"], r["bytes"]) for r in e.collect()]


@query("W7_range_cuts", _BY_COMMIT.replace("WITH ", "WITH RECURSIVE ", 1) + ", o AS (SELECT *, row_number() OVER (ORDER BY n) AS i FROM b), c(i, n, held, cut) AS (SELECT i, n, bytes, bytes >= 4000 FROM o WHERE i = 1 UNION ALL SELECT o.i, o.n, CASE WHEN cut THEN bytes ELSE held + bytes END, CASE WHEN cut THEN bytes ELSE held + bytes END >= 4000 FROM c JOIN o ON o.i = c.i + 1) SELECT n AS after FROM c WHERE cut")
def range_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in L.range_cuts(by_commit(spark, sf), 4000)], "after int")


@query("O6_range_parts", f"{W}, {state_sql('S', 20)}, p AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS n FROM S), m AS (SELECT type, id AS lo, lead(id) OVER (PARTITION BY type ORDER BY id) AS hi FROM p WHERE n % 32 = 0) SELECT m.type, lo, hi, count(*) AS records FROM m JOIN p ON p.type = m.type AND p.id >= lo AND (hi IS NULL OR p.id < hi) GROUP BY m.type, lo, hi")
def range_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Units of a scan, cut at every 32nd record of a type, and what each reads."""
    from pyspark.sql import Window

    s = V.state(entries(spark, sf), 20)
    cut = V.marks(s, 32).select("type", F.col("id").alias("lo"), F.lead("id").over(Window.partitionBy("type").orderBy("id")).alias("hi"))
    rows = s.select(F.col("type").alias("_t"), "id").join(F.broadcast(cut), (F.col("_t") == F.col("type")) & (F.col("id") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("id") < F.col("hi"))))
    return rows.groupBy("type", "lo", "hi").agg(F.count("*").alias("records"))


@query("O8_tiers", _BY_COMMIT + " SELECT n AS first, CASE WHEN bytes <= 700 THEN 0 ELSE CAST(ceil(ln(bytes / 700) / ln(1.2) - 1e-9) AS INTEGER) END AS tier FROM b")
def tiers(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(n, L.tier(b, 1.2, 700)) for n, b in by_commit(spark, sf)]
    return spark.createDataFrame(rows, "first int, tier int")


@query("M5_rebuilt_group", W + """, N AS (SELECT *, lead("commit") OVER (PARTITION BY type, id ORDER BY "commit") AS nx FROM E WHERE "commit" <= 10), K AS (SELECT * FROM N WHERE nx IS NULL), F AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit") AS f FROM K) SELECT type, id, "commit", kind, 1 AS "group" FROM F WHERE NOT (f = 1 AND kind = 'x') UNION ALL SELECT type, id, "commit", kind, "commit" FROM E WHERE "commit" > 10""")
def rebuilt_group(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten commits merged into one group under a plan of the caller's; only the newest version is kept."""
    groups = [L.Group(n, n, b) for n, b in by_commit(spark, sf)]
    plan = L.plan_rebuild(groups, 1, 30, lambda g: [g[:10]])
    return L.finish_rebuild(entries(spark, sf), plan, [(30, 30)]).select("type", "id", "commit", "kind", "group")


@query("X6_planned_merges", _BY_COMMIT + " SELECT n AS first, CAST(CASE WHEN n <= 10 THEN 1 WHEN n BETWEEN 15 AND 18 THEN 15 ELSE n END AS INTEGER) AS \"group\" FROM b")
def planned_merges(spark: SparkSession, sf: str) -> DataFrame:
    """A caller's plan of two merges, and the group that each commit is in then."""
    groups = [L.Group(n, n, b) for n, b in by_commit(spark, sf)]
    plan = L.plan_rebuild(groups, 2, 30, lambda g: [[x for x in g if x.first <= 10], [x for x in g if 15 <= x.first <= 18]])
    rows = [(g.first, m[0].first) for m in plan.merges for g in m] + [(g.first, g.first) for g in plan.untouched]
    return spark.createDataFrame(rows, "first int, `group` int")


@query("M27_full_tiers", "SELECT session, seq FROM (SELECT o_custkey % 50 AS session, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 3 ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey % 50, o_orderkey % 3) AS c FROM orders WHERE o_orderkey % 7 <> 0) WHERE c >= 16 AND n <= 16")
def full_tiers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    runs = o.select((F.col("o_custkey") % 50).alias("session"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).alias("tier"), F.lit(1).alias("bytes"), F.when(F.col("o_orderkey") % 7 == 0, 1).alias("merging"))
    return L.full_tiers(runs).select("session", "seq")


@query("M24_merged_layers", W + """, r AS (SELECT id, hash, "commit", row_number() OVER (PARTITION BY type, id, CASE WHEN "commit" BETWEEN 5 AND 12 THEN 12 ELSE "commit" END ORDER BY "commit" DESC) AS n, type FROM E) SELECT CASE WHEN "commit" BETWEEN 5 AND 12 THEN 12 ELSE "commit" END AS layer, type || '/' || id AS key, hash AS value FROM r WHERE n = 1""")
def merged_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layers 5 to 12, which are due as neighbours of one level, become one."""
    e = entries(spark, sf).select(F.col("commit").alias("layer"), F.concat_ws("/", "type", "id").alias("key"), F.col("hash").alias("value"))
    due = L.due_layers([(n, 0 if 5 <= n <= 12 else n) for n in range(1, 31)])
    return L.merge_layers(e, due, max(due), bottom=False)


@query("M21_from_snapshots", W + ", " + ", ".join(state_sql(f"S{v}", 4 * v) for v in range(1, 6)) + ", A AS (" + " UNION ALL ".join(f"SELECT {v} AS v, type, id, hash FROM S{v}" for v in range(1, 6)) + """), P AS (SELECT n.v, n.type, n.id, n.hash, o.hash AS was FROM A n LEFT JOIN A o ON o.type = n.type AND o.id = n.id AND o.v = n.v - 1) SELECT type, id, v AS "commit", 'r' AS kind, hash FROM P WHERE hash IS DISTINCT FROM was UNION ALL SELECT o.type, o.id, o.v + 1, 'x', NULL FROM A o WHERE o.v < 5 AND NOT EXISTS (SELECT 1 FROM A n WHERE n.type = o.type AND n.id = o.id AND n.v = o.v + 1)""")
def from_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Five whole versions converted to commits."""
    e = entries(spark, sf)
    whole = reduce(DataFrame.unionByName, [V.state(e, 4 * v).select(F.lit(v).alias("version"), "type", "id", "hash", "size") for v in range(1, 6)])
    return L.from_snapshots(whole, 5).select("type", "id", "commit", "kind", "hash")


@query("U4_ranges", _BY_COMMIT + ", m AS (SELECT avg(bytes) AS a FROM b), k AS (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM b, m WHERE bytes > a), r AS (SELECT min(n) AS lo, max(n) AS hi FROM k GROUP BY g) SELECT greatest(lo, 4) AS lo, least(hi, 25) AS hi FROM r WHERE hi >= 4 AND lo <= 25")
def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of commits larger than the mean, inside 4 to 25."""
    rows = by_commit(spark, sf)
    mean = sum(b for _, b in rows) / len(rows)
    return spark.createDataFrame(M.intersect_ranges(M.normalize_ranges([(n, n) for n, b in rows if b > mean]), [(4, 25)]), "lo int, hi int")


@query("X5_takedown", W + """, N AS (SELECT *, lead("commit") OVER (PARTITION BY type, id ORDER BY "commit") AS nx FROM E), K AS (SELECT * FROM N WHERE nx IS NULL OR nx > 15), F AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY "commit") AS f FROM K) SELECT type, id, "commit", CASE WHEN kind = 'r' AND (type = 'view' AND length(id) = 1 OR substring(hash, 1, 2) = 'ab') THEN 'w' ELSE kind END AS kind FROM F WHERE NOT (f = 1 AND kind = 'x')""")
def takedown(spark: SparkSession, sf: str) -> DataFrame:
    """Records that a predicate of type, id and hash names are withheld by a rebuild."""
    named = ((F.col("type") == "view") & (F.length("id") == 1)) | F.col("hash").startswith("ab")
    return M.rebuild(entries(spark, sf), [(15, 30)], named).select("type", "id", "commit", "kind")


@query("X4_files_to_read", W + """, f AS (SELECT type || '/' || CAST("commit" AS VARCHAR) || '/' || substring(id, 1, 1) AS file, min(type || chr(9) || id) AS lo, max(type || chr(9) || id) AS hi FROM E GROUP BY 1) SELECT file FROM f WHERE hi >= 'view' || chr(9) || '60' AND lo < 'view' || chr(9) || '99'""")
def files_to_read(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).groupBy(F.concat_ws("/", "type", F.col("commit").cast("string"), F.substring("id", 1, 1)).alias("file"))
    f = e.agg(F.min(F.struct("type", "id")).alias("a"), F.max(F.struct("type", "id")).alias("b")).select("file", F.col("a.type").alias("first_type"), F.col("a.id").alias("first_id"), F.col("b.type").alias("last_type"), F.col("b.id").alias("last_id"))
    return V.files_to_read(f, ("view", "60"), ("view", "99")).select("file")


@query("X7_each_record", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'large' AS problem FROM part WHERE p_size > 40")
def each_record(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.to_json(F.struct(F.col("p_size").alias("size"))).alias("data"))
    return U.each_record(p, lambda d: F.when(F.get_json_object(d, "$.size").cast("int") > 40, "large")).select("id", "problem")


@query("X7_each_change", AB + ", X AS (SELECT A.hash AS a, B.hash AS b, coalesce(B.size, 0) - coalesce(A.size, 0) AS d FROM A FULL JOIN B ON A.type = B.type AND A.id = B.id WHERE A.hash IS DISTINCT FROM B.hash) SELECT count(*) AS changes, count(*) FILTER (a IS NULL) AS added, CAST(sum(d) AS BIGINT) AS bytes FROM X")
def each_change(spark: SparkSession, sf: str) -> DataFrame:
    grown = F.coalesce("after_size", F.lit(0)) - F.coalesce("before_size", F.lit(0))
    return M.account(V.diff(entries(spark, sf), 10, 20), {"changes": F.lit(1), "added": F.col("change") == "added", "bytes": grown})


# Schemas, keys and links


@query("M10_tightened", "WITH n AS (SELECT p_type AS type, count(*) AS c, max(p_size) AS m FROM part GROUP BY p_type) SELECT type, CASE WHEN c % 3 = 0 THEN 'went' ELSE 'changed' END AS why FROM n WHERE c % 3 = 0 OR c % 2 = 1")
def tightened(spark: SparkSession, sf: str) -> DataFrame:
    """Schemas of types: of some the maximum falls, of some only fewer members are required, some go."""
    n = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("c"), F.max("p_size").alias("m")).collect()  # a row for each type
    schema = lambda r, less, need: {"properties": {"size": {"maximum": r["m"] - less}}, "required": need}
    before = {r["p_type"]: schema(r, 0, ["size", "brand"]) for r in n}
    after = {r["p_type"]: schema(r, r["c"] % 2, ["size"]) for r in n if r["c"] % 3}
    return spark.createDataFrame([(t, "went" if s is None else "changed") for t, s in schemas.tightened(before, after).items()], "type string, why string")


@query("V3_keys", "SELECT c_custkey AS k, c_custkey % 5 NOT IN (0, 1, 2) AS ok FROM customer")
def keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.when(k % 5 == 0, F.lit(".t")).when(k % 5 == 1, F.lit("a/b")).otherwise(F.lit("é"))
    i = F.when(k % 5 == 2, F.lit("")).when(k % 5 == 3, F.repeat(F.lit("é"), 512)).otherwise(k.cast("string"))
    return table(spark, sf, "customer").select(k.alias("k"), canonical.keys_ok(t, i).alias("ok"))


@query("V5_schema_problems", "SELECT p_brand AS brand, CASE WHEN max(p_size) % 2 = 0 THEN 'pattern' ELSE 'reference' END AS problem FROM part GROUP BY p_brand")
def schema_problems(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("m")).collect()  # a row for each brand
    bad = lambda m: {"properties": {"x": {"pattern": "(a*)*"}}} if m % 2 == 0 else {"$ref": "#/nowhere"}
    return spark.createDataFrame([(r["p_brand"], p.rpartition(": ")[2]) for r in n for p in schemas.check_schema(bad(r["m"]))], "brand string, problem string")


@query("V6_link_problems", "SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def link_problems(spark: SparkSession, sf: str) -> DataFrame:
    link = F.when(F.col("doc_id") % 3 == 1, F.lit("ul:rec:xyz")).otherwise(F.concat(F.lit("ul:rec:"), F.sha2("source", 256)))
    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.array(F.struct(link.alias("$link"))).alias("data"))).alias("j"))
    return d.where(canonical.link_problem(F.col("j"))).select("doc_id")


@query("F14_schema_columns", "SELECT p_type AS type, 'size' AS c, 0 AS place FROM part GROUP BY p_type UNION ALL SELECT p_type, CASE WHEN count(*) % 2 = 0 THEN 'name' ELSE 'brand' END, 1 FROM part GROUP BY p_type UNION ALL SELECT p_type, CASE WHEN count(*) % 2 = 0 THEN 'brand' ELSE 'name' END, 2 FROM part GROUP BY p_type")
def schema_columns(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("c")).collect()  # a row for each type
    order = lambda c: schemas.column_order({"properties": {"brand": {}, "name": {}, "size": {}}, "propertyOrder": ["size"], "required": ["name"] if c % 2 == 0 else []})
    return spark.createDataFrame([(r["p_type"], c, k) for r in n for k, c in enumerate(order(r["c"]))], "type string, c string, place int")


def _sets(spark: SparkSession, sf: str) -> list:
    return V.counts(V.state(entries(spark, sf), 20)).orderBy("type").collect()  # a row for each type


@query("V10_version_roots", f"{W}, {state_sql('S', 20)}, n AS (SELECT type, count(*) AS c, CAST(sum(size) AS BIGINT) AS b FROM S GROUP BY type) SELECT type, 'ulv2:' || sha256('{{\"format\":2,\"metadata\":null,\"private\":null,\"public\":{{\"files\":{{\"bytes\":0,\"count\":0,\"root\":null}},\"types\":{{\"' || type || '\":{{\"bytes\":' || CAST(b AS VARCHAR) || ',\"count\":' || CAST(c AS VARCHAR) || ',\"root\":\"' || sha256(type) || '\",\"schema\":\"' || sha256('s') || '\"}}}}}}}}') AS hash, CASE WHEN type = 'view' THEN 'public: type view: bad count' END AS problem FROM n")
def version_roots(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for r in _sets(spark, sf):
        tree = {"root": digest(r["type"]), "count": r["records"], "bytes": r["bytes"], "schema": digest("s")}
        root = roots.make_root(None, {"types": {r["type"]: tree}, "files": {"root": None, "count": 0, "bytes": 0}}, None, "format")
        told = roots.version_hash(root)
        if r["type"] == "view":
            tree["count"] = -1
        out.append((r["type"], told, roots.check_root(root, "format")))
    return spark.createDataFrame(out, "type string, hash string, problem string")


@query("V11_author_commits", f"WITH {VERSIONS} SELECT collection, seq, CASE WHEN version % 5 = 0 THEN 'stale' WHEN version % 5 = 1 THEN 'number' WHEN version % 5 = 2 THEN 'files' WHEN version % 5 = 3 THEN 'semver' END AS problem FROM versions")
def author_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commits that authors built on a head of number 4, each wrong in its own way or right."""

    def check(version):
        import datetime

        now = datetime.datetime(2024, 5, 1, 12, tzinfo=datetime.timezone.utc)
        head = {"number": 4, "id": "h", "semver": "1.2.3", "createdAt": "2024-05-01T11:00:00+00:00"}
        c = {"collection": "c", "number": 5, "previous": "h", "semver": "1.3.0", "createdAt": "2024-05-01T11:59:00+00:00", "changes": [{"files": ["f"]}]}
        c |= [{"number": 4}, {"number": 9}, {"changes": [{"files": []}]}, {"semver": "2.0.0"}, {}][version % 5]
        return roots.check_author_commit(c, head, ["f"], "minor", now, "c")

    return versions(spark, sf).select("collection", "seq", F.udf(check, T.StringType())("version").alias("problem"))


# Scalar functions


@query("f1_canonical_json", "SELECT c_custkey AS k, '{\"a\":[true,null,\"' || c_name || '\"],\"b\":' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(CAST(c_acctbal AS DOUBLE) AS VARCHAR) END || ',\"c\":1e+21}' AS j FROM customer")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('{"c": 1e21, "b": '), F.col("c_acctbal").cast("string"), F.lit(', "a": [true, null, "'), F.col("c_name"), F.lit('"]}'))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), canonical.canonical(raw).alias("j"))


@query("f2_entry_texts", "SELECT c_custkey AS k, '[\"r\",\"t\",\"' || CAST(c_custkey AS VARCHAR) || '\",\"' || sha256(c_name) || '\",5,0,7]' AS entry, '{\"id\":\"' || CAST(c_custkey AS VARCHAR) || '\",\"type\":\"t\",\"removed\":true}' AS removal FROM customer")
def entry_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    named = F.concat_ws(" ", k, F.sha2("c_name", 256))
    entry = canonical.text_of(lambda x: canonical.entry_text("r", "t", x.split()[0], x.split()[1], 5, 0, 7), named)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), entry.alias("entry"), canonical.text_of(lambda x: canonical.removal_line(x, "t"), k).alias("removal"))


@query("f3_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", canonical.line_hash(F.coalesce("text", F.lit(""))).alias("hash"))


#: Keys of a file, and so of a filter, on average.
FILE_KEYS = 50_000


@query("f4_bloom_filter", "SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0")
def bloom_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that filters of the even ones hold; what these hold by mistake is cut by the list itself. A filter is of one file's keys, dealt by hash, and made and asked in the task that holds them."""
    k = table(spark, sf, "customer").where("c_custkey IS NOT NULL").select(F.col("c_custkey").alias("k"))
    even = k.where("k % 2 = 0").distinct()
    file = F.pmod(F.xxhash64("k"), F.lit(-(-even.count() // FILE_KEYS) or 1))

    def ask(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        held = canonical.Bloom(map(str, own["k"]))
        return asked.loc[[str(x) in held for x in asked["k"]], ["k"]]

    maybe = k.groupBy(file.alias("file")).cogroup(even.groupBy(file.alias("file"))).applyInPandas(ask, k.schema)
    return maybe.where("k % 2 = 0")


@query("f5_utf8_order", "SELECT word, octet_length(encode(word)) AS bytes, row_number() OVER (ORDER BY encode(word)) - 1 AS place FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)")
def utf8_order(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return V.positions(w.select(F.lit("w").alias("type"), F.col("word").alias("id"))).select(F.col("id").alias("word"), F.octet_length("id").cast("long").alias("bytes"), F.col("position").alias("place"))


@query("f6_names", "SELECT c_custkey AS k, lower(trim('  ' || c_name || '@Example.ORG ')) AS email, regexp_replace(lower(c_mktsegment || '-' || c_name), '[^a-z0-9]', '', 'g') AS loose, contains(c_name, '1') AS found FROM customer")
def names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    address = F.concat(F.lit("  "), "c_name", F.lit("@Example.ORG "))
    return c.select(F.col("c_custkey").alias("k"), cells.normalize_email(address).alias("email"), cells.loose_name(F.concat_ws("-", "c_mktsegment", "c_name")).alias("loose"), F.col("c_name").like(cells.like_literal("1")).alias("found"))


@query("f7_ids", "SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN sha256(source) END AS hash FROM documents")
def ids(spark: SparkSession, sf: str) -> DataFrame:
    h, n = F.sha2("source", 256), F.col("doc_id") % 4
    form = F.when(n == 0, F.concat(F.lit(" ul:rec:"), h)).when(n == 1, F.upper(h)).when(n == 2, F.concat(F.lit("sha256:"), h, F.lit(" "))).otherwise(F.concat(F.lit("ul:bad:"), h))
    return table(spark, sf, "documents").select("doc_id", canonical.text_of(canonical.hash_input, form).alias("hash"))


_ALPHABET = canonical.BETANUMERIC


@query("f8_arks", f"WITH n AS (SELECT c_custkey AS k, c_custkey AS x FROM customer), d AS (SELECT k, unnest(range(0, 10)) AS i, x FROM n), c AS (SELECT k, i, CAST((x * (i + 7)) % 29 AS INTEGER) AS v FROM d) SELECT k, string_agg(substring('{_ALPHABET}', v + 1, 1), '' ORDER BY i) || substring('{_ALPHABET}', CAST(sum(v * (i + 1)) % 29 AS INTEGER) + 1, 1) AS name FROM c GROUP BY k")
def arks(spark: SparkSession, sf: str) -> DataFrame:
    """Names of betanumerics with their check characters."""
    place = lambda i: ((F.col("c_custkey") * (i + 7)) % 29 + 1).cast("int")
    name = F.concat(*[F.substring(F.lit(_ALPHABET), place(i), F.lit(1)) for i in range(10)])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), canonical.text_of(lambda x: x + canonical.check_char(x), name).alias("name"))


@query("f9_next_semvers", f"WITH {VERSIONS} SELECT collection, seq, CASE version % 3 WHEN 0 THEN CAST(seq + 1 AS VARCHAR) || '.0.0' WHEN 1 THEN CAST(seq AS VARCHAR) || '.3.0' ELSE CAST(seq AS VARCHAR) || '.2.10' END AS semver FROM versions")
def next_semvers(spark: SparkSession, sf: str) -> DataFrame:
    bump = F.element_at(F.array(F.lit("major"), F.lit("minor"), F.lit("patch")), (F.col("version") % 3 + 1).cast("int"))
    told = F.concat_ws(" ", F.concat(F.lit("v"), F.col("seq").cast("string"), F.lit(".2.9")), bump)
    step = canonical.text_of(lambda x: ".".join(map(str, canonical.next_semver(canonical.semver(x.split()[0]), x.split()[1]))), told)
    return versions(spark, sf).select("collection", "seq", step.alias("semver"))


@query("f10_dates", f"WITH {VERSIONS} SELECT version, replace(created, '-', '') AS erc, greatest(created, '1995-06-01') AS at FROM versions")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    import datetime

    v = versions(spark, sf)
    erc = canonical.text_of(lambda x: canonical.erc_date(datetime.date.fromisoformat(x)), F.col("created"))
    last = datetime.datetime(1995, 6, 1)
    at = canonical.text_of(lambda x: canonical.not_before(datetime.datetime.fromisoformat(x), last).date().isoformat(), F.col("created"))
    return v.select("version", erc.alias("erc"), at.alias("at"))


@query("f11_formats", "SELECT p_partkey AS k, p_partkey % 60 BETWEEN 0 AND 23 AS t, p_partkey % 300 <= 255 AS ip FROM part")
def formats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    check = lambda name: F.udf(lambda x: schemas.FORMATS[name](x), T.BooleanType())
    t = F.concat(F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00:00Z"))
    ip = F.concat(F.lit("10.0.0."), (k % 300).cast("string"))
    return table(spark, sf, "part").select(k.alias("k"), check("time")(t).alias("t"), check("ipv4")(ip).alias("ip"))


@query("f12_coerced", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'maybe' ELSE 'true' END AS b, CAST(p_size AS VARCHAR) AS n FROM part")
def coerced(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    b = F.when(k % 4 == 0, "YES").when(k % 4 == 1, "no").when(k % 4 == 2, "maybe").otherwise("1")
    return table(spark, sf, "part").select(k.alias("k"), cells.coerce(b, "boolean").alias("b"), cells.coerce(F.concat(F.lit(" "), F.col("p_size").cast("string")), "integer").alias("n"))


@query("f13_drafted_schema", """SELECT "column" AS field, CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) % 1 = 0) THEN 'integer' ELSE CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'string' END END AS type, count(*) FILTER (v IS NULL) = 0 AS required FROM (SELECT unnest(['p_name', 'p_size', 'p_some', 'p_retailprice']) AS "column", unnest([p_name, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 5 > 0 THEN p_brand END, CAST(p_retailprice AS VARCHAR)]) AS v FROM part) GROUP BY 1""")
def drafted_schema(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).alias("p_some"), "p_retailprice")
    s = cells.draft_schema(p, "p_partkey")
    return spark.createDataFrame([(k, x["type"], k in s["required"]) for k, x in s["properties"].items()], "field string, type string, required boolean")


@query("f14_type_counts", AB + ", na AS (SELECT type, count(*) AS n FROM A GROUP BY type), nb AS (SELECT type, count(*) AS n FROM B GROUP BY type) SELECT coalesce(na.type, nb.type) AS type, coalesce(nb.n, 0) - coalesce(na.n, 0) AS delta FROM na FULL JOIN nb ON na.type = nb.type")
def type_count_deltas(spark: SparkSession, sf: str) -> DataFrame:
    step = F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", -1).otherwise(0)
    return V.diff(entries(spark, sf), 10, 20).groupBy("type").agg(F.sum(step).alias("delta"))


@query("f15_file_references", "SELECT doc_id, sha256(source) AS hash, '/f' AS path FROM documents UNION ALL SELECT doc_id, sha256(lang), '/list/0' FROM documents")
def file_references(spark: SparkSession, sf: str) -> DataFrame:
    ref = lambda c: F.struct(F.concat(F.lit("sha256:"), F.sha2(c, 256)).alias("$file"))
    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(ref("source").alias("f"), F.array(ref("lang")).alias("list"))).alias("j"))
    return d.select("doc_id", F.explode(canonical.links(F.col("j"))).alias("l")).where("l.file").select("doc_id", "l.hash", "l.path")


@query("f16_json_members", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1")
def json_members(spark: SparkSession, sf: str) -> DataFrame:
    return C.status_counts(table(spark, sf, "events"), [F.get_json_object("props", "$.k").cast("long").alias("v")])


_INNER = "".join(f"\\x{b ^ 0x36:02X}" for b in b"key".ljust(64, b"\0"))
_OUTER = "".join(f"\\x{b ^ 0x5C:02X}" for b in b"key".ljust(64, b"\0"))


@query("f17_signatures", f"SELECT c_custkey AS k, sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(c_name)))) AS signature FROM customer")
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), canonical.hmac_sha256(F.col("c_name"), b"key").alias("signature"))


@query("f18_cursors", f"{W}, {state_sql('S', 20)} SELECT type, id, rtrim(translate(to_base64(encode('{{\"t\":\"' || type || '\",\"k\":\"' || id || '\"}}')), '+/', '-_'), '=') AS cursor FROM S")
def cursors(spark: SparkSession, sf: str) -> DataFrame:
    s = V.state(entries(spark, sf), 20)
    made = canonical.text_of(lambda x: canonical.encode_cursor(*x.split("\t")), F.concat_ws("\t", "type", "id"))
    back = canonical.text_of(lambda x: "\t".join(canonical.decode_cursor(x)), F.col("cursor"))
    out = s.select("type", "id", made.alias("cursor")).withColumn("_b", back)
    return out.where(F.col("_b") == F.concat_ws("\t", "type", "id")).drop("_b")


@query("F8_preview_data", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS shown, sha256(source) AS file FROM documents WHERE text IS NOT NULL")
def preview_data(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    j = F.to_json(F.struct(F.col("text").alias("t"), F.struct(F.concat(F.lit("sha256:"), F.sha2("source", 256)).alias("$file"), F.repeat(F.lit("x"), 300).alias("pad")).alias("f")))
    cut = d.select("doc_id", cells.preview_data(j).alias("p"))
    x = F.from_json("p", "t string, f struct<`$file`: string>")
    return cut.select("doc_id", x.alias("x")).select("doc_id", F.col("x.t").alias("shown"), F.substring("x.f.$file", 8, 64).alias("file"))
