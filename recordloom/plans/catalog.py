"""Queries over the catalog fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from .fixtures import COLLECTIONS, ORGANIZATIONS, SCHEMA_ROWS, USAGE, VERSIONS, collections, organizations, schema_rows, table, usage, versions
from .registry import query

BASE = f"WITH {ORGANIZATIONS}, {COLLECTIONS}, {VERSIONS}, heads AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY collection ORDER BY seq DESC) = 1) "
INTERVALS = f"WITH {COLLECTIONS}, {ORGANIZATIONS}, {SCHEMA_ROWS}, ch AS (SELECT * FROM (SELECT *, lag(hash) OVER (PARTITION BY collection, type ORDER BY seq) AS b FROM schema_rows) WHERE hash IS DISTINCT FROM b), intervals AS (SELECT collection, type, hash, seq AS from_seq, lead(seq) OVER (PARTITION BY collection, type ORDER BY seq) AS to_seq FROM ch) "


@query("J7_collection_list", BASE + "SELECT collection, name, org_name, seq, records FROM collections JOIN organizations USING (org) LEFT JOIN heads USING (collection) WHERE public ORDER BY records DESC NULLS LAST, collection LIMIT 40 OFFSET 10")
def collection_list(spark: SparkSession, sf: str) -> DataFrame:
    c = C.visible(collections(spark, sf))
    return C.list_collections(c, organizations(spark, sf), versions(spark, sf), [F.desc_nulls_last("records"), F.asc("collection")], 40, 10).select("collection", "name", "org_name", "seq", "records")


@query("F4_visibility", BASE + "SELECT collection FROM collections WHERE public OR org IN (3, 7)")
def visibility(spark: SparkSession, sf: str) -> DataFrame:
    return C.visible(collections(spark, sf), [3, 7]).select("collection")


@query("F5_search", BASE + "SELECT collection, name FROM collections JOIN organizations USING (org) WHERE contains(lower(name), '00012') OR contains(lower(org_name), '00012')")
def search(spark: SparkSession, sf: str) -> DataFrame:
    return collections(spark, sf).join(organizations(spark, sf), "org").where(C.search(["name", "org_name"], " 00012 ")).select("collection", "name")


@query("F6_tag_membership", BASE + "SELECT collection FROM collections WHERE list_contains([tag, 'org' || CAST(org AS VARCHAR)], 'org4')")
def tag_membership(spark: SparkSession, sf: str) -> DataFrame:
    summary = F.to_json(F.struct(F.array("tag", F.concat(F.lit("org"), F.col("org").cast("string"))).alias("tags")))
    return C.with_tag(collections(spark, sf).withColumn("summary", summary), "summary", "org4").select("collection")


@query("F7_list_membership", BASE + "SELECT collection, name FROM collections WHERE collection IN (1, 5, 9, 1000000)")
def list_membership(spark: SparkSession, sf: str) -> DataFrame:
    return C.in_list(collections(spark, sf), "collection", "[1,5,9,1000000]").select("collection", "name")


@query("F13_org_page", BASE + "SELECT collection, name, records FROM collections LEFT JOIN heads USING (collection) WHERE org = 5 AND tag = 'BUILDING' AND contains(lower(name || ' ' || tag), 'customer')")
def org_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = collections(spark, sf).where("org = 5").join(C.heads(versions(spark, sf)).select("collection", "records", "created"), "collection", "left")
    rows = rows.withColumn("tags", F.array("tag")).withColumn("types", F.array().cast("array<string>"))
    return C.org_page(rows, "BUILDING", " Customer ").select("collection", "name", "records")


@query("G6_schema_intervals", INTERVALS + "SELECT * FROM intervals")
def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return C.schema_intervals(schema_rows(spark, sf)).select("collection", "type", "hash", "from_seq", "to_seq")


_ONE = "sha256('Brand#11')"


@query("J8_schema_users", INTERVALS + f"SELECT collection, org_name, i.type, from_seq, to_seq, version FROM intervals i JOIN collections USING (collection) JOIN organizations USING (org) LEFT JOIN versions v ON v.collection = i.collection AND v.seq = i.from_seq WHERE hash = {_ONE} AND public")
def schema_users(spark: SparkSession, sf: str) -> DataFrame:
    i = C.schema_intervals(schema_rows(spark, sf)).where(F.col("hash") == F.sha2(F.lit("Brand#11"), 256))
    v = versions(spark, sf).select("collection", F.col("seq").alias("from_seq"), "version")
    rows = i.join(C.visible(collections(spark, sf)), "collection").join(organizations(spark, sf), "org").join(v, ["collection", "from_seq"], "left")
    return rows.select("collection", "org_name", "type", "from_seq", "to_seq", "version")


@query("J9_failed_pushes", BASE + "SELECT version, collection, name, org_name FROM versions JOIN collections USING (collection) JOIN organizations USING (org) WHERE message = '1-URGENT' ORDER BY created DESC, version LIMIT 20")
def failed_pushes(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.failed_pushes(versions(spark, sf), collections(spark, sf), organizations(spark, sf), F.col("message") == "1-URGENT", 20)
    return rows.select("version", "collection", "name", "org_name")


@query("J10_tombstones", BASE + "SELECT collection, org_name FROM (SELECT collection, CASE WHEN collection % 2 = 0 THEN org END AS org FROM collections) LEFT JOIN organizations USING (org)")
def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    t = collections(spark, sf).select("collection", F.when(F.col("collection") % 2 == 0, F.col("org")).alias("org"))
    return C.owners_of_lost(t, organizations(spark, sf)).select("collection", "org_name")


@query("J11_versions_in_intervals", INTERVALS + "SELECT i.collection, i.type, i.hash, v.seq, v.version FROM intervals i JOIN versions v ON v.collection = i.collection AND v.seq >= from_seq AND (to_seq IS NULL OR v.seq < to_seq)")
def versions_in_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return C.versions_in(C.schema_intervals(schema_rows(spark, sf)), versions(spark, sf)).select("collection", "type", "hash", "seq", "version")


@query("J12_pair_join", BASE + "SELECT collection, seq, version FROM versions JOIN (VALUES (1, 1), (1, 3), (4, 2), (77, 1)) AS p(c, s) ON collection = c AND seq = s")
def pair_join(spark: SparkSession, sf: str) -> DataFrame:
    return C.in_pairs(versions(spark, sf), ("collection", "seq"), "[[1,1],[1,3],[4,2],[77,1]]").select("collection", "seq", "version")


@query("J13_visible_schemas", INTERVALS + "SELECT DISTINCT hash FROM schema_rows s WHERE EXISTS (SELECT 1 FROM collections c WHERE c.collection = s.collection AND public)")
def visible_schemas(spark: SparkSession, sf: str) -> DataFrame:
    return schema_rows(spark, sf).join(C.visible(collections(spark, sf)), "collection", "left_semi").select("hash").distinct()


@query("J14_lost_ids", BASE + "SELECT DISTINCT collection FROM versions t WHERE NOT EXISTS (SELECT 1 FROM collections c WHERE c.public AND c.collection = t.collection)")
def lost_ids(spark: SparkSession, sf: str) -> DataFrame:
    return C.lost_ids(versions(spark, sf), C.visible(collections(spark, sf)), "collection")


_METRICS = ["click", "error", "purchase", "signup", "view"]


@query("A4_usage_by_account", f"WITH {USAGE} SELECT account, " + ", ".join(f"CAST(coalesce(sum(amount) FILTER (metric = '{m}'), 0) AS BIGINT) AS {m}" for m in _METRICS) + " FROM usage GROUP BY account")
def usage_by_account(spark: SparkSession, sf: str) -> DataFrame:
    return C.usage_table(usage(spark, sf), "account", _METRICS)


@query("A5_daily_series", f"WITH {USAGE} SELECT strftime(d, '%Y-%m-%d') AS day, CAST(coalesce(amount, 0) AS BIGINT) AS amount FROM range(DATE '2023-12-20', DATE '2024-01-11', INTERVAL 1 DAY) AS r(d) LEFT JOIN (SELECT day, sum(amount) AS amount FROM usage GROUP BY day) u ON u.day = strftime(d, '%Y-%m-%d')")
def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    return C.daily_series(usage(spark, sf), "2023-12-20", "2024-01-10")


@query("A6_monthly_growth", BASE + "SELECT substring(created, 1, 7) AS month, count(*) AS versions, CAST(sum(records) AS BIGINT) AS records FROM versions GROUP BY 1")
def monthly_growth(spark: SparkSession, sf: str) -> DataFrame:
    return C.monthly_growth(versions(spark, sf))


@query("A7_type_totals", f"WITH {SCHEMA_ROWS} SELECT type, CAST(sum(n) AS BIGINT) AS records, count(*) AS collections FROM (SELECT collection, type, count(*) AS n FROM schema_rows GROUP BY collection, type) GROUP BY type ORDER BY records DESC, type LIMIT 50")
def type_totals(spark: SparkSession, sf: str) -> DataFrame:
    n = schema_rows(spark, sf).groupBy("collection", "type").agg(F.count("*").alias("n"))
    typed = n.groupBy("collection").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("type_counts"))
    return C.type_totals(typed)


@query("A8_shared_schemas", INTERVALS + "SELECT hash, count(DISTINCT collection) AS collections, min(type) AS type FROM intervals WHERE to_seq IS NULL GROUP BY hash HAVING count(DISTINCT collection) > 1 ORDER BY collections DESC, hash LIMIT 20")
def shared_schemas(spark: SparkSession, sf: str) -> DataFrame:
    return C.shared_schemas(C.schema_intervals(schema_rows(spark, sf)))


@query("A9_org_rollup", BASE + "SELECT org, org_name, count(collection) AS collections, count(*) FILTER (public) AS public_collections, CAST(coalesce(sum(seq), 0) AS BIGINT) AS versions, CAST(coalesce(sum(records), 0) AS BIGINT) AS records, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, max(created) AS last_push FROM organizations LEFT JOIN collections USING (org) LEFT JOIN heads USING (collection) GROUP BY org, org_name")
def org_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return C.org_rollup(collections(spark, sf), organizations(spark, sf), versions(spark, sf))


@query("A10_facets", BASE + "SELECT tag, count(*) AS n FROM collections WHERE public GROUP BY tag ORDER BY n DESC, tag LIMIT 50")
def facets(spark: SparkSession, sf: str) -> DataFrame:
    return C.facet(C.visible(collections(spark, sf)), "tag", 50)


@query("A11_conditional_sums", BASE + "SELECT count(*) FILTER (public) AS public, count(*) FILTER (NOT public) AS private, CAST(sum(CASE WHEN public THEN org ELSE 0 END) AS BIGINT) AS weight FROM collections")
def conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("public")
    return C.conditional(collections(spark, sf), {"public": (p, None), "private": (~p, None), "weight": (p, F.col("org"))})


@query("A12_status_counts", BASE + "SELECT message, seq > 5 AS late, count(*) AS n FROM versions GROUP BY ALL")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.status_counts(versions(spark, sf), [F.col("message"), (F.col("seq") > 5).alias("late")])


@query("A13_totals", BASE + "SELECT (SELECT count(*) FROM collections) AS collections, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM organizations) AS organizations")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return C.totals({"collections": collections(spark, sf), "versions": versions(spark, sf), "organizations": organizations(spark, sf)})


@query("A18_org_version_sums", BASE + "SELECT org, count(*) AS versions, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM versions JOIN collections USING (collection) GROUP BY org")
def org_version_sums(spark: SparkSession, sf: str) -> DataFrame:
    return C.org_version_sums(versions(spark, sf), collections(spark, sf))


@query("A20_profile", "SELECT * FROM (SELECT 'p_brand' AS \"column\", count(DISTINCT p_brand) AS \"values\", CAST(0 AS BIGINT) AS blanks, min(p_brand) AS least, max(p_brand) AS largest, count(DISTINCT p_brand) <= 6 AS listed FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size), count(*) FILTER (p_size IS NULL), min(CAST(p_size AS VARCHAR)), max(CAST(p_size AS VARCHAR)), count(DISTINCT p_size) <= 6 FROM part)")
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return C.profile(table(spark, sf, "part"), ["p_brand", "p_size"])


@query("A23_telling_tags", BASE + "SELECT tag, count(*) AS n FROM (SELECT DISTINCT collection, unnest([tag, 'all', CASE WHEN public THEN 'public' ELSE 'private' END]) AS tag FROM collections) GROUP BY tag HAVING count(*) < (SELECT count(*) FROM collections) ORDER BY n DESC, tag LIMIT 8")
def telling_tags(spark: SparkSession, sf: str) -> DataFrame:
    return C.telling_tags(collections(spark, sf).withColumn("tags", F.array(F.col("tag"), F.lit("all"), F.when(F.col("public"), "public").otherwise("private"))))


@query("O5_top_collections", BASE + "SELECT collection, bytes FROM heads ORDER BY bytes DESC, collection LIMIT 15")
def top_collections(spark: SparkSession, sf: str) -> DataFrame:
    return C.heads(versions(spark, sf)).select("collection", "bytes").orderBy(F.desc("bytes"), "collection").limit(15)


@query("W1_versions_listed", BASE + "SELECT collection, seq, version, row_number() OVER (PARTITION BY collection ORDER BY seq) AS rn FROM versions QUALIFY rn <= 3")
def versions_listed(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_of_each(versions(spark, sf).select("collection", "seq", "version"), "collection", "seq", 3).withColumn("rn", F.col("rn").cast("long"))
