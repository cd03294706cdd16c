"""Queries of sources and sinks: uploads, sorted files, packs, exports, tars, commits, mirrors and imports. What they write lies in folders of their own under the shared one."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import layouts as L
from ..operators import versions as V
from ..operators import write as M
from ..operators.lineage import fresh_folder, settled
from ..sources import files as S
from ..sources import packs as P
from ..sources import store
from ..sources.tables import read_table
from .fixtures import ENTRIES, entries, state_sql, table
from .registry import query

W = "WITH " + ENTRIES
S20 = f"{W}, {state_sql('S', 20)}"
_LINE = "'{\"id\":\"' || id || '\",\"type\":\"' || type || '\",\"data\":' || CAST(size AS VARCHAR) || '}'"
LINES = S20 + f", L AS (SELECT type, id, size AS data, {_LINE} AS line, sha256({_LINE}) AS hash, CAST(strlen({_LINE}) AS BIGINT) AS size FROM S WHERE kind = 'r')"
MARK = "format"


def lined(spark: SparkSession, sf: str, version: int = 20) -> DataFrame:
    """Live records of a version with lines and their hashes."""
    s = V.live(V.state(entries(spark, sf), version))
    line = F.to_json(F.struct("id", "type", F.col("size").alias("data")))
    return s.select("type", "id", "kind", "commit", line.alias("line")).withColumn("hash", canonical.line_hash(F.col("line"))).withColumn("size", F.octet_length("line").cast("long"))


def built(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted files of records by type and an id's first character."""
    rows = lined(spark, sf).withColumn("part", F.concat_ws("/", "type", F.substring("id", 1, 1)))
    ends = rows.groupBy("part").agg(F.min(F.struct("type", "id")).alias("first"), F.max(F.struct("type", "id")).alias("last"))
    return S.write_files(rows, "part", MARK).join(ends, "part")


_FILES = LINES + """, ent AS (SELECT type || '/' || substring(id, 1, 1) AS part, type, id, '["r","' || type || '","' || id || '","' || hash || '",' || CAST(size AS VARCHAR) || ',0,' || CAST(coalesce(sum(size + 1) OVER (PARTITION BY type, substring(id, 1, 1) ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS VARCHAR) || ']' || chr(10) AS t, size FROM L),
f AS (SELECT part, any_value(type) AS type, min(id) AS lo, max(id) AS hi, count(*) AS n, sum(size + 1) AS b, sha256(string_agg(t, '' ORDER BY id)) AS k FROM ent GROUP BY part),
files AS (SELECT part, n AS entries, sha256('{"bytes":' || CAST(b AS VARCHAR) || ',"commits":null,"entries":' || CAST(n AS VARCHAR) || ',"first":["' || type || '","' || lo || '"],"format":3,"keyBlocks":[["' || type || '","' || lo || '","' || k || '",' || CAST(n AS VARCHAR) || ']],"labeled":false,"last":["' || type || '","' || hi || '"],"lines":' || CAST(n AS VARCHAR) || ',"records":' || CAST(n AS VARCHAR) || ',"removals":0,"withheld":0}') AS file_id FROM f)"""


@query("S5_sorted_files", _FILES + " SELECT part, entries, file_id FROM files")
def sorted_files(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).select("part", "entries", "file_id")


_ASKED = [("view", "7"), ("click", "12"), ("click", "zzz"), ("nothing", "1"), ("error", "44"), ("signup", "3")]


@query("S4_file_lookup", LINES + " SELECT type, id, 'r' AS kind, hash, line FROM L WHERE (type || '/' || id) IN (" + ", ".join(f"'{t}/{i}'" for t, i in _ASKED) + ")")
def file_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return S.lookup(built(spark, sf), spark.createDataFrame(_ASKED, "type string, id string")).select("type", "id", "kind", "hash", "line")


@query("V7_verify_files", _FILES + " SELECT file_id || 'x' AS file_id, 'id' AS problem FROM files WHERE part LIKE 'view%' UNION ALL SELECT file_id, 'ValueError' FROM files WHERE part LIKE 'error%'")
def verify_files(spark: SparkSession, sf: str) -> DataFrame:
    f = built(spark, sf)
    told = F.when(F.col("part").startswith("view"), F.concat("file_id", F.lit("x"))).otherwise(F.col("file_id"))
    data = F.when(F.col("part").startswith("error"), F.expr("substring(data, 1, length(data) - 1)")).otherwise(F.col("data"))
    return S.file_problems(f.select(told.alias("file_id"), data.alias("data")))


@query("S5_labeled_files", W + " SELECT type, id, \"commit\", kind, hash FROM E WHERE kind <> 'w'")
def labeled_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry written to labeled files that are cut by key and size, and read back."""
    e = entries(spark, sf).where("kind <> 'w'").withColumn("commit", F.col("commit").cast("long"))
    cut = L.files_cut(e, 4000, 2000, 100).withColumn("part", F.concat_ws("/", "type", "file", F.col("piece").cast("string")))
    rows = cut.withColumn("line", F.when(F.col("kind") == "r", F.to_json(F.struct("id", "type", F.col("seq").alias("data")))))
    f = S.write_files(rows.select("part", "kind", "type", "id", "line", "commit", "hash", "size"), "part", MARK, labeled=True)
    lines = rows.where("kind = 'r'").select("type", "id", F.sha2(F.col("line").cast("binary"), 256).alias("_l"), "commit", F.col("hash").alias("own"))
    back = S.scan_files(f).withColumnRenamed("hash", "_l").join(lines, ["type", "id", "commit", "_l"], "left")
    return back.select("type", "id", F.col("commit").cast("int").alias("commit"), "kind", F.col("own").alias("hash"))


@query("W7_size_cuts", W + """, k AS (SELECT type, id, CAST(sum(coalesce(size, 0)) AS BIGINT) AS b, count(*) AS n FROM E GROUP BY type, id), r AS (SELECT *, coalesce(sum(b) OVER w, 0) AS bb, coalesce(sum(n) OVER w, 0) AS nn FROM k WINDOW w AS (PARTITION BY type ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT type, id, CAST(greatest(floor(bb / 900), floor(nn / 40)) AS BIGINT) AS piece FROM r""")
def size_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts by bytes and entries alone: at this target no key's hash ends a file."""
    return L.files_cut(entries(spark, sf).select("type", "id", "commit", "size"), 1 << 60, 900, 40).select("type", "id", "piece").distinct()


@query("S6_parse_upload", "SELECT c_custkey AS seq, CASE c_custkey % 7 WHEN 0 THEN 'duplicate_key' WHEN 1 THEN 'bad_id' WHEN 2 THEN 'bad_type' WHEN 3 THEN 'syntax' WHEN 4 THEN 'unsafe_integer' END AS code, CASE WHEN c_custkey % 7 = 6 THEN '{\"id\":\"' || CAST(c_custkey AS VARCHAR) || '\",\"type\":\"t\",\"data\":{\"a\":1,\"b\":2}}' END AS line FROM customer WHERE c_custkey % 7 <> 5")
def parse_upload(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    text = k.cast("string")
    row = lambda id_, type_, data: F.concat(F.lit('{"type":"'), F.lit(type_), F.lit('","id":"'), id_, F.lit(f'","data":{data}}}'))
    value = (
        F.when(k % 7 == 0, row(text, "t", '{"a":1,"a":2}'))
        .when(k % 7 == 1, row(F.lit(""), "t", "1"))
        .when(k % 7 == 2, row(text, ".t", "1"))
        .when(k % 7 == 3, F.lit('{"type":"t","id":"1'))
        .when(k % 7 == 4, row(text, "t", "9007199254740993"))
        .when(k % 7 == 5, F.lit("  "))
        .otherwise(row(text, "t", '{"b":2.0,"a":1}'))
    )
    return store.parse_upload(table(spark, sf, "customer").select(value.alias("value"), k.alias("seq"))).select("seq", "code", "line")


@query("V2_input_lines", "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'bad_envelope' WHEN 1 THEN 'bad_envelope' WHEN 2 THEN 'bad_id' END AS code, CASE WHEN c_custkey % 4 = 3 THEN true END AS private FROM customer")
def input_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.when(k % 4 == 0, F.lit('{"id":"a","type":"t"}')).when(k % 4 == 1, F.lit('{"id":"a","type":"t","data":1,"private":0}')).when(k % 4 == 2, F.lit('{"id":7,"type":"t","data":1}')).otherwise(F.lit('{"id":"a","type":"t","data":1,"private":true}'))
    return table(spark, sf, "customer").select(k.alias("k"), canonical.parsed(value).alias("p")).select("k", "p.code", "p.private")


def imported(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Parts written as a file of that kind and read again as an importer does."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("size"))
    at = fresh_folder(spark, "import") + "." + kind
    if kind == "csv":
        p.write.option("header", True).csv(at)
    elif kind == "tsv":
        p.write.option("header", True).option("sep", "\t").csv(at)
    elif kind == "ndjson":
        p.write.json(at)
    else:
        p.write.parquet(at)
    return read_table(spark, at).select("key", "name", "size")


_PARTS = "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part"


@query("S8_import_csv", _PARTS)
def import_csv(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf, "csv")


@query("S8_import_tsv", _PARTS)
def import_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf, "tsv")


@query("S8_import_ndjson", _PARTS)
def import_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf, "ndjson")


@query("S9_read_table", _PARTS)
def read_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return imported(spark, sf, "parquet")


@query("K2_export_gz", LINES + " SELECT line AS value FROM L")
def export_gz(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh_folder(spark, "export")
    store.write_export(lined(spark, sf), at, gz=True)
    return spark.read.text(f"{at}/*.gz")


def archived(spark: SparkSession, sf: str) -> str:
    at = fresh_folder(spark, "export") + ".tar"
    d = table(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("hash")).agg(F.first("text").alias("text"))
    own = d.select("hash", F.octet_length("text").cast("long").alias("size"), F.when(~F.col("hash").startswith("0"), F.col("text").cast("binary")).alias("data"))
    store.tar_export(lined(spark, sf), at, {"version": "1.0.0"}, {"view": {}}, "# About", own, at=86400)
    return at


_TAR = LINES + """, R AS (SELECT 'records/' || type || '.ndjson' AS name, string_agg(substring(line, 1, length(line) - 1) || ',"hash":"' || hash || '"}' || chr(10), '' ORDER BY id) AS body FROM L GROUP BY type), D AS (SELECT DISTINCT sha256(text) AS h, text FROM documents WHERE text IS NOT NULL), T AS (SELECT name, body FROM R UNION ALL SELECT 'files/' || h, text FROM D WHERE h NOT LIKE '0%' UNION ALL SELECT 'README.md', '# About')"""


@query("K3_tar_export", _TAR + " SELECT name, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS hash FROM T")
def tar_export(spark: SparkSession, sf: str) -> DataFrame:
    return store.untar(spark, archived(spark, sf)).where("name <> 'manifest.json'").select("name", "size", F.sha2("data", 256).alias("hash"))


@query("S11_untar", LINES + ", t AS (SELECT type, count(*) AS records, CAST(sum(size + 75) AS BIGINT) AS bytes FROM L GROUP BY type), D AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT type, records, bytes, (SELECT count(*) FROM D WHERE h LIKE '0%') AS missing FROM t")
def untar(spark: SparkSession, sf: str) -> DataFrame:
    """What the manifest inside the tar says."""
    m = store.untar(spark, archived(spark, sf)).where("name = 'manifest.json'")
    x = F.from_json(F.col("data").cast("string"), "types map<string, struct<records: long, bytes: long>>, missing array<string>")
    return m.select(x.alias("x")).select(F.explode("x.types").alias("type", "t"), F.size("x.missing").cast("long").alias("missing")).select("type", "t.records", "t.bytes", "missing")


_OLD = f", {state_sql('O', 10)}, LO AS (SELECT {_LINE} AS line FROM O WHERE kind = 'r')"


@query("K5_pack", LINES + _OLD + " SELECT DISTINCT hash, line FROM L WHERE line NOT IN (SELECT line FROM LO)")
def pack(spark: SparkSession, sf: str) -> DataFrame:
    return M.pack(lined(spark, sf), lined(spark, sf, 10))


@query("K5_receive", LINES + _OLD + ", p AS (SELECT DISTINCT hash, line FROM L WHERE line NOT IN (SELECT line FROM LO)) SELECT hash, 'bytes' AS problem FROM p WHERE substring(hash, 1, 1) = 'a' UNION ALL SELECT hash, 'missing' FROM p WHERE substring(hash, 1, 1) = 'b' UNION ALL SELECT sha256('stray'), 'not named'")
def receive(spark: SparkSession, sf: str) -> DataFrame:
    """A pack of which some objects are broken, some lost and one is a stranger's."""
    p = M.pack(lined(spark, sf), lined(spark, sf, 10)).where(~F.col("hash").startswith("b"))
    p = p.withColumn("line", F.when(F.col("hash").startswith("a"), F.concat("line", F.lit(" "))).otherwise(F.col("line")))
    stray = spark.range(1).select(F.sha2(F.lit("stray").cast("binary"), 256).alias("hash"), F.lit("stray").alias("line"))
    return M.receive(p.unionByName(stray), lined(spark, sf), lined(spark, sf, 10))


@query("M23_pack_blocks", LINES + " SELECT DISTINCT hash, line FROM L WHERE substring(hash, 1, 1) < '8'")
def pack_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = lined(spark, sf).dropDuplicates(["hash"])
    return P.read_packs(settled(P.write_packs(rows, 2000)), rows.where("substring(hash, 1, 1) < '8'"))


@query("M24_merged_packs", LINES + " SELECT DISTINCT hash FROM L WHERE substring(hash, 1, 1) < '4'")
def merged_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Packs of which a quarter is wanted, merged; what the new ones hold."""
    rows = lined(spark, sf).dropDuplicates(["hash"]).repartition(4, "id")
    keep = rows.where("substring(hash, 1, 1) < '4'").select("hash")
    return P.places(P.merge_packs(settled(P.write_packs(rows, 2000)), keep, 0.9, 2000)).select("hash")


def _now() -> datetime.datetime:
    return datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def landed(spark: SparkSession, commits: int = 5) -> str:
    """A store with a log of that many commits, one of them sent twice."""
    root = fresh_folder(spark, "log")
    for n in [*range(commits), commits - 1]:
        store.land(spark, root, "c", {"files": [f"f{n}"]}, lambda head, n=n: "minor" if n % 2 else "patch", _now())
    return root


_LOG = "SELECT * FROM (VALUES (1, '1.0.0', true), (2, '1.1.0', true), (3, '1.1.1', true), (4, '1.2.0', true), (5, '1.2.1', true)) AS t(number, semver, follows)"


@query("K6_landed_commits", _LOG)
def landed_commits(spark: SparkSession, sf: str) -> DataFrame:
    log = store.read_log(spark, landed(spark))
    before = log.select((F.col("number") + 1).cast("int").alias("number"), F.col("id").alias("_id"))
    return log.withColumn("number", F.col("number").cast("int")).join(before, "number", "left").select("number", "semver", F.col("previous").eqNullSafe(F.col("_id")).alias("follows"))


@query("K7_mirrored_store", LINES + ' SELECT type, id, line, 3 AS commits FROM L')
def mirrored_store(spark: SparkSession, sf: str) -> DataFrame:
    source, target = landed(spark, 3), fresh_folder(spark, "mirror")
    lined(spark, sf).select("type", "id", "line").write.parquet(f"{source}/entries")
    store.mirror(spark, source, target)
    log = store.read_log(spark, target).agg(F.count("*").cast("int").alias("commits"))
    return spark.read.parquet(f"{target}/entries").join(F.broadcast(log), F.lit(True))


@query("S10_store_objects", "SELECT * FROM (VALUES ('a', true, 'one'), ('a', false, 'one'), ('b', true, 'two')) AS t(name, created, holds)")
def store_objects(spark: SparkSession, sf: str) -> DataFrame:
    """An object is created once, whoever comes second."""
    root = fresh_folder(spark, "objects")
    rows = [(n, store.create_once(spark, f"{root}/{n}", d), store.read_object(spark, f"{root}/{n}").decode()) for n, d in (("a", b"one"), ("a", b"other"), ("b", b"two"))]
    return spark.createDataFrame(rows, "name string, created boolean, holds string")


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def database(spark: SparkSession, sf: str) -> str:
    """The URL of a database of parts. One process at a time may write to a database of this kind, so the driver imports what tasks have written; it then lies read-only in an archive in the shared folder, where every executor may open it, if that is a folder of files."""
    import shutil
    import tempfile

    jvm = spark.sparkContext._jvm
    jvm.System.setProperty("derby.stream.error.file", "/dev/null")  # no log beside the program
    jvm.java.lang.Class.forName(DERBY)
    rows, kept = fresh_folder(spark, "database"), fresh_folder(spark, "database") + ".jar"
    # cells are quoted, as bare ones are trimmed; null is an empty cell
    quoted = F.concat(F.lit('"'), F.replace("p_name", F.lit('"'), F.lit('""')), F.lit('"'))
    table(spark, sf, "part").select(F.concat_ws(",", F.coalesce(F.col("p_partkey").cast("string"), F.lit("")), F.coalesce(quoted, F.lit("")), F.coalesce(F.col("p_size").cast("string"), F.lit("")))).write.text(rows)
    target, fs = store._fs(spark, kept)
    path = jvm.org.apache.hadoop.fs.Path
    with tempfile.TemporaryDirectory() as own:
        connection = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{own}/db/parts;create=true")
        connection.createStatement().execute("CREATE TABLE PARTS (K BIGINT, N VARCHAR(32672), Z INTEGER)")
        call = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'PARTS', ?, ',', '\"', 'UTF-8', 0)")
        for status in fs.listStatus(path(rows)):
            if status.getPath().getName().startswith("part-") and status.getLen():
                fs.copyToLocalFile(False, status.getPath(), path(f"file://{own}/rows"), True)
                call.setString(1, f"{own}/rows")
                call.execute()
        connection.close()
        try:
            jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{own}/db/parts;shutdown=true")
        except Exception as e:  # says so if it has gone well
            if "shutdown" not in str(e):
                raise
        fs.copyFromLocalFile(False, True, path("file://" + shutil.make_archive(f"{own}/parts", "zip", f"{own}/db")), target)
    fs.delete(path(rows), True)
    return f"jdbc:derby:jar:({target.toUri().getPath()})parts"


@query("S12_database_table", _PARTS)
def database_table(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the database that comes with Spark, read by key ranges."""
    from ..sources.tables import read_jdbc

    got = read_jdbc(spark, database(spark, sf), "parts", "K", 4, properties={"driver": DERBY})
    return got.select(F.col("K").cast("string").alias("key"), F.col("N").alias("name"), F.col("Z").cast("string").alias("size"))
