"""Shared plumbing: reading tables, tables cut to the shared folder, and graph components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold on its way to Python; texts are whole, so a batch stays small.
ARROW_ROWS = 512
#: Words of 64 bits in a filter of ids, and so the bound of what one broadcasts.
FILTER_WORDS = 1 << 18
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether Parquet reads a column's chunk at once. Such a chunk lies outside the heap, and the reading threads keep that memory.
AT_ONCE = "parquet.hadoop.vectored.io.enabled"
_made: list[tuple[SparkSession, str]] = []
_bases: list[tuple[SparkSession, str]] = []
_named: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, at_once: bool = True) -> DataFrame:
    """With at_once=False column chunks are read by small buffers on the heap: a chunk that is read at once lies outside it, and that memory is kept by the reading threads."""
    read = spark.read if at_once else spark.read.option(AT_ONCE, "false")
    return read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, so that a batch of long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        _bases.append((spark, base))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/recordloom-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    if path in _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")  # its files stay, as they are not the catalog's
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    """Tables cut during the session go when the driver ends."""
    for spark, path in [*_made, *_bases]:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a lineage cut that outlives lost executors.

    Shuffle files of the writing query are dropped as soon as it is done.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.option(AT_ONCE, "false").schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables made by cut that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._loom_path)


def release(paths: list[tuple[SparkSession, str]], keep: list[str]) -> None:
    """Removes folders made by fresh_path, but those that files to keep lie in."""
    for spark, path in paths:
        tail = path.rpartition("/")[2]
        if not any(f"/{tail}/" in f for f in keep):
            remove(spark, path)


def made() -> list[tuple[SparkSession, str]]:
    """Folders that this session has made so far."""
    return list(_made)


def cut_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As cut, as a table bucketed by key: later joins on key move the other side only. It leaves the catalog with its files."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    where = f"recordloom_{uuid.uuid4().hex}_{name}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        path = fresh_path(spark, name)
        _named[path] = where
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).option(AT_ONCE, "false").saveAsTable(where)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.table(where)
    out._loom_path = path
    return out


def spare(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_filter(ids: DataFrame, key: str) -> DataFrame:
    """A filter of the ids in column key: at most FILTER_WORDS rows (word, bits), whatever the number of ids."""
    h = F.xxhash64(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    return cut(ids.select(F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "filter")


def perhaps_in(df: DataFrame, key: str, words: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of df whose key the filter may hold, or with inside=False those that it surely lacks. Nothing moves but the filter."""
    w, b = spare(df.columns, "word"), spare(df.columns, "bits")
    h = F.xxhash64(df[key])
    there = (F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)) == F.col(w)) & (F.call_function("shiftrightunsigned", F.col(b), h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return df.join(F.broadcast(words.withColumnsRenamed({"word": w, "bits": b})), there, "left_semi" if inside else "left_anti")  # FILTER_WORDS rows at most


def fingerprint(text="text"):
    """A text's 128-bit identity as two longs; null counts as the empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(0x5EED), t, F.length(t)).alias("b"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """A node for each text: a, b (its fingerprint), id (its smallest doc_id), copies, text. Copies are combined before the shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fingerprint().alias("fp"))
    one = rows.groupBy(F.col("fp.a").alias("a"), F.col("fp.b").alias("b")).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("text").alias("text"))
    return one.withColumn("node", F.monotonically_increasing_id())


def components(nodes_edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    nodes_edges has columns u and v. Returns (node, component) for every node on an edge, component being the smallest
    node that it reaches. Each star is a minimum per node (combined before the shuffle, and cut, so that a join with a hub's
    many edges can be split) joined back to the edges; no task gathers a node's neighbours.
    """

    def large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least

    def small(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = e.join(least, "u")
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        return out, least

    def starred(e: DataFrame) -> bool:
        """Whether each u has one v, and no v is a u: nothing is left to do."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").head(1)

    e = cut(nodes_edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if starred(e):
            break
        wide, hubs = large(e)
        wide = cut(wide, "stars")
        narrow, hubs2 = small(wide)
        last, e = e, cut(narrow, "stars")
        drop(last, wide, hubs, hubs2)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
