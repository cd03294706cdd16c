"""Queries over the reference events fixture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import provenance as P
from ..operators.lineage import settled
from .fixtures import REFERENCES, references
from .registry import query

W = "WITH " + REFERENCES
PRESENCE = W + ", t AS (SELECT *, lag(op) OVER (PARTITION BY hash, collection, type, id ORDER BY seq, op) AS b FROM refs), u AS (SELECT * FROM t WHERE op <> coalesce(b, '-')), iv AS (SELECT * FROM (SELECT hash, collection, type, id, seq AS from_seq, lead(seq) OVER (PARTITION BY hash, collection, type, id ORDER BY seq, op) AS to_seq, op FROM u) WHERE op = '+')"


@query("G1_events_of_hash", W + " SELECT hash, collection, type, id, seq, op FROM refs")
def events(spark: SparkSession, sf: str) -> DataFrame:
    return P.events_of(references(spark, sf), F.col("hash").isNotNull()).select("hash", "collection", "type", "id", "seq", "op")


@query("A16_presence", PRESENCE + " SELECT hash, collection, type, id, from_seq, to_seq FROM iv")
def presence(spark: SparkSession, sf: str) -> DataFrame:
    return P.presence(references(spark, sf))


_FORKS = [("f1", "src0", 500, True), ("f2", "f1", 10, False), ("f3", "f2", 1, False), ("f4", "f3", 1, False), ("f5", "f4", 1, True), ("f6", "f5", 1, True), ("g1", "src3", 300, False)]
_SET = "CASE WHEN seq % 7 = 0 THEN 'private' ELSE 'public' END"
_FORKED = (
    W
    + f", fr AS (SELECT hash, collection, type, id, {_SET} AS s, seq, '+' AS op FROM base UNION ALL SELECT hash, collection, type, id, {_SET}, seq + 60, '-' FROM base WHERE seq % 5 = 0"
    + f" UNION ALL SELECT hash, 'f1', type, id, {_SET}, seq + 200, '-' FROM base WHERE collection = 'src0' AND seq % 3 = 0 UNION ALL SELECT hash, 'f2', type, id, {_SET}, seq + 300, '-' FROM base WHERE collection = 'src0' AND seq % 4 = 0 UNION ALL SELECT hash, 'f2', type, id, {_SET}, seq + 400, '+' FROM base WHERE collection = 'src0' AND seq % 8 = 0)"
    + ", t AS (SELECT *, lag(op) OVER (PARTITION BY hash, collection, type, id, s ORDER BY seq, op) AS b FROM fr), u AS (SELECT * FROM t WHERE op <> coalesce(b, '-'))"
    + ", iv AS (SELECT * EXCLUDE (op) FROM (SELECT hash, collection, type, id, s, seq AS from_seq, lead(seq) OVER (PARTITION BY hash, collection, type, id, s ORDER BY seq, op) AS to_seq, op FROM u) WHERE op = '+')"
    + ", rm AS (SELECT hash, collection, type, id, s, min(seq) AS removed FROM t WHERE op = '-' AND coalesce(b, '-') = '-' GROUP BY ALL)"
    + ", forks(child, parent, at_seq, private) AS (VALUES " + ", ".join(f"('{c}', '{p}', {a}, {x})" for c, p, a, x in _FORKS) + ")"
    + ", r AS (SELECT hash, collection, type, id, s, from_seq, to_seq FROM iv UNION SELECT r.hash, child, r.type, r.id, r.s, CAST(1 AS BIGINT), rm.removed FROM r JOIN forks ON r.collection = parent LEFT JOIN rm ON rm.hash = r.hash AND rm.collection = child AND rm.type = r.type AND rm.id = r.id AND rm.s = r.s WHERE from_seq <= at_seq AND (to_seq IS NULL OR to_seq > at_seq) AND (r.s = 'public' OR private))"
)


def fork_references(spark: SparkSession, sf: str) -> DataFrame:
    """References with sets, and what forks remove of what they inherit and add again."""
    seq = F.col("seq")
    base = references(spark, sf).where("op = '+'").withColumn("set", F.when(seq % 7 == 0, "private").otherwise("public"))
    own = base.where("collection = 'src0'")
    more = [base.where("seq % 5 = 0").withColumns({"seq": seq + 60, "op": F.lit("-")})]
    for fork, every, later, op in (("f1", 3, 200, "-"), ("f2", 4, 300, "-"), ("f2", 8, 400, "+")):
        more.append(own.where(seq % every == 0).withColumns({"collection": F.lit(fork), "seq": seq + later, "op": F.lit(op)}))
    return settled(reduce(DataFrame.unionByName, more, base))  # it stands for a log that is stored


def fork_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FORKS, "child string, parent string, at long, private boolean")


@query("J17_presence_in_forks", "WITH RECURSIVE " + _FORKED[5:] + ' SELECT hash, collection, type, id, s AS "set", from_seq, to_seq FROM r')
def forks(spark: SparkSession, sf: str) -> DataFrame:
    return P.into_forks(fork_references(spark, sf), fork_table(spark))


@query("G2_presence_of", "WITH RECURSIVE " + _FORKED[5:] + ", one AS (SELECT min(hash) AS h FROM base WHERE collection = 'src0') SELECT hash, collection, type, id, s AS \"set\", from_seq, to_seq FROM r WHERE hash = (SELECT h FROM one)")
def presence_of(spark: SparkSession, sf: str) -> DataFrame:
    r = fork_references(spark, sf)
    return P.presence_of(r, fork_table(spark), r.where("collection = 'src0' AND op = '+'").agg(F.min("hash")).first()[0])


@query("G3_provenance", PRESENCE + " SELECT hash, count(*) AS intervals, count(*) FILTER (to_seq IS NULL) AS open, count(DISTINCT collection) AS collections FROM iv GROUP BY hash")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    return P.presence_summary(P.presence(references(spark, sf)))


@query("A22_first_appearance", W + " SELECT hash, min(seq) AS seq FROM refs WHERE op = '+' GROUP BY hash")
def first_appearance(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_seen(references(spark, sf)).select("hash", "seq")


@query("G8_reference_deltas", "WITH n AS (SELECT lang AS file, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT source, -count(*) FILTER (doc_id % 2 = 0) FROM documents GROUP BY source UNION ALL SELECT lang, -count(*) FROM documents WHERE lang = 'de' GROUP BY lang) SELECT file, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY file HAVING sum(n) <> 0")
def reference_deltas(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    counts = d.groupBy(F.col("lang").alias("file")).agg(F.count("*").alias("n"))
    deltas = d.where("doc_id % 2 = 0").select(F.col("source").alias("file"), F.lit(-1).alias("d")).unionByName(d.where("lang = 'de'").select(F.col("lang").alias("file"), F.lit(-1).alias("d")))
    return P.apply_deltas(counts, deltas)


@query("G4_first_seen", W + " SELECT hash, collection, type, id, seq FROM refs WHERE op = '+' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY seq, collection, id) = 1")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_seen(references(spark, sf))


@query("G5_batch_by_hash", W + ", k AS (SELECT hash, row_number() OVER (ORDER BY hash) AS ordinal FROM (SELECT DISTINCT hash FROM refs ORDER BY hash LIMIT 100)) SELECT ordinal, hash, count(*) AS n FROM k JOIN refs USING (hash) GROUP BY ordinal, hash")
def batch(spark: SparkSession, sf: str) -> DataFrame:
    r = references(spark, sf)
    from pyspark.sql import Window

    first = r.select("hash").distinct().orderBy("hash").limit(100)  # a batch names 100 hashes at most
    k = first.withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("hash")).cast("long"))
    return P.ordered_lookup(k, r.groupBy("hash").agg(F.count("*").alias("n"))).select("ordinal", "hash", "n")


@query("A17_file_references", "SELECT file, count(*) AS records FROM (SELECT DISTINCT doc_id, unnest([source, lang, source]) AS file FROM documents) GROUP BY file")
def file_references(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return P.reference_counts(d.select(F.col("doc_id").alias("record"), F.array("source", "lang", "source").alias("files")))


@query("J18_resolve_links", W + ", l AS (SELECT seq AS src, hash, CASE WHEN seq % 2 = 0 THEN collection END AS collection FROM base), t AS (SELECT DISTINCT hash, collection AS \"at\", type, id FROM base) SELECT src, l.hash, \"at\", t.type, t.id FROM l LEFT JOIN t ON l.hash = t.hash AND (l.collection IS NULL OR l.collection = \"at\")")
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    r = references(spark, sf).where("op = '+'")
    links = r.select(F.col("seq").alias("src"), "hash", F.when(F.col("seq") % 2 == 0, F.col("collection")).alias("collection"))
    return P.resolve(links, r.select("hash", "collection", "type", "id").distinct()).select("src", "hash", F.col("at"), "type", "id")
