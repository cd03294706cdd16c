"""MinHash near-duplicates: universal hash minima, banding, signature verification and connected components.

Rows are numbered and written once; signatures are computed where the rows lie. Rows with equal texts share a node, the
least of their numbers. A signature holds HASHES minima of universal hashes over distinct word shingles; BANDS bands of
equal minima make buckets. First, every member of a bucket is paired with the bucket's leader. Pairs whose signatures agree
enough are confirmed on their full shingle sets, and confirmed links joined into components. Buckets whose members still
lie in several components are looked at again: pairs across components whose signatures agree join these into families,
which hold every link that is still to be found. A family's signatures are dealt to blocks, and each pair of blocks is
compared in a task of its own, across components only; rows that agree with another one there are then compared by their
full sets. Texts move only if they are in a candidate pair: a filter of bounded size over their numbers holds the others
back (at a saturated filter more texts move, and results are the same). No group is gathered whole, no pair is dropped, and
what a task returns is a forest over its rows, never its pairs.

A pair at the threshold shares no bucket with probability (1 - 0.8^4)^32 = 5e-8, and its signature falls under AGREE with
probability below 1e-8.

Defined results: null and empty texts, and texts without a word, have no shingles and link with nothing; rows that repeat
belong to one component and each report it; an empty table gives an empty result; other columns are ignored by
near_duplicates and kept by keep_one, whatever their names; without any doc_id a component has a null id. Texts of any
length are read whole, one at a time if they are long; of ties for the smallest doc_id every row is kept by near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, drop, fingerprint, id_filter, perhaps_in, spare, table, tuned
from .textscan import Words, chunks, mix

SHINGLE = 5
PERCENT = 80
HASHES = 128
BANDS = 32
#: Agreeing minima, of HASHES, under which a pair is not confirmed.
AGREE = 75
BLOCK = 512
#: Shingles of the texts that a block may hold, if they are of more than one text.
BLOCK_SHINGLES = 200_000
_U = np.uint64
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=_U) * _U(2) + _U(1)
_C = _rng.integers(0, 1 << 63, HASHES, dtype=_U)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's k-word shingles (of the whole sequence, if shorter) and the text of each; in text order."""
    h = w.hash
    parts, docs = [], []
    count = np.diff(w.first)
    for n in range(1, k + 1):
        run = w.runs(h, n)
        at = np.flatnonzero(w.whole(n)) if n == k else w.first[:-1][count == n]
        parts.append(mix(run[at] + _U(n)))
        docs.append(w.doc[at])
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(parts)[order], doc[order]


def distinct(x: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Distinct shingles of each text."""
    if not len(x):
        return np.zeros(texts, np.int64)
    y = mix(x ^ mix(doc.astype(_U) + _U(1)))
    order = np.argsort(y)
    y = y[order]
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    return np.bincount(doc[order][new], minlength=texts)


def signatures(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows with a column text -> in its place n_shingles, low byte of each minimum, band keys (none for a text without shingles)."""
    per = HASHES // BANDS
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("n_shingles", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(len(kept))):
                x, doc = shingles(Words(data, off, lower=True), shingle)
                n = distinct(x, doc, b - a)
                some = np.flatnonzero(n)
                least = np.zeros((HASHES, len(some)), np.uint32)
                if len(some):
                    first = np.searchsorted(doc, some)
                    for i in range(HASHES):
                        least[i] = np.minimum.reduceat(x * _A[i] + _C[i], first) >> _U(32)
                keys = np.zeros((BANDS, len(some)), _U)
                for band in range(BANDS):
                    k = np.full(len(some), band + 1, _U)
                    for r in range(per):
                        k = mix(k * _U(0x9E3779B97F4A7C15) + least[band * per + r])
                    keys[band] = k
                low = np.ascontiguousarray(least.T.astype(np.uint8))
                sig = [b""] * (b - a)
                for i, s in enumerate(some.tolist()):
                    sig[s] = low[i].tobytes()
                held = np.zeros(b - a + 1, np.int32)
                held[1:][some] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(held, dtype=np.int32)), pa.array(np.ascontiguousarray(keys.T).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.array(n), pa.array(sig, pa.binary()), bands], names=schema.names)

    return rows.select(*(f.name for f in kept), "text").mapInArrow(run, schema)


def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the nodes in wanted: a filter keeps other texts from moving."""
    return perhaps_in(texts, "node", id_filter(wanted, "node")).join(wanted, "node")


def agreeing(pairs: DataFrame, signs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (u, v) whose sizes and signatures let them reach the threshold."""
    side = lambda x: signs.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").where((F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                su, sv = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, HASHES) for x in ("su", "sv"))
                yield batch.select(["u", "v"]).filter(pa.array((su == sv).sum(1) >= AGREE))

    return sized.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def shingle_sets(col: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    for a, b, data, off in chunks(col):
        x, doc = shingles(Words(data, off, lower=True), shingle)
        yield from map(np.unique, np.split(x, np.searchsorted(doc, np.arange(1, b - a))))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs (u, v) whose full shingle sets reach the threshold."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the long or int columns of that name, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        ids = np.stack([np.asarray(batch.column(x)).astype(np.int64) for x in names])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = ids[:, a].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(members: DataFrame, key: str, blocks) -> DataFrame:
    """members of a group dealt to blocks, and each to the tasks of its block's pairs: adds i (its block), p <= q (the pair)."""
    n = members.withColumn("_n", blocks.cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    both = n.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = both.withColumn("p", F.least("i", "_j")).withColumn("q", F.greatest("i", "_j")).drop("_n", "_j")
    return dealt.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")


def alike(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x, y of a block pair whose components differ and whose sizes and signatures let them reach the threshold."""
    i, n, component = (t[x].to_numpy() for x in ("i", "n_shingles", "component"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
    p, q = t["p"][0].as_py(), t["q"][0].as_py()
    left, right = np.flatnonzero(i == p), np.flatnonzero(i == q)
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        a, b = n[rows][:, None], n[right][None]
        ok = (component[rows][:, None] != component[right][None]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
        if p == q:
            ok &= rows[:, None] < right[None]
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 65536):
            u, v = rows[x[k : k + 65536]], right[y[k : k + 65536]]
            keep = (sig[u] == sig[v]).sum(1) >= AGREE
            xs.append(u[keep])
            ys.append(v[keep])
    return np.concatenate(xs), np.concatenate(ys)


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows reaches over pairs x, y."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        least = least[least]
        if (least == before).all():
            return least


def _edges(node: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(least != np.arange(len(least)))
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[least[some]])], names=["u", "v"])


def perhaps(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members (key, size, node, component, n_shingles, sig) of buckets -> edges (u, v) that join what pairs across components with agreeing signatures join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key", "p", "q"]):
            x, y = alike(t, percent)
            if len(x):
                yield _edges(t["node"].to_numpy(), forest(x, y, len(t)))

    dealt = block_pairs(members, "key", F.ceil(F.col("size") / BLOCK))
    return dealt.select("key", "p", "q", "i", "node", "component", "n_shingles", "sig").mapInArrow(run, "u long, v long")


def partnered(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """members (family, blocks, node, component, n_shingles, sig) -> rows of block pairs (family, p, q, i, and the rest) that agree with another row there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["family", "p", "q"]):
            some = np.union1d(*alike(t, percent))
            if len(some):
                yield from t.take(pa.array(some)).combine_chunks().to_batches()

    names = ["family", "p", "q", "i", "node", "component", "n_shingles", "sig"]
    return block_pairs(members, "family", F.col("blocks")).select(*names).mapInArrow(run, "family long, p int, q int, i int, node long, component long, n_shingles long, sig binary")


def surely(rows: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """partnered rows with text -> links (u, v) that join all that confirmed pairs across components join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["family", "p", "q"]):
            x, y = alike(t, percent)
            if not len(x):
                continue
            sets = {}
            some = np.union1d(x, y)
            for r, one in zip(some.tolist(), shingle_sets(t["text"].combine_chunks().take(pa.array(some)), shingle), strict=True):
                sets[r] = one
            linked: list[np.ndarray] = []
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            for own in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1):
                mine, others = sets[int(x[own[0]])], [sets[r] for r in y[own].tolist()]
                size = np.array([len(o) for o in others])
                flat = np.concatenate(others)
                at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                shared = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(size) - size)
                linked.append(own[(shared > 0) & (100 * shared >= percent * (len(mine) + size - shared))])
            on = np.concatenate(linked)
            if len(on):
                yield _edges(t["node"].to_numpy(), forest(x[on], y[on], len(t)))

    dealt = rows.repartition("family", "p", "q").sortWithinPartitions("family", "p", "q")
    return dealt.select("family", "p", "q", "i", "node", "component", "n_shingles", "sig", "text").mapInArrow(run, "u long, v long")


def stars(joined: DataFrame) -> DataFrame:
    return joined.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def linked_nodes(signs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, component) of nodes that link with another, out of their signatures; texts: node, text, of which only those of candidate pairs move."""
    keys = signs.select("node", F.explode("bands").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).where("size > 1"), "buckets")
    members = cut(keys.join(shared, "key"), "members")
    pairs = members.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    close = cut(agreeing(pairs, signs, percent), "agreeing")
    wanted = cut(close.select(F.col("u").alias("node")).unionByName(close.select(F.col("v").alias("node"))).distinct(), "wanted")
    own = cut(fetched(texts, wanted), "texts")
    links = cut(confirmed(close, own, shingle, percent), "links")
    joined = cut(components(links), "components")
    drop(close, links, wanted, own)

    of = members.join(joined, "node", "left").select("key", "size", "node", F.coalesce("component", "node").alias("component"))
    mixed = cut(of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "mixed")
    sized = signs.select("node", "n_shingles", "sig")
    edges = cut(perhaps(of.join(mixed, "key", "left_semi").join(sized, "node"), percent), "perhaps")
    drop(members, shared, mixed)
    families = components(edges.unionByName(stars(joined))).withColumnRenamed("component", "family")
    inside = cut(families.join(joined, "node", "left").select("node", "family", F.coalesce("component", "node").alias("component")).join(sized, "node"), "families")
    several = inside.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"), F.sum("n_shingles").alias("n")).where("lo <> hi")
    several = cut(several.select("family", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("blocks")), "several")
    paired = cut(partnered(inside.join(several, "family"), percent), "partnered")
    wanted = cut(paired.select("node").distinct(), "wanted")
    more = cut(surely(paired.join(fetched(texts, wanted), "node"), shingle, percent), "links")
    out = cut(components(more.unionByName(stars(joined))), "components")
    drop(edges, inside, several, paired, wanted, more, joined)
    return out


def judged(whole: DataFrame, row: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, a, b (text fingerprint), n_shingles, component_id, kept. whole: a table that is cut, with row numbers in the column row."""
    text = F.coalesce("text", F.lit("")).alias("text")
    slim = whole.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), text, fingerprint().alias("fp"))
    sketches = cut(signatures(slim.select("row", "id", F.col("fp.a").alias("a"), F.col("fp.b").alias("b"), "text"), shingle), "sketches")
    nodes = cut(sketches.groupBy("a", "b").agg(F.min("row").alias("node"), F.min("id").alias("id")), "nodes")  # numbers move, not texts
    signs = cut(sketches.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n_shingles", "sig", "bands"), "signatures")
    joined = linked_nodes(signs, whole.select(F.col(row).alias("node"), text), shingle, percent)
    least = joined.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    of_node = joined.join(least, "component").select("node", "least")
    named = cut(nodes.join(of_node, "node", "left").select("a", "b", F.coalesce("least", "id").alias("least")), "named")
    drop(nodes, signs, joined)
    of = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id"))
    rows = sketches.select("row", "id", "a", "b", "n_shingles").join(named, ["a", "b"])
    return rows.select("row", F.col("id").alias("doc_id"), "a", "b", "n_shingles", of.alias("component_id"), F.col("id").eqNullSafe(of).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    tuned(docs.sparkSession)
    whole = cut(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
    return judged(whole, "row", shingle, percent).drop("row", "a", "b")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest doc_id stays. Rows with equal doc_id and text are one; rows without a word stay."""
    tuned(docs.sparkSession)
    row = spare(docs.columns, "row")
    whole = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = cut(judged(whole, row, shingle, percent), "judged")
    stay = found.where("kept OR n_shingles = 0").groupBy("doc_id", "a", "b").agg(F.min("row").alias("row"))
    gone = cut(found.select(F.col("row").alias(row)).join(stay.select(F.col("row").alias(row)), row, "left_anti"), "gone")
    words = id_filter(gone, row)
    rest = perhaps_in(whole, row, words).join(gone, row, "left_anti")  # other rows do not move
    return perhaps_in(whole, row, words, inside=False).unionByName(rest).select(*docs.columns)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: Sets and links of all pairs that share a shingle, and reachability.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
t(r, y) AS (SELECT r, r FROM d UNION SELECT t.r, l.y FROM t JOIN l ON t.y = l.x),
c AS (SELECT t.r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.y GROUP BY t.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
