"""Embedding near-duplicates by a pivot-permutation index.

Every distinct vector is described by the PREFIX reference points nearest to it, nearest first. Inverted lists are kept for
pairs of the HEAD nearest, so that members of a list share two pivots at least. A list's descriptions are dealt to blocks,
and for each pair of blocks shared pivots are counted: pairs with SHARED common ones whose ranks agree (the sum of PREFIX
less the difference of ranks reaches ORDER) are candidates. Vectors go only to block pairs where they have a candidate, and
are verified there by cosine in double precision. A link counts in the list of its two least shared head pivots only, so
that it counts once; a task returns a count and a root for each of its rows, never its pairs.

Pivots are a sample of vectors without near-copies of each other, filled up with fixed random directions; every vector is
indexed. Their number follows the square root of the rows, which keeps lists short, as long as they fit PIVOT_BYTES, the
bound of what is broadcast; with still more rows lists get longer, and all of a list is compared all the same. Recall
against brute force is tested to be 0.98 at least on planted pairs; no pair below the threshold is linked.

Equal vectors are one node with a count, found by a 128-bit hash. Vectors of each length have their own pivots and lists,
as only those of equal length can link.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing, not with their copies
either; other rows that repeat link with each other; a null vec_id counts as a vector, and a component without any other id
has a null id; ties between pivots go to the lower one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop, table, tuned
from .minhash import BLOCK, block_pairs, forest

COSINE = 0.95
#: Pivots that describe a vector, and how many of the nearest make its lists.
PREFIX, HEAD = 12, 6
#: Common pivots of a candidate pair, and the least agreement of their ranks.
SHARED, ORDER = 5, 45
MIN_PIVOTS, PIVOT_BYTES = 32, 64 << 20
#: Pivots that are nearer to each other than this are taken once.
APART = 0.7


def matrix(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are whole, finite, not zero and of that size, as unit doubles, and their places."""
    flat = col.values.slice(col.offsets[0].as_py(), col.offsets[-1].as_py() - col.offsets[0].as_py()) if len(col) else col.values
    off = np.asarray(col.offsets).astype(np.int64)
    off = off - off[0]
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero((np.diff(off) == size) & np.asarray(col.is_valid()))
    got = x[off[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    fine = np.isfinite(got).all(1)
    rows, got = rows[fine], got[fine]
    top = np.abs(got).max(1, initial=0)
    rows, got, top = rows[top > 0], got[top > 0], top[top > 0]
    got = got / top[:, None]
    return rows, got / np.linalg.norm(got, axis=1, keepdims=True)


def pivots_for(rows: int, size: int) -> int:
    """How many pivots so many vectors of that size get."""
    most = min(1 << 16, 1 << int(math.log2(max(MIN_PIVOTS, PIVOT_BYTES // (8 * size)))))
    return min(most, max(MIN_PIVOTS, 1 << round(math.log2(max(1, rows)) / 2)))


def choose_pivots(vectors: DataFrame, size: int, n: int) -> np.ndarray:
    """n unit vectors, from a sample of at most 2 n rows."""
    some = vectors.where(F.size("embedding") == size).orderBy(F.xxhash64("embedding"), "node").limit(2 * n).select("embedding").toArrow()  # so many rows at most
    _, x = matrix(some["embedding"].combine_chunks(), size) if len(some) else (None, np.zeros((0, size)))
    kept = np.zeros((0, size))
    for at in range(0, len(x), 256):
        own = x[at : at + 256]
        own = own[(np.abs(own @ kept.T) < APART).all(1)]
        near, chosen = np.abs(own @ own.T), []
        for i in range(len(own)):
            if not (near[i, chosen] >= APART).any():
                chosen.append(i)
        kept = np.concatenate((kept, own[chosen]))[:n]
    more = np.random.default_rng(11).normal(size=(n - len(kept), size))
    return np.concatenate((kept, more / np.linalg.norm(more, axis=1, keepdims=True)))


def permutations(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """node, copies, prefix (its nearest pivots, nearest first) and keys (its length and pairs of the nearest) of vectors that can link. pivots: by length."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most for a length
    pairs = np.array(list(combinations(range(HEAD), 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in sorted(set(batch.column(2).value_lengths().drop_null().to_pylist()) & sent.value.keys()):
                rows, x = matrix(batch.column(2), size)
                near = np.argsort(-(x @ sent.value[size].T), axis=1, kind="stable")[:, :PREFIX]
                head = np.sort(near[:, :HEAD], axis=1)
                keys = (size << 32) + (head[:, pairs[:, 0]] << 16) + head[:, pairs[:, 1]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(pairs)), pa.array(keys.reshape(-1)))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([v.tobytes() for v in near.astype(np.uint16)], pa.binary()), lists], names=["node", "copies", "prefix", "keys"])

    return vectors.select("node", "copies", "embedding").mapInArrow(run, "node long, copies long, prefix binary, keys array<long>")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole block pairs, many at a time, and where each begins and the last ends."""
    held, n = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held, n = ([*held, batch], n + len(batch)) if len(batch) else (held, n)
            if n < rows:
                continue
        if not n:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids = np.stack([t[x].to_numpy().astype(np.int64) for x in ("key", "p", "q")])
        starts = (np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist()
        if batch is None:
            yield t, [0, *starts, len(t)]
        elif starts:
            yield t.slice(0, starts[-1]), [0, *starts]
            held = t.slice(starts[-1]).to_batches()
            n = len(t) - starts[-1]


def described(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["prefix"].to_pylist()), np.uint16).reshape(-1, PREFIX).astype(np.int64)


def candidates(key: int, p: int, q: int, i: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows u, v of a block pair that belong to its list and agree in enough pivots and in their order."""
    names, ids = np.unique(near, return_inverse=True)
    held = np.zeros((len(near), len(names)), np.float32)
    held[np.arange(len(near))[:, None], ids.reshape(near.shape)] = 1
    if p == q:
        u, v = np.nonzero(held @ held.T >= SHARED)
        u, v = u[u < v], v[u < v]
    else:
        left, right = np.flatnonzero(i == p), np.flatnonzero(i == q)
        u, v = np.nonzero(held[left] @ held[right].T >= SHARED)
        u, v = left[u], right[v]
    if not len(u):
        return u, v
    found = []
    for at in range(0, len(u), 1 << 15):
        a, b = u[at : at + (1 << 15)], v[at : at + (1 << 15)]
        ok = ((near[a][:, :, None] == near[b][:, None, :]) * _RANKS).sum((1, 2)) >= ORDER
        a, b = a[ok], b[ok]
        head = np.sort(near[a][:, :HEAD], axis=1)
        common = (head[:, :, None] == near[b][:, None, :HEAD]).any(2)
        first = common.argmax(1)
        common[np.arange(len(a)), first] = False
        own = key >> 32 << 32 | head[np.arange(len(a)), first] << 16 | head[np.arange(len(a)), common.argmax(1)]
        found.append(np.stack((a, b))[:, own == key])
    u, v = np.concatenate(found, 1)
    return u, v


_RANKS = PREFIX - np.abs(np.arange(PREFIX)[:, None] - np.arange(PREFIX)[None])
_ROWS = "key long, p int, q int, i int, node long, copies long, prefix binary"


def pairs_of(t: pa.Table, bounds: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of each block pair of a table, as its rows."""
    near, i = described(t), t["i"].to_numpy()
    key, p, q = (t[x].to_numpy()[bounds[:-1]].tolist() for x in ("key", "p", "q"))
    for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b - a > 1:
            u, v = candidates(key[n], p[n], q[n], i[a:b], near[a:b])
            if len(u):
                yield a + u, a + v


def partnered(members: DataFrame) -> DataFrame:
    """members (key, size, node, copies, prefix) -> rows of block pairs that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches):
            some = [x for pair in pairs_of(t, bounds) for x in pair]
            if some:
                yield from t.take(pa.array(np.unique(np.concatenate(some)))).combine_chunks().to_batches()

    return block_pairs(members, "key", F.ceil(F.col("size") / BLOCK)).select("key", "p", "q", "i", "node", "copies", "prefix").mapInArrow(run, _ROWS)


def links(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """partnered rows with embedding -> node, links (vectors found in this list), root (least row it reaches in this list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches):
            node, copies, sizes = (t[x].to_numpy() for x in ("node", "copies", "key"))
            sizes = sizes >> 32
            places, unit = np.zeros(len(t), np.int64), {}
            for size in np.unique(sizes).tolist():
                at, unit[size] = matrix(t["embedding"].combine_chunks(), size)
                places[at] = np.arange(len(at))
            out = []
            for u, v in pairs_of(t, bounds):
                x = unit[int(sizes[u[0]])]
                on = np.concatenate([np.einsum("ij,ij->i", x[places[u[k : k + 4096]]], x[places[v[k : k + 4096]]]) >= cosine for k in range(0, len(u), 4096)])
                u, v = u[on], v[on]
                if len(u):
                    a = min(u.min(), v.min())
                    u, v, size = u - a, v - a, max(u.max(), v.max()) - a + 1
                    n = np.bincount(u, copies[a + v], size).astype(np.int64) + np.bincount(v, copies[a + u], size).astype(np.int64)
                    some = np.flatnonzero(n)
                    out.append((node[a + some], n[some], node[a + forest(u, v, size)[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "links", "root"])

    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.select("key", "p", "q", "i", "node", "copies", "prefix", "embedding").mapInArrow(run, "node long, links long, root long")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    tuned(embeddings.sparkSession)
    rows = cut(embeddings.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row"), F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(0x5EED), "embedding", F.size("embedding")).alias("b")), "vectors")
    groups = cut(rows.groupBy("a", "b").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("id")), "groups")
    vectors = cut(rows.select(F.col("row").alias("node"), "embedding").join(groups.select("node", "copies"), "node"), "distinct")
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("s")).count().collect()  # a row for each length
    index = cut(permutations(vectors, {r["s"]: choose_pivots(vectors, r["s"], pivots_for(r["count"], r["s"])) for r in sizes}), "permutations")
    keys = index.select("node", "copies", "prefix", F.explode("keys").alias("key"))
    lists = cut(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    paired = cut(partnered(keys.join(lists, "key")), "partnered")
    found = cut(links(paired.join(vectors.select("node", "embedding"), "node"), cosine), "links")
    drop(paired, lists)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = cut(components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))), "components")
    of = index.select("node", "copies").join(groups.select("node", "a", "b", "id"), "node").join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("id").alias("least"))
    named = cut(of.join(least, "component").select("a", "b", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.lit(True).alias("fine")), "named")
    component = F.when(F.col("fine"), F.col("least")).otherwise(F.col("vec_id"))
    out = rows.select("vec_id", "a", "b").join(named, ["a", "b"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Cosines of all pairs, and reachability.
OP7_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT r, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS x, b.r AS y FROM f a JOIN f b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
n AS (SELECT x AS r, count(*) AS n FROM l GROUP BY x),
t(r, y) AS (SELECT r, r FROM e UNION SELECT t.r, l.y FROM t JOIN l ON t.y = l.x),
c AS (SELECT t.r, min(e.vec_id) AS component_id FROM t JOIN e ON e.r = t.y GROUP BY t.r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c USING (r) LEFT JOIN n USING (r)
"""
