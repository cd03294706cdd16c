"""Merkle trees over sorted records: leaves and nodes end where a key's hash says so, or when they are full.

Positions are counted inside key ranges, and ranges are joined by small tables of their totals, so no task holds a type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import leaf_boundary
from .lineage import settled

# Fixed values of the format.
LEAF_BITS, LEAF_MOST = 10, 8192
STEP_BITS, NODE_MOST = 6, 1024


def _boundary(key: str, bits: int) -> Column:
    if bits <= 16:
        return leaf_boundary(F.col(key), bits)
    low = F.conv(F.substring(F.sha2(F.col(key).cast("binary"), 256), 5, 12), 16, 10).cast("long")
    return low % (1 << min(bits, 48)) == 0


def cut_runs(rows: DataFrame, by: str, key: str, bits: int, most: int) -> DataFrame:
    """Adds `run`, a number that rows of one node share: a node ends after a boundary key, or with `most` rows.

    The ranged rows are settled before both sides of the join read them: ranges are sampled, and a second evaluation would
    cut elsewhere.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(rows.repartitionByRange(parts, by, key).withColumn("_p", F.spark_partition_id()).withColumn("_b", _boundary(key, bits)))
    w = Window.partitionBy("_p", by).orderBy(key)
    local = ranged.withColumn("_n", F.row_number().over(w))
    local = local.withColumn("_ends", F.max(F.when(F.col("_b"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    totals = local.groupBy(by, "_p").agg(F.count("*").alias("_c"), F.max(F.when(F.col("_b"), F.col("_n"))).alias("_last"))
    order = Window.partitionBy(by).orderBy("_p")  # a row for each range
    totals = totals.withColumn("_before", F.sum("_c").over(order) - F.col("_c"))
    totals = totals.withColumn("_end", F.max(F.col("_before") + F.col("_last")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out = local.join(totals.select(by, "_p", "_before", "_end"), [by, "_p"])
    start = F.coalesce(F.col("_before") + F.col("_ends"), F.col("_end"), F.lit(0))  # rows before the run of the last boundary
    at = F.col("_before") + F.col("_n") - 1
    return out.withColumn("run", start + F.floor((at - start) / most) * most).drop("_p", "_b", "_n", "_ends", "_before", "_end")


def _quoted(c: str) -> Column:
    return F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")


def leaf_rows(records: DataFrame, bits: int = LEAF_BITS, most: int = LEAF_MOST) -> DataFrame:
    """Records (type, id, hash, size) with the run of their leaf; in order of (type, run, id) they are what an iteration over leaves reads."""
    return cut_runs(records.select("type", "id", "hash", "size"), "type", "id", bits, most)


def leaves_of(rows: DataFrame) -> DataFrame:
    """(type, run, last_key, count, bytes, hash) of each leaf of rows that have their run."""
    entry = F.struct("id", F.concat(F.lit("["), _quoted("id"), F.lit(',"'), "hash", F.lit('",'), F.col("size").cast("string"), F.lit("]")).alias("e"))
    held = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]), ",")  # at most a leaf's entries
    found = rows.groupBy("type", "run").agg(F.max("id").alias("last_key"), F.count("*").alias("count"), F.sum("size").alias("bytes"), held.alias("_e"))
    return found.withColumn("hash", F.sha2(F.concat(F.lit('{"e":['), "_e", F.lit('],"t":"leaf"}')).cast("binary"), 256)).drop("_e")


def leaves(records: DataFrame, bits: int = LEAF_BITS, most: int = LEAF_MOST) -> DataFrame:
    """(type, run, last_key, count, bytes, hash) of each leaf of records (type, id, hash, size)."""
    return leaves_of(leaf_rows(records, bits, most))


def nodes(children: DataFrame, level: int, bits: int = LEAF_BITS, step: int = STEP_BITS, most: int = NODE_MOST) -> DataFrame:
    """The next level over nodes (type, last_key, count, bytes, hash)."""
    natural = bits + step * level
    rows = cut_runs(children.select("type", "last_key", "count", "bytes", "hash"), "type", "last_key", natural, most)
    entry = F.struct("last_key", F.concat(F.lit("["), _quoted("last_key"), F.lit(',"'), "hash", F.lit('",'), F.col("count").cast("string"), F.lit(","), F.col("bytes").cast("string"), F.lit("]")).alias("e"))
    held = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]), ",")  # at most `most` children
    found = rows.groupBy("type", "run").agg(F.max("last_key").alias("last_key"), F.sum("count").alias("count"), F.sum("bytes").alias("bytes"), held.alias("_e"))
    return found.withColumn("hash", F.sha2(F.concat(F.lit('{"e":['), "_e", F.lit(f'],"l":{level},"t":"node"}}')).cast("binary"), 256)).drop("_e")


def roots(records: DataFrame, bits: int = LEAF_BITS, most: int = LEAF_MOST, step: int = STEP_BITS, node_most: int = NODE_MOST) -> DataFrame:
    """(type, hash, count, bytes) of each type's root; a level is built while some type has several nodes on it."""
    done, level, now = None, 0, leaves(records, bits, most)
    while True:
        now = settled(now)
        single = now.groupBy("type").agg(F.count("*").alias("_n")).where("_n = 1").select("type")
        top = now.join(single, "type", "left_semi").select("type", "hash", "count", "bytes")
        done = top if done is None else done.unionByName(top)
        now = now.join(single, "type", "left_anti")
        if not now.head(1):
            return done
        level += 1
        now = nodes(now, level, bits, step, node_most)


def tree_diff(before: DataFrame, after: DataFrame, bits: int = LEAF_BITS, most: int = LEAF_MOST) -> DataFrame:
    """Differences of two versions' records, read from leaves that the other version lacks only."""
    cut = [settled(leaf_rows(x, bits, most)) for x in (before, after)]
    hashed = [settled(leaves_of(x)) for x in cut]

    def apart(own: int, name: str) -> DataFrame:
        lone = hashed[own].join(hashed[1 - own].select("type", "hash"), ["type", "hash"], "left_anti")
        return cut[own].join(lone.select("type", "run"), ["type", "run"], "left_semi").select("type", "id", F.col("hash").alias(name))

    return apart(0, "before_hash").join(apart(1, "after_hash"), ["type", "id"], "full_outer").where(~F.col("before_hash").eqNullSafe(F.col("after_hash")))


def verify_tree(told: DataFrame, records: DataFrame, bits: int = LEAF_BITS, most: int = LEAF_MOST, step: int = STEP_BITS, node_most: int = NODE_MOST) -> DataFrame:
    """told (type, hash, count, bytes) against what records give: (type, problem), where a root is missing, not told, or of another hash, count or size."""
    t, r = (x.select("type", *(F.col(c).alias(f"{n}_{c}") for c in ("hash", "count", "bytes"))) for x, n in ((told, "t"), (roots(records, bits, most, step, node_most), "r")))
    problem = (
        F.when(F.col("r_hash").isNull(), "no records")
        .when(F.col("t_hash").isNull(), "not told")
        .when(F.col("t_count") != F.col("r_count"), "count")
        .when(F.col("t_bytes") != F.col("r_bytes"), "bytes")
        .when(F.col("t_hash") != F.col("r_hash"), "hash")
    )
    return t.join(r, "type", "full_outer").select("type", problem.alias("problem")).where("problem IS NOT NULL")


def commit_roots(entries: DataFrame, head: int, bits: int = LEAF_BITS, most: int = LEAF_MOST, step: int = STEP_BITS, node_most: int = NODE_MOST) -> DataFrame:
    """(type, hash, count, bytes, was): roots of a version and what they were before it, for types that it changes."""
    from .versions import state

    now, old = (roots(state(entries, v), bits, most, step, node_most) for v in (head, head - 1))
    both = now.join(old.select("type", F.col("hash").alias("was")), "type", "left")
    return both.where(~F.col("hash").eqNullSafe(F.col("was")))
