"""Writes and upkeep of a versioned collection, as plans over its entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import KEY, newest, visible_spans


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in the given order, which stands for arrival."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_runs(runs: list[DataFrame], key: list[str] = KEY) -> DataFrame:
    """Union of runs, of which later ones take precedence."""
    both = reduce(DataFrame.unionByName, [r.withColumn("_run", F.lit(n)) for n, r in enumerate(runs)])
    return last_wins(both, key, ["_run"]).drop("_run")


def save(head: DataFrame, output: DataFrame, mode: str = "set", scope: Column | None = None) -> DataFrame:
    """What a save changes: (type, id, op, hash). In set mode records in scope that the output lacks are removed; equal ones are left out."""
    a = head.select(*KEY, F.col("hash").alias("_old"), (scope if scope is not None else F.lit(True)).alias("_in"))
    b = output.select(*KEY, F.col("hash").alias("_new"))
    op = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    rows = a.join(b, KEY, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    gone = F.col("_new").isNull()
    rows = rows.where(~gone | F.coalesce(F.col("_in"), F.lit(False))) if mode == "set" else rows.where(~gone)
    return rows.select(*KEY, op.alias("op"), F.col("_new").alias("hash"))


def without_no_ops(upload: DataFrame, head: DataFrame) -> DataFrame:
    """Rows of an upload (type, id, kind, hash) that change the head."""
    rows = upload.join(head.select(*KEY, F.col("hash").alias("_old")), KEY, "left")
    return rows.where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def route_sets(delta: DataFrame) -> DataFrame:
    """Each row (type, id, set, hash) as an upsert of its set and a delete from the other."""
    other = F.when(F.col("set") == "public", "private").otherwise("public")
    ops = F.array(F.struct(F.col("set").alias("set"), F.lit("upsert").alias("op")), F.struct(other.alias("set"), F.lit("delete").alias("op")))
    return delta.select(*KEY, "hash", F.explode(ops).alias("_o")).select(*KEY, F.col("_o.set").alias("set"), F.col("_o.op").alias("op"), F.when(F.col("_o.op") == "upsert", F.col("hash")).alias("hash"))


def carried_over(head: DataFrame, upload: DataFrame) -> DataFrame:
    """Records that an upload does not replace."""
    return head.join(upload.select(*KEY), KEY, "left_anti")


def rebuild(entries: DataFrame, retained: list[tuple[int, int]], takedown: Column | None = None, leading: bool = True) -> DataFrame:
    """Entries thinned to what kept versions see; records that a takedown names are withheld. leading: removals with nothing older go, which is right if no older entries are left out."""
    kept = visible_spans(entries, retained, leading)
    return kept.withColumn("kind", F.when((F.col("kind") == "r") & takedown, "w").otherwise(F.col("kind"))) if takedown is not None else kept


def squash(entries: DataFrame, base: int, number: int) -> DataFrame:
    """One commit in place of those after base: the newest entry of each key they write, without no-ops."""
    own = newest(entries.where(F.col("commit") > base))
    before = newest(entries.where(F.col("commit") <= base).join(own.select(*KEY), KEY, "left_semi")).where("kind <> 'x'")
    return without_no_ops(own, before).withColumn("commit", F.lit(number))


def semvers(bumps: DataFrame, by: str = "collection", order: str = "seq") -> DataFrame:
    """Semver of each version from its bump (major, minor, patch); the first is 1.0.0. Resets become counts within islands."""
    w = Window.partitionBy(by).orderBy(order)
    first = F.row_number().over(w) == 1
    rows = bumps.withColumn("_bump", F.when(first, "major").otherwise(F.col("bump")))
    rows = rows.withColumn("major", F.sum((F.col("_bump") == "major").cast("long")).over(w))
    rows = rows.withColumn("minor", F.sum((F.col("_bump") == "minor").cast("long")).over(Window.partitionBy(by, "major").orderBy(order)))
    rows = rows.withColumn("patch", F.sum((F.col("_bump") == "patch").cast("long")).over(Window.partitionBy(by, "major", "minor").orderBy(order)))
    return rows.drop("_bump").withColumn("semver", F.concat_ws(".", *(F.col(x).cast("string") for x in ("major", "minor", "patch"))))


def bump_of(schema_changed: Column, records_changed: Column) -> Column:
    return F.when(schema_changed, "major").when(records_changed, "minor").otherwise("patch")


def running_stats(changes: DataFrame) -> DataFrame:
    """Records and bytes after each commit from its changes (commit, before_size, after_size, change): deltas, then a running sum over commits."""
    step = F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", -1).otherwise(0)
    grown = F.coalesce("after_size", F.lit(0)) - F.coalesce("before_size", F.lit(0))
    deltas = changes.groupBy("commit").agg(F.sum(step).alias("d"), F.sum(grown).alias("b"))
    w = Window.partitionBy(F.lit(1)).orderBy("commit")  # a row for each commit
    return deltas.select("commit", F.sum("d").over(w).alias("records"), F.sum("b").over(w).alias("bytes"))


def sweep(stored: DataFrame, listed: DataFrame, ledger: DataFrame, trash: DataFrame, now: int, grace: int) -> DataFrame:
    """Next state of every stored name: named ones are kept (and saved from the ledger), others condemned, trashed after grace and purged after it again; names that are listed and not stored are missing."""
    s, l, c, t = (x.withColumn(f"_{n}", F.lit(True)) for x, n in ((stored, "s"), (listed, "l"), (ledger, "c"), (trash, "t")))
    rows = s.join(l, "name", "full_outer").join(c, "name", "full_outer").join(t, "name", "full_outer")
    has = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(False))
    verdict = (
        F.when(has("l") & ~has("s") & has("t"), "restore")
        .when(has("l") & ~has("s"), "missing")
        .when(has("l") & has("c"), "pardon")
        .when(has("l"), "keep")
        .when(has("t"), F.when(F.col("trashed") + grace <= now, "purge").otherwise("wait"))
        .when(has("c") & has("s"), F.when(F.col("condemned") + grace <= now, "trash").otherwise("wait"))
        .when(has("s"), "condemn")
        .otherwise("forget")
    )
    return rows.select("name", verdict.alias("verdict"), "bytes")


def new_nodes(after: DataFrame, before: DataFrame, key: str = "hash") -> DataFrame:
    """Objects that one version reaches and another does not."""
    return after.select(key).distinct().join(before.select(key), key, "left_anti")


def reclaim(stored: DataFrame, reached: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows that some kept version reaches."""
    return stored.join(reached.select(*key).distinct(), key, "left_semi")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Upserts and deletes between two snapshots."""
    up = after.join(before.select(*KEY, "hash"), [*KEY, "hash"], "left_anti").select(*KEY, F.lit("upsert").alias("op"), "hash")
    gone = before.join(after.select(*KEY), KEY, "left_anti").select(*KEY, F.lit("delete").alias("op"), F.lit(None).cast("string").alias("hash"))
    return up.unionByName(gone)


def reconcile(counters: DataFrame, counted: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose stored counter is not what a recount gives."""
    both = counters.select(key, F.col(value).alias("stored")).join(counted.select(key, F.col(value).alias("actual")), key, "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("actual")))


def match_ids(columns: DataFrame, ids: DataFrame) -> DataFrame:
    """columns (column, value) against ids (collection, type, id): distinct values of a column that are ids of a type, and of how many."""
    values = columns.where("value IS NOT NULL").distinct()
    of = values.groupBy("column").agg(F.count("*").alias("of"))
    hits = values.join(ids.select("collection", "type", F.col("id").alias("value")).distinct(), "value").groupBy("collection", "type", "column").agg(F.count("*").alias("hits"))
    return hits.join(of, "column")


def normalize_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed ranges as few disjoint ones, ascending; neighbours join."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(r for r in ranges if r[0] <= r[1]):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def intersect_ranges(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return normalize_ranges([(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b])


def visible_files(public: DataFrame, private: DataFrame, member: bool, limit: int) -> DataFrame:
    """Files (file) of the sets that a reader may see, each once, in order, at most limit."""
    shown = public.select("file").unionByName(private.select("file")) if member else public.select("file")
    return shown.distinct().orderBy("file").limit(limit)


def merge_cumulative(files: DataFrame, added: DataFrame) -> DataFrame:
    """All files (file, size) that any version has named: those so far and what a version adds, each once."""
    return files.select("file", "size").unionByName(added.select("file", "size").join(files.select("file"), "file", "left_anti").dropDuplicates(["file"]))


def usage_rollup(events: DataFrame, batch: str, keys: list[str]) -> DataFrame:
    """Sums of amounts by keys, rebuilt from a log that may hold a batch more than once: a batch's hash counts once."""
    return events.dropDuplicates([batch]).groupBy(*keys).agg(F.sum("amount").alias("amount"))


def add_usage(rollup: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """A rollup after a batch is added to it."""
    return rollup.unionByName(batch.groupBy(*keys).agg(F.sum("amount").alias("amount")).select(rollup.columns)).groupBy(*keys).agg(F.sum("amount").alias("amount"))


def collection_stats(files: DataFrame) -> DataFrame:
    """files (collection, file, entries, line_bytes, stored_bytes), which versions share: of each collection its files, entries and bytes, a file counted once."""
    own = files.groupBy("collection", "file").agg(*(F.max(c).alias(c) for c in ("entries", "line_bytes", "stored_bytes")))
    return own.groupBy("collection").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("entries", "line_bytes", "stored_bytes")))


def changed_fields(before: Column, after: Column) -> Column:
    """Names of the members in which two maps differ, in order; native."""
    names = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    return F.filter(names, lambda f: ~F.try_element_at(before, f).eqNullSafe(F.try_element_at(after, f)))


def diff_counts(changed: DataFrame) -> DataFrame:
    """Changes of each type and kind."""
    return changed.groupBy("type", "change").agg(F.count("*").alias("n"))


def account(changes: DataFrame, tallies: dict[str, Column]) -> DataFrame:
    """A row of sums over changes, one for each tally: accounting of every change in the pass that reads them."""
    return changes.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in tallies.items()))


def pack(after: DataFrame, before: DataFrame) -> DataFrame:
    """Objects (hash, line) that a version reaches and its base does not, each once."""
    return after.select("hash", "line").dropDuplicates(["hash"]).join(before.select("hash").distinct(), "hash", "left_anti")


def receive(packed: DataFrame, target: DataFrame, have: DataFrame) -> DataFrame:
    """What does not hold of a pack against the version it is to complete: (hash, problem) of objects whose bytes hash otherwise, that the version does not name, or that it names and nobody has."""
    bad = packed.where(F.sha2(F.col("line").cast("binary"), 256) != F.col("hash")).select("hash", F.lit("bytes").alias("problem"))
    stray = packed.join(target.select("hash"), "hash", "left_anti").select("hash", F.lit("not named").alias("problem"))
    known = packed.select("hash").unionByName(have.select("hash"))
    lost = target.select("hash").distinct().join(known, "hash", "left_anti").select("hash", F.lit("missing").alias("problem"))
    return bad.unionByName(stray).unionByName(lost)


def verify_records(records: DataFrame) -> DataFrame:
    """Rows whose line does not hash or measure to what the entry says."""
    return records.where((F.sha2(F.col("line").cast("binary"), 256) != F.col("hash")) | (F.octet_length("line") != F.col("size")))


def verify_log(commits: DataFrame) -> DataFrame:
    """Problems of a log (collection, number, previous, hash, base): gaps, broken chains and bases that are not earlier."""
    w = Window.partitionBy("collection").orderBy("number")
    rows = commits.withColumn("_n", F.lag("number").over(w)).withColumn("_h", F.lag("hash").over(w))
    problem = (
        F.when(F.col("_n").isNull() & (F.col("number") != 1), "gap")
        .when(F.col("number") - F.col("_n") != 1, "gap")
        .when(~F.col("previous").eqNullSafe(F.col("_h")), "chain")
        .when(F.col("base") >= F.col("number"), "base")
    )
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("collection", "number", "problem")
