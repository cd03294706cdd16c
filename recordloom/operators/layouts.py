"""Layouts of a collection's files: which to merge, where to cut, what forks share, what may go. Manifests have a row for each file, so their policies run on the driver; what touches records is a plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.canonical import cuts
from .versions import KEY

# Fixed values of the format.
RATIO = 10
TIER_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Group:
    """Neighbouring files that hold commits first .. last."""

    first: int
    last: int
    bytes: int


def tier(size: int, ratio: int = RATIO, base: int = TIER_BYTES) -> int:
    return 0 if size <= base else math.ceil(math.log(size / base, ratio) - 1e-9)


def plan_merge(groups: list[Group], ratio: int = RATIO, base: int = TIER_BYTES) -> list[Group]:
    """Groups in commit order that are to become one; none if nothing is due. The lowest tier first, of that the newest run of groups not above it that is long enough and not mostly one large group."""
    for t in sorted({tier(g.bytes, ratio, base) for g in groups}):
        runs = [list(r) for small, r in groupby(groups, key=lambda g, t=t: tier(g.bytes, ratio, base) <= t) if small]
        for run in reversed(runs):
            if len(run) >= ratio and sum(g.bytes for g in run) >= 2 * max(g.bytes for g in run):
                return run
    return []


def range_cuts(sizes: Iterable[tuple[object, int]], target: int) -> list[object]:
    """Keys after which a range ends: bytes since the last cut have reached the target."""
    out, held = [], 0
    for key, size in sizes:
        held += size
        if held >= target:
            out.append(key)
            held = 0
    return out


def files_of(entries: DataFrame, target: int) -> DataFrame:
    """Content-cut files of entries (type, id, size): a file ends after a cut key, whatever the parts it is built in."""
    rows = entries.withColumn("_cut", cuts(F.col("type"), F.col("id"), F.coalesce("size", F.lit(0)), target))
    before = F.coalesce(F.sum(F.col("_cut").cast("long")).over(Window.partitionBy("commit").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("file", before).groupBy("commit", "file").agg(F.count("*").alias("entries"), F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))


def fork(commits: DataFrame, child: str, at: int) -> DataFrame:
    """The log of a fork: its parent's up to a version."""
    return commits.where(F.col("number") <= at).withColumn("collection", F.lit(child))


def still_needed(files: DataFrame, dropped: str) -> DataFrame:
    """files (collection, file, records, bytes): what dropping a collection lets go, and what others keep."""
    mine, others = files.where(F.col("collection") == dropped), files.where(F.col("collection") != dropped).select("file").distinct().withColumn("_kept", F.lit(True))
    rows = mine.join(others, "file", "left")
    return rows.groupBy(F.coalesce("_kept", F.lit(False)).alias("kept")).agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


def offset_page(marks: DataFrame, records: DataFrame, type_: str, offset: int, limit: int, step: int) -> DataFrame:
    """A page by position: reading begins at the last mark before it."""
    start = marks.where((F.col("type") == type_) & (F.col("position") <= offset)).orderBy(F.desc("position")).limit(1).first()
    own = records.where(F.col("type") == type_)
    if start is None:
        return own.orderBy("id").offset(offset).limit(limit)
    return own.where(F.col("id") >= start["id"]).orderBy("id").offset(offset - start["position"]).limit(limit)  # fewer than step rows are passed over


def shifted(marks: DataFrame, deltas: DataFrame) -> DataFrame:
    """Marks (id, position) after changes (id, delta of +1 or -1): each moves by the changes before it. Changes are one commit's, marks one type's."""
    events = marks.select("id", "position", F.lit(0).alias("d")).unionByName(deltas.select("id", F.lit(None).cast("long").alias("position"), F.col("delta").alias("d")))
    w = Window.partitionBy(F.lit(1)).orderBy("id", F.col("position").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_s", F.sum("d").over(w)).where("position IS NOT NULL").select("id", (F.col("position") + F.col("_s")).alias("position"))


def reachable(kept: DataFrame, manifests: DataFrame) -> DataFrame:
    """Objects that kept versions (version) name in manifests (version, object)."""
    return manifests.join(kept.select("version"), "version", "left_semi").select("object").distinct()


def sweepable(stored: DataFrame, marked: DataFrame, now: int, least_age: int) -> DataFrame:
    """Stored objects (object, created) that nothing reaches and that are old enough."""
    return stored.where(F.col("created") + least_age <= now).join(marked, "object", "left_anti")


def layered_values(layers: DataFrame, keys: DataFrame) -> DataFrame:
    """layers (layer, key, value): each key's value in the newest layer that has it."""
    return layers.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by("value", "layer").alias("value"))


def windows(hits: DataFrame, seconds: int) -> DataFrame:
    """Fixed windows that the first hit after expiry opens, out of (caller, at): caller, opened, hits.

    Hits are counted by caller and second first, and a hit that comes `seconds` or more after the one before always opens a
    window, so a caller's seconds fall into islands that know nothing of each other. Islands are dealt to tasks and read in
    order; a task holds the window that is open and no more.
    """
    each = hits.where("caller IS NOT NULL AND at IS NOT NULL").groupBy("caller", "at").agg(F.count("*").alias("n"))
    w = Window.partitionBy("caller").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(w) >= seconds, F.lit(True))
    islands = each.withColumn("island", F.sum(apart.cast("long")).over(w))
    schema = T.StructType([hits.schema["caller"], T.StructField("opened", T.LongType()), T.StructField("hits", T.LongType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # caller, island, opened, hits
        for batch in batches:
            out = []
            for caller, island, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[:2] == [caller, island] and at < now[2] + seconds:
                    now[3] += n
                    continue
                if now:
                    out.append((now[0], now[2], now[3]))
                now = [caller, island, at, n]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now[0], now[2], now[3]), types, strict=True)], names=schema.names)

    types = [to_arrow_type(f.dataType) for f in schema.fields]
    dealt = islands.repartition("caller", "island").sortWithinPartitions("caller", "island", "at")
    return dealt.select("caller", "island", F.col("at").cast("long").alias("at"), "n").mapInArrow(fold, schema)


def files_cut(rows: DataFrame, target: int, most_bytes: int, most_entries: int) -> DataFrame:
    """Files of entries (type, id, commit, size): a file ends where a key's hash says so, at a change of type, and inside such a stretch wherever its bytes or entries pass a multiple of the most; a key's rows stay together. Adds `file`, the first key of its stretch, and `piece`."""
    keys = rows.groupBy(*KEY).agg(F.sum(F.coalesce("size", F.lit(0))).alias("_b"), F.count("*").alias("_e"), F.max_by("size", "commit").alias("_last"))
    ends = keys.withColumn("_cut", cuts(F.col("type"), F.col("id"), F.coalesce("_last", F.lit(0)), target))
    order = Window.partitionBy("type").orderBy("id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = ends.withColumn("_run", F.coalesce(F.sum(F.col("_cut").cast("long")).over(before), F.lit(0)))
    inner = Window.partitionBy("type", "_run").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    held = lambda c: F.coalesce(F.sum(c).over(inner), F.lit(0))
    placed = run.withColumn("piece", F.greatest(F.floor(held("_b") / most_bytes), F.floor(held("_e") / most_entries)).cast("long"))
    placed = placed.withColumn("file", F.min("id").over(Window.partitionBy("type", "_run")))
    return rows.join(placed.select(*KEY, "file", "piece"), KEY)


def groups_of(files: DataFrame) -> list[Group]:
    """Groups out of files (group, first, last, bytes), oldest first; a row for each group comes to the driver."""
    rows = files.groupBy("group").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("bytes").alias("bytes")).orderBy("first").collect()
    return [Group(r["first"], r["last"], r["bytes"]) for r in rows]


@dataclass(frozen=True)
class RebuildPlan:
    """Merges of neighbouring groups, each a list, what they leave alone, and the layout's number and newest commit."""

    number: int
    through: int
    merges: tuple[tuple[Group, ...], ...]
    untouched: tuple[Group, ...]


def plan_rebuild(groups: list[Group], number: int, through: int, plan: Callable[[list[Group]], list[list[Group]]] | None = None) -> RebuildPlan | None:
    """What a rebuild will do, decided before any file is read: a caller's plan, or the tiers' one merge. None if there is nothing to do."""
    merges = plan(groups) if plan else [m for m in [plan_merge(groups)] if m]
    taken = [g for m in merges for g in m]
    if len(set(taken)) < len(taken):
        raise ValueError("a group is merged twice")
    for m in merges:
        at = [groups.index(g) for g in m]
        if at != list(range(at[0], at[0] + len(at))):
            raise ValueError("only neighbouring groups merge")
    return RebuildPlan(number, through, tuple(map(tuple, merges)), tuple(g for g in groups if g not in taken)) if merges else None


def finish_rebuild(entries: DataFrame, plan: RebuildPlan, retained: list[tuple[int, int]]) -> DataFrame:
    """Entries with the group that holds them after the rebuild: merged ones thinned to what kept versions see, others as they were."""
    from .write import rebuild

    out = []
    for m in plan.merges:
        lo, hi = m[0].first, m[-1].last
        inside = entries.where(F.col("commit").between(lo, hi))
        oldest = lo == min(g.first for x in (*plan.merges, plan.untouched) for g in x)
        thin = rebuild(inside, intersected(retained, lo, hi, plan.through), leading=oldest)
        out.append(thin.withColumn("group", F.lit(lo)))
    for g in plan.untouched:
        out.append(entries.where(F.col("commit").between(g.first, g.last)).withColumn("group", F.lit(g.first)))
    return reduce(DataFrame.unionByName, out)


def intersected(retained: list[tuple[int, int]], lo: int, hi: int, through: int) -> list[tuple[int, int]]:
    """Versions inside a merged stretch that kept versions read it at: those kept in it, and its last one for all later ones."""
    inside = [(max(a, lo), min(b, hi)) for a, b in retained if max(a, lo) <= min(b, hi)]
    later = any(b > hi for _, b in retained) or through > hi
    return [*inside, (hi, hi)] if later else inside


def full_tiers(runs: DataFrame, fan_in: int = 16) -> DataFrame:
    """Of runs (session, seq, tier, bytes, merging) the oldest fan_in free ones of each tier that has so many: what is to be merged next."""
    w = Window.partitionBy("session", "tier")
    free = runs.where("merging IS NULL").withColumn("_n", F.row_number().over(w.orderBy("seq"))).withColumn("_c", F.count("*").over(w))
    return free.where((F.col("_c") >= fan_in) & (F.col("_n") <= fan_in)).drop("_n", "_c")


def runs_for_commit(free: list[tuple[int, int]], merging: int, most: int, fan_in: int = 16) -> list[list[int]]:
    """Groups of runs (seq, bytes) to merge before a commit reads them, smallest first, until at most `most` are left; merging: merges under way, each of which leaves one run."""
    rest, n, out = sorted(free, key=lambda r: r[1]), len(free) + merging, []
    while n > most and len(rest) >= 2:
        k = min(fan_in, n - most + 1, len(rest))
        out.append([seq for seq, _ in rest[:k]])
        rest, n = rest[k:], n - k + 1
    return out


def due_layers(layers: list[tuple[int, int]], fan: int = 4) -> list[int]:
    """Neighbouring layers (number, level), oldest first, that are to become one of the next level: the newest `fan` or more of one level in a row; none if nothing is due."""
    for level in sorted({lv for _, lv in layers}):
        run: list[int] = []
        for n, lv in [*layers, (-1, -1)]:
            if lv == level:
                run.append(n)
            elif len(run) >= fan:
                return run
            else:
                run = []
    return []


def merge_layers(layers: DataFrame, numbers: list[int], into: int, bottom: bool) -> DataFrame:
    """layers (layer, key, value; a null value is a removal) with some merged into one: the newest value of a key stays, and in the bottom layer removals go."""
    own = layers.where(F.col("layer").isin(numbers)).groupBy("key").agg(F.max_by(F.struct("value"), "layer").alias("v"))
    merged = own.select(F.lit(into).cast(layers.schema["layer"].dataType).alias("layer"), "key", F.col("v.value").alias("value"))
    rest = layers.where(~F.col("layer").isin(numbers)).select("layer", "key", "value")
    return rest.unionByName(merged.where("value IS NOT NULL") if bottom else merged)


def from_snapshots(snapshots: DataFrame, last: int) -> DataFrame:
    """Entries (type, id, commit, kind, hash, size) out of whole versions (version, type, id, hash, size) numbered 1 to last: what each version changed. Converts a store that keeps versions to one that keeps commits."""
    w = Window.partitionBy(*KEY).orderBy("version")
    rows = snapshots.withColumn("_v", F.lag("version").over(w)).withColumn("_h", F.lag("hash").over(w)).withColumn("_next", F.lead("version").over(w))
    there = F.coalesce(F.col("_v") == F.col("version") - 1, F.lit(False))
    wrote = rows.where(~there | (F.col("hash") != F.col("_h"))).select(*KEY, F.col("version").alias("commit"), F.lit("r").alias("kind"), "hash", "size")
    left = rows.where((F.coalesce("_next", F.lit(last + 1)) > F.col("version") + 1) | (F.col("_next").isNull() & (F.col("version") < last)))
    gone = left.select(*KEY, (F.col("version") + 1).alias("commit"), F.lit("x").alias("kind"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("size"))
    return wrote.unionByName(gone)
