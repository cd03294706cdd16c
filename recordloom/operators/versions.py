"""Reads of a versioned collection: all follow from the newest entry of a key at a version.

entries has a row for each (type, id, commit): kind r (a record), w (a record whose line is withheld) or x (absent). Every
function prunes by commit and key before it groups, and reads keys, hashes and sizes only unless lines are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

KEY = ["type", "id"]


class NoSuchVersion(ValueError):
    pass


def open_view(entries: DataFrame, version: int, head: int, retained: list[tuple[int, int]] | None = None) -> DataFrame:
    """Entries up to a version; an error if it is not there or no longer kept."""
    if not 0 <= version <= head:
        raise NoSuchVersion(f"version {version} is not among 0 to {head}")
    if retained is not None and not any(lo <= version <= hi for lo, hi in retained):
        raise NoSuchVersion(f"version {version} is not kept")
    return entries.where(F.col("commit") <= version)


def key_range(start: tuple[str, str] | None = None, after: tuple[str, str] | None = None, stop: tuple[str, str] | None = None, only: str | None = None) -> Column:
    """From start (inclusive) or after (exclusive) to stop (exclusive), of one type; in a form that reaches the scan."""
    parts: list[Column] = []
    for bound, low, inclusive in ((start, True, True), (after, True, False), (stop, False, False)):
        if bound:
            t, k = bound
            id_ = (F.col("id") >= k if inclusive else F.col("id") > k) if low else F.col("id") < k
            parts.append((F.col("type") > t if low else F.col("type") < t) | ((F.col("type") == t) & id_))
    if only is not None:
        parts.append(F.col("type") == only)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def newest(entries: DataFrame) -> DataFrame:
    """The newest entry of each key, absent ones too."""
    rest = [c for c in entries.columns if c not in KEY]
    best = entries.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "commit").alias("_e"))
    return best.select(*KEY, *(F.col(f"_e.{c}").alias(c) for c in rest))


def state(entries: DataFrame, version: int) -> DataFrame:
    """Records of a version."""
    return newest(entries.where(F.col("commit") <= version)).where("kind <> 'x'")


def live(records: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """What readers are served: whole lines only, no reserved types, nothing denied."""
    shown = records.where((F.col("kind") == "r") & ~F.col("type").startswith("$"))
    return shown.join(denied.select("hash").distinct(), "hash", "left_anti") if denied is not None else shown


def get_record(entries: DataFrame, version: int, type_: str, id_: str) -> DataFrame:
    """The record of one key, or no row."""
    own = entries.where((F.col("type") == type_) & (F.col("id") == id_) & (F.col("commit") <= version))
    return own.orderBy(F.desc("commit")).limit(1).where("kind <> 'x'")


def states_at(entries: DataFrame, version: int, keys: DataFrame) -> DataFrame:
    """For keys (type, id, ordinal): their record's hash, size, commit and whether it is withheld, or nulls; order is the ordinal."""
    wanted = entries.where(F.col("commit") <= version).join(keys.select(*KEY).distinct(), KEY, "left_semi")
    return keys.join(newest(wanted).where("kind <> 'x'"), KEY, "left").select("ordinal", *KEY, "hash", "size", "commit", (F.col("kind") == "w").alias("withheld"))


def groups(entries: DataFrame, version: int) -> DataFrame:
    """Each key's entries, oldest first."""
    held = F.sort_array(F.collect_list(F.struct("commit", "kind", "hash", "size")))  # at most a key's commits
    return entries.where(F.col("commit") <= version).groupBy(*KEY).agg(held.alias("entries"))


def page(records: DataFrame, limit: int, bounds: Column | None = None) -> DataFrame:
    """The first records in key order within bounds."""
    return (records.where(bounds) if bounds is not None else records).orderBy(*KEY).limit(limit)


def positions(records: DataFrame, within: list[str] = ()) -> DataFrame:
    """Adds `position`, from 0 in key order, counted anew for each value of the columns within.

    Rows are counted inside key ranges, which are settled first as they are sampled, and a small table of the ranges' totals
    is added, so no task holds all rows.
    """
    within = list(within)
    parts = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(records.repartitionByRange(parts, *KEY).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p", *within).orderBy(*KEY)))
    order = Window.partitionBy(*(within or [F.lit(1)])).orderBy("_p")  # a row for each range
    sizes = ranged.groupBy(*within, "_p").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(order) - F.col("_c")).drop("_c")
    return local.join(sizes, [*within, "_p"]).withColumn("position", F.col("_n") + F.col("_before") - 1).drop("_p", "_n", "_before")


def offset_page(records: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page by position, however deep: positions come from counts of ranges, and only the page's rows are sorted together."""
    placed = positions(records).where(F.col("position").between(offset, offset + limit - 1))
    return placed.orderBy("position").drop("position")


def export(records: DataFrame) -> DataFrame:
    """Every record in key order, by a range partitioning of keys."""
    return records.orderBy(*KEY)


def counts(records: DataFrame) -> DataFrame:
    """Records and bytes of each type; withheld ones count."""
    return records.groupBy("type").agg(F.count("*").alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def history(entries: DataFrame, version: int, type_: str, id_: str) -> DataFrame:
    """Every entry of one key, newest first."""
    return entries.where((F.col("type") == type_) & (F.col("id") == id_) & (F.col("commit") <= version)).orderBy(F.desc("commit"))


def changes_of_state(entries: DataFrame) -> DataFrame:
    """Entries that change their key, labelled added, updated or removed; rewrites to the same hash and removals of nothing go."""
    before = F.lag("hash").over(Window.partitionBy(*KEY).orderBy("commit"))
    label = F.when(F.col("hash").isNull(), "removed").when(F.col("before").isNull(), "added").otherwise("updated")
    return entries.withColumn("before", before).where(~F.col("hash").eqNullSafe(F.col("before"))).withColumn("label", label)


def touched(entries: DataFrame, since: int, until: int) -> DataFrame:
    """Keys with an entry in (since, until]."""
    return entries.where((F.col("commit") > since) & (F.col("commit") <= until)).select(*KEY).distinct()


def changes(entries: DataFrame, since: int, until: int) -> DataFrame:
    """Keys touched in (since, until] with their newest entry at until, changed or not."""
    return newest(entries.where(F.col("commit") <= until).join(touched(entries, since, until), KEY, "left_semi"))


def diff(entries: DataFrame, since: int, until: int) -> DataFrame:
    """Keys that end otherwise than they began: hashes and sizes before and after, and what happened. One grouping answers both versions."""
    own = entries.where(F.col("commit") <= until).join(touched(entries, since, until), KEY, "left_semi")
    cell = F.struct("kind", "hash", "size", "commit")
    both = own.groupBy(*KEY).agg(F.max_by(cell, "commit").alias("b"), F.max_by(F.when(F.col("commit") <= since, cell), F.when(F.col("commit") <= since, F.col("commit"))).alias("a"))
    side = lambda s, c: F.when(F.col(f"{s}.kind") != "x", F.col(f"{s}.{c}"))
    rows = both.select(*KEY, side("a", "hash").alias("before_hash"), side("b", "hash").alias("after_hash"), side("a", "size").alias("before_size"), side("b", "size").alias("after_size"))
    label = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "removed").otherwise("updated")
    return rows.where(~F.col("before_hash").eqNullSafe(F.col("after_hash"))).withColumn("change", label)


def split_diff(changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of records, and one row that sums up reserved types."""
    reserved = F.col("type").startswith("$")
    flag = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    assets = lambda k: F.coalesce(F.sum(((F.col("type") == "$asset") & (F.col("change") == k)).cast("long")), F.lit(0))
    meta = changed.where(reserved).agg(flag(F.col("type") == "$schema").alias("schema_changed"), flag(F.col("type") == "$meta").alias("metadata_changed"), assets("added").alias("files_added"), assets("removed").alias("files_removed"))
    return changed.where(~reserved), meta


def pages_by_bytes(rows: DataFrame, size: str, limit: int, most_bytes: int) -> DataFrame:
    """The first page: limit rows at most, and none that would pass most_bytes, but the first always. The window runs over limit rows."""
    first = rows.orderBy(*KEY).limit(limit)
    w = Window.partitionBy(F.lit(1)).orderBy(*KEY)
    summed = first.withColumn("_sum", F.sum(F.coalesce(F.col(size), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return summed.where((F.col("_sum") <= most_bytes) | (F.col("_n") == 1)).drop("_sum", "_n")


def conflicts(entries: DataFrame, base: int, number: int) -> DataFrame:
    """Keys that commit `number`, made on `base`, wrote and others changed meanwhile."""
    mine = entries.where(F.col("commit") == number).select(*KEY, F.col("hash").alias("mine"))
    theirs = changes(entries, base, number - 1).select(*KEY, F.col("hash").alias("theirs"), F.col("commit").alias("their_commit"))
    return mine.join(theirs, KEY)


def rank_of(records: DataFrame, type_: str, id_: str) -> DataFrame:
    """Records before a key, and after it."""
    before = (F.col("type") < type_) | ((F.col("type") == type_) & (F.col("id") < id_))
    after = (F.col("type") > type_) | ((F.col("type") == type_) & (F.col("id") > id_))
    return records.agg(F.count_if(before).alias("rank"), F.count_if(after).alias("after"))


def entry_at(records: DataFrame, position: int) -> DataFrame:
    return offset_page(records, position, 1)


def marks(records: DataFrame, step: int) -> DataFrame:
    """Every step-th record of a type with its position."""
    return positions(records.select(*KEY), ["type"]).where(F.col("position") % step == 0).select(*KEY, "position")


def kept_version(retained: list[tuple[int, int]], version: str = "commit") -> Column:
    """Whether a version is kept."""
    return reduce(lambda a, b: a | b, [F.col(version).between(lo, hi) for lo, hi in retained], F.lit(False))


def files_to_read(files: DataFrame, start: tuple[str, str] | None = None, stop: tuple[str, str] | None = None) -> DataFrame:
    """files (first_type, first_id, last_type, last_id) whose keys may lie in a range; others are skipped unread."""
    out = files
    if start:
        t, k = start
        out = out.where((F.col("last_type") > t) | ((F.col("last_type") == t) & (F.col("last_id") >= k)))
    if stop:
        t, k = stop
        out = out.where((F.col("first_type") < t) | ((F.col("first_type") == t) & (F.col("first_id") < k)))
    return out


def type_details(records: DataFrame, schemas: DataFrame, shown: str | None = None) -> DataFrame:
    """A version in detail: (type, count, bytes, schema) of each type that has a schema, or of the one that is shown."""
    n = counts(live(records))
    own = schemas if shown is None else schemas.where(F.col("type") == shown)
    return own.select("type", F.col("hash").alias("schema")).join(n, "type", "left").select("type", F.coalesce("records", F.lit(0)).alias("count"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "schema")


def merge_sets(public: DataFrame, private: DataFrame, member: bool) -> DataFrame:
    """Records of the sets that a reader may see."""
    shown = public.withColumn("set", F.lit("public"))
    return shown.unionByName(private.withColumn("set", F.lit("private"))) if member else shown


def diff_sets(before: DataFrame, after: DataFrame, moves: bool = False) -> DataFrame:
    """Difference of two versions with sets; a move with the same hash counts only if asked for."""
    a, b = (x.select(*KEY, F.col("hash").alias(f"{n}_hash"), F.col("set").alias(f"{n}_set")) for x, n in ((before, "before"), (after, "after")))
    differs = ~F.col("before_hash").eqNullSafe(F.col("after_hash"))
    return a.join(b, KEY, "full_outer").where(differs | ~F.col("before_set").eqNullSafe(F.col("after_set")) if moves else differs)


def visible_spans(entries: DataFrame, retained: list[tuple[int, int]], leading: bool = True) -> DataFrame:
    """Entries that some kept version sees: an entry of commit c is read by versions c to the key's next commit less one; with leading, removals with nothing before them go."""
    w = Window.partitionBy(*KEY).orderBy("commit")
    rows = entries.withColumn("_next", F.lead("commit").over(w))
    seen = reduce(lambda a, b: a | b, [(F.col("commit") <= hi) & (F.col("_next").isNull() | (F.col("_next") > lo)) for lo, hi in retained], F.lit(False))
    if not leading:
        return rows.where(seen).drop("_next")
    kept = rows.where(seen).withColumn("_first", F.row_number().over(w) == 1)
    return kept.where(~(F.col("_first") & (F.col("kind") == "x"))).drop("_next", "_first")


def find_version(commits: DataFrame, selector: str) -> DataFrame:
    """The commit that latest, a (partial) semver with or without v, an id or a bare hash names; the highest number wins."""
    s = selector.strip()
    if s == "latest":
        found = commits
    elif s.lstrip("v").replace(".", "").isdigit() and len(s) < 40:
        want = s.lstrip("v")
        found = commits.where((F.col("semver") == want) | F.col("semver").startswith(want + "."))
    else:
        found = commits.where(F.col("hash") == s.rpartition(":")[2].lower())
    return found.orderBy(F.desc("number")).limit(1)
