"""Where a record has been: presence intervals, forks, first appearances and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

PLACE = ["hash", "collection", "type", "id"]


def events_of(references: DataFrame, hashes: Column) -> DataFrame:
    """Events of hashes in order; an add sorts before a removal of the same version."""
    return references.where(hashes).orderBy("hash", "collection", "seq", "op")


def _turns(references: DataFrame, place: list[str]) -> DataFrame:
    """Events with the one before at their place."""
    return references.withColumn("_b", F.lag("op").over(Window.partitionBy(*place).orderBy("seq", "op")))


def presence(references: DataFrame, place: list[str] = PLACE) -> DataFrame:
    """Half-open intervals [from_seq, to_seq) in which a place holds a hash: repeated adds go on, removals of nothing go."""
    turns = _turns(references, place).where(F.col("op") != F.coalesce("_b", F.lit("-")))
    w = Window.partitionBy(*place).orderBy("seq", "op")
    return turns.withColumn("to_seq", F.lead("seq").over(w)).where("op = '+'").select(*place, F.col("seq").alias("from_seq"), "to_seq")


def inherited_removals(references: DataFrame, place: list[str] = PLACE) -> DataFrame:
    """The first removal at each place of what it had not added: a fork dropping what it inherited."""
    lone = _turns(references, place).where((F.col("op") == "-") & (F.coalesce("_b", F.lit("-")) == "-"))
    return lone.groupBy(*place).agg(F.min("seq").alias("removed"))


#: Steps of paths that may be walked on the driver and broadcast; 64 MB or so.
WALKED = 500_000


def _walked(forks: DataFrame) -> DataFrame | None:
    """Paths of a small table of forks; None if it is not one."""
    rows = forks.select("parent", "child", "at", "private").limit(WALKED + 1).collect()
    up = {r["child"]: r for r in rows}
    out, left = [], WALKED
    if len(rows) > WALKED or len(up) < len(rows):
        return None
    for end in up:
        steps, at = [], end
        while at in up and len(steps) <= len(up):
            r = up[at]
            steps.insert(0, (r["child"], r["at"], r["private"]))
            at = r["parent"]
            left -= len(steps)
            if left < 0:
                return None
            out.append((at, end, list(steps)))
    kind = forks.schema["child"].dataType.simpleString()
    return F.broadcast(forks.sparkSession.createDataFrame(out, f"collection {kind}, child {kind}, steps array<struct<child: {kind}, at: long, private: boolean>>"))


def fork_paths(forks: DataFrame) -> DataFrame:
    """(collection, child, steps) for every collection and every fork below it: the forks (child, at, private) on the way, in order.

    A table of few forks is walked on the driver, and its paths are broadcast; of more, lengths double each round.
    """
    small = _walked(forks)
    if small is not None:
        return small
    step = F.struct("child", "at", "private")
    every = longest = settled(forks.select(F.col("parent").alias("collection"), "child", F.array(step).alias("steps")))
    size = 1
    while True:
        on = every.select(F.col("collection").alias("child"), F.col("child").alias("_c"), F.col("steps").alias("_s"))
        more = settled(longest.join(on, "child").select("collection", F.col("_c").alias("child"), F.concat("steps", "_s").alias("steps")))
        if not more.head(1):
            return every
        size *= 2
        every, longest = every.unionByName(more), more.where(F.size("steps") == size)


def into_forks(references: DataFrame, forks: DataFrame) -> DataFrame:
    """Presence intervals, carried into forks (child, parent, at, private) of any depth.

    references have a column set (public or private). A fork's version 1 holds what its parent held at the fork point, until
    the fork removes it; private places are carried only into forks made with the private set, and a place that is already
    there from version 1 is not carried again. Each interval meets the forks below its collection at once, and a place is
    carried to one if every fork on the way holds it at the next one's fork point.
    """
    place = [*PLACE, "set"]
    rest = [c for c in place if c != "collection"]
    own = presence(references, place)
    first = F.col("steps")[0]["at"]
    held = (F.col("from_seq") <= first) & (F.col("to_seq").isNull() | (F.col("to_seq") > first))
    met = own.join(fork_paths(forks), "collection").where(held & ((F.col("set") == "public") | F.forall("steps", lambda x: x["private"])))
    each = met.select(*rest, F.col("collection").alias("root"), F.col("child").alias("fork"), "steps", F.posexplode("steps").alias("k", "s"))
    each = each.select(*rest, "root", "fork", F.col("s.child").alias("collection"), F.try_element_at("steps", F.col("k") + 2)["at"].alias("next_at"))
    there = own.where("from_seq = 1").select(*place, F.lit(True).alias("there"))
    known = each.join(inherited_removals(references, place), place, "left").join(there, place, "left")
    on = F.col("there").isNull() & (F.col("next_at").isNull() | ((F.col("next_at") >= 1) & (F.col("removed").isNull() | (F.col("next_at") < F.col("removed")))))
    carried = known.groupBy(*rest, "root", "fork").agg(F.bool_and(on).alias("on"), F.max(F.when(F.col("collection") == F.col("fork"), F.col("removed"))).alias("to_seq")).where("on")
    carried = carried.select("hash", F.col("fork").alias("collection"), "type", "id", "set", F.lit(1).cast("long").alias("from_seq"), "to_seq").distinct()
    return own.unionByName(carried)


def presence_of(references: DataFrame, forks: DataFrame, hash_: str) -> DataFrame:
    """Where a record is and was, forks included."""
    return into_forks(references.where(F.col("hash") == hash_), forks)


def presence_summary(intervals: DataFrame) -> DataFrame:
    """Of each hash: its intervals, those still open, and its collections."""
    return intervals.groupBy("hash").agg(F.count("*").alias("intervals"), F.count_if(F.col("to_seq").isNull()).alias("open"), F.countDistinct("collection").alias("collections"))


def first_seen(references: DataFrame) -> DataFrame:
    """The earliest add of each hash."""
    best = references.where("op = '+'").groupBy("hash").agg(F.min_by(F.struct("collection", "type", "id", "seq"), F.struct("seq", "collection", "id")).alias("f"))
    return best.select("hash", "f.*")


def ordered_lookup(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of keys (hash, ordinal) in their order; keys without a row go."""
    return keys.join(rows, "hash").orderBy("ordinal")


def reference_counts(files: DataFrame) -> DataFrame:
    """Records that name each file, out of (record, files)."""
    return files.select("record", F.explode(F.array_distinct("files")).alias("file")).groupBy("file").agg(F.count("*").alias("records"))


def apply_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters (file, n) after signed deltas; zero goes, and a negative count stays to be reported."""
    both = counts.select("file", "n").unionByName(deltas.select("file", F.col("d").alias("n")))
    return both.groupBy("file").agg(F.sum("n").alias("n")).where("n <> 0")


def resolve(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (src, hash, collection) to the places that hold their hash; a link that names a collection takes that one."""
    t = targets.select(F.col("hash").alias("_h"), F.col("collection").alias("at"), "type", "id")
    there = (F.col("hash") == F.col("_h")) & (F.col("collection").isNull() | (F.col("collection") == F.col("at")))
    return links.join(t, there, "left").drop("_h")
