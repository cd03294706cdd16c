"""Reads against an in-memory model, at every version of random collections."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import versions as V
from recordloom.operators import write as M

TYPES, SCHEMA = ["a", "b", "é", "zz"], "type string, id string, commit int, kind string, hash string, size long"


def uploads(seed):
    r, out = random.Random(seed), []
    for commit in range(1, r.randint(3, 8)):
        for t, i in {(r.choice(TYPES), f"k{r.randrange(15):03d}") for _ in range(r.randint(1, 20))}:
            gone = r.random() < 0.2
            v = r.randrange(4)
            out.append((t, i, commit, "x" if gone else "r", None if gone else f"h{v}", None if gone else 10 * v + 1))
    return out


def model(rows, v):
    state = {}
    for t, i, c, k, h, s in sorted(rows, key=lambda x: x[2]):
        if c <= v:
            state[t, i] = (c, k, h, s)
    return {k: e for k, e in state.items() if e[1] != "x"}


@pytest.fixture(scope="module")
def frames(spark):
    return [(rows := uploads(seed), spark.createDataFrame(rows, SCHEMA).cache()) for seed in (1, 2, 3)]


def test_reads_at_every_version(frames):
    for rows, e in frames:
        last = max(r[2] for r in rows)
        for v in range(0, last + 1):
            want = model(rows, v)
            got = [(r["type"], r["id"]) for r in V.export(V.state(e, v)).collect()]
            assert got == sorted(want, key=lambda k: (k[0].encode(), k[1].encode()))
            counts = {r["type"]: (r["records"], r["bytes"]) for r in V.counts(V.state(e, v)).collect()}
            assert counts == {t: (sum(k[0] == t for k in want), sum(x[3] for k, x in want.items() if k[0] == t)) for t in {k[0] for k in want}}


def test_differences_between_versions(frames):
    rows, e = frames[0]
    last = max(r[2] for r in rows)
    for since, until in ((0, last), (1, last), (1, 2), (last, last)):
        a, b = model(rows, since), model(rows, until)
        want = {k: (a.get(k, [None] * 4)[2], b.get(k, [None] * 4)[2]) for k in a.keys() | b.keys()}
        want = {k: x for k, x in want.items() if x[0] != x[1]}
        got = {(r["type"], r["id"]): (r["before_hash"], r["after_hash"]) for r in V.diff(e, since, until).collect()}
        assert got == want
    assert {r["change"] for r in V.diff(e, 0, last).collect()} == {"added"}


def test_rebuild_leaves_kept_versions_as_they_were(frames):
    rows, e = frames[1]
    last = max(r[2] for r in rows)
    kept = [(2, 2), (last, last)]
    thin = M.rebuild(e, kept)
    assert thin.count() <= len(rows)
    for v in (2, last):
        assert sorted(map(tuple, V.state(thin, v).select("type", "id", "hash").collect())) == sorted(map(tuple, V.state(e, v).select("type", "id", "hash").collect()))


def test_squash_equals_the_difference(frames):
    rows, e = frames[2]
    last = max(r[2] for r in rows)
    one = {(r["type"], r["id"]): r["hash"] for r in M.squash(e, 1, 2).collect()}
    assert one == {(r["type"], r["id"]): r["after_hash"] for r in V.diff(e, 1, last).collect()}


def test_versions_that_are_not_there(frames):
    _, e = frames[0]
    with pytest.raises(V.NoSuchVersion):
        V.open_view(e, 9, 3)
    with pytest.raises(V.NoSuchVersion):
        V.open_view(e, 2, 3, [(3, 3)])


def test_ranges():
    assert M.normalize_ranges([(5, 6), (1, 2), (3, 3), (9, 8)]) == [(1, 3), (5, 6)]
    assert M.intersect_ranges([(1, 5), (8, 9)], [(4, 8)]) == [(4, 5), (8, 8)]


def test_key_bounds_reach_the_scan(spark, tmp_path, frames):
    frames[0][1].write.parquet(str(tmp_path / "e"))
    plan = spark.read.parquet(str(tmp_path / "e")).where(V.key_range(after=("b", "k003")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThan(type,b),And(EqualTo(type,b),GreaterThan(id,k003)))]" in plan


def test_semvers_reset(spark):
    rows = [("c", n, b) for n, b in enumerate(["patch", "minor", "minor", "patch", "major", "patch", "minor", "patch"], 1)]
    got = [r["semver"] for r in M.semvers(spark.createDataFrame(rows, "collection string, seq int, bump string")).orderBy("seq").collect()]
    assert got == ["1.0.0", "1.1.0", "1.2.0", "1.2.1", "2.0.0", "2.0.1", "2.1.0", "2.1.1"]


def test_presence_ignores_repeats_and_orphans(spark):
    from recordloom.operators.provenance import inherited_removals, into_forks, presence, presence_of

    rows = [("h", "c", "t", "i", s, op) for s, op in ((1, "-"), (2, "+"), (3, "+"), (5, "-"), (6, "-"), (8, "+"))]
    refs = spark.createDataFrame(rows, "hash string, collection string, type string, id string, seq long, op string")
    assert sorted((r["from_seq"], r["to_seq"] or 0) for r in presence(refs).collect()) == [(2, 5), (8, 0)]
    assert [r["removed"] for r in inherited_removals(refs).collect()] == [1]
    refs = refs.withColumn("set", F.lit("public"))
    forks = spark.createDataFrame([("f", "c", 4, False), ("g", "f", 0, False), ("n", "c", 6, False)], "child string, parent string, at long, private boolean")
    assert sorted({r["collection"] for r in into_forks(refs, forks).collect()}) == ["c", "f"]  # g forks before f's first version
    assert presence_of(refs, forks, "h").count() == 3 and presence_of(refs, forks, "other").count() == 0


def carried(events, forks):
    """The rule for forks in plain Python: intervals of (hash, collection, set, type, id)."""
    open_, out, orphan = {}, [], {}
    for h, c, s, t, i, seq, op in sorted(events, key=lambda e: (e[0], e[1], e[5], e[6])):
        k = (h, c, s, t, i)
        if op == "+":
            open_.setdefault(k, seq)
        elif k in open_:
            out.append((*k, open_.pop(k), seq))
        else:
            orphan.setdefault(k, seq)
    out += [(*k, a, None) for k, a in open_.items()]
    level = out
    while level:
        more = []
        for h, c, s, t, i, a, b in level:
            for child, parent, at, private in forks:
                if parent == c and a <= at and (b is None or at < b) and (s == "public" or private) and not any(x[:6] == (h, child, s, t, i, 1) for x in [*out, *more]):
                    more.append((h, child, s, t, i, 1, orphan.get((h, child, s, t, i))))
        out, level = out + more, more
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_presence_in_forks_against_the_rule(spark, seed, monkeypatch):
    from recordloom.operators import provenance
    from recordloom.operators.provenance import into_forks

    if seed == 3:
        monkeypatch.setattr(provenance, "WALKED", 5)  # as with many forks
    r = random.Random(seed)
    chain = [f"c{n}" for n in range(9)]
    forks = [(chain[n + 1], chain[n], r.randrange(0, 4), r.random() < 0.6) for n in range(8)] + [("d", "c2", 3, True)]
    events = list({(f"h{r.randrange(3)}", r.choice(chain), r.choice(["public", "private"]), "t", str(r.randrange(2)), r.randrange(1, 9), r.choice("+-")) for _ in range(120)})
    refs = spark.createDataFrame(events, "hash string, collection string, set string, type string, id string, seq long, op string")
    got = into_forks(refs, spark.createDataFrame(forks, "child string, parent string, at long, private boolean")).collect()
    assert sorted(str((x["hash"], x["collection"], x["set"], x["type"], x["id"], x["from_seq"], x["to_seq"])) for x in got) == carried(events, forks)


def test_diff_pages_never_leave_the_first_row_out(spark):
    rows = spark.createDataFrame([("a", str(n), 700) for n in range(5)], "type string, id string, size long")
    assert V.pages_by_bytes(rows, "size", 10, 100).count() == 1
    assert V.pages_by_bytes(rows, "size", 10, 1500).count() == 2
    assert V.pages_by_bytes(rows.where(F.lit(False)), "size", 10, 1500).count() == 0


def test_tree_of_a_version_does_not_depend_on_partitions(frames):
    from recordloom.operators import trees

    rows, e = frames[1]
    s = V.state(e, max(r[2] for r in rows))
    one = {(r["type"], r["last_key"], r["hash"]) for r in trees.leaves(s.repartition(1), 2, 3).collect()}
    assert one == {(r["type"], r["last_key"], r["hash"]) for r in trees.leaves(s.repartition(7), 2, 3).collect()}
    assert sum(r["count"] for r in trees.roots(s, 2, 3, 2, 8).collect()) == s.count()


def test_merge_policy():
    from recordloom.operators.layouts import Group, plan_merge, range_cuts, tier

    small = [Group(n, n, 10) for n in range(1, 6)]
    assert plan_merge(small, 3, 100) == small
    assert plan_merge([Group(0, 0, 10_000), *small], 3, 100) == small
    assert plan_merge([Group(0, 0, 90), Group(1, 1, 1), Group(2, 2, 1)], 3, 100) == []
    assert plan_merge(small[:2], 3, 100) == [] and [tier(x, 10, 100) for x in (1, 100, 101, 1000, 1001)] == [0, 0, 1, 1, 2]
    assert range_cuts([("a", 5), ("b", 6), ("c", 1), ("d", 20)], 10) == ["b", "d"]


def test_merged_groups_keep_what_kept_versions_see(frames):
    from recordloom.operators import layouts as L

    for rows, e in frames:
        last = max(r[2] for r in rows)
        groups = [L.Group(n, n, 10) for n in range(1, last + 1)]
        kept = [(2, 2), (last, last)]
        for merge in ([groups[:2]], [groups[1:]], [groups[:1], groups[1:]]):
            merge = [m for m in merge if m]
            out = L.finish_rebuild(e, L.plan_rebuild(groups, 1, last, lambda g, m=merge: m), kept)
            for v in (2, last):
                assert sorted(map(tuple, V.state(out, v).select("type", "id", "hash").collect())) == sorted(map(tuple, V.state(e, v).select("type", "id", "hash").collect()))
    with pytest.raises(ValueError):
        L.plan_rebuild(groups, 1, last, lambda g: [[g[0], g[2]]])
    assert L.plan_rebuild(groups, 1, last) is None
    assert L.plan_rebuild([L.Group(n, n, 10) for n in range(1, 12)], 1, 11).untouched == ()


def test_policies_of_runs_and_layers():
    from recordloom.operators import layouts as L

    assert L.runs_for_commit([(n, n) for n in range(40)], 0, 10) == [list(range(16)), list(range(16, 32))]
    assert L.runs_for_commit([(1, 5), (2, 3)], 0, 10) == [] and L.runs_for_commit([(1, 5), (2, 3), (3, 4)], 0, 2) == [[2, 3]]
    assert L.due_layers([(1, 1), (2, 0), (3, 0), (4, 0)]) == [] and L.due_layers([(1, 1), (2, 0), (3, 0), (4, 0), (5, 0)]) == [2, 3, 4, 5]


def test_snapshots_become_commits_that_read_back(spark, frames):
    from recordloom.operators import layouts as L

    rows, e = frames[0]
    last = max(r[2] for r in rows)
    whole = [(v, t, i, x[2], x[3]) for v in range(1, last + 1) for (t, i), x in model(rows, v).items()]
    out = L.from_snapshots(spark.createDataFrame(whole, "version int, type string, id string, hash string, size long"), last)
    for v in range(1, last + 1):
        assert sorted(map(tuple, V.state(out, v).select("type", "id", "hash").collect())) == sorted((t, i, x[2]) for (t, i), x in model(rows, v).items())


def sequential_leaves(rows, bits, most):
    """(last key, count) of each leaf of sorted (type, id), cut one after another."""
    import hashlib

    out, held = [], []
    for t, i in rows:
        if held and (held[-1][0] != t or len(held) == most or int.from_bytes(hashlib.sha256(held[-1][1].encode()).digest()[:8], "big") % (1 << bits) == 0):
            out.append((*held[-1], len(held)))
            held = []
        held.append((t, i))
    return [*out, (*held[-1], len(held))]


def test_leaves_of_many_records_equal_a_sequential_cut(spark):
    from recordloom.operators import trees as T

    n = 600_000
    ids = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"), F.format_string("k%07d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.lit(1).cast("long").alias("size"))
    want = sequential_leaves(sorted(("a" if k % 3 == 0 else "b", f"k{k:07d}") for k in range(n)), 10, 64)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    hashes = set()
    try:
        for parts in ("5", "8", "31"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = T.leaves(ids, 10, 64).collect()
            assert sorted((r["type"], r["last_key"], r["count"]) for r in got) == sorted(want)
            hashes.add(tuple(sorted(r["hash"] for r in got)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(hashes) == 1


def test_positions_of_many_records(spark):
    n = 50_000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("type"), F.format_string("k%07d", "id").alias("id"))
    page = [(r["type"], r["id"]) for r in V.offset_page(rows.repartition(5), n // 2 - 2, 4).collect()]
    assert page == [("a", f"k{n - 4:07d}"), ("a", f"k{n - 2:07d}"), ("b", "k0000001"), ("b", "k0000003")]
    assert sorted((r["type"], r["position"]) for r in V.marks(rows, 10_000).collect()) == [(t, k) for t in "ab" for k in (0, 10_000, 20_000)]
    assert V.offset_page(rows, n, 5).collect() == [] and V.entry_at(rows.where("id < 'k'"), 0).collect() == []


def test_windows_open_at_the_first_hit_after_expiry(spark):
    from recordloom.operators.layouts import windows

    r = random.Random(4)
    hits = [(c, r.randrange(2000)) for c in "xyz" for _ in range(150)] + [("q", 5)] * 7 + [(None, 3)]
    want = []
    for c in "qxyz":
        opened = None
        for at in sorted(a for d, a in hits if d == c):
            if opened is None or at >= opened + 60:
                want.append([c, at, 0])
                opened = at
            want[-1][2] += 1
    got = windows(spark.createDataFrame(hits, "caller string, at long").repartition(3), 60).collect()
    assert sorted([x["caller"], x["opened"], x["hits"]] for x in got) == sorted(want)


def test_versions_in_long_intervals(spark):
    from recordloom.operators.catalog import versions_in

    v = spark.createDataFrame([("c", n, n, "d") for n in range(1, 400)], "collection string, seq long, version long, created string")
    i = spark.createDataFrame([("c", 1, 200), ("c", 200, None), ("c", 63, 65), ("c", 500, None), ("none", 1, None)], "collection string, from_seq long, to_seq long")
    got = versions_in(i, v).groupBy("from_seq").count().collect()
    assert {r["from_seq"]: r["count"] for r in got} == {1: 199, 200: 200, 63: 2}
