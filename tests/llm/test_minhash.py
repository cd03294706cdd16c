import random
import re

import pytest

from recordloom.llm import minhash
from recordloom.llm.common import components

from .corpus import documents, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, k):
    sets = []
    for d in docs:
        w = WORD.findall((d[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[find(i)] = min(d[0], least.get(find(i), d[0]))
    of = [least.get(find(i)) if sets[i] else docs[i][0] for i in range(len(docs))]
    return sorted(((str(d[0]), len(s), str(o), d[0] == o) for d, s, o in zip(docs, sets, of, strict=True)))


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    assert result(minhash.near_duplicates(frame(spark), k)) == brute(documents(), k)


def test_a_group_around_the_threshold(spark, monkeypatch):
    """Many variants of one text, of which some link with some only; blocks of a few rows."""
    r = random.Random(4)
    base = sentence(r, 120).split()
    rows = []
    for n in range(120):
        words = list(base)
        for _ in range(r.randrange(0, 9)):
            words[r.randrange(len(words))] = "v" + str(r.randrange(50))
        rows.append((n, " ".join(words), "en", "s", 0))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    assert result(minhash.near_duplicates(frame(spark, rows), 4)) == brute(rows, 4)


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    assert minhash.keep_one(frame(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    kept = minhash.keep_one(docs, 5)
    assert kept.columns == docs.columns
    rows = kept.collect()
    want = {x[0] for x in brute(documents(), 5) if x[3] and x[1]}
    full = [r for r in rows if (r["text"] or "").split()]
    assert sorted(str(r["doc_id"]) for r in full) == sorted(want)
    blank = {d[0] for d in documents() if not (d[1] or "").split()}
    assert sorted(str(r["doc_id"]) for r in rows if not (r["text"] or "").split()) == sorted(map(str, blank))


def test_components_of_chains_and_hubs(spark):
    edges = [(n, n + 1) for n in range(0, 60)] + [(1000, 1000 + n) for n in range(1, 50)] + [(2001, 2000), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 0 for n in range(61)} | {1000 + n: 1000 for n in range(50)} | {2000: 2000, 2001: 2000}


def test_clashing_names_stay(spark):
    from pyspark.sql import functions as F

    names = ["_a", "_b", "_d", "_n", "_fp", "row", "node", "n_shingles", "kept", "word", "bits", "u", "v", "least", "fp", "id"]
    docs = frame(spark).withColumns({c: F.lit(f"own {c}") for c in names})
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in names)
    assert len(minhash.near_duplicates(docs).columns) == 4


def test_a_text_of_a_megabyte(spark):
    r = random.Random(7)
    long = sentence(r, 160_000)
    words = long.split()
    rows = [(1, long, "en", "s", 0), (2, " ".join(words[:-9] + ["x"] * 9), "en", "s", 0), (3, " ".join(words[:80_000]), "en", "s", 0), (4, long, "en", "s", 0)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {x["doc_id"] for x in minhash.keep_one(frame(spark, rows)).collect()} == {1, 3}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    from recordloom.llm import common

    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    assert result(minhash.near_duplicates(frame(spark), 4)) == brute(documents(), 4)
