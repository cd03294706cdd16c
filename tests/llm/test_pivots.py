import math

import numpy as np

from recordloom.llm import pivots


def vectors(seed=1, groups=30):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = r.normal(size=24)
        for _ in range(int(r.integers(1, 12))):
            rows.append((c + r.normal(size=24) * r.choice([0.02, 0.1, 0.25])).tolist())
    rows += [rows[0]] * 3 + [[2 * x for x in rows[1]]]
    rows += r.normal(size=(100, 24)).tolist()
    rows += [None, [0.0] * 24, [math.nan] * 24, [math.inf] + [0.0] * 23, [None] + [1.0] * 23, [1.0] * 5, []]
    return [(n, v, n % 4) for n, v in enumerate(rows)] + [(None, rows[0], 1), (2, rows[2], 1)]


def brute(rows):
    good = [v is not None and len(v) == 24 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    x = np.array([v if g else [0.0] * 24 for (_, v, _), g in zip(rows, good, strict=True)], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(s), strict=True):
        root[find(i)] = find(j)
    least = {}
    for i, (n, _, _) in enumerate(rows):
        if n is not None:
            least[find(i)] = min(n, least.get(find(i), n))
    return s, [least.get(find(i)) for i in range(len(rows))]


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 8)
    rows = vectors()
    s, component = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int").repartition(3)
    got = pivots.near_vectors(df).collect()
    assert len(got) == len(rows)
    want = {}
    for (n, _, _), links, c in zip(rows, s.sum(1).tolist(), component, strict=True):
        want.setdefault(n, []).append((links, c))
    found = sum(r["n_links"] for r in got)
    assert 0.97 * s.sum() <= found <= s.sum()
    right = sum((r["n_links"], r["component_id"]) in want[r["vec_id"]] for r in got)
    assert right >= 0.97 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def planted(n=20_000, size=64, seed=7):
    """Vectors with pairs whose cosines spread around the threshold, chains of them, and a group of equal ones."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n // 2, 2):
        u = r.normal(size=size)
        u -= (u @ x[i]) * x[i]
        c = r.uniform(0.93, 1.0)
        x[i + 1] = c * x[i] + math.sqrt(1 - c * c) * u / np.linalg.norm(u)
    x[n // 2 : n // 2 + 700] = x[n // 2]
    x[n // 2 + 700 : n // 2 + 1400] = x[n // 2] + 0.02 * r.normal(size=(700, size))  # one dense group
    return x.astype(np.float32)


def test_recall_on_planted_vectors(spark):
    x = planted()
    df = spark.createDataFrame(enumerate(map(list, x.tolist())), "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = np.concatenate([(y[a : a + 2000] @ y.T >= 0.95).sum(1) - 1 for a in range(0, len(y), 2000)])
    found = np.array([got[n][0] for n in range(len(y))])
    assert (found <= want).all()
    dense = slice(len(y) // 2, len(y) // 2 + 1400)
    lone = np.r_[found[: dense.start], found[dense.stop :]].sum() / np.r_[want[: dense.start], want[dense.stop :]].sum()
    assert lone >= 0.98 and found[dense].sum() / want[dense].sum() >= 0.98, (lone, found[dense].sum() / want[dense].sum())
    assert {got[n][1] for n in range(dense.start, dense.start + 700)} == {dense.start}


def test_equal_vectors_are_one_node(spark):
    rows = [(n, [1.0, 2.0, 3.0]) for n in range(3000)] + [(5000, [1.0, 2.0, 3.1]), (5001, [0.0, 0.0, 0.0]), (5002, [0.0, 0.0, 0.0]), (5003, None), (5004, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {n: (3000, 0, n == 0) for n in range(3000)} | {5000: (3000, 0, False)} | {n: (0, n, True) for n in range(5001, 5005)}


def test_empty_table(spark):
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_each_length_links(spark):
    r = np.random.default_rng(4)
    rows = [(n, r.normal(size=24).tolist()) for n in range(12)] + [(n, [1.0, 2.0, 3.0 * (n % 2), 4.0, 5.0]) for n in range(20, 24)] + [(30, [1.0]), (31, [2.0]), (32, [-1.0]), (40, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in pivots.near_vectors(df).collect()}
    assert {n: got[n] for n in (20, 21, 22, 23, 30, 31, 32, 40)} == {20: (1, 20), 21: (1, 21), 22: (1, 20), 23: (1, 21), 30: (1, 30), 31: (1, 30), 32: (0, 32), 40: (0, 40)}
