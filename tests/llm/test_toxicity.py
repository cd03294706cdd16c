import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import toxicity

from .corpus import documents, frame, sentence


def labelled(n=600):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.25
        words = sentence(r, r.randrange(20, 200)).split()
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["Vile,", "vile", "nasty.", "wretched"]))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    docs_df, labels_df = frame(spark, docs), spark.createDataFrame([*labels, (9999, 1, 1), (3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs_df, labels_df)
    rows = toxicity.score(docs_df.select("doc_id", "text"), model).withColumn("held_out", toxicity.held_out()).collect()
    truth = dict((d, t) for d, _, t in labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and sum((r["score"] >= toxicity.CUT) == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert len(model[0]) < 20000

    kept = {r["doc_id"] for r in toxicity.keep_clean(docs_df, model).collect()}
    assert len(kept & {d for d, t in truth.items() if not t}) / sum(not t for t in truth.values()) > 0.97
    assert toxicity.keep_clean(docs_df, model).columns == docs_df.columns


def test_odd_rows_and_no_labels(spark):
    docs, labels = labelled(200)
    model = toxicity.learn(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = toxicity.score(frame(spark), model, "s").collect()
    assert len(rows) == len(documents()) and all(0 <= r["s"] <= 1 for r in rows)
    none = toxicity.learn(frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none is None and {r["s"] for r in toxicity.score(frame(spark), none, "s").collect()} == {0.0}
    assert toxicity.score(frame(spark, []), model, "s").collect() == []


def plain_ftrl(examples):
    """FTRL-proximal with a weight at a time, in dictionaries, after the published update."""
    count = Counter(i for x, _ in examples for i in set(x.tolist()))
    z, n, bias, squares = defaultdict(float), defaultdict(float), 0.0, 0.0
    rate = lambda n: (toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / (rate(n[i]) + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in examples:
            own = [i for i in x.tolist() if count[i] >= toxicity.ROWS]
            w = {i: weight(i) for i in own}
            b = -bias / rate(squares)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
            bias += g - (math.sqrt(squares + g * g) - math.sqrt(squares)) / toxicity.ALPHA * b
            squares += g * g
    return {i: weight(i) for i in list(z) if weight(i)}, -bias / rate(squares)


def test_weights_equal_plain_ftrl():
    r = np.random.default_rng(4)
    rows = [(np.unique(np.append(r.integers(0, 300, 25), [301] if y else [302, 303])), y) for y in r.integers(0, 2, 200).tolist()]
    at, w, bias = toxicity.fit(rows)
    want, b = plain_ftrl(rows)
    assert dict(zip(at.tolist(), w, strict=True)) == pytest.approx(want) and bias == pytest.approx(b) and len(want) > 3


def test_clashing_names_and_repeated_ids(spark):
    docs, labels = labelled(120)
    twice = frame(spark, [*docs, *[(d, t + " again", *rest) for d, t, *rest in docs]]).withColumn("toxicity", F.lit("clash")).withColumn("__toxicity", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = (toxicity.learn(twice.repartition(n), known) for n in (2, 5))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
    kept = toxicity.keep_clean(twice, one)
    assert kept.columns == twice.columns and {x["toxicity"] for x in kept.collect()} == {"clash"}


def test_a_text_of_a_megabyte(spark):
    docs, labels = labelled(300)
    model = toxicity.learn(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    long = [(1, "word " * 220_000 + "vile nasty wretched vile nasty", "en", "s", 0), (2, "word " * 220_000, "en", "s", 0)]
    got = {x["doc_id"]: x["s"] for x in toxicity.score(frame(spark, long), model, "s").collect()}
    assert got[1] > got[2]


def test_weights_are_sparse():
    import numpy as np

    r = np.random.default_rng(0)
    rows = [(np.unique(np.append(r.integers(10, 5000, 50), [3] if y else [4])), y) for y in (0, 1) * 300]
    at, w, _ = toxicity.fit(rows)
    top = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert top[3] > 0.5 and len(at) < 3000 and max(top, key=top.get) == 3
