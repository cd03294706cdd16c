"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashed words, word pairs, and words two apart, each present or not. Learning rates are per coordinate and L1
keeps most weights at zero, so what is broadcast is a short list of at most 2^BITS weights. It is fitted on a sample of at
most SAMPLE labelled rows, taken by a hash of their ids; scoring reads every whole text.

Defined results: null and empty texts score as the bias alone; a doc_id with several labels is toxic if any says so, and of
a doc_id with several texts one is learned from, the same one each time; texts of any length are read whole; ties of sampled
ids' hashes go to the lower id; labels without a document and null labels are not learned from; without any row to learn from every score is 0; a null
doc_id is not held out; rows that repeat are scored alike; other columns are ignored by score and kept by keep_clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare, table, tuned
from .textscan import Words, chunks, mix

BITS = 20
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 1.0
#: Rows of the sample that a feature must be in.
ROWS = 3
CUT = 0.3
_U = np.uint64
#: Bytes that end a word: ASCII but for letters and digits.
SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and the text of each, with repeats."""
    h = w.hash
    two, skip = np.flatnonzero(w.whole(2)), np.flatnonzero(w.whole(3))
    pairs = mix(h[two] * _U(3) + mix(h[two + 1]))
    apart = mix(h[skip] * _U(5) + mix(h[skip + 2] + _U(1)))
    return (np.concatenate((h, pairs, apart)) >> _U(64 - BITS)).astype(np.int64), np.concatenate((w.doc, w.doc[two], w.doc[skip]))


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the bias."""
    seen = np.bincount(np.concatenate([x for x, _ in examples]), minlength=1 << BITS) >= ROWS
    examples = [(x[seen[x]], y) for x, y in examples]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz, bn = 0.0, 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for x, y in examples:
            zx, nx = z[x], n[x]
            w = weight(zx, nx)
            bias = -bz / ((BETA + np.sqrt(bn)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA * bias
            bn += g * g
    w = weight(z, n)
    some = np.flatnonzero(w)
    return some, w[some], float(-bz / ((BETA + np.sqrt(bn)) / ALPHA))


def held_out(column="doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Weights from labelled documents that are not held out; None without any."""
    tuned(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(sample)  # so many rows at most
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # at most sample ids
    texts = own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"), F.max("toxic").alias("toxic"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(1)):
                x, doc = features(Words(data, off, lower=True, separators=SEPARATORS))
                order = np.argsort(doc, kind="stable")
                parts = np.split(x[order], np.searchsorted(doc[order], np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a).cast(pa.int64()), pa.array([np.unique(p).astype(np.int32).tobytes() for p in parts], pa.binary())], names=["doc_id", "toxic", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if rows:
            order = np.random.default_rng(1).permutation(len(rows := sorted(rows)))
            at, w, bias = fit([(np.frombuffer(rows[i][1], np.int32), rows[i][2]) for i in order])
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], names=["at", "w", "bias"])

    types = T.StructType([docs.schema["doc_id"], T.StructField("toxic", T.LongType()), T.StructField("x", T.BinaryType())])
    found = texts.mapInArrow(collect, types).repartition(1).mapInArrow(train, "at binary, w binary, bias double").collect()  # one row of at most 2^BITS weights
    return (np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["w"]), found[0]["bias"]) if found else None


def scores(col: pa.Array, dense: np.ndarray, bias: float | None) -> np.ndarray:
    out = np.zeros(len(col))
    if bias is None:
        return out
    for a, b, data, off in chunks(col):
        x, doc = features(Words(data, off, lower=True, separators=SEPARATORS))
        some = np.flatnonzero(dense[x])
        x, doc = np.divmod(np.unique(doc[some] * (1 << BITS) + x[some]), 1 << BITS)[::-1]
        out[a:b] = bias + np.bincount(doc, dense[x], b - a)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, name: str = "score") -> DataFrame:
    """docs with a double column of that name."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # at most 2^BITS weights
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = np.zeros(1 << BITS), None
        if sent.value:
            dense[sent.value[0]], bias = sent.value[1], sent.value[2]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(at), dense, bias))], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, cut: float = CUT) -> DataFrame:
    """docs that score under the cut."""
    name = spare(docs.columns, "toxicity")
    return score(docs, model, name).where(F.col(name) < cut).drop(name)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
