import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from recordloom.llm import packing

from .corpus import documents, frame


def tokenizer():
    """As the library gives it."""
    return Tokenizer.from_file(packing.vocabulary_path())


def check(rows, docs, limit):
    t = tokenizer()
    want = sorted((str(d[0]), p, a, len(ids[a : a + limit]), zlib.crc32(np.array(ids[a : a + limit], "<u4").tobytes())) for d in docs for ids in [t.encode(d[1] or "", add_special_tokens=False).ids + [1]] for p, a in enumerate(range(0, len(ids), limit)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def best_fit_decreasing(sizes, limit):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        g = min((g for g in gaps if g >= s), default=None)
        if g is None:
            n, g = n + 1, limit
        else:
            gaps.remove(g)
        gaps.append(g - s)
    return n


def test_pieces_and_places(spark):
    docs = documents()
    for limit in (4096, 100):
        rows = packing.pack_documents(frame(spark), limit).collect()
        n = check(rows, docs, limit)
        assert n <= 1.02 * best_fit_decreasing([r["length"] for r in rows], limit) + 1


def test_ids_are_kept_if_asked_for(spark):
    rows = packing.pack_documents(frame(spark), 4096, keep_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, [])).collect() == []


def test_units_equal_the_library():
    texts = ["It's don't İstanbul Σας naïve", "ÀÉÿ×÷ß À1b2 %%%a", "é́ Aé ﬁ½", "\x00\x7f a\x1cb", "'s 'T l'été", "", "a", "<|endoftext|>", "hello <|endoftext|> world", "A<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> é", "<|endoftext", None] * 3
    got = list(packing.word_ids(packing.vocabulary_path())(pa.array(texts)))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_another_vocabulary_is_encoded_whole():
    path = packing.vocabulary_path("byte_bpe_50k.json")
    texts = ["It's one  Test\n42 naïve", "", None, "<|endoftext|> x", "b" * 300]
    got = list(packing.WordIds(path)(pa.array(texts)))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_a_text_of_a_megabyte():
    text = " ".join(f"word{n} l'été {n % 97}" for n in range(60_000))
    assert len(text) > 1 << 20
    got = list(packing.word_ids(packing.vocabulary_path())(pa.array(["a b", text, "c"])))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tokenizer().encode_batch(["a b", text, "c"], add_special_tokens=False)]


def test_units_of_random_texts():
    r = random.Random(6)
    parts = ["'", "'", "s", "t", "re", "ve", "ll", "d", "m", "l", "r", " ", "A", "é", "É", "1", ",", "-", "''", "x", "\n", "ß", "\x1c", "\u2019", "e\u0301", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(4000)]
    got = list(packing.word_ids(packing.vocabulary_path())(pa.array(texts)))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_plans_of_many_shapes(spark):
    r = np.random.default_rng(1)
    for sizes in (r.integers(1, 60, 3000), r.integers(1200, 1500, 2000), np.full(999, 4096), np.full(5000, 7), r.integers(1, 4097, 2000)):
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
        rows, opened = packing.plan(spark, counts)
        placed = {}
        fill = {}
        for size, rank, per, k, seq, gap in sorted(rows.tolist(), key=lambda x: -x[5]):  # as gaps shrink
            placed.setdefault(size, []).append((rank, per * k))
            for s in range(seq, seq + k):
                assert fill.get(s, 0) == 4096 - gap
                fill[s] = fill.get(s, 0) + per * size
        assert max(fill.values()) <= 4096 and len(fill) <= opened
        for size, spans in placed.items():
            at = 0
            for rank, n in sorted(spans):
                assert rank == at
                at += n
            assert at == counts[size]
        assert len(fill) <= 1.02 * best_fit_decreasing(sizes.tolist(), 4096) + 1


def test_a_worker_remembers_units_in_little_memory():
    import tracemalloc

    r = random.Random(8)
    units = sorted({"".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(60_000)})
    ids = packing.WordIds(packing.vocabulary_path())
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for _ in ids(pa.array([" ".join(units[a : a + 1000]) for a in range(0, len(units), 1000)])):
            pass
        assert tracemalloc.get_traced_memory()[0] - before < 100 * len(units)
    finally:
        tracemalloc.stop()
    assert list(ids(pa.array([units[7] + " " + units[-1]]))) == [np.array(tokenizer().encode(units[7] + " " + units[-1], add_special_tokens=False).ids, "<u4").tobytes()]


def test_ranges_are_swept_by_workers_of_tables(spark, monkeypatch):
    """Those of RDDs are processes of their own beside them, which an executor's memory has to hold as well."""
    counts = {n: 1 + n % 7 for n in range(1, 200)}
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    rows, opened = packing.plan(spark, counts, 200)
    assert sum(int(r[2] * r[3]) for r in rows) == sum(counts.values())
    assert opened <= 1.02 * best_fit_decreasing([s for s, n in counts.items() for _ in range(n)], 200) + 1
