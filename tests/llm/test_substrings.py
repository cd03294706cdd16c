import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import substrings

from .corpus import documents, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    words = [WORD.findall(d[1] or "") for d in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in zip(docs, words, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((str(d[0]), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_against_brute_force(spark):
    assert result(substrings.deduplicate(frame(spark))) == brute(documents(), 35)


@pytest.mark.parametrize("shard", [1, 3])
def test_crowded_shards_are_dealt_anew(spark, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    assert result(substrings.deduplicate(frame(spark))) == brute(documents(), 35)


def test_a_template_with_a_changing_word(spark, monkeypatch):
    """Windows that share all but a word or two crowd one shard at every length of run but the last."""
    r = random.Random(5)
    head, tail = sentence(r, 34), sentence(r, 40)
    rows = [(n, f"{head} {n % 90} {sentence(r, 3)} {tail} {n % 70}", "en", "s", 0) for n in range(120)]
    monkeypatch.setattr(substrings, "SHARD", 5)
    assert result(substrings.deduplicate(frame(spark, rows))) == brute(rows, 35)


def test_every_removed_window_is_found_by_the_index(spark, monkeypatch):
    """With an index that finds nothing, nothing is removed: no other path decides."""
    monkeypatch.setattr(substrings, "search", lambda rows, window=35: rows.select(*substrings.SEGMENT, rows["copies"].alias("mask")).where("mask < 0"))
    assert {r["n_removed"] for r in substrings.deduplicate(frame(spark)).collect()} == {0}


def test_a_text_of_a_megabyte(spark):
    r = random.Random(6)
    long = sentence(r, 170_000)
    rows = [(1, long, "en", "s", 0), (2, sentence(r, 50) + " " + " ".join(long.split()[90_000:90_060]), "en", "s", 0)]
    assert result(substrings.deduplicate(frame(spark, rows))) == brute(rows, 35)


def test_empty_table(spark):
    assert substrings.deduplicate(frame(spark, [])).collect() == []


def test_index_counts_runs():
    r = np.random.default_rng(2)
    segments = [r.integers(1, 4, n) for n in (50, 60, 40, 45)]
    weights = [1, 2, 1, 1]
    symbols = np.concatenate([np.append(s, 0) for s in segments])
    fm = substrings.FMIndex(symbols, np.repeat(weights, [len(s) + 1 for s in segments]), 12)
    ends = np.array([30, 20, 90, 100, 140])
    got = fm.matching(symbols, ends, np.full(5, 12))
    assert fm.matching(symbols, ends, np.array([1, 1, 2, 12, 12])).tolist() == np.minimum(got, [1, 1, 2, 12, 12]).tolist()
    for e, n in zip(ends.tolist(), got.tolist(), strict=True):
        def count(k):
            run = symbols[e - k : e].tolist()
            return sum(w for s, w in zip(segments, weights, strict=True) for i in range(len(s) - k + 1) if s[i : i + k].tolist() == run)
        assert n == 12 or count(n + 1) < 2
        assert n == 0 or count(n) >= 2
