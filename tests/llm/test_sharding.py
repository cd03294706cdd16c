import zlib
from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import sharding

from .corpus import documents, frame


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 4097])
def test_a_bijection_and_its_inverse(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, back=True).tolist() == list(range(n))
    shard, slot = sharding.locate(np.arange(n), n)
    assert sharding.row_at(shard, slot, n).tolist() == list(range(n))


def plain(x, n, keys=sharding.KEYS):
    """The permutation, a number at a time."""
    m64 = (1 << 64) - 1

    def mix(v):
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & m64
        v = (v ^ v >> 27) * 0x94D049BB133111EB & m64
        return v ^ v >> 31

    bits = sharding._width(n)
    mask = (1 << bits) - 1
    while True:
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (mix((right + k) & m64) & mask)
        x = left << bits | right
        if x < n:
            return x


def test_shards_of_a_table(spark):
    docs = documents()
    rows = sharding.shard_documents(frame(spark)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(d[0]), len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        p = plain(r["number"], len(docs))
        assert (r["shard"], r["slot"]) == (p % 24, p // 24)
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_numbers_do_not_depend_on_partitions(spark):
    key = lambda df: sorted((str(r["doc_id"]), r["text_crc32"], r["number"]) for r in sharding.shard_documents(df).collect())
    assert key(frame(spark).repartition(7)) == key(frame(spark).coalesce(1))


def test_empty_table(spark):
    assert sharding.shard_documents(frame(spark, [])).collect() == []
