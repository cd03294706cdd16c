"""Best-fit packing of token pieces into sequences of a fixed length.

Bulk-synchronous best fit. Pieces and gaps are sorted by size and kept as runs: (size, count, first rank) for pieces,
(size, count, first sequence) for gaps, so a round's state is bounded by the sequence length and not by the corpus.
In a round the size axis is split into ranges; each range is swept in its own task from large to small, every piece
taking its successor (the smallest free gap that holds it), larger pieces and then lower ranks first; what a range leaves
over meets in one last sweep of leftovers. Then gaps are updated and the next round begins. Pieces themselves never move:
a piece finds its place from its rank among the pieces of its length.

Defined results: null and empty texts give one piece of the end id alone; rows that repeat are packed each for itself;
an empty table gives an empty result; other columns of the input, whatever their names, are ignored. Texts of any length are
read whole, one at a time if they are long. Of pieces of equal length that of the lower rank (partition, then row) is placed
first, so places of ties may differ between runs while sequences' fillings do not. The strings of a vocabulary's added tokens
are those tokens where they stand in a text, as the library has it.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, tuned
from .textscan import LOWER, Words, chunks

LIMIT = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Size ranges that are swept in parallel.
RANGES = 8
#: Units whose ids a worker remembers; about 50 bytes each, so 30 MB.
REMEMBERED = 600_000
#: Bytes of text that are cut into units at once, each of which takes some 40 bytes meanwhile.
CHUNK = 1 << 19
#: What a vocabulary's file says of cutting if Units cuts as it does. Fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
SUFFIX = "</w>"
#: 0 white space, 1 letters, 2 digits, 3 marks, 4 what a byte alone does not tell.
KINDS = np.full(256, 3, np.uint8)
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = 1
KINDS[0x30:0x3A] = 2
KINDS[[*range(0x80, 0xC3), *range(0xC4, 0x100)]] = 4


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units(Words):
    """What the tokenizer cuts texts into before it merges: runs of letters, single digits, runs of marks; lower-cased.

    Only for texts of ASCII and accented Latin letters, whose units follow from their bytes; plain tells which texts are.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        data = LOWER[data]
        lead = data == 0xC3
        after = np.zeros(n, bool)
        after[1:] = lead[:-1]
        kind = KINDS[data]
        odd = (kind == 4) & ~after | after & ((data == 0x97) | (data == 0xB7))
        kind[after] = 1
        data[after & (data >= 0x80) & (data <= 0x9E)] += 0x20
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        turn = np.ones(n + 1, bool)
        turn[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        turn |= edge
        self.data, self.off = data, off
        starts = np.flatnonzero(turn[:-1] & (kind != 0))
        ends = np.flatnonzero(turn[1:] & (kind != 0)) + 1
        letters = kind[starts] == 1
        # a lone apostrophe takes the short endings that may follow it
        lone = np.flatnonzero((ends[:-1] - starts[:-1] == 1) & (data[starts[:-1]] == 0x27) & letters[1:] & (ends[:-1] == starts[1:]) & ~edge[starts[1:]])
        if len(lone):
            c = data[starts[lone + 1]]
            two = ends[lone + 1] - starts[lone + 1] > 1
            d = data[np.minimum(starts[lone + 1] + 1, n - 1)]
            long = two & (((c == 0x72) | (c == 0x76)) & (d == 0x65) | (c == 0x6C) & (d == 0x6C))
            taken = np.where(np.isin(c, [0x73, 0x74, 0x6D, 0x64]), 1, np.where(long, 2, 0))
            ends[lone] += taken
            starts[lone + 1] += taken
            on = starts < ends
            starts, ends, letters = starts[on], ends[on], letters[on]
        self.starts, self.ends, self.letters = starts, ends, letters
        self.first = np.searchsorted(starts, off)
        self.plain = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(odd)))[off]) == 0


class WordIds:
    """Ids of texts under a tokenizer that never joins across white space: each distinct unit is encoded once.

    New units of letters are encoded together, since each of them ends with its only token marked as a word's end. Texts
    that are not plain or hold the string of an added token are encoded whole, as are all texts under a vocabulary that cuts
    otherwise than Units does.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        first = (said["pre_tokenizer"] or {}).get("pretokenizers", [None])[0]
        self.cuts = said["normalizer"] == NORMALIZER and first == SPLIT and said["model"].get("end_of_word_suffix") == SUFFIX
        self.added = [(t["content"], t["normalized"]) for t in said["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(SUFFIX)]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.number, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.ids, self.begin, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of letters, and how many each has."""
        ids = self.encode([" ".join(units)])[0]
        size = np.diff(np.flatnonzero(np.concatenate(([True], self.ends[ids]))))
        if len(size) == len(units):
            return ids, size
        return self._others(units)

    def _others(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.encode(units)
        return np.concatenate(got), np.array([len(x) for x in got])

    def _learn(self, units: list[str], encode) -> None:
        """Units get the next numbers in turn."""
        for a in range(0, len(units), 4096):
            ids, size = encode(units[a : a + 4096])
            n, at = len(size), self.count
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            while at + n > len(self.begin):
                self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
            self.ids[self.used : self.used + len(ids)] = ids
            self.begin[at : at + n] = self.used + np.cumsum(size) - size
            self.size[at : at + n] = size
            self.used += len(ids)
            self.count += n

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes' units, -1 for new ones."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.number[at], -1)

    def __call__(self, col: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.cuts:
            for a in range(0, len(col), 64):
                yield from (x.tobytes() for x in self.encode([t or "" for t in col.slice(a, 64).to_pylist()]))
            return
        for a, b, data, off in chunks(col, CHUNK):
            u = Units(data, off)
            for content, normalized in self.added:
                u.plain &= ~np.asarray(pc.match_substring(col.slice(a, b - a).fill_null(""), content, ignore_case=normalized))
            if self.count > REMEMBERED:
                self.forget()
            hashes, where, which = np.unique(u.hash, return_index=True, return_inverse=True)
            found = self._find(hashes)
            new = np.flatnonzero(found < 0)
            if len(new):
                raw = u.data.tobytes()
                for on, encode in ((u.letters[where[new]], self._letters), (~u.letters[where[new]], self._others)):
                    some = new[on]
                    units = [raw[s:e].decode("utf-8", "replace") for s, e in zip(u.starts[where[some]].tolist(), u.ends[where[some]].tolist(), strict=True)]
                    found[some] = self.count + np.arange(len(some))
                    self._learn(units, encode)
                at = np.searchsorted(self.known, hashes[new])
                self.known, self.number = np.insert(self.known, at, hashes[new]), np.insert(self.number, at, found[new])
            at = found[which]
            size = self.size[at]
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
            ids = self.ids[np.repeat(self.begin[at] - total[:-1], size) + np.arange(total[-1])]
            cuts = total[u.first].tolist()
            whole = dict(zip(odd := np.flatnonzero(~u.plain).tolist(), self.encode(col.take(pa.array([a + d for d in odd], pa.int64())).to_pylist()), strict=True)) if not u.plain.all() else {}
            for d in range(b - a):
                yield (whole[d] if d in whole else ids[cuts[d] : cuts[d + 1]]).tobytes()


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for a worker, which keeps what it has learned from task to task."""
    return WordIds(path)


def token_pieces(docs: DataFrame, limit: int = LIMIT, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Texts as pieces of at most limit ids: doc_id, piece, start, length, ids_crc32, part, nth (rank in the part among pieces of that length) and, if asked for, ids."""
    path = path or vocabulary_path()
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "part", "nth"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = word_ids(path), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc, got in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                got += END_ID.to_bytes(4, "little")
                n = len(got) // 4
                for p, at in enumerate(range(0, n, limit)):
                    piece = got[4 * at : 4 * (at + limit)]
                    size = len(piece) // 4
                    out.append((doc, p, at, size, zlib.crc32(piece), part, int(seen[size]), *([piece] * keep_ids)))
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sweep(pieces: list[tuple], gaps: list[tuple], each: int) -> tuple[list[tuple], list[tuple], list[tuple], list[tuple]]:
    """One descending sweep. pieces (size, count, rank) and gaps (size, count, sequence), both largest first.

    Free gaps lie on a stack whose top is the smallest that holds the current piece, that is its successor. each: pieces
    of a run that a gap may take in this round. Returns matches (size, rank, per gap, gaps, sequence, gap size), pieces
    and gaps left over, and gaps made smaller.
    """
    stack: list[tuple] = []
    matches, left, made, at = [], [], [], 0
    for size, count, rank in pieces:
        while at < len(gaps) and gaps[at][0] >= size:
            stack.append(gaps[at])
            at += 1
        while count and stack:
            gap, n, seq = stack.pop()
            per = min(gap // size, each)
            k = min(n, count // per)
            if not k:
                k, per = 1, count
            matches.append((size, rank, per, k, seq, gap))
            count -= per * k
            rank += per * k
            if gap > per * size:
                made.append((gap - per * size, k, seq))
            if n > k:
                stack.append((gap, n - k, seq + k))
        if count:
            left.append((size, count, rank))
    return matches, left, stack + gaps[at:], made


def swept_in_tasks(spark: SparkSession, ranges: list[tuple]) -> list[tuple]:
    """Each range swept in a task of its own, by the workers that tables have: an RDD's would come on top of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([pickle.dumps(sweep(*ranges[x])) for x in n], pa.binary())], names=["id", "swept"])

    found = spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, "id long, swept binary").collect()  # runs of RANGES ranges
    return [pickle.loads(r["swept"]) for r in sorted(found, key=lambda r: r["id"])]


def plan(spark: SparkSession, counts: dict[int, int], limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """Places for counts[size] pieces of each size: rows (size, first rank, per gap, gaps, first sequence, gap size), sorted, and the number of sequences.

    Every list here is of runs, at most limit of them for pieces, so nothing on the driver grows with the corpus.
    """
    pieces = sorted(((s, n, 0) for s, n in counts.items() if n), reverse=True)
    gaps: list[tuple] = []
    matches: list[tuple] = []
    opened = 0
    fresh = max(-(-sum(s * n for s, n, _ in pieces) // limit), sum(n for s, n, _ in pieces if 2 * s > limit)) if pieces else 0
    while pieces:
        if fresh:
            gaps = sorted([*gaps, (limit, fresh, opened)], reverse=True)
            opened, fresh = opened + fresh, 0
        each = max(1, sum(n for _, n, _ in pieces) // max(1, sum(n for _, n, _ in gaps)) // 4)
        cuts = sorted({s for s, _, _ in pieces})
        cuts = cuts[:: max(1, -(-len(cuts) // RANGES))]
        ranges = [([p for p in pieces if a <= p[0] < b], [g for g in gaps if a <= g[0] < b], each) for a, b in zip(cuts, [*cuts[1:], limit + 1], strict=True)]
        if len(ranges) > 1 and len(pieces) + len(gaps) > 4 * RANGES:
            swept = swept_in_tasks(spark, ranges)
        else:
            swept = [sweep(*x) for x in ranges]
        rest = [sorted((x for s in swept for x in s[k]), reverse=True) for k in (1, 2)]
        last = sweep(rest[0], rest[1], each)
        found = [m for s in (*swept, last) for m in s[0]]
        pieces = sorted(last[1], reverse=True)
        least = pieces[-1][0] if pieces else 0
        gaps = sorted((g for s in ([last[2]], *([s[3]] for s in (*swept, last))) for x in s for g in x if g[0] >= least), reverse=True)
        matches += found
        if not found:
            fresh = max(1, -(-sum(s * n for s, n, _ in pieces) // limit))
    return np.array(sorted(matches), np.int64).reshape(-1, 6), opened


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces that have length, part and nth; part and nth go."""
    spark = pieces.sparkSession
    by = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by = by.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit rows
    rows, _ = plan(spark, counts, limit)
    key = spark.sparkContext.broadcast(((rows[:, 0] << 46) + rows[:, 1], rows))  # runs, bounded by the sequence length
    ranked = pieces.join(by, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")
    names = [x for x in ranked.columns if x != "nth"]
    schema = T.StructType([ranked.schema[x] for x in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = key.value
        for batch in batches:
            size, nth = (np.asarray(batch.column(x)) for x in ("length", "nth"))
            run = runs[np.searchsorted(keys, (size << 46) + nth, "right") - 1] if len(runs) else runs
            k = nth - run[:, 1]
            seq = run[:, 4] + k // run[:, 2]
            offset = limit - run[:, 5] + k % run[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(seq), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, limit: int = LIMIT, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Texts as pieces with their places in sequences of at most limit ids."""
    tuned(docs.sparkSession)
    return pack(cut(token_pieces(docs, limit, path, keep_ids), "pieces"), limit)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
