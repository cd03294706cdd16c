"""Substring dedup: windows of WINDOW words that also start elsewhere, found with FM-indexes over content shards.

A window's minimizer, the least hash of its word runs of GRAM, names the shard it belongs to, so equal windows meet in
one shard and a document streams only to the shards of its own windows. Consecutive windows whose minimizer stands at one
position form a segment (at most WINDOW - GRAM + 1 windows, all different). Segments are counted by 128-bit hashes before
words are moved: a shard that one window only has met holds no repeat. Every other shard is searched: its distinct segments,
each with its number of copies, are sorted to depth WINDOW or more and kept as a wavelet-matrix FM-index, and backward search
gives matching statistics, stopping where fewer than two occurrences (counted with copies) are left. For a segment met once
they are taken at the end of each window, for one met more often at its own end. Windows that reach the threshold are
reported.

A shard of more than SHARD distinct segments is dealt anew by minimizers of longer runs (of GRAM, then half way to WINDOW,
then of WINDOW words, where a shard is one window), so no task holds a common minimizer's segments whole; the parts are
indexed and searched as the others are.

Words are compared by 64-bit hashes inside a shard. Defined results: null and empty texts have no words; texts under WINDOW
words keep all; windows of rows that repeat count as starting elsewhere; texts of any length are cut whole; which of equal
segments lends its words does not matter; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_by, distinct_texts, fingerprint, table, tuned
from .textscan import Words, chunks, mix, powers

WINDOW = 35
GRAM = 8
#: Distinct segments of a shard that is not dealt anew.
SHARD = 1_000
#: Words that an index is built over at once, if they are of more than one minimizer.
INDEX_WORDS = 400_000
_U = np.uint64


def least_in(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each run of width, and its leftmost place, by doubling."""
    value, place, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        n = len(value) - step
        right = value[step:] < value[:n]
        value, place = np.where(right, value[step:], value[:n]), np.where(right, place[step:], place[:n])
        have += step
    return value, place


SEGMENT = ["m", "seg", "alt", "n"]


def cut_segments(h: np.ndarray, value: np.ndarray, place: np.ndarray, at: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the windows that begin at words `at` of hashes h: minimizer, two hashes, first word and number of windows. value, place: of each window's minimizer; owner: of each word."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    at = at[first]
    p, q = powers(len(h) + 1)
    both = []
    for x in (h, mix(h + _U(0x5EED))):
        c = np.zeros(len(x) + 1, _U)
        np.cumsum(x * p[: len(x)], out=c[1:])
        both.append(mix((c[at + n + window - 1] - c[at]) * q[at] + n.astype(_U)).view(np.int64))
    return value[at].view(np.int64), *both, at, n.astype(np.int32)


def segments(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """node, copies, text -> m (minimizer), seg and alt (hashes of the segment's words), n (windows), node, copies, start (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, copies = (np.asarray(batch.column(x)) for x in (0, 1))
            for a, _, data, off in chunks(batch.column(2)):
                w = Words(data, off)
                if len(w) < window:
                    continue
                h = w.hash
                at = np.flatnonzero(w.whole(window))
                if not len(at):
                    continue
                m, seg, alt, at, n = cut_segments(h, *least_in(w.runs(h, gram), window - gram + 1), at, w.doc, window)
                doc = w.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m, seg, alt, n, nodes[a + doc], copies[a + doc], (at - w.first[doc]).astype(np.int32))], names=[*SEGMENT, "node", "copies", "start"])

    return texts.select("node", "copies", "text").mapInArrow(run, "m long, seg long, alt long, n int, node long, copies long, start int")


class FMIndex:
    """Counts of word runs of up to depth words in segments; a wavelet matrix of packed bits over the Burrows-Wheeler transform."""

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, depth: int):
        """symbols: words numbered from 1, each segment closed by 0; weights: how often the segment of each symbol occurs."""
        n = len(symbols)
        rank, have = symbols.astype(np.int64), 1
        while have < depth:
            key = rank * (n + 2)
            key[:-have] += rank[have:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            up = np.zeros(n, np.int64)
            up[1:] = np.cumsum(key[1:] != key[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = up
            have *= 2
            if up[-1] == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        bwt = symbols[order - 1]
        total = int(weights.sum())
        self.before = np.concatenate(([0], np.cumsum(weights[order]))).astype(np.uint32 if total < 1 << 32 else np.int64)
        self.total = n
        counts = np.bincount(symbols)
        start = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.bits: list[tuple[np.ndarray, np.ndarray, int]] = []
        level, names = bwt.astype(np.int64), np.arange(len(counts))
        low = np.zeros(len(counts), np.int64)
        for shift in range(max(1, int(len(counts) - 1).bit_length()) - 1, -1, -1):
            on = (level >> shift & 1).astype(bool)
            packed = np.zeros((n >> 6) + 1, np.uint64)
            packed.view(np.uint8)[: -(-n // 8)] = np.packbits(on, bitorder="little")
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.uint32)
            zeros = n - int(on.sum())
            self.bits.append((packed, ones, zeros))
            low = self._down(low, names >> shift & 1, self.bits[-1])
            level = np.concatenate((level[~on], level[on]))
        self.jump = start - low

    @staticmethod
    def _down(at: np.ndarray, bit: np.ndarray, level: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        packed, ones, zeros = level
        word = at >> 6
        one = ones[word].astype(np.int64) + np.bitwise_count(packed[word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))).astype(np.int64)
        return np.where(bit, zeros + one, at - one)

    def back(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Interval ends after a step of backward search."""
        for k, level in enumerate(self.bits):
            at = self._down(at, symbol >> (len(self.bits) - 1 - k) & 1, level)
        return at + self.jump[symbol]

    def matching(self, symbols: np.ndarray, ends: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each end, how many words before it occur twice or more together, up to its length."""
        got = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.total)
        k = 0
        while len(live):
            k += 1
            s = symbols[ends[live] - k]
            both = self.back(np.concatenate((lo, hi)), np.concatenate((s, s)))
            lo, hi = both[: len(live)], both[len(live) :]
            on = self.before[hi].astype(np.int64) - self.before[lo] >= 2
            got[live[on]] = k
            on &= length[live] > k
            live, lo, hi = live[on], lo[on], hi[on]
        return got


def search(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """rows m, seg, alt, n, copies, words (64-bit hashes of distinct segments) -> m, seg, alt, n, mask (bit i: window i repeats)."""

    def index(m: np.ndarray, seg: np.ndarray, alt: np.ndarray, n: np.ndarray, copies: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
        size = n + window - 1
        _, ids = np.unique(np.frombuffer(b"".join(words), _U), return_inverse=True)
        ends = np.cumsum(size)
        symbols = np.insert(ids + 1, ends, 0)
        fm = FMIndex(symbols, np.repeat(copies, size + 1), window)
        ends = ends + np.arange(len(size))  # among symbols
        once = np.flatnonzero(copies == 1)
        which = np.concatenate((np.repeat(once, n[once]), often := np.flatnonzero(copies > 1)))
        k = np.arange(len(which) - len(often)) - np.repeat(np.cumsum(n[once]) - n[once], n[once])
        at = np.concatenate(((ends - size)[which[: len(k)]] + k + window, ends[often]))
        length = np.concatenate((np.full(len(k), window), size[often]))
        full = fm.matching(symbols, at, length) >= length
        mask = np.zeros(len(n), np.int64)
        np.bitwise_or.at(mask, which, np.where(full, np.concatenate((1 << k, (1 << n[often]) - 1)), 0))
        some = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (m, seg, alt, n.astype(np.int32), mask)], names=[*SEGMENT, "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            m, n = np.asarray(batch.column(0)), np.asarray(batch.column(3))
            cuts = np.append(np.flatnonzero(m[1:] != m[:-1]) + 1, len(m))
            if held and len(m) and held[-1].column(0)[len(held[-1]) - 1].as_py() != m[0] and size >= INDEX_WORDS:
                yield index(*columns(held))
                held, size = [], 0
            for b in cuts.tolist():
                held.append(batch.slice(at, b - at))
                size += int((n[at:b] + window).sum())
                at = b
                if size >= INDEX_WORDS and b < len(m):
                    yield index(*columns(held))
                    held, size = [], 0
        if held:
            yield index(*columns(held))

    def columns(held: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(held)
        return *(t[x].to_numpy().astype(np.int64) for x in (*SEGMENT, "copies")), t["words"].to_pylist()

    dealt = rows.repartition("m").sortWithinPartitions("m")
    return dealt.select(*SEGMENT, "copies", "words").mapInArrow(run, "m long, seg long, alt long, n int, mask long")


def crowded(kinds: DataFrame) -> DataFrame:
    """Shards of more than SHARD distinct segments."""
    return cut(kinds.groupBy("m").agg(F.count("*").alias("c")).where(F.col("c") > SHARD).select("m"), "crowded")


def parts_of(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """Segments m, seg, alt, n, copies, words cut anew by minimizers of longer runs: those segments, of, which one they are of, and from, its window that they begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                h = np.frombuffer(x["words"], _U)
                value, place = least_in(Words.runs(None, h, gram), window - gram + 1)
                own = cut_segments(h, mix(value ^ _U(x["m"] & (1 << 64) - 1)), place, np.arange(x["n"]), np.zeros(len(h), np.int8), window)
                out += [(int(m), int(seg), int(alt), int(n), x["copies"], h[at : at + n + window - 1].tobytes(), {c: x[c] for c in SEGMENT}, int(at)) for m, seg, alt, at, n in zip(*own, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*SEGMENT, "copies", "words", "of", "from"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.struct([(c, pa.int32() if c == "n" else pa.int64()) for c in SEGMENT]), pa.int32()]
    return rows.select(*SEGMENT, "copies", "words").mapInArrow(run, "m long, seg long, alt long, n int, copies long, words binary, of struct<m: long, seg: long, alt: long, n: int>, `from` int")


def masks(kinds: DataFrame, grams: list[int], window: int) -> DataFrame:
    """m, seg, alt, n, mask of distinct segments (m, seg, alt, n, copies, words) with repeated windows. grams: of the minimizers that crowded shards are dealt anew by."""
    many = crowded(kinds) if grams else None
    if many is None or not many.head(1):
        return search(kinds, window)
    few = search(kinds.join(many, "m", "left_anti"), window)
    parts = cut(parts_of(kinds.join(many, "m", "left_semi"), grams[0], window), "parts")
    mine = parts.groupBy(*SEGMENT).agg(F.sum("copies").alias("copies"), F.first("words").alias("words"))
    again = mine.join(cut(parts.groupBy("m").agg(F.sum("copies").alias("c")).where("c > 1").select("m"), "often"), "m", "left_semi")
    found = cut(masks(cut(again, "kinds"), grams[1:], window), "masks")
    back = parts.select(*SEGMENT, "of", "from").join(found, SEGMENT).select("of.*", F.expr("shiftleft(mask, `from`)").alias("mask"))
    return few.unionByName(back.groupBy(*SEGMENT).agg(F.bit_or("mask").alias("mask")))


def repeated(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """node, start, n, mask of segments with repeated windows. texts: node, copies, text, bucketed by node."""
    cuts = segments(texts, window, gram)
    often = cut(cuts.groupBy("m").agg(F.sum("copies").alias("c")).where("c > 1").select("m"), "often")  # cut, so that the join of a common one can be split
    met = cut(cuts.join(often, "m", "left_semi"), "segments")
    kinds = met.groupBy(*SEGMENT).agg(F.sum("copies").alias("copies"), F.min(F.struct("node", "start")).alias("at"))
    lists = kinds.groupBy("at.node").agg(F.collect_list(F.struct(*SEGMENT, "copies", "at.start")).alias("wanted"))  # at most a text's segments

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column(0)):
                w = Words(data, off)
                raw = w.hash
                out = [(*(x[c] for c in SEGMENT), x["copies"], raw[(s := w.first[d] + x["start"]) : s + x["n"] + window - 1].tobytes()) for d, got in enumerate(batch.column(1).slice(a, b - a).to_pylist()) for x in got]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*SEGMENT, "copies", "words"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    worded = cut(texts.join(lists, "node").select("text", "wanted").mapInArrow(fetch, "m long, seg long, alt long, n int, copies long, words binary"), "words")
    found = cut(masks(worded, [(gram + window) // 2, window], window), "masks")
    return met.join(found, SEGMENT).select("node", "start", "n", "mask")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by one space) for every row."""
    spark = tuned(docs.sparkSession)
    texts = cut_by(distinct_texts(docs), "node", "texts")
    marks = repeated(texts.select("node", "copies", "text"), window).groupBy("node").agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks"))  # at most a text's segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                kept, n = words, len(words)
                if marks:
                    edge = np.zeros(n + 1, np.int64)
                    for x in marks:
                        k = x["start"] + np.flatnonzero(np.int64(x["mask"]) >> np.arange(x["n"]) & 1)
                        np.add.at(edge, k, 1)
                        np.add.at(edge, k + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                out.append((a, b, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "n_words", "n_removed", "kept_sha256", "kept"])

    done = texts.join(marks, "node", "left").select("a", "b", "text", "marks").mapInArrow(run, "a long, b long, n_words long, n_removed long, kept_sha256 string, kept string")
    rows = docs.select("doc_id", fingerprint().alias("fp")).select("doc_id", F.col("fp.a").alias("a"), F.col("fp.b").alias("b"))
    return rows.join(done, ["a", "b"]).drop("a", "b")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same law by plain window counting.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
h AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM s WHERE g IN (SELECT g FROM t))),
k AS (SELECT d.r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS d LEFT JOIN h USING (r, p) WHERE h.p IS NULL GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
