"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

Words are runs of letters, digits and non-ASCII bytes after lower-casing A-Z. The automaton holds every word run of every
item. A document's words stream through it; at each word the automaton gives the longest run ending there that some item
holds. A run of WINDOW words or more, or a whole shorter item, is an occurrence, and its words are hit.

An automaton lies in flat arrays and holds at most AUTOMATON_WORDS words, which are at most 64 MB in a worker and are what
is broadcast. More items make several automata; documents stream through each in a pass of its own, in which workers hold no
other one, and the passes' findings are joined by row. A longer item spans automata with WINDOW - 1 words of overlap.

Defined results: null and empty texts have no words and no hits; an item without words occurs nowhere; items with equal ids
are one; items without an id count as one, which no list of ids names; rows that repeat are each judged; texts of any length
are read whole; empty tables give empty results or no hits; other columns are ignored by scan and kept by clean.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, spare, table, tuned

WINDOW = 10
#: Words in one automaton, and so the bound of what is broadcast at once.
AUTOMATON_WORDS = 250_000
#: clean() drops a document with more than this share of its words hit.
MAX_COVERAGE = 0.8
_SEPARATOR = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in _SEPARATOR:
    if not 65 <= _c <= 90:
        _TABLE[_c] = 32
WORD_TABLE = bytes(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split() if text else []


class _Build:
    """Generalised suffix automaton of runs of word numbers, while it grows. next: transitions; link, size: suffix links and longest lengths."""

    def __init__(self, runs: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = array("i", [-1]), array("i", [0])
        for run in runs:
            last = 0
            for c in run:
                last = self._extend(last, c)

    def _new(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's run followed by c, made its own if it is part of a longer one."""
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new


class Automaton:
    """Generalised suffix automaton of items' words, in flat arrays: at most 2 states and 3 edges for each word.

    root: the first state's edges by word; one_word, one_next: a state's first edge; more, more_next: further edges as sorted
    numbers state * words + word.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        runs = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        built = _Build(runs)
        self.link, self.size, n = built.link, built.size, max(1, len(self.vocabulary))
        self.root = array("i", [0]) * n
        for c, to in built.next[0].items():
            self.root[c] = to
        self.one_word, self.one_next = array("i", [-1]) * len(self.size), array("i", [0]) * len(self.size)
        rest = []
        for state, edges in enumerate(built.next[1:], 1):
            for k, (c, to) in enumerate(edges.items()):
                if k:
                    rest.append((state * n + c, to))
                else:
                    self.one_word[state], self.one_next[state] = c, to
        del built
        rest.sort()
        self.more, self.more_next = array("q", [x for x, _ in rest]), array("i", [x for _, x in rest])
        self.several = bytearray(len(self.size))
        for x in self.more:
            self.several[x // n] = 1
        #: items, and of each state whose suffix of window words (or whole short item) is one, the places of items that have it
        self.items = [item for item, _ in items]
        held, short = [], {}
        self.least = min((min(len(r), window) for r in runs if r), default=window)
        for k, run in enumerate(runs):
            state = length = 0
            for at, c in enumerate(run, 1):
                state, length = self.step(state, length, c)
                if at >= window:
                    held.append((self.suffix(state, window), k))
            if run and len(run) < window:
                short.setdefault(self.suffix(state, len(run)), (len(run), []))[1].append(k)
        held = sorted(set(held))
        self.states, self.of = array("i", [x for x, _ in held]), array("i", [k for _, k in held])
        self.short: dict[int, tuple[int, list[int]]] = short

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and length of the longest known run that ends with c."""
        while state:
            if self.one_word[state] == c:
                return self.one_next[state], length + 1
            if self.several[state]:
                key = state * len(self.root) + c
                at = bisect_left(self.more, key)
                if at < len(self.more) and self.more[at] == key:
                    return self.more_next[at], length + 1
            state = self.link[state]
            length = self.size[state]
        to = self.root[c]
        return (to, length + 1) if to else (0, 0)

    def suffix(self, state: int, length: int) -> int:
        while state and self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """True for each word that is hit, and the items that occur."""
        hit, found = np.zeros(len(words), bool), set()
        if len(words) < self.least:
            return hit, found
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            state = length = 0
            for at, c in enumerate(ids[a:b].tolist(), a + 1):
                state, length = self.step(state, length, c)
                if length >= self.window:
                    hit[at - self.window : at] = True
                    s = self.suffix(state, self.window)
                    found.update(self.of[bisect_left(self.states, s) : bisect_right(self.states, s)])
                if self.short and length >= self.least:
                    s = state
                    while s > 0:
                        k = self.short.get(s)
                        if k and k[0] <= length:
                            hit[at - k[0] : at] = True
                            found.update(k[1])
                        s = self.link[s]
        return hit, {self.items[k] for k in found}


def item_groups(benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items' words in groups of at most limit words; a longer item goes on in the next with window - 1 words of overlap."""
    group: list[tuple[object, list[bytes]]] = []
    room = limit
    for row in benchmark.select("item_id", "text").toLocalIterator():  # a partition at a time, a group kept
        words = words_of(row["text"])
        at = 0
        while words:
            part = words[at : at + max(room, window)]
            group.append((row["item_id"], part))
            room -= len(part)
            done = at + len(part) >= len(words)
            at += len(part) - window + 1
            if room < window:
                yield group
                group, room = [], limit
            if done:
                break
    if group:
        yield group


def machine(spark: SparkSession, group: list[tuple[object, list[bytes]]], window: int):
    return spark.sparkContext.broadcast(Automaton(group, window))  # AUTOMATON_WORDS words at most


def spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def judged(docs: DataFrame, benchmark: DataFrame, finish: Callable, schema: T.StructType, window: int, limit: int) -> DataFrame:
    """docs through finish(batch, found), found(text's place, words) -> hit, items.

    One automaton is asked in the pass that finishes. Of several, each has a pass of its own, in which workers hold no other;
    what is found is kept by row, and the pass that finishes reads it.
    """
    spark = tuned(docs.sparkSession)
    groups = item_groups(benchmark, window, limit)
    first, second = next(groups, []), next(groups, None)
    at = docs.columns.index("text")
    if second is None:
        only = machine(spark, first, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(batch, lambda n, words: only.value.match(words))

        return docs.mapInArrow(run, schema)

    row, hits, names = (spare(docs.columns, x) for x in ("row", "hits", "names"))
    whole = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    parts = []
    for group in chain([first, second], groups):
        one = machine(spark, group, window)

        def ask(batches: Iterator[pa.RecordBatch], one=one) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hit, found = one.value.match(words_of(text))
                    if found:
                        a, b = spans(hit)
                        out.append((n, list(zip(a.tolist(), b.tolist(), strict=True)), list(found)))
                rows, pairs, items = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x] for x in pairs], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(to_arrow_type(kind)))], names=["row", "hits", "names"])

        kind = benchmark.schema["item_id"].dataType
        found = T.StructType([T.StructField("row", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in "ab"]))), T.StructField("names", T.ArrayType(kind))])
        parts.append(cut(whole.select(row, "text").mapInArrow(ask, found), "hits"))
        one.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.flatten(F.collect_list("hits")).alias(hits), F.flatten(F.collect_list("names")).alias(names)).withColumnRenamed("row", row)  # at most a text's words for each automaton

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, items = (batch.column(x).to_pylist() for x in (len(docs_columns), len(docs_columns) + 1))

            def known(n: int, words: list[bytes], pairs=pairs, items=items) -> tuple[np.ndarray, set]:
                hit = np.zeros(len(words), bool)
                for x in pairs[n] or ():
                    hit[x["a"] : x["b"]] = True
                return hit, set(items[n] or ())

            yield finish(batch.select(docs_columns), known)

    docs_columns = docs.columns
    return whole.join(every, row, "left").select(*docs_columns, hits, names).mapInArrow(settle, schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), and the longest hit run."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("n_words", "n_hit", "n_items", "longest")), T.StructField("items", T.ArrayType(T.StringType()))])

    def finish(batch: pa.RecordBatch, found: Callable) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(5)]
        for n, value in enumerate(batch.column(1)):
            words = words_of(value.as_py())
            hit, items = found(n, words)
            a, b = spans(hit)
            for c, x in zip(cols, (len(words), int(hit.sum()), len(items), int((b - a).max()) if len(a) else 0, sorted(str(x) for x in items if x is not None)), strict=True):
                c.append(x)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.string()))], names=schema.names)

    return judged(docs.select("doc_id", "text"), benchmark, finish, schema, window, limit)


def clean_text(text: str, found: Callable, max_coverage: float = MAX_COVERAGE) -> str | None:
    """text without its hit spans; None if more than max_coverage of its words are hit; text itself if none is. found: words -> hit, items."""
    raw = text.encode()
    mapped = raw.translate(WORD_TABLE)
    words = mapped.split()
    hit, _ = found(words)
    if not hit.any():
        return text
    if hit.mean() > max_coverage:
        return None
    on = np.frombuffer(mapped, np.uint8) != 32
    starts, ends = spans(on)
    out, at = [], 0
    for a, b in zip(*spans(hit), strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, window: int = WINDOW, limit: int = AUTOMATON_WORDS) -> DataFrame:
    """docs with hit spans cut from their texts; documents that are mostly test items go. Columns stay; n_chars, if there, follows the text."""
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def finish(batch: pa.RecordBatch, found: Callable) -> pa.RecordBatch:
        old = batch.column(at).to_pylist()
        new = [x and clean_text(x, lambda words, n=n: found(n, words), max_coverage) for n, x in enumerate(old)]
        keep = pa.array([a is None or b is not None for a, b in zip(old, new, strict=True)], pa.bool_())
        cols = list(batch.columns)
        cols[at] = pa.array(new, cols[at].type)
        if counted is not None:
            was = cols[counted].to_pylist()
            cols[counted] = pa.array([w if a is b or b is None else len(b) for w, a, b in zip(was, old, new, strict=True)], cols[counted].type)
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names).filter(keep)

    return judged(docs, benchmark, finish, docs.schema, window, limit)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Word windows of every item against every document's, then islands of hit words.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT q, item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (SELECT q, item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i : i + 9] END AS g FROM (SELECT q, item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN sizes WHERE i + k - 1 <= len(w)),
occ AS (SELECT r, i, dw.k, q, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM occ)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
