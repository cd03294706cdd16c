"""Line dedup by overlapping chunks of lines.

A chunk is any LEAST lines that follow each other in a text: one begins at every line that has LEAST - 1 lines behind it,
whatever precedes it, so a passage has the same chunks wherever it stands, from its first line to its last. Of chunks that
occur repeatedly anywhere, the first by (doc_id, row, place) stays; lines that lie in another one go. So every later
occurrence of a run of LEAST lines or more goes whole, and the first occurrence of a line always stays, though its neighbours
may go with a passage of their own. Chunks are counted by a 128-bit hash; those met twice are fetched and compared by their
bytes.

Defined results: lines are runs between line feeds, and empty lines belong to the line before them; null and empty texts
have no lines and stay as they are; texts of fewer than LEAST lines stay; texts that lose all lines become empty but for
line feeds before the first, and their rows stay; of rows that repeat one keeps its chunks; null doc_ids come first; an
empty table gives an empty result; other columns, whatever their names, are kept, and n_chars, if there, follows a changed
text. Texts of any length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, cut_by, spare, table, tuned
from .textscan import Words, chunks, mix

LEAST = 2
_U = np.uint64
FEEDS = np.arange(256) == 10
ROW = "__loom_row"


def line_chunks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line and end line of each chunk, and its two hashes, in text order."""
    h = w.hash
    first = np.flatnonzero(w.whole(LEAST))
    both = np.array([w.runs(x, LEAST)[first].view(np.int64) for x in (h, mix(h + _U(0x5EED)))])
    return first, first + LEAST, both


def _listed(lists: pa.Array, a: int, b: int, w: Words) -> np.ndarray:
    """Lines of w where chunks begin, from lists of places of rows a to b; w holds those rows' texts."""
    part = lists.slice(a, b - a)
    doc = np.repeat(np.arange(b - a), part.value_lengths().fill_null(0).to_numpy())
    return np.sort(w.first[doc] + part.flatten().to_numpy())


def _chunk_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0))
            for a, _, data, off in chunks(batch.column(1)):
                w = Words(data, off, separators=FEEDS)
                first, _, h = line_chunks(w)
                doc = w.doc[first]
                place = (first - w.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(rows[a + doc]), pa.array(place)], names=["h", "g", ROW, "place"])

    return texts.select(ROW, "text").mapInArrow(run, f"h long, g long, {ROW} long, place int")


def repeated_chunks(texts: DataFrame) -> DataFrame:
    """(row, place) of chunks that an earlier one equals. texts: the row number, doc_id, text."""
    found = cut(_chunk_rows(texts), "places")
    twice = cut(found.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").select("h", "g"), "twice")  # cut, so that the join of a common one can be split
    lists = found.join(twice, ["h", "g"], "left_semi").groupBy(ROW).agg(F.collect_list("place").alias("places"))  # at most a text's chunks

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0))
            for a, b, data, off in chunks(batch.column(2)):
                w = Words(data, off, separators=FEEDS)
                first, end, h = line_chunks(w)
                on = np.searchsorted(first, _listed(batch.column(3), a, b, w))
                doc = w.doc[first]
                place = first - w.first[doc]
                raw = [data[s:e].tobytes() for s, e in zip(w.starts[first[on]], w.ends[end[on] - 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[0][on]), pa.array(h[1][on]), pa.array(rows[a + doc[on]]), batch.column(1).take(pa.array(a + doc[on])), pa.array(place[on].astype(np.int32)), pa.array(raw, pa.binary())], names=["h", "g", ROW, "doc_id", "place", "bytes"])

    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField(ROW, T.LongType()), texts.schema["doc_id"], T.StructField("place", T.IntegerType()), T.StructField("bytes", T.BinaryType())])
    raw = cut(texts.join(lists, ROW).select(ROW, "doc_id", "text", "places").mapInArrow(fetch, schema), "chunks")
    first = cut(raw.groupBy("h", "g", "bytes").agg(F.min(F.struct("doc_id", ROW, "place")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "first")
    return raw.join(first, ["h", "g", "bytes"]).where((F.col(ROW) != F.col(f"first.{ROW}")) | (F.col("place") != F.col("first.place"))).select(ROW, "place")


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs without repeated chunks; with counts, two more columns at the end: lines, and lines removed."""
    tuned(docs.sparkSession)
    row, gone_at = spare(docs.columns, ROW), spare(docs.columns, "__gone")
    rows = cut_by(docs.withColumn(row, F.monotonically_increasing_id()), row, "lines")
    gone = repeated_chunks(rows.select(F.col(row).alias(ROW), "doc_id", "text")).groupBy(F.col(ROW).alias(row)).agg(F.collect_list("place").alias(gone_at))  # at most a text's chunks
    names = [*docs.columns, *([spare(docs.columns, x) for x in ("n_lines", "n_removed")] * counts)]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in names[len(docs.columns) :])])
    at, counted = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            gone = cols.pop()
            new = cols[at].to_pylist()
            sizes = None if counted is None else cols[counted].to_pylist()
            lines, lost = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for a, b, data, off in chunks(cols[at]):
                w = Words(data, off, separators=FEEDS)
                lines[a:b] = np.diff(w.first)
                begin = _listed(gone, a, b, w)
                if not len(begin):
                    continue
                out = np.zeros(len(w) + 1, bool)
                for k in range(LEAST):
                    out[begin + k] = True
                for d in np.unique(w.doc[begin]).tolist():
                    f, e = int(w.first[d]), int(w.first[d + 1])
                    edges = np.flatnonzero(np.diff(out[f:e].astype(np.int8), prepend=0, append=0)) + f
                    cuts = [int(off[d]), *(int(w.starts[x]) if x < e else int(off[d + 1]) for x in edges.tolist()), int(off[d + 1])]
                    new[a + d] = b"".join(data[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode()
                    lost[a + d] = out[f:e].sum()
                    if sizes is not None:
                        sizes[a + d] = len(new[a + d])
            cols[at] = pa.array(new, cols[at].type)
            if sizes is not None:
                cols[counted] = pa.array(sizes, cols[counted].type)
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(lines), pa.array(lost)] * counts)], names=names)

    return rows.join(gone, row, "left").select(*docs.columns, gone_at).mapInArrow(run, schema)


def without_emptied(docs: DataFrame, given: DataFrame) -> DataFrame:
    """docs without those that have lost all lines. Null texts stay, and those of ids that have a text without lines in given, where docs come from; given is read before docs and not beside them, as its texts may take much memory."""
    bare = F.translate("text", "\n", "") == ""
    own = spare(docs.columns, "__id")
    were = cut(given.where(bare).select(F.col("doc_id").alias(own)).distinct(), "bare")
    same = F.col("doc_id").eqNullSafe(F.col(own))
    return docs.where(F.coalesce(~bare, F.lit(True))).unionByName(docs.where(bare).join(were, same, "left_semi"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Runs of two lines by their bytes, the first of equal ones, and what of each text is left.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
p AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL),
o AS (SELECT *, 1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
l AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS n, lead(s) OVER (PARTITION BY r ORDER BY i) AS nx, lead(s + length(line)) OVER (PARTITION BY r ORDER BY i) AS e FROM o WHERE line <> ''),
c AS (SELECT r, n, row_number() OVER (PARTITION BY substring(text, CAST(s AS BIGINT), CAST(e - s AS BIGINT)) ORDER BY doc_id NULLS FIRST, r, n) AS k FROM l WHERE e IS NOT NULL),
g AS (SELECT DISTINCT r, n FROM (SELECT r, n FROM c WHERE k > 1 UNION ALL SELECT r, n + 1 FROM c WHERE k > 1)),
x AS (SELECT l.r, count(*) AS n_lines, count(g.n) AS n_removed, min(s) AS head, coalesce(string_agg(CASE WHEN g.n IS NULL THEN substring(text, CAST(s AS BIGINT), CAST(coalesce(nx, length(text) + 1) - s AS BIGINT)) END, '' ORDER BY l.n), '') AS kept FROM l LEFT JOIN g ON g.r = l.r AND g.n = l.n GROUP BY l.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(CASE WHEN x.r IS NULL THEN coalesce(text, '') ELSE substring(text, 1, CAST(head - 1 AS BIGINT)) || kept END) AS kept_sha256 FROM d LEFT JOIN x ON x.r = d.r
"""
