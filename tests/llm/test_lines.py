import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import lines
from recordloom.llm.textscan import Words

from .corpus import documents, frame, sentence


def chunk_texts(text):
    raw = (text or "").encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), separators=lines.FEEDS)
    first, end, _ = lines.line_chunks(w)
    return [(int(f), int(e), raw[w.starts[f] : w.ends[e - 1]]) for f, e in zip(first, end, strict=True)], w, raw


def brute(rows):
    """rows (row, doc_id, text): the text that stays of each."""
    seen = defaultdict(list)
    for n, d, t in rows:
        for f, _, c in chunk_texts(t)[0]:
            seen[c].append((d is not None, d or 0, n, f))
    out = {}
    for n, d, t in rows:
        if t is None:
            out[n] = None
            continue
        chunks, w, raw = chunk_texts(t)
        keep, at = [], 0
        for f, e, c in chunks:
            if min(seen[c]) != (d is not None, d or 0, n, f):
                keep.append(raw[at : w.starts[f]])
                at = int(w.starts[e]) if e < len(w) else len(raw)
        out[n] = b"".join([*keep, raw[at:]]).decode()
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    pool = [sentence(r, 6) for _ in range(12)]
    rows = [*documents()]
    for n in range(200, 260):
        at = r.randrange(8)
        rows.append((n, "\n".join([sentence(r, 5) for _ in range(r.randrange(3))] + pool[at : at + r.randrange(1, 5)] + [""] * r.randrange(2) + pool[:3]) + "\n" * r.randrange(3), "en", "s", 0))
    df = frame(spark, rows).coalesce(1).withColumn("row", F.monotonically_increasing_id()).cache()
    want = brute([(x["row"], x["doc_id"], x["text"]) for x in df.collect()])
    clashing = df.withColumns({c: F.lit("clash") for c in ("__gone", "__loom_row", "n_lines", "__id")})
    out = lines.dedup_lines(clashing, counts=True)
    assert out.columns[:-2] == clashing.columns and out.columns[-2:] == ["n_lines_", "n_removed"]
    got = out.collect()
    assert {x["row"]: x["text"] for x in got} == want
    assert sum(x["n_removed"] for x in got) > 50 and {x["__gone"] for x in got} == {"clash"}
    assert all(x["n_chars"] == len(x["text"]) for x in got if x["n_removed"])


def test_a_text_of_a_megabyte(spark):
    long = "\n".join(f"line {n} of many in a text that does not end" for n in range(26_000))
    rows = [(1, long, "en", "s", 0), (2, "new\n" + long[500_000:600_000] + "\nend", "en", "s", 0)]
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(frame(spark, rows, clash=False)).collect()}
    assert got[1] == long and len(got[2]) < 200


def test_tables_leave_the_catalog(spark):
    from recordloom.llm.common import cut_by, drop

    before = spark.catalog.listTables()
    made = cut_by(spark.range(10), "id", "numbers")
    assert made.count() == 10 and len(spark.catalog.listTables()) == len(before) + 1
    drop(made)
    assert len(spark.catalog.listTables()) == len(before)


def test_boundaries_shift_with_inserted_lines():
    r = random.Random(5)
    body = [sentence(r, 6) for _ in range(60)]
    a = {c for _, _, c in chunk_texts("\n".join(body))[0]}
    b = {c for _, _, c in chunk_texts("\n".join([sentence(r, 4), *body]))[0]}
    assert len(a & b) >= 0.6 * len(a)


def test_empty_table(spark):
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def split_lines(text):
    """Byte ranges of a text's lines with the empty ones behind them; made without line_chunks."""
    raw, at, out = text.encode(), 0, []
    for part in raw.split(b"\n"):
        if part:
            out.append((at, at + len(part)))
        at += len(part) + 1
    return raw, out


def later_runs(rows):
    """rows (order, text): (row, first line, end line) of each longest run of two or more whole lines whose bytes occur earlier."""
    seen, found = set(), []
    for n, t in sorted(rows):
        raw, at = split_lines(t)
        i = 0
        while i < len(at):
            j = i
            while j < len(at) and (j == i or raw[at[i][0] : at[j][1]] in seen):
                j += 1
            if j - i >= 2:
                found.append((n, i, j))
            i = max(i + 1, j - 1 if j - i >= 2 else 0)
        seen |= {raw[at[i][0] : at[j][1]] for i in range(len(at)) for j in range(i + 1, len(at))}
    return found


def test_recall_of_repeated_runs(spark):
    r = random.Random(9)
    passages = [[sentence(r, 12) for _ in range(n)] for n in (2, 3, 4, 5, 6, 9)]
    rows = []
    for n in range(60):
        body = [sentence(r, 7) for _ in range(r.randrange(2, 9))]
        at = r.randrange(len(body) + 1)
        rows.append((n, "\n".join(body[:at] + passages[n % 6] + body[at:]), "en", "s", 0))
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(frame(spark, rows, clash=False)).collect()}
    runs = later_runs([(n, t) for n, t, *_ in rows])
    assert len(runs) == 54
    gone = 0
    for n, f, e in runs:
        kept = set(got[n].split("\n"))
        raw, at = split_lines(rows[n][1])
        gone += not any(raw[a:b].decode() in kept for a, b in at[f:e])
    assert gone == len(runs)  # recall 1.0
    assert {x for _, t, *_ in rows for x in t.split("\n")} == {x for t in got.values() for x in t.split("\n") if x}  # no line is lost
    assert sum(len(split_lines(t)[1]) for t in got.values()) == sum(len(split_lines(t)[1]) for _, t, *_ in rows) - sum(e - f for _, f, e in runs)


def test_without_emptied(spark):
    given = frame(spark, [(1, "a\nb", "", "", 0), (2, "", "", "", 0), (3, None, "", "", 0), (None, "\n", "", "", 0), (5, "\nc\nd", "", "", 0), (6, " \n", "", "", 0)])
    docs = frame(spark, [(1, "", "", "", 0), (2, "", "", "", 0), (3, None, "", "", 0), (None, "\n", "", "", 0), (5, "\n", "", "", 0), (6, " \n", "", "", 0), (7, "e", "", "", 0)])
    out = lines.without_emptied(docs, given)
    assert out.schema == docs.schema
    assert {x["doc_id"] for x in out.collect()} == {2, 3, None, 6, 7}


def test_without_emptied_reads_given_once(spark, tmp_path):
    """Given's texts are not read again beside the texts of docs by what follows."""
    rows = frame(spark, [(1, "a\nb", "", "", 0), (2, "", "", "", 0)])
    for name in ("given", "docs"):
        rows.write.parquet(f"{tmp_path}/{name}")
    docs, given = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "given"))
    out = lines.without_emptied(docs, given)
    assert set(docs.inputFiles()) <= set(out.inputFiles()) and not set(given.inputFiles()) & set(out.inputFiles())
    assert {x["doc_id"] for x in out.collect()} == {1, 2}
