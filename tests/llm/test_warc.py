import gzip
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from recordloom.llm import warc


def pages():
    r = random.Random(3)
    big = ["é" * 600 + str(n) for n in range(3)]
    rows = [(n, f"http://x/{n}\r\nWARC-Type: bad é", r.choice(big)) for n in range(40)]
    rows += [(50, None, None), (51, "", ""), (52, "u", "x" * 999), (53, "u", "x" * 999), (54, "u", "x" * 1000), (55, "u", "x" * 1000), (55, "u", "x" * 1000), (None, "n", "x" * 1000), (None, "n", None), (60, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 50), (61, "u", "y" * 700_000)]
    r.shuffle(rows)
    return rows


def test_records_come_back(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    got = warc.archive_pages(df, f"file://{tmp_path}/w", payloads=True).collect()
    heads = {}
    for p, _, h in pages():
        if p is not None and len((h or "").encode()) >= 1000:
            heads[h] = max(p, heads.get(h, p))
    want = []
    for p, _, h in pages():
        raw = (h or "").encode()
        to = heads.get(h) if p is not None and len(raw) >= 1000 else None
        kind = "revisit" if to is not None and p < to else "response"
        want.append((str(p), len(raw), hashlib.sha1(raw).hexdigest(), kind, to if kind == "revisit" else None))
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert all(hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")

    raw, normal = sorted((tmp_path / "w/raw").glob("*.gz")), sorted((tmp_path / "w/normal").glob("*.gz"))
    assert len(raw) == len(normal) > 0
    for path in normal:  # members are single records at the offsets of the index
        data = path.read_bytes()
        members = [json.loads(x) for x in path.with_name(path.name.replace(".warc.gz", ".index.jsonl")).read_text().splitlines()]
        assert sum(m["length"] for m in members) == len(data)
        assert all(gzip.decompress(data[m["offset"] : m["offset"] + m["length"]]).startswith(b"WARC/1.1\r\n") for m in members)


def test_ids_are_unique_and_revisits_refer_to_one(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    warc.archive_pages(df, f"file://{tmp_path}/w").collect()
    seen = {}
    for path in (tmp_path / "w/normal").glob("*.gz"):
        with path.open("rb") as f:
            for raw in warc.records(f):
                headers, _ = warc.parse(raw)
                assert headers["WARC-Record-ID"] not in seen
                seen[headers["WARC-Record-ID"]] = headers
    refers = [h["WARC-Refers-To"] for h in seen.values() if h["WARC-Type"] == "revisit"]
    assert len(seen) == len(pages()) and refers and all(seen[x]["WARC-Type"] == "response" for x in refers)


def test_revisits_equal_the_sql(spark, tmp_path):
    """The registered SQL, on a table that has revisits, which the given ones lack."""
    from ..compare import connect, rows

    given = [(p, u, h) for p, u, h in pages() if p not in (None, 55)]
    spark.createDataFrame(given, "page_id long, url string, html string").write.parquet(f"{tmp_path}/sf/pages.parquet")
    got = warc.op2_warc(spark, f"{tmp_path}/sf").toPandas()
    table = "(VALUES " + ", ".join(f"({p}, {'NULL' if h is None else chr(39) + h + chr(39)})" for p, _, h in given) + ") AS pages(page_id, html)"
    want = connect("/root/testdata/sf0.001").execute(warc.OP2_SQL.replace("FROM pages", f"FROM {table}")).df()
    assert (got["record_type"] == "revisit").sum() > 30
    assert rows(got) == rows(want)


def test_schemes():
    assert warc.ALIASES["s3a"] == "s3"
    assert warc._fs("file:///tmp/x")[1] == "/tmp/x"


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_small_archives_roll(spark, tmp_path):
    df = spark.createDataFrame([(n, "u", "z" * 500) for n in range(20)], "page_id long, url string, html string").coalesce(1)
    written = warc.write_archives(df, f"file://{tmp_path}/r", roll=3000)
    assert written.select("archive").distinct().count() > 3
    assert sorted((r["archive"], r["ordinal"]) for r in written.collect())[0][1] == 0


def test_a_cut_archive_is_an_error():
    whole = gzip.compress(warc.record("response", 1, "", "u", "00" * 20, 3, b"abc"))
    assert len(list(warc.records(io.BytesIO(whole)))) == 1
    broken = gzip.compress(warc.record("response", 1, "", "u", "00" * 20, 3, b"abc")[:-3])
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(broken)))
