import datetime
import json
import sqlite3
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.sources import store, tables


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id , name\n1, \"x, y\"\n2\n")
    rows = tables.read_table(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", "x, y"), ("2", None)] and rows[0].__fields__ == ["id", "name"]
    (tmp_path / "a.tsv").write_text("id\tn\n1\t2\n")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "a.tsv")).collect()] == [("1", "2")]


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.read_table(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.json").write_text('{"x": [{"a": 1}], "y": [{"b": 1}, {"b": 2}]}')
    with pytest.raises(tables.Ambiguous):
        tables.read_table(spark, str(tmp_path / "b.json"))
    assert tables.read_table(spark, str(tmp_path / "b.json"), "y").count() == 2
    (tmp_path / "c.ndjson").write_text('{"a": 1}\n{"a": 2}\n')
    assert tables.read_table(spark, str(tmp_path / "c.ndjson")).count() == 2


def test_sqlite_file(spark, tmp_path):
    p = str(tmp_path / "a.sqlite")
    with sqlite3.connect(p) as db:
        db.execute("CREATE TABLE t (a, b)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)])
        db.execute("CREATE VIEW v AS SELECT a FROM t")
    with pytest.raises(tables.Ambiguous):
        tables.read_table(spark, p)
    assert [tuple(r) for r in tables.read_table(spark, p, "t").collect()] == [("1", "x"), ("2", None)]
    assert tables.read_table(spark, p, query="SELECT sum(a) AS s FROM t").collect()[0]["s"] == "3"


def test_xlsx_file(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    p = tmp_path / "a.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><t>n</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in tables.read_table(spark, str(p)).collect()] == [(None, "7")]


def test_an_upload_becomes_a_version_and_an_export(spark, tmp_path):
    (tmp_path / "u.ndjson").write_text('{"id":"2","type":"t","data":{"b":1,"a":2}}\n\n{"id":"1","type":"t","data":0}\n{"id":"1","type":"t","data":1.0}\n{"id":"1"\n')
    up = store.read_upload(spark, str(tmp_path / "u.ndjson"))
    assert [r["code"] for r in up.where("code IS NOT NULL").collect()] == ["syntax"]
    store.write_entries(store.upload_entries(up, 1), str(tmp_path / "c"))
    e = spark.read.parquet(str(tmp_path / "c/entries"))
    lines = [r["value"] for r in store.export_lines(e, with_hash=False).collect()]
    assert lines == ['{"id":"1","type":"t","data":1}', '{"id":"2","type":"t","data":{"a":2,"b":1}}']
    assert store.export_lines(e).first()["value"].endswith(f'"hash":"{e.where("id = 1").first()["hash"]}"}}')
    store.write_export(e, str(tmp_path / "gz"), gz=True)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "gz")).collect()) == sorted(lines)
    store.tar_export(e, str(tmp_path / "x.tar"), {"version": 1})
    with tarfile.open(tmp_path / "x.tar") as tar:
        assert tar.getnames() == ["manifest.json", "records/t.ndjson"]
        assert tar.extractfile("records/t.ndjson").read().decode().splitlines() == [r["value"] for r in store.export_lines(e).collect()]


def test_a_commit_number_is_taken_once(spark, tmp_path):
    store.publish(spark, f"file://{tmp_path}/c", 1, {"n": 1})
    with pytest.raises(store.CommitTaken):
        store.publish(spark, f"file://{tmp_path}/c", 1, {"n": 2})


def test_tars_hold_everything_and_name_what_is_missing(spark, tmp_path):
    rows = [(t, f"k{n:04d}", f'{{"id":"k{n:04d}","type":"{t}","data":"é{n}"}}', f"{n:064d}") for t in ("a", "b" * 120) for n in range(700)]
    records = spark.createDataFrame(rows, "type string, id string, line string, hash string").repartition(5)
    files = spark.createDataFrame([("h1", 3, bytearray(b"abc")), ("h2", 5, None), ("h3", 2, bytearray(b"xy"))], "hash string, size long, data binary")
    denied = spark.createDataFrame([("h3",), ("h9",)], "hash string")
    members = store.tar_export(records, f"file://{tmp_path}/x.tar", {"version": 1}, {"a": {}}, "read me", files, denied, at=86400)
    with tarfile.open(tmp_path / "x.tar") as tar:
        assert tar.getnames() == [r["name"] for r in members.collect()] == ["manifest.json", "README.md", "records/a.ndjson", f"records/{'b' * 120}.ndjson", "files/h1"]
        assert {m.mtime for m in tar} == {86400}
        about = json.load(tar.extractfile("manifest.json"))
        assert (about["missing"], about["withheld"], about["records"], about["files"]) == (["h2"], ["h3"], 1400, 2)
        lines = tar.extractfile("records/a.ndjson").read().decode().splitlines()
        assert len(lines) == 700 and [json.loads(x)["id"] for x in lines] == [f"k{n:04d}" for n in range(700)] and json.loads(lines[5])["hash"] == rows[5][3]
    got = {r["name"]: bytes(r["data"]) for r in store.untar(spark, f"file://{tmp_path}/x.tar").collect()}
    assert got["files/h1"] == b"abc" and got["README.md"] == b"read me" and len(got) == 5
    empty = store.tar_export(records.limit(0), f"file://{tmp_path}/y.tar", {})
    assert [r["name"] for r in empty.collect()] == ["manifest.json"]


def test_commits_that_race_all_land(spark, tmp_path):
    root, now = f"file://{tmp_path}/c", datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    first = store.land(spark, root, "c", {"files": ["a"]}, lambda head: "patch", now)
    assert (first["number"], first["previous"], first["semver"]) == (1, None, "1.0.0")
    real = store.head_number

    def behind(spark, root, hint=0):
        """Somebody else commits between the look at the head and the write."""
        n = real(spark, root, hint)
        if n == 1:
            store.head_number = real
            store.land(spark, root, "c", {"files": ["theirs"]}, lambda head: "minor", now + datetime.timedelta(hours=1))
        return n

    store.head_number = behind
    try:
        mine = store.land(spark, root, "c", {"files": ["mine"]}, lambda head: "patch", now)
    finally:
        store.head_number = real
    theirs = store.read_commit(spark, root, 2)
    assert (mine["number"], mine["previous"], mine["semver"]) == (3, theirs["id"], "1.1.1") and mine["createdAt"] == theirs["createdAt"]
    assert store.land(spark, root, "c", {"files": ["mine"]}, lambda head: "patch", now) == mine  # sent again
    with pytest.raises(store.Moved):
        store.land(spark, root, "c", {"files": ["late"]}, lambda head: "patch", now, expected=theirs["id"])
    with pytest.raises(store.Race):
        store.land(spark, root, "c", {"files": ["never"]}, lambda head: "patch", now, attempts=0)
    for n in range(4, 12):
        store.publish(spark, root, n, {"n": n})
    assert [store.head_number(spark, root, h) for h in (0, 1, 5, 11, 99)] == [11] * 5
    assert sorted(r["number"] or 0 for r in store.read_log(spark, root).collect())[-3:] == [1, 2, 3]


def test_mirrors_get_commits_last(spark, tmp_path):
    source, target = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    for n in (1, 2, 10):
        store.publish(spark, source, n, {"n": n})
    store.create_once(spark, f"{source}/entries/x", b"x")
    store.create_once(spark, f"{source}/empty", b"")
    assert store.mirror(spark, source, target) == ["empty", "entries/x", "commits/1.json", "commits/2.json", "commits/10.json"]
    assert store.mirror(spark, source, target) == [] and store.read_object(spark, f"{target}/entries/x") == b"x" and store.read_object(spark, f"{target}/empty") == b""
    assert store.read_object(spark, f"{target}/nothing") is None


def test_many_rows_of_a_sqlite_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "BATCH", 100)
    p = str(tmp_path / "a.sqlite")
    with sqlite3.connect(p) as db:
        db.execute("CREATE TABLE t (a, b)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(n, None) for n in range(450)])
        db.execute("CREATE TABLE e (a)")
    rows = tables.read_table(spark, p, "t")
    assert rows.count() == 450 and rows.where("b IS NULL").count() == 450 and "Union" not in rows._jdf.queryExecution().toString()
    assert tables.read_table(spark, p, "e").collect() == []


def test_a_database_table_is_read_in_ranges(spark):
    spark.sparkContext._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:ranges;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id AS K", "id * 2 AS V").write.jdbc(url, "t", properties=driver)
    spark.range(0).selectExpr("id AS K").write.jdbc(url, "e", properties=driver)
    got = tables.read_jdbc(spark, url, "t", "K", 4, properties=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(r["V"] for r in got.collect()) == list(range(0, 200, 2))
    assert tables.read_jdbc(spark, url, "t", properties=driver).count() == 100 and tables.read_jdbc(spark, url, "e", "K", properties=driver).collect() == []


def test_packs_give_back_what_went_in(spark):
    from recordloom.sources import packs

    rows = [(f"h{n}", f"line {n} é" * (n % 7)) for n in range(500)] + [(None, "x"), ("y", None)]
    df = spark.createDataFrame(rows, "hash string, line string").repartition(3)
    made = packs.write_packs(df, 1000).cache()
    assert made.count() > 10 and packs.places(made).count() == 500
    wanted = spark.createDataFrame([(f"h{n}",) for n in (0, 3, 499)] + [("none",)], "hash string")
    assert {r["hash"]: r["line"] for r in packs.read_packs(made, wanted).collect()} == {r[0]: r[1] for r in rows if r[0] in ("h0", "h3", "h499")}
    merged = packs.merge_packs(made, wanted, 0.5, 1000)
    assert {r["hash"] for r in packs.places(merged).collect()} == {"h0", "h3", "h499"}


def test_a_tar_computes_its_records_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def line(n: int) -> str:
        seen.add(1)
        return f'{{"id":"{n}"}}'

    k = spark.range(400).select((F.col("id") % 4).cast("string").alias("type"), F.lpad(F.col("id").cast("string"), 4, "0").alias("id"), F.udf(line)("id").alias("line"))
    store.tar_export(k.withColumn("hash", F.sha2("line", 256)), f"file://{tmp_path}/x.tar", {})
    assert seen.value == 400
    got = {r["name"]: bytes(r["data"]).decode() for r in store.untar(spark, f"file://{tmp_path}/x.tar").collect()}
    assert [x.split(",")[0] for x in got["records/3.ndjson"].splitlines()] == [f'{{"id":"{n}"' for n in range(3, 400, 4)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["x.tar"]


def test_another_process_reads_the_database(spark, tmp_path):
    """As executors do, which do not share the driver's memory."""
    import subprocess
    import sys

    from recordloom.plans import files

    rows = [(1, ' a "b", c', 4), (2, "", None), (3, None, 6), (4, "é\\", 7)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    url = files.database(spark, str(tmp_path))
    read = "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); " + f"print([tuple(r) for r in s.read.jdbc({url!r}, 'parts', properties={{'driver': {files.DERBY!r}}}).orderBy('K').collect()])"
    got = subprocess.run([sys.executable, "-c", read], cwd=tmp_path, capture_output=True, text=True, timeout=100, check=False)
    assert got.stdout.strip() == repr(rows), got.stderr[-2000:]


def test_small_members_of_a_tar_are_read_together():
    sizes = [0, 5, 9, 2 << 20, 7, *[1 << 18] * 5]
    raw = b"".join(store.tar_header(f"m{n}", s) + bytes([n]) * s + b"\0" * (-s % 512) for n, s in enumerate(sizes)) + b"\0" * 1024
    batches = list(store.members(pa.py_buffer(raw)))
    assert [len(b) for b in batches] == [3, 1, 4, 2]
    got = [x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == [(f"m{n}", s, bytes([n]) * s) for n, s in enumerate(sizes)]
