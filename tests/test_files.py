import random

import pytest

from recordloom.sources import files
from recordloom.sources.files import File, Row, build


def rows(n=3000, seed=1):
    r = random.Random(seed)
    keys = sorted({(r.choice(["$schema", "a", "é", "zz"]), f"k{r.randrange(10 * n)}") for _ in range(n)}, key=lambda k: (k[0].encode(), k[1].encode()))
    return [Row("x", t, i) if r.random() < 0.2 else Row("r", t, i, f'{{"id":"{i}","type":"{t}","data":"{"p" * r.randrange(300)}"}}') for t, i in keys]


def test_a_key_block_as_the_format_says():
    """The line and its hash are a published vector of the format. Fixed values."""
    line = '{"id":"10.1000/abc","type":"work","data":{"title":"On Sorting","year":2024}}'
    _, content, data = build([Row("r", "work", "10.1000/abc", line)], False, "mark")
    assert content["keyBlocks"] == [["work", "10.1000/abc", "a6210c1b3dcb993166ac9e088e74be43ea50246eb77fda176f5ef2d67d0e001a", 1]]
    assert content["bytes"] == 77 and File(data).problems() == []


def test_round_trip():
    some = rows()
    id_, content, data = build(some, False, "mark")
    f = File(data)
    assert f.id == id_ and f.content == content and f.problems() == [] and len(content["keyBlocks"]) > 1 and len(f.spans["recordBlocks"]) > 1
    assert [(e[0], e[1], e[2]) for e in f.entries()] == [(r.kind, r.type, r.id) for r in some]
    for r in random.Random(2).sample(some, 20):
        assert f.covers(r.type, r.id)
        (e,) = f.find(r.type, r.id)
        assert e[0] == r.kind and (r.kind == "x" or f.line(e) == r.line)
    assert not f.covers("ÿ", "1") and f.find("a", "nothing") == []


def test_rows_rewritten_unchanged_share_a_line():
    a, b = '{"id":"1","type":"t","data":1}', '{"id":"1","type":"t","data":2}'
    some = [Row("r", "t", "1", a, 1), Row("r", "t", "1", a, 3), Row("r", "t", "1", b, 4), Row("w", "t", "1", None, 5, "0" * 64, 9), Row("r", "t", "1", a, 6), Row("x", "t", "2", None, 2)]
    _, content, data = build(some, True, "mark")
    assert (content["lines"], content["records"], content["withheld"], content["commits"]) == (4, 4, 1, [1, 6])
    assert [e[7] for e in File(data).find("t", "1")] == [1, 3, 4, 5, 6] and File(data).problems() == []


def test_damage_is_found():
    with pytest.raises(ValueError):
        build([Row("x", "b", "1"), Row("x", "a", "1")], False, "mark")
    with pytest.raises(ValueError):
        File(b"nothing of the kind")
    _, _, data = build(rows(50), False, "mark")
    f = File(data)
    f.content["keyBlocks"][0][2] = "0" * 64
    f.content["records"] += 1
    assert f.problems() == ["key block 0", "counts"]


def test_files_do_not_depend_on_partitions(spark):
    some = [(n % 3, r.kind, r.type, r.id, r.line) for n, r in enumerate(rows(300))]
    df = spark.createDataFrame(some, "file int, kind string, type string, id string, line string")
    one = {(r["file"], r["file_id"]) for r in files.write_files(df.repartition(1), "file", "mark").collect()}
    assert one == {(r["file"], r["file_id"]) for r in files.write_files(df.repartition(5), "file", "mark").collect()}
    assert all(File(bytes(r["data"])).problems() == [] for r in files.write_files(df, "file", "mark").collect())


def test_labeled_files_cut_by_key_and_size(spark):
    from recordloom.operators.layouts import files_cut

    r = random.Random(3)
    made = [(t, f"k{n:04d}", c, None if r.random() < 0.2 else r.randrange(20, 90)) for t in ("a", "b") for n in range(400) for c in range(1, r.randrange(2, 5))]
    df = spark.createDataFrame(made, "type string, id string, commit long, size long").repartition(4)
    cut = files_cut(df, 3000, 1500, 40).collect()
    assert len(cut) == len(made)
    by_key, held = {}, {}
    for x in cut:
        by_key.setdefault((x["type"], x["id"]), set()).add((x["file"], x["piece"]))
        held.setdefault((x["type"], x["file"], x["piece"]), []).append(x)
    assert all(len(v) == 1 for v in by_key.values())  # a key's rows stay together
    assert max(len(v) for v in held.values()) < 40 + 5 and len(held) > 20
    ranges = sorted((t, min(x["id"] for x in v), max(x["id"] for x in v)) for (t, _, _), v in held.items())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(ranges[:-1], ranges[1:], strict=True))  # files do not overlap
    again = {(x["type"], x["id"], x["commit"]): (x["file"], x["piece"]) for x in files_cut(df.repartition(9), 3000, 1500, 40).collect()}
    assert again == {(x["type"], x["id"], x["commit"]): (x["file"], x["piece"]) for x in cut}


def test_filters_hold_every_key_of_a_large_table(spark, tmp_path):
    from recordloom import plans

    spark.range(0, 230_000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = plans.QUERIES["f4_bloom_filter"](spark, str(tmp_path))
    assert (got.count(), got.distinct().count(), got.where("k % 2 <> 0").count()) == (115_000, 115_000, 0)
