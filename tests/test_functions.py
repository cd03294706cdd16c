import json

import pytest
from pyspark.sql import functions as F

from recordloom.functions import canonical as C
from recordloom.functions import cells
from recordloom.functions.schemas import FORMATS, Validator, relaxes, tightened


@pytest.mark.parametrize("x, text", [(1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-7, "1e-7"), (1e-6, "0.000001"), (-0.0, "0"), (1.0, "1"), (5e-324, "5e-324"), (9007199254740993.0, "9007199254740992"), (-12.5e-9, "-1.25e-8"), (123456789.125, "123456789.125")])
def test_numbers_as_ecmascript_prints_them(x, text):
    assert C.number(x) == text


def test_members_sort_by_utf16_units():
    assert C.jcs({"\ufb33": 1, "\U0001f600": 2, "a": [True, None, "\u20ac\n"]}) == '{"a":[true,null,"\u20ac\\n"],"\U0001f600":2,"\ufb33":1}'


@pytest.mark.parametrize("text, code", [('{"a":1,"a":2}', "duplicate_key"), ('{"a":1,"\\u0061":2}', "duplicate_key"), ('{"a":9007199254740992}', "unsafe_integer"), ('["\\ud800"]', "lone_surrogate"), ('["abc', "syntax"), ('["\\u12"]', "syntax"), ("[" * 66 + "]" * 66, "too_deep"), ("[" * 65 + "]" * 65, None), ('{"a":9007199254740992,"b', "unsafe_integer"), ('{"a" 1}', "syntax"), ("[NaN]", "syntax"), ('{"a":{"a":1}}', None), ("[1e20,9007199254740993.0]", None), ('["\\ud83d\\ude00"]', None)])
def test_input_rules(text, code):
    try:
        C.parse_strict(text)
        got = None
    except C.InputError as e:
        got = e.code
    assert got == code


@pytest.mark.parametrize("line, code", [("[]", "bad_envelope"), ('{"id":"","type":"t","data":1}', "bad_id"), ('{"id":"' + "é" * 513 + '","type":"t","data":1}', "bad_id"), ('{"id":"a","type":".t","data":1}', "bad_type"), ('{"id":"a","type":"a/b","data":1}', "bad_type"), ('{"id":"a","type":"t"}', "bad_envelope"), ('{"id":"a","type":"t","data":1,"private":0}', "bad_envelope")])
def test_record_lines_that_break_a_rule(line, code):
    with pytest.raises(C.InputError) as e:
        C.parse_record(line)
    assert e.value.code == code


def test_parsed_column(spark):
    df = spark.createDataFrame([('{"type":"t","id":"1","data":{"b":1.0,"a":[]},"x":0}',), ("{",)], "v string")
    a, b = df.select(C.parsed(df["v"]).alias("p")).select("p.*").collect()
    assert (a["line"], a["code"], b["code"]) == ('{"id":"1","type":"t","data":{"a":[],"b":1}}', None, "syntax")


def test_null_rows_have_a_verdict(spark):
    from recordloom.functions.schemas import valid

    df = spark.createDataFrame([(None,), ("{}",), ("no json",), ('{"a":1}',)], "v string")
    assert [r[0] for r in df.select(valid(df["v"], {"required": ["a"]})).collect()] == [False, False, False, True]
    assert [r["c"] for r in df.select(C.parsed(df["v"]).alias("p")).select(F.col("p.code").alias("c")).collect()][0] == "syntax"
    assert [r[0] for r in df.select(C.canonical(df["v"])).collect()] == [None, "{}", None, '{"a":1}']
    assert [r[0] for r in df.select(C.cuts(df["v"], df["v"], F.lit(1), 10)).collect()][0] is False
    assert [r[0] for r in df.select(C.link_problem(df["v"])).collect()] == [False] * 4


def test_arks_cursors_and_filters():
    import datetime

    name = C.ark_id("11111111-2222-3333-4444-555555555555")
    assert len(name) == 10 and name[0] in C.CONSONANTS and set(name) <= set(C.BETANUMERIC)
    assert C.parse_ark(C.build_ark("ulb1", name, "v1.2.3", "a/b", "é x")) == ("ulb1", name, "1.2.3", "a/b", "é x")
    wrong = C.build_ark("ulb1", name)[:-1] + ("b" if C.check_char(name) != "b" else "c")
    assert C.parse_ark(wrong) is None and C.parse_ark("nothing") is None
    assert C.decode_cursor(C.encode_cursor("é", "k/1")) == ("é", "k/1") and C.decode_cursor("plain", "t") == ("t", "plain") and C.decode_cursor("plain") is None
    f = C.Bloom(str(n) for n in range(1000))
    assert all(str(n) in f for n in range(1000)) and sum(str(n) in f for n in range(1000, 11_000)) < 300
    assert C.erc_date(datetime.date(2024, 2, 9)) == "20240209"
    assert C.not_before(datetime.datetime(2024, 1, 1), datetime.datetime(2025, 1, 1)).year == 2025


def test_signatures(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("héllo",), ("",)], "v string")
    for key in (b"k", b"x" * 200):
        assert [r[0] for r in df.select(C.hmac_sha256(df["v"], key)).collect()] == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in ("héllo", "")]


def test_times_name_a_second_of_a_utc_day():
    good = ["23:59:60Z", "00:59:60+01:00", "18:29:60-05:30", "23:59:59.9z", "10:00:00+0130", "10:00:00-01"]
    bad = ["23:59:60+01:00", "12:00:60Z", "24:00:00Z", "10:60:00Z", "10:00:61Z", "10:00:00+24:00", "10:00:00+01:60", "10:00:00", "1:00:00Z", "10:00Z"]
    assert [t for t in good if not FORMATS["time"](t)] == [] and [t for t in bad if FORMATS["time"](t)] == []
    assert FORMATS["iso-time"]("10:00:00") and FORMATS["date-time"]("2016-12-31t23:59:60Z") and FORMATS["date-time"]("2016-12-31 10:00:00Z")
    assert not FORMATS["date-time"]("2016-12-31") and not FORMATS["date-time"]("2016-12-31TT10:00:00Z") and not FORMATS["date-time"]("2016-13-31T10:00:00Z")


def test_roots():
    from recordloom.functions import roots as R

    tree = {"root": "0" * 64, "count": 1, "bytes": 2}
    public = {"types": {"t": tree | {"schema": "1" * 64}}, "files": {"root": None, "count": 0, "bytes": 0}}
    private = public | {"salt": "2" * 64}
    empty = {"types": {}, "files": {"root": None, "count": 0, "bytes": 0}, "salt": "2" * 64}
    root = R.make_root({"a": 1}, public, private, "v")
    assert R.check_root(root, "v") is None and root["private"] == R.private_commitment(private) and R.make_root(None, public, empty, "v")["private"] is None
    assert R.check_set(private, True) is None and R.check_set(empty, True) == "empty" and R.version_hash(root).startswith("ulv2:")
    for change in ({"v": 3}, {"metadata": []}, {"private": "x"}, {"more": 1}, {"public": public | {"types": {".t": tree}}}, {"public": public | {"files": tree | {"root": None}}}, {"public": public | {"types": {"t": tree}}}):
        assert R.check_root(root | change, "v") is not None
    assert R.check_root(None, "v") and R.check_root(root, "w")
    r = R.receipt({"collection": "c", "number": 3, "id": "x"}, "here", __import__("datetime").datetime(2024, 1, 1))
    assert R.receipt_fits(r, {"collection": "c", "number": 3, "id": "x"}) and not R.receipt_fits(r, {"collection": "c", "number": 4, "id": "x"})


def test_links():
    h = "0" * 64
    data = {"a/b": [{"$link": f"ul:rec:{h}", "id": "x", "deep": {"$link": "no"}}], "f": {"$file": f"sha256:{h}"}, "g": {"$file": "other"}}
    assert [x[:3] for x in C.links_of(data)] == [("/a~1b/0", "rec", h), ("/f", "asset", h)]
    assert C.file_refs([data, data]) == [h]
    assert not C.bad_links(data) and C.bad_links([{"$link": h}]) and C.bad_links({"$link": f"ul:ver:{h}", "type": ""})
    assert C.hash_input(f" sha256:{h} ") == h and C.hash_input("abc") is None


def test_names_and_versions():
    assert [C.counter(n) for n in (0, 18, 19, 20)] == ["b", "z", "bb", "bc"]
    assert C.check_char("13030/xf93gt2") == "r" or len(C.check_char("xf93gt2")) == 1
    assert C.next_semver(None, "patch") == (1, 0, 0) and C.next_semver((1, 2, 3), "minor") == (1, 3, 0)
    assert sum(C.is_cut("t", str(n), 99, 1000) for n in range(5000)) == pytest.approx(500, rel=0.15)


def test_validator():
    v = Validator({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "d": {"format": "date-time"}, "t": {"$ref": "#/definitions/t"}}, "additionalProperties": False, "definitions": {"t": {"oneOf": [{"type": "string"}, {"items": {"$ref": "#/definitions/t"}, "type": "array"}]}}})
    assert v.valid({"a": 1.0, "d": "1998-12-31T23:59:60Z", "t": ["x", ["y"]]})
    for bad in ({"a": 0}, {"a": 1, "d": "2020-02-30T00:00:00Z"}, {"b": 1}, {"a": True}, {"a": 1, "t": [1]}):
        assert not v.valid(bad)
    assert Validator({"multipleOf": 0.1}).valid(0.3) and not Validator({"multipleOf": 0.1}).valid(0.35)
    assert Validator({"maxLength": 1}).valid("😀") and not Validator({"const": 1}).valid(True)


@pytest.mark.parametrize("name, good, bad", [("email", "a@b.c", "a@b"), ("ipv4", "1.2.3.4", "1.2.3.256"), ("uuid", "urn:uuid:" + "0" * 8 + "-0000-0000-0000-" + "0" * 12, "0"), ("duration", "P1DT2H", "PT"), ("time", "10:00:00+01:00", "10:00:00"), ("json-pointer", "/a~1b", "/a~2"), ("byte", "YWI=", "YWI"), ("hostname", "a-b.c", "-a")])
def test_formats(name, good, bad):
    assert FORMATS[name](good) and not FORMATS[name](bad)


def test_relaxed_schemas():
    a = {"properties": {"x": {"type": "string"}}, "required": ["x"]}
    assert relaxes(a, a | {"required": [], "title": "t"}) and not relaxes(a | {"required": []}, a)
    assert not relaxes({"not": a}, {"not": a | {"required": []}})
    ref = {"properties": {"x": {"$ref": "#/definitions/t"}}, "required": ["x"], "definitions": {"t": {"title": "a"}}}
    assert relaxes(ref, ref) and relaxes(ref, ref | {"title": "new", "private": True}) and not relaxes(ref, ref | {"required": []})
    for k in ("items", "additionalProperties", "contains", "propertyNames", "then", "else"):
        assert relaxes({k: a}, {k: a | {"required": []}})
    for k in ("if", "definitions", "oneOf"):
        assert not relaxes({k: [a] if k == "oneOf" else a}, {k: [a | {"required": []}] if k == "oneOf" else a | {"required": []}})
    assert relaxes({"allOf": [a]}, {"allOf": [a | {"required": []}]}) and not relaxes({"allOf": [a]}, {"allOf": [a, a]})
    assert relaxes({"items": [a]}, {"items": [a | {"required": []}]}) and not relaxes({"x": 1}, {}) and not relaxes(a, a | {"required": ["x", "y"]})
    assert tightened({"t": a, "u": a, "v": a}, {"t": a | {"required": []}, "u": a | {"minProperties": 1}}) == {"u": a | {"minProperties": 1}, "v": None}


def test_cells(spark):
    df = spark.createDataFrame([("1", "yes", "2024-01-01", "1.5", "", "x"), ("-2", "No", "2024-01-01T10:00Z", "1e3", None, "1")], "a string, b string, c string, d string, e string, f string")
    got = {r["column"]: r["kind"] for r in cells.guess_types(df, df.columns).collect()}
    assert got == {"a": "whole number", "b": "true or false", "c": "date and time", "d": "number", "e": "text", "f": "text"}
    assert cells.field_name(" 1st  name! ") == "f_1st_name" and cells.field_name("—") == "field"
    assert cells.like_literal("5%_") == "%5\\%\\_%"
    assert [r[0] for r in df.select(cells.coerce(df["b"], "boolean")).collect()] == ["true", "false"]
    assert json.loads(json.dumps(cells.PREVIEW)) == 200


def test_schemas_that_are_refused():
    from recordloom.functions.schemas import check_schema, column_order, unsafe_pattern

    assert unsafe_pattern("(a+)+") and unsafe_pattern("(a|b*)*c") and unsafe_pattern("x" * 300) and unsafe_pattern("(")
    assert not unsafe_pattern("(a{1,3})+") and not unsafe_pattern("[a+]*b+")
    assert check_schema({"properties": {"a": {"pattern": "(a*)*"}, "b": {"$ref": "#/nowhere"}, "c": {"private": True}}}) == ["/properties/a: pattern", "/properties/b: reference", "/properties/c: private field"]
    assert check_schema({"$ref": "#/definitions/x", "definitions": {"x": {}}}) == []
    assert column_order({"properties": {"d": {}, "c": {}, "b": {}, "a": {}}, "propertyOrder": ["c"], "required": ["b"]}) == ["c", "b", "a", "d"]
    assert column_order({}, ["z", "a", "z"]) == ["a", "z"]
