import pytest

from recordloom.llm import registry

from ..compare import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_a_query_for_each_operator():
    names = registry.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == list(names)


def test_result_columns(spark):
    want = {
        "op1_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
        "op4_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
        "op6_personal": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string n_added:bigint n_secret:bigint secrets:string",
        "op8_lines": "doc_id:bigint n_lines:bigint n_removed:bigint kept_sha256:string",
        "op9_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    }
    for name, columns in want.items():
        assert " ".join(f"{c}:{t}" for c, t in registry.queries()[name](spark, SF).dtypes) == columns
