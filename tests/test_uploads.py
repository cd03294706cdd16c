import pytest

from recordloom.operators import uploads as U
from recordloom.plans import uploads as P

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query", [P.scan, P.check_upload])
def test_queries_return_all_problems(spark, query):
    assert "Limit" not in query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_no_limit(spark):
    rows = spark.range(30).selectExpr("'t' AS type", "cast(id AS string) AS id", "'{\"size\":9}' AS data", "'r' AS kind")
    tight = {"t": {"properties": {"size": {"type": "integer", "maximum": 5}}}}
    assert U.invalid(rows, tight).count() == 20 and U.invalid(rows, tight, None).count() == 30
    assert U.check_upload(rows, rows, {"t": {}}, tight, None)[0].count() == 30
