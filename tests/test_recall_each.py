import pytest

from tests.correctness import compare
from trailweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["r08_similar_each", "j12_snippet_parents_each"])
def test_every_fiftieth_row_is_a_query(spark, name):
    good, said = compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert good, said
    wanted = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert registry.QUERIES[name](spark, SF).select("query_id").distinct().count() == wanted > 1
