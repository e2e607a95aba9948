import pytest

from cathlight.plans import catalog, cohorts, comparison, measures, ordering, pipelines, records, streams, texts  # noqa: F401  the others add to the catalogue
from tests.oracle import DATA, duck, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, DATA)) == duck(catalog.SQL[name])


# what SQL can't say: matching blocks (against all pairs in test_generated.py) and a perceptron (in test_probes.py)
BEYOND_SQL = {"fuzzy_part_names", "perceptron_probe"}


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES) - BEYOND_SQL
