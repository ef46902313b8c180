import pytest

from pathloom.plans import catalogue
from pathloom.plans.fixtures import view
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, same, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).collect()


def test_views_hold_whole_tables(spark):
    values = lambda df: sorted({str(r[0]) for r in df.collect()})
    chunks = view(spark, SF, "vector_chunks")
    assert values(chunks.select("text")) == values(view(spark, SF, "documents").select("text"))
    assert values(chunks.select("embedding")) == values(view(spark, SF, "embeddings").select("embedding"))
    assert chunks.select("chunk_id").distinct().count() == chunks.count() == 500
    assert values(view(spark, SF, "questions").select("qid")) == values(view(spark, SF, "benchmark").select("item_id"))
    lines = sum(len(r.body2.split("\n")) for r in view(spark, SF, "filings").collect())
    assert lines == view(spark, SF, "lineitem").count()


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
