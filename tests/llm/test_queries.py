import pytest

import __spark_entry__ as entry
from lodestream.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"
ROWS = {"op2_simhash": "documents", "op4_quality": "documents", "op5_sharding": "documents", "op7_suffixes": "documents", "op8_warc": "pages", "op9_katz": "documents", "op10_embeddings": "embeddings"}


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ROWS))
def test_a_row_for_every_row(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{ROWS[name]}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_oracle(spark, name):
    oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name])
