"""The pipeline's stages on one small corpus, and the registered queries against their SQL."""

import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from fleet_audit.llm import queries
from fleet_audit.llm.shared import kept, table

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages_keep_columns_and_rows_of_their_input(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = kept(stage(spark, docs, SF), name)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        assert name == "tokens" or docs.columns == columns
        assert len(after) >= 0.7 * len(before)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert check.compare(spark, check.connect(SF), SF, name) == []
