import pytest

import corpus_pipeline
from sensorloom.llm import queries
from tests import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_its_sql(spark, name):
    assert compare.compare(spark, compare.connect(FOLDER), FOLDER, name) is None


def test_pipeline_stages(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, docs = {r["doc_id"]: r["text"] for r in documents.collect()}, documents
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert sorted(docs.columns) == sorted(documents.columns)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append((name, docs.count()))
    assert [n for n, _ in seen] == ["toxicity", "line_dedup", "near_duplicates", "mixing"]
    assert 0.7 * len(before) < seen[0][1] < len(before) and seen[1][1] == seen[0][1] and seen[2][1] < seen[1][1] < seen[3][1] + seen[2][1]
    rows = corpus_pipeline.pieces(spark, docs, FOLDER).collect()
    assert len(rows) == seen[3][1] and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
