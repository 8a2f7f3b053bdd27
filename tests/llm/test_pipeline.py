import corpus_pipeline
from eventlake.llm import language, private
from eventlake.llm.common import DOCUMENT_COLUMNS, written
from pyspark.sql import functions as F
from tests.llm.conftest import SF
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_packing import check


def through(spark, docs):
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept[name] = written(stage(spark, docs, SF), f"test-{name}")
    return kept


def test_stages_take_effect(spark, docs):
    found = through(spark, docs)
    before = docs
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert tuple(found[name].columns) == DOCUMENT_COLUMNS
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    assert found["language"].count() == lettered.count()
    expected = plain_kept([(r.doc_id, r.text) for r in found["language"].collect()])
    assert {r.doc_id for r in found["near_duplicates"].collect()} == expected
    spans = private.with_base(found["personal_data"].select("doc_id", "text"))
    assert spans.where(F.size("base") > 0).isEmpty()
    assert found["personal_data"].count() == found["near_duplicates"].count()
    assert found["mixing"].count() > 0 and before.count() > 0
    ids = found["mixing"].groupBy("doc_id").count().where("count = 1").select("doc_id")
    once = found["packing"].join(ids, "doc_id").select("doc_id").distinct().count()
    assert once == ids.count()
    assert check(found["packing"].collect(), found["mixing"]) < 0.05


def test_odd_rows_and_empty_tables(spark, odd, none):
    found = through(spark, odd)
    assert {r.doc_id for r in found["language"].collect()} == {1, 5, 6, 8, None}
    assert found["packing"].count() > 0
    assert through(spark, none)["packing"].count() == 0
    assert language.UNKNOWN == "und"
