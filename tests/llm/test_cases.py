"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from winnow.llm import decontaminate, language, lines, lm, personal, quality, secrets, sentencepiece, simhash

from .tables import documents, empty, rows

ITEMS = [(1, "old stone houses"), (2, None), (None, "the river"), (4, "")]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def labels(spark):
    made = [(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda spark, docs: secrets.secret_report(docs),
    "lines": lambda spark, docs: lines.line_report(docs),
    "personal": lambda spark, docs: personal.personal_report(docs),
    "sentencepiece": lambda spark, docs: sentencepiece.round_trip(docs),
    "decontaminate": lambda spark, docs: decontaminate.contamination(docs, items(spark)),
    "language": lambda spark, docs: language.language_report(docs),
    "quality": lambda spark, docs: quality.quality_report(docs, labels(spark)),
    "lm": lambda spark, docs: lm.score_texts(docs, 20_000),
    "simhash": lambda spark, docs: simhash.simhash_groups(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(spark, name):
    found = OPERATORS[name](spark, documents(spark)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in found), key=key) == sorted((r[0] for r in rows()), key=key)
    by_id = {}
    for r in found:  # repeated rows get equal results
        if r["doc_id"] is not None:
            assert by_id.setdefault(r["doc_id"], r) == r


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_every_case(spark, tmp_path, name):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(spark)
    found = stage(spark, docs, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.schema.simpleString() == docs.schema.simpleString()
    assert 0 < found.count() <= docs.count()
    assert stage(spark, empty(spark), str(tmp_path)).count() == 0


def test_unlabelled_documents(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.language_report(docs).collect()} == {("und", 0.0)}
    none = labels(spark).where("false")
    assert {r.score for r in quality.quality_report(docs, none).collect()} == {0.5}
