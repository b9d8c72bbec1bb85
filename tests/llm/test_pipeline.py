"""The pipeline against the operators' brute-force meaning, and its columns."""

import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 3)[0])
import corpus_pipeline  # noqa: E402


def test_stages_and_run_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).persist()
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, data).collect()))
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == before
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_lines", "decontamination", "packing"]


def test_near_duplicates_leave_one_of_each_group(spark, data):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "something else entirely here now"), (4, "something else entirely here now"), (None, "no number at all for it"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, data)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4, 7, 8]


def test_decisions_take_effect(spark, data):
    line = "this very line is in both of the documents, word for word"
    docs = spark.createDataFrame([(1, f"{line}\nfirst", 1), (2, f"second\n{line}", 2)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_lines(spark, docs, data).collect()}
    assert out == {1: (f"{line}\nfirst", 1), 2: ("second", 6)}
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    marked = spark.createDataFrame([(1, f"before {item} after"), (2, "clean")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, marked, data).collect()] == [2]


def test_short_lines_repeat_too(spark, data):
    short, unspaced = "All rights reserved.", "这是一行没有空格的很长的文字它在两个文件里都有"
    passage = "\n".join(f"word{i} of a passage laid out short" for i in range(12))
    rows = [(1, f"{short}\n{unspaced}\n\n{passage}"), (2, f"own\n\n  all RIGHTS reserved. \n{unspaced}\n\n{passage}")]
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()}
    assert out == {1: rows[0][1], 2: "own\n\n"}


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
    assert corpus_pipeline.packing(spark, docs, data).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows(spark, data, k):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x" * 5000, None, "b", 5000), (3, "some words of a text", "en", None, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[k][1](spark, docs, data)
    assert out.columns == docs.columns and out.count() >= 3
