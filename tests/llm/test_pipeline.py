"""Stages of the pipeline: columns, what they keep, and odd rows."""

import corpus_pipeline

from .conftest import DOCS, prose, rows


def test_run_over_odd_documents(spark, sf, docs):
    out = corpus_pipeline.run(spark, sf(documents=docs))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_stages_keep_columns_and_clean_documents(spark, sf):
    data = [(k, prose(k, 100), "en", f"s{k % 3}", None, 0, "t", "n", "s", True, 1) for k in range(40)]
    data += [(100, data[0][1], *data[0][2:]), data[1], (101, data[2][1].replace(" ", "  "), *data[2][2:]), (102, "short", *data[0][2:]), (103, prose(500, 60) + " me@x.org", *data[0][2:])]
    d = spark.createDataFrame(data, DOCS)
    folder = sf(documents=d)
    by = dict(corpus_pipeline.STAGES)
    kept = by["quality"](spark, d, folder)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in data} - {102}
    one = by["near_duplicates"](spark, kept, folder)
    assert one.columns == d.columns and sorted(r["doc_id"] for r in one.collect()) == [*range(40), 103]
    clean = by["personal_data"](spark, one, folder)
    assert clean.columns == d.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert texts[103][0].endswith(" <EMAIL>") and texts[103][1] == len(texts[103][0]) and texts[5][0] == data[5][1]
    mixed = by["mix"](spark, clean, folder)
    assert mixed.columns == d.columns


def test_empty(spark, sf, empty):
    assert corpus_pipeline.run(spark, sf(documents=empty)).count() == 0
    assert len(rows()) > 20
