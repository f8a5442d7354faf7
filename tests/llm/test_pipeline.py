"""The pipeline's stages on a small corpus, each held against what it must do to its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm.common import materialize

from .test_operators import brute_repeats, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = [(i, prose(i, 80) + "\n" + prose(500 + i, 20), "en") for i in range(40)]
    rows += [(100, rows[0][1], "en"), (101, rows[1][1] + " once more", "en"), (102, None, "en"), (103, "", None), (104, "123 " * 80, "en"), (105, "too short", "en")]
    rows += [(200 + i, prose(900 + i, 60) + " " + rows[2][1][:120], "en") for i in range(3)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(materialize(stage(spark, held[-1], folder)))
        if name != "packing":
            assert held[-1].columns == columns
    ids = [sorted(r[0] for r in x.select("doc_id").distinct().collect()) for x in held]
    assert set(ids[0]) - set(ids[1]) == {102, 103, 104}
    assert set(ids[1]) - set(ids[2]) == {105}
    assert set(ids[2]) - set(ids[3]) == {100, 101}
    assert ids[3] == ids[4] == ids[5]
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in held[3:5])
    want = brute_repeats(list(before.items()))
    assert {i: len(before[i].encode()) - len(t.encode()) for i, t in after.items()} == {i: w[1] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in held[4].collect())
    sums = held[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert all(r["n"] == r["all"] for r in sums.collect())


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "MinHash near-dedup", "suffix-array dedup", "packing"]


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
