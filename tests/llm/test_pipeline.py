"""The pipeline: every stage against a plain version of its rule."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillspark.llm import mixing
from test_neardup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in cp.STAGES:
        result = cp.materialize(stage(spark, docs, SF), "test-stage")
        out.append((docs, result))
        docs = result
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shards"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    assert stages[-1][1].columns[:5] == stages[0][0].columns


def test_quality_keeps_what_labels_call_good(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = set(ids(after))
    judged = [(r["doc_id"] in kept) == (r["quality"] == 1) for r in labels.collect()]
    assert sum(judged) / len(judged) > 0.95


def test_one_of_each_group(stages):
    before, after = stages[1]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == sorted(i for (i, _, c) in brute(rows, 5, 80) if i == c)


def test_no_item_is_left(spark, stages):
    before, after = stages[2]
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r in before.collect() if not any(t in r["text"].lower() for t in items)]
    assert ids(after) == sorted(clean)


def test_mix_takes_its_copies(stages):
    before, after = stages[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == want


def test_shards_hold_every_row(stages):
    before, after = stages[4]
    assert ids(before) == ids(after)
    assert after.groupBy("shard").agg(F.sum("bytes").alias("b")).filter(F.col("b") > cp.SHARD_BYTES).count() == 0
