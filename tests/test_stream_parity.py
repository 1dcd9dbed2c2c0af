import os

import pytest
from pyspark.sql import functions as F

from newslens.operators.textstats import text_stats
from newslens.plans import all_oracles, all_queries
from newslens.plans.harness import compare, duck
from newslens.session import scratch_path
from newslens.streaming import features as SF

SMALL = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    base = scratch_path(spark, "stream-test")
    src = os.path.join(base, "in")
    rows = [(1, "Uno dos."), (2, "Tres."), (3, None), (4, "Cuatro cinco seis.")]
    spark.createDataFrame(rows, "id bigint, text string").repartition(2).write.parquet(src)
    out, ck = os.path.join(base, "out"), os.path.join(base, "ck")
    SF.run_feature_stream(spark, src, out, ck)
    got = {r["id"]: r["total_words"] for r in SF.latest_results(spark, out).collect()}
    batch = text_stats(spark.createDataFrame([r for r in rows if r[1]], "id bigint, text string"), id_col="id")
    assert got == {r["id"]: r["total_words"] for r in batch.collect()}
    bad = spark.read.parquet(os.path.join(out, "quarantine")).collect()
    assert [(r["id"], r["error"]) for r in bad] == [(3, "missing text")]
    SF.run_feature_stream(spark, src, out, ck)  # same checkpoint: nothing is reprocessed
    assert spark.read.parquet(os.path.join(out, "results")).count() == 3


PARITY = ["f2_text_stats", "f12_pos_map", "t2_topics", "t4_topic_counts", "n6_top_entities", "m3_topic_sentiment",
          "d3_dedupe_first", "d5_lookup_newspaper", "x11_body", "x19_article_rows", "b1_multihot", "r3_mixed_balance",
          "v7_cv_summary", "s8_retain_snapshots", "stream_lookup", "e4_knn", "r5_tomek"]


@pytest.mark.parametrize("name", PARITY)
def test_oracle_parity_small(spark, name):
    r = compare(spark, name, SMALL, all_queries()[name], all_oracles()[name], duck(SMALL))
    assert r["status"] == "match", r


def test_every_query_has_entry(spark):
    qs, orc = all_queries(), all_oracles()
    assert set(orc) <= set(qs)
    assert len(qs) >= 70


def test_stream_service_mode(spark):
    base = scratch_path(spark, "stream-service")
    src = os.path.join(base, "in")
    spark.createDataFrame([(1, "Uno dos."), (2, "Tres.")], "id bigint, text string").write.parquet(src)
    out = os.path.join(base, "out")
    q = SF.run_feature_stream(spark, src, out, os.path.join(base, "ck"), processing_time="200 milliseconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["id"]: r["total_words"] for r in SF.latest_results(spark, out).collect()}
    assert got == {1: 3, 2: 2}
    looked = SF.lookup(SF.latest_results(spark, out), spark.createDataFrame([(2,), (9,)], "id bigint"))
    assert [r["id"] for r in looked.collect()] == [2]


def test_a_batch_computes_its_features_once(spark):
    base = scratch_path(spark, "stream-once")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(1, "Uno.", None), (2, "Dos.", None), (3, None, "missing text")], "id bigint, text string, error string")
    given = rows.mapInPandas(count, rows.schema)
    given = spark.createDataFrame(given.rdd, given.schema)  # a finished plan, as a stream gives it
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    SF.upsert_batch(os.path.join(base, "out"))(given, 0)
    assert seen.value == 3
    assert spark.read.parquet(os.path.join(base, "out", "results")).count() == 2
    assert spark.read.parquet(os.path.join(base, "out", "quarantine")).count() == 1
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= kept
