"""What a task holds, and what is sent, as tables grow."""

import numpy as np
import pandas as pd
import pytest

from newslens.functions import text as T
from newslens.operators import ivf, topics, vectors, ward
from newslens.operators.textstats import readability
from newslens.plans import graph_q, model_q


def _docs(spark, n=40):
    return spark.createDataFrame([(i, f"Casa grande {'perro gato ' * (i % 5 + 1)} casa roja número{i % 3} árbol.") for i in range(n)], "doc_id long, text string")


def test_topic_parts_follow_the_texts(spark, monkeypatch):
    df = _docs(spark)
    whole = {tuple(r) for r in topics.top_topics(topics.by_doc(df)).collect()}
    monkeypatch.setattr(topics, "PART_BYTES", 100)
    small = topics.by_doc(df)
    assert small.rdd.getNumPartitions() >= 20
    assert {tuple(r) for r in topics.top_topics(small).collect()} == whole


def test_topics_are_computed_once_for_embeddings(spark):
    df = _docs(spark)
    out = vectors.topic_embeddings(topics.top_topics(topics.by_doc(df)), docs=df)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 40


def test_index_lists_in_small_frames():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 4))
    centroids = rng.normal(size=(50, 4))
    frame = pd.DataFrame({"_id": np.arange(3000), "_v": list(v)})
    parts = list(ivf._to_lists(centroids, 20)([frame, frame.iloc[:0]]))
    assert max(map(len, parts)) <= ivf.COPIES
    got = pd.concat(parts)
    near = np.argsort(((v[:, None] - centroids[None]) ** 2).sum(2), axis=1, kind="stable")[:, :20]
    assert got["_id"].tolist() == np.repeat(np.arange(3000), 20).tolist() and got["list"].tolist() == near.ravel().tolist()


def test_ward_sends_a_cluster_to_few_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (30, 3)) for c in (0.0, 2.0, 5.0)])
    rows = spark.createDataFrame([(i, 0, [float(a) for a in v]) for i, v in enumerate(x)], "id long, community long, vec array<double>")
    parts = []
    inner = ward._neighbours
    monkeypatch.setattr(ward, "_neighbours", lambda looking, alive, d: parts.append(alive.first()["parts"]) or inner(looking, alive, d))
    got = {r.id: r["sub"] for r in ward.ward_clusters(rows, distance=1.5, block=2).collect()}
    assert parts[0] == ward.PARTS
    expected = ward.ward_labels(x, 1.5)
    assert len(set(got.values())) == len(set(expected)) == len({(got[i], expected[i]) for i in range(len(x))})


def test_readability_cuts_words_once(spark):
    plan = readability(_docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"regexp_extract_all(text#") <= plan.count(T.SENTENCE_RE) + plan.count(f", {T.WORD_RE}, 0") and plan.count(f", {T.WORD_RE}, 0") == 1


def test_each_topic_slot_has_its_own_vector(spark):
    tops = spark.createDataFrame([(1, 2, "perro"), (1, 1, "gato"), (2, 1, "perro")], "doc_id bigint, rank bigint, term string")
    e = {r["doc_id"]: r["topic_embedding"] for r in vectors.topic_embeddings(tops, dim=16).collect()}
    assert any(e[1][:16]) and any(e[2][:16]) and e[1][16:32] == e[2][:16] != e[1][:16] and not any(e[1][32:]) and not any(e[2][16:])


def _graph_tables(spark, path, n=12):
    docs = [(i, f"Casa {'Ana Lima' if i % 2 else 'Quito'} y Pedro{i % 3} hablan.", "es", "a", 40) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=4)], i % 2) for i in range(n)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("name", ["g1_edges", "g3_jaccard", "g4_time_closeness"])
def test_event_graph_keeps_no_nodes_in_executors(spark, tmp_path, name):
    _graph_tables(spark, tmp_path)
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    df = getattr(graph_q, name)(spark, str(tmp_path))
    assert 0 < df.count() <= 12 * 11
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= kept
    assert "InMemoryRelation" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_communities_keep_no_nodes_in_executors(spark, tmp_path, monkeypatch):
    _graph_tables(spark, tmp_path)
    monkeypatch.setattr(model_q, "louvain", lambda nodes, edges: nodes.withColumn("community", nodes["id"]))
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    assert model_q.g9_communities(spark, str(tmp_path)).count() == 12
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= kept


def test_communities_have_every_document(spark, tmp_path):
    _graph_tables(spark, tmp_path)
    more = spark.createDataFrame([(100, "Quito y Ana Lima.", "es", "a", 17), (101, None, None, None, None), (None, "x", "es", "a", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    more.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    found = {r.id: r.community for r in model_q.g9_communities(spark, str(tmp_path)).collect()}
    assert found.keys() == {*range(12), 100, 101} and found[100] == 100 and found[101] == 101
    assert model_q.g9_quality(spark, str(tmp_path)).first()["nodes"] == 12  # as its SQL
