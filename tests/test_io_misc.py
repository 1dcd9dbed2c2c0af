import json
import os

import numpy as np
from pyspark.sql import functions as F

from newslens.operators import balance as R
from newslens.operators import clean as C
from newslens.operators import extract as X
from newslens.operators import labels as B
from newslens.operators import vectors as VE
from newslens.operators.eventgraph import cluster_members
from newslens.session import scratch_path
from newslens.sources import io as IO
from newslens.streaming import features as SF


def test_flat_json_roundtrip_unicode(spark):
    path = scratch_path(spark, "flat")
    os.makedirs(path, exist_ok=True)
    arts = [{"id": "1", "headline": "Árbol ñandú", "body": "b", "link": "l", "fecha": "f", "sesgo": "N", "newspaper": "EL PAIS"}]
    with open(os.path.join(path, "a.json"), "w", encoding="utf-8") as f:
        json.dump(arts, f, ensure_ascii=False, indent=4)
    df = IO.read_flat_json(spark, path)
    assert df.first()["headline"] == "Árbol ñandú"
    out = scratch_path(spark, "flat-out")
    IO.write_json(df, out)
    text = "".join(open(os.path.join(out, n), encoding="utf-8").read() for n in os.listdir(out) if n.endswith(".json"))
    assert "Árbol ñandú" in text


def test_wide_csv_multiline_and_stage_append(spark):
    path = scratch_path(spark, "csv")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "n.csv"), "w", encoding="utf-8") as f:
        f.write('idNew,text,label,f1\n1,"línea uno\nlínea ""dos""",0.5,\n')
    df = IO.read_wide_csv(spark, path, "idNew string, text string, label double, f1 double")
    r = df.first()
    assert r["text"] == 'línea uno\nlínea "dos"' and r["f1"] is None
    assert C.fill_numeric_zero(df).first()["f1"] == 0.0 and C.fill_numeric_zero(df).first()["text"] == r["text"]
    stage = scratch_path(spark, "stage")
    inputs = spark.createDataFrame([(1,), (2,)], "id bigint")
    calls = []

    def compute(todo):
        calls.append(sorted(x[0] for x in todo.collect()))
        return todo.withColumn("v", F.col("id") * 10)

    IO.read_stage_or_compute(spark, stage, inputs, "id", compute)
    more = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    out = IO.read_stage_or_compute(spark, stage, more, "id", compute)
    assert calls == [[1, 2], [3]] and sorted(x["v"] for x in out.collect()) == [10, 20, 30]


def test_drop_truncate_rename_feature_columns(spark):
    df = spark.createDataFrame([(1, "x" * 600, 0.5, 1.0, "t")], "idNew int, text string, bias double, NOUN_X double, body string")
    t = B.training_table(df)
    assert t.columns == ["text", "label", "body"]
    assert df.select(C.truncate("text", 512)).first()[0] == "x" * 512
    assert C.drop_if_present(df, "missing", "idNew").columns == ["text", "bias", "NOUN_X", "body"]
    assert B.feature_columns(df.withColumnRenamed("bias", "label")) == ["idNew", "NOUN_X"]
    assert B.dummy_feature(df).first()["dummy"] == 0.0


def test_balance_passthrough_single_class(spark):
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, label int")
    out = R.balance_or_passthrough(one, R.undersample)
    assert out.count() == 2 and set(out.columns) == {"doc_id", "label", "copy"}


def test_stream_dedupe_within_watermark(spark):
    base = scratch_path(spark, "stream-dedupe")
    src = os.path.join(base, "in")
    spark.createDataFrame([(1, "Uno."), (1, "Uno."), (2, "Dos tres.")], "id bigint, text string").coalesce(1).write.parquet(src)
    out = os.path.join(base, "out")
    SF.run_feature_stream(spark, src, out, os.path.join(base, "ck"), dedupe_within="1 hour")
    assert spark.read.parquet(os.path.join(out, "results")).count() == 2


def test_pca_centred_orthogonal(spark):
    rng = np.random.default_rng(3)
    X_ = rng.normal(size=(40, 5)) @ np.diag([5.0, 3.0, 1.0, 0.5, 0.1]) + 7.0
    df = spark.createDataFrame([(i, X_[i].tolist()) for i in range(40)], "id int, embedding array<double>")
    out = VE.pca(df, "embedding", k=3)
    Z = np.array([r["reduced"] for r in out.orderBy("id").collect()])
    assert Z.shape == (40, 3)
    assert np.allclose(Z.mean(0), 0.0, atol=1e-9)  # centred before projection
    c = np.cov(Z.T)
    assert np.allclose(c - np.diag(np.diag(c)), 0.0, atol=1e-8)  # uncorrelated components
    assert c[0, 0] >= c[1, 1] >= c[2, 2]


def test_topic_embeddings_padding(spark):
    tops = spark.createDataFrame([(1, 1, "gato"), (1, 2, "perro"), (2, 1, "gato")], "doc_id bigint, rank bigint, term string")
    e = {r["doc_id"]: r["topic_embedding"] for r in VE.topic_embeddings(tops, dim=16).collect()}
    assert len(e[1]) == 48 and len(e[2]) == 48
    assert e[1][:16] == e[2][:16] and all(v == 0.0 for v in e[2][16:])
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    every = {r["doc_id"]: r["topic_embedding"] for r in VE.topic_embeddings(tops, dim=16, docs=docs).collect()}
    assert every == {**e, 3: [0.0] * 48}  # a document without topics


def test_cluster_members_rows(spark):
    m = spark.createDataFrame([(2, 1, "b"), (1, 1, "a"), (3, 2, "c")], "id bigint, cluster bigint, headline string")
    assert [(r["cluster"], r["id"]) for r in cluster_members(m).collect()] == [(1, 1), (1, 2), (2, 3)]


def test_other_site_rules():
    diario = [r for r in X.SITE_RULES if r["newspaper"] == "EL DIARIO"][0]
    html = "<ul class='footer'><h2>Entradilla</h2></ul><p class='article-text'>A</p><p class='article-text'>B</p><p>x</p>"
    assert X.article_body(html, diario) == "Entradilla\nA\nB"
    assert X.article_body("<p class='article-text'>A</p>", diario) == "\nA"
    assert X.article_body("<ul class='footer'></ul><p>A</p>", diario) == "N/A"
    razon = [r for r in X.SITE_RULES if r["newspaper"] == "LA RAZON"][0]
    assert X.article_body("<p>fuera</p>", razon) == "N/A"
    assert X.article_body("<div class='article-main__content'><p>U</p><p>V</p></div>", razon) == "\nU\nV"
    publico = [r for r in X.SITE_RULES if r["newspaper"] == "EL PUBLICO"][0]
    assert X.article_body("<p> A</p><p>B</p>", publico) == "\n A\nB"
    cover = "<article><h2 class='title'><a href='/n'>N</a></h2></article><article><h2 class='title'>sin</h2></article>"
    assert X.cover_candidates(cover, "https://www.publico.es", publico) == [("https://www.publico.es/n", "N")]


def test_remaining_cover_and_body_rules():
    def rule(name, i=0):
        return [r for r in X.SITE_RULES if r["newspaper"] == name][i]

    diario = "<div class='md__new'><h2 class='ni-title'><a href='/d1'> Uno </a></h2></div><div class='md__new'><h2>x</h2></div>"
    assert X.cover_candidates(diario, "https://www.eldiario.es", rule("EL DIARIO")) == [("https://www.eldiario.es/d1", "Uno")]
    pais = ("<article><h2 class='c_t'><a href='https://elpais.com/p'>P</a></h2></article>"
            "<article><h2 class='c_t'><span>no link</span></h2></article>")
    assert X.cover_candidates(pais, "https://elpais.com", rule("EL PAIS")) == [("https://elpais.com/p", "P")]
    razon = "<h2 class='article__title'><a href='/r'>R</a></h2><h2 class='article__title'>x</h2>"
    assert X.cover_candidates(razon, "https://www.larazon.es", rule("LA RAZON")) == [("https://www.larazon.es/r", "R")]
    conf = "<div class='news-body-complete'><p>A</p><p>B</p></div><div class='news-body-complete'><p>C</p></div>"
    assert X.article_body(conf, rule("EL CONFIDENCIAL")) == "\nA\nB"
    assert X.article_body("<p>A</p>", rule("EL CONFIDENCIAL")) == "N/A"
    assert X.article_body("<div class='ue-c-article__body' data-section='other'><p>A</p></div>", rule("EL MUNDO")) == "N/A"


def test_feature_record_shape(spark):
    from newslens.operators.record import feature_record
    d = spark.createDataFrame([(1, "Madrid es bueno. Gato gato perro."), (2, "")], "doc_id bigint, text string")
    r = {x["doc_id"]: x for x in feature_record(d).collect()}
    assert r[1]["total_words"] == 8 and r[1]["pos"]["PUNCT"]["count"] == 2
    assert r[1]["ner"]["LOC"]["count"] == 1 and r[1]["topic_terms"][0]["term"] == "gato"
    assert len(r[1]["topics"]) == 5 and r[1]["sentiment"]["label"] == "5"
    assert r[2]["pos"] == {} and r[2]["topic_awareness"] == 0.0 and r[2]["readability"]["fernandez_huerta"] == 0.0


def test_cross_validate_resume(spark):
    from newslens.operators import models as MD
    rows = [(i, [float(i % 2), float(i % 3)], i % 2, i % 3) for i in range(30)]
    df = MD.with_features(spark.createDataFrame(rows, "id int, v array<double>, label int, fold int"), "v")
    path = scratch_path(spark, "cv-results")
    g = [{"stepSize": 0.1, "maxDepth": 2}]
    first = MD.cross_validate(df, MD.gbt_factory(2), g, results_path=path)
    assert first.count() == 3
    again = MD.cross_validate(df, MD.gbt_factory(2), g + [{"stepSize": 0.2, "maxDepth": 2}], results_path=path)
    assert again.count() == 6  # only the new parameter set was fitted
