import math

from newslens.operators import entities as E
from newslens.operators import sentiment as M
from newslens.operators import textstats as S
from newslens.operators import topics as TP

TEXTS = [
    (1, ""),
    (2, "   "),
    (3, "palabra"),
    (4, "de la que el"),
    (5, "¿Qué? ¡ÁRBOL!"),
    (6, "Uno dos.\n\nTres cuatro."),
]


def _docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_base_counts_and_zero_denominators(spark):
    r = {x["doc_id"]: x for x in S.text_stats(_docs(spark)).collect()}
    assert r[1]["total_words"] == 0 and r[1]["total_sentences"] == 0 and r[1]["total_paragraphs"] == 1
    assert r[1]["char_per_word_ratio"] == 0.0 and r[1]["word_per_sentence_ratio"] == 0.0
    assert r[2]["total_characters"] == 3 and r[2]["total_words"] == 0
    assert r[3]["total_words"] == 1 and r[3]["unique_lemmatized_words"] == 1
    assert r[4]["total_stopwords"] == 4 and r[4]["unique_lemmatized_words"] == 0
    # tokens: ¿ Qué ? ¡ ÁRBOL !  -> punctuation counts as words
    assert r[5]["total_words"] == 6
    assert r[5]["total_sentences"] == 2
    assert r[5]["total_mayus"] == 6
    assert r[5]["total_interrogations"] == 2 and r[5]["total_exclamations"] == 2
    assert r[6]["total_paragraphs"] == 2
    assert math.isclose(r[6]["total_words_log"], math.log(r[6]["total_words"] + 1))


def test_pos_stats_sum_to_words(spark):
    d = _docs(spark)
    pos = S.pos_stats(d).groupBy("doc_id").sum("count").collect()
    words = {x["doc_id"]: x["total_words"] for x in S.text_stats(d).collect()}
    for row in pos:
        assert row["sum(count)"] == words[row["doc_id"]]


def test_topics_rank_ties_and_cells(spark):
    rows = [
        (1, ""),                                     # no topic
        (2, "gato"),                                 # one topic
        (3, "gato perro"),                           # two, ascending names
        (4, "perro gato gato"),                      # two, gato first
        (5, "zeta alfa beta zeta alfa beta"),        # three equal scores -> later name first
    ]
    d = _docs(spark, rows)
    tops = {(x["doc_id"], x["rank"]): x["term"] for x in TP.top_topics(d).collect()}
    assert tops[(4, 1)] == "gato" and tops[(4, 2)] == "perro"
    assert [tops[(5, r)] for r in (1, 2, 3)] == ["zeta", "beta", "alfa"]
    cells = {x["doc_id"]: (x["c1"], x["c2"], x["c3"]) for x in TP.topic_cells(d).collect()}
    assert cells[1] == (0.0, 0.0, 0.0)
    assert cells[2] == (1.0, 0.0, 0.0)
    assert cells[3] == (0.0, 1.0, 1.0)  # ranks: perro (later name) first, then gato
    assert cells[4] == (1.0, 0.0, 0.0)  # gato first and alphabetically first
    assert cells[5] == (0.0, 0.0, 1.0)  # zeta is third alphabetically


def test_topic_counts_padding_and_awareness(spark):
    d = _docs(spark, [(1, "Gato gato perro."), (2, "")])
    c = {(x["doc_id"], x["rank"]): x for x in TP.topic_counts(d).collect()}
    assert c[(1, 1)]["cnt"] == 2 and c[(1, 2)]["cnt"] == 1 and c[(1, 3)]["cnt"] == 0
    assert c[(2, 5)]["score"] == 0.0 and len([k for k in c if k[0] == 2]) == 5
    a = {x["doc_id"]: x["topic_awareness"] for x in TP.topic_awareness(d).collect()}
    h = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3))
    assert math.isclose(a[1], 1 / (1 + h)) and a[2] == 0.0


def test_entities_and_scores(spark):
    d = _docs(spark, [(1, "Madrid y Pedro Sánchez. Madrid"), (2, "sin nombres"), (3, "Madrid.")])
    ents = {(x["doc_id"], x["entity"]) for x in E.doc_entities(d).collect()}
    assert ents == {(1, "madrid"), (1, "pedro sánchez"), (3, "madrid")}
    top = [(x["rank"], x["entity"], x["cnt"]) for x in E.top_entities(d).filter("doc_id = 1").orderBy("rank").collect()]
    assert top == [(1, "Madrid", 2), (2, "Pedro Sánchez", 1)]
    s = {x["doc_id"]: x["score"] for x in E.entity_scores(d).collect()}
    assert math.isclose(s[1], math.log(3 / 3) + math.log(3 / 2)) and s[2] == 0.0


def test_sentiment_rules(spark):
    d = _docs(spark, [(1, "Es bueno. Es malo. Nada."), (2, "")])
    m1 = {x["doc_id"]: (x["label"], x["score"]) for x in M.text_sentiment(d).collect()}
    assert m1[1] == ("3", 0.0) and m1[2] == ("3", 0.0)
    m2 = {x["doc_id"]: x for x in M.phrase_sentiment(d).collect()}
    assert (m2[1]["positive_phrases_count"], m2[1]["negative_phrases_count"], m2[1]["neutral_phrases_count"]) == (1, 1, 1)
    assert m2[2]["positive_phrases_ratio"] == 0.0


def test_heavy_entities_are_scored_where_they_lie(spark):
    """One entity in 90 % of the documents: the scores are those of a plain join, and its rows are not joined by a shuffle."""
    import math

    from newslens.operators import entities as E

    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    rows = [(i, "hot") for i in range(180)] + [(i, f"e{i % 7}") for i in range(0, 200, 2)] + [(5, "own")]
    ents = spark.createDataFrame(rows, "doc_id long, entity string")
    df = {}
    for _, e in rows:
        df[e] = df.get(e, 0) + 1
    wanted = {i: sum(math.log(200 / (1 + df[e])) for j, e in rows if j == i) for i in range(200)}
    for heavy in (50, 1, 10**6):
        scored = E.entity_scores(docs, ents=ents, heavy_df=heavy)
        found = {r.doc_id: r.score for r in scored.collect()}
        assert found.keys() == wanted.keys() and all(abs(found[i] - wanted[i]) < 1e-9 for i in found)
    plan = E.entity_scores(docs, ents=ents, heavy_df=50)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
