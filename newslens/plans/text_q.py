"""Queries for text statistics (F*) and topics (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.functions import text as T
from newslens.functions.lexicons import POS_LOOKUP
from newslens.operators import textstats as S
from newslens.operators import topics as TP
from newslens.plans.registry import (ALPHA, WORD, finish, query, r6, round6, sql_div, sql_lemmas,
                                     sql_sentences, sql_str, sql_tokens, stop_list)
from newslens.sources.tables import documents

COUNTS = S.BASE_COUNTS
NL2 = "chr(10) || chr(10)"

# A per-document CTE with the same base fields the Spark operator computes.
BASE_CTE = f"""
b AS (
  SELECT doc_id, text,
    len({sql_tokens()})::BIGINT AS total_words,
    len({sql_sentences()})::BIGINT AS total_sentences,
    ((length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))
      - length(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), {NL2}, ''))) // 2 + 1)::BIGINT AS total_paragraphs,
    length(text)::BIGINT AS total_characters,
    len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS total_mayus,
    len(regexp_extract_all(text, '[?¿]'))::BIGINT AS total_interrogations,
    len(regexp_extract_all(text, '[!¡]'))::BIGINT AS total_exclamations,
    len(list_filter({sql_tokens()}, lambda x: lower(x) IN ({stop_list()})))::BIGINT AS total_stopwords,
    len(list_distinct({sql_lemmas()}))::BIGINT AS unique_lemmatized_words
  FROM documents)"""

RATIO_SQL = {
    "char_per_word_ratio": ("total_characters", "total_words"),
    "char_per_sentence_ratio": ("total_characters", "total_sentences"),
    "word_per_sentence_ratio": ("total_words", "total_sentences"),
    "char_per_paragraph_ratio": ("total_characters", "total_paragraphs"),
    "sentences_per_paragraph_ratio": ("total_sentences", "total_paragraphs"),
    "word_per_paragraph_ratio": ("total_words", "total_paragraphs"),
}


def _counts_sql() -> str:
    return ", ".join(f"{c}, {r6(f'ln({c} + 1)')} AS {c}_log" for c in COUNTS)


def _ratios_sql() -> str:
    return ", ".join(f"{r6(sql_div(a, b))} AS {n}" for n, (a, b) in RATIO_SQL.items())


@query("f1_tokens", f"""
SELECT doc_id, len({sql_tokens()})::BIGINT AS n_tokens, len(list_distinct({sql_tokens()}))::BIGINT AS n_distinct
FROM documents""")
def f1_tokens(spark, sf):
    return S.token_summary(documents(spark, sf))


@query("f2_text_stats", f"WITH {BASE_CTE} SELECT doc_id, {_counts_sql()} FROM b")
def f2_text_stats(spark, sf):
    s = S.text_stats(documents(spark, sf))
    return finish(s.select("doc_id", *[x for c in COUNTS for x in (c, f"{c}_log")]))


@query("f7_stopwords", f"""
SELECT doc_id, len(list_filter({sql_tokens()}, lambda x: lower(x) IN ({stop_list()})))::BIGINT AS total_stopwords
FROM documents""")
def f7_stopwords(spark, sf):
    return S.stopword_counts(documents(spark, sf))


@query("f8_filtered_lemmas", f"""
SELECT doc_id, len({sql_lemmas()})::BIGINT AS n_filtered,
  len(list_distinct({sql_lemmas()}))::BIGINT AS unique_lemmatized_words,
  {r6(sql_div(f'len(list_distinct({sql_lemmas()}))', f'len({sql_tokens()})'))} AS ratio
FROM documents""")
def f8_filtered_lemmas(spark, sf):
    return finish(S.lemma_stats(documents(spark, sf)))


@query("f11_ratios", f"WITH {BASE_CTE} SELECT doc_id, {_ratios_sql()} FROM b")
def f11_ratios(spark, sf):
    return finish(S.ratios(documents(spark, sf)))


def _pos_values() -> str:
    seen, rows = set(), []
    for form, tag in POS_LOOKUP:
        if form not in seen:
            seen.add(form)
            rows.append(f"({sql_str(form)}, {sql_str(tag)})")
    return ", ".join(rows)


@query("f12_pos_map", f"""
WITH lk(form, upos) AS (VALUES {_pos_values()}),
tok AS (SELECT doc_id, unnest({sql_tokens()}) AS token FROM documents),
tg AS (
  SELECT t.doc_id, CASE WHEN lk.upos IS NOT NULL THEN lk.upos
                        WHEN regexp_matches(t.token, '^\\p{{N}}+$') THEN 'NUM'
                        WHEN NOT regexp_matches(t.token, '[\\p{{L}}\\p{{N}}_]') THEN 'PUNCT'
                        ELSE 'X' END AS tag
  FROM tok t LEFT JOIN lk ON lower(t.token) = lk.form),
c AS (SELECT doc_id, tag, count(*)::BIGINT AS count FROM tg GROUP BY 1, 2),
tot AS (SELECT doc_id, len({sql_tokens()}) AS tw, len({sql_sentences()}) AS ts FROM documents)
SELECT c.doc_id, tag, count, {r6(sql_div('count', 'tw'))} AS ratio_words,
  {r6(sql_div('count', 'ts'))} AS ratio_sentences, {r6('ln(count + 1)')} AS count_log
FROM c JOIN tot USING (doc_id)""")
def f12_pos_map(spark, sf):
    return finish(S.pos_stats(documents(spark, sf)))


_READ_WORDS = f"list_filter(regexp_extract_all(text, {WORD}), lambda w: regexp_matches(w, {ALPHA}))"


@query("f13_readability", f"""
WITH b AS (
  SELECT doc_id,
    len({_READ_WORDS})::DOUBLE AS w,
    len({sql_sentences()})::DOUBLE AS s,
    coalesce(list_sum(list_transform({_READ_WORDS},
        lambda x: greatest(1, len(regexp_extract_all(lower(x), {sql_str(T.VOWEL_GROUP_RE)}))))), 0)::DOUBLE AS syl,
    coalesce(list_sum(list_transform({_READ_WORDS}, lambda x: length(x))), 0)::DOUBLE AS let
  FROM documents)
SELECT doc_id,
  {r6(f"CASE WHEN w > 0 AND s > 0 THEN 206.84 - 60.0 * (syl / w) - 1.02 * (w / s) ELSE 0.0 END")} AS fernandez_huerta,
  {r6(f"CASE WHEN w > 0 AND s > 0 THEN 206.835 - 62.3 * (syl / w) - (w / s) ELSE 0.0 END")} AS szigriszt_pazos,
  {r6(f"CASE WHEN w > 0 AND s > 0 THEN 95.2 - 9.7 * (let / w) - 0.35 * (w / s) ELSE 0.0 END")} AS gutierrez_polini
FROM b""")
def f13_readability(spark, sf):
    return finish(S.readability(documents(spark, sf)))


@query("f15_feature_table", f"""
WITH {BASE_CTE}
SELECT doc_id, {_counts_sql()}, {_ratios_sql()}, total_stopwords, {r6('ln(total_stopwords + 1)')} AS total_stopwords_log,
  unique_lemmatized_words, {r6('ln(unique_lemmatized_words + 1)')} AS unique_lemmatized_words_log,
  {r6(sql_div('unique_lemmatized_words', 'total_words'))} AS unique_lemmatized_words_ratio
FROM b""")
def f15_feature_table(spark, sf):
    return finish(S.text_stats(documents(spark, sf)))


# ---------------- topics ----------------

TERMS_CTE = f"""
lem AS (SELECT doc_id, unnest(list_filter({sql_lemmas()}, lambda x: length(x) >= 2)) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM lem GROUP BY 1, 2),
voc AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term ASC) AS vr FROM tf),
v AS (SELECT doc_id, term, tf, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS score FROM voc WHERE vr <= 100),
tops AS (SELECT doc_id, term, tf, score,
           row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term DESC) AS rank FROM v)"""


@query("t1_topic_terms", f"WITH {TERMS_CTE} SELECT doc_id, term, tf FROM v")
def t1_topic_terms(spark, sf):
    d = TP.by_doc(documents(spark, sf))
    return TP.topic_terms(d).select("doc_id", "term", "tf")


@query("t2_topics", f"WITH {TERMS_CTE} SELECT doc_id, rank::BIGINT AS rank, term, {r6('score')} AS score FROM tops WHERE rank <= 5")
def t2_topics(spark, sf):
    d = TP.by_doc(documents(spark, sf))
    return finish(TP.top_topics(d).select("doc_id", "rank", "term", "score"))


@query("t4_topic_counts", f"""
WITH {TERMS_CTE},
slots AS (SELECT doc_id, unnest(range(1, 6)) AS rank,
                 list_transform(regexp_extract_all(text, {WORD}), lambda w: lower(w)) AS words,
                 len({sql_tokens()}) AS tw FROM documents),
j AS (SELECT s.doc_id, s.rank, s.words, s.tw, t.term, t.score FROM slots s
      LEFT JOIN tops t ON t.doc_id = s.doc_id AND t.rank = s.rank),
c AS (SELECT doc_id, rank, tw, score,
        (CASE WHEN term IS NULL THEN 0 ELSE len(list_filter(words, lambda w: w = term)) END)::BIGINT AS cnt FROM j)
SELECT doc_id, rank::BIGINT AS rank, cnt, {r6(sql_div('cnt', 'tw'))} AS ratio_words,
  {r6('coalesce(score, 0.0)')} AS score, {r6('ln(cnt + 1)')} AS cnt_log FROM c""")
def t4_topic_counts(spark, sf):
    d = TP.by_doc(documents(spark, sf))
    return finish(TP.topic_counts(d))


@query("t5_topic_cells", f"""
WITH {TERMS_CTE},
t3 AS (SELECT doc_id, list(term ORDER BY rank) AS names FROM tops WHERE rank <= 3 GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(t3.names, []::VARCHAR[]) AS names FROM documents d LEFT JOIN t3 USING (doc_id)),
k AS (SELECT doc_id, names, list_sort(names) AS alpha, len(names) AS n FROM j),
cells AS (SELECT doc_id, c,
   CASE WHEN n = 0 OR c // n >= n THEN 0.0
        WHEN alpha[(c % n) + 1] = names[(c // n) + 1] THEN 1.0 ELSE 0.0 END AS v
   FROM k, (SELECT unnest([0, 1, 2]) AS c))
SELECT doc_id, max(v) FILTER (WHERE c = 0) AS c1, max(v) FILTER (WHERE c = 1) AS c2,
       max(v) FILTER (WHERE c = 2) AS c3 FROM cells GROUP BY doc_id""")
def t5_topic_cells(spark, sf):
    d = TP.by_doc(documents(spark, sf))
    return finish(TP.topic_cells(d))


@query("t6_topic_awareness", f"""
WITH {TERMS_CTE},
p AS (SELECT doc_id, tf / sum(tf) OVER (PARTITION BY doc_id) AS p FROM v),
h AS (SELECT doc_id, sum(-p * ln(p)) AS h FROM p GROUP BY doc_id)
SELECT d.doc_id, {r6('CASE WHEN coalesce(h, 0.0) <> 0 THEN 1.0 / (1.0 + h) ELSE 0.0 END')} AS topic_awareness
FROM documents d LEFT JOIN h USING (doc_id)""")
def t6_topic_awareness(spark, sf):
    d = TP.by_doc(documents(spark, sf))
    return finish(TP.topic_awareness(d))


@query("f15_feature_record")
def f15_feature_record(spark, sf):
    """The full DM8 record (maps, topic arrays, sentiment and readability structs), summarised per row."""
    from newslens.operators.record import feature_record

    r = feature_record(documents(spark, sf))
    return r.select("doc_id", "total_words", F.size("pos").cast("bigint").alias("n_pos_tags"),
                    F.size("ner").cast("bigint").alias("n_ner_tags"), F.size("topic_terms").cast("bigint").alias("n_topics"),
                    F.col("sentiment.label").alias("sentiment_label"),
                    round6(F.col("topic_awareness")).alias("topic_awareness"))
