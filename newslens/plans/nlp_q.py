"""Queries for entities (N*) and sentiment (M*)."""

from __future__ import annotations

from newslens.functions import text as T
from newslens.functions.lexicons import ENTITY_PUNCT, ENTITY_TYPES, GAZETTEER, SENTIMENT_LEXICON
from newslens.operators import entities as E
from newslens.operators import sentiment as M
from newslens.operators.topics import by_doc
from newslens.plans.registry import finish, query, r6, sql_div, sql_sentences, sql_str, sql_tokens
from newslens.plans.text_q import TERMS_CTE
from newslens.sources.tables import documents

ENT_RE = sql_str(T.ENTITY_RE)
PUNCT = sql_str(ENTITY_PUNCT)
GZ = "g(form, etype) AS (VALUES " + ", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in dict(GAZETTEER).items()) + ")"
LEX = "lex(word, pol) AS (VALUES " + ", ".join(f"({sql_str(k)}, {float(v)})" for k, v in dict(SENTIMENT_LEXICON).items()) + ")"
TYPES = ", ".join(sql_str(t) for t in ENTITY_TYPES)
A, B, C, D = M.STAR_CUTS


def _stars(s: str, n: str) -> str:
    avg = f"(({s}) / ({n}))"
    return (f"(CASE WHEN ({n}) = 0 THEN 3 WHEN {avg} <= {A} THEN 1 WHEN {avg} <= {B} THEN 2 "
            f"WHEN {avg} < {C} THEN 3 WHEN {avg} < {D} THEN 4 ELSE 5 END)")


MENTIONS_CTE = f"""
{GZ},
ml AS (SELECT doc_id, regexp_extract_all(text, {ENT_RE}) AS l FROM documents),
m0 AS (SELECT doc_id, unnest(l) AS mention, generate_subscripts(l, 1) - 1 AS pos FROM ml),
m AS (SELECT m0.*, lower(trim(mention, {PUNCT})) AS norm, coalesce(g.etype, 'MISC') AS etype
      FROM m0 LEFT JOIN g ON lower(trim(mention, {PUNCT})) = g.form)"""

ENTS_CTE = f"""
{GZ},
e0 AS (SELECT doc_id, lower(trim(unnest(regexp_extract_all(text, {ENT_RE})), {PUNCT})) AS norm
       FROM documents),
ents AS (SELECT DISTINCT e0.doc_id, e0.norm AS entity FROM e0 LEFT JOIN g ON e0.norm = g.form
         WHERE coalesce(g.etype, 'MISC') IN ({TYPES}) AND e0.norm <> '')"""


@query("n1_entities", f"WITH {ENTS_CTE} SELECT doc_id, entity FROM ents")
def n1_entities(spark, sf):
    return E.doc_entities(documents(spark, sf))


@query("n5_ner_stats", f"""
WITH {MENTIONS_CTE},
c AS (SELECT doc_id, etype AS tag, count(*)::BIGINT AS count FROM m GROUP BY 1, 2),
tot AS (SELECT doc_id, len({sql_tokens()}) AS tw, len({sql_sentences()}) AS ts FROM documents)
SELECT c.doc_id, tag, count, {r6(sql_div('count', 'tw'))} AS ratio_words,
  {r6(sql_div('count', 'ts'))} AS ratio_sentences, {r6('ln(count + 1)')} AS count_log
FROM c JOIN tot USING (doc_id)""")
def n5_ner_stats(spark, sf):
    return finish(E.ner_stats(documents(spark, sf)))


@query("n6_top_entities", f"""
WITH {MENTIONS_CTE},
g2 AS (SELECT doc_id, mention, count(*)::BIGINT AS cnt, min(pos) AS first FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first ASC) AS rank FROM g2)
SELECT doc_id, rank::BIGINT AS rank, mention AS entity, cnt FROM r WHERE rank <= 5""")
def n6_top_entities(spark, sf):
    return E.top_entities(by_doc(documents(spark, sf)))


@query("n7_entity_df", f"WITH {ENTS_CTE} SELECT entity, count(*)::BIGINT AS df FROM ents GROUP BY entity")
def n7_entity_df(spark, sf):
    return E.entity_doc_freq(E.doc_entities(documents(spark, sf)))


@query("n8_entity_tfidf", f"""
WITH {ENTS_CTE},
dfq AS (SELECT entity, count(*) AS df FROM ents GROUP BY entity),
n AS (SELECT count(*) AS n_docs FROM documents),
s AS (SELECT ents.doc_id, sum(ln(n.n_docs / (1.0 + dfq.df))) AS score FROM ents JOIN dfq USING (entity), n
      GROUP BY ents.doc_id)
SELECT d.doc_id, {r6('coalesce(s.score, 0.0)')} AS score FROM documents d LEFT JOIN s USING (doc_id)""")
def n8_entity_tfidf(spark, sf):
    return finish(E.entity_scores(documents(spark, sf)))


@query("n9_entity_tfidf_cells", f"""
WITH {MENTIONS_CTE},
nm AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id),
tok AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(mention), {sql_str(E.ENTITY_TERM_RE)})) AS term FROM m),
tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
dft AS (SELECT doc_id, term, count(*) AS dft FROM tf GROUP BY 1, 2),
voc AS (SELECT doc_id, term, dft, row_number() OVER (PARTITION BY doc_id ORDER BY term) - 1 AS tidx,
               count(*) OVER (PARTITION BY doc_id) AS V FROM dft),
x AS (SELECT tf.doc_id, tf.pos, voc.tidx, tf.tf * (ln((1.0 + nm.n) / (1.0 + voc.dft)) + 1.0) AS x
      FROM tf JOIN voc USING (doc_id, term) JOIN nm USING (doc_id)),
xv AS (SELECT doc_id, pos AS m, tidx AS t, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, pos)) AS val FROM x),
shape AS (SELECT doc_id, max(V) AS V FROM voc GROUP BY doc_id),
cells AS (SELECT d.doc_id, c.cell, CASE WHEN s.V > 0 THEN c.cell // s.V END AS m,
                 CASE WHEN s.V > 0 THEN c.cell % s.V END AS t
          FROM documents d LEFT JOIN shape s USING (doc_id), (SELECT unnest(range(0, 5)) AS cell) c)
SELECT cells.doc_id, cells.cell::BIGINT AS cell, {r6('coalesce(xv.val, 0.0)')} AS value
FROM cells LEFT JOIN xv ON cells.doc_id = xv.doc_id AND cells.m = xv.m AND cells.t = xv.t""")
def n9_entity_tfidf_cells(spark, sf):
    return finish(E.entity_tfidf_cells(by_doc(documents(spark, sf))))


# ---------------- sentiment ----------------

@query("m1_text_sentiment", f"""
WITH {LEX},
t AS (SELECT doc_id, lower(unnest({sql_tokens()})) AS w FROM documents),
p AS (SELECT t.doc_id, sum(lex.pol) AS s, count(*) AS n FROM t JOIN lex ON t.w = lex.word GROUP BY t.doc_id),
j AS (SELECT d.doc_id, coalesce(p.s, 0.0) AS s, coalesce(p.n, 0) AS n FROM documents d LEFT JOIN p USING (doc_id))
SELECT doc_id, {_stars('s', 'n')}::VARCHAR AS label,
  {r6('CASE WHEN n = 0 THEN 0.0 ELSE s / n END')} AS score FROM j""")
def m1_text_sentiment(spark, sf):
    return finish(M.text_sentiment(documents(spark, sf)))


SENT_PARTS_CTE = f"""
{LEX},
sl AS (SELECT doc_id, {sql_sentences()} AS l FROM documents),
se AS (SELECT doc_id, unnest(l) AS sent, generate_subscripts(l, 1) AS si FROM sl),
st AS (SELECT doc_id, si, sent, lower(unnest({sql_tokens('sent')})) AS w FROM se),
sp0 AS (SELECT st.doc_id, st.si, sum(lex.pol) AS s, count(lex.pol) AS n FROM st LEFT JOIN lex ON st.w = lex.word
        GROUP BY st.doc_id, st.si),
sp AS (SELECT se.doc_id, se.si, se.sent, coalesce(sp0.s, 0.0) AS s, coalesce(sp0.n, 0) AS n
       FROM se LEFT JOIN sp0 USING (doc_id, si))"""


@query("m2_phrase_sentiment", f"""
WITH {SENT_PARTS_CTE},
k AS (SELECT doc_id, {_stars('s', 'n')} AS st FROM sp),
c AS (SELECT doc_id, count(*) FILTER (WHERE st >= 4) AS pos, count(*) FILTER (WHERE st <= 2) AS neg,
             count(*) FILTER (WHERE st = 3) AS neu, count(*) AS tot FROM k GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(neu, 0) AS neu,
             coalesce(tot, 0) AS tot FROM documents d LEFT JOIN c USING (doc_id))
SELECT doc_id, pos::BIGINT AS positive_phrases_count, neg::BIGINT AS negative_phrases_count,
  neu::BIGINT AS neutral_phrases_count, {r6(sql_div('pos', 'tot'))} AS positive_phrases_ratio,
  {r6(sql_div('neg', 'tot'))} AS negative_phrases_ratio, {r6(sql_div('neu', 'tot'))} AS neutral_phrases_ratio
FROM j""")
def m2_phrase_sentiment(spark, sf):
    return finish(M.phrase_sentiment(documents(spark, sf)))


@query("m3_topic_sentiment", f"""
WITH {TERMS_CTE}, {SENT_PARTS_CTE},
slots AS (SELECT d.doc_id, r.rank, t.term FROM documents d, (SELECT unnest(range(1, 6)) AS rank) r
          LEFT JOIN tops t ON t.doc_id = d.doc_id AND t.rank = r.rank),
rel AS (SELECT slots.doc_id, slots.rank, slots.term, count(sp.si) AS k, coalesce(sum(sp.s), 0.0) AS s,
               coalesce(sum(sp.n), 0) AS n
        FROM slots LEFT JOIN sp ON sp.doc_id = slots.doc_id AND slots.term IS NOT NULL AND contains(sp.sent, slots.term)
        GROUP BY 1, 2, 3)
SELECT doc_id, rank::BIGINT AS rank,
  CASE WHEN term IS NULL THEN '' WHEN k = 0 THEN '3' ELSE {_stars('s', 'n')}::VARCHAR END AS label,
  {r6('CASE WHEN term IS NULL OR k = 0 OR n = 0 THEN 0.0 ELSE s / n END')} AS score
FROM rel""")
def m3_topic_sentiment(spark, sf):
    return finish(M.topic_sentiment(by_doc(documents(spark, sf))))
