"""The full per-text feature record (F15, DM8).

One row per document: the 25 base fields, the POS and NER families as
``map<tag, struct<count, ratio_words, ratio_sentences, count_log>>``, the
top topics as an array of structs, text / phrase / topic sentiment, topic
awareness and readability. Families are computed from a frame partitioned once
by id, so the joins that assemble the record are co-partitioned (no extra
exchange). A wide pivot (one column per tag) is only for export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.operators import entities as E
from newslens.operators import sentiment as M
from newslens.operators import textstats as S
from newslens.operators import topics as TP


def _as_map(long: DataFrame, id_col: str, name: str) -> DataFrame:
    return long.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(
        "tag", F.struct("count", "ratio_words", "ratio_sentences", "count_log")))).alias(name))


def feature_record(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    d = TP.by_doc(docs.select(id_col, text_col), id_col, text_col)
    base = S.text_stats(d, text_col, id_col)
    pos = _as_map(S.pos_stats(d, text_col, id_col), id_col, "pos")
    ner = _as_map(E.ner_stats(d, text_col, id_col), id_col, "ner")
    tc = TP.topic_counts(d, text_col, id_col)
    topics = tc.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "cnt", "ratio_words", "score", "cnt_log"))).alias("topics"))
    tops = TP.top_topics(d, text_col, id_col)
    names = tops.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("topic_terms"))
    sent = M.text_sentiment(d, text_col, id_col).select(id_col, F.struct("label", "score").alias("sentiment"))
    phr = M.phrase_sentiment(d, text_col, id_col)
    phrases = phr.select(id_col, F.struct(*[c for c in phr.columns if c != id_col]).alias("phrases"))
    tsent = M.topic_sentiment(d, text_col, id_col, topics=tops).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("rank", "label", "score"))).alias("topic_sentiment"))
    aware = TP.topic_awareness(d, text_col, id_col)
    read = S.readability(d, text_col, id_col)
    readability = read.select(id_col, F.struct(*[c for c in read.columns if c != id_col]).alias("readability"))
    empty_map = F.create_map().cast("map<string,struct<count:bigint,ratio_words:double,ratio_sentences:double,count_log:double>>")
    out = base
    for part in (pos, ner, topics, names, sent, phrases, tsent, aware, readability):
        out = out.join(part, id_col, "left")
    return (out.withColumn("pos", F.coalesce("pos", empty_map)).withColumn("ner", F.coalesce("ner", empty_map))
            .withColumn("topic_terms", F.coalesce("topic_terms", F.array().cast("array<struct<rank:bigint,term:string>>")))
            .withColumn("error", F.lit(None).cast("string")))
