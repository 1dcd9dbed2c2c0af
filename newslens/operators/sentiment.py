"""Sentiment (M1-M3) with a pluggable scorer.

Default scorer: a lexicon (word -> polarity) held as a literal map, so scoring
is a per-row higher-order function with no join and no shuffle. The average
polarity of matched tokens maps to 1-5 stars; a text with no lexicon word is 3
stars with score 0. Stars 1-2 are negative, 3 neutral, 4-5 positive.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.functions import text as T
from newslens.functions.lexicons import SENTIMENT_LEXICON, TOPICS_TOP
from newslens.operators.topics import top_topics

# --- fixed values: star cut points on the average polarity ----------------------------
STAR_CUTS = (-0.6, -0.2, 0.2, 0.6)
# --- end fixed values ---------------------------------------------------------------


def lexicon_map(lexicon=SENTIMENT_LEXICON) -> Column:
    d = dict(lexicon)
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in d.items()))


def polarity_parts(text: Column, lexicon=SENTIMENT_LEXICON) -> Column:
    """struct(s = sum of polarities, n = matched tokens) for a text column."""
    lex = lexicon_map(lexicon)
    pols = F.filter(F.transform(T.tokens(text), lambda t: F.try_element_at(lex, F.lower(t))), lambda p: p.isNotNull())
    return F.struct(F.aggregate(pols, F.lit(0.0), lambda a, p: a + p).alias("s"), F.size(pols).alias("n"))


def stars(s: Column, n: Column) -> Column:
    avg = s / n
    a, b, c, d = STAR_CUTS
    return (F.when(n == 0, F.lit(3)).when(avg <= a, F.lit(1)).when(avg <= b, F.lit(2))
            .when(avg < c, F.lit(3)).when(avg < d, F.lit(4)).otherwise(F.lit(5)))


def score(s: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(s / n)


def text_sentiment(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lexicon=SENTIMENT_LEXICON) -> DataFrame:
    """M1: (id, label '1'..'5', score)."""
    p = df.select(F.col(id_col), polarity_parts(F.col(text_col), lexicon).alias("p"))
    return p.select(id_col, stars(F.col("p.s"), F.col("p.n")).cast("string").alias("label"),
                    score(F.col("p.s"), F.col("p.n")).alias("score"))


def phrase_sentiment(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lexicon=SENTIMENT_LEXICON) -> DataFrame:
    """M2: counts and shares of positive / negative / neutral sentences."""
    lex = lexicon_map(lexicon)

    def sent_stars(s):
        pols = F.filter(F.transform(T.tokens(s), lambda t: F.try_element_at(lex, F.lower(t))), lambda p: p.isNotNull())
        return stars(F.aggregate(pols, F.lit(0.0), lambda a, p: a + p), F.size(pols))

    st = df.select(F.col(id_col), F.transform(T.sentences(text_col), sent_stars).alias("st"))
    pos = F.size(F.filter("st", lambda x: x >= 4)).cast("bigint")
    neg = F.size(F.filter("st", lambda x: x <= 2)).cast("bigint")
    neu = F.size(F.filter("st", lambda x: x == 3)).cast("bigint")
    tot = F.size("st")
    return st.select(id_col, pos.alias("positive_phrases_count"), neg.alias("negative_phrases_count"),
                     neu.alias("neutral_phrases_count"),
                     T.safe_div(pos, tot).alias("positive_phrases_ratio"),
                     T.safe_div(neg, tot).alias("negative_phrases_ratio"),
                     T.safe_div(neu, tot).alias("neutral_phrases_ratio"))


def topic_sentiment(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = TOPICS_TOP,
                    lexicon=SENTIMENT_LEXICON, topics: DataFrame | None = None) -> DataFrame:
    """M3: per topic slot, score the sentences that contain the topic (case-sensitive
    substring); no such sentence -> ('3', 0.0); empty slot -> ('', 0.0).

    Scoring the joined fragment equals summing the per-sentence parts, so the
    topic x sentence match runs inside the document row (<= k x sentences).
    """
    tops = topics if topics is not None else top_topics(df, text_col, id_col, k)
    per_doc = tops.groupBy(id_col).agg(F.collect_list(F.struct("rank", "term")).alias("tops"))
    lex = lexicon_map(lexicon)

    def parts(s):
        pols = F.filter(F.transform(T.tokens(s), lambda t: F.try_element_at(lex, F.lower(t))), lambda p: p.isNotNull())
        return F.struct(s.alias("sent"), F.aggregate(pols, F.lit(0.0), lambda a, p: a + p).alias("s"),
                        F.size(pols).alias("n"))

    d = df.select(F.col(id_col), F.transform(T.sentences(text_col), parts).alias("sp"))
    j = d.join(per_doc, id_col, "left")
    empty = F.array().cast("array<struct<rank:bigint,term:string>>")
    j = j.select(id_col, "sp", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda r: F.struct(
        r.cast("bigint").alias("rank"),
        F.get(F.filter(F.coalesce(F.col("tops"), empty), lambda t: t["rank"] == r), 0)["term"].alias("term")))).alias("slot"))
    term = F.col("slot.term")
    rel = F.filter("sp", lambda x: F.contains(x["sent"], term))
    s = F.aggregate(rel, F.lit(0.0), lambda a, x: a + x["s"])
    n = F.aggregate(rel, F.lit(0), lambda a, x: a + x["n"])
    label = F.when(term.isNull(), F.lit("")).when(F.size(rel) == 0, F.lit("3")).otherwise(stars(s, n).cast("string"))
    sc = F.when(term.isNull() | (F.size(rel) == 0), F.lit(0.0)).otherwise(score(s, n))
    return j.select(id_col, F.col("slot.rank").alias("rank"), label.alias("label"), sc.alias("score"))
