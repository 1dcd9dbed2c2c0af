"""Per-document topics.

Each text is its own one-document corpus, so the TF-IDF of the reference
reduces to L2-normalised term counts (idf = 1). The whole family is therefore
relational: explode the filtered lemmas, count per (doc, term), rank.

Partitioning: the input is hash-partitioned on the id once
(``by_doc``), into as many parts as the texts are long; the term aggregate, the rank windows and the joins back to the
document all require a distribution on the id that this one exchange already
satisfies, so the family costs a single shuffle of (id, lemma array). With a
documents table bucketed on the id even that exchange disappears.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslens.functions import text as T
from newslens.functions.lexicons import TOPIC_CELLS, TOPIC_VOCAB_CAP, TOPICS_TOP


#: Bytes of text in a part: its terms are counted, sorted and ranked in one task's memory.
PART_BYTES = 8 << 20


def by_doc(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dealt by id. A given number of parts: by default they would be merged by the size of the texts as shuffled, a fraction
    of what their exploded terms take."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return df.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES)), id_col)


def topic_terms(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                cap: int = TOPIC_VOCAB_CAP, stop_words=None) -> DataFrame:
    """(id, term, tf, vr) - the at most ``cap`` most frequent filtered lemmas of >= 2 characters.

    Ties on tf are broken by term ascending.
    """
    lem = T.filtered_lemmas(T.tokens(text_col), stop_words)
    lem = F.filter(lem, lambda x: F.length(x) >= 2)
    ex = df.select(F.col(id_col), F.explode(lem).alias("term"))
    tf = ex.groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("bigint").alias("tf"))
    w = Window.partitionBy(id_col).orderBy(F.desc("tf"), F.asc("term"))
    return tf.withColumn("vr", F.row_number().over(w)).filter(F.col("vr") <= cap)


def topic_scores(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """score = tf / sqrt(sum tf^2) over the kept vocabulary."""
    w = Window.partitionBy(id_col)
    return terms.withColumn("score", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w)))


def top_topics(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = TOPICS_TOP,
               stop_words=None) -> DataFrame:
    """(id, rank, term, tf, score); highest score first, equal scores -> later term first."""
    scored = topic_scores(topic_terms(df, text_col, id_col, stop_words=stop_words), id_col)
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), F.desc("term"))
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(id_col, F.col("rank").cast("bigint").alias("rank"), "term", "tf", "score"))


def topic_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = TOPICS_TOP,
                 stop_words=None) -> DataFrame:
    """T4: per topic slot 1..k: whole-word case-insensitive count in the raw text, its
    ratio to the words, the score and ln(count+1); empty slots are zero.

    The count runs as a higher-order function over the document's own word array,
    so it needs no join of tokens against topics.
    """
    tops = top_topics(df, text_col, id_col, k, stop_words)
    per_doc = tops.groupBy(id_col).agg(F.collect_list(F.struct("rank", "term", "score")).alias("tops"))
    docs = df.select(F.col(id_col), F.transform(T.word_tokens(text_col), lambda w: F.lower(w)).alias("words"),
                     F.size(T.tokens(text_col)).alias("tw"))
    j = docs.join(per_doc, id_col, "left")
    slots = F.sequence(F.lit(1), F.lit(k))
    j = j.select(id_col, "words", "tw", F.explode(F.transform(slots, lambda r: F.struct(
        r.cast("bigint").alias("rank"),
        F.get(F.filter(F.coalesce(F.col("tops"), F.array().cast("array<struct<rank:bigint,term:string,score:double>>")),
                       lambda t: t["rank"] == r), 0).alias("t")))).alias("slot"))
    term = F.col("slot.t.term")
    cnt = F.when(term.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.col("words"), lambda w: w == term))).cast("bigint")
    return j.select(
        id_col, F.col("slot.rank").alias("rank"), cnt.alias("cnt"),
        T.safe_div(cnt, F.col("tw")).alias("ratio_words"),
        F.coalesce(F.col("slot.t.score"), F.lit(0.0)).alias("score"),
        T.log1p(cnt).alias("cnt_log"),
    )


def topic_cells(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", stop_words=None) -> DataFrame:
    """T5: the first three cells of the TF-IDF matrix of the top-3 topic names.

    Every name is one distinct single-term document, so row i of the matrix is
    the unit vector at the alphabetical position of name i; the cells are the
    row-major prefix of that permutation matrix.
    """
    tops = top_topics(df, text_col, id_col, TOPIC_CELLS, stop_words)
    per_doc = tops.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    ids = df.select(id_col)
    j = ids.join(per_doc, id_col, "left").withColumn("t", F.coalesce(
        "t", F.array().cast("array<struct<rank:bigint,term:string>>")))
    names = F.transform(F.col("t"), lambda x: x["term"])
    alpha = F.array_sort(names)
    n = F.size(names)
    # row-major cells of an n x n permutation matrix P[i][pos(name_i)]
    def cell(c: int):
        row = F.floor(F.lit(c) / n).cast("int")
        colj = (F.lit(c) % n).cast("int")
        name_i = F.element_at(names, row + 1)
        return F.when((n == 0) | (row >= n), F.lit(0.0)).otherwise(
            F.when(F.element_at(alpha, colj + 1) == name_i, F.lit(1.0)).otherwise(F.lit(0.0)))
    return j.select(id_col, cell(0).alias("c1"), cell(1).alias("c2"), cell(2).alias("c3"))


def topic_awareness(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", stop_words=None) -> DataFrame:
    """1 / (1 + H) of the vocabulary-term shares, 0 when H is 0 or there is no term."""
    terms = topic_terms(df, text_col, id_col, stop_words=stop_words)
    w = Window.partitionBy(id_col)
    p = terms.withColumn("p", F.col("tf") / F.sum("tf").over(w))
    h = p.groupBy(id_col).agg(F.sum(-F.col("p") * F.ln(F.col("p"))).alias("h"))
    ids = df.select(id_col)
    j = ids.join(h, id_col, "left")
    hh = F.coalesce(F.col("h"), F.lit(0.0))
    return j.select(id_col, F.when(hh != 0, 1.0 / (1.0 + hh)).otherwise(F.lit(0.0)).alias("topic_awareness"))
