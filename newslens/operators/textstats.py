"""Per-text statistics (F1-F15): one row in, one row out.

Everything except the part-of-speech map is a narrow projection built from
regex and higher-order functions: no shuffle, no Python. The POS map (F12) is
an explode + aggregate keyed on the document id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions import text as T
from newslens.functions.lexicons import POS_LOOKUP, spanish_stop_words
from newslens.operators.common import maybe_broadcast

BASE_COUNTS = (
    "total_words", "total_sentences", "total_paragraphs", "total_characters",
    "total_mayus", "total_interrogations", "total_exclamations",
)


def with_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """tokens, sentences and identity lemmas as array columns."""
    return df.withColumn("tokens", T.tokens(text_col)).withColumn("sentences", T.sentences(text_col))


def text_stats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", paragraph_sep: str = "\n\n",
               stop_words=None) -> DataFrame:
    """The 25 base fields of the feature record."""
    stop = list(stop_words or spanish_stop_words())
    t = F.col(text_col)
    toks = T.tokens(t)
    base = df.select(
        F.col(id_col),
        F.size(toks).cast("bigint").alias("total_words"),
        F.size(T.sentences(t)).cast("bigint").alias("total_sentences"),
        T.paragraph_count(t, paragraph_sep).alias("total_paragraphs"),
        F.length(t).cast("bigint").alias("total_characters"),
        T.count_re(t, T.UPPER_RE).alias("total_mayus"),
        T.count_re(t, T.QUESTION_RE).alias("total_interrogations"),
        T.count_re(t, T.EXCLAIM_RE).alias("total_exclamations"),
        F.size(F.filter(toks, lambda w: F.lower(w).isin(stop))).cast("bigint").alias("total_stopwords"),
        F.size(F.array_distinct(T.filtered_lemmas(toks, stop))).cast("bigint").alias("unique_lemmatized_words"),
    )
    c = F.col
    return base.select(
        id_col,
        *[x for name in BASE_COUNTS for x in (c(name), T.log1p(c(name)).alias(f"{name}_log"))],
        T.safe_div(c("total_characters"), c("total_words")).alias("char_per_word_ratio"),
        T.safe_div(c("total_characters"), c("total_sentences")).alias("char_per_sentence_ratio"),
        T.safe_div(c("total_words"), c("total_sentences")).alias("word_per_sentence_ratio"),
        T.safe_div(c("total_characters"), c("total_paragraphs")).alias("char_per_paragraph_ratio"),
        T.safe_div(c("total_sentences"), c("total_paragraphs")).alias("sentences_per_paragraph_ratio"),
        T.safe_div(c("total_words"), c("total_paragraphs")).alias("word_per_paragraph_ratio"),
        "total_stopwords",
        T.log1p(c("total_stopwords")).alias("total_stopwords_log"),
        "unique_lemmatized_words",
        T.log1p(c("unique_lemmatized_words")).alias("unique_lemmatized_words_log"),
        T.safe_div(c("unique_lemmatized_words"), c("total_words")).alias("unique_lemmatized_words_ratio"),
    )


def token_summary(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """F1 summary: number of tokens and of distinct tokens."""
    toks = T.tokens(text_col)
    return df.select(
        id_col,
        F.size(toks).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(toks)).cast("bigint").alias("n_distinct"),
    )


def stopword_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", stop_words=None) -> DataFrame:
    """F7."""
    stop = list(stop_words or spanish_stop_words())
    return df.select(
        id_col,
        F.size(F.filter(T.tokens(text_col), lambda w: F.lower(w).isin(stop))).cast("bigint").alias("total_stopwords"),
    )


def lemma_stats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", stop_words=None) -> DataFrame:
    """Filtered lemmas, distinct count and its ratio to words."""
    toks = T.tokens(text_col)
    lem = T.filtered_lemmas(toks, stop_words)
    uniq = F.size(F.array_distinct(lem)).cast("bigint")
    return df.select(
        id_col,
        F.size(lem).cast("bigint").alias("n_filtered"),
        uniq.alias("unique_lemmatized_words"),
        T.safe_div(uniq, F.size(toks)).alias("ratio"),
    )


def ratios(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """the six ratios, 0.0 on a zero denominator."""
    s = text_stats(df, text_col, id_col)
    return s.select(id_col, "char_per_word_ratio", "char_per_sentence_ratio", "word_per_sentence_ratio",
                    "char_per_paragraph_ratio", "sentences_per_paragraph_ratio", "word_per_paragraph_ratio")


def pos_lookup_df(spark, lookup=POS_LOOKUP) -> DataFrame:
    # First entry wins for a repeated form.
    seen, rows = set(), []
    for form, tag in lookup:
        if form not in seen:
            seen.add(form)
            rows.append((form, tag))
    return spark.createDataFrame(rows, "form string, upos string")


def pos_tags(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lookup=POS_LOOKUP) -> DataFrame:
    """Rule tagger (token -> UPOS): closed-class lookup, NUM, PUNCT, else X.

    The fixed lookup table is small, so it is broadcast; a caller's own only if its count allows it.
    """
    lk = pos_lookup_df(df.sparkSession, lookup)
    lk = F.broadcast(lk) if lookup is POS_LOOKUP else maybe_broadcast(lk)
    toks = df.select(F.col(id_col), F.posexplode(T.tokens(text_col)).alias("pos", "token"))
    tagged = toks.join(lk, F.lower(toks["token"]) == lk["form"], "left")
    upos = (
        F.when(F.col("upos").isNotNull(), F.col("upos"))
        .when(F.col("token").rlike(r"^\p{N}+$"), F.lit("NUM"))
        .when(~F.col("token").rlike(r"[\p{L}\p{N}_]"), F.lit("PUNCT"))
        .otherwise(F.lit("X"))
    )
    return tagged.select(id_col, "pos", "token", upos.alias("upos"))


def pos_stats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lookup=POS_LOOKUP) -> DataFrame:
    """per tag count, ratio to words, ratio to sentences, ln(count+1) - long form."""
    totals = df.select(
        F.col(id_col),
        F.size(T.tokens(text_col)).alias("tw"),
        F.size(T.sentences(text_col)).alias("ts"),
    )
    counts = pos_tags(df, text_col, id_col, lookup).groupBy(id_col, F.col("upos").alias("tag")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    j = counts.join(totals, id_col)
    return j.select(
        id_col, "tag", "count",
        T.safe_div(F.col("count"), F.col("tw")).alias("ratio_words"),
        T.safe_div(F.col("count"), F.col("ts")).alias("ratio_sentences"),
        T.log1p(F.col("count")).alias("count_log"),
    )


def pos_map(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", lookup=POS_LOOKUP) -> DataFrame:
    """F12 as the record's ``map<tag, struct>`` column."""
    long = pos_stats(df, text_col, id_col, lookup)
    return long.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "tag", F.struct("count", "ratio_words", "ratio_sentences", "count_log")))).alias("pos"))


def readability(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fernandez-Huerta, Szigriszt-Pazos and Gutierrez-Polini on alphabetic words."""
    # words as a column of its own: three expressions read them, and each would cut the text again
    cut = df.select(F.col(id_col), F.filter(T.word_tokens(text_col), lambda w: w.rlike(T.ALPHA_RE)).alias("words"),
                    F.size(T.sentences(text_col)).cast("double").alias("s"))
    words = F.col("words")
    base = cut.select(
        F.col(id_col),
        F.size(words).cast("double").alias("w"),
        "s",
        T.syllables(words).cast("double").alias("syl"),
        F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w).cast("bigint")).cast("double").alias("let"),
    )
    spw = T.safe_div(F.col("syl"), F.col("w"))
    wps = T.safe_div(F.col("w"), F.col("s"))
    lpw = T.safe_div(F.col("let"), F.col("w"))
    has = (F.col("w") > 0) & (F.col("s") > 0)
    zero = F.lit(0.0)
    return base.select(
        id_col,
        F.when(has, F.lit(206.84) - 60.0 * spw - 1.02 * wps).otherwise(zero).alias("fernandez_huerta"),
        F.when(has, F.lit(206.835) - 62.3 * spw - wps).otherwise(zero).alias("szigriszt_pazos"),
        F.when(has, F.lit(95.2) - 9.7 * lpw - 0.35 * wps).otherwise(zero).alias("gutierrez_polini"),
    )
