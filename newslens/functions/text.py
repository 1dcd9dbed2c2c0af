"""Column expressions for text work.

All of them are built-in Spark expressions (regex + higher-order functions), so
they stay inside whole-stage codegen and run on each row without a shuffle.
The patterns are also valid RE2, so the DuckDB oracle uses the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.functions.lexicons import spanish_stop_words

# --- fixed values: tokenisation patterns ----------------------------------------------
# A token is a run of word characters or a single other non-space character
# (punctuation counts as a word).
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
WORD_RE = r"[\p{L}\p{N}_]+"
# A sentence is a run without terminal marks or newlines plus its terminal marks.
SENTENCE_RE = r"[^.!?…\n]+[.!?…]*"
ALPHA_RE = r"^\p{L}+$"
UPPER_RE = r"\p{Lu}"
QUESTION_RE = r"[?¿]"
EXCLAIM_RE = r"[!¡]"
# Spanish vowel nucleus used for the syllable count (our own documented rule).
VOWEL_GROUP_RE = r"[aeiouáéíóúü]+"
# Entity candidate: a run of capitalised words.
ENTITY_RE = r"\p{Lu}[\p{L}\p{N}_]*(?:[ ]+\p{Lu}[\p{L}\p{N}_]*)*"
# --- end fixed values ----------------------------------------------------------------


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    return F.regexp_extract_all(col_(text), F.lit(TOKEN_RE), 0)


def word_tokens(text) -> Column:
    return F.regexp_extract_all(col_(text), F.lit(WORD_RE), 0)


def sentences(text) -> Column:
    raw = F.regexp_extract_all(col_(text), F.lit(SENTENCE_RE), 0)
    return F.filter(raw, lambda s: s.rlike(r"\S"))


def count_re(text, pattern: str) -> Column:
    return F.regexp_count(col_(text), F.lit(pattern)).cast("bigint")


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, 0.0 when b is zero (the reference's guard)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def log1p(c: Column) -> Column:
    return F.log1p(c.cast("double"))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_stop(word: Column, stop_words=None) -> Column:
    return F.lower(word).isin(list(stop_words or spanish_stop_words()))


def paragraph_count(text, sep: str = "\n\n") -> Column:
    """Pieces of the stripped text split on ``sep`` (at least 1)."""
    s = strip_ws(col_(text))
    n_sep = F.length(s) - F.length(F.replace(s, F.lit(sep), F.lit("")))
    return (F.floor(n_sep / F.lit(len(sep))) + 1).cast("bigint")


def filtered_lemmas(toks: Column, stop_words=None) -> Column:
    """Lower-cased tokens (identity lemmatiser) that are alphabetic and not stop words."""
    stop = list(stop_words or spanish_stop_words())
    lem = F.transform(toks, lambda t: F.lower(t))
    return F.filter(lem, lambda t: t.rlike(ALPHA_RE) & ~t.isin(stop))


def syllables(words: Column) -> Column:
    """Sum over words of max(1, vowel groups)."""
    return F.aggregate(
        words,
        F.lit(0).cast("bigint"),
        lambda acc, w: acc + F.greatest(F.lit(1), F.regexp_count(F.lower(w), F.lit(VOWEL_GROUP_RE))).cast("bigint"),
    )


def html_unescape(c: Column) -> Column:
    """Decode the common named/numeric entities (fixed list)."""
    out = c
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def tag_text(fragment: Column) -> Column:
    """Text of an HTML fragment the way ``get_text(strip=True)`` reads it:
    every text node stripped, then concatenated with no separator."""
    pieces = F.split(fragment, r"<[^>]*>")
    return html_unescape(F.array_join(F.transform(pieces, strip_ws), ""))
