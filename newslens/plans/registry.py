"""Registry of named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from newslens.functions.lexicons import spanish_stop_words
from newslens.functions import text as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round6(c):
    """floor(x * 1e6 + 0.5) / 1e6: plain IEEE double arithmetic, so Spark and DuckDB give the same
    result for the same input (their ROUND functions disagree on exact decimal halves)."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.floor(x * 1e6 + 0.5) / 1e6 + F.lit(0.0))


def finish(df: DataFrame) -> DataFrame:
    """Round every floating column to 6 places (and drop -0.0) so both engines print the same value."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(round6(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---- SQL snippets shared by the oracles (same patterns as the Spark side) ----

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stop_list() -> str:
    return ", ".join(sql_str(w) for w in spanish_stop_words())


TOKEN = sql_str(T.TOKEN_RE)
WORD = sql_str(T.WORD_RE)
SENT = sql_str(T.SENTENCE_RE)
ALPHA = sql_str(T.ALPHA_RE)


def sql_tokens(col: str = "text") -> str:
    return f"regexp_extract_all({col}, {TOKEN})"


def sql_sentences(col: str = "text") -> str:
    return f"list_filter(regexp_extract_all({col}, {SENT}), lambda s: regexp_matches(s, '\\S'))"


def sql_lemmas(col: str = "text") -> str:
    return (f"list_filter(list_transform({sql_tokens(col)}, lambda x: lower(x)), "
            f"lambda x: regexp_matches(x, {ALPHA}) AND x NOT IN ({stop_list()}))")


def sql_div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END)"


def r6(x: str) -> str:
    return f"(CASE WHEN isnan(({x})::DOUBLE) THEN ({x})::DOUBLE ELSE floor(({x})::DOUBLE * 1e6 + 0.5) / 1e6 + 0.0 END)"
