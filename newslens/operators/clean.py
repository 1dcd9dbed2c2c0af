"""Cleaning, joining, normalising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: accepted date layouts, tried in order (day first) -----------------------
DATE_FORMATS = (
    "dd/MM/yy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd",
    "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yy HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm[:ss][.SSS][XXX]", "d MMM yyyy", "d MMMM yyyy",
)
# --- end fixed values ----------------------------------------------------------------------


def drop_missing_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Drop null and empty ids."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def dedupe_first(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("file", "outer_pos", "inner_pos")) -> DataFrame:
    """D3: keep the first row per key in the given order.

    ``min_by`` is an aggregate, so a key holding a large share of the rows is
    reduced map-side before the shuffle instead of landing in one window task.
    """
    df = drop_missing_ids(df, key)
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*")


def clean_counts(raw: DataFrame, key: str = "id") -> DataFrame:
    """Number of items before and after cleaning."""
    kept = F.when(F.col(key).isNotNull() & (F.col(key) != ""), F.col(key))
    return raw.agg(F.count(F.lit(1)).cast("bigint").alias("n_before"),
                   F.count_distinct(kept).cast("bigint").alias("n_after"))


def last_wins(lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """DM4: one row per key, the value of the last occurrence."""
    return lookup.groupBy(key).agg(F.max_by(value, order).alias(value))


def lookup_join(left: DataFrame, lookup: DataFrame, left_key: str = "Id", right_key: str = "id",
                value: str = "newspaper", order: str = "ord") -> DataFrame:
    """Left join adding ``value`` by id (missing -> null, last duplicate wins).

    The right side is reduced to one row per key first; the join strategy is left
    to AQE, which turns it into a broadcast join from the runtime size when small.
    """
    r = last_wins(lookup, right_key, value, order).withColumnRenamed(right_key, "_rk")
    return left.join(r, left[left_key] == r["_rk"], "left").drop("_rk")


def exclude_sources(df: DataFrame, sources=("EL MUNDO",), col: str = "newspaper") -> DataFrame:
    """Drop rows of the given sources; nulls are kept (pandas ``!=`` semantics)."""
    cond = F.lit(True)
    for s in sources:
        cond = cond & ~F.col(col).eqNullSafe(F.lit(s))
    return df.filter(cond)


def build_text(df: DataFrame, headline: str = "headline", body: str = "body") -> DataFrame:
    """Lower-cased headline + ' ' + body, null-safe."""
    return df.withColumn("texto", F.lower(F.concat(F.coalesce(F.col(headline), F.lit("")), F.lit(" "),
                                                   F.coalesce(F.col(body), F.lit("")))))


def parse_timestamps(col: str, formats=DATE_FORMATS) -> F.Column:
    """D8 with the time of day: first format that parses (ISO stays ISO; day-first otherwise)."""
    return F.coalesce(*[F.try_to_timestamp(F.col(col), F.lit(f)) for f in formats])


def parse_dates(col: str, formats=DATE_FORMATS) -> F.Column:
    """The day alone."""
    return parse_timestamps(col, formats).cast("date")


def truncate(col: str, n: int = 512) -> F.Column:
    """D9."""
    return F.substring(F.col(col), 1, n)


def drop_if_present(df: DataFrame, *names: str) -> DataFrame:
    """``drop`` ignores missing names."""
    return df.drop(*names)


def fill_numeric_zero(df: DataFrame) -> DataFrame:
    """Numeric nulls -> 0 (strings are left alone, see quirk Q15)."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in
           ("integer", "long", "double", "float", "short", "decimal", "byte")]
    return df.fillna(0, subset=num) if num else df
