"""Shared plan helpers: size-checked broadcast and skew-safe hash ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this many rows a "small" side is joined by shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 100_000
# md5 prefix of 4 hex digits -> 65,536 rank buckets.
RANK_BUCKET_HEX = 4


def maybe_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``small`` only after checking its row count; otherwise leave it to a shuffle join."""
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


def hash_key(id_col: str, seed: int) -> Column:
    """Deterministic sampling key: md5('<seed>:<id>'). The same string orders rows in DuckDB."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def hash_rank(df: DataFrame, id_col: str, group_cols: list[str], seed: int, out: str = "hrank") -> DataFrame:
    """0-based rank of each row inside its group, in (md5 key, id) order.

    Equivalent to ``row_number() over (partition by group order by key, id) - 1``
    but no window spans a whole group: rows are first spread over 16^k buckets
    by the key prefix, per-(group, bucket) counts give each bucket its offset
    (a window over the small count table), and the final window only sorts one
    bucket. A group holding a third of the table is split into 65,536 tasks'
    worth of work instead of one.
    """
    h = hash_key(id_col, seed)
    d = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, RANK_BUCKET_HEX), 16, 10).cast("int"))
    counts = d.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(*group_cols).orderBy("_b") if group_cols else Window.orderBy("_b")
    offs = counts.withColumn("_off", F.sum("_c").over(wo) - F.col("_c")).drop("_c")
    wi = Window.partitionBy(*group_cols, "_b").orderBy("_h", id_col)
    ranked = d.withColumn("_w", F.row_number().over(wi) - 1)
    j = ranked.join(maybe_broadcast(offs), [*group_cols, "_b"])
    return j.withColumn(out, (F.col("_off") + F.col("_w")).cast("bigint")).drop("_h", "_b", "_off", "_w")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
