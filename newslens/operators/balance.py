"""Class rebalancing (R1-R3, R7) and fold assignment (V1-V2).

All sampling is deterministic: rows are ordered by md5('<seed>:<id>'), never by
``rand()``. Ranks come from ``common.hash_rank`` so a dominant class never
funnels into one task. Per-class targets are a tiny aggregate (one row per
class), joined by a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions.lexicons import MIX_MAJ_SHARE, MIX_MIN_SHARE, N_FOLDS, SEED
from newslens.operators.common import class_counts, hash_rank, maybe_broadcast


def _resample_to(df: DataFrame, targets: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """Each class to its target count: keep the first ``t`` rows in hash order when
    shrinking; when growing, every row appears t div n times plus one more for the
    first t mod n rows. Output adds ``copy`` (0 = the original row)."""
    r = hash_rank(df, id_col, [label], seed)
    j = r.join(maybe_broadcast(targets), label)
    q = F.floor(F.col("t") / F.col("n"))
    rem = F.col("t") % F.col("n")
    total = F.when(F.col("t") <= F.col("n"), F.when(F.col("hrank") < F.col("t"), 1).otherwise(0)) \
             .otherwise(q + F.when(F.col("hrank") < rem, 1).otherwise(0))
    j = j.withColumn("_k", total.cast("int")).filter(F.col("_k") > 0)
    out = j.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_k") - 1).cast("bigint"))))
    return out.drop("hrank", "t", "n", "_k")


def undersample(df: DataFrame, id_col: str = "doc_id", label: str = "label", seed: int = SEED) -> DataFrame:
    """Every class down to the smallest class count."""
    c = class_counts(df, label)
    m = c.select(F.min("n")).scalar()
    return _resample_to(df, c.withColumn("t", m), id_col, label, seed)


def oversample(df: DataFrame, id_col: str = "doc_id", label: str = "label", seed: int = SEED,
               target: int | None = None) -> DataFrame:
    """R2: every class up to ``target`` (default: the largest class count); larger classes stay."""
    c = class_counts(df, label)
    t = F.lit(target) if target is not None else c.select(F.max("n")).scalar()
    return _resample_to(df, c.withColumn("t", F.greatest(F.col("n"), t)), id_col, label, seed)


def mixed_balance(df: DataFrame, id_col: str = "doc_id", label: str = "label", seed: int = SEED,
                  maj_share: float = MIX_MAJ_SHARE, min_share: float = MIX_MIN_SHARE) -> DataFrame:
    """Minority up to int(min_share * n_maj) (never down, Q18), majority down to
    int(maj_share * n_maj); any class in between is left alone (3-class case)."""
    c = class_counts(df, label)
    n_maj = c.select(F.max("n")).scalar()
    n_min = c.select(F.min("n")).scalar()
    up = F.floor(n_maj * F.lit(min_share)).cast("bigint")
    down = F.floor(n_maj * F.lit(maj_share)).cast("bigint")
    t = (F.when(F.col("n") == n_maj, down)
         .when(F.col("n") == n_min, F.greatest(F.col("n"), up))
         .otherwise(F.col("n")))
    return _resample_to(df, c.withColumn("t", t), id_col, label, seed)


def balance_or_passthrough(df: DataFrame, balancer, label: str = "label", **kw) -> DataFrame:
    """Fall back to the unbalanced data when there is one class or the result is empty."""
    n_classes = df.select(F.count_distinct(label)).first()[0]
    if n_classes < 2:
        return df.withColumn("copy", F.lit(0).cast("bigint"))
    out = balancer(df, label=label, **kw)
    return out if out.limit(1).count() else df.withColumn("copy", F.lit(0).cast("bigint"))


def stratified_folds(df: DataFrame, id_col: str = "doc_id", label: str = "label", k: int = N_FOLDS,
                     seed: int = SEED) -> DataFrame:
    """V1: fold = (rank inside the class in hash order) mod k - class shares equal per fold."""
    r = hash_rank(df, id_col, [label], seed)
    return r.withColumn("fold", (F.col("hrank") % k).cast("int")).drop("hrank")


def folds(df: DataFrame, id_col: str = "doc_id", k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """V2: fold = (global rank in hash order) mod k."""
    r = hash_rank(df, id_col, [], seed)
    return r.withColumn("fold", (F.col("hrank") % k).cast("int")).drop("hrank")
