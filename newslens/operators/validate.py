"""Metrics, cross-validation summaries and grid bookkeeping (V5-V8).

Metrics come from confusion counts: every row emits its contribution to the
true class (tp or fn) and, when wrong, to the predicted class (fp); one
aggregate with map-side combine gives per-class tp/fp/fn. Macro F1 is the
plain mean over the union of true and predicted classes (MLlib's ``f1`` is the
weighted one, so it is not used).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """(by..., class, tp, fp, fn, n)."""
    by = by or []
    hit = F.col(label) == F.col(pred)
    contrib = F.array(
        F.struct(F.col(label).alias("class"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"),
                 (~hit).cast("int").alias("fn"), F.lit(1).alias("n")),
        F.struct(F.col(pred).alias("class"), F.lit(0).alias("tp"), (~hit).cast("int").alias("fp"),
                 F.lit(0).alias("fn"), F.lit(0).alias("n")),
    )
    e = df.select(*by, F.explode(contrib).alias("c"))
    return e.groupBy(*by, F.col("c.class").alias("class")).agg(
        *[F.sum(f"c.{m}").cast("bigint").alias(m) for m in ("tp", "fp", "fn", "n")])


def f1(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> F.Column:
    den = 2 * F.col(tp) + F.col(fp) + F.col(fn)
    return F.when(den == 0, F.lit(0.0)).otherwise(2.0 * F.col(tp) / den)


def per_class_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """V6: per class tp, fp, fn, f1."""
    return confusion(df, label, pred, by).withColumn("f1", f1())


def summary_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """V6: accuracy and macro F1 (per ``by`` group)."""
    by = by or []
    pc = per_class_metrics(df, label, pred, by)
    return pc.groupBy(*by).agg((F.sum("tp") / F.sum("n")).alias("acc"), F.avg("f1").alias("f1_macro"))


def cv_summary(per_fold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """V7: mean / population std of accuracy, mean macro F1, and the raw fold lists."""
    by = by or []
    return per_fold.groupBy(*by).agg(
        F.avg("acc").alias("mean_acc"), F.stddev_pop("acc").alias("std_acc"),
        F.avg("f1_macro").alias("mean_f1_macro"),
        F.sort_array(F.collect_list(F.struct("fold", "acc"))).alias("acc_folds"),
        F.sort_array(F.collect_list(F.struct("fold", "f1_macro"))).alias("f1_folds"))


def pending_grid(folds: DataFrame, params_keys: list[str], finished: DataFrame) -> DataFrame:
    """V5: every (params_key, fold) not yet in the result table."""
    grid = folds.select("fold").distinct().select(
        F.explode(F.array(*[F.lit(k) for k in params_keys])).alias("params_key"), "fold")
    return grid.join(finished.select("params_key", "fold"), ["params_key", "fold"], "left_anti")


def best_params(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """V8: the parameter set with the highest metric (ties -> smallest key)."""
    top = results.select(F.max(metric)).scalar()
    return results.filter(F.col(metric) == top).agg(F.min("params_key").alias("params_key"),
                                                     F.max(metric).alias(metric))
