"""Result tables of a grid: one row for each parameter set and fold, written so that a rerun replaces its own.

A finished (params, fold) is a partition of the table. Partitions are written by dynamic overwrite, so a job that is killed
and run again leaves each of them once, and a rerun of the grid only fits what is missing. The F1 of every class is kept
beside accuracy and macro F1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.operators import densehead, leafboost
from newslens.operators.folds import FoldSets
from newslens.operators.models import params_key
from newslens.sources.io import read_if_there

ROW = "experiment string, params_key string, fold int, acc double, f1_macro double, f1_class map<int,double>, rounds int, fallback string"


def head_rows(sets: FoldSets, params: list[dict], experiment: str, **options) -> list[tuple]:
    """V3: the dense head on every fold."""
    fits = densehead.train_grid(sets, params, **options)
    return [(experiment, params_key(f.params), f.fold, f.best_acc, max(f.best_f1, 0.0), f.best_classes, f.epochs, sets.fallbacks.get(f.fold)) for f in fits]


def boost_rows(sets: FoldSets, params: list[dict], experiment: str, **options) -> list[tuple]:
    """V4: leaf-limited trees on every fold."""
    fits = leafboost.boost_grid(sets, params, **options)
    judged = leafboost.judge(sets, fits)
    return [(experiment, params_key(f.params), f.fold, *judged.get(i, (0.0, 0.0, {})), len(f.trees), sets.fallbacks.get(f.fold)) for i, f in enumerate(fits)]


def write_results(rows: DataFrame, path: str) -> None:
    """Each (experiment, params_key, fold) replaces its own partition and no other."""
    (rows.repartition("experiment", "params_key", "fold").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("experiment", "params_key", "fold").parquet(path))


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    found = read_if_there(spark, path)
    # names of partitions are read back as whatever they look like
    return None if found is None else found.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], ROW).schema])


def run_grid(spark: SparkSession, make: Callable[[list[dict]], list[tuple]], params: list[dict], experiment: str, folds: list[int],
             path: str | None = None) -> DataFrame:
    """Rows ROW of every parameter set and fold; with ``path`` only those not yet there are fitted, and all are returned."""
    if path is None:
        return spark.createDataFrame(make(params), ROW)
    done = read_results(spark, path)
    kept = set() if done is None else {(r.params_key, r.fold) for r in done.filter(F.col("experiment") == experiment).select("params_key", "fold").collect()}
    todo = [p for p in params if any((params_key(p), f) not in kept for f in folds)]
    if todo:
        write_results(spark.createDataFrame(make(todo), ROW), path)
    return read_results(spark, path).filter(F.col("experiment") == experiment)


def summary(results: DataFrame) -> DataFrame:
    """V7: one row for each (experiment, params_key): means, the deviation of accuracy, the mean F1 of each class, and the
    values of every fold in the order of the folds. A class without rows in a fold counts as absent there."""
    keys = ["experiment", "params_key"]
    def of_folds(c: str):
        return F.transform(F.sort_array(F.collect_list(F.struct("fold", c))), lambda x: x[c])

    # a row for each fold: the lists are as long as there are folds
    in_order = F.array_sort(F.map_entries("f1_class"))
    listed = results.withColumn("f1_classes", F.transform(in_order, lambda e: e["value"])).withColumn("_entries", in_order)
    out = listed.groupBy(*keys).agg(
        F.avg("acc").alias("mean_acc"), F.stddev_pop("acc").alias("std_acc"), F.avg("f1_macro").alias("mean_f1_macro"),
        of_folds("acc").alias("acc_folds"), of_folds("f1_macro").alias("f1_macro_folds"), of_folds("f1_classes").alias("f1_class_folds"),
        F.flatten(F.filter(of_folds("_entries"), lambda e: e.isNotNull())).alias("_all"))
    out = out.withColumn("_classes", F.sort_array(F.array_distinct(F.transform("_all", lambda e: e["key"]))))

    def mean_of(c):
        own = F.filter("_all", lambda e: e["key"] == c)
        return F.aggregate(own, F.lit(0.0), lambda a, e: a + e["value"]) / F.size(own)

    means = F.when(F.size("_classes") > 0, F.map_from_arrays("_classes", F.transform("_classes", mean_of)))
    return out.withColumn("mean_f1_class", means).drop("_all", "_classes")
