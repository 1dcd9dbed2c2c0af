"""Training sets of a cross-validation (B4-B8, R7, V1): every fold's training rows scaled, balanced and weighted.

The fits of a grid share these sets, so they are built once: ``training`` has the rows that a fit without fold f learns from,
``validation`` those of fold f, both with their features scaled by the mean and deviation of f's training rows. Balancing sees
the training rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions.lexicons import SEED
from newslens.operators.samplers import resample
from newslens.session import materialize

ROWS_PER_TASK = 5000


@dataclass
class FoldSets:
    training: DataFrame  # fold int, id long, x array<double>, label int, weight double
    validation: DataFrame  # fold int, id long, x array<double>, label int
    folds: list[int]
    classes: int
    dim: int
    fallbacks: dict[int, str | None]  # why a fold's training rows were left as they are


def assemble(df: DataFrame, columns: list[str], vec_col: str | None = None) -> DataFrame:
    """x = the numeric columns (null: 0) after the embedding, if any."""
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]) if columns else F.array().cast("array<double>")
    x = numbers if vec_col is None else F.concat(F.col(vec_col).cast("array<double>"), numbers)
    return df.withColumn("x", x)


def _scaling(rows: DataFrame, scaled_from: int) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each component from ``scaled_from`` on; 0 and 1 before that and for constants."""
    s = rows.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s")).first()["s"]
    n = s["count"]
    mean, var = s["mean"].toArray(), s["variance"].toArray() * ((n - 1) / n if n else 0.0)
    sd = [v ** 0.5 if v > 1e-18 else 0.0 for v in var]
    return ([float(m) if i >= scaled_from else 0.0 for i, m in enumerate(mean)],
            [float(d) if i >= scaled_from else 1.0 for i, d in enumerate(sd)])


def _scale(x, mean: list[float], sd: list[float]):
    m, s = F.array(*[F.lit(v) for v in mean]), F.array(*[F.lit(v) for v in sd])
    return F.transform(x, lambda v, i: F.when(F.get(s, i) == 0, F.lit(0.0)).otherwise((v - F.get(m, i)) / F.get(s, i)))


def fold_sets(df: DataFrame, sampler: str = "none", id_col: str = "id", label: str = "label", scaled_from: int = 0, seed: int = SEED,
              shared: dict[int, dict] | None = None) -> FoldSets:
    """df: id, x array<double>, label (0 to classes - 1), fold. Components before ``scaled_from`` (an embedding) stay as they are.
    ``shared``: a dict for the calls with the same rows and another sampler; what samplers have in common is made once a fold."""
    rows = materialize(df.select(F.col(id_col).cast("long").alias("id"), "x", F.col(label).cast("int").alias("label"), F.col("fold").cast("int").alias("fold")))
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
    shape = rows.agg(F.max("label").alias("top"), F.max(F.size("x")).alias("dim"), F.count("*").alias("n")).first()
    classes, dim = (shape["top"] or 0) + 1, shape["dim"] or 0
    training, validation, reasons = [], [], {}
    for f in folds:
        own = rows.filter(F.col("fold") != f)
        if not own.limit(1).count():
            reasons[f] = "no training rows"
            continue
        mean, sd = _scaling(own, scaled_from)
        balanced, reasons[f] = resample(own.withColumn("x", _scale(F.col("x"), mean, sd)), sampler, "id", "x", "label", seed,
                                        None if shared is None else shared.setdefault(f, {}))
        balanced = balanced.withColumnRenamed("vec", "x")
        # B8, of the rows trained on; one row for each class
        counts = {r.label: r["n"] for r in balanced.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        weight = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, total / (len(counts) * n))])[F.col("label")]
        training.append(balanced.select(F.lit(f).alias("fold"), "id", "x", "label", weight.alias("weight")))
        validation.append(rows.filter(F.col("fold") == f).select("fold", "id", _scale(F.col("x"), mean, sd).alias("x"), "label"))

    def both(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        # a fit reads these rows in hundreds of short jobs: a small table in few tasks
        return materialize(out.coalesce(max(2, shape["n"] * len(folds) // ROWS_PER_TASK)))

    return FoldSets(both(training), both(validation), [f for f in folds if reasons.get(f) != "no training rows"], classes, dim, reasons)
