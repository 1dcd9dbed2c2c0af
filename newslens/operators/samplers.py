"""Balancers by name, with the fallbacks of R7, and estimators that resample what they are fitted to (R1-R7, §2.13).

A balancer takes (id, vec, label) rows and returns rows of the same columns: fewer, repeated or synthetic ones. Ids of repeated
and synthetic rows are fresh and negative, so that ids stay unique; text or other columns of a synthetic row are those of
``parent`` (R6). ``resample`` decides from one aggregate whether a balancer can work at all, and says why if it can't.

``Resampled`` is a ``pyspark.ml`` estimator: it fits another estimator to the resampled rows. In a cross-validation the rows it
is given are those of the training fold, so nothing of a validation fold is repeated or interpolated into the training.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions.lexicons import SEED
from newslens.operators import balance as R
from newslens.operators import neighbours as N
from newslens.session import materialize

COLUMNS = ("id", "vec", "label", "parent")


def _given(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("vec").cast("array<double>").alias("vec"), "label", F.lit(None).cast("long").alias("parent"))


def _copies(df: DataFrame) -> DataFrame:
    """Rows with ``copy``: the first keeps its id, the others point to it and get an id of their own."""
    first = F.col("copy") == 0
    fresh = -1 - (F.pmod(F.xxhash64("id", "copy"), F.lit((1 << 62) - 1)))
    return df.select(F.when(first, F.col("id")).otherwise(fresh).alias("id"), F.col("vec").cast("array<double>").alias("vec"), "label",
                     F.when(~first, F.col("id")).alias("parent"))


def _by_copies(balancer) -> Callable[[DataFrame, int], DataFrame]:
    return lambda df, seed: _copies(balancer(df, id_col="id", label="label", seed=seed))


def _smote(df: DataFrame, seed: int) -> DataFrame:
    made = N.smote(df, id_col="id", vec_col="vec", label="label", seed=seed)
    fresh = -1 - F.pmod(F.xxhash64("parent_id", "nn_id", "u", F.lit(seed)), F.lit((1 << 62) - 1))
    return _given(df).unionByName(made.select(fresh.alias("id"), "vec", "label", F.col("parent_id").alias("parent")))


def _cleaned(keep) -> Callable[[DataFrame, int], DataFrame]:
    def clean(df: DataFrame, seed: int, shared: dict | None = None) -> DataFrame:
        both = N.smote_and_clean(df, keep, id_col="id", vec_col="vec", label="label", seed=seed, shared=shared)
        return both.select(F.coalesce(F.col("id"), -F.col("key")).alias("id"), "vec", "label", F.col("parent_id").alias("parent"))
    return clean


#: name -> (rows (id, vec, label), seed) -> rows COLUMNS
SAMPLERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "none": lambda df, seed: _given(df),
    "undersample": _by_copies(R.undersample),
    "oversample": _by_copies(R.oversample),
    "mixed": _by_copies(R.mixed_balance),
    "smote": _smote,
    "smotetomek": _cleaned(N.tomek_keep),
    "smoteenn": _cleaned(N.enn_keep),
}
#: These interpolate between vectors, which constant features make pointless.
_INTERPOLATING = ("smote", "smotetomek", "smoteenn")
#: These clean the same rows by the same neighbours.
_CLEANING = ("smotetomek", "smoteenn")


def resample(df: DataFrame, name: str, id_col: str = "id", vec_col: str = "vec", label: str = "label", seed: int = SEED,
             shared: dict | None = None) -> tuple[DataFrame, str | None]:
    """(rows COLUMNS, reason): the rows balanced by SAMPLERS[name], or as they are, with the reason (R7): one class,
    constant features, an empty result, a class that vanished, or an error of the balancer. ``shared``: a dict for the calls
    with the same rows and seed, which then interpolate and look for neighbours once."""
    if name not in SAMPLERS:
        raise KeyError(f"no sampler {name!r}; there are {', '.join(SAMPLERS)}")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    if name == "none":
        return _given(rows), None
    shape = rows.agg(F.count_distinct("label").alias("classes"), F.max("vec").alias("most"), F.min("vec").alias("least")).first()
    if shape["classes"] < 2:
        return _given(rows), "one class"
    if name in _INTERPOLATING and shape["most"] == shape["least"]:
        return _given(rows), "constant features"
    try:
        made = SAMPLERS[name](rows, seed, shared=shared) if shared is not None and name in _CLEANING else SAMPLERS[name](rows, seed)
        out = materialize(made.select(*COLUMNS))
        left = out.agg(F.count_distinct("label").alias("classes")).first()["classes"]
    except (PySparkException, ValueError) as e:
        return _given(rows), f"error: {type(e).__name__}"
    if not left:
        return _given(rows), "empty result"
    if left < shape["classes"]:
        return _given(rows), "a class vanished"
    return out, None


class Resampled(Estimator):
    """An estimator fitted to balanced rows: ``Resampled(inner, "smoteenn").fit(df)``; df has id, vec and label columns, and
    ``prepare`` makes from the resampled rows what ``inner`` wants."""

    def __init__(self, inner: Estimator, sampler: str = "none", prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
                 id_col: str = "id", vec_col: str = "vec", label: str = "label", seed: int = SEED):
        super().__init__()
        self.inner, self.sampler, self.prepare = inner, sampler, prepare
        self.columns, self.seed, self.reason = (id_col, vec_col, label), seed, None

    def _fit(self, dataset: DataFrame):
        rows, self.reason = resample(dataset, self.sampler, *self.columns, seed=self.seed)
        return self.inner.fit(self.prepare(rows))
