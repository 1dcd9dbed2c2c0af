"""Labels and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions.lexicons import ORIENT_HIGH, ORIENT_LOW
from newslens.operators.clean import fill_numeric_zero


def multi_hot(df: DataFrame, col: str = "bias_type", n_labels: int = 5, strict: bool = False) -> DataFrame:
    """B1: comma list -> label_1..label_n flags.

    strict=True is the reference's exact token match (``"1, 2"`` misses 2,
    ``"1.0"`` misses 1); the default trims and reads ``"1.0"`` as ``"1"`` (Q14).
    """
    parts = F.split(F.coalesce(F.col(col), F.lit("")), ",")
    if not strict:
        parts = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"\.0+$", ""))
    out = df
    for n in range(1, n_labels + 1):
        out = out.withColumn(f"label_{n}", F.array_contains(parts, str(n)).cast("int"))
    return out


def orientation(score) -> F.Column:
    """B2: > 0.5 -> 1, < -0.5 -> 2, else 0 (null stays 0, like the reference's else branch)."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > ORIENT_HIGH, 1).when(s < ORIENT_LOW, 2).otherwise(0).cast("int")


def training_table(df: DataFrame, drop=("idNew", "idPhrase", "embedding"), rename=("bias", "label"),
                   drop_suffix: str = "_X") -> DataFrame:
    """Drop ids, ``*_X`` POS columns and embeddings; rename; numeric nulls -> 0."""
    cols = [c for c in df.columns if c.endswith(drop_suffix)]
    out = df.drop(*drop, *cols)
    if rename and rename[0] in out.columns:
        out = out.withColumnRenamed(*rename)
    return fill_numeric_zero(out)


def feature_columns(df: DataFrame, exclude=("label", "text")) -> list[str]:
    """Every numeric column but the label / text."""
    return [f.name for f in df.schema.fields if f.name not in exclude and f.dataType.typeName() in
            ("integer", "long", "double", "float", "short")]


def standardise(df: DataFrame, cols: list[str], prefix: str = "z_", fit: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population sigma; sigma 0 -> 0.

    The statistics of all columns are one aggregate over ``fit`` (default ``df``;
    pass the training fold to avoid leakage, Q16), read back as one scalar subquery.
    """
    src = fit if fit is not None else df
    of = [(c, F.col(c).cast("double")) for c in cols]
    if not cols:
        return df
    stats = src.select(F.struct(*[F.struct(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd")).alias(c) for c, x in of])).scalar()
    of_col = lambda c, k: F.col("_stats")[c][k]
    scaled = {prefix + c: F.when(of_col(c, "sd") == 0, F.lit(0.0)).otherwise((F.col(c) - of_col(c, "mu")) / of_col(c, "sd")) for c in cols}
    return df.withColumn("_stats", stats).withColumns(scaled).drop("_stats")


def dummy_feature(df: DataFrame, name: str = "dummy") -> DataFrame:
    """A constant feature for the embedding-only feature set."""
    return df.withColumn(name, F.lit(0.0))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = c.select(F.sum("n_c")).scalar()
    k = c.select(F.count(F.lit(1))).scalar()
    return c.select(label, (n / (k * F.col("n_c"))).alias("weight"))
