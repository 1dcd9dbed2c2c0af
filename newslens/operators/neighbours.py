"""Neighbour-based resampling (R4-R6, E5): SMOTE, Tomek links, edited nearest
neighbours and nearest-original lookup, all on the exact k-NN join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.functions.lexicons import SEED
from newslens.operators.common import class_counts, hash_rank, maybe_broadcast
from newslens.operators.knn import knn
from newslens.session import ensure_checkpoint_dir, materialize


def _u01(*cols) -> F.Column:
    """Deterministic uniform [0, 1) from a hash of the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 31)).cast("double") / float(1 << 31)


def smote(df: DataFrame, id_col: str = "id", vec_col: str = "vec", label: str = "label", k: int = 5,
          seed: int = SEED, target: int | None = None) -> DataFrame:
    """Synthetic rows for every class below the majority (or ``target``).

    Parent rows are taken in hash order, round-robin, until the class reaches
    the target; each synthetic row interpolates x + u (nn - x) toward one of the
    parent's k_c = min(k, n_c - 1) nearest same-class rows (k_c >= 1), with the
    neighbour and u drawn from hashes. Output: (parent_id, nn_id, label, u, vec).
    """
    counts = class_counts(df, label)
    t = F.lit(target) if target is not None else counts.select(F.max("n")).scalar()
    goals = counts.withColumn("need", F.greatest(t - F.col("n"), F.lit(0))) \
                  .withColumn("kc", F.least(F.lit(k), F.col("n") - 1)).filter((F.col("need") > 0) & (F.col("kc") >= 1))
    goals = maybe_broadcast(goals)
    minority = df.join(goals.select(label), label, "left_semi")
    ranked = hash_rank(minority.select(id_col, label), id_col, [label], seed).join(goals, label)
    per_parent = (F.floor(F.col("need") / F.col("n")) + F.when(F.col("hrank") < F.col("need") % F.col("n"), 1).otherwise(0))
    samples = ranked.withColumn("_m", per_parent.cast("int")).filter(F.col("_m") > 0).select(
        F.col(id_col).alias("parent_id"), label, "kc", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("s"))
    samples = samples.withColumn("pick", (F.pmod(F.xxhash64(F.lit(seed), "parent_id", "s"), F.col("kc")) + 1).cast("bigint"))
    nn = knn(minority, k=k, id_col=id_col, vec_col=vec_col, metric="euclidean", group_col=label, seed=seed)
    j = samples.join(nn.select(F.col("qid").alias("parent_id"), F.col("rank").alias("pick"), "nn_id"), ["parent_id", "pick"])
    vecs = df.select(F.col(id_col).alias("_vid"), F.col(vec_col).cast("array<double>").alias("_v"))
    j = j.join(vecs.withColumnRenamed("_vid", "parent_id").withColumnRenamed("_v", "_pv"), "parent_id") \
         .join(vecs.withColumnRenamed("_vid", "nn_id").withColumnRenamed("_v", "_nv"), "nn_id")
    u = _u01(F.lit(seed + 1), "parent_id", "s")
    return j.withColumn("u", u).select(
        "parent_id", "nn_id", label, "u", F.zip_with("_pv", "_nv", lambda x, y: x + F.col("u") * (y - x)).alias("vec"))


#: Neighbours that the edited nearest neighbours ask.
ENN_K = 3


def tomek_keep(df: DataFrame, id_col: str = "id", vec_col: str = "vec", label: str = "label", nn: DataFrame | None = None) -> DataFrame:
    """R5 Tomek: drop both ends of every pair that are mutual nearest neighbours with different labels. ``nn``: neighbours
    (qid, rank, nn_id) of the rows, if they are known, one at least."""
    nn = knn(df, k=1, id_col=id_col, vec_col=vec_col, metric="euclidean") if nn is None else nn
    nn = nn.filter(F.col("rank") == 1).select("qid", "nn_id")
    lab = df.select(F.col(id_col).alias("_i"), F.col(label).alias("_l"))
    mutual = nn.alias("a").join(nn.alias("b"), (F.col("a.qid") == F.col("b.nn_id")) & (F.col("a.nn_id") == F.col("b.qid")))
    m = mutual.select(F.col("a.qid").alias("x"), F.col("a.nn_id").alias("y"))
    m = m.join(lab.withColumnRenamed("_i", "x").withColumnRenamed("_l", "lx"), "x") \
         .join(lab.withColumnRenamed("_i", "y").withColumnRenamed("_l", "ly"), "y").filter(F.col("lx") != F.col("ly"))
    return df.join(m.select(F.col("x").alias(id_col)), id_col, "left_anti")


def enn_keep(df: DataFrame, id_col: str = "id", vec_col: str = "vec", label: str = "label", k: int = ENN_K,
             nn: DataFrame | None = None) -> DataFrame:
    """R5 ENN: keep a row only when all of its k nearest neighbours share its label. ``nn``: neighbours (qid, rank, nn_id) of
    the rows, if they are known, k at least."""
    nn = knn(df, k=k, id_col=id_col, vec_col=vec_col, metric="euclidean") if nn is None else nn
    nn = nn.filter(F.col("rank") <= k).select("qid", "nn_id")
    lab = df.select(F.col(id_col).alias("nn_id"), F.col(label).alias("_nl"))
    own = df.select(F.col(id_col).alias("qid"), F.col(label).alias("_ql"))
    agree = nn.join(lab, "nn_id").join(own, "qid").groupBy("qid").agg(
        F.bool_and(F.col("_nl") == F.col("_ql")).alias("ok"))
    return df.join(agree.filter("ok").select(F.col("qid").alias(id_col)), id_col, "left_semi")


def smote_and_clean(df: DataFrame, keep, id_col: str = "id", vec_col: str = "vec", label: str = "label", k: int = 5,
                    seed: int = SEED, shared: dict | None = None) -> DataFrame:
    """R4 + R5: the rows and their SMOTE rows together, cleaned by ``keep`` (``tomek_keep`` or ``enn_keep``). A dict ``shared``
    keeps both, and their neighbours, for another call with the same rows and seed and another ``keep``.

    Output: (key, id_col, parent_id, label, vec_col); a SMOTE row has a parent_id and a null id. ``key`` is the id of a given
    row and numbers the SMOTE rows beyond the largest id; it is fixed by the checkpoint.
    """
    if shared:
        return keep(shared["both"], id_col="key", vec_col=vec_col, label=label, nn=shared["nn"])
    made = smote(df, id_col, vec_col, label, k, seed)
    given = df.select(F.col(id_col).cast("bigint").alias("key"), id_col, F.lit(None).cast(df.schema[id_col].dataType).alias("parent_id"),
                      label, F.col(vec_col).cast("array<double>").alias(vec_col))
    largest = df.select(F.max(F.col(id_col).cast("bigint"))).scalar()
    added = made.select((largest + 1 + F.monotonically_increasing_id()).alias("key"), F.lit(None).cast(df.schema[id_col].dataType).alias(id_col),
                        "parent_id", label, F.col("vec").alias(vec_col))
    ensure_checkpoint_dir(df.sparkSession)
    both = materialize(given.unionByName(added))  # read several times by the k-NN
    if shared is None:
        return keep(both, id_col="key", vec_col=vec_col, label=label)
    shared |= {"both": both, "nn": materialize(knn(both, k=ENN_K, id_col="key", vec_col=vec_col, metric="euclidean"))}
    return keep(both, id_col="key", vec_col=vec_col, label=label, nn=shared["nn"])


def nearest_original(synthetic: DataFrame, originals: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, orig_id) - the nearest original row (Euclidean) of each synthetic row."""
    nn = knn(synthetic, originals, k=1, id_col=id_col, vec_col=vec_col, metric="euclidean", exclude_self=False)
    return nn.select(F.col("qid").alias(id_col), F.col("nn_id").alias("orig_id"))
