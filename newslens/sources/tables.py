"""Table access and the fixture mapping onto the article data model."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# --- fixed values: fixture mapping ------------------------------------------------------
# Article date of a synthetic document: 2024-01-01 plus (doc_id mod 30) days.
BASE_DATE = "2024-01-01"
DATE_CYCLE = 30
# --- end fixed values -------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a table whose scan yields fewer partitions than the cluster has cores.

    A large table already scans in many splits (files / row groups), so this is
    a no-op there; a small file of heavy rows (long texts, vectors) would
    otherwise run its per-row regex or NumPy work in one task.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as articles: id, newspaper, headline (first line), body, date."""
    d = documents(spark, sf_dir)
    return article_view(d)


def article_view(d: DataFrame) -> DataFrame:
    first_nl = F.instr(F.col("text"), "\n")
    headline = F.when(first_nl > 0, F.substring_index(F.col("text"), "\n", 1)).otherwise(F.col("text"))
    body = F.when(first_nl > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit(None))
    return d.select(
        "doc_id",
        F.col("source").alias("newspaper"),
        headline.alias("headline"),
        body.alias("body"),
        "text",
        "lang",
        F.date_add(F.lit(BASE_DATE).cast("date"), (F.col("doc_id") % DATE_CYCLE).cast("int")).alias("fecha_dt"),
    )
