"""Sources and sinks.

* nested dataset files (a JSON list of crawl results, each a list of articles)
  are read one file per task with ``wholetext`` and flattened with two
  ``posexplode`` calls that keep both ordinals (file order survives);
* flat JSON / JSON Lines / CSV / Parquet readers take explicit schemas;
* snapshots are a ``snapshot_ts`` column, so retention and restore are
  relational filters instead of file copies.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE_DDL = ("id string, headline string, body string, link string, fecha string, "
               "sesgo string, newspaper string")
NESTED_DDL = f"array<array<struct<{ARTICLE_DDL.replace(' string', ': string')}>>>"


def read_nested_dataset(spark: SparkSession, path: str, skip_empty: bool = True) -> DataFrame:
    """(file, outer_pos, inner_pos, article fields...)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", NESTED_DDL).alias("crawls"))
    # H1: an unparsable document must not silently become a null row
    raw = raw.select("file", F.when(F.col("crawls").isNull(), F.raise_error(F.lit("unparsable nested dataset file")))
                     .otherwise(F.col("crawls")).alias("crawls"))
    outer = raw.select("file", F.posexplode("crawls").alias("outer_pos", "articles"))
    if skip_empty:
        outer = outer.filter(F.size("articles") > 0)
    inner = outer.select("file", "outer_pos", F.posexplode("articles").alias("inner_pos", "a"))
    return inner.select("file", F.col("outer_pos").cast("bigint"), F.col("inner_pos").cast("bigint"), "a.*")


def write_nested_dataset(df: DataFrame, path: str, file_col: str, list_col: str, order_col: str) -> None:
    """Write articles as one nested JSON document per ``file_col`` value: an outer
    list per ``list_col`` value (sorted), inner lists ordered by ``order_col``.

    Each inner list is one crawl result (one cover page), so its size is bounded
    by the page, not by the table.
    """
    fields = [c.split(" ")[0] for c in ARTICLE_DDL.split(", ")]
    inner = df.groupBy(file_col, list_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("_o"), F.struct(*fields).alias("a")))).alias("l"))
    inner = inner.select(file_col, list_col, F.transform("l", lambda x: x["a"]).alias("articles"))
    outer = inner.groupBy(file_col).agg(
        F.sort_array(F.collect_list(F.struct(F.col(list_col).alias("_k"), F.col("articles")))).alias("l"))
    doc = outer.select(file_col, F.to_json(F.transform("l", lambda x: x["articles"])).alias("value"))
    doc.repartition(file_col).write.mode("overwrite").partitionBy(file_col).text(path)


def read_flat_json(spark: SparkSession, path: str, ddl: str = ARTICLE_DDL, multiline: bool = True) -> DataFrame:
    """A top-level JSON array (multiLine) or JSON Lines with an explicit schema."""
    return spark.read.schema(ddl).option("multiLine", multiline).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: UTF-8 JSON Lines; non-ASCII characters are written as is."""
    df.write.mode(mode).option("encoding", "UTF-8").json(path)


def read_wide_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Header CSV with quoted multi-line text fields and an explicit schema."""
    return (spark.read.schema(ddl).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def append_stage(df: DataFrame, path: str) -> None:
    """Incremental stage output; readers order by key, not by file."""
    df.write.mode("append").parquet(path)


def append_crawl(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append a crawl once (union by name)."""
    return existing.unionByName(new, allowMissingColumns=True)


def pending_ids(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Only inputs whose key has no stage output yet."""
    return inputs.join(done.select(key), key, "left_anti")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none. Any other failure is raised: taking it for an absent table would
    compute and append everything once more."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_stage_or_compute(spark: SparkSession, path: str, inputs: DataFrame, key: str, compute) -> DataFrame:
    """Compute the stage only for new keys, append, and return the whole stage table."""
    done = read_if_there(spark, path)
    todo = inputs if done is None else pending_ids(inputs, done, key)
    append_stage(compute(todo), path)
    return spark.read.parquet(path)


def with_snapshot(df: DataFrame, ts_col: str = "ts", unit: str = "day") -> DataFrame:
    return df.withColumn("snapshot_ts", F.date_trunc(unit, F.col(ts_col)).cast("date"))


def retained_snapshots(df: DataFrame, keep: int = 3) -> DataFrame:
    """(snapshot_ts, n) of the newest ``keep`` snapshots.

    The rank runs over the per-snapshot aggregate (one row per snapshot), never
    over the rows themselves.
    """
    agg = df.groupBy("snapshot_ts").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.orderBy(F.desc("snapshot_ts"))
    return agg.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= keep).drop("r")


def restore_latest(df: DataFrame) -> DataFrame:
    """Rows of the newest snapshot (scalar subquery for the max)."""
    latest = df.select(F.max("snapshot_ts")).scalar()
    return df.filter(F.col("snapshot_ts") == latest)
