"""Helpers shared by the training-data operators: staged tables, Arrow batch slicing, packed closures."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.session import ensure_checkpoint_dir


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows are whole texts, so Spark's 10,000 of them in one Arrow batch would fill a worker's memory.
TEXTS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in small batches, unless it has a setting of its own."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(TEXTS_PER_BATCH))


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str | Column) -> DataFrame:
    """The named columns of one given table; other columns, whatever their names, never enter a plan."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder of spark.checkpoint.dir and read it back.

    Cuts lineage like a checkpoint, but columnar: later readers prune columns, and a lost executor only costs a
    re-read. The folder's owner decides how long such tables stay.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose ``column`` holds about ``max_bytes``; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
    release()


def release() -> None:
    """Give back what a worker no longer uses: it is kept for other tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(pc.cast(column, pa.binary()), b"").to_pylist()


def as_text(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def most_frequent(df: DataFrame, key: str, count: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the rows with the highest counts, ``most`` at most: all rows above the lowest step of the count,
    in quarters of powers of two, that leaves no more. What reaches the driver is bounded by ``most``."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 4)
    steps = df.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, held = None, 0
    for row in sorted(steps, key=lambda r: -r.step):
        held += row.n
        if held > most:
            break
        least = row.step
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = df.where(step >= least).select(F.col(key).cast("bigint"), F.col(count).cast("bigint")).toArrow()
    return rows.column(0).to_numpy(), rows.column(1).to_numpy()


class IntTable:
    """A fixed map from 64-bit keys to int values, looked up for whole arrays at once (open addressing)."""

    def __init__(self, keys, values, missing: int = -1):
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, missing, np.int64)
        self.used, self.missing = np.zeros(size, bool), missing
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[~self.used[slot[todo]]]
            _, first = np.unique(slot[free], return_index=True)  # one key takes a slot, the others go on
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]], self.used[slot[put]] = keys[put], values[put], True
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, ``missing`` for keys not in the table."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], self.missing)
        todo = np.flatnonzero((self.keys[slot] != keys) & self.used[slot])
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.used) - 1)
            at = slot[todo]
            hit = self.used[at] & (self.keys[at] == keys[todo])
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[self.used[at] & ~hit]
        return out
