"""Streaming queries (Q-S1 .. Q-S4)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from newslens.plans.registry import finish, query
from newslens.plans.text_q import BASE_CTE, COUNTS, RATIO_SQL, _counts_sql, _ratios_sql
from newslens.session import scratch_path
from newslens.sources.tables import documents, table
from newslens.streaming import features as SF

#: Partitions of the table in a request file, and bytes of its row groups, by which it is split.
PARTITIONS_A_FILE, ROW_GROUP = 4, 8 << 20


@query("stream_features", f"WITH {BASE_CTE} SELECT doc_id AS id, {_counts_sql()}, {_ratios_sql()} FROM b")
def stream_features(spark, sf):
    """Documents arrive as request files; the stream featurises them micro-batch by micro-batch."""
    base = scratch_path(spark, "stream")
    src = os.path.join(base, "requests")
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    # a request file for a few partitions of a large table, so that a micro-batch of files has work for all cores; each can be split
    parts, cores = docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    docs.coalesce(max(min(parts, cores), -(-parts // PARTITIONS_A_FILE))).write.option("parquet.block.size", ROW_GROUP).parquet(src)
    SF.run_feature_stream(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"), max_files_per_trigger=4)
    r = SF.latest_results(spark, os.path.join(base, "out"))
    return finish(r.select("id", *[x for c in COUNTS for x in (c, f"{c}_log")], *RATIO_SQL))


@query("stream_lookup", """
WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
           FROM events)
SELECT user_id, event_id FROM l WHERE rn = 1 AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def stream_lookup(spark, sf):
    ev = table(spark, sf, "events")
    latest = SF.latest_per_key(ev)
    requested = ev.filter(F.col("event_type") == "error").select(F.col("user_id"))
    return SF.lookup(latest, requested, "user_id").select("user_id", "event_id")
