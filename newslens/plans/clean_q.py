"""Queries for sources/sinks (S*) and cleaning (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.operators import clean as C
from newslens.plans.registry import query
from newslens.session import scratch_path
from newslens.sources import io as IO
from newslens.sources.tables import article_view, documents, table

ART_SQL = """
arts AS (SELECT doc_id, source AS newspaper,
           CASE WHEN instr(text, chr(10)) > 0 THEN split_part(text, chr(10), 1) ELSE text END AS headline,
           CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, length(split_part(text, chr(10), 1)) + 2) END AS body,
           DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS fecha_dt
         FROM documents)"""


def _articles_for_file(spark, sf):
    a = article_view(documents(spark, sf))
    return a.select(
        F.col("doc_id").cast("string").alias("id"), "headline", "body",
        F.concat(F.lit("https://"), F.col("newspaper"), F.lit(".example/"), F.col("doc_id")).alias("link"),
        F.date_format("fecha_dt", "dd/MM/yy").alias("fecha"), F.lit("N").alias("sesgo"), "newspaper",
        F.date_format("fecha_dt", "yyyy-MM-dd").alias("crawl_day"), "doc_id")


@query("s1_nested_json", """
WITH d AS (SELECT doc_id, source, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day FROM documents)
SELECT (dense_rank() OVER (PARTITION BY day ORDER BY source) - 1)::BIGINT AS outer_pos,
       (row_number() OVER (PARTITION BY day, source ORDER BY doc_id) - 1)::BIGINT AS inner_pos,
       CAST(doc_id AS VARCHAR) AS id, source AS newspaper
FROM d""")
def s1_nested_json(spark, sf):
    path = scratch_path(spark, "nested-dataset")
    IO.write_nested_dataset(_articles_for_file(spark, sf), path, "crawl_day", "newspaper", "doc_id")
    return IO.read_nested_dataset(spark, path).select("outer_pos", "inner_pos", "id", "newspaper")


@query("s4_append_union", """
SELECT crawl::BIGINT AS crawl, source AS newspaper, count(*)::BIGINT AS n
FROM (SELECT 1 AS crawl, source FROM documents UNION ALL SELECT 2 AS crawl, source FROM documents)
GROUP BY crawl, source""")
def s4_append_union(spark, sf):
    d = documents(spark, sf).select(F.col("source").alias("newspaper"))
    both = IO.append_crawl(d.withColumn("crawl", F.lit(1).cast("bigint")), d.withColumn("crawl", F.lit(2).cast("bigint")))
    return both.groupBy("crawl", "newspaper").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("s7_incremental_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s7_incremental_anti(spark, sf):
    return IO.pending_ids(documents(spark, sf).select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("s8_retain_snapshots", """
WITH a AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS snapshot_ts, count(*)::BIGINT AS n FROM events GROUP BY 1)
SELECT snapshot_ts, n FROM (SELECT *, dense_rank() OVER (ORDER BY snapshot_ts DESC) AS r FROM a) WHERE r <= 3""")
def s8_retain_snapshots(spark, sf):
    return IO.retained_snapshots(IO.with_snapshot(table(spark, sf, "events")), 3)


@query("s9_restore_latest", """
SELECT event_id, user_id, event_type, value FROM events
WHERE CAST(date_trunc('day', ts) AS DATE) = (SELECT max(CAST(date_trunc('day', ts) AS DATE)) FROM events)""")
def s9_restore_latest(spark, sf):
    e = IO.with_snapshot(table(spark, sf, "events"))
    return IO.restore_latest(e).select("event_id", "user_id", "event_type", "value")


@query("d3_dedupe_first", "SELECT md5(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def d3_dedupe_first(spark, sf):
    d = documents(spark, sf).select(F.md5("text").alias("id"), "doc_id")
    return C.dedupe_first(d, "id", ("doc_id",)).select("id", "doc_id")


@query("d4_clean_counts", "SELECT count(*)::BIGINT AS n_before, count(DISTINCT md5(text))::BIGINT AS n_after FROM documents")
def d4_clean_counts(spark, sf):
    return C.clean_counts(documents(spark, sf).select(F.md5("text").alias("id")), "id")


@query("d5_lookup_newspaper", """
WITH lk AS (SELECT doc_id AS id, source AS newspaper, 1 AS ord FROM documents
            UNION ALL SELECT doc_id, source || '/es', 2 FROM documents WHERE lang = 'es'),
r AS (SELECT id, arg_max(newspaper, ord) AS newspaper FROM lk GROUP BY id)
SELECT l.doc_id, r.newspaper FROM labels l LEFT JOIN r ON l.doc_id = r.id""")
def d5_lookup_newspaper(spark, sf):
    d = documents(spark, sf)
    first = d.select(F.col("doc_id").alias("id"), F.col("source").alias("newspaper"), F.lit(1).alias("ord"))
    second = d.filter(F.col("lang") == "es").select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit("/es")).alias("newspaper"), F.lit(2).alias("ord"))
    left = table(spark, sf, "labels").select(F.col("doc_id").alias("Id"))
    out = C.lookup_join(left, first.unionByName(second), "Id", "id", "newspaper", "ord")
    return out.select(F.col("Id").alias("doc_id"), "newspaper")


@query("d6_exclude_source", "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src0'")
def d6_exclude_source(spark, sf):
    return C.exclude_sources(documents(spark, sf), ("src0",), "source").select("doc_id", "source")


@query("d7_build_text", f"""
WITH {ART_SQL}
SELECT doc_id, lower(coalesce(headline, '') || ' ' || coalesce(body, '')) AS texto FROM arts""")
def d7_build_text(spark, sf):
    return C.build_text(article_view(documents(spark, sf))).select("doc_id", "texto")


@query("d8_parse_dates", """
WITH d AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS dt FROM documents),
f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN strftime(dt, '%d/%m/%y') ELSE strftime(dt, '%Y-%m-%d') END AS fecha FROM d)
SELECT doc_id, coalesce(CAST(try_strptime(fecha, '%d/%m/%y') AS DATE), CAST(try_strptime(fecha, '%Y-%m-%d') AS DATE)) AS fecha_dt
FROM f""")
def d8_parse_dates(spark, sf):
    a = article_view(documents(spark, sf))
    fecha = F.when(F.col("doc_id") % 2 == 0, F.date_format("fecha_dt", "dd/MM/yy")).otherwise(
        F.date_format("fecha_dt", "yyyy-MM-dd"))
    return a.select("doc_id", fecha.alias("fecha")).select("doc_id", C.parse_dates("fecha").alias("fecha_dt"))


#: Layouts with and without a time of day, by document id: Spark's pattern and DuckDB's.
LAYOUTS = [("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
           ("dd/MM/yy HH:mm", "%d/%m/%y %H:%M"), ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"), ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
           ("dd-MM-yyyy", "%d-%m-%Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd/MM/yyyy", "%d/%m/%Y")]


@query("d8_parse_timestamps", f"""
WITH d AS (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) + to_minutes(doc_id * 37 % 1440) AS ts FROM documents),
f AS (SELECT doc_id, CASE doc_id % {len(LAYOUTS)} {" ".join(f"WHEN {i} THEN strptime(strftime(ts, '{d}'), '{d}')" for i, (_, d) in enumerate(LAYOUTS))} END AS ts FROM d)
SELECT doc_id, epoch(ts)::BIGINT AS seconds FROM f""")
def d8_parse_timestamps(spark, sf):
    """Dates in nine layouts, to the second where the layout has a time."""
    minutes = F.col("doc_id") * 37 % 1440
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") % 30 * 86400 + minutes * 60)
    said = F.coalesce(*[F.when(F.col("doc_id") % len(LAYOUTS) == i, F.date_format(ts, s)) for i, (s, _) in enumerate(LAYOUTS)])
    return documents(spark, sf).select("doc_id", said.alias("fecha")).select("doc_id", F.unix_timestamp(C.parse_timestamps("fecha")).alias("seconds"))
