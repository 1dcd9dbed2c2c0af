"""One query per operator, each over its whole table with production parameters, and the DuckDB SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import (
    bpe_replay,
    centroids,
    conversation_repair,
    decontaminate,
    html_text,
    maxent_lm,
    merkle,
    ngram_trie,
    quality_cnn,
    sharding,
    suffix_dedup,
    token_counts,
    url_cascade,
)
from newslens.llm.common import read

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
UNIGRAM_FILE = "piece_bpe_32k.model"

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text under the pieces and scores of a public vocabulary, read as a unigram model."""
    vocabulary = token_counts.load_vocabulary(public_tokenizers.path(UNIGRAM_FILE))
    return token_counts.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary)


def quality_network(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality_cnn.Network:
    """The classifier, fitted to labelled rows of docs outside the held-out third."""
    labels = read(spark, sf_dir, "labels", F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return quality_cnn.train(*quality_cnn.labelled_sample(texts, labels.where(~_held_out("id", 3, 1))))


def _held_out(id_col: str, modulus: int, remainder: int):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus)) == remainder


@query
def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = quality_cnn.score(docs.withColumnRenamed("doc_id", "id"), quality_network(spark, sf_dir, docs))
    return found.select(F.col("id").alias("doc_id"), _held_out("id", 3, 1).alias("held_out"), "score", "predicted")


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every whole text and of its edited text, with their likeness."""
    return merkle.fingerprints(read(spark, sf_dir, "documents", "doc_id", "text"))


def _fingerprint_sql(text: str) -> str:
    leaves = f"list_transform(string_split({text}, chr(10)), lambda p: sha256(p))"
    sections = (f"list_transform(range(1, len({leaves}) + 1, {merkle.SECTION}), "
                f"lambda i: sha256(array_to_string(({leaves})[i:i + {merkle.SECTION - 1}], '')))")
    pieces = f"list_transform(regexp_extract_all({text}, '[^\n]{{1,{merkle.PIECE}}}'), lambda p: left(md5(p), 8))"
    return (f"sha256(array_to_string({sections}, '')) || ':' || array_to_string(list_transform({sections}, lambda s: left(s, 16)), '.')"
            f" || ':' || array_to_string({pieces}, '.')")


def _likeness_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct(string_split(string_split({c}, ':')[3], '.'))" for c in (a, b))
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


ORACLES["op4_merkle"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM t),
e AS (SELECT *, left(text, (length(text) - length(text) // 2)::BIGINT) || left(following, (length(text) // 2)::BIGINT) AS edited FROM n),
f AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_fingerprint_sql("text")} AS fingerprint,
      {_fingerprint_sql("edited")} AS edited_fingerprint, {_fingerprint_sql("following")} AS next_fingerprint FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_likeness_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness_sql("fingerprint", "next_fingerprint")} AS near_next
FROM f"""

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the allow and block rules on the URL of every page."""
    return url_cascade.judge(read(spark, sf_dir, "pages", "page_id", "url"), url_cascade.rules_table(spark, URL_RULES))


ORACLES["op5_url_cascade"] = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
p AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT page_id, rhost || rpath AS rule, verdict,
      row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS rn
      FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, '{url_cascade.DEFAULT}') AS verdict
FROM u LEFT JOIN f ON u.page_id = f.page_id AND f.rn = 1"""


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other numbers, names and units."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a 5-word-shingle Jaccard similarity of 0.75 or more."""
    return ngram_trie.jaccard_classes(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards of near equal bytes."""
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the bytes they decode to, as digests."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_replay.digests(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


@query
def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text under the maximum-entropy model and its unigram base."""
    return maxent_lm.held_out_scores(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes of strings of 200 bytes that start elsewhere, too, as counts and a digest."""
    return suffix_dedup.removed(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of 8 centroids of every vector after 10 rounds."""
    assigned, fitted = centroids.cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return centroids.with_inertia(assigned, fitted)


def _rounds_sql() -> str:
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for r in range(1, centroids.ROUNDS + 2):
        steps.append(f"a{r} AS MATERIALIZED (SELECT q.rid, min(struct_pack(d := {square}, k := c{r - 1}.k)) AS best FROM q, c{r - 1} GROUP BY q.rid)")
        if r <= centroids.ROUNDS:
            steps.append(f"s{r} AS (SELECT best.k AS k, i, sum(x[i])::BIGINT AS t, count(*)::BIGINT AS n FROM a{r} JOIN q USING (rid), range(1, {centroids.DIMENSIONS + 1}) g(i) GROUP BY ALL)")
            steps.append(f"c{r} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r - 1} o LEFT JOIN "
                         f"(SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k) m ON m.k = o.k)")
    return ",\n".join(steps)


ORACLES["op12_centroids"] = f"""
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor({centroids.SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), x) - 1)::INTEGER AS k, x AS c FROM q QUALIFY k < {centroids.CLUSTERS}),
{_rounds_sql()},
f AS (SELECT vec_id, best.k AS cluster, best.d AS distance FROM a{centroids.ROUNDS + 1} JOIN q USING (rid))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{centroids.ROUNDS}.c, ',')) AS centroid_sha256
FROM f JOIN c{centroids.ROUNDS} ON c{centroids.ROUNDS}.k = f.cluster"""


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired digest of every conversation, after the given damage."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_repair.audits(conversation_repair.damaged(rows), present=F.col("present"))


ORACLES["op13_conversations"] = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM raw, bits),
kept AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit JOIN (VALUES (1), (2)) twice(n) ON n = 1 OR f = 3 WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM kept),
known AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed),
faulty AS (SELECT conv_id, turn, role, text, pos, solid = '' AS blank, solid <> '' AND again AS duplicate, solid <> '' AND NOT again AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
  pos > 1 AND lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM known),
every AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS n FROM faulty GROUP BY conv_id),
ops(st, op, initial, goes, price) AS (VALUES (0, 'D', NULL, 0, 4), (1, 'D', NULL, 1, 4), (2, 'D', NULL, 2, 4), (3, 'D', NULL, 3, 4), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0),
  (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3)),
ext(goes, st, ins, price) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 3), (1, 2, 'I', 3), (3, 2, 'I', 3), (2, 3, 'I', 3), (0, 3, 'II', 6), (1, 3, 'II', 6)),
v AS (SELECT conv_id, 0::BIGINT AS pos, st, price AS cost, ins AS audit FROM every, ext WHERE goes = 0
  UNION ALL
  SELECT conv_id, pos, st, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS rn FROM (
    SELECT v.conv_id, r.pos, e.st, v.cost + o.price + e.price + CASE WHEN r.truncated AND o.op <> 'D' THEN 3 ELSE 0 END AS cost, v.audit || o.op || e.ins AS audit
    FROM v JOIN faulty r ON r.conv_id = v.conv_id AND r.pos = v.pos + 1
    JOIN ops o ON o.st = v.st AND (o.op = 'D' OR NOT (r.blank OR r.duplicate)) AND (o.initial IS NULL OR o.initial = left(r.role, 1))
    JOIN ext e ON e.goes = o.goes)) WHERE rn = 1),
best AS (SELECT every.conv_id, v.cost, v.audit FROM every LEFT JOIN counts USING (conv_id) JOIN v ON v.conv_id = every.conv_id AND v.pos = coalesce(counts.n, 0) AND v.st IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY every.conv_id ORDER BY v.cost, v.audit) = 1),
steps AS (SELECT conv_id, j, audit[j] AS op, j - length(replace(left(audit, j::BIGINT), 'I', '')) AS inserted, length(replace(left(audit, j::BIGINT), 'D', '')) AS turn_no,
  length(replace(audit, 'D', '')) AS turns FROM best, range(1, 4000) g(j) WHERE j <= length(audit)),
lines AS (SELECT s.conv_id, s.j, CASE WHEN s.op = 'K' THEN r.role WHEN (s.turn_no + s.turns) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN s.op = 'I' THEN '' ELSE r.text END AS line
  FROM steps s LEFT JOIN faulty r ON r.conv_id = s.conv_id AND r.pos = s.j - s.inserted WHERE s.op <> 'D'),
done AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS body FROM lines GROUP BY conv_id)
SELECT b.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, b.cost::BIGINT AS cost, b.audit, sha256(coalesce(d.body, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id = b.conv_id LEFT JOIN done d ON d.conv_id = b.conv_id"""
