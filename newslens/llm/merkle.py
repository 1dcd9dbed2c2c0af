"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text, in DataFrame functions only.

A text's lines are its paragraphs; SECTION paragraphs in a row are a section. A paragraph's hash is the SHA-256 of its
text, a section's that of its paragraphs' hashes, the root's that of the sections' hashes: roots are equal exactly when
texts are. Below the paragraphs stand their pieces, PIECE code points each, with short hashes, so that an edit within a
paragraph leaves the pieces before it alone.

A fingerprint is text: root:section.section...:piece.piece..., the root in full, the first 16 hex digits of each section's
hash, 8 of each piece's. The likeness of two fingerprints is 1 if the roots are equal, else the Dice coefficient of their
distinct pieces. ``differing_sections`` compares the second level and names the sections in which two texts differ.

``next_rows`` gives every row the text of the next row in descending order of id without gathering rows in one task: ids
are cut at quantiles into buckets, each bucket is a window of its own, and the highest row of each bucket is copied to the
bucket above as the successor of that bucket's last row. Only the bounds, one pair for each bucket, reach the driver.

Cases: a null text counts as empty, which has a fingerprint of its own; texts of any length are covered whole; ties of id
are ordered by text, descending; rows with equal id and text follow each other; a table of one row is its own successor;
the first row of all follows every row without id (of none, if there are only such rows: the text itself); an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = 8
PIECE = 32
#: Rows in a bucket of the succession, about.
BUCKET_ROWS = 2000
MOST_BUCKETS = 4096


def with_fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a fingerprint column for each text column: {text: fingerprint}. A null text counts as empty.

    Leaves and sections are columns of their own first, as a function of arrays evaluates anew what stands in it."""
    text = {out: F.coalesce(F.col(c), F.lit("")) for c, out in columns.items()}
    leaf, section = (lambda out: f"_leaves_{out}"), (lambda out: f"_sections_{out}")
    df = df.withColumns({leaf(out): F.transform(F.split(t, "\n", -1), lambda p: F.sha2(p, 256)) for out, t in text.items()})
    df = df.withColumns({section(out): _sections(F.col(leaf(out))) for out in text})
    made = {}
    for out, t in text.items():
        pieces = F.transform(F.regexp_extract_all(t, F.lit(r"[^\n]{1,%d}" % PIECE), F.lit(0)), lambda p: F.substring(F.md5(p), 1, 8))
        shorts = F.transform(F.col(section(out)), lambda s: F.substring(s, 1, 16))
        made[out] = F.concat_ws(":", F.sha2(F.array_join(section(out), ""), 256), F.array_join(shorts, "."), F.array_join(pieces, "."))
    return df.withColumns(made).drop(*map(leaf, text), *map(section, text))


def _sections(leaves: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(leaves), F.lit(SECTION))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(leaves, i, F.lit(SECTION)), ""), 256))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 0 to 1, 1 exactly for equal texts' ones unless texts differ in line feeds alone."""
    pa, pb = (F.array_distinct(F.split(F.element_at(F.split(x, ":"), 3), "\\.")) for x in (a, b))
    share = 2.0 * F.size(F.array_intersect(pa, pb)) / (F.size(pa) + F.size(pb))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections whose hashes differ or that only one of the two has."""
    sa, sb = (F.split(F.element_at(F.split(x, ":"), 2), "\\.") for x in (a, b))
    pairs = F.arrays_zip(sa.alias("x"), sb.alias("y"))
    numbered = F.transform(pairs, lambda p, i: F.when(p["x"].eqNullSafe(p["y"]), F.lit(None)).otherwise(i))
    return F.filter(numbered, lambda i: i.isNotNull())


def next_rows(docs: DataFrame) -> DataFrame:
    """docs (id bigint, text) with next_text: the text of the next row in descending order of id, of the first row after
    the last. Rows without id come after the last, so the first row follows each of them."""
    known = docs.where("id is not null")
    n = known.count()
    buckets = min(MOST_BUCKETS, 1 + n // BUCKET_ROWS)
    cuts = known.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    placed = known.withColumn("bucket", _above(F.col("id"), sorted({int(c) for c in cuts}), 0))
    tops = {r.bucket: r.top for r in placed.groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    if not tops:
        return docs.withColumn("next_text", F.col("text"))
    found = sorted(tops)
    top = F.create_map(*[F.lit(x) for b in found for x in (b, tops[b])])
    # the first row of a bucket closes the bucket above; that of the uppermost, the first of all, closes the lowest
    closes = F.create_map(*[F.lit(x) for i, b in enumerate(found) for x in (b, found[(i + 1) % len(found)])])
    firsts = placed.where(F.col("id") == top[F.col("bucket")]).groupBy("bucket").agg(F.max("text").alias("text"))
    closing = firsts.select(F.lit(None).cast("bigint").alias("id"), "text", closes[F.col("bucket")].alias("bucket"))
    order = Window.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), F.col("text").desc())
    rows = placed.select("id", "text", "bucket").unionByName(closing)
    rows = rows.withColumn("next_text", F.lead("text").over(order)).where("id is not null").select("id", "text", "next_text")
    first = known.where(F.col("id") == tops[found[-1]]).agg(F.max("text").alias("next_text"))
    lost = docs.where("id is null")
    return rows if lost.isEmpty() else rows.unionByName(lost.withColumn("next_text", first.scalar()))


def _above(x: Column, cuts: list[int], first: int) -> Column:
    """first + the number of cuts that x exceeds, by bisection: an expression of depth log(cuts)."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(x > cuts[mid], _above(x, cuts[mid + 1 :], first + mid + 1)).otherwise(_above(x, cuts[:mid], first))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by as many of ``following``, or all it has."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = next_rows(given).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = with_fingerprints(rows, {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"})
    return rows.select(
        F.col("id").alias(id_col), F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
