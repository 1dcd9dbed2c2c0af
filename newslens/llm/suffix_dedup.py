"""Suffix-array deduplication: every byte inside a string of LENGTH bytes that starts somewhere else, too.

A string of LENGTH bytes has an anchor: of the hashes of the pieces of ANCHOR bytes in it, the place of the smallest (the
leftmost of equal ones). Equal strings have equal anchors, so only places whose anchor's hash occurs twice in the corpus can
repeat. The texts are scanned for runs of string starts with one anchor, some 40 bytes apart; a run is named by its anchor's
hash and a hash of its bytes, and equal runs of one Arrow batch are one row, so that a common line costs a task one row and
not one for each place. Runs with equal bytes are repeats throughout. The rest of a group - other bytes around an anchor that
others have, too - goes to the suffix array, together with one of each kind of equal runs.

A suffix array is built for one or more whole groups, laid end to end (UNIT_BYTES), in two stages. A suffix that is smaller
than its successor is sorted directly, 8 bytes at a time, and only ties are looked at again. The others are induced: buckets
of the first byte are scanned in ascending order, and every suffix met puts its predecessor, if that is larger, next in its
own bucket; a scan takes a bucket's suffixes at once, run after run of the same byte. Then the common prefixes of neighbours
are computed: LENGTH or more is a repeat. Nothing beyond LENGTH is compared, and suffixes are left out that neither start a
string in question nor are needed to induce one.

A group of more than MOST different runs never comes to one task as it is. Its runs are cut into blocks of NARROW starts at
equal distances from the anchor; strings of one block share LENGTH - NARROW + 1 bytes, by which blocks are grouped anew. What
is too large even then is cut into single strings, whose groups are the equal ones: they are counted, with partial sums.

Cases: null counts as empty; texts shorter than LENGTH stay as they are; equal texts of LENGTH bytes or more lose everything,
in each row; ties - overlapping repeats within one text - count; texts of any length are scanned in segments; strings never
cross texts; bytes are cut without regard to characters, so ``kept`` is binary; rows without id, or with a shared id, are
judged by their text; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.llm.bytewords import _VALUE, _power, mix
from newslens.llm.common import as_bytes, byte_chunks, release, stage

LENGTH = 200
#: Bytes of an anchor. Longer ones give fewer false groups and more rows.
ANCHOR = 128
MOST = 50_000
NARROW = 8
UNIT_BYTES = 6_000_000
_SEGMENT = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)

RUNS = "h long, ph long, tkey long, at long, more binary"


# --- runs of strings that share an anchor -----------------------------------------------------------------


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def runs(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: (text, first start, starts, bytes from the first start to the anchor, hash of the
    anchor, hash of the run's bytes). Every string of ``length`` bytes is in one run."""
    parts, owner, offset = [], [], []
    for i, text in enumerate(texts):
        for begin in range(0, len(text) - length + 1, _SEGMENT):
            parts.append(text[begin : begin + _SEGMENT + length - 1])
            owner.append(i)
            offset.append(begin)
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    out, held, begin = [], 0, 0
    for i, part in enumerate(parts):
        if i > begin and held + len(part) > 2 * _SEGMENT:
            out.append(_runs(parts[begin:i], np.array(owner[begin:i]), np.array(offset[begin:i]), length, anchor))
            begin, held = i, 0
        held += len(part)
    out.append(_runs(parts[begin:], np.array(owner[begin:]), np.array(offset[begin:]), length, anchor))
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs(parts: list[bytes], owner: np.ndarray, offset: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(parts), np.uint8)
    n, sizes = len(data), np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE_OF[data] * _power("up", n), out=sums[1:])
    down = _power("down", n + 1)
    hashes = mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    places = np.arange(len(hashes), dtype=np.uint64)
    least = (_sliding_least((hashes & ~_PLACE) | places, length - anchor + 1) & _PLACE).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), sizes - length + 1)
    first = np.cumsum(sizes - length + 1) - (sizes - length + 1)
    start = np.arange(len(part)) - first[part] + begins[part]
    at = least[start]
    opens = np.ones(len(start), bool)
    opens[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(opens)
    count = np.diff(np.append(head, len(start)))
    begin, q = start[head], at[head]
    left = q - begin
    body = (sums[begin + count + length - 1] - sums[begin]) * down[begin]
    ph = mix(body + (left * 256 + count).astype(np.uint64) * _ODD)
    return owner[part[head]], begin - begins[part[head]] + offset[part[head]], count, left, hashes[q], ph


#: As in bytewords, but with capital letters apart.
_VALUE_OF = _VALUE.copy()
_VALUE_OF[65:91] = np.random.default_rng(11).integers(1, 2**63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scan(length: int, anchor: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: an equal text adds no other string, and its own rows are settled by their count
        for batch in byte_chunks(batches, "text", 2 * _SEGMENT):
            new = []
            for i, key in enumerate(batch.column("tkey").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            texts = batch.column("text").take(pa.array(new, pa.int64()))
            keys = batch.column("tkey").take(pa.array(new, pa.int64())).to_numpy()
            owner, first, count, left, h, ph = runs(as_bytes(texts), length, anchor)
            if not len(h):
                continue
            at = (first << 16) | (left << 8) | count
            order = np.lexsort((ph, h))
            h, ph, key, at = h[order].view(np.int64), ph[order].view(np.int64), keys[owner[order]], at[order]
            opens = np.ones(len(h), bool)
            opens[1:] = (h[1:] != h[:-1]) | (ph[1:] != ph[:-1])
            head = np.flatnonzero(opens)
            sizes = np.diff(np.append(head, len(h)))
            pairs = np.stack([key, at], 1)
            more = [pairs[i + 1 : i + n].tobytes() if n > 1 else None for i, n in zip(head.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h[head]), pa.array(ph[head]), pa.array(key[head]), pa.array(at[head]), pa.array(more, pa.binary())], names=["h", "ph", "tkey", "at", "more"])
        release()

    return scan


# --- the suffix array -------------------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as a number in the order of the bytes; zeros follow the end."""
    words = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for bits, step in ((8, 1), (16, 2), (32, 4)):
        words = (words[:-step] << np.uint64(bits)) | words[step:]
    return words[: len(data)]


def _rising(data: np.ndarray) -> np.ndarray:
    """Whether the suffix from each place is smaller than its successor. The end counts as smaller than any byte; the last
    place is taken as rising, so that every chain of falling suffixes ends at a rising one."""
    step = np.sign(data[1:].astype(np.int16) - data[:-1])
    n = len(data)
    known = np.append(np.flatnonzero(step), n - 1)
    following = known[np.searchsorted(known, np.arange(n))]
    return np.append(step, 1)[following] > 0


def _sort_directly(places: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """The places in the order of their first ``length`` bytes at least; ties in any order."""
    key = words[places]
    order = np.argsort(key)
    places, key = places[order], key[order]
    tied = np.zeros(len(places) + 1, bool)  # with the one before
    tied[1:-1] = key[1:] == key[:-1]
    for depth in range(8, length, 8):
        slots = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(slots):
            break
        joins = tied[slots]  # a slot that joins none opens a group
        key = words[places[slots] + depth]
        differs = np.zeros(len(slots), bool)
        differs[1:] = joins[1:] & (key[1:] != key[:-1])
        if not differs.any():
            continue
        group = np.cumsum(~joins)
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differs]] = True
        some = np.flatnonzero(mixed[group])
        order = some[np.lexsort((key[some], group[some]))]
        places[slots[some]], key[some] = places[slots[order]], key[order]
        differs[some[1:]] = joins[some[1:]] & (key[some[1:]] != key[some[1:] - 1])
        tied[slots[differs]] = False
    return places


def suffix_order(data: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted places (a mask) in the order of their suffixes, right for the first ``length`` bytes. ``data`` ends with
    ``length`` + 8 bytes or more of padding, of which none is wanted."""
    n = len(data)
    rising = _rising(data)
    stops = np.flatnonzero(rising)
    open_end = np.flatnonzero(wanted & ~np.append(wanted[1:], False) & ~rising)  # chains that go on beyond what is wanted
    close = stops[np.searchsorted(stops, open_end)]
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, open_end, 1)
    np.add.at(delta, close + 1, -1)
    needed = wanted | (np.cumsum(delta[:-1]) > 0)
    direct = np.flatnonzero(needed & rising)
    words = _words(np.concatenate([data, np.zeros(length, np.uint8)]))
    direct = _sort_directly(direct, words, length)
    borders = np.searchsorted(data[direct], np.arange(257))
    falling = needed & ~rising
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        level = np.concatenate(queues[byte]) if queues[byte] else np.zeros(0, np.int64)
        scanned = []
        while len(level):  # falling suffixes of this bucket; each may be the tail of one with the same byte before it
            scanned.append(level)
            before = level - 1
            level = before[(before >= 0) & falling[before] & (data[before] == byte)]
        scanned.append(direct[borders[byte] : borders[byte + 1]])
        bucket = np.concatenate(scanned)
        if not len(bucket):
            continue
        out.append(bucket)
        queues[byte] = []
        before = bucket - 1
        before = before[(before >= 0) & falling[before] & (data[before] > byte)]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for some in np.split(before, cuts):
                queues[data[some[0]]].append(some)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of each neighbours in ``order``, whether their common prefix is ``length`` or more."""
    words = _words(data)
    pair = np.arange(len(order) - 1)
    for depth in range(0, length, 8):
        over = np.uint64(max(0, depth + 8 - length) * 8)
        pair = pair[(words[order[pair] + depth] >> over) == (words[order[pair + 1] + depth] >> over)]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[pair] = True
    return out


def repeated(bodies: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each body, the starts of strings of ``length`` bytes that start elsewhere in the bodies, too."""
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies) + bytes(length + 8), np.uint8)
    begins = np.cumsum(sizes) - sizes
    starts = np.maximum(sizes - length + 1, 0)
    delta = np.zeros(len(data) + 1, np.int32)
    some = starts > 0
    np.add.at(delta, begins[some], 1)
    np.add.at(delta, begins[some] + starts[some], -1)
    wanted = np.cumsum(delta[:-1]) > 0
    order = suffix_order(data, wanted, length)
    same = common_prefixes(data, order, length)
    hit = np.zeros(len(data), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begins.tolist(), starts.tolist())]


SPANS = "tkey long, begin long, end long"


def _span_batch(key, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, begin, end)], names=["tkey", "begin", "end"])


def _suffix_arrays(length: int):
    """Over rows (g, tkey, first, whole, body) that come group by group: spans of repeats in bodies that aren't whole."""

    def unit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, begins, ends = [], [], []
        for (_, key, first, whole, _), hits in zip(rows, repeated([r[4] for r in rows], length)):
            if whole or not len(hits):
                continue
            cut = np.flatnonzero(np.diff(hits) > 1)
            for a, b in zip(hits[np.append(0, cut + 1)].tolist(), hits[np.append(cut, len(hits) - 1)].tolist()):
                keys.append(key)
                begins.append(first + a)
                ends.append(first + b + length)
        if keys:
            yield _span_batch(keys, begins, ends)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "tkey", "first", "whole", "body"))):
                if size > UNIT_BYTES and row[0] != held[-1][0]:
                    yield from unit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from unit(held)
        release()

    return arrays


# --- Spark ------------------------------------------------------------------------------------------------


def _text(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(text.alias("text"), F.xxhash64(text).alias("tkey"))


def shared_runs(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """texts (text, tkey) -> the runs whose anchor others have, too: RUNS, whole (the run's bytes occur twice), opens (one row
    of each kind of bytes) and kinds (how many kinds the anchor has)."""
    found = texts.where(F.octet_length("text") >= length).select("tkey", "text").mapInArrow(_scan(length, anchor), RUNS)
    near = Window.partitionBy("h").orderBy("ph", "tkey", "at")
    other = [F.lag("ph").over(near), F.lead("ph").over(near)]
    ranked = found.select("*", other[0].alias("_before"), other[1].alias("_after"))
    held = ranked.where(F.col("_before").isNotNull() | F.col("_after").isNotNull() | F.col("more").isNotNull()).select(
        *found.columns, (F.col("more").isNotNull() | F.coalesce(F.col("_before") == F.col("ph"), F.lit(False)) | F.coalesce(F.col("_after") == F.col("ph"), F.lit(False))).alias("whole"),
        F.coalesce(F.col("_before") != F.col("ph"), F.lit(True)).alias("opens"))
    return held.withColumn("kinds", F.sum(F.col("opens").cast("long")).over(Window.partitionBy("h")))


def _bodies(some: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(h, left, tkey, first, whole, body) of runs, with the bytes of their strings cut from one row of each text."""
    at = F.col("at")
    one = texts.dropDuplicates(["tkey"]).select("tkey", F.col("text").cast("binary").alias("bytes"))
    placed = some.select("h", "tkey", "whole", F.shiftright(at, 16).alias("first"), at.bitwiseAND(255).cast("int").alias("n"), F.shiftright(at, 8).bitwiseAND(255).cast("int").alias("left"))
    return placed.join(one, "tkey").select(
        "h", "left", "tkey", "first", "whole", F.substring(F.col("bytes"), (F.col("first") + 1).cast("int"), F.col("n") + length - 1).alias("body"))


def _blocks(bodies: DataFrame, width: int, length: int) -> DataFrame:
    """Bodies cut into blocks of ``width`` starts at equal distances from the anchor; g is what the strings of a block share."""
    first, last = F.col("left") - (F.octet_length("body") - length), F.col("left")  # distances of starts to the anchor
    cut = bodies.select("*", F.explode(F.sequence(F.floor(first / width), F.floor(last / width))).alias("t"))
    high = F.least(F.col("left"), (F.col("t") + 1) * width - 1)
    low = F.greatest(first, F.col("t") * width)
    skip = F.col("left") - high
    block = cut.select("h", "t", "tkey", "whole", (F.col("first") + skip).alias("first"), high.cast("int").alias("left"),
                       F.substring(F.col("body"), (skip + 1).cast("int"), (high - low + length).cast("int")).alias("body"))
    # from t * width bytes before the anchor: what strings that start up to width - 1 bytes earlier still hold
    core = F.substring(F.col("body"), (F.col("left") - F.col("t") * width + 1).cast("int"), F.lit(length - width + 1))
    return block.select(F.xxhash64("h", "t", core).alias("g"), "h", "left", "tkey", "first", "whole", "body")


def _sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """Spans from the suffix arrays of whole groups g."""
    parts = rows.select("g", "tkey", "first", "whole", "body").repartition("g").sortWithinPartitions("g")
    return parts.mapInArrow(_suffix_arrays(length), SPANS)


def repeat_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """texts (text, tkey) -> SPANS: stretches of repeated strings, which may overlap, in texts that occur once."""
    held = stage(shared_runs(texts, length, anchor), "shared-runs")

    def all_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = b"".join(x for x in batch.column("more").to_pylist() if x)
            pairs = np.concatenate([np.stack([batch.column("tkey").to_numpy(), batch.column("at").to_numpy()], 1), np.frombuffer(more, np.int64).reshape(-1, 2)])
            first = pairs[:, 1] >> 16
            yield _span_batch(pairs[:, 0], first, first + (pairs[:, 1] & 255) + (length - 1))

    spans = held.where("whole").select("tkey", "at", "more").mapInArrow(all_places, SPANS)
    mixed = held.where("opens and kinds > 1")
    small = _bodies(mixed.where(F.col("kinds") <= most), texts, length).withColumn("g", F.col("h"))
    spans = spans.unionByName(_sorted_groups(small, length))
    if held.where(F.col("kinds") > most).limit(1).count():
        blocks = stage(_blocks(_bodies(mixed.where(F.col("kinds") > most), texts, length), NARROW, length), "narrow-blocks")
        sizes = blocks.groupBy("g").agg(F.count("*").alias("n"))
        large = stage(sizes.where(F.col("n") > most).select("g"), "large-blocks")
        spans = spans.unionByName(_sorted_groups(blocks.join(large, "g", "left_anti"), length))
        # single strings, whose groups are the equal ones
        single = _blocks(blocks.join(large, "g", "left_semi").drop("g"), 1, length).withColumn("key", F.md5("body"))
        equal = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        spans = spans.unionByName(single.where("not whole").join(equal, "key", "left_semi").select("tkey", "first", (F.col("first") + length).alias("end")).toDF("tkey", "begin", "end"))
    return spans


CUT = "tkey long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"


def _cut(length: int):
    def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        opens = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
        return list(zip(begin[opens].tolist(), end[np.append(opens[1:] - 1, len(end) - 1)].tolist()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, "text", 8 * _SEGMENT):
            found = batch.column("found")
            inner = found.flatten()
            borders = found.offsets.to_numpy() - found.offsets[0].as_py()
            begin, end = inner.field("begin").to_numpy(), inner.field("end").to_numpy()
            sizes, spans, kept = [], [], []
            for text, copies, a, b in zip(as_bytes(batch.column("text")), batch.column("copies").to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
                if copies > 1:
                    gone = [(0, len(text))] if len(text) >= length else []
                else:
                    gone = merged(begin[a:b], end[a:b]) if b > a else []
                keep, at = [], 0
                for x, y in gone:
                    keep.append(text[at:x])
                    at = y
                sizes.append(len(text))
                spans.append([{"begin": x, "end": y} for x, y in gone])
                kept.append(b"".join(keep) + text[at:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["tkey", "n_bytes", "spans", "kept"])
        release()

    return cut


def cut_texts(docs: DataFrame, text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """CUT of every different text: tkey (xxhash64 of the text), its size, the spans removed (maximal, in order), and the rest."""
    texts = _text(docs, text_col)
    spans = repeat_spans(texts, length, anchor, most)
    per_text = spans.groupBy("tkey").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    one = texts.groupBy("tkey").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    joined = one.join(per_text, "tkey", "left").select("tkey", "text", "copies", F.coalesce("found", none).alias("found"))
    return joined.mapInArrow(_cut(length), CUT)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    span = F.col("spans")
    gone = F.aggregate(span, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    cut = cut_texts(docs, text_col, length, anchor, most).select(
        "tkey", "n_bytes", gone.alias("n_removed"), F.size(span).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    rows = docs.select(docs[id_col], F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("tkey"))
    return rows.join(cut, "tkey").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
