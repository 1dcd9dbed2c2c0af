"""Sharding: a minimax contiguous partition of ordered atomic groups.

Rows with equal text are one group and never parted; groups are ordered by the MD5 of their text. The capacity is the
smallest for which a greedy walk - fill a shard until the next group would exceed it, then open the next one - needs no
more than the wanted number of shards; it is found by binary search, and the cuts are where the greedy walk makes them.

The walk runs on the driver over a bounded summary. At first that is one entry for each of 65,536 ranges of the order.
Treating a range as unsplittable bounds the capacity from above, as divisible from below; only ranges in which a cut can
fall for a capacity between the bounds are opened, into ranges 65,536 times finer, until they are single groups. So the
result is exact, while the driver holds the first ranges and about a dozen opened ones for each shard.

The slots of a shard are numbered without a window over it: rows are counted by (shard, hash of the id), and only the rows
of one such cell are ranked together.

Cases: a null text has no bytes, as an empty one: both have size 1 and are one group; repeated rows share a group; a group
larger than an even share sets the capacity, and the walk fills the other shards up to it, so that later shards may stay
empty; there may be fewer groups than shards (then shards stay empty, too); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.llm.common import stage

SHARDS = 16
#: Hex digits of the order key that one level of ranges adds.
DIGITS = 4
CELLS = 4096
_KEY_DIGITS = 32

Range = tuple[str, int, int, int]  # key prefix, size, size of its largest group, groups


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Indexes at which a new shard opens, or None if ``shards`` don't suffice."""
    cuts, held = [], 0
    for i, size in enumerate(sizes):
        if size > capacity:
            return None
        if held + size > capacity:
            cuts.append(i)
            held = 0
            if len(cuts) >= shards:
                return None
        held += size
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity for which the greedy walk needs at most ``shards`` shards."""
    low, high = max([-(-sum(sizes) // shards), *sizes, 0]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _opened(ranges: list[Range], shards: int) -> list[int]:
    """Indexes of ranges of several groups in which a cut can fall for some capacity between the bounds."""
    sizes = [r[1] for r in ranges]
    total = sum(sizes)
    high = smallest_capacity(sizes, shards)
    low = max([-(-total // shards), *(r[2] for r in ranges)])
    # a walk may waste up to the size of a range at each cut; with capacity low it gets no further than k * low ...
    out, starts, at = [], [], 0
    for size in sizes:
        starts.append(at)
        at += size
    # ... and no less far than a walk that never parts a range
    earliest, reached, i = [], 0, 0
    for _ in range(shards - 1):
        end = reached + low
        while i < len(sizes) and starts[i] + sizes[i] <= end:
            i += 1
        reached = starts[i] if i < len(sizes) else total
        earliest.append(reached)
    zones = [(a, min(total, (k + 1) * high)) for k, a in enumerate(earliest)]
    for i, (size, start) in enumerate(zip(sizes, starts)):
        if ranges[i][3] > 1 and any(a < start + size and start <= b for a, b in zones):
            out.append(i)
    return out


def _ranges(groups: DataFrame, digits: int) -> list[Range]:
    rows = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("n")).collect()
    return sorted((r.prefix, r["size"], r.largest, r.n) for r in rows)


def cuts(groups: DataFrame, shards: int = SHARDS) -> list[str]:
    """The order keys at which shards 1, 2, ... open. groups: key (hex, _KEY_DIGITS long, distinct), size."""
    ranges = _ranges(groups, DIGITS)
    for digits in range(2 * DIGITS, _KEY_DIGITS + 1, DIGITS):
        chosen = _opened(ranges, shards)
        if not chosen:
            break
        prefixes = [ranges[i][0] for i in chosen]
        by_length = {}
        for p in prefixes:
            by_length.setdefault(len(p), []).append(p)
        inside = F.lit(False)
        for n, some in by_length.items():
            inside = inside | F.substring("key", 1, n).isin(some)
        finer = _ranges(groups.where(inside), digits)
        gone = set(prefixes)
        ranges = sorted([r for r in ranges if r[0] not in gone] + finer)
    sizes = [r[1] for r in ranges]
    return [ranges[i][0] for i in greedy(sizes, smallest_capacity(sizes, shards), shards)]


def _text_bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row: sizes near equal, groups of equal texts whole."""
    text = _text_bytes(F.col(text_col))
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"), F.md5(text).alias("key"))
    rows = stage(narrow, "sizes")
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    shard = F.lit(0)
    for key in cuts(groups, shards):
        shard = shard + (F.col("key") >= key).cast("int")
    cell = F.pmod(F.xxhash64("id"), F.lit(CELLS)).cast("int")
    placed = rows.select("id", "size", "crc", shard.alias("shard"), cell.alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "crc", "size")) - 1)
    # at most shards * CELLS rows
    out = ranked.join(F.broadcast(offsets), ["shard", "cell"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rank")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
