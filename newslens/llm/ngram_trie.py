"""N-gram Jaccard join: which texts share at least 75 % of their word n-grams, and the classes that these links form.

A text's set holds its distinct 5-word shingles (words: see bytewords), as 64-bit hashes; a shorter text has its whole
word sequence as one. Texts with equal sets are one vertex, named by a 128-bit digest, so copies cost nothing beyond the
first pass. Sets are kept in one global order, rare shingles first. A pair with Jaccard similarity t or more shares a
shingle among the first n - ceil(t n) + 1 of each set, and its sizes differ by t at most.

1. ``shingle_sets``: size and digest of every text. Each task counts the shingles of its own texts, deals the counts out by
   shingle and gets the counts over all texts back. A set that has less than ceil(t n) shingles in common with all others
   together can have no link: most texts are settled here, also those that share only a passage.
2. The others' shingles are counted once more, among them alone, and give the global order. Each set sends its prefix,
   dealt by shingle; sets in a shingle's list, sorted by size, are chained while neighbours' sizes are within t. That keeps
   together every pair that can be linked. A task chains its own lists before it sends them, and sends two entries for each
   shingle and size class, however many sets it has.
3. Connected components of the chains (large-star / small-star) give groups of candidates. The sets of a group meet in one
   unit; a group of more than ``unit_shingles`` is cut into blocks and every pair of blocks is a unit, so none is unbounded.
4. In a unit the sets go into a prefix tree, frequent shingles first. A traversal for each set shares the overlap along
   common paths, and leaves a subtree as soon as the remaining lengths can't reach the threshold, exactly and for all
   texts. Sets already in one class are not compared again, so a unit returns a spanning forest, never all pairs.
5. Components of the links name the classes.

Cases: null and empty texts, and those without words, have an empty set and are linked with nothing; repeated rows are in
one class; a null id never names a class, so a class of rows without id has a null name; rows without an id are told apart by
their text; an empty table gives no rows. Other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslens.llm.bytewords import hash_words, mix
from newslens.llm.common import byte_chunks, stage
from newslens.operators.common import maybe_broadcast

WORDS = 5
#: Links need 100 * intersection >= 75 * union.
THRESHOLD = 75
CHUNK_BYTES = 1 << 20
#: Shingles of the distinct sets that are counted in one chunk, before counts are dealt out.
FLUSH = 600_000
PREFIX_FLUSH = 500_000
UNIT_SHINGLES = 500_000


def shingles(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w, at = hash_words(column)
    if not len(w):
        return [np.zeros(0, np.uint64) for _ in range(len(at) - 1)]
    rng = np.random.default_rng(words)
    factor = rng.integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    padded = np.concatenate((w, np.zeros(words - 1, np.uint64)))
    all_windows = padded[: len(w)] * factor[0]
    for k in range(1, words):
        all_windows += padded[k : k + len(w)] * factor[k]
    all_windows = mix(all_windows + np.uint64(words))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(all_windows[a : b - words + 1]))
        elif b > a:
            out.append(mix((w[a:b] * factor[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(w[:0])
    return out


def digest(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def need(n: int, threshold: int) -> int:
    """The overlap that a set of n shingles needs with any set that it is linked with."""
    return -(-threshold * n // 100)


# ---------------------------------------------------------------- how many texts have a shingle

class Chunk:
    """Distinct sets of some thousand texts, and their distinct shingles in the order in which they are dealt: by bucket,
    then by the first set that has them."""

    def __init__(self, sets: list[np.ndarray], buckets: int):
        self.sets = sets
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
        found, first, inverse, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        bucket = ((found >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((first, bucket))
        self.shingle, self.count, self.bucket = found[order], counts[order], bucket[order]
        self.owner = of[first[order]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place, self.of = place[inverse], of  # for each element of the sets: its shingle's place, its set

    def messages(self, chunk: int):
        """(bucket, chunk, shingles cut to 32 bits, counts cut to 255) for each bucket."""
        for k, rows in _runs(self.bucket):
            yield k, chunk, self.shingle[rows].astype(np.uint32).tobytes(), np.minimum(self.count[rows], 255).astype(np.uint8).tobytes()


def _runs(values: np.ndarray):
    """(value, slice) of each run of equal values."""
    if len(values):
        cuts = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(values[a]), slice(a, b)


_MESSAGE = "bucket bigint, chunk bigint, a binary, b binary"


def _message_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
        ["bucket", "chunk", "a", "b"])


def _answered(messages: DataFrame) -> DataFrame:
    """For every chunk and bucket, how many sets have each shingle, over all chunks, as b, cut to 255. A shingle is known by
    its bucket and 32 bits here; should two meet, their counts add up, which costs pruning and no link. Rows with a bucket
    below 0 go through."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        a, b = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("a", np.uint32), ("b", np.uint8)))
        found, inverse = np.unique(np.concatenate(a), return_inverse=True)
        total = np.minimum(np.bincount(inverse, np.concatenate(b), len(found)), 255).astype(np.uint8)[inverse]
        parts = np.split(total, np.cumsum([len(x) for x in a])[:-1])
        none = pa.array([b""] * len(a), pa.binary())
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "a": none, "b": pa.array([x.tobytes() for x in parts], pa.binary())})

    return messages.groupBy("bucket").applyInArrow(run, _MESSAGE)


def _counts_of(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Of a chunk's rows: what its negative bucket held, and the counts in the order of the deal."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("a").to_pylist(), table.column("b").to_pylist()))
    with pa.ipc.open_stream(rows[0][1]) as reader:
        held = reader.read_all()
    return held, np.frombuffer(b"".join(r[2] for r in rows[1:]), np.uint8)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _buckets(df: DataFrame) -> int:
    return 8 * df.rdd.getNumPartitions()


def shingle_sets(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs (id, text) -> (id, n, digest, open): the size and digest (null: empty) of every text's set, and whether so many of
    its shingles stand in another set, too, that it could be linked. Equal sets of one chunk count as one."""
    kind = docs.schema["id"].dataType.simpleString()
    buckets = _buckets(docs)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        info, sets, place, size = [], [], {}, 0

        def flush():
            dealt = Chunk(sets, buckets)
            alone = dealt.count == 1
            inside = np.bincount(dealt.of[dealt.count[dealt.place] > 1], minlength=len(sets))
            # whose each shingle is, as runs; those with several owners are settled here
            owner = np.where(alone, dealt.owner, len(sets))
            cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
            length = np.diff(np.append(cut, len(owner)))
            ids = pa.concat_arrays([x[0] for x in info])
            n = pa.array([k for x in info for k in x[1]], pa.int64())
            digests = pa.array([d for x in info for d in x[2]], pa.binary())
            which = pa.array([place.get(d, -1) for x in info for d in x[2]], pa.int64())
            k = len(ids)
            pad = lambda v: pa.array([v] + [None] * (k - 1), pa.binary())
            held = pa.RecordBatch.from_arrays(
                [ids, n, digests, which, pad(inside.tobytes()), pad(owner[cut].astype(np.uint32).tobytes()), pad(length.astype(np.uint32).tobytes())],
                ["id", "n", "digest", "which", "inside", "owner", "length"])
            return _message_batch([(-1 - chunk, chunk, _packed(held), b""), *dealt.messages(chunk)])

        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            found = shingles(part.column("text"), words)
            names = [digest(x) if len(x) else None for x in found]
            for name, x in zip(names, found):
                if name is not None and name not in place:
                    place[name] = len(sets)
                    sets.append(x)
                    size += len(x)
            info.append((part.column("id"), [len(x) for x in found], names))
            if size >= FLUSH:
                yield flush()
                chunk += 1
                info, sets, place, size = [], [], {}, 0
        if info:
            yield flush()

    def settle(table: pa.Table) -> pa.Table:
        held, counts = _counts_of(table)
        inside, owner, length = (np.frombuffer(held.column(c)[0].as_py(), t) for c, t in (("inside", np.int64), ("owner", np.uint32), ("length", np.uint32)))
        of = np.repeat(owner, length)
        shared = inside + np.bincount(of[counts > 1], minlength=len(inside) + 1)[: len(inside)]
        which, n = held.column("which").to_numpy(), held.column("n").to_numpy()
        opened = (which >= 0) & (shared[which] * 100 >= n * threshold) if len(shared) else np.zeros(len(n), bool)
        return pa.table({"id": held.column("id"), "n": held.column("n"), "digest": held.column("digest"), "open": pa.array(opened)})

    dealt = docs.select("id", "text").mapInArrow(run, _MESSAGE)
    return _answered(dealt).groupBy("chunk").applyInArrow(settle, f"id {kind}, n bigint, digest binary, open boolean")


def _prefix_lists(wanted: DataFrame, words: int, threshold: int, buckets: int) -> DataFrame:
    """wanted (text, name) -> packed prefix entries (bucket, shingles, names, sizes) and, with a null bucket, chains (names,
    others). The order of shingles: rare ones among the wanted sets first, then by hash."""
    dealt_to = max(1, _buckets(wanted) // 4)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        names, sets, size = [], [], 0

        def flush():
            held = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["name", "members"])
            return _message_batch([(-1 - chunk, chunk, _packed(held), b""), *Chunk(sets, dealt_to).messages(chunk)])

        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            for name, x in zip(part.column("name").to_pylist(), shingles(part.column("text"), words)):
                if len(x) and digest(x) == name:
                    names.append(name)
                    sets.append(x)
                    size += len(x)
            if size >= PREFIX_FLUSH:
                yield flush()
                chunk += 1
                names, sets, size = [], [], 0
        if sets:
            yield flush()

    def lists(table: pa.Table) -> pa.Table:
        held, counts = _counts_of(table)
        sets = [np.frombuffer(x, np.uint64) for x in held.column("members").to_pylist()]
        own = Chunk(sets, dealt_to)
        count = counts[own.place]
        toks, sizes, names = [np.zeros(0, np.uint64)], [], []
        ends = np.cumsum([len(x) for x in sets])
        for name, x, end in zip(held.column("name").to_pylist(), sets, ends.tolist()):
            c = count[end - len(x) : end]
            if (c > 1).sum() >= need(len(x), threshold):
                prefix = x[np.lexsort((x, c))][: len(x) - need(len(x), threshold) + 1]
                toks.append(prefix)
                sizes.append(len(x))
                names.append(int.from_bytes(name[:8], "big", signed=True))
        lengths = [len(t) for t in toks[1:]]
        tok, name, n, a, b = _chain(np.concatenate(toks), np.repeat(np.array(names, np.int64), lengths), np.repeat(np.array(sizes, np.uint32), lengths), threshold)
        rows = [(None, b"", a.tobytes(), b.tobytes())] if len(a) else []
        bucket = (mix(tok ^ np.uint64(0x5BD1E995)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for k, some in _runs(bucket[order]):
            at = order[some]
            rows.append((k, tok[at].tobytes(), name[at].tobytes(), n[at].tobytes()))
        cols = list(zip(*rows)) or [()] * 4
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in zip(("shingles", "names", "sizes"), cols[1:])}})

    dealt = wanted.select("text", "name").mapInArrow(run, _MESSAGE)
    return _answered(dealt).groupBy("chunk").applyInArrow(lists, "bucket bigint, shingles binary, names binary, sizes binary")


def _chain(tok, name, n, threshold: int):
    """Sort entries by (shingle, size); returns the entries that stand for each shingle and size class, and the chained
    pairs of names."""
    order = np.lexsort((name, n, tok))
    tok, name, n = tok[order], name[order], n[order]
    joined = (tok[1:] == tok[:-1]) & (n[:-1].astype(np.int64) * 100 >= n[1:].astype(np.int64) * threshold)
    a, b = name[:-1][joined], name[1:][joined]
    differ = a != b
    pairs = np.unique(np.stack((a[differ], b[differ]), 1), axis=0) if differ.any() else np.zeros((0, 2), np.int64)
    # in a size class all sizes are within the threshold, so its first and last stand for those between
    size_class = np.floor(np.log(n) / max(-math.log(threshold / 100), 1e-9) * 2)
    edge = np.ones(len(tok) + 1, bool)
    edge[1:-1] = (tok[1:] != tok[:-1]) | (size_class[1:] != size_class[:-1])
    keep = edge[:-1] | edge[1:]
    return tok[keep], name[keep], n[keep], pairs[:, 0], pairs[:, 1]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the pairs: (member, smallest member)."""
    names, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(names)))
    half = len(a)
    for x, y in zip(index[:half].tolist(), index[half:].tolist()):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([_find(parent, i) for i in range(len(names))], np.int64)
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _candidate_links(lists: DataFrame, threshold: int) -> DataFrame:
    """(a, b): chains over the whole table, from the entries of each bucket and the tasks' own chains."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("shingles", np.uint64), ("names", np.int64), ("sizes", np.uint32))}
        *_, a, b = _chain(cols["shingles"], cols["names"], cols["sizes"], threshold)
        a, b = _forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def own(batches):
        for batch in batches:
            for x, y in zip(batch.column("names").to_pylist(), batch.column("sizes").to_pylist()):
                a, b = _forest(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = lists.where("bucket is not null").groupBy("bucket").applyInArrow(run, "a bigint, b bigint")
    chained = lists.where("bucket is null").mapInArrow(own, "a bigint, b bigint")
    return dealt.unionByName(chained).distinct()


# ---------------------------------------------------------------- components

def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): each node of the links (a, b) that isn't the smallest of its component, with that smallest one.

    Alternates large-star and small-star until every node points at its root; each round is staged. Raises if
    ``max_rounds`` don't suffice.
    """
    pairs = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        if state.n == 0 or (state.n == state.nodes and pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()):
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        pairs = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        pairs = stage(pairs, "large")
        low = pairs.groupBy("a").agg(F.min("b").alias("m"))
        moved = pairs.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stage(low.select("a", F.col("m").alias("b")).unionByName(moved).where("a <> b").distinct(), "small")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


# ---------------------------------------------------------------- the prefix tree

class Trie:
    """Sets of ints, each an ascending tuple, in a path-compressed prefix tree."""

    __slots__ = ("label", "depth", "ends", "children", "low", "high", "first", "only")

    def __init__(self, label, depth):
        self.label, self.depth = label, depth
        self.ends: list[int] = []
        self.children: list[Trie] = []
        self.low = self.high = self.first = 0
        self.only = -1  # the set, if there is one alone from here on

    @classmethod
    def build(cls, sets: list[tuple[int, ...]]) -> "Trie":
        order = sorted(range(len(sets)), key=sets.__getitem__)
        root = cls((), 0)
        todo = [(root, 0, len(order), 0)]
        while todo:
            node, lo, hi, at = todo.pop()
            a, b = sets[order[lo]], sets[order[hi - 1]]
            members = order[lo:hi]
            node.low, node.high = min(len(sets[i]) for i in members), max(len(sets[i]) for i in members)
            node.first = min(members)
            if hi - lo == 1:
                node.only, node.label, node.depth = order[lo], frozenset(a[at:]), len(a)
                continue
            end, most = at, min(len(a), len(b))
            while end < most and a[end] == b[end]:
                end += 1
            node.label, node.depth = (frozenset(a[at:end]), a[end - 1] if end > at else -1), end
            while lo < hi and len(sets[order[lo]]) == end:
                node.ends.append(order[lo])
                lo += 1
            while lo < hi:
                head, up = sets[order[lo]][end], lo
                while up < hi and sets[order[up]][end] == head:
                    up += 1
                child = cls((), end)
                node.children.append(child)
                todo.append((child, lo, up, end))
                lo = up
        return root


def linked(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[int]:
    """For each of the distinct sets, the smallest index in its class of links within the list."""
    parent = list(range(len(sets)))
    plus = 100 + threshold
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [tuple(np.sort(r).tolist()) for r in np.split(rank[inverse], cuts)]
    root = Trie.build(ordered)
    for r, own in enumerate(ordered):
        has, n = frozenset(own), len(own)
        todo = [(root, 0, 0)]  # node, overlap so far, how many of own are passed
        while todo:
            node, overlap, passed = todo.pop()
            if node.first >= r or node.high * 100 < n * threshold or node.low * threshold > n * 100:
                continue
            if node.only >= 0:
                if _find(parent, node.only) != _find(parent, r):
                    overlap += len(has & node.label)
                    if plus * overlap >= threshold * (n + node.depth):
                        _union(parent, r, node.only)
                continue
            label, last = node.label
            if label:
                overlap += len(has & label)
                passed = _passed(own, last, passed)
            # no set below can share more than what is left of either; the best length is the one where both run out
            left = n - passed
            best = min(max(node.depth + left, node.low), node.high)
            if plus * (overlap + min(left, best - node.depth)) < threshold * (n + best):
                continue
            for s in node.ends:
                if s < r and plus * overlap >= threshold * (n + node.depth):
                    _union(parent, r, s)
            todo.extend((child, overlap, passed) for child in node.children)
    return [_find(parent, i) for i in range(len(sets))]


def _passed(own: tuple[int, ...], token: int, lo: int) -> int:
    """How many of ``own`` are <= token."""
    hi = len(own)
    while lo < hi:
        mid = (lo + hi) // 2
        if own[mid] <= token:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _union(parent: list[int], x: int, y: int) -> None:
    x, y = _find(parent, x), _find(parent, y)
    parent[max(x, y)] = min(x, y)


def _verified_links(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): digests of linked sets, a spanning forest of each unit. sets: unit, part, name, members (packed set)."""

    def run(table: pa.Table) -> pa.Table:
        groups = defaultdict(dict)
        for part, name, members in zip(*(table.column(c).to_pylist() for c in ("part", "name", "members"))):
            groups[part][name] = members
        a, b = [], []
        for by_name in groups.values():
            names = sorted(by_name, key=lambda x: (len(by_name[x]), x))
            for i, k in enumerate(linked([np.frombuffer(by_name[x], np.uint64) for x in names], threshold) if len(names) > 1 else ()):
                if i != k:
                    a.append(names[i])
                    b.append(names[k])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return sets.groupBy("unit").applyInArrow(run, "a binary, b binary")


def _packed_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(group, name, members) of the wanted texts (id, group, name)."""

    def run(batches):
        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            sets = shingles(part.column("text"), words)
            right = [i for i, (s, name) in enumerate(zip(sets, part.column("name").to_pylist())) if len(s) and digest(s) == name]
            rows = part.take(pa.array(right, pa.int64()))
            members = pa.array([sets[i].tobytes() for i in right], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("group"), rows.column("name"), pa.array([len(sets[i]) for i in right], pa.int64()), members], ["group", "name", "n", "members"])

    return docs.join(wanted, "id").select("text", "group", "name").mapInArrow(run, "group bigint, name binary, n bigint, members binary")


#: Ids and digests of candidates are broadcast up to this many rows (about 50 bytes each), else shuffled with the texts.
BROADCAST_ROWS = 250_000


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A string for each row: its id, or the digest of its text if it has none. Keys of ids come first in order."""
    by_text = F.concat(F.lit("t"), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    return F.coalesce(F.concat(F.lit("i"), docs[id_col].cast("string")), by_text)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: int, unit_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(rows (key, n, digest), classes (digest, name, head)): every row's key, set size and digest; every set's class by its
    smallest id (null if there is none) and its first key."""
    texts = docs.select(_row_key(docs, id_col, text_col).alias("id"), docs[text_col].cast("string").alias("text"))
    rows = stage(shingle_sets(texts, words, threshold), "sets")
    if not rows.where(F.col("id").startswith("t")).isEmpty():
        # copies without an id share a key: one of them stands for all below
        by_text = F.col("id").startswith("t")
        texts = texts.where(~by_text).unionByName(texts.where(by_text).dropDuplicates(["id"]))
    vertices = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.max("open").alias("open"))
    opened = stage(vertices.where("open").select("id", F.col("digest").alias("name"), "n"), "open")
    buckets = 1 + (opened.agg(F.sum("n")).first()[0] or 0) * (100 - threshold) // 100 // 500_000
    asked = texts.join(maybe_broadcast(opened.select("id", "name"), BROADCAST_ROWS), "id").select("text", "name")
    lists = stage(_prefix_lists(asked, words, threshold, buckets), "prefixes")
    groups = components(_candidate_links(lists, threshold))

    vertices = opened.withColumn("node", _first_long("name"))
    grouped = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    wanted = stage(vertices.join(grouped, "node").select("id", F.col("root").alias("group"), "name", "n"), "wanted")
    sized = wanted.groupBy("group").agg(F.sum("n").alias("size")).withColumn("blocks", F.ceil(F.col("size") / unit_shingles))
    sets = _packed_sets(texts, maybe_broadcast(wanted.select("id", "group", "name"), BROADCAST_ROWS), words)
    large = stage(sized.where("blocks > 1").select("group", "blocks"), "large")
    units = 1 + (sized.agg(F.sum("size")).first()[0] or 0) // unit_shingles
    spread = F.pmod(F.xxhash64("group"), F.lit(units))
    if large.isEmpty():
        dealt = sets.withColumn("part", F.col("group")).withColumn("unit", spread)
    else:
        block = F.pmod(F.xxhash64("name"), F.col("blocks"))
        others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j))
        pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(others)
        dealt = sets.join(large, "group", "left").withColumn("pair", F.explode(pairs))
        dealt = dealt.withColumn("part", F.xxhash64("group", "pair")).withColumn("unit", F.when(F.col("blocks").isNull(), spread).otherwise(F.col("part")))
    links = _verified_links(dealt.select("unit", "part", "name", "members"), threshold)
    classes = components(links)

    # the class of each vertex that has links, then the smallest id of each class; staged, so that the last join is one of
    # two plain shuffles, whose large partitions (a digest with many copies) Spark splits
    kind = docs.schema[id_col].dataType
    own = F.when(F.col("id").startswith("i"), F.substring("id", 2, 1 << 30).cast(kind))
    first = F.struct(F.col("id").startswith("t").alias("none"), own.alias("own"), F.col("id").alias("key"))  # by id, not by its digits
    vertices = rows.where("digest is not null").groupBy("digest").agg(F.min(first).alias("first"))
    named = vertices.join(classes.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    lowest = named.groupBy("root").agg(F.min("first").alias("first"))
    of_digest = named.select("digest", "root").join(lowest, "root").select("digest", F.col("first.own").alias("name"), F.col("first.key").alias("head"))
    return rows.select(F.col("id").alias("key"), own.alias("own"), "n", "digest"), stage(of_digest, "classes")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """(id_col, n_shingles bigint, component_id): every row of ``docs`` with its set's size and the smallest id reachable
    by links. See the module's head for the method and the cases."""
    rows, classes = _classes(docs, id_col, text_col, words, threshold, unit_shingles)
    out = rows.join(classes, "digest", "left")
    return out.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "own").alias("component_id"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, less those whose class holds a smaller id. Rows that share an id stay or go
    together; rows equal in id and text are reduced to one; of rows without an id, those with the first text of a class stay."""
    rows, classes = _classes(docs, id_col, text_col, WORDS, THRESHOLD, UNIT_SHINGLES)
    heads = stage(rows.join(classes, "digest", "left").select("key", (F.col("key") == F.coalesce("head", "key")).alias("first")), "heads")
    by_key = heads.groupBy("key").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = by_key.where(~F.col("first")).select(F.col("key").alias(name))
    kept = docs.join(maybe_broadcast(gone, BROADCAST_ROWS), _row_key(docs, id_col, text_col) == F.col(name), "left_anti")
    return kept if by_key.where("n > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])


def _first_long(digest_col: str):
    """The first 8 bytes of a digest as a long, as the packed entries name it."""
    words = [F.conv(F.hex(F.substring(digest_col, at, 4)), 16, 10).cast("bigint") for at in (1, 5)]
    return F.shiftleft(words[0], 32).bitwiseOR(words[1])
