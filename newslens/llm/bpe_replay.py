"""Byte-level BPE encoding and decoding by replaying merges over the words of many documents at once.

Texts are split by the tokenizer's pattern; words that no earlier batch of the task has met are laid out in one array of
byte tokens. An inverted index holds, for each position where a mergeable pair stands, the token it merges into, whose id
is its rank. Merges are replayed in rank order: as words are independent of each other, every step takes each word's first
entry in rank order (the leftmost of equals), applies these merges to all words at once, and enters anew only the pairs
with the touched neighbours. For each word this is the order in which the tiktoken library merges, which also takes a word
that is a token of its own as that token.

Nothing is shuffled: a task needs only its own documents and the rank file (about 1 MB, a fixed size).

Cases: null and empty texts have no tokens and decode to empty bytes; a text of any length is encoded whole (a word of n
bytes costs O(n log n)); repeated rows give repeated results; an empty table gives no rows. Ids absent from the vocabulary
raise KeyError in ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from newslens.llm.common import IntTable, as_text, byte_chunks

CACHE_WORDS = 100_000
CHUNK_BYTES = 2 << 20
#: Longer words, in bytes, are merged one by one.
LONG_WORD = 256
#: Texts below this code point are split by the standard library, with the classes written out.
_SIMPLE = 0x250
_NEVER = np.int64(1 << 30)

_codecs: dict[tuple[bytes, str], "Codec"] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 bytes and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _written_out(pattern: str) -> re.Pattern | None:
    r"""The pattern with \p{L}, \p{N} and \s replaced by their members below _SIMPLE; None if it has other classes."""
    members = {"L": "", "N": "", "s": ""}
    for i in range(_SIMPLE):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        kind = kind if kind in "LN" else "s" if regex.match(r"\s", c) else ""
        if kind:
            members[kind] += f"\\u{i:04x}"
    out, depth, i = "", 0, 0
    while i < len(pattern):
        two, four = pattern[i : i + 2], pattern[i : i + 5]
        if four in (r"\p{L}", r"\p{N}"):
            body, i = members[four[3]], i + 5
            out += body if depth else f"[{body}]"
        elif two in (r"\s", r"\S"):
            body, i = members["s"], i + 2
            if two == r"\S" and depth:
                return None
            out += body if depth else f"[{'^' if two == r'\S' else ''}{body}]"
        elif two in (r"\p", r"\P", r"\w", r"\W", r"\d", r"\D", r"\b", r"\X"):
            return None
        else:
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            out += pattern[i]
            i += 1
    return re.compile(out)


class _Known(dict):
    """Token ids by word. A word not met before gets an empty list, to be filled when its batch is replayed; words of the
    previous generation come over as they are met again."""

    def __init__(self, older: dict):
        super().__init__()
        self.older = dict(older)
        self.fresh: dict[str, list[int]] = {}

    def __missing__(self, word):
        ids = self.older.get(word)
        if ids is None:
            ids = self.fresh[word] = []
        self[word] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        self.split_any = regex.compile(pattern).findall
        simple = _written_out(pattern)
        self.split_simple = simple.findall if simple else None
        self.beyond = re.compile(f"[^\\u0000-\\u{_SIMPLE - 1:04x}]").search
        split = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = IntTable([a << 32 | b for a, b, _ in split], [rank for _, _, rank in split], int(_NEVER))
        self.shared_ids = list(range(max(self.token, default=0) + 1))
        self.known = _Known({})

    def split(self, text: str) -> list[str]:
        if self.split_simple and not self.beyond(text):
            return self.split_simple(text)
        return self.split_any(text)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        whole = list(map(self.ranks.get, words))
        out: list[list[int]] = [[] if rank is None else [rank] for rank in whole]
        for w, rank in enumerate(whole):
            if rank is None and len(words[w]) > LONG_WORD:
                out[w] += self._replay_long(words[w])
        word = np.array([w for w, rank in enumerate(whole) if rank is None and 0 < len(words[w]) <= LONG_WORD], np.int64)
        data = np.frombuffer(b"".join([words[w] for w in word]), np.uint8)
        size = np.array([len(words[w]) for w in word], np.int64)
        tok = self.byte_ids[data]
        last = np.zeros(len(tok), bool)  # of its word
        last[np.cumsum(size) - 1] = True
        # the index: for each position, the token that its pair merges into; _NEVER where no pair starts
        index = np.full(len(tok), _NEVER)
        pairs = np.flatnonzero(~last)
        index[pairs] = self._merged(tok[pairs], tok[pairs + 1])
        while len(word):
            begin = np.cumsum(size) - size
            # each word's first entry in rank order, the leftmost of equals
            first = np.minimum.reduceat(index << 32 | np.arange(len(index)), begin)
            done = first >> 32 == _NEVER
            if done.any():
                ids = list(map(self.shared_ids.__getitem__, tok[np.repeat(done, size)].tolist()))
                i = 0
                for w, n in zip(word[done].tolist(), size[done].tolist()):
                    out[w] += ids[i : i + n]
                    i += n
                keep = np.repeat(~done, size)
                moved = np.cumsum(keep) - 1
                tok, index, last = tok[keep], index[keep], last[keep]
                word, size, begin = word[~done], size[~done], moved[begin[~done]]
                at = moved[(first & 0xFFFFFFFF)[~done]]
            else:
                at = first & 0xFFFFFFFF
            if not len(word):
                break
            tok[at] = index[at]
            last[at] = last[at + 1]
            left, right = at[at > begin] - 1, at[~last[at]]
            index[at] = _NEVER
            index[left] = self._merged(tok[left], tok[left + 1])
            index[right] = self._merged(tok[right], tok[right + 2])
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            tok, index, last = tok[keep], index[keep], last[keep]
            size = size - 1
        return out

    def _replay_long(self, word: bytes) -> list[int]:
        """The same order for one long word, whose entries wait in a heap: O(n log n)."""
        tok = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merged = self.ranks.get
        text = self.token

        def entry(i: int, j: int):
            rank = merged(text[tok[i]] + text[tok[j]]) if i >= 0 and j >= 0 else None
            return () if rank is None else ((rank, i, tok[i], tok[j]),)

        heap = [e for i in range(n - 1) for e in entry(i, i + 1)]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j < 0 or tok[j] != b:
                continue  # an earlier merge took one of the two
            tok[i], tok[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for e in (*entry(before[i], i), *entry(i, after[i])):
                heapq.heappush(heap, e)
        return [t for t in tok if t >= 0]

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.get(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text; words new to this codec are merged together first."""
        if len(self.known) > CACHE_WORDS:
            self.known = _Known(self.known)
        of_word = self.known.__getitem__
        found = [list(map(of_word, self.split(text))) for text in texts]
        fresh, self.known.fresh = self.known.fresh, {}
        for ids, made in zip(fresh.values(), self.replay([word.encode() for word in fresh])):
            ids += made
        for lists in found:
            yield list(chain.from_iterable(lists))

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of token ids."""
        return b"".join(map(self.token.__getitem__, ids))


def codec(data: bytes, pattern: str) -> Codec:
    """The codec of a rank file's bytes, built once in each worker."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def _ranks_of(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row."""
    ranks = _ranks_of(df, ranks_path)

    def run(batches):
        own = codec(ranks.value, pattern)
        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            ids = pa.array(list(own.encode(as_text(part.column("text")))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("id"), ids], ["id", "ids"])

    given = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    out = given.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary) of every row's token ids; null ids decode to empty bytes."""
    ranks = _ranks_of(df, ranks_path)

    def run(batches):
        own = codec(ranks.value, "")
        for batch in batches:
            made = pa.array([own.decode(ids or ()) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), made], ["id", "bytes"])

    given = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    out = given.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, bytes binary")
    return out.withColumnRenamed("id", id_col)


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each row is encoded, and its ids decoded, in one pass."""
    ranks = _ranks_of(df, ranks_path)

    def run(batches):
        own = codec(ranks.value, pattern)
        written = {rank: str(rank) for rank in own.token}
        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            n, sums, backs = [], [], []
            for ids in own.encode(as_text(part.column("text"))):
                n.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
                backs.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    out = given.mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
