"""Token counts under a unigram vocabulary, without building the pieces.

A text is escaped (space becomes U+2581, one more stands in front) and cut where no piece can span: before every U+2581
that follows another character, if no vocabulary piece holds one there. For each segment an Aho-Corasick automaton lists
all vocabulary matches by their end; dynamic programming carries, for every position, the best score and the number of
pieces on that path, nothing else. Ties follow the unigram encoders of the public libraries: starts are tried in
ascending order and only a strictly better score replaces an earlier one, so the longest last piece wins. A character
without a piece of its own may be unknown at (lowest score - 10); with byte pieces in the vocabulary it counts one token
per UTF-8 byte, otherwise a run of unknown characters counts as one token. Scores add up in double precision.

No shuffle; a task keeps a bounded cache of segment counts and the vocabulary (a fixed size).

Cases: null and empty texts count 0 tokens; texts of any length are counted whole, in memory proportional to the longest
segment; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from newslens.llm.common import as_text, byte_chunks

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 200_000
CHUNK_BYTES = 4 << 20


class Vocabulary(NamedTuple):
    """Pieces that match text, with scores; whether unknown characters fall back to bytes; the lowest score of all."""

    pieces: list[tuple[str, float]]
    byte_fallback: bool
    lowest: float


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece model file. Control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    plain = [i for i in size if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in plain]
    return Vocabulary(pieces, any(model.is_byte(i) for i in size), min((s for _, s in pieces), default=0.0))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.auto.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.auto.make_automaton()
        self.single = {piece for piece, _ in vocabulary.pieces if len(piece) == 1}
        self.unknown = vocabulary.lowest - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        inner = any(SPACE in piece.lstrip(SPACE) for piece, _ in vocabulary.pieces)
        # runs of unknown characters count as one, so without bytes a cut could part such a run
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if not inner and self.bytes else lambda t: [t]
        self.known: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces on the best path through one segment."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        open_end = [False] * (n + 1)  # the path ends in an unknown run
        best[0] = 0.0
        matches = self.auto.iter(text) if len(self.auto) else iter(())
        ahead = next(matches, None)
        for end in range(1, n + 1):
            high, pieces, run = None, 0, False
            while ahead is not None and ahead[0] == end - 1:  # longest first, so starts ascend
                length, score = ahead[1]
                total = best[end - length] + score
                if high is None or total > high:
                    high, pieces, run = total, count[end - length] + 1, False
                ahead = next(matches, None)
            c = text[end - 1]
            if c not in self.single:
                total = best[end - 1] + self.unknown
                if high is None or total > high:
                    if self.bytes:
                        more = len(c.encode())
                    else:
                        more = 0 if open_end[end - 1] else 1
                    high, pieces, run = total, count[end - 1] + more, not self.bytes
            best[end], count[end], open_end[end] = high, pieces, run
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for part in self.segments(SPACE + text.replace(" ", SPACE)):
            n = known.get(part)
            if n is None:
                if len(known) >= CACHE_SEGMENTS:
                    known.clear()
                n = known[part] = self.segment(part)
            total += n
        return total


_counters: dict[int, Counter] = {}


def counter(vocabulary: Vocabulary) -> Counter:
    """The counter of a vocabulary, built once in each worker."""
    key = hash((tuple(vocabulary.pieces), vocabulary.byte_fallback))
    if key not in _counters:
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def token_counts(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens bigint, n_chars bigint) of every row; n_chars in code points."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = counter(sent.value)
        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            texts = as_text(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(map(own.count, texts), pa.int64()), pa.array(map(len, texts), pa.int64())],
                ["id", "n_tokens", "n_chars"])

    given = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    out = given.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_chars bigint")
    return out.withColumnRenamed("id", id_col)
