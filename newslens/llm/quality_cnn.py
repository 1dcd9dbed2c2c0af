"""Quality classifier: a byte-level convolutional network in NumPy.

Every position of a text's UTF-8 bytes is the start of a window of WIDTH bytes. A filter is a learned weight for each byte
value at each place of the window; with FILTERS of them, a window's responses are sums of table rows. Responses are
max-pooled over overlapping chunks of CHUNK positions that step by half a chunk and cover the whole text, passed through
tanh, and combined: the mean, the lowest and the highest response of each filter over the chunks, times learned weights,
give one probability by a sigmoid.

Training is plain back-propagation (Adam) on a bounded sample of labelled texts: SAMPLE_ROWS rows at most, those that
come first by a hash of id, of texts up to SAMPLE_TEXT_BYTES. Only the sample reaches the driver. Scoring covers every
byte of every text and needs no shuffle; the network's tables (about 150 kB) are broadcast.

Cases: null and empty texts have all-zero features, so their score is the network's for "nothing there"; any length is
scored whole, in pieces of bounded memory; repeated rows repeat; without any label, or with one class only, training
returns a network that answers the share of good labels (0.5 without labels); an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import byte_chunks

WIDTH = 6
FILTERS = 12
CHUNK = 128
HALF = CHUNK // 2
SAMPLE_ROWS = 3000
SAMPLE_TEXT_BYTES = 64_000
EPOCHS = 6
#: A small sample is gone through more often, for this many steps at least.
LEAST_STEPS = 800
BATCH = 16
CHUNK_BYTES = 256 << 10
_PAD = 256  # the byte value beyond the end of a text
_NEVER = np.float32(-1e4)


class Network(NamedTuple):
    tables: np.ndarray  # WIDTH x 257 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 3 x FILTERS: mean, lowest, highest
    offset: float


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each padded to whole half-chunks; how many half-chunks each has."""
    halves = np.array([-(-len(t) // HALF) for t in texts], np.int64)
    out = np.full(int(halves.sum()) * HALF + WIDTH, _PAD, np.int32)
    at = 0
    for t, n in zip(texts, halves.tolist()):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * HALF
    return out, halves


def _pooled(highest: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the highest response of each half-chunk to that of each overlapping chunk: (values, first chunk of each text).
    Chunk i joins half-chunks i and i + 1; a text of one half-chunk has that one chunk. Texts without any are left out."""
    own = halves[halves > 0]
    begin = np.cumsum(own) - own
    follows = np.ones(len(highest), bool)
    follows[begin + own - 1] = False
    after = np.concatenate((highest[1:], highest[-1:]))
    both = np.where(follows[:, None], np.maximum(highest, after), highest)
    keep = follows.copy()
    keep[begin[own == 1]] = True
    return both[keep], np.cumsum(np.maximum(own - 1, 1)) - np.maximum(own - 1, 1)


def _features(chunks: np.ndarray, first: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """texts x 3 x FILTERS; zero for texts without bytes."""
    out = np.zeros((len(halves), 3, chunks.shape[1]), np.float32)
    if len(first):
        n = np.diff(np.append(first, len(chunks)))
        has = halves > 0
        out[has, 0] = np.add.reduceat(chunks, first, 0) / n[:, None]
        out[has, 1] = np.minimum.reduceat(chunks, first, 0)
        out[has, 2] = np.maximum.reduceat(chunks, first, 0)
    return out


class Scorer:
    """Scores texts; two neighbouring places of a window share one table, so that a window takes WIDTH / 2 look-ups."""

    def __init__(self, net: Network):
        self.net = net
        t = net.tables.copy()
        t[0, _PAD] = _NEVER  # no window starts beyond the end
        self.pairs = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(257 * 257, -1).astype(np.float32) for j in range(0, WIDTH, 2)]

    def _highest(self, laid: np.ndarray) -> np.ndarray:
        n = len(laid) - WIDTH
        pair = laid[:-1] * 257 + laid[1:]
        z = self.pairs[0].take(pair[:n], 0)
        for k, table in enumerate(self.pairs[1:], 1):
            z += table.take(pair[2 * k : 2 * k + n], 0)
        return z.reshape(-1, HALF, z.shape[1]).max(1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        laid, halves = _laid_out(texts)
        step = CHUNK_BYTES // HALF * HALF
        parts = [self._highest(laid[i : min(i + step, len(laid) - WIDTH) + WIDTH]) for i in range(0, len(laid) - WIDTH, step)]
        z = np.concatenate(parts) if parts else np.zeros((0, FILTERS), np.float32)
        chunks, first = _pooled(np.tanh(z + self.net.bias), halves)
        x = (_features(chunks, first, halves) * self.net.weights).sum((1, 2), dtype=np.float64) + self.net.offset
        return 1 / (1 + np.exp(-x))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit a network to texts and their 0/1 labels, both classes with equal weight."""
    rng = np.random.default_rng(seed)
    p = {
        "tables": rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32),
        "bias": np.full(FILTERS, -1.0, np.float32),
        "weights": rng.normal(0, 0.1, (3, FILTERS)).astype(np.float32),
        "offset": np.zeros(1, np.float32),
    }
    labels = np.asarray(labels, np.float32)
    good = float(labels.mean()) if len(labels) else 0.5
    if good in (0.0, 1.0) or not len(labels):
        share = min(max(good, 1e-3), 1 - 1e-3)
        return Network(p["tables"] * 0, p["bias"] * 0, p["weights"] * 0, float(np.log(share / (1 - share))))
    weight = np.where(labels > 0, 0.5 / good, 0.5 / (1 - good)).astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            grad = _gradient(p, [texts[i] for i in rows], labels[rows], weight[rows])
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return Network(p["tables"], p["bias"], p["weights"], float(p["offset"][0]))


def _gradient(p: dict, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict:
    laid, halves = _laid_out(texts)
    n = len(laid) - WIDTH
    tables = p["tables"].copy()
    tables[0, _PAD] = _NEVER
    z = tables[0].take(laid[:n], 0)
    for j in range(1, WIDTH):
        z += tables[j].take(laid[j : j + n], 0)
    z = z.reshape(-1, HALF, FILTERS)
    where = z.argmax(1)  # half-chunks x filters
    high = np.take_along_axis(z, where[:, None], 1)[:, 0]
    act = np.tanh(high + p["bias"])
    chunks, first = _pooled(act, halves)
    feats = _features(chunks, first, halves)
    score = 1 / (1 + np.exp(-((feats * p["weights"]).sum((1, 2)) + p["offset"])))
    d = ((score - labels) * weight / len(texts)).astype(np.float32)
    grad = {"offset": d.sum(keepdims=True), "weights": (d[:, None, None] * feats).sum(0) + 1e-4 * p["weights"]}
    # back through the three summaries to chunks, and from a chunk to the half-chunk that held its highest response
    d_feats = (d[:, None, None] * p["weights"])[halves > 0]
    sizes = np.diff(np.append(first, len(chunks)))
    text = np.repeat(np.arange(len(first)), sizes)
    held = feats[halves > 0]
    d_chunks = d_feats[text, 0] / sizes[text, None]
    for k in (1, 2) if len(first) else ():  # chunks that tie share what goes to the lowest or highest
        tied = (chunks == held[text, k]).astype(np.float32)
        d_chunks += d_feats[text, k] * tied / np.maximum(np.add.reduceat(tied, first, 0), 1)[text]
    begin = (np.cumsum(halves) - halves)[halves > 0]
    half = np.arange(len(chunks)) - first[text] + begin[text]
    other = np.minimum(half + (halves[halves > 0][text] > 1), len(act) - 1)
    use_other = act[other] > act[half]
    d_act = np.zeros_like(act)
    np.add.at(d_act, half, np.where(use_other, 0, d_chunks))
    np.add.at(d_act, other, np.where(use_other, d_chunks, 0))
    d_z = d_act * (1 - act * act)
    grad["bias"] = d_z.sum(0)
    grad["tables"] = np.zeros_like(p["tables"])
    places = where + (np.arange(len(act)) * HALF)[:, None]
    columns = np.broadcast_to(np.arange(FILTERS), places.shape)
    for j in range(WIDTH):
        np.add.at(grad["tables"][j], (laid[places + j], columns), d_z)
    return grad


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` texts with labels, from docs (id, text) and labels (id, label). Of an id with several labels the
    lowest counts. Labels that are null or neither 0 nor 1, and rows without id or text, are no examples."""
    one = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    # first the ids, so that only the sample's texts travel
    chosen = one.select("id", "label", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(4 * rows)
    known = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
    found = known.join(F.broadcast(chosen), "id").orderBy("h", "id").limit(rows).select("text", "label").toArrow()
    return pc.cast(found.column("text"), pa.binary()).to_pylist(), np.array(found.column("label").to_pylist(), np.float32)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(id, score double, predicted int: 1 if score >= 0.5) for every row of docs (id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(sent.value)
        for part in byte_chunks(batches, "text", 4 * CHUNK_BYTES):
            found = scorer.score(pc.fill_null(pc.cast(part.column("text"), pa.binary()), b"").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(sent.value)
        for part in byte_chunks(batches, text_col, 4 * CHUNK_BYTES):
            found = scorer.score(pc.fill_null(pc.cast(part.column(text_col), pa.binary()), b"").to_pylist())
            yield part.filter(pa.array(found >= 0.5))

    return docs.mapInArrow(run, docs.schema)
