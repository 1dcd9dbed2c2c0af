"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are words (see bytewords) and one end per text, each known by its 64-bit hash. The model factors

    p(token | before) = p(class | features of what stands before) * p(token | class).

The class softmax is the maximum-entropy part: four features - the token before, the one two before, the one three before
(skips), and the pair of the two before (n-gram) - are hashed to rows of one table of ROWS x CLASSES weights, whose rows
and a bias are added up. Classes: the most frequent tokens, the end among them, one each; CLUSTERS of the COMMON next ones,
grouped by which of the most frequent tokens stand beside them; the rest class for all others. Within a class the softmax
has a bias only, which training fits in closed form: the token's share of the class's training count, smoothed by one, with
one more place in the rest class for tokens never seen. So probabilities add up to one.

Everything is gathered from all training texts:
1. token counts: each task adds up its own, then they are summed by token;
2. neighbour counts of common tokens, summed in blocks up a tree of bounded fan-in;
3. class weights: in each of ROUNDS rounds a share of the training texts is read, every task starts from the current
   weights and makes Adagrad steps on minibatches, and the changes are averaged row by row, weighted by how often the task
   met the row, up the same tree.
The driver holds the model: HEAD token counts at most, COMMON x PROBES neighbour counts, the weight table. It is broadcast
to score all texts in sparse batches. Tokens outside the HEAD most frequent ones are looked up by a join with the counts.

Cases: null and empty texts consist of the end; texts of any length are scored whole; repeated rows are scored each;
without training texts N = V = 0, so the base score is 0 and the model spreads evenly over the classes; an empty table
gives no rows. Rows without an id count as id "".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.bytewords import hash_words, mix
from newslens.llm.common import IntTable, byte_chunks, most_frequent, stage

HEAD = 1 << 18
COMMON = 1 << 16
SINGLES = 14
CLUSTERS = 17
CLASSES = SINGLES + CLUSTERS + 1
REST = CLASSES - 1
PROBES = 32
PAIRED = 2048
ROW_BITS = 15
ROWS = 1 << ROW_BITS
FEATURES = 4
ROUNDS = 2
MINIBATCH = 8192
RATE = 0.3
CHUNK_BYTES = 2 << 20
COUNT_FLUSH = 3_000_000
FAN_IN = 64
BLOCK_ROWS = 512
END = np.uint64(0x9D39247E33776D41)
_SALTS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Vocabulary(NamedTuple):
    """The head: hashes and counts by descending count, and their classes; N and V of all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray  # training tokens in each class
    class_types: np.ndarray
    tokens: int
    types: int


class Model(NamedTuple):
    vocabulary: Vocabulary
    weights: np.ndarray  # ROWS x CLASSES
    bias: np.ndarray  # CLASSES


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, offsets), an end after each text's words."""
    words, at = hash_words(column)
    n = len(at) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = at[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[ends] = END
    out[is_word] = words
    return out, np.append(0, ends + 1)


# ---------------------------------------------------------------- 1. counts

def token_counts(texts: DataFrame) -> DataFrame:
    """(h bigint, c bigint): how often each token stands in texts (text)."""

    def run(batches):
        held, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["h", "c"])

        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            held.append(tokens_of(part.column("text"))[0])
            size += len(held[-1])
            if size >= COUNT_FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- sums up a tree

def tree_sum(parts: DataFrame, tasks: int, join: Callable[[list[bytes], list[bytes]], tuple[bytes, bytes]]) -> DataFrame:
    """parts (block, task, value, weight) joined by block, FAN_IN of them at most in one group at a time."""

    def run(table: pa.Table) -> pa.Table:
        value, weight = join(table.column("value").to_pylist(), table.column("weight").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "task": table.column("over").slice(0, 1), "value": pa.array([value], pa.binary()), "weight": pa.array([weight], pa.binary())})

    while True:
        over = F.floor(F.col("task") / FAN_IN).cast("bigint")
        parts = parts.withColumn("over", over).groupBy("block", "over").applyInArrow(run, "block bigint, task bigint, value binary, weight binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return parts


def _tasks(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


# ---------------------------------------------------------------- 2. classes

def _neighbours(texts: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """common tokens x 2 PROBES: how often each of the most frequent tokens stands before, and after, each common one."""
    common, probes = hashes[:COMMON], min(PROBES, len(hashes))
    sent = texts.sparkSession.sparkContext.broadcast(common)
    n = len(common)

    def run(batches):
        table = IntTable(sent.value, np.arange(n))
        found = np.zeros(n * 2 * PROBES, np.int64)
        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            tok, at = tokens_of(part.column("text"))
            ids = table.get(tok)
            same = np.ones(max(len(ids) - 1, 0), bool)
            same[at[1:-1] - 1] = False
            left, right = ids[:-1], ids[1:]
            for here, beside, side in ((right, left, 0), (left, right, PROBES)):
                ok = same & (here >= 0) & (beside >= 0) & (beside < probes)
                found += np.bincount(here[ok] * (2 * PROBES) + side + beside[ok], minlength=len(found))
        task = TaskContext.get().partitionId()
        found = found.reshape(n, 2 * PROBES)
        for block, a in enumerate(range(0, n, BLOCK_ROWS * 4)):
            value = found[a : a + BLOCK_ROWS * 4]
            if value.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([task], pa.int64()), pa.array([value.astype(np.float32).tobytes()], pa.binary()), pa.array([b""], pa.binary())],
                    ["block", "task", "value", "weight"])

    def join(values, weights):
        return np.sum([np.frombuffer(v, np.float32) for v in values], 0, dtype=np.float64).astype(np.float32).tobytes(), b""

    parts = texts.select("text").mapInArrow(run, "block bigint, task bigint, value binary, weight binary")
    out = np.zeros((n, 2 * PROBES), np.float32)
    for row in tree_sum(parts, _tasks(texts), join).select("block", "value").toArrow().to_pylist():
        value = np.frombuffer(row["value"], np.float32).reshape(-1, 2 * PROBES)
        out[row["block"] * BLOCK_ROWS * 4 :][: len(value)] = value
    return out


def _clusters(beside: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A cluster for each row, by k-means of the square roots of neighbour shares, weighted by count."""
    x = np.sqrt(beside / np.maximum(beside.sum(1, keepdims=True), 1))
    weight = counts.astype(np.float64)
    centres = [x[0]]
    gap = np.full(len(x), np.inf)
    for _ in range(min(CLUSTERS, len(x)) - 1):  # the next centre is the row that weighs most by count and distance
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
        centres.append(x[int((gap * weight).argmax())])
    c = np.array(centres)
    for _ in range(12):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        for k in range(len(c)):
            w = weight[near == k]
            if len(w):
                c[k] = (x[near == k] * w[:, None]).sum(0) / w.sum()
    return near


def build_vocabulary(texts: DataFrame, counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    hashes, c = most_frequent(counts, "h", "c", HEAD)
    order = np.lexsort((hashes, -c))
    hashes, c = hashes[order].view(np.uint64), c[order]
    # the end stands for a class of its own whatever its count
    classes = np.full(len(hashes), REST, np.int64)
    if n:
        end_count = counts.where(F.col("h") == int(END.view(np.int64))).agg(F.sum("c")).first()[0] or 0
        others = hashes != END
        hashes, c = np.append(END, hashes[others]), np.append(end_count, c[others])
        classes = np.full(len(hashes), REST, np.int64)
        classes[:SINGLES] = np.arange(min(SINGLES, len(hashes)))
        common = hashes[:COMMON]
        if len(common) > SINGLES:
            beside = _neighbours(texts, common)
            classes[SINGLES : len(common)] = SINGLES + _clusters(beside[SINGLES:], c[SINGLES : len(common)])
    class_tokens = np.bincount(classes, c, CLASSES)
    class_types = np.bincount(classes, minlength=CLASSES).astype(np.float64)
    class_tokens[REST] += n - c.sum()
    class_types[REST] += v - len(hashes)
    return Vocabulary(hashes, c, classes, class_tokens, class_types, n, v)


# ---------------------------------------------------------------- 3. class weights

class Features:
    """Rows of the weight table for every token of a batch."""

    def __init__(self, hashes: np.ndarray):
        self.table = IntTable(hashes, np.arange(len(hashes)))
        names = np.minimum(np.arange(len(hashes) + 2), COMMON).astype(np.uint64)  # beyond COMMON, all alike
        names[-1] = COMMON + 1  # before the first token
        self.rows = [self._row(names, salt) for salt in _SALTS[:3]]

    @staticmethod
    def _row(names: np.ndarray, salt: np.uint64) -> np.ndarray:
        return (mix(names + salt) >> np.uint64(64 - ROW_BITS)).astype(np.int32)

    def __call__(self, tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(index in the head or -1, rows of each feature)."""
        ids = self.table.get(tok)
        known = len(self.rows[0]) - 2
        name = np.where(ids < 0, known, ids)
        start = np.repeat(at[:-1], np.diff(at))
        place = np.arange(len(tok)) - start
        before = []
        for k in (1, 2, 3):
            shifted = np.full(len(tok), known + 1)
            shifted[k:] = name[:-k] if len(tok) > k else name[:0]
            before.append(np.where(place >= k, shifted, known + 1))
        rows = [of[b] for of, b in zip(self.rows, before)]
        one, two = (np.where(b < PAIRED, b, np.where(b == known + 1, PAIRED + 1, PAIRED)) for b in before[:2])
        pair = (one * (PAIRED + 2) + two).astype(np.uint64)
        return ids, [*rows, self._row(pair, _SALTS[3])]


def _class_scores(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = weights.take(rows[0], 0)
    for r in rows[1:]:
        z += weights.take(r, 0)
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def _classes_of(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    return np.where(ids < 0, REST, vocabulary.classes[ids]) if len(vocabulary.classes) else np.full(len(ids), REST)


def _train_round(texts: DataFrame, model: Model) -> Model:
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        features = Features(own.vocabulary.hashes)
        w, bias = own.weights.copy(), own.bias.copy()
        squares, bias_squares = np.full(ROWS, 1e-4, np.float32), np.full(CLASSES, 1e-4, np.float32)
        met, seen = np.zeros(ROWS, np.float32), 0
        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            tok, at = tokens_of(part.column("text"))
            ids, rows = features(tok, at)
            classes = _classes_of(own.vocabulary, ids)
            for a in range(0, len(tok), MINIBATCH):
                here = [r[a : a + MINIBATCH] for r in rows]
                g = np.exp(_class_scores(w, bias, here))
                g /= g.sum(1, keepdims=True)
                g[np.arange(len(g)), classes[a : a + MINIBATCH]] -= 1
                for r in here:
                    order = np.argsort(r.astype(np.uint16), kind="stable")
                    sorted_rows = r[order]
                    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
                    touched = sorted_rows[first]
                    step = np.add.reduceat(g[order], first, 0)
                    times = np.diff(np.append(first, len(r))).astype(np.float32)
                    step /= np.sqrt(times)[:, None]
                    squares[touched] += (step * step).mean(1)
                    w[touched] -= RATE * step / np.sqrt(squares[touched])[:, None]
                    met[touched] += times
                step = g.sum(0) / np.sqrt(len(g))
                bias_squares += step * step
                bias -= RATE * step / np.sqrt(bias_squares)
                seen += len(g)
        task = TaskContext.get().partitionId()
        change = w - own.weights
        rows_out = [(-1, bias - own.bias, np.array([seen], np.float32))] if seen else []
        rows_out += [(b, change[a : a + BLOCK_ROWS], met[a : a + BLOCK_ROWS]) for b, a in enumerate(range(0, ROWS, BLOCK_ROWS)) if met[a : a + BLOCK_ROWS].any()]
        for block, value, weight in rows_out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([task], pa.int64()), pa.array([value.astype(np.float16).tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())],
                ["block", "task", "value", "weight"])

    def join(values, weights):
        """The mean change of each row, weighted by how often it was met."""
        w = [np.frombuffer(x, np.float32) for x in weights]
        total = np.sum(w, 0)
        v = sum(np.frombuffer(x, np.float16).astype(np.float32).reshape(len(k), -1) * k[:, None] for x, k in zip(values, w))
        return (v / np.maximum(total, 1)[:, None]).astype(np.float16).tobytes(), total.tobytes()

    parts = texts.select("text").mapInArrow(run, "block bigint, task bigint, value binary, weight binary")
    weights, bias = model.weights.copy(), model.bias.copy()
    for row in tree_sum(parts, _tasks(texts), join).select("block", "value").toArrow().to_pylist():
        value = np.frombuffer(row["value"], np.float16).astype(np.float32)
        if row["block"] < 0:
            bias += value
        else:
            at = row["block"] * BLOCK_ROWS
            weights[at : at + BLOCK_ROWS] += value.reshape(-1, CLASSES)
    return Model(model.vocabulary, weights, bias)


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """The model of all texts (text, slice bigint: spreads them over the rounds), whose token counts are given."""
    vocabulary = build_vocabulary(texts, counts)
    share = (vocabulary.class_tokens + 1) / (vocabulary.class_tokens + 1).sum() if vocabulary.tokens else np.full(CLASSES, 1 / CLASSES)
    model = Model(vocabulary, np.zeros((ROWS, CLASSES), np.float32), np.log(share).astype(np.float32))
    if vocabulary.tokens:
        for k in range(ROUNDS):
            model = _train_round(texts.where(F.pmod("slice", F.lit(ROUNDS)) == k), model)
    return model


# ---------------------------------------------------------------- scores

def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (id, held_out, text) -> id, held_out, n_tokens, n_known, base_score, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        own = sent.value
        v = own.vocabulary
        features = Features(v.hashes)
        inside = np.log10(v.counts + 1) if len(v.counts) else np.zeros(1)
        smooth = np.log10(np.maximum(v.class_tokens + v.class_types + (np.arange(CLASSES) == REST), 1))
        key = TaskContext.get().partitionId() << 40
        for part in byte_chunks(batches, "text", CHUNK_BYTES):
            tok, at = tokens_of(part.column("text"))
            ids, rows = features(tok, at)
            classes = _classes_of(v, ids)
            of_class = np.empty(len(tok))
            for a in range(0, len(tok), MINIBATCH):
                z = _class_scores(own.weights, own.bias, [r[a : a + MINIBATCH] for r in rows])
                own_z = z[np.arange(len(z)), classes[a : a + MINIBATCH]]
                of_class[a : a + MINIBATCH] = own_z - np.log(np.exp(z).sum(1))
            logs = np.where(ids >= 0, inside[ids], 0)
            add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  no text is without its end
            keys = key + np.arange(part.num_rows)
            key += part.num_rows
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), part.column("id"), part.column("held_out"), pa.nulls(n, pa.int64()), pa.array(np.diff(at)), pa.array(add((ids >= 0).astype(np.int64))),
                 pa.array(add(logs)), pa.array(add(of_class / np.log(10) - smooth[classes]))], names)
            rare = np.flatnonzero(ids < 0)
            m = len(rare)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[np.searchsorted(at, rare, side="right") - 1]), pa.nulls(m, part.column("id").type), pa.nulls(m, pa.bool_()),
                 pa.array(tok[rare].view(np.int64)), none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names)

    names = ["key", "id", "held_out", "h", "n_tokens", "n_known", "logs", "model"]
    kind = f"key bigint, id {id_type.simpleString()}, held_out boolean, h bigint, n_tokens bigint, n_known bigint, logs double, model double"
    # a text's row, and a row for each of its tokens outside the head; the key names the text within this one staged table
    scored = stage(docs.select("id", "held_out", "text").mapInArrow(run, kind), "scored")
    rare = scored.where("h is not null").select("key", "h")
    found = rare.join(counts, "h").groupBy("key").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1)).alias("more"))
    total = model.vocabulary.tokens + model.vocabulary.types + 1
    more = F.coalesce("more", F.lit(0.0))
    return scored.where("h is null").join(found, "key", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(total)))).alias("base_score"),
        (F.col("logs") + more + F.col("model")).alias("score"))


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row: the model learns from the rows
    whose crc32(id as text) mod ``modulus`` isn't ``remainder``."""
    code = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    given = docs.select(F.col(id_col).alias("id"), (F.pmod(code, F.lit(modulus)) == remainder).alias("held_out"), F.floor(code / modulus).alias("slice"), F.col(text_col).cast("string").alias("text"))
    training = given.where(~F.col("held_out")).select("text", "slice")
    counts = stage(token_counts(training), "counts")
    model = train(training, counts)
    out = score(given, model, counts)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
