"""Gradient-boosted trees grown best-first to a number of leaves (V4), on histograms that Spark sums.

What MLlib's boosted trees lack: a leaf count instead of a depth, second-order gains, and more than two classes (a tree for each
class and round, on the softmax). Features are cut into at most BINS bins by quantiles of the training rows. All fits of a grid
(parameter sets x folds) grow their next trees together, so a grid costs as many Spark jobs as its slowest fit.

A tree grows in passes. A pass runs the best-first choice - always split the leaf of largest gain - on what is known, noting the
leaves whose split it would make but whose children it hasn't seen; then one job computes the histograms of those children for
all fits. When nothing new is asked for, the choice was exact, and the tree is done; so a tree takes about as many jobs as it is
deep, not as it has leaves.

Each fit has its own copy of its fold's rows (bins and margins, a few bytes each), dealt once into chunks of at most CHUNK_ROWS
rows; a chunk is always read by one task, as a few rows of packed arrays. A task sums gradients by (output, node, feature, bin)
over its chunk, batch by batch. A fit of one chunk finds its best splits there: once a job over the roots has told which fits can
grow at all, all its trees are grown within the task, by the same passes, and one job does for the grid. The histograms of more
chunks are summed by node in Spark, a job a pass. So what is shuffled in a pass grows with the chunks, one for each CHUNK_ROWS
rows, and is nothing below that. (While the histograms of all chunks are below DRIVER_BYTES, the driver adds
them itself, in the same order of operations; that saves a shuffle a pass.)

Margins stay with their rows; each round adds the last trees' values in the pass that opens the next round. They are persisted,
and cut from their lineage every CHECKPOINT rounds, so a lost executor replays a few rounds and no more.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.operators.densehead import scores
from newslens.operators.folds import FoldSets
from newslens.session import materialize

# --- fixed values: grid and defaults ---------------------------------------------------------------------
GRID = {"learning_rate": [0.05, 0.1], "num_leaves": [15, 31], "max_depth": [-1, 5]}
TREES, MIN_CHILD, MIN_HESSIAN = 100, 10, 1e-3
# --- end fixed values ------------------------------------------------------------------------------------
BINS = 255
CHECKPOINT = 20
#: Rows of a fit whose histograms one task sums; and rows for which a task of its own is worth while.
CHUNK_ROWS, ROWS_PER_TASK = 1 << 18, 5000
DRIVER_BYTES = 64 << 20


@dataclass
class Split:
    """The best split of a node: bins up to ``bin`` of ``feature`` go left. No split: gain 0."""
    gain: float = 0.0
    feature: int = -1
    bin: int = -1


@dataclass
class Node:
    depth: int
    g: float
    h: float
    n: int
    split: Split
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """What is known of a growing tree; node 0 is the root. ``expanded`` are the nodes that the finished tree splits."""
    nodes: dict[int, Node] = field(default_factory=dict)
    expanded: set[int] = field(default_factory=set)

    def arrays(self, rate: float) -> tuple[np.ndarray, ...]:
        """(feature or -1, bin, left, right, value) of the finished tree's nodes."""
        order = [0]
        for i in order:
            if i in self.expanded:
                order += [self.nodes[i].left, self.nodes[i].right]
        at = {i: k for k, i in enumerate(order)}
        feature, bins, left, right, value = (np.zeros(len(order), t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64))
        for k, i in enumerate(order):
            node = self.nodes[i]
            if i in self.expanded:
                feature[k], bins[k], left[k], right[k] = node.split.feature, node.split.bin, at[node.left], at[node.right]
            else:
                feature[k], value[k] = -1, -rate * node.g / node.h if node.h > 0 else 0.0
        return feature, bins, left, right, value


def best_first(tree: Tree, leaves: int, max_depth: int) -> tuple[set[int], list[int]]:
    """(nodes split, nodes among them whose children aren't known): the leaf of largest gain first, of equal ones the older."""
    done: set[int] = set()
    unknown: list[int] = []
    queue: list[tuple[float, int]] = []

    def offer(i: int) -> None:
        node = tree.nodes[i]
        if node.split.gain > 0 and (max_depth < 0 or node.depth < max_depth):
            heapq.heappush(queue, (-node.split.gain, i))

    offer(0)
    while queue and len(done) < leaves - 1:
        _, i = heapq.heappop(queue)
        done.add(i)
        node = tree.nodes[i]
        if node.left < 0:
            unknown.append(i)
        else:
            offer(node.left)
            offer(node.right)
    return done, unknown


def best_split(histogram: np.ndarray, min_child: int = MIN_CHILD, min_hessian: float = MIN_HESSIAN) -> tuple[Split, float, float, int]:
    """(best split, sum of gradients, of hessians, rows) of a node's histogram (3, features, bins)."""
    g, h, n = histogram
    total_g, total_h, total_n = float(g[0].sum()), float(h[0].sum()), int(round(n[0].sum()))
    left_g, left_h, left_n = (np.cumsum(a, axis=1)[:, :-1] for a in (g, h, n))
    right_g, right_h, right_n = total_g - left_g, total_h - left_h, total_n - left_n
    fair = (left_n >= min_child - 0.5) & (right_n >= min_child - 0.5) & (left_h >= min_hessian) & (right_h >= min_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fair, left_g**2 / left_h + right_g**2 / right_h - total_g**2 / total_h, 0.0)
    gain = np.round(gain, 12)  # equal gains of equal partitions stay equal, whatever the order of the sums
    at = int(gain.argmax()) if gain.size else 0
    if not gain.size or not gain.flat[at] > 0:
        return Split(), total_g, total_h, total_n
    feature, bin_ = divmod(at, gain.shape[1])
    return Split(float(gain.flat[at]), feature, bin_), total_g, total_h, total_n


def descend(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node of a tree (feature or -1, bin, left, right, ...) that each row ends in."""
    feature, cut, left, right = tree[:4]
    at = np.zeros(len(bins), np.int64)
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        here = at[rows]
        goes = bins[rows, feature[here]] <= cut[here]
        at[rows] = np.where(goes, left[here], right[here])
        rows = rows[feature[at[rows]] >= 0]
    return at


def derivatives(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians (rows, outputs) of the logistic loss (one output) or the softmax (one for each class)."""
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins))
        return p - y[:, None], p * (1.0 - p)
    e = np.exp(margins - margins.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    k = margins.shape[1]
    return p - (np.arange(k) == y[:, None]), k / (k - 1.0) * p * (1.0 - p)


def bin_edges(rows: DataFrame, dim: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each component's bins but the last: quantiles of the rows; each at most once."""
    if not dim:
        return []
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"q{i}") for i in range(dim)],
                     *[F.max(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(dim)]).first()  # bins numbers a component
    return [np.unique([v for v in (found[f"q{i}"] or []) if v < found[f"m{i}"]]) for i in range(dim)]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], 1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


@dataclass
class Fit:
    params: dict
    fold: int
    edges: list[np.ndarray]
    trees: list[list[tuple[np.ndarray, ...]]] = field(default_factory=list)  # by round and output
    open: bool = True


def _dealt(sets: FoldSets, edges: dict[int, list[np.ndarray]], places: int, outputs: int, chunks: int, parts: int) -> DataFrame:
    """Every fit's training rows, in parts that hold whole chunks: (part, fit, first, label, bins, margins), a row for a batch of
    a fit's rows, with their labels, bins and margins (zeros) as bytes. The fit of parameter set p and the f-th fold is p x folds + f."""
    at = {f: i for i, f in enumerate(sets.folds)}

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                if int(fold) in at:
                    bins = _binned(np.stack(part["x"].to_list()), edges[int(fold)])
                    yield pd.DataFrame({"at": at[int(fold)], "row": part["row"], "label": part["label"], "bins": [b.tobytes() for b in bins]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (part, fit), rows in pdf.groupby(["part", "fit"]):
                yield pd.DataFrame({"part": [part], "fit": [fit], "first": [rows["row"].iat[0]], "label": [rows["label"].to_numpy(np.int32).tobytes()],
                                    "bins": [b"".join(rows["bins"])], "margins": [bytes(8 * outputs * len(rows))]})

    rows = sets.training.select("fold", "x", "label", F.monotonically_increasing_id().alias("row"))
    rows = rows.mapInPandas(binned, "at int, row long, label int, bins binary")
    fits = F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda p: (p * len(sets.folds) + F.col("at")).cast("int"))
    rows = rows.select(F.explode(fits).alias("fit"), "row", "label", "bins")
    rows = rows.select(F.pmod(F.col("fit") * chunks + F.pmod("row", F.lit(chunks)), F.lit(parts)).cast("int").alias("part"), "fit", "row", "label", "bins")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("fit", "row")
    return rows.mapInPandas(packed, "part int, fit int, first long, label binary, bins binary, margins binary")


def _kept(state: DataFrame, parts: int) -> DataFrame:
    """State cut from its lineage, each part in one task."""
    return materialize(state).repartitionById(parts, F.col("part")).sortWithinPartitions("fit", "first").persist()


def _arrays(row, dim: int, outputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, bins, margins) of a batch of rows."""
    y = np.frombuffer(row.label, np.int32)
    return y, np.frombuffer(row.bins, np.uint8).reshape(len(y), dim), np.frombuffer(row.margins).reshape(len(y), outputs)


def _added(state: DataFrame, trees: dict[int, list[tuple]], dim: int) -> DataFrame:
    """State with the values of new trees added: fit -> its tree for each output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                new = trees.get(row.fit)
                if new:
                    _, bins, margins = _arrays(row, dim, len(new))
                    out.append((margins + np.stack([tree[4][descend(tree, bins)] for tree in new], 1)).tobytes())
                else:
                    out.append(row.margins)
            yield pdf.assign(margins=out)

    return state.mapInPandas(run, state.schema)


def _sums(held: np.ndarray, g: np.ndarray, h: np.ndarray, tree: tuple, nodes: list[int], bins: int) -> np.ndarray:
    """Histograms (nodes, 3, features, bins) of the rows that a partial tree brings to each of the nodes."""
    slot = np.full(len(tree[0]), -1)
    slot[nodes] = np.arange(len(nodes))
    slot = slot[descend(tree, held)]
    rows = np.flatnonzero(slot >= 0)
    total = np.zeros((len(nodes), 3, held.shape[1], bins))
    for j in range(held.shape[1]):
        cell = slot[rows] * bins + held[rows, j]
        for k, w in enumerate((g[rows], h[rows], None)):
            total[:, k, j] = np.bincount(cell, w, len(nodes) * bins).reshape(len(nodes), bins)
    return total


def _histograms(state: DataFrame, chunks: int, asked: dict[int, list[tuple[int, tuple, list[int]]]], dim: int, bins: int, outputs: int, min_child: int) -> dict:
    """fit -> [(output, partial tree, nodes)]; returns (fit, output, node) -> (split, g, h, n)."""
    lines = "fit int, output int, node int, gain double, feature int, bin int, g double, hs double, n long"

    def line(key: tuple, histogram: np.ndarray) -> dict:
        split, g, h, n = best_split(histogram, min_child)
        return {"fit": key[0], "output": key[1], "node": key[2], "gain": split.gain, "feature": split.feature, "bin": split.bin, "g": g, "hs": h, "n": n}

    def summed(batches: Iterator[pd.DataFrame]) -> dict[tuple[int, int, int], np.ndarray]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for pdf in batches:
            for row in pdf.itertuples():
                of = asked.get(row.fit, [])
                if not of:
                    continue
                y, held, margins = _arrays(row, dim, outputs)
                slopes = derivatives(margins, y)
                for output, tree, nodes in of:
                    total = _sums(held, slopes[0][:, output], slopes[1][:, output], tree, nodes, bins)
                    for i, node in enumerate(nodes):
                        key = (row.fit, output, node)
                        sums[key] = sums[key] + total[i] if key in sums else total[i]
        return sums

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [line(key, histogram) for key, histogram in summed(batches).items()]
        if found:
            yield pd.DataFrame(found)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, histogram in summed(batches).items():
            yield pd.DataFrame({"fit": [key[0]], "output": [key[1]], "node": [key[2]], "h": [histogram.tobytes()]})

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["fit"].iat[0], pdf["output"].iat[0], pdf["node"].iat[0]
        return pd.DataFrame([line(key, np.sum([np.frombuffer(b).reshape(3, dim, bins) for b in pdf["h"]], axis=0))])

    if chunks == 1:  # a fit's rows are in one task
        found = state.mapInPandas(whole, lines)
    else:
        parts = state.mapInPandas(partial, "fit int, output int, node int, h binary")
        if chunks * sum(len(x[2]) for of in asked.values() for x in of) * 3 * dim * bins * 8 <= DRIVER_BYTES:
            sums: dict[tuple[int, int, int], list[bytes]] = {}
            for r in parts.collect():
                sums.setdefault((r.fit, r.output, r.node), []).append(r.h)
            return {key: best_split(np.sum([np.frombuffer(b).reshape(3, dim, bins) for b in blobs], axis=0), min_child) for key, blobs in sums.items()}
        found = parts.groupBy("fit", "output", "node").applyInPandas(reduce, lines)
    return {(r.fit, r.output, r.node): (Split(r.gain, r.feature, r.bin), r.g, r.hs, r.n) for r in found.collect()}  # a line for each node


def _partial(tree: Tree, asked: list[int]) -> tuple[tuple[np.ndarray, ...], list[int]]:
    """The known tree as arrays, in which the children of the asked nodes are leaves; and those children."""
    for i in asked:
        node = tree.nodes[i]
        if node.left < 0:
            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
            for child in (node.left, node.right):
                tree.nodes[child] = Node(node.depth + 1, 0.0, 0.0, 0, Split())
    n = len(tree.nodes)
    feature, cut, left, right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, node in tree.nodes.items():
        if node.left >= 0:
            feature[i], cut[i], left[i], right[i] = node.split.feature, node.split.bin, node.left, node.right
    return (feature, cut, left, right), [c for i in asked for c in (tree.nodes[i].left, tree.nodes[i].right)]


def _trees_within(batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], params: dict, trees: int, bins: int, min_child: int) -> list[list[tuple[np.ndarray, ...]]]:
    """All trees of a fit from its (labels, bins, margins), by round and output; the sums are those of the passes of a grid."""
    outputs, out = batches[0][2].shape[1], []
    while len(out) < trees:
        slopes = [derivatives(margins, y) for y, _, margins in batches]
        growing = [Tree({0: Node(0, 0.0, 0.0, 0, Split())}) for _ in range(outputs)]
        ask = {k: (_partial(tree, [])[0], [0]) for k, tree in enumerate(growing)}
        while ask:
            for k, (arrays, nodes) in ask.items():
                total = None
                for (_, held, _), (g, h) in zip(batches, slopes):
                    some = _sums(held, g[:, k], h[:, k], arrays, nodes, bins)
                    total = some if total is None else total + some
                for node, histogram in zip(nodes, total):
                    at = growing[k].nodes[node]
                    at.split, at.g, at.h, at.n = best_split(histogram, min_child)
            ask = {}
            for k, tree in enumerate(growing):
                tree.expanded, unknown = best_first(tree, params["num_leaves"], params["max_depth"])
                if unknown:
                    ask[k] = _partial(tree, unknown)
        if not any(t.expanded for t in growing):
            break  # no later round would find a split either
        out.append([t.arrays(params["learning_rate"]) for t in growing])
        batches = [(y, held, margins + np.stack([tree[4][descend(tree, held)] for tree in out[-1]], 1)) for y, held, margins in batches]
    return out


def _grown_within(state: DataFrame, fits: list[Fit], trees: int, dim: int, bins: int, outputs: int, min_child: int) -> dict[int, list]:
    """number of a fit -> all its trees, for the open fits; each has its rows in one task, one after the other."""
    params = {i: fit.params for i, fit in enumerate(fits) if fit.open}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, held = None, []

        def grown():
            return pd.DataFrame({"fit": [fit], "trees": [pickle.dumps(_trees_within(held, params[fit], trees, bins, min_child))]})

        for pdf in batches:
            for row in pdf.itertuples():
                if row.fit != fit:
                    if held:
                        yield grown()
                    fit, held = row.fit, []
                if row.fit in params:
                    held.append(_arrays(row, dim, outputs))
        if held:
            yield grown()

    return {r.fit: pickle.loads(r.trees) for r in state.mapInPandas(run, "fit int, trees binary").collect()}  # a few KB a tree


def boost_grid(sets: FoldSets, params: list[dict], trees: int = TREES, min_child: int = MIN_CHILD, bins: int = BINS,
               chunk_rows: int = CHUNK_ROWS) -> list[Fit]:
    """Every parameter set (learning_rate, num_leaves, max_depth) on every fold, in step."""
    outputs = 1 if sets.classes <= 2 else sets.classes
    edges = {f: bin_edges(sets.training.filter(F.col("fold") == f), sets.dim, bins) for f in sets.folds}
    fits = [Fit(p, f, edges[f]) for p in params for f in sets.folds]
    sizes = [r["n"] for r in sets.training.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    chunks = max(1, math.ceil(max(sizes, default=0) / chunk_rows))
    # the trees of a fit of one chunk are the work of one task, however few its rows
    parts = max(1, len(fits) if chunks == 1 else min(len(fits) * chunks, max(2, sum(sizes) * len(params) // ROWS_PER_TASK)))
    state = _kept(_dealt(sets, edges, len(params), outputs, chunks, parts), parts)
    last, persisted = None, [state]
    if chunks == 1 and fits and trees:
        roots = {i: [(k, _partial(Tree({0: Node(0, 0.0, 0.0, 0, Split())}), [])[0], [0]) for k in range(outputs)] for i in range(len(fits))}
        able = {i for (i, _, _), (split, *_) in _histograms(state, chunks, roots, sets.dim, bins, outputs, min_child).items() if split.gain > 0}
        for i, fit in enumerate(fits):
            fit.open = i in able
        for i, own in (_grown_within(state, fits, trees, sets.dim, bins, outputs, min_child) if able else {}).items():
            fits[i].trees, fits[i].open = own, len(own) == trees
        state.unpersist()
        return fits
    for rnd in range(trees):
        if last:
            state = _added(state, last, sets.dim)
            state = state.persist() if rnd % CHECKPOINT else _kept(state, parts)
            persisted.append(state)
        growing = {(i, k): Tree({0: Node(0, 0.0, 0.0, 0, Split())}) for i, fit in enumerate(fits) if fit.open for k in range(outputs)}
        ask: dict[tuple[int, int], tuple[tuple, list[int]]] = {key: _partial(tree, []) for key, tree in growing.items()}
        ask = {key: (arrays, [0]) for key, (arrays, _) in ask.items()}
        while ask:
            by_fit: dict[int, list] = {}
            for (i, k), (arrays, nodes) in ask.items():
                by_fit.setdefault(i, []).append((k, arrays, nodes))
            found = _histograms(state, chunks, by_fit, sets.dim, bins, outputs, min_child)
            for (i, k, node), (split, g, h, n) in found.items():
                at = growing[i, k].nodes[node]
                at.split, at.g, at.h, at.n = split, g, h, n
            ask = {}
            for key, tree in growing.items():
                p = fits[key[0]].params
                tree.expanded, unknown = best_first(tree, p["num_leaves"], p["max_depth"])
                if unknown:
                    ask[key] = _partial(tree, unknown)
        for old in persisted[:-1]:
            old.unpersist()
        persisted = persisted[-1:]
        last = {}
        for i, fit in enumerate(fits):
            if not fit.open:
                continue
            own = [growing[i, k] for k in range(outputs)]
            if not any(t.expanded for t in own):
                fit.open = False  # no later round would find a split either
                continue
            finished = [t.arrays(fit.params["learning_rate"]) for t in own]
            fit.trees.append(finished)
            last[i] = finished
        if not last:
            break
    for old in persisted:
        old.unpersist()
    return fits


def predictions(rows: DataFrame, fits: list[Fit], outputs: int) -> DataFrame:
    """rows (fold, id, x, label) -> (fit, id, label, pred) for every fit of the row's fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x = np.stack(part["x"].to_list())
                for i, fit in enumerate(fits):
                    if fit.fold == fold:
                        held, margins = _binned(x, fit.edges), np.zeros((len(x), outputs))
                        for rnd in fit.trees:
                            for k, tree in enumerate(rnd):
                                margins[:, k] += tree[4][descend(tree, held)]
                        pred = (margins[:, 0] > 0).astype(int) if outputs == 1 else margins.argmax(1)
                        yield pd.DataFrame({"fit": i, "id": part["id"], "label": part["label"], "pred": pred})

    return rows.mapInPandas(run, "fit int, id long, label int, pred int")


def judge(sets: FoldSets, fits: list[Fit]) -> dict[int, tuple[float, float, dict[int, float]]]:
    """fit -> (accuracy, macro F1, F1 by class) on the fit's validation fold."""
    return scores(predictions(sets.validation, fits, 1 if sets.classes <= 2 else sets.classes))
