"""Samplers by name, fold-wise training sets, the dense head, leaf-limited trees, result tables."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from newslens.operators import densehead as D
from newslens.operators import grid as GR
from newslens.operators import leafboost as B
from newslens.operators.folds import fold_sets
from newslens.operators.samplers import SAMPLERS, Resampled, resample
from newslens.session import scratch_path


def _table(spark, n=90, classes=2, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(i % 3 == 0) if classes == 2 else min(int(rng.integers(0, 4)), 2)
        x = rng.normal(0, 1, 4) + np.array([2.0 * y, 0, 0, -y])
        rows.append((i, [float(v) for v in x], y, i // 3 % 3 if classes == 2 else int(rng.integers(0, 3))))
    return spark.createDataFrame(rows, "id long, x array<double>, label int, fold int")


def test_samplers_reach_their_counts_and_keep_ids_unique(spark):
    df = _table(spark).withColumnRenamed("x", "vec")
    n = {0: 60, 1: 30}
    wanted = {"none": n, "undersample": {0: 30, 1: 30}, "oversample": {0: 60, 1: 60}, "mixed": {0: 42, 1: 36}, "smote": {0: 60, 1: 60}}
    for name, counts in wanted.items():
        rows, reason = resample(df, name)
        found = rows.collect()
        assert reason is None and len({r.id for r in found}) == len(found)
        assert {y: sum(r.label == y for r in found) for y in (0, 1)} == counts, name
        assert all((r.parent is None) == (r.id >= 0) for r in found)
    for name in ("smotetomek", "smoteenn"):
        rows, reason = resample(df, name)
        found = rows.collect()
        assert reason is None and 60 < len(found) <= 120 and len({r.id for r in found}) == len(found) and any(r.parent is not None for r in found)
    with pytest.raises(KeyError):
        resample(df, "other")


def test_samplers_fall_back(spark, monkeypatch):
    df = _table(spark, 12).withColumnRenamed("x", "vec")
    one = df.where("label = 0")
    assert resample(one, "smote")[1] == "one class" and resample(one, "undersample")[0].count() == one.count()
    flat = df.withColumn("vec", F.array(F.lit(1.0), F.lit(2.0)))
    assert resample(flat, "smoteenn")[1] == "constant features" and resample(flat, "oversample")[1] is None
    monkeypatch.setitem(SAMPLERS, "empty", lambda d, seed: SAMPLERS["none"](d, seed).limit(0))
    monkeypatch.setitem(SAMPLERS, "lost", lambda d, seed: SAMPLERS["none"](d, seed).where("label = 0"))
    monkeypatch.setitem(SAMPLERS, "broken", lambda d, seed: d.select("no_such_column"))
    assert [resample(df, s)[1] for s in ("empty", "lost")] == ["empty result", "a class vanished"]
    rows, reason = resample(df, "broken")
    assert reason.startswith("error") and rows.count() == 12


def test_cleaning_samplers_share_rows_and_neighbours(spark, monkeypatch):
    from newslens.operators import neighbours as N
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(i % 5 == 0, 1.0, 3)], int(i % 5 == 0)) for i in range(80)], "id long, vec array<double>, label int").coalesce(1)
    apart = {n: sorted(map(str, resample(df, n)[0].select("id", "vec", "label", "parent").collect())) for n in ("smoteenn", "smotetomek")}
    searched, knn = [], N.knn
    monkeypatch.setattr(N, "knn", lambda *a, **k: searched.append(1) or knn(*a, **k))
    shared = {}
    for name, rows in apart.items():
        got, reason = resample(df, name, shared=shared)
        assert reason is None and sorted(map(str, got.select("id", "vec", "label", "parent").collect())) == rows
    assert len(searched) == 2  # the minority's neighbours, and those of all rows


def test_resampled_estimator_fits_to_the_balanced_rows(spark):
    df = _table(spark, 60).withColumnRenamed("x", "vec")
    est = Resampled(LogisticRegression(), "undersample", lambda d: d.withColumn("features", array_to_vector("vec")))
    assert est.fit(df).summary.predictions.count() == 40 and est.reason is None


def test_fold_sets_scale_and_balance_the_training_rows_only(spark):
    df = _table(spark)
    sets = fold_sets(df, "undersample", scaled_from=2)
    assert (sets.folds, sets.classes, sets.dim) == ([0, 1, 2], 2, 4)
    given = {r.id: r for r in df.collect()}
    train, valid = sets.training.collect(), sets.validation.collect()
    assert sorted(r.id for r in valid) == sorted(given) and all(given[r.id].fold == r.fold for r in valid)
    for f in (0, 2):
        own = [r for r in train if r.fold == f]
        assert all(given[r.id].fold != f for r in own) and len({sum(r.label == y for r in own) for y in (0, 1)}) == 1
        learned = np.array([r.x for r in given.values() if r.fold != f])
        mean, sd = learned.mean(0), learned.std(0)
        for r in own + [v for v in valid if v.fold == f]:
            x = np.array(given[r.id].x)
            assert np.allclose(r.x[:2], x[:2]) and np.allclose(r.x[2:], ((x - mean) / sd)[2:])
    assert all(r.weight == 1.0 for r in train)


def test_gradient_of_the_head(spark):
    rng = np.random.default_rng(2)
    shapes = D.layer_sizes(5, 3, (7, 4))
    theta = D.initial(shapes, 3)
    x, y, w = rng.normal(size=(20, 5)), rng.integers(0, 3, 20), rng.uniform(0.5, 2, 20)
    masks = [D._mask(np.arange(20), 1, i, b, 0.3, 9) for i, (_, b) in enumerate(shapes[:-1])]
    g, _, total = D.gradient(theta, shapes, x, y, w, masks)
    assert total == pytest.approx(w.sum())
    for i in rng.choice(len(theta), 40, replace=False):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (D.gradient(up, shapes, x, y, w, masks)[1] - D.gradient(down, shapes, x, y, w, masks)[1]) / 2e-6
        assert g[i] == pytest.approx(slope, rel=1e-4, abs=1e-6)
    share = np.mean(D._mask(np.arange(4000), 0, 0, 8, 0.3, 1) == 0)
    assert abs(share - 0.3) < 0.02


def test_distributed_gradient_equals_one_pass_and_the_head_learns(spark):
    sets = fold_sets(_table(spark, 90))
    shapes = D.layer_sizes(sets.dim, sets.classes)
    theta = D.initial(shapes, 1)
    p = {"lr": 0.01, "dropout": 0.1}
    found = D._gradients(sets.training.repartition(5), [(0, p, 0, theta), (1, p, 2, theta)], shapes, 0, 42)
    for number, fold in ((0, 0), (1, 2)):
        rows = sorted(sets.training.where(F.col("fold") == fold).collect(), key=lambda r: r.id)
        ids, x = np.array([r.id for r in rows]), np.array([r.x for r in rows])
        masks = [D._mask(ids, 0, i, b, 0.1, 42) for i, (_, b) in enumerate(shapes[:-1])]
        g, _, total = D.gradient(theta, shapes, x, np.array([r.label for r in rows]), np.array([r.weight for r in rows]), masks)
        assert np.allclose(found[number][0], g / total)
    fits = D.train_grid(sets, [p], epochs=3, steps=4)
    assert len(fits) == 3 and all(f.best_f1 > 0.7 and f.best_classes.keys() == {0, 1} for f in fits)


def _grown(bins, g, h, leaves, depth, min_child, n_bins=B.BINS):
    """Best-first growth on one machine, one leaf at a time: the partition of rows and leaf values."""
    def split(rows):
        hist = np.zeros((3, bins.shape[1], n_bins))
        for j in range(bins.shape[1]):
            for k, w in enumerate((g[rows], h[rows], np.ones(len(rows)))):
                hist[k, j] = np.bincount(bins[rows, j], w, n_bins)
        return B.best_split(hist, min_child)[0]

    open_ = [(split(np.arange(len(g))), np.arange(len(g)), 0)]
    while len(open_) < leaves:
        able = [i for i, (s, _, d) in enumerate(open_) if s.gain > 0 and (depth < 0 or d < depth)]
        if not able:
            break
        i = max(able, key=lambda k: open_[k][0].gain)
        s, rows, d = open_.pop(i)
        goes = bins[rows, s.feature] <= s.bin
        open_ += [(split(rows[goes]), rows[goes], d + 1), (split(rows[~goes]), rows[~goes], d + 1)]
    out = np.zeros(len(g))
    for _, rows, _ in open_:
        out[rows] = -g[rows].sum() / h[rows].sum()
    return out


@pytest.mark.parametrize("driver_bytes", [B.DRIVER_BYTES, 0])
def test_trees_equal_best_first_growth_on_one_machine(spark, monkeypatch, driver_bytes):
    monkeypatch.setattr(B, "DRIVER_BYTES", driver_bytes)
    sets = fold_sets(_table(spark, 150, classes=3, seed=4))
    params = [{"learning_rate": 0.1, "num_leaves": 6, "max_depth": -1}, {"learning_rate": 0.3, "num_leaves": 9, "max_depth": 2}]
    fits = B.boost_grid(sets, params, trees=2, min_child=5)
    assert len(fits) == 6 and all(len(f.trees) == 2 and len(f.trees[0]) == 3 for f in fits)
    for fit in fits[:2] + fits[3:5]:
        rows = sets.training.where(F.col("fold") == fit.fold).collect()
        bins, y = B._binned(np.array([r.x for r in rows]), fit.edges), np.array([r.label for r in rows])
        margins = np.zeros((len(rows), 3))
        for trees in fit.trees:
            g, h = B.derivatives(margins, y)
            for k, tree in enumerate(trees):
                value = fit.params["learning_rate"] * _grown(bins, g[:, k], h[:, k], fit.params["num_leaves"], fit.params["max_depth"], 5)
                assert np.allclose(tree[4][B.descend(tree, bins)], value)
                margins[:, k] += value
            assert max(len(t[0]) for t in trees) <= 2 * fit.params["num_leaves"] - 1


def test_a_fit_of_one_chunk_sends_lines_and_chunks_grow_the_same_trees(spark, monkeypatch):
    sets = fold_sets(_table(spark, 150, classes=3, seed=4))
    params = [{"learning_rate": 0.1, "num_leaves": 6, "max_depth": -1}, {"learning_rate": 0.3, "num_leaves": 9, "max_depth": 2}]
    read, histograms = [], B._histograms

    def watched(state, *rest):
        read.append(state)
        return histograms(state, *rest)

    monkeypatch.setattr(B, "_histograms", watched)
    whole = B.boost_grid(sets, params, trees=2, min_child=5)
    # a fit's rows of its own fold, no rows of other fits beside them
    rows = {r.fit: r.n for r in read[0].groupBy("fit").agg(F.sum(F.octet_length("label") / 4).cast("long").alias("n")).collect()}
    of = {r.fold: r.n for r in sets.training.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert rows == {i: of[fit.fold] for i, fit in enumerate(whole)}
    assert read[0].withColumn("task", F.spark_partition_id()).groupBy("fit").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] == 1
    chunked = B.boost_grid(sets, params, trees=2, min_child=5, chunk_rows=40)
    for a, b in zip(whole, chunked):
        for x, y in zip(a.trees, b.trees, strict=True):
            assert all(np.allclose(u, v) for s, t in zip(x, y, strict=True) for u, v in zip(s, t, strict=True))


def test_fits_of_one_chunk_take_no_job_a_pass(spark, monkeypatch):
    sets = fold_sets(_table(spark, 120))
    params = [{"learning_rate": 0.3, "num_leaves": 4, "max_depth": -1}, {"learning_rate": 0.1, "num_leaves": 3, "max_depth": 1}]
    passes, histograms = [], B._histograms
    monkeypatch.setattr(B, "_histograms", lambda *a: passes.append(1) or histograms(*a))
    monkeypatch.setattr(B, "_added", None)
    fits = B.boost_grid(sets, params, trees=7, min_child=5)
    assert len(passes) == 1 and len(fits) == 6 and all(len(f.trees) == 7 and f.open for f in fits)


def test_binary_trees_learn_and_a_constant_table_stops(spark):
    sets = fold_sets(_table(spark, 120))
    fits = B.boost_grid(sets, [{"learning_rate": 0.3, "num_leaves": 4, "max_depth": -1}], trees=6, min_child=5)
    assert all(f1 > 0.6 for _, f1, _ in B.judge(sets, fits).values())
    flat = fold_sets(_table(spark, 60).withColumn("x", F.array(F.lit(1.0))))
    stopped = B.boost_grid(flat, [{"learning_rate": 0.3, "num_leaves": 4, "max_depth": -1}], trees=5)
    assert all(not f.open and not f.trees for f in stopped) and len(B.judge(flat, stopped)) == 3


def test_results_are_written_once_and_summed_up(spark):
    path = scratch_path(spark, "grid")
    calls = []

    def make(params):
        calls.append(len(params))
        return [("e", f"lr={p['lr']}", f, 0.5 + 0.1 * f, 0.4, {0: 0.3, 1: 0.5 + f} if f else {0: 0.6}, 1, None) for p in params for f in (0, 1)]

    first = GR.run_grid(spark, make, [{"lr": 1}], "e", [0, 1], path)
    assert first.count() == 2
    GR.write_results(first, path)  # a part that is run again replaces itself
    both = GR.run_grid(spark, make, [{"lr": 1}, {"lr": 2}], "e", [0, 1], path)
    assert calls == [1, 1] and both.count() == 4 and GR.run_grid(spark, make, [{"lr": 2}], "e", [0, 1], path).count() == 4 and calls == [1, 1]
    s = {r.params_key: r for r in GR.summary(both).collect()}
    assert s.keys() == {"lr=1", "lr=2"} and s["lr=1"].acc_folds == [0.5, 0.6] and s["lr=1"].f1_class_folds == [[0.6], [0.3, 1.5]]
    assert s["lr=2"].mean_f1_class == {0: pytest.approx(0.45), 1: 1.5} and s["lr=2"].std_acc == pytest.approx(0.05)
