from collections import Counter

from pyspark.sql import functions as F

from newslens.operators import balance as R
from newslens.operators import labels as B
from newslens.operators import validate as V
from newslens.operators.common import hash_rank


def _labelled(spark, n_pos=40, n_neg=9, parts=3):
    rows = [(i, 1) for i in range(n_pos)] + [(1000 + i, 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "doc_id bigint, label int").repartition(parts)


def test_multihot_strict_and_normalised(spark):
    d = spark.createDataFrame([("1",), ("1,3",), ("1, 2",), ("1.0",), (None,)], "bias_type string")
    norm = [tuple(r[f"label_{n}"] for n in range(1, 6)) for r in B.multi_hot(d).collect()]
    strict = [tuple(r[f"label_{n}"] for n in range(1, 6)) for r in B.multi_hot(d, strict=True).collect()]
    assert norm == [(1, 0, 0, 0, 0), (1, 0, 1, 0, 0), (1, 1, 0, 0, 0), (1, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    assert strict[2] == (1, 0, 0, 0, 0) and strict[3] == (0, 0, 0, 0, 0)


def test_orientation_boundaries(spark):
    d = spark.createDataFrame([(-1.0,), (-0.5,), (0.0,), (0.5,), (0.51,), (None,)], "b double")
    assert [r[0] for r in d.select(B.orientation("b")).collect()] == [2, 0, 0, 0, 1, 0]


def test_standardise_population_sigma(spark):
    d = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, x double, c double")
    z = {r["id"]: (r["z_x"], r["z_c"]) for r in B.standardise(d, ["x", "c"]).collect()}
    assert z == {1: (-1.0, 0.0), 2: (1.0, 0.0)}


def test_hash_rank_is_partition_independent(spark):
    d = _labelled(spark)
    ranks = []
    for parts in (1, 4, 7):
        r = hash_rank(d.repartition(parts), "doc_id", ["label"], 42).select("doc_id", "hrank").collect()
        ranks.append(sorted((x[0], x[1]) for x in r))
    assert ranks[0] == ranks[1] == ranks[2]
    by_label = Counter()
    for doc, rk in ranks[0]:
        by_label[doc >= 1000] += 1
    assert sorted(rk for doc, rk in ranks[0] if doc >= 1000) == list(range(9))


def test_undersample_subset_equal_counts(spark):
    d = _labelled(spark)
    u = R.undersample(d)
    c = Counter(r["label"] for r in u.collect())
    assert c == {0: 9, 1: 9}
    assert u.join(d, ["doc_id", "label"], "left_anti").count() == 0


def test_oversample_and_mixed(spark):
    d = _labelled(spark)
    o = Counter(r["label"] for r in R.oversample(d).collect())
    assert o == {0: 40, 1: 40}
    m = Counter(r["label"] for r in R.mixed_balance(d).collect())
    assert m == {1: int(0.7 * 40), 0: int(0.6 * 40)}


def test_stratified_folds_balanced(spark):
    f = R.stratified_folds(_labelled(spark))
    c = Counter((r["label"], r["fold"]) for r in f.collect())
    for lab in (0, 1):
        sizes = [c[(lab, k)] for k in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_f1_with_absent_class(spark):
    d = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 2)], "label int, pred int")
    pc = {r["class"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in V.per_class_metrics(d).collect()}
    assert pc[0] == (2, 1, 0, 0.8) and pc[1] == (0, 0, 2, 0.0) and pc[2] == (0, 1, 0, 0.0)
    s = V.summary_metrics(d).first()
    assert abs(s["acc"] - 0.5) < 1e-12 and abs(s["f1_macro"] - 0.8 / 3) < 1e-12


def test_pending_grid_and_best(spark):
    folds = spark.createDataFrame([(0,), (1,), (2,)], "fold int")
    finished = spark.createDataFrame([("a", 0), ("a", 1)], "params_key string, fold int")
    p = {(r[0], r[1]) for r in V.pending_grid(folds, ["a", "b"], finished).collect()}
    assert p == {("a", 2), ("b", 0), ("b", 1), ("b", 2)}
    res = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "params_key string, f1_macro double")
    assert tuple(V.best_params(res).first()) == ("a", 0.5)


def test_hash_rank_exact_under_skew(spark):
    import hashlib
    rows = [(i, 0 if i % 10 else 1) for i in range(3000)]  # class 0 holds 90% of the rows
    d = spark.createDataFrame(rows, "doc_id bigint, label int").repartition(5)
    got = {r["doc_id"]: r["hrank"] for r in hash_rank(d, "doc_id", ["label"], 42).collect()}
    want = {}
    for lab in (0, 1):
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, l in rows if l == lab)
        want.update({i: r for r, (_, i) in enumerate(ids)})
    assert got == want
    glob = {r["doc_id"]: r["hrank"] for r in hash_rank(d, "doc_id", [], 42).collect()}
    order = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, _ in rows)
    assert glob == {i: r for r, (_, i) in enumerate(order)}
