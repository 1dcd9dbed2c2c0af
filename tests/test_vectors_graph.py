import numpy as np
from pyspark.sql import functions as F

from newslens.operators import eventgraph as G
from newslens.operators import neighbours as NB
from newslens.operators.knn import knn
from newslens.operators.louvain import louvain
from newslens.operators.ward import ward_labels


def _brute(X, ids, k, metric, groups=None):
    out = {}
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True) if metric == "cosine" else X
    for i in range(len(X)):
        d = ((Xn - Xn[i]) ** 2).sum(1)
        d = d / 2 if metric == "cosine" else np.sqrt(d)
        cand = [(round(float(d[j]), 6), int(ids[j])) for j in range(len(X))
                if j != i and (groups is None or groups[j] == groups[i])]
        out[int(ids[i])] = [c[1] for c in sorted(cand)[:k]]
    return out


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(c, 0.3, size=(60, 8)) for c in (0.0, 3.0, -3.0)])
    X[5] = X[6]  # an exact duplicate pair
    ids = np.arange(len(X)) * 3 + 1
    groups = (np.arange(len(X)) % 2).astype(int)
    df = spark.createDataFrame([(int(i), X[j].tolist(), int(groups[j])) for j, i in enumerate(ids)],
                               "id bigint, vec array<double>, g int")
    for metric in ("cosine", "euclidean"):
        got = knn(df, k=7, metric=metric, cell_size=16).collect()
        res = {}
        for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
            res.setdefault(r["qid"], []).append(r["nn_id"])
        assert res == _brute(X, ids, 7, metric)
    got = knn(df, k=5, metric="euclidean", group_col="g", cell_size=16).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        res.setdefault(r["qid"], []).append(r["nn_id"])
    assert res == _brute(X, ids, 5, "euclidean", groups)


def test_knn_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id bigint, vec array<double>")
    got = knn(df, k=30, metric="cosine").collect()
    assert len(got) == 6


def test_louvain_two_cliques_and_isolated(spark):
    edges = []
    for base in (0, 10):
        nodes = range(base, base + 5)
        edges += [(a, b, 1.0) for a in nodes for b in nodes if a < b]
    edges.append((4, 10, 1.0))
    e = spark.createDataFrame(edges, "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(i,) for i in list(range(5)) + list(range(10, 15)) + [99]], "id bigint")
    comm = {r["id"]: r["community"] for r in louvain(nodes, e).collect()}
    assert len({comm[i] for i in range(5)}) == 1 and len({comm[i] for i in range(10, 15)}) == 1
    assert comm[0] != comm[10] and comm[99] == 99
    assign = spark.createDataFrame(list(comm.items()), "id bigint, community bigint")
    q = G.modularity(e, assign).first()["q"]
    m = len(edges)
    expected = 2 * (10 / m - ((2 * 10 + 1) / (2 * m)) ** 2)
    assert abs(q - expected) < 1e-9


def test_ward_threshold_four_points():
    X = np.array([[0.0, 0.0], [0.0, 1.0], [10.0, 0.0], [10.0, 1.0]])
    assert len(set(ward_labels(X, 1.5))) == 2
    assert len(set(ward_labels(X, 0.5))) == 4
    assert len(set(ward_labels(X, 50.0))) == 1


def test_tomek_and_enn(spark):
    pts = [(1, [0.0, 0.0], 0), (2, [0.1, 0.0], 1), (3, [5.0, 5.0], 0), (4, [5.2, 5.0], 0),
           (5, [5.1, 5.3], 0), (6, [9.0, 9.0], 1), (7, [9.2, 9.1], 1), (8, [9.1, 8.8], 1)]
    df = spark.createDataFrame(pts, "id bigint, vec array<double>, label int")
    kept = {r["id"] for r in NB.tomek_keep(df).collect()}
    assert kept == {3, 4, 5, 6, 7, 8}
    enn = {r["id"] for r in NB.enn_keep(df, k=2).collect()}
    assert {3, 4, 5, 6, 7, 8} <= enn and 1 not in enn and 2 not in enn


def test_smote_points_on_segments(spark):
    rows = [(i, [float(i), 0.0], 1) for i in range(10)] + [(100 + i, [0.0, float(i)], 0) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    s = NB.smote(df, k=5).collect()
    assert len(s) == 6 and all(r["label"] == 0 for r in s)
    vec = {r[0]: r[1] for r in rows}
    for r in s:
        p, q = np.array(vec[r["parent_id"]]), np.array(vec[r["nn_id"]])
        assert np.allclose(np.array(r["vec"]), p + r["u"] * (q - p))
        assert 0.0 <= r["u"] < 1.0


def test_edge_weight_guards(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (2, 1, 0.9)], "i bigint, j bigint, cos_sim double")
    nodes = spark.createDataFrame([(1, ["a", "b"], 0), (2, ["a"], 10), (3, [], 5)],
                                  "id bigint, entities array<string>, day int")
    f = G.edge_features(pairs, nodes)
    e = G.weighted_edges(f).collect()
    assert [(r["src"], r["dst"]) for r in e] == [(1, 2)]
    same_day = spark.createDataFrame([(1, ["a"], 3), (2, ["a"], 3)], "id bigint, entities array<string>, day int")
    f2 = G.edge_features(pairs.filter("j != 3"), same_day)
    assert G.weighted_edges(f2).count() == 0  # zero date range -> no edge
    assert G.edge_guard_counts(f2).first()["undefined_weight"] == 2


def test_smote_and_clean(spark):
    """Balanced first, then without the pair of mutual nearest neighbours whose labels differ."""
    far = [(i, [float(i), 0.0], 0) for i in range(6)] + [(10 + i, [float(i), 50.0], 1) for i in range(3)]
    pair = [(20, [200.0, 200.0], 0), (21, [200.0, 200.5], 1)]
    df = spark.createDataFrame(far + pair, "id bigint, vec array<double>, label int")
    made = NB.smote(df, k=2).collect()
    assert len(made) == 3
    rows = [(i, None, v, y) for i, v, y in far + pair] + [(None, r["parent_id"], r["vec"], r["label"]) for r in made]
    near = [min((sum((a - b) ** 2 for a, b in zip(v, w[2])), j) for j, w in enumerate(rows) if j != i)[1] for i, (_, _, v, _) in enumerate(rows)]
    kept = [r for i, r in enumerate(rows) if not (near[near[i]] == i and rows[near[i]][3] != r[3])]
    got = NB.smote_and_clean(df, NB.tomek_keep, k=2).collect()
    assert len({r["key"] for r in got}) == len(got) == len(kept) < len(rows)
    assert {(r["id"], r["parent_id"], tuple(r["vec"]), r["label"]) for r in got} == {(i, p, tuple(v), y) for i, p, v, y in kept}


def test_knn_reads_its_rows_as_a_stream(spark):
    """A task of the search holds its queries and one batch: no plan groups rows, and rows that are no neighbours are left out."""
    rng = np.random.default_rng(5)
    some = np.round(rng.normal(size=(60, 4)), 1)
    data = [(i, [float(x) for x in some[i % 60]]) for i in range(240)] + [(500, None), (501, [float("nan")] * 4)]
    df = spark.createDataFrame(data, "id long, vec array<double>").repartition(3)
    plan = knn(df, k=5, metric="euclidean", cell_size=16)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    whole = {i: np.array(v) for i, v in data[:240]}
    for metric in ("euclidean", "cosine"):
        unit = {i: v / np.linalg.norm(v) for i, v in whole.items()} if metric == "cosine" else whole
        far = {}
        for i, v in unit.items():
            d = {j: ((w - v) ** 2).sum() / 2.0 if metric == "cosine" else np.sqrt(((w - v) ** 2).sum()) for j, w in unit.items() if j != i}
            far[i] = sorted(d, key=lambda j: (round(d[j], 6), j))[:5]
        got = {}
        for r in knn(df, k=5, metric=metric, cell_size=16).collect():
            got.setdefault(r.qid, {})[r["rank"]] = r.nn_id
        assert {i: [n[k] for k in sorted(n)] for i, n in got.items()} == far


def test_modularity_searches_neighbours_once(spark, tmp_path):
    from newslens.plans.graph_q import g10_modularity

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(i % 2, 0.1, 4)], i % 2) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = g10_modularity(spark, str(tmp_path))
    # the edges are read by several sums; no search is left in their plan
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert -0.5 <= found.first().q <= 1


def test_knn_in_groups_finds_what_brute_force_finds(monkeypatch):
    from newslens.operators import knn as K
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(c, 0.4, size=(300, 12)) * np.r_[3.0, 2.0, np.ones(10)] for c in (0.0, 4.0, -9.0)])[rng.permutation(900)]
    X[10:60] = X[9]  # ties
    X[700, 3], ids = np.inf, np.arange(900) * 2
    screened, merge = [], K._Block._merge
    monkeypatch.setattr(K._Block, "_merge", lambda self, i, j, ids, R: screened.append(len(R)) or merge(self, i, j, ids, R))
    monkeypatch.setattr(K, "MANY", 50)
    for metric in ("euclidean", "cosine"):
        del screened[:]
        block = K._Block(6, metric, True)
        block.ask(ids[:699], X[:699])
        for a in range(0, 900, 100):
            block.see(ids[a:a + 100], X[a:a + 100])
        got = {}
        for b in block.answers():
            for q, n, d in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(q, []).append((round(d, 6), n))
        for i in range(0, 699, 7):
            d = ((X - X[i]) ** 2).sum(1)
            d = np.round(d / 2 if metric == "cosine" else np.sqrt(d), 6)
            near = [(d[j], ids[j]) for j in np.lexsort((ids, d)) if j not in (i, 700)][:6]
            assert sorted(got[ids[i]]) == near
        assert min(screened) < 50  # a group skips rows of a batch
