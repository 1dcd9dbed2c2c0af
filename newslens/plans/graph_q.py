"""Queries for vectors (E*), the event graph (G*) and neighbour-based resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.operators import knn as K
from newslens.plans.registry import finish, query, r6
from newslens.session import materialize
from newslens.sources.tables import embeddings, table

K_NN = 30

VEC_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v)"""


def sq_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


KNN_SQL = f"""{VEC_SQL},
pairs AS (SELECT a.vec_id, b.vec_id AS nn_id, {sq_sql('a.u', 'b.u')} / 2.0 AS dist FROM u a, u b WHERE a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 6), nn_id) AS rank FROM pairs)
        WHERE rank <= {K_NN})"""


def _emb(spark, sf):
    return embeddings(spark, sf)


def _knn(spark, sf, k=K_NN):
    return K.knn(_emb(spark, sf), k=k, id_col="vec_id", vec_col="embedding", metric="cosine")


@query("e4_knn", f"WITH {KNN_SQL} SELECT vec_id, rank::BIGINT AS rank, nn_id, {r6('1.0 - dist')} AS cos_sim FROM knn")
def e4_knn(spark, sf):
    n = _knn(spark, sf)
    return finish(n.select(F.col("qid").alias("vec_id"), "rank", "nn_id", (1.0 - F.col("dist")).alias("cos_sim")))


# ---------------- event graph ----------------

from newslens.operators import eventgraph as G  # noqa: E402
from newslens.operators import entities as E  # noqa: E402
from newslens.plans.nlp_q import ENTS_CTE  # noqa: E402
from newslens.sources.tables import article_view, documents  # noqa: E402

FRAME_SQL = f"""{ENTS_CTE}, {VEC_SQL},
fr AS (SELECT u.vec_id AS id, u.label, u.u, (DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER)) - DATE '1970-01-01' AS day
       FROM u JOIN documents d ON d.doc_id = u.vec_id),
es AS (SELECT doc_id AS id, list(entity ORDER BY entity) AS ents FROM ents GROUP BY doc_id),
nd AS (SELECT fr.id, fr.label, fr.u, fr.day, coalesce(es.ents, []::VARCHAR[]) AS ents FROM fr LEFT JOIN es USING (id)),
fpairs AS (SELECT a.id AS i, b.id AS j, {sq_sql('a.u', 'b.u')} / 2.0 AS dist FROM nd a, nd b WHERE a.id <> b.id),
fknn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(dist, 6), j) AS rank FROM fpairs)
         WHERE rank <= {K_NN}),
ex AS (SELECT id, unnest(ents) AS entity FROM nd),
dfq AS (SELECT entity, count(*) AS df FROM ex GROUP BY entity),
sc AS (SELECT ex.id, sum(ln((SELECT count(*) FROM nd) / (1.0 + dfq.df))) AS s FROM ex JOIN dfq USING (entity) GROUP BY ex.id),
nds AS (SELECT nd.*, coalesce(sc.s, 0.0) AS s FROM nd LEFT JOIN sc USING (id)),
rng AS (SELECT max(day) - min(day) AS r FROM nd),
feat AS (SELECT k.i, k.j, 1.0 - k.dist AS cos_sim,
           len(list_intersect(a.ents, b.ents)) / (len(list_distinct(list_concat(a.ents, b.ents))) + 1e-6) AS jaccard,
           CASE WHEN rng.r = 0 THEN NULL ELSE 1.0 - abs(a.day - b.day) / rng.r::DOUBLE END AS t_norm,
           (a.s + b.s) / 2.0 AS tfidf, len(a.ents) > 0 AND len(b.ents) > 0 AS has_ents
         FROM fknn k JOIN nds a ON a.id = k.i JOIN nds b ON b.id = k.j, rng),
wt AS (SELECT *, (0.5 * jaccard + 0.4 * cos_sim + 0.1 * t_norm)
                 * (1.0 + CASE WHEN 1.0 + tfidf > 0 THEN ln(1.0 + tfidf) END) AS w FROM feat WHERE has_ents),
edges AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, max(w) AS w FROM wt
          WHERE w IS NOT NULL AND NOT isnan(w) AND w > 0.3 AND i <> j GROUP BY 1, 2)"""


def _nodes(spark, sf):
    d = article_view(documents(spark, sf))
    return G.nodes_table(d, _emb(spark, sf))


def _feats(spark, sf, nodes=None):
    if nodes is None:
        nodes = materialize(_nodes(spark, sf))  # read by k-NN, features, scores and the date range
    ents = nodes.select("id", F.explode("entities").alias("entity"))
    scores = E.entity_scores(nodes.select("id"), ents=ents, id_col="id")
    return G.edge_features(G.knn_pairs(nodes), nodes, scores)


@query("g1_edges", f"WITH {FRAME_SQL} SELECT src, dst, {r6('w')} AS w FROM edges")
def g1_edges(spark, sf):
    return finish(G.weighted_edges(_feats(spark, sf)))


@query("g3_jaccard", f"WITH {FRAME_SQL} SELECT i AS src, j AS dst, {r6('jaccard')} AS jaccard FROM feat")
def g3_jaccard(spark, sf):
    return finish(_feats(spark, sf).select(F.col("i").alias("src"), F.col("j").alias("dst"), "jaccard"))


@query("g4_time_closeness", f"WITH {FRAME_SQL} SELECT i AS src, j AS dst, {r6('t_norm')} AS t_norm FROM feat")
def g4_time_closeness(spark, sf):
    return finish(_feats(spark, sf).select(F.col("i").alias("src"), F.col("j").alias("dst"), "t_norm"))


@query("g10_modularity", f"""
WITH {KNN_SQL},
ed AS (SELECT least(vec_id, nn_id) AS src, greatest(vec_id, nn_id) AS dst, max(1.0 - dist) AS w FROM knn GROUP BY 1, 2),
lab AS (SELECT vec_id, label FROM embeddings),
el AS (SELECT ed.w, a.label AS cs, b.label AS cd FROM ed JOIN lab a ON a.vec_id = ed.src JOIN lab b ON b.vec_id = ed.dst),
m AS (SELECT sum(w) AS m FROM ed),
inn AS (SELECT cs AS c, sum(w) AS in_c FROM el WHERE cs = cd GROUP BY cs),
deg AS (SELECT c, sum(w) AS tot_c FROM (SELECT cs AS c, w FROM el UNION ALL SELECT cd AS c, w FROM el) GROUP BY c)
SELECT {r6('sum(coalesce(in_c, 0.0) / m.m - pow(tot_c / (2.0 * m.m), 2))')} AS q FROM deg LEFT JOIN inn USING (c), m""")
def g10_modularity(spark, sf):
    nn = _knn(spark, sf)
    edges = nn.select(F.least("qid", "nn_id").alias("src"), F.greatest("qid", "nn_id").alias("dst"),
                      (1.0 - F.col("dist")).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    edges = materialize(edges)  # read by the sums of all edges, of those inside and of the degrees
    assign = _emb(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    return finish(G.modularity(edges, assign))


@query("g12_cluster_report", f"""
WITH {FRAME_SQL},
sz AS (SELECT label AS cluster, count(*)::BIGINT AS size FROM nd GROUP BY label),
ec AS (SELECT nd.label AS cluster, e.entity, count(*) AS cnt FROM nd, unnest(nd.ents) AS e(entity) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cnt DESC, entity ASC) AS rank FROM ec)
SELECT sz.cluster, sz.size, rk.rank::BIGINT AS rank, rk.entity FROM sz JOIN rk USING (cluster) WHERE rk.rank <= 5""")
def g12_cluster_report(spark, sf):
    nodes = _nodes(spark, sf)
    lab = _emb(spark, sf).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return G.cluster_report(nodes.join(lab, "id"))


@query("g13_large_groups", """
SELECT label, vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 20)""")
def g13_large_groups(spark, sf):
    return G.large_groups(_emb(spark, sf).select("label", "vec_id"), "label")


# ---------------- embeddings, reduction, neighbour resampling ----------------

from newslens.operators import neighbours as NB  # noqa: E402
from newslens.operators import vectors as VE  # noqa: E402
from newslens.operators.balance import folds as hash_folds  # noqa: E402
from newslens.operators.topics import by_doc, top_topics  # noqa: E402

LV_SQL = """
lv AS (SELECT e.vec_id, l.quality AS label, list_transform(e.embedding, lambda x: x::DOUBLE) AS v
       FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id)"""


def _euclid_rank_sql(src: str, qfilter: str = "TRUE", rfilter: str = "TRUE", self_ok: bool = False) -> str:
    cond = "TRUE" if self_ok else "a.vec_id <> b.vec_id"
    return f"""pr AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt({sq_sql('a.v', 'b.v')}) AS d
       FROM {src} a, {src} b WHERE {cond} AND ({qfilter.replace('x.', 'a.')}) AND ({rfilter.replace('x.', 'b.')})),
rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 6), j) AS rank FROM pr)"""


def _lv(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("label"))
    return _emb(spark, sf).select("vec_id", "embedding").join(lab, "vec_id")


@query("e1_hash_embed")
def e1_hash_embed(spark, sf):
    e = VE.text_embeddings(documents(spark, sf))
    return e.select("doc_id", F.size("embedding").cast("bigint").alias("dim"), "embedding")


@query("e2_topic_embed")
def e2_topic_embed(spark, sf):
    docs = documents(spark, sf)
    e = VE.topic_embeddings(top_topics(by_doc(docs)), docs=docs)
    return e.select("doc_id", F.size("topic_embedding").cast("bigint").alias("len"), "topic_embedding")


@query("e3_pca")
def e3_pca(spark, sf):
    r = VE.pca(_emb(spark, sf), "embedding")
    return r.select("vec_id", F.size("reduced").cast("bigint").alias("k"), "reduced")


@query("r4_smote")
def r4_smote(spark, sf):
    s = NB.smote(_lv(spark, sf), id_col="vec_id", vec_col="embedding", label="label")
    return s.select("parent_id", "nn_id", "label", "u", "vec")


@query("r5_tomek", f"""
WITH {LV_SQL}, {_euclid_rank_sql('lv')},
nn1 AS (SELECT rk.i, rk.j FROM rk WHERE rank = 1),
links AS (SELECT a.i FROM nn1 a JOIN nn1 b ON a.i = b.j AND a.j = b.i
          JOIN lv la ON la.vec_id = a.i JOIN lv lb ON lb.vec_id = a.j WHERE la.label <> lb.label)
SELECT vec_id FROM lv WHERE vec_id NOT IN (SELECT i FROM links)""")
def r5_tomek(spark, sf):
    return NB.tomek_keep(_lv(spark, sf), id_col="vec_id", vec_col="embedding", label="label").select("vec_id")


@query("r5_enn", f"""
WITH {LV_SQL}, {_euclid_rank_sql('lv')},
ag AS (SELECT rk.i, bool_and(lj.label = li.label) AS ok FROM rk JOIN lv li ON li.vec_id = rk.i
       JOIN lv lj ON lj.vec_id = rk.j WHERE rank <= 3 GROUP BY rk.i)
SELECT i AS vec_id FROM ag WHERE ok""")
def r5_enn(spark, sf):
    return NB.enn_keep(_lv(spark, sf), id_col="vec_id", vec_col="embedding", label="label").select("vec_id")


@query("r6_nearest_original", f"""
WITH fv AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
                   ((row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 3) AS fold
            FROM embeddings),
pr AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt({sq_sql('a.v', 'b.v')}) AS d FROM fv a, fv b WHERE a.fold = 0 AND b.fold <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 6), j) AS rank FROM pr)
SELECT i AS vec_id, j AS orig_id FROM rk WHERE rank = 1""")
def r6_nearest_original(spark, sf):
    f = hash_folds(_emb(spark, sf).select("vec_id", "embedding"), id_col="vec_id")
    syn = f.filter(F.col("fold") == 0)
    orig = f.filter(F.col("fold") != 0)
    return NB.nearest_original(syn, orig, id_col="vec_id", vec_col="embedding")
