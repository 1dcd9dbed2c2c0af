"""Queries for labels (B*), rebalancing (R1-R3) and validation (V1-V2, V5-V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newslens.functions import text as T
from newslens.operators import balance as R
from newslens.operators import labels as B
from newslens.operators import validate as V
from newslens.operators.common import class_counts
from newslens.operators.grid import summary
from newslens.plans.registry import finish, query, r6, sql_sentences, sql_tokens
from newslens.sources.tables import documents, table

SEED = 42
HKEY = "md5('42:' || CAST(doc_id AS VARCHAR))"
LAB = "l AS (SELECT doc_id, quality AS label FROM labels)"
RANKED = f"""{LAB},
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {HKEY}, doc_id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM l),
cc AS (SELECT DISTINCT label, n FROM r)"""


def _labelled(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))


def _resample_sql(target_expr: str) -> str:
    return f"""WITH {RANKED},
tg AS (SELECT label, n, {target_expr} AS t FROM cc),
k AS (SELECT r.doc_id, r.label, CASE WHEN tg.t <= tg.n THEN (r.rk < tg.t)::INTEGER
                                     ELSE (tg.t // tg.n + (r.rk < tg.t % tg.n)::INTEGER) END AS k
      FROM r JOIN tg USING (label))
SELECT doc_id, label, unnest(range(0, k))::BIGINT AS copy FROM k WHERE k > 0"""


# ---------------- labels ----------------

def _bias_type_spark():
    d = F.col("doc_id")
    parts = [F.when(F.shiftright(d, n - 1).bitwiseAND(1) == 1,
                    F.when(d % 5 == 0, F.lit(f"{n}.0")).otherwise(F.lit(str(n)))) for n in range(1, 6)]
    return (F.when(d % 13 == 0, F.lit(None).cast("string"))
            .when(d % 3 == 1, F.concat_ws(", ", *parts)).otherwise(F.concat_ws(",", *parts)))


def _bias_type_sql() -> str:
    parts = ", ".join(f"CASE WHEN (doc_id >> {n - 1}) & 1 = 1 THEN (CASE WHEN doc_id % 5 = 0 THEN '{n}.0' ELSE '{n}' END) END"
                      for n in range(1, 6))
    return (f"CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN concat_ws(', ', {parts}) "
            f"ELSE concat_ws(',', {parts}) END")


@query("b1_multihot", f"""
WITH b AS (SELECT doc_id, list_transform(string_split(coalesce({_bias_type_sql()}, ''), ','),
                                         lambda p: regexp_replace(trim(p), '\\.0+$', '')) AS parts FROM documents)
SELECT doc_id, {", ".join(f"list_contains(parts, '{n}')::INTEGER AS label_{n}" for n in range(1, 6))} FROM b""")
def b1_multihot(spark, sf):
    d = documents(spark, sf).select("doc_id", _bias_type_spark().alias("bias_type"))
    return B.multi_hot(d).select("doc_id", *[f"label_{n}" for n in range(1, 6)])


@query("b2_orientation", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
x AS (SELECT event_id, 2.0 * (value - lo) / (hi - lo) - 1.0 AS b FROM events, s)
SELECT event_id, (CASE WHEN b > 0.5 THEN 1 WHEN b < -0.5 THEN 2 ELSE 0 END)::INTEGER AS label_cat FROM x""")
def b2_orientation(spark, sf):
    e = table(spark, sf, "events")
    lo = e.select(F.min("value")).scalar()
    hi = e.select(F.max("value")).scalar()
    b = 2.0 * (F.col("value") - lo) / (hi - lo) - 1.0
    return e.select("event_id", B.orientation(b).alias("label_cat"))


@query("b3_training_table", """
SELECT l.doc_id, length(d.text)::BIGINT AS text_len, l.quality AS label FROM labels l JOIN documents d USING (doc_id)""")
def b3_training_table(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("bias"))
    d = documents(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("text_len"))
    return B.training_table(lab.join(d, "doc_id")).select("doc_id", "text_len", "label")


@query("b5_standardise", f"""
WITH f AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, len({sql_tokens()})::DOUBLE AS n_words,
                  len({sql_sentences()})::DOUBLE AS n_sentences FROM documents),
s AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(n_words) AS m2, stddev_pop(n_words) AS s2,
             avg(n_sentences) AS m3, stddev_pop(n_sentences) AS s3 FROM f)
SELECT doc_id, {r6('CASE WHEN s1 = 0 THEN 0.0 ELSE (n_chars - m1) / s1 END')} AS z_n_chars,
  {r6('CASE WHEN s2 = 0 THEN 0.0 ELSE (n_words - m2) / s2 END')} AS z_n_words,
  {r6('CASE WHEN s3 = 0 THEN 0.0 ELSE (n_sentences - m3) / s3 END')} AS z_n_sentences FROM f, s""")
def b5_standardise(spark, sf):
    d = documents(spark, sf).select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                                    F.size(T.tokens("text")).cast("double").alias("n_words"),
                                    F.size(T.sentences("text")).cast("double").alias("n_sentences"))
    z = B.standardise(d, ["n_chars", "n_words", "n_sentences"])
    return finish(z.select("doc_id", "z_n_chars", "z_n_words", "z_n_sentences"))


@query("b7_class_counts", "SELECT quality AS label, count(*)::BIGINT AS n FROM labels GROUP BY quality")
def b7_class_counts(spark, sf):
    return class_counts(_labelled(spark, sf))


@query("b8_class_weights", f"""
WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality)
SELECT label, {r6('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)')} AS weight FROM c""")
def b8_class_weights(spark, sf):
    return finish(B.class_weights(_labelled(spark, sf)))


# ---------------- rebalancing ----------------

@query("r1_undersample", _resample_sql("(SELECT min(n) FROM cc)"))
def r1_undersample(spark, sf):
    return R.undersample(_labelled(spark, sf), seed=SEED).select("doc_id", "label", "copy")


@query("r2_oversample", _resample_sql("greatest(n, (SELECT max(n) FROM cc))"))
def r2_oversample(spark, sf):
    return R.oversample(_labelled(spark, sf), seed=SEED).select("doc_id", "label", "copy")


@query("r3_mixed_balance", _resample_sql(
    "CASE WHEN n = (SELECT max(n) FROM cc) THEN floor((SELECT max(n) FROM cc) * 0.7)::BIGINT "
    "WHEN n = (SELECT min(n) FROM cc) THEN greatest(n, floor((SELECT max(n) FROM cc) * 0.6)::BIGINT) ELSE n END"))
def r3_mixed_balance(spark, sf):
    return R.mixed_balance(_labelled(spark, sf), seed=SEED).select("doc_id", "label", "copy")


# ---------------- folds and metrics ----------------

@query("v1_stratified_folds", f"WITH {RANKED} SELECT doc_id, label, (rk % 3)::INTEGER AS fold FROM r")
def v1_stratified_folds(spark, sf):
    return R.stratified_folds(_labelled(spark, sf), seed=SEED).select("doc_id", "label", "fold")


@query("v2_folds", f"""
WITH {LAB}
SELECT doc_id, label, ((row_number() OVER (ORDER BY {HKEY}, doc_id) - 1) % 3)::INTEGER AS fold FROM l""")
def v2_folds(spark, sf):
    return R.folds(_labelled(spark, sf), seed=SEED).select("doc_id", "label", "fold")


PRED_SQL = """p AS (SELECT l.doc_id, l.quality AS label, (length(d.text) % 2)::INTEGER AS pred
          FROM labels l JOIN documents d USING (doc_id))"""


def _confusion_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""(SELECT {b}label AS class, (label = pred)::INTEGER AS tp, 0 AS fp, (label <> pred)::INTEGER AS fn, 1 AS n FROM {src}
   UNION ALL SELECT {b}pred AS class, 0, (label <> pred)::INTEGER, 0, 0 FROM {src})"""


F1_SQL = "CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0 ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END"


def _predictions(spark, sf):
    lab = _labelled(spark, sf)
    d = documents(spark, sf).select("doc_id", F.length("text").alias("len"))
    return lab.join(d, "doc_id")


@query("v6_metrics", f"""
WITH {PRED_SQL}
SELECT class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, {r6(F1_SQL)} AS f1
FROM {_confusion_sql('p')} GROUP BY class""")
def v6_metrics(spark, sf):
    p = _predictions(spark, sf).withColumn("pred", (F.col("len") % 2).cast("int"))
    return finish(V.per_class_metrics(p).select("class", "tp", "fp", "fn", "f1"))


@query("v7_cv_summary", f"""
WITH {RANKED}, {PRED_SQL},
pf AS (SELECT p.*, (r.rk % 3)::INTEGER AS fold FROM p JOIN r USING (doc_id)),
pc AS (SELECT fold, class, sum(tp) AS tp, sum(n) AS n, {F1_SQL} AS f1 FROM {_confusion_sql('pf', 'fold')} GROUP BY fold, class),
pfm AS (SELECT fold, sum(tp) / sum(n) AS acc, avg(f1) AS f1_macro FROM pc GROUP BY fold)
SELECT {r6('avg(acc)')} AS mean_acc, {r6('stddev_pop(acc)')} AS std_acc, {r6('avg(f1_macro)')} AS mean_f1_macro FROM pfm""")
def v7_cv_summary(spark, sf):
    lab = R.stratified_folds(_labelled(spark, sf), seed=SEED)
    d = documents(spark, sf).select("doc_id", (F.length("text") % 2).cast("int").alias("pred"))
    per_fold = V.summary_metrics(lab.join(d, "doc_id"), by=["fold"])
    return finish(V.cv_summary(per_fold).select("mean_acc", "std_acc", "mean_f1_macro"))


@query("v7_fold_classes", f"""
WITH {RANKED}, {PRED_SQL},
pf AS (SELECT p.*, (r.rk % 3)::INTEGER AS fold FROM p JOIN r USING (doc_id)),
pc AS (SELECT fold, class, sum(tp) AS tp, sum(n) AS n, {F1_SQL} AS f1 FROM {_confusion_sql('pf', 'fold')} GROUP BY fold, class),
pfm AS (SELECT fold, sum(tp) / sum(n) AS acc, avg(f1) AS f1_macro FROM pc GROUP BY fold)
SELECT pc.fold, pc.class, {r6('pc.f1')} AS f1, {r6('avg(pc.f1) OVER (PARTITION BY pc.class)')} AS mean_f1, {r6('pfm.acc')} AS acc, {r6('pfm.f1_macro')} AS f1_macro
FROM pc JOIN pfm USING (fold)""")
def v7_fold_classes(spark, sf):
    """The fold lists of the summary, a row for each fold and class, with the mean F1 of the class."""
    lab = R.stratified_folds(_labelled(spark, sf), seed=SEED)
    d = documents(spark, sf).select("doc_id", (F.length("text") % 2).cast("int").alias("pred"))
    per_class = V.per_class_metrics(lab.join(d, "doc_id"), by=["fold"])
    per_fold = per_class.groupBy("fold").agg((F.sum("tp") / F.sum("n")).alias("acc"), F.avg("f1").alias("f1_macro"),
                                             F.map_from_entries(F.collect_list(F.struct("class", "f1"))).alias("f1_class"))
    rows = per_fold.select(F.lit("e").alias("experiment"), F.lit("p").alias("params_key"), "fold", "acc", "f1_macro", "f1_class")
    s = summary(rows).select("mean_f1_class", F.posexplode(F.arrays_zip("acc_folds", "f1_macro_folds", "f1_class_folds")).alias("fold", "z"))
    one = s.select("fold", "z.acc_folds", "z.f1_macro_folds", "mean_f1_class", F.posexplode("z.f1_class_folds").alias("i", "f1"))
    # the classes of a fold's list are in order; those of the mean, too
    return finish(one.select("fold", F.element_at(F.sort_array(F.map_keys("mean_f1_class")), F.col("i") + 1).alias("class"), "f1",
                             F.element_at("mean_f1_class", F.element_at(F.sort_array(F.map_keys("mean_f1_class")), F.col("i") + 1)).alias("mean_f1"),
                             F.col("acc_folds").alias("acc"), F.col("f1_macro_folds").alias("f1_macro")))


PREDICTORS = {"len_mod_2": lambda n: (n % 2).cast("int"), "len_mod_3_is_0": lambda n: (n % 3 == 0).cast("int")}
PRED_SQL_MULTI = """pm AS (SELECT 'len_mod_2' AS params_key, l.quality AS label, (length(d.text) % 2)::INTEGER AS pred
            FROM labels l JOIN documents d USING (doc_id)
           UNION ALL SELECT 'len_mod_3_is_0', l.quality, (length(d.text) % 3 = 0)::INTEGER
            FROM labels l JOIN documents d USING (doc_id))"""


def _multi_predictions(spark, sf):
    p = _predictions(spark, sf)
    arr = F.array(*[F.struct(F.lit(k).alias("params_key"), fn(F.col("len")).alias("pred")) for k, fn in PREDICTORS.items()])
    return p.select("doc_id", "label", F.explode(arr).alias("x")).select("doc_id", "label", "x.params_key", "x.pred")


@query("v8_best_params", f"""
WITH {PRED_SQL_MULTI},
pc AS (SELECT params_key, class, {F1_SQL} AS f1 FROM {_confusion_sql('pm', 'params_key')} GROUP BY params_key, class),
m AS (SELECT params_key, avg(f1) AS f1_macro FROM pc GROUP BY params_key)
SELECT min(params_key) AS params_key, {r6('max(f1_macro)')} AS f1_macro FROM m WHERE f1_macro = (SELECT max(f1_macro) FROM m)""")
def v8_best_params(spark, sf):
    res = V.summary_metrics(_multi_predictions(spark, sf), by=["params_key"])
    return finish(V.best_params(res))


GRID = ["len_mod_2", "len_mod_3_is_0", "len_mod_5"]


@query("v5_pending_grid", f"""
WITH {RANKED},
f AS (SELECT DISTINCT (rk % 3)::INTEGER AS fold FROM r),
g AS (SELECT k.params_key, f.fold FROM f, (SELECT unnest({GRID!r}) AS params_key) k),
done AS (SELECT DISTINCT 'len_mod_2' AS params_key, (r.rk % 3)::INTEGER AS fold FROM r JOIN documents d USING (doc_id))
SELECT params_key, fold FROM g WHERE (params_key, fold) NOT IN (SELECT (params_key, fold) FROM done)""")
def v5_pending_grid(spark, sf):
    fl = R.stratified_folds(_labelled(spark, sf), seed=SEED)
    d = documents(spark, sf).select("doc_id", (F.length("text") % 2).cast("int").alias("pred"))
    finished = V.summary_metrics(fl.join(d, "doc_id"), by=["fold"]).withColumn("params_key", F.lit("len_mod_2"))
    return V.pending_grid(fl, GRID, finished).select("params_key", "fold")
