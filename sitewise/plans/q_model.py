"""Registered queries: modelling.

Relational parts (one-hot, train-only imputation) have oracles; fitted
models are checked by invariants in the tests."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sitewise.functions.quantiles import median_struct
from sitewise.operators import model as MO
from sitewise.operators import windows as WI
from sitewise.plans import bindings as B
from sitewise.plans.registry import r6, register
from sitewise.session import checkpoint as _ckpt
from sitewise.session import shared_path

NUMERIC = ["o_totalprice", "c_acctbal", "region_code"]
CATEGORICAL = ["region", "ward", "o_orderpriority"]
FEATURES = NUMERIC + CATEGORICAL + ["o_orderdate"]
LV = B.STATUS_LEVELS
O = f"({B.ORDER_SITES_SQL}) o"

# Untuned fits take the middle of the reference's ranges; it names
# no AdaBoost rounds and no Shapley samples.
FOREST = {"num_trees": 750, "mtry": 10, "min_n": 6}
BOOSTED = {"trees": 750, "depth": 5, "learn_rate": 10**-1.5}
ROUNDS, SAMPLES = 50, 64

# The level lists of the two one-hot columns (TPC-H domains).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def split_sites(s, d):
    o = B.order_sites(s, d)
    return WI.stratified_split(o, "status_group", "id", 0.8, 123)


def recipe():
    return MO.feature_recipe(NUMERIC, CATEGORICAL, "status_group", LV, date_col="o_orderdate")


def train_test(s, d):
    sp = _ckpt(split_sites(s, d))
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


def fit_predict(s, d, estimator):
    tr, te = train_test(s, d)
    m = MO.fit(recipe(), estimator, tr)
    return MO.predict(m, te, "id", "status_group", LV)


# ---------------------------------------------------------------- relational parts (O)

def _onehot_sql():
    cols = []
    for col, levels in (("ward", SEGMENTS), ("o_orderpriority", PRIORITIES)):
        import re

        for lv in levels:
            name = re.sub(r"[^0-9a-zA-Z]+", "_", f"{col}_{lv}").strip("_").lower()
            cols.append(f"CAST(CASE WHEN {col} = '{lv}' THEN 1 ELSE 0 END AS INTEGER) AS {name}")
    return f"SELECT id, {', '.join(cols)} FROM {O}"


@register("one_hot", sql=_onehot_sql())
def one_hot(s, d):
    o = B.order_sites(s, d).select("id", "ward", "o_orderpriority")
    o = MO.one_hot_columns(o, "ward", SEGMENTS)
    return MO.one_hot_columns(o, "o_orderpriority", PRIORITIES).drop("ward", "o_orderpriority")


SPLIT_SQL = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY status_group ORDER BY md5(concat(CAST(id AS VARCHAR), '123')))
            <= floor(COUNT(*) OVER (PARTITION BY status_group) * 0.8) THEN 'train' ELSE 'test' END AS split FROM {O}"""


@register(
    "train_median_impute",
    sql=f"""WITH sp AS ({SPLIT_SQL}),
x AS (SELECT id, split, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acct, o_totalprice FROM sp),
m AS (SELECT quantile_cont(acct, 0.5) AS m_acct, quantile_cont(o_totalprice, 0.5) AS m_price FROM x WHERE split = 'train')
SELECT id, split, round(COALESCE(acct, m_acct), 6) AS acct, round(COALESCE(o_totalprice, m_price), 6) AS o_totalprice FROM x, m""",
)
def train_median_impute(s, d):
    sp = split_sites(s, d).select("id", "split", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acct"), "o_totalprice")
    med = median_struct(sp.where(F.col("split") == "train"), ["acct", "o_totalprice"])
    out = sp.withColumn("_m", med)
    return out.select("id", "split", r6(F.coalesce("acct", F.col("_m.acct")), "acct"),
                      r6(F.coalesce("o_totalprice", F.col("_m.o_totalprice")), "o_totalprice"))


# ---------------------------------------------------------------- fitted models (R)

@register("feature_recipe")
def feature_recipe_q(s, d):
    tr, te = train_test(s, d)
    prep = recipe().fit(tr)
    return prep.transform(te).select("id", "label", vector_to_array("features").alias("features"))


register("rf_fit_predict")(lambda s, d: fit_predict(s, d, MO.random_forest(num_trees=20, mtry=3, min_n=2)))
register("gbt_fit_predict")(lambda s, d: fit_predict(s, d, MO.boosted_trees(**BOOSTED)))
register("logistic_fit")(lambda s, d: fit_predict(s, d, MO.logistic(0.01)))
register("svm_fit")(lambda s, d: fit_predict(s, d, MO.linear_svm(0.01)))
register("tree_fit")(lambda s, d: fit_predict(s, d, MO.decision_tree(5)))


@register("adaboost_fit")
def adaboost_fit(s, d):
    tr, te = train_test(s, d)
    return MO.adaboost_samme(recipe(), tr, te, "id", "status_group", LV, rounds=ROUNDS, depth=2)


@register("bind_predictions")
def bind_predictions(s, d):
    tr, te = train_test(s, d)
    a = MO.predict(MO.fit(recipe(), MO.random_forest(10, 3, 2), tr), te, "id", "status_group", LV)
    b = MO.predict(MO.fit(recipe(), MO.logistic(0.01), tr), te, "id", "status_group", LV)
    return a.select("id", "truth", F.col("pred").alias("pred_forest")).join(b.select("id", F.col("pred").alias("pred_logistic")), "id")


@register("model_roundtrip")
def model_roundtrip(s, d):
    tr, te = train_test(s, d)
    m = MO.fit(recipe(), MO.random_forest(10, 3, 2), tr)
    path = shared_path(s, "model")
    m.write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    m2 = PipelineModel.load(path)
    a = MO.predict(m, te, "id", "status_group", LV).select("id", F.col("pred").alias("pred_before"))
    b = MO.predict(m2, te, "id", "status_group", LV).select("id", F.col("pred").alias("pred_after"))
    return a.join(b, "id").withColumn("same", F.col("pred_before") == F.col("pred_after"))


# The reference's ranges; learn_rate is given in log10.
POINTS, FOLDS = 10, 5
GRIDS = {
    "random_forest": MO.latin_hypercube(
        {"mtry": (5, 15), "trees": (500, 1000), "min_n": (2, 10)}, POINTS, 123, integer=["mtry", "trees", "min_n"]),
    "boosted_trees": MO.latin_hypercube(
        {"trees": (500, 1000), "tree_depth": (3, 8), "learn_rate": (-2, -1)}, POINTS, 123, integer=["trees", "tree_depth"],
        log10=["learn_rate"]),
}
MAKE = {
    "random_forest": lambda mtry, trees, min_n: MO.deep_forest(trees, mtry, min_n),
    "boosted_trees": lambda trees, tree_depth, learn_rate: MO.boosted_trees(trees, tree_depth, learn_rate),
}


def _tuned(folds):
    """Metrics of both families: (model, param_id, fold, metric, estimate)."""
    forest, boosted = (
        MO.tune_grid(recipe(), MAKE[name], GRIDS[name], folds, "fold", "id", "status_group", LV, name) for name in GRIDS)
    return forest.unionByName(boosted)


def _finalists(metrics, train):
    """(family, best point, model refitted on all training rows) of each family."""
    metrics = _ckpt(metrics)
    for name in GRIDS:
        res = metrics.where(F.col("model") == name)
        yield name, MO.select_best(res).first(), MO.finalize_and_fit(recipe(), MAKE[name], GRIDS[name], res, train)


def tune(s, d):
    return _tuned(WI.vfold_assign(train_test(s, d)[0], "status_group", "id", FOLDS, 123))


register("tune_metrics")(tune)


@register("select_best")
def select_best(s, d):
    """The best point of each family."""
    res = _ckpt(tune(s, d))
    forest, boosted = (MO.select_best(res.where(F.col("model") == name), "accuracy") for name in GRIDS)
    return forest.unionByName(boosted)


@register("refit_best")
def refit_best(s, d):
    """Tuning, then one fit per family on all training rows with the parameters it chose."""
    tr, te = train_test(s, d)
    res = _tuned(WI.vfold_assign(tr, "status_group", "id", FOLDS, 123))
    forest, boosted = (
        MO.predict(m, te, "id", "status_group", LV).withColumn("model", F.lit(name)) for name, _, m in _finalists(res, tr))
    return forest.unionByName(boosted)


@register("nested_cv")
def nested_cv(s, d):
    """Outer folds by hash; inside each, the whole tuning over inner folds,
    then each family's best point refitted and scored on the outer fold."""
    o = _ckpt(WI.vfold_assign_hash(B.order_sites(s, d), "id", FOLDS, 7, "outer"))
    rows = []
    for k in range(FOLDS):
        train = o.where(F.col("outer") != k)
        res = _tuned(WI.vfold_assign_hash(train, "id", FOLDS, 11, "fold"))
        for name, best, m in _finalists(res, train):
            pr = MO.predict(m, o.where(F.col("outer") == k), "id", "status_group", LV)
            acc = pr.agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0]
            rows.append((k, name, int(best["param_id"]), "accuracy", float(acc)))
    return s.createDataFrame(rows, "outer_fold int, model string, best_param_id int, metric string, estimate double")


def _importance(s, d):
    tr, te = train_test(s, d)
    m = MO.fit(recipe(), MO.random_forest(10, 3, 2), tr)
    return MO.permutation_importance(m, te, FEATURES, "id", "status_group", LV)


register("permutation_importance")(_importance)
register("top_features")(lambda s, d: MO.top_features(_importance(s, d), 15))


@register("shapley_mean_abs")
def shapley_mean_abs(s, d):
    return MO.mean_abs_shapley(shapley_sampled(s, d))


@register("shapley_sampled")
def shapley_sampled(s, d):
    tr, te = train_test(s, d)
    m = MO.fit(recipe(), MO.random_forest(10, 3, 2), tr)
    return MO.shapley_sampled(m, te, tr, FEATURES, "id", LV, samples=SAMPLES)


def _rated(s, d):
    """Labelled documents: the toxic class is rare by nature."""
    doc = B.table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                                            F.length(F.regexp_replace("text", "[^ ]", "")).cast("double").alias("n_spaces"))
    lab = B.table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("rating"))
    return lab.join(doc, "doc_id")


@register("smote")
def smote(s, d):
    return MO.smote_2d(_rated(s, d), "rating", "n_chars", "n_spaces", "doc_id", k=5, seed=123)


@register(
    "smote_sizes",
    sql="""WITH r AS (SELECT CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS rating FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
c AS (SELECT rating, COUNT(*) AS n FROM r GROUP BY 1)
SELECT rating, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS n_synthetic, CAST(0 AS BIGINT) AS n_off_segment FROM c""",
)
def smote_sizes(s, d):
    """Class sizes after oversampling, and new points off the segment from
    their base to the neighbour that was picked (none)."""
    new = smote(s, d)
    base = _rated(s, d).select(F.col("doc_id").alias("base_id"), F.col("n_chars").alias("bx"), F.col("n_spaces").alias("by"))
    off = F.abs((F.col("n_chars") - F.col("bx")) * (F.col("ny") - F.col("by")) - (F.col("n_spaces") - F.col("by")) * (F.col("nx") - F.col("bx")))
    size = 1 + F.abs(F.col("nx") - F.col("bx")) * F.abs(F.col("ny") - F.col("by"))
    return new.join(base, "base_id").groupBy("rating").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("synthetic").alias("n_synthetic"),
        F.count_if(F.col("synthetic") & (off > 1e-6 * size)).alias("n_off_segment"))


@register("ensemble_models")
def ensemble_models(s, d):
    """RF + boosting ensemble on fitted models: probabilities averaged per id."""
    from sitewise.operators.metrics import ensemble_average

    tr, te = train_test(s, d)
    m = MO.fit(recipe(), MO.deep_forest(**FOREST), tr)
    a = MO.predict(m, te, "id", "status_group", LV)
    m.stages[-1].release()
    b = MO.predict(MO.fit(recipe(), MO.boosted_trees(**BOOSTED), tr), te, "id", "status_group", LV)
    return ensemble_average(a, b, "id", MO.prob_names(LV))
