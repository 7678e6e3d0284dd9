"""Registered queries: missing group keys, absent levels, and the derived
tables around models (metric tables, facts, profiles) that plain SQL can check.

A missing group is a group of its own everywhere, as in the reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import metrics as ME
from sitewise.operators import model as MO
from sitewise.operators import spatial as SP
from sitewise.operators import stats as ST
from sitewise.operators import windows as WI
from sitewise.plans import bindings as B
from sitewise.plans import q_metrics as QM
from sitewise.plans import q_spatial as QS
from sitewise.plans.registry import register
from sitewise.plans.q_stats import round_all, rsql

LV, P = B.STATUS_LEVELS, B.PROB_COLS
O = f"({B.ORDER_SITES_SQL}) o"
SA, SB = (f"({B.scores_sql(m)})" for m in ("model_a", "model_b"))
STRATA_SQL = f"(SELECT id, region_code, NULLIF(region, 'ASIA') AS region, NULLIF(status_group, 'non functional') AS status_group FROM {O}) t"
MD5 = "md5(concat(CAST(id AS VARCHAR), '123'))"


def strata(s, d):
    o = B.order_sites(s, d)
    return o.select("id", "region_code", F.nullif(F.col("region"), F.lit("ASIA")).alias("region"),
                    F.nullif(F.col("status_group"), F.lit("non functional")).alias("status_group"))


register(
    "stratified_split_nullkey",
    sql=f"""SELECT id, status_group, CASE WHEN row_number() OVER (PARTITION BY status_group ORDER BY {MD5}, id)
  <= floor(COUNT(*) OVER (PARTITION BY status_group) * 0.8) THEN 'train' ELSE 'test' END AS split FROM {STRATA_SQL}""",
)(lambda s, d: WI.stratified_split(strata(s, d).select("id", "status_group"), "status_group", "id", 0.8, 123))
register(
    "vfold_nullkey",
    sql=f"""SELECT id, status_group, CAST((row_number() OVER (PARTITION BY status_group ORDER BY {MD5}, id) - 1) % 5 AS INTEGER) AS fold
FROM {STRATA_SQL}""",
)(lambda s, d: WI.vfold_assign(strata(s, d).select("id", "status_group"), "status_group", "id", 5, 123))
register(
    "region_code_id_nullkey",
    sql=f"""SELECT id, region, region_code, CAST(dense_rank() OVER (PARTITION BY region ORDER BY region_code) AS INTEGER) AS code_rank
FROM {STRATA_SQL}""",
)(lambda s, d: WI.dense_rank_within(strata(s, d).select("id", "region", "region_code"), ["region"], "region_code", "code_rank"))
register(
    "iqr_bound_nullkey",
    sql=f"""SELECT flag, {rsql('q25')} AS q25, {rsql('med')} AS median, {rsql('q75')} AS q75, {rsql('q75 - q25')} AS iqr,
  {rsql('med + 1.5 * (q75 - q25)')} AS upper_bound
FROM (SELECT NULLIF(l_returnflag, 'R') AS flag, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS med,
             quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY 1) t""",
)(lambda s, d: round_all(ST.iqr_table(
    B.table(s, d, "lineitem").withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("R"))), "l_extendedprice", ["flag"])))


# ---------------------------------------------------------------- points of a missing group

def points_nullkey(s, d):
    return QS.pts(s, d).select(F.nullif(F.col("grp"), F.lit(1)).alias("grp"), "id", "x", "y")


def _nullkey_sql(name: str) -> str:
    """The query's own oracle, with group 1 shown as missing: a missing group
    must give what the group gave under its name."""
    from sitewise.plans.registry import ORACLES

    return f"SELECT t.* REPLACE (NULLIF(t.grp, 1) AS grp) FROM ({ORACLES[name]}) t"


register("centroid_outliers_nullkey", sql=_nullkey_sql("centroid_outliers"))(
    lambda s, d: SP.centroid_outliers(points_nullkey(s, d), ["grp"], "id").withColumn("threshold", F.round("threshold", 6)))
register("knn_grid_nullkey", sql=_nullkey_sql("knn_grid"))(
    lambda s, d: SP.knn_points(points_nullkey(s, d), ["grp"], "id", QS.KNN_K).withColumn("dist", F.round("dist", 6)))
register("lof_nullkey", sql=_nullkey_sql("lof_by_group"))(
    lambda s, d: SP.lof_by_group(points_nullkey(s, d), ["grp"], "id", QS.LOF_K, QS.LOF_TOP).withColumn("lof", F.round("lof", 6)))


# ---------------------------------------------------------------- metrics: all curves, absent levels, missing labels

def _roc_all_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{lv}' AS level, {c} AS v, truth = '{lv}' AS pos FROM {SA} s" for lv, c in P.items())
    ends = ", ".join(f"('{lv}')" for lv in P)
    return f"""WITH long AS ({long}),
cnt AS (SELECT level, v, COUNT(*) FILTER (WHERE pos) AS np, COUNT(*) FILTER (WHERE NOT pos) AS nn FROM long GROUP BY 1, 2),
cum AS (SELECT level, v, SUM(np) OVER w AS tp, SUM(nn) OVER w AS fp, SUM(np) OVER (PARTITION BY level) AS p, SUM(nn) OVER (PARTITION BY level) AS n
        FROM cnt WINDOW w AS (PARTITION BY level ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT level, v AS threshold, round(CAST(tp AS DOUBLE) / p, 6) AS sensitivity, round(1.0 - CAST(fp AS DOUBLE) / n, 6) AS specificity FROM cum
UNION ALL SELECT level, NULL, 0.0, 1.0 FROM (VALUES {ends}) e(level)"""


register("roc_points_all", sql=_roc_all_sql())(
    lambda s, d: round_all(ME.roc_points_all(B.scores(s, d), "truth", P), keep=["threshold"]))
# 'abandoned' never occurs: its pairs have no AUC, the others are as they were
register("metric_auc_absent_level", sql=f"WITH {QM._auc_sql(SA)} SELECT round(roc_auc, 6) AS roc_auc FROM a")(
    lambda s, d: round_all(ME.hand_till_auc(B.scores(s, d).withColumn("p_none", F.lit(0.0)), "truth", {**P, "abandoned": "p_none"})))
_lv_vals = ", ".join(f"('{x}')" for x in LV)
register(
    "confusion_matrix_missing",
    sql=f"""WITH s AS (SELECT CASE WHEN id % 11 <> 0 THEN truth END AS truth, CASE WHEN id % 7 <> 0 THEN pred END AS pred FROM {SA} a),
g AS (SELECT t.truth, p.pred, 0 AS n FROM (VALUES {_lv_vals}) t(truth), (VALUES {_lv_vals}) p(pred)
      UNION ALL SELECT truth, pred, COUNT(*) FROM s GROUP BY 1, 2)
SELECT truth, pred, CAST(SUM(n) AS BIGINT) AS n FROM g GROUP BY 1, 2""",
)(lambda s, d: ME.confusion_matrix(B.scores(s, d).withColumns({
    "truth": F.when(F.col("id") % 11 != 0, F.col("truth")), "pred": F.when(F.col("id") % 7 != 0, F.col("pred"))}), "truth", "pred", LV))
register(
    "bind_scores",
    sql=f"SELECT a.id, a.truth, a.pred AS pred_a, b.pred AS pred_b FROM {SA} a JOIN {SB} b ON a.id = b.id",
)(lambda s, d: B.scores(s, d, "model_a").select("id", "truth", F.col("pred").alias("pred_a")).join(
    B.scores(s, d, "model_b").select("id", F.col("pred").alias("pred_b")), "id"))

# ---------------------------------------------------------------- a metric table as tuning leaves it: per grid point and fold
FOLD_ACC_SQL = "SELECT '{m}' AS model, CAST(id % 3 AS INTEGER) AS param_id, CAST(id // 3 % 5 AS INTEGER) AS fold, CAST(truth = pred AS INTEGER) AS hit FROM {src} s"


def fold_metrics(s, d):
    parts = []
    for m in ("model_a", "model_b"):
        sc = B.scores(s, d, m).withColumns({"param_id": (F.col("id") % 3).cast("int"), "fold": (F.floor(F.col("id") / 3) % 5).cast("int")})
        parts.append(ME.metric_table(sc, "truth", "pred", P, m, ["param_id", "fold"]))
    return parts[0].unionByName(parts[1])


register(
    "select_best_table",
    sql=f"""WITH h AS ({FOLD_ACC_SQL.format(m='model_a', src=SA)} UNION ALL {FOLD_ACC_SQL.format(m='model_b', src=SB)}),
f AS (SELECT model, param_id, fold, avg(hit) AS estimate FROM h GROUP BY 1, 2, 3),
m AS (SELECT model, param_id, avg(estimate) AS mean FROM f GROUP BY 1, 2)
SELECT model, param_id, {rsql('mean')} AS mean FROM m ORDER BY m.mean DESC, param_id LIMIT 1""",
)(lambda s, d: round_all(MO.select_best(fold_metrics(s, d), "accuracy")))
register(
    "top_features_table",
    sql=f"""WITH i AS (SELECT lga AS feature, {rsql('avg(o_totalprice) - 150000')} AS importance FROM {O} GROUP BY 1)
SELECT feature, importance FROM i ORDER BY importance DESC, feature LIMIT 15""",
)(lambda s, d: MO.top_features(round_all(B.order_sites(s, d).groupBy(F.col("lga").alias("feature")).agg(
    (F.avg("o_totalprice") - 150000).alias("importance"))), 15))
register(
    "report_metrics",
    sql=f"""SELECT model, metric, estimator, round(estimate, 3) AS estimate
FROM ({QM._metric_table_sql('model_a')} UNION ALL {QM._metric_table_sql('model_b')}) t""",
)(lambda s, d: QM.metric_table(s, d).select("model", "metric", "estimator", F.round("estimate", 3).alias("estimate")))
register(
    "model_facts",
    sql=f"SELECT CAST(5 AS BIGINT) AS n_folds, CAST(7 AS BIGINT) AS n_features, COUNT(*) AS n_rows FROM {O}",
)(lambda s, d: ST.model_facts(
    WI.vfold_assign(B.order_sites(s, d).select("id", "status_group"), "status_group", "id", 5, 123), "fold",
    ["o_totalprice", "c_acctbal", "region_code", "region", "ward", "o_orderpriority", "o_orderdate"]))

# ---------------------------------------------------------------- profiles of booleans and categories
_FLAGS = {"in_debt": "CASE WHEN o_totalprice > 50000 THEN c_acctbal < 0 END", "urgent": "o_orderpriority = '1-URGENT'"}


def _bool_sql(c: str) -> str:
    return f"""SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, {rsql(f'avg(CAST({c} IS NOT NULL AS INTEGER))')} AS complete_rate,
  {rsql(f'avg(CAST({c} AS INTEGER))')} AS mean, COUNT(*) FILTER (WHERE {c}) AS n_true, COUNT(*) FILTER (WHERE NOT {c}) AS n_false FROM b"""


register(
    "profile_boolean",
    sql=f"WITH b AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _FLAGS.items())} FROM {O}) " + " UNION ALL ".join(_bool_sql(c) for c in _FLAGS),
)(lambda s, d: round_all(ST.profile_boolean(B.order_sites(s, d).select(*[F.expr(e).alias(c) for c, e in _FLAGS.items()]), list(_FLAGS))))
_CATS = ["region", "lga", "ward", "o_orderpriority"]


def _cat_sql(c: str) -> str:
    return f"""SELECT '{c}' AS variable, (SELECT COUNT(*) FROM x WHERE {c} IS NULL) AS n_missing, COUNT(*) AS n_unique, CAST(max(n) AS BIGINT) AS top_n
FROM (SELECT {c}, COUNT(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY 1) g"""


register(
    "profile_category",
    sql=f"WITH x AS (SELECT NULLIF(region, 'ASIA') AS region, lga, ward, o_orderpriority FROM {O}) " + " UNION ALL ".join(_cat_sql(c) for c in _CATS),
)(lambda s, d: ST.profile_category(B.order_sites(s, d).withColumn("region", F.nullif(F.col("region"), F.lit("ASIA"))).select(*_CATS), _CATS))
