"""Registered queries: metrics on score tables."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from sitewise.operators import metrics as ME
from sitewise.plans import bindings as B
from sitewise.plans.registry import register
from sitewise.plans.q_stats import round_all

LV = B.STATUS_LEVELS
P = B.PROB_COLS
SA = f"({B.scores_sql('model_a')})"


def _prf_sql(src: str) -> str:
    lv = ", ".join(f"('{x}')" for x in LV)
    return f"""c AS (SELECT l.level,
    COUNT(*) FILTER (WHERE s.truth = l.level AND s.pred = l.level) AS tp,
    COUNT(*) FILTER (WHERE s.truth <> l.level AND s.pred = l.level) AS fp,
    COUNT(*) FILTER (WHERE s.truth = l.level AND s.pred <> l.level) AS fn
  FROM {src} s, (VALUES {lv}) l(level) GROUP BY l.level),
pr AS (SELECT level, CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
m AS (SELECT CASE WHEN COUNT(*) FILTER (WHERE precision IS NULL) > 0 THEN NULL ELSE avg(precision) END AS precision,
             CASE WHEN COUNT(*) FILTER (WHERE recall IS NULL) > 0 THEN NULL ELSE avg(recall) END AS recall,
             CASE WHEN COUNT(*) FILTER (WHERE f1 IS NULL) > 0 THEN NULL ELSE avg(f1) END AS f_meas FROM f)"""


def _auc_sql(src: str) -> str:
    parts = []
    for i, j in permutations(LV, 2):
        parts.append(f"SELECT '{i}' AS li, '{j}' AS lj, {P[i]} AS v, truth = '{i}' AS pos FROM {src} s WHERE truth IN ('{i}', '{j}')")
    return f"""long AS ({" UNION ALL ".join(parts)}),
cnt AS (SELECT li, lj, v, COUNT(*) FILTER (WHERE pos) AS np, COUNT(*) FILTER (WHERE NOT pos) AS nn FROM long GROUP BY 1, 2, 3),
cum AS (SELECT *, SUM(nn) OVER (PARTITION BY li, lj ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - nn AS below,
               SUM(nn) OVER (PARTITION BY li, lj) AS N, SUM(np) OVER (PARTITION BY li, lj) AS P FROM cnt),
pair AS (SELECT li, lj, SUM(np * (below + nn * 0.5)) / (MAX(P) * MAX(N)) AS auc FROM cum GROUP BY 1, 2),
a AS (SELECT avg(auc) AS roc_auc FROM pair)"""


register("metric_accuracy", sql=f"SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {SA} s")(
    lambda s, d: round_all(ME.accuracy(B.scores(s, d), "truth", "pred"))
)
register("metric_f_macro", sql=f"WITH {_prf_sql(SA)} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_meas, 6) AS f_meas FROM m")(
    lambda s, d: round_all(ME.macro_prf(B.scores(s, d), "truth", "pred", LV))
)
register("metric_auc_handtill", sql=f"WITH {_auc_sql(SA)} SELECT round(roc_auc, 6) AS roc_auc FROM a")(
    lambda s, d: round_all(ME.hand_till_auc(B.scores(s, d), "truth", P))
)

_lv_vals = ", ".join(f"('{x}')" for x in LV)
register(
    "confusion_matrix",
    sql=f"""WITH g AS (SELECT t.truth, p.pred FROM (VALUES {_lv_vals}) t(truth), (VALUES {_lv_vals}) p(pred)),
c AS (SELECT truth, pred, COUNT(*) AS n FROM {SA} s GROUP BY 1, 2)
SELECT g.truth, g.pred, COALESCE(c.n, 0) AS n FROM g LEFT JOIN c ON g.truth = c.truth AND g.pred = c.pred""",
)(lambda s, d: ME.confusion_matrix(B.scores(s, d), "truth", "pred", LV))

POS = "non functional"
register(
    "roc_points",
    sql=f"""WITH cnt AS (SELECT {P[POS]} AS v, COUNT(*) FILTER (WHERE truth = '{POS}') AS np, COUNT(*) FILTER (WHERE truth <> '{POS}') AS nn
  FROM {SA} s GROUP BY 1),
cum AS (SELECT v, SUM(np) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               SUM(nn) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
               SUM(np) OVER () AS P, SUM(nn) OVER () AS N FROM cnt)
SELECT v AS threshold, round(CAST(tp AS DOUBLE) / P, 6) AS sensitivity, round(1.0 - CAST(fp AS DOUBLE) / N, 6) AS specificity FROM cum""",
)(lambda s, d: round_all(ME.roc_points(B.scores(s, d), "truth", P[POS], POS), keep=["threshold"]))


def _metric_table_sql(model: str) -> str:
    src = f"({B.scores_sql(model)})"
    return f"""SELECT * FROM (WITH {_prf_sql(src)}, {_auc_sql(src)},
acc AS (SELECT avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM {src} s)
SELECT '{model}' AS model, 'accuracy' AS metric, 'multiclass' AS estimator, round(accuracy, 6) AS estimate FROM acc
UNION ALL SELECT '{model}', 'f_meas', 'macro', round(f_meas, 6) FROM m
UNION ALL SELECT '{model}', 'roc_auc', 'hand_till', round(roc_auc, 6) FROM a)"""


def metric_table(s, d):
    parts = [ME.metric_table(B.scores(s, d, m), "truth", "pred", P, m) for m in ("model_a", "model_b")]
    return round_all(parts[0].unionByName(parts[1]))


register("metric_table", sql=f"{_metric_table_sql('model_a')} UNION ALL {_metric_table_sql('model_b')}")(metric_table)

register(
    "metric_lookup",
    sql=f"""SELECT model, round(estimate, 3) AS estimate FROM ({_metric_table_sql('model_a')} UNION ALL {_metric_table_sql('model_b')}) t
WHERE metric = 'accuracy'""",
)(lambda s, d: metric_table(s, d).where(F.col("metric") == "accuracy").select("model", F.round("estimate", 3).alias("estimate")))


def _comparison_sql(model: str) -> str:
    src = f"({B.scores_sql(model)})"
    return f"""SELECT * FROM (WITH {_prf_sql(src)}, {_auc_sql(src)}
SELECT '{model}' AS model, round(roc_auc, 6) AS roc_auc, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f_meas, 6) AS f1 FROM m, a)"""


register("model_comparison", sql=f"{_comparison_sql('model_a')} UNION ALL {_comparison_sql('model_b')}")(
    lambda s, d: round_all(
        ME.model_comparison(B.scores(s, d, "model_a"), "truth", "pred", P, "model_a").unionByName(
            ME.model_comparison(B.scores(s, d, "model_b"), "truth", "pred", P, "model_b"))
    )
)

_pa, _pb = f"({B.scores_sql('model_a')})", f"({B.scores_sql('model_b')})"
_pc = list(P.values())
register(
    "ensemble_average",
    sql=f"""WITH j AS (SELECT a.id, {", ".join(f"(a.{c} + b.{c}) / 2 AS {c}" for c in _pc)} FROM {_pa} a JOIN {_pb} b ON a.id = b.id)
SELECT id, {", ".join(f"round({c}, 6) AS {c}" for c in _pc)},
  CASE WHEN {_pc[0]} >= {_pc[1]} AND {_pc[0]} >= {_pc[2]} THEN '{LV[0]}' WHEN {_pc[1]} >= {_pc[2]} THEN '{LV[1]}' ELSE '{LV[2]}' END AS pred
FROM j""",
)(lambda s, d: round_all(ME.ensemble_average(B.scores(s, d, "model_a"), B.scores(s, d, "model_b"), "id", P)))
