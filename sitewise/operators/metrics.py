"""Classification metrics on (truth, pred, probability...) tables (M16-M20,
M23, M24, M30).

Rank statistics never sort the whole table in one task: rows are first
collapsed to counts per distinct score, then cumulative counts come from the
two-level prefix sum in ``functions.quantiles``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.quantiles import ordered_prefix


def accuracy(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def class_counts(df: DataFrame, truth: str, pred: str, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(level, tp, fp, fn) for every level, zero where a level never occurs."""
    lv = F.array(*[F.lit(x) for x in levels])
    per = df.select(*by, F.explode(lv).alias("level"), truth, pred)
    return per.groupBy(*by, "level").agg(
        F.count_if((F.col(truth) == F.col("level")) & (F.col(pred) == F.col("level"))).cast("long").alias("tp"),
        F.count_if((F.col(truth) != F.col("level")) & (F.col(pred) == F.col("level"))).cast("long").alias("fp"),
        F.count_if((F.col(truth) == F.col("level")) & (F.col(pred) != F.col("level"))).cast("long").alias("fn"),
    )


def per_class_prf(df: DataFrame, truth: str, pred: str, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 per level; undefined (0/0) values are null."""
    c = class_counts(df, truth, pred, levels, by)
    p = F.try_divide(F.col("tp").cast("double"), F.nullif(F.col("tp") + F.col("fp"), F.lit(0)))
    r = F.try_divide(F.col("tp").cast("double"), F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))
    c = c.withColumns({"precision": p, "recall": r})
    f1 = F.when((F.col("precision") + F.col("recall")) == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return c.withColumn("f1", f1)


def macro_prf(df: DataFrame, truth: str, pred: str, levels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Macro averages (mean over levels); a null level value makes the mean null."""
    c = per_class_prf(df, truth, pred, levels, by)

    def mean_strict(col):
        return F.when(F.count_if(F.col(col).isNull()) > 0, F.lit(None)).otherwise(F.avg(col))

    return c.groupBy(*by).agg(mean_strict("precision").alias("precision"), mean_strict("recall").alias("recall"),
                 mean_strict("f1").alias("f_meas"))


def _pair_auc(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUC per key from rows (keys..., v, pos): P(v_pos > v_neg) + P(tie) / 2."""
    keys = list(keys)
    cnt = long.groupBy(*keys, "v").agg(
        F.count_if(F.col("pos")).cast("long").alias("np"), F.count_if(~F.col("pos")).cast("long").alias("nn")
    )
    r = ordered_prefix(cnt, "v", keys, weight="nn")
    # _cum = negatives with score <= v; _n = all negatives of the key.
    below = F.col("_cum") - F.col("nn")
    g = r.groupBy(*keys).agg(
        F.sum(F.col("np") * (below + F.col("nn") * F.lit(0.5))).alias("wins"),
        F.sum("np").alias("P"),
        F.max("_n").alias("N"),
    )
    # a pair without positives or negatives has no AUC
    return g.select(*keys, F.try_divide(F.col("wins"), (F.col("P") * F.col("N")).cast("double")).alias("auc"))


def hand_till_auc(df: DataFrame, truth: str, prob: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Multiclass AUC of Hand & Till (2001): mean over ordered level pairs
    (i, j) of AUC(i vs j) using the probability of i, on rows of i and j.
    Pairs with an absent level have no AUC and are left out of the mean."""
    levels = list(prob)
    parts = []
    for i, j in permutations(levels, 2):
        parts.append(
            F.when(F.col(truth).isin(i, j), F.struct(F.lit(i).alias("li"), F.lit(j).alias("lj"),
                                                     F.col(prob[i]).cast("double").alias("v"),
                                                     (F.col(truth) == i).alias("pos")))
        )
    long = df.select(*by, F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s")).select(*by, "s.*")
    pair = _pair_auc(long, [*by, "li", "lj"])
    return pair.groupBy(*by).agg(F.avg("auc").alias("roc_auc"))


def binary_auc(df: DataFrame, truth: str, score: str, positive: str) -> DataFrame:
    long = df.select(F.lit(1).alias("k"), F.col(score).cast("double").alias("v"), (F.col(truth) == positive).alias("pos"))
    return _pair_auc(long, ["k"]).select("auc")


def confusion_matrix(df: DataFrame, truth: str, pred: str, levels: Sequence[str]) -> DataFrame:
    """Counts per (truth, pred) over the full level x level grid (zeros kept),
    and the cells of missing or unknown labels that occur. The grid comes from
    the fixed level list, not from the data."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b, 0) for a in levels for b in levels], f"{truth} string, {pred} string, n long")
    cnt = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return grid.unionByName(cnt).groupBy(truth, pred).agg(F.sum("n").cast("long").alias("n"))


def roc_points(df: DataFrame, truth: str, score: str, positive: str) -> DataFrame:
    """One-vs-rest ROC: at each distinct score v, sensitivity = P(s >= v | pos)
    and specificity = P(s < v | neg); null when there is no such row."""
    long = df.select(F.lit(positive).alias("level"), F.col(score).cast("double").alias("v"), (F.col(truth) == positive).alias("pos"))
    return _roc(long).drop("level")


def _roc(long: DataFrame) -> DataFrame:
    """ROC points per level of rows (level, v, pos), in one prefix sum."""
    long = long.where(F.col("v").isNotNull() & F.col("pos").isNotNull())
    cnt = long.groupBy("level", "v").agg(F.count_if("pos").cast("long").alias("np"), F.count_if(~F.col("pos")).cast("long").alias("nn"))
    r = ordered_prefix(cnt, "v", ["level"], weight=["np", "nn"], descending=True)
    return r.select(
        "level", F.col("v").alias("threshold"),
        F.try_divide(F.col("_cum_np"), F.col("_n_np")).alias("sensitivity"),
        (F.lit(1.0) - F.try_divide(F.col("_cum_nn"), F.col("_n_nn"))).alias("specificity"),
    )


def roc_points_all(df: DataFrame, truth: str, prob: Mapping[str, str]) -> DataFrame:
    """ROC curve of every level against the rest, with its end points: (0, 1) at
    a threshold above every score (null) and (1, 0) at the lowest score."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(c).cast("double").alias("v"),
                                                   (F.col(truth) == lv).alias("pos")) for lv, c in prob.items()])).alias("s")).select("s.*")
    start = df.sparkSession.createDataFrame([(lv, None, 0.0, 1.0) for lv in prob], "level string, threshold double, sensitivity double, specificity double")
    return start.unionByName(_roc(long))


def metric_table(df: DataFrame, truth: str, pred: str, prob: Mapping[str, str], model: str,
                 by: Sequence[str] = ()) -> DataFrame:
    """Long metric table: model, [by...], metric, estimator, estimate. With
    ``by`` (e.g. grid point and fold) every group is scored in the same job."""
    levels = list(prob)
    by = list(by)
    acc = accuracy(df, truth, pred, by).select(*by, F.lit("accuracy").alias("metric"),
                                               F.lit("multiclass").alias("estimator"), F.col("accuracy").alias("estimate"))
    f = macro_prf(df, truth, pred, levels, by).select(*by, F.lit("f_meas").alias("metric"), F.lit("macro").alias("estimator"),
                                                      F.col("f_meas").alias("estimate"))
    auc = hand_till_auc(df, truth, prob, by).select(*by, F.lit("roc_auc").alias("metric"),
                                                    F.lit("hand_till").alias("estimator"), F.col("roc_auc").alias("estimate"))
    return acc.unionByName(f).unionByName(auc).select(F.lit(model).alias("model"), "*")


def model_comparison(df: DataFrame, truth: str, pred: str, prob: Mapping[str, str], model: str) -> DataFrame:
    """One row per model: AUC, macro precision, macro recall, macro F1."""
    levels = list(prob)
    m = macro_prf(df, truth, pred, levels)
    a = hand_till_auc(df, truth, prob)
    return m.withColumn("roc_auc", a.select("roc_auc").scalar()).select(
        F.lit(model).alias("model"), "roc_auc", "precision", "recall", F.col("f_meas").alias("f1"))


def ensemble_average(a: DataFrame, b: DataFrame, key: str, prob: Mapping[str, str], pred: str = "pred") -> DataFrame:
    """Average two models' probabilities per row (joined on the key); class = argmax."""
    levels = list(prob)
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in prob.values()]).join(
        b.select(key, *[F.col(c).alias(f"b_{c}") for c in prob.values()]), key)
    avg = {c: (F.col(f"a_{c}") + F.col(f"b_{c}")) / 2 for c in prob.values()}
    out = j.select(key, *[v.alias(k) for k, v in avg.items()])
    return out.withColumn(pred, argmax_level(prob))


def argmax_level(prob: Mapping[str, str]):
    """Level with the largest probability; ties go to the earlier level."""
    levels = list(prob)
    expr = None
    for i, lv in enumerate(levels[:-1]):
        cond = None
        for other in levels[i + 1:]:
            c = F.col(prob[lv]) >= F.col(prob[other])
            cond = c if cond is None else cond & c
        expr = (F.when if expr is None else expr.when)(cond, F.lit(lv))
    return expr.otherwise(F.lit(levels[-1]))
