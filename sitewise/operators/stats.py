"""Aggregates: summaries, histograms, profiles, correlation and association
measures (G6-G9, G16-G28).

Multi-column statistics run as one aggregate (or one long-form aggregate
keyed by the column name), never a loop of jobs. Association measures work
from contingency counts of observed cells only: the identity
chi2 = N * (sum n_ab^2 / (n_a n_b) - 1) needs no level x level grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import columns as C
from sitewise.functions.quantiles import columns_quantiles, exact_quantiles
from sitewise.session import checkpoint


def _val(df: DataFrame, c: str):
    return C.nan_to_null(c) if C.is_fractional(df, c) else F.col(c).cast("double")


# ---------------------------------------------------------------- summaries

def numeric_summary_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """variable, min, median, mean, stdev, q25, q75, max -- missing ignored."""
    q = columns_quantiles(df, cols, [0.25, 0.5, 0.75], ["q25", "median", "q75"])
    parts = [
        F.struct(
            F.lit(c).alias("variable"),
            F.min(_val(df, c)).alias("min"),
            F.avg(_val(df, c)).alias("mean"),
            F.stddev_samp(_val(df, c)).alias("stdev"),
            F.max(_val(df, c)).alias("max"),
        )
        for c in cols
    ]
    basic = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return basic.join(q, "variable", "left")


SUMMARY_STATS = ["min", "median", "mean", "stdev", "q25", "q75", "max"]


def numeric_summary_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row, columns ``<variable>_<stat>``."""
    long = numeric_summary_long(df, cols)
    return long.groupBy().pivot("variable", list(cols)).agg(*[F.first(s).alias(s) for s in SUMMARY_STATS])


def quantile_row(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(df, col, probs, names, by)


def iqr_table(df: DataFrame, col: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], ["q25", "median", "q75"], by)
    iqr = F.col("q75") - F.col("q25")
    return q.select(*by, "q25", "median", "q75", iqr.alias("iqr"), (F.col("median") + F.lit(k) * iqr).alias("upper_bound"))


# ---------------------------------------------------------------- histograms

def histogram(df: DataFrame, col: str, n_bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins on [min, max] (per group); counts and bin edges."""
    from sitewise.operators.clean import equal_width_bins

    by = list(by)
    x = _val(df, col)
    d = df.select(*by, x.alias("x")).where(F.col("x").isNotNull())
    b = equal_width_bins(d, "x", n_bins, "bin", by)
    return b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def histogram_long(df: DataFrame, cols: Sequence[str], n_bins: int = 30) -> DataFrame:
    """Faceted histogram: one long frame keyed by variable, bins per variable."""
    long = df.select(*[_val(df, c).alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    return histogram(long, "value", n_bins, ["variable"])


# ---------------------------------------------------------------- profiles

def profile_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    q = columns_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0], ["p0", "p25", "p50", "p75", "p100"])
    parts = [
        F.struct(
            F.lit(c).alias("variable"),
            F.count_if(C.is_missing(c, C.is_fractional(df, c))).cast("long").alias("n_missing"),
            F.avg((~C.is_missing(c, C.is_fractional(df, c))).cast("double")).alias("complete_rate"),
            F.avg(_val(df, c)).alias("mean"),
            F.stddev_samp(_val(df, c)).alias("sd"),
        )
        for c in cols
    ]
    basic = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return basic.join(q, "variable", "left")


def profile_string(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    parts = []
    for c in cols:
        x = F.col(c)
        parts.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.count_if(x.isNull()).cast("long").alias("n_missing"),
                F.avg(x.isNotNull().cast("double")).alias("complete_rate"),
                F.min(F.length(x)).cast("long").alias("min_len"),
                F.max(F.length(x)).cast("long").alias("max_len"),
                F.count_if(x == "").cast("long").alias("n_empty"),
                F.count_distinct(x).cast("long").alias("n_unique"),
                F.count_if(x.rlike(r"^\s+$")).cast("long").alias("n_whitespace"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def profile_date(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min, max, median (floored to a day), distinct days, missing."""
    days = df.select(*[F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).alias(c) for c in cols])
    med = columns_quantiles(days, cols, [0.5], ["m"])
    parts = [
        F.struct(
            F.lit(c).alias("variable"),
            F.count_if(F.col(c).isNull()).cast("long").alias("n_missing"),
            F.min(F.to_date(c)).alias("min"),
            F.max(F.to_date(c)).alias("max"),
            F.count_distinct(F.to_date(c)).cast("long").alias("n_unique"),
        )
        for c in cols
    ]
    basic = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    med = med.select("variable", F.date_add(F.lit("1970-01-01").cast("date"), F.floor("m").cast("int")).alias("median"))
    return basic.join(med, "variable", "left")


def profile_boolean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing, true and false counts, and the share of true, of boolean columns."""
    parts = [
        F.struct(
            F.lit(c).alias("variable"),
            F.count_if(F.col(c).isNull()).cast("long").alias("n_missing"),
            F.avg(F.col(c).isNotNull().cast("double")).alias("complete_rate"),
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.count_if(F.col(c)).cast("long").alias("n_true"),
            F.count_if(~F.col(c)).cast("long").alias("n_false"),
        )
        for c in cols
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def profile_category(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing count, distinct levels and the count of the most frequent level
    of category columns, all from one count per (column, level)."""
    c = level_counts(df, cols)
    real = F.col("value").isNotNull()
    return c.groupBy(F.col("name").alias("variable")).agg(
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).cast("long").alias("n_missing"),
        F.count_if(real).cast("long").alias("n_unique"),
        F.max(F.when(real, F.col("n"))).cast("long").alias("top_n"),
    )


def model_facts(folds: DataFrame, fold: str, features: Sequence[str]) -> DataFrame:
    """Number of folds, of features and of rows behind a model, as the report states them."""
    return folds.agg(
        F.count_distinct(fold).cast("long").alias("n_folds"), F.lit(len(features)).cast("long").alias("n_features"),
        F.count(F.lit(1)).alias("n_rows"))


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, value, n) for several category columns in long form."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "name", "value")
    return long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, cols: Sequence[str], k: int = 3) -> DataFrame:
    """Most frequent k levels of each category column (ties by value)."""
    c = level_counts(df, cols).where(F.col("value").isNotNull())
    w = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    return c.withColumn("rnk", F.row_number().over(w).cast("int")).where(F.col("rnk") <= k)


# ---------------------------------------------------------------- correlation

def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every unordered pair, pairwise-complete."""
    parts = [
        F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.corr(_val(df, a), _val(df, b)).alias("corr"))
        for a, b in combinations(cols, 2)
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def linear_smooth_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Least-squares line y ~ x for every ordered pair: slope, intercept, r2."""
    parts = [
        F.struct(
            F.lit(y).alias("y"),
            F.lit(x).alias("x"),
            F.regr_slope(_val(df, y), _val(df, x)).alias("slope"),
            F.regr_intercept(_val(df, y), _val(df, x)).alias("intercept"),
            F.regr_r2(_val(df, y), _val(df, x)).alias("r2"),
        )
        for y, x in permutations(cols, 2)
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


# ---------------------------------------------------------------- association

def _contingency(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, a, b, n_ab, n_a, n_b, n, r, c) over observed cells; rows with a
    missing value on either side are left out."""
    long = df.select(
        F.col(target).cast("string").alias("b"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("a")) for f in features])),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    # Written once: every margin below reads the cells, not the input.
    cells = checkpoint(long.groupBy("feature", "a", "b").agg(F.count(F.lit(1)).alias("n_ab")))
    # Margins by aggregation (partial sums before the shuffle), joined back on
    # their keys: no window holds all cells of a high-cardinality feature.
    row_m = cells.groupBy("feature", "a").agg(F.sum("n_ab").alias("n_a"))
    col_m = cells.groupBy("feature", "b").agg(F.sum("n_ab").alias("n_b"))
    tot = cells.groupBy("feature").agg(
        F.sum("n_ab").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    return cells.join(row_m, ["feature", "a"]).join(col_m, ["feature", "b"]).join(tot, "feature")


def cramers_v(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Cramér's V of each category feature against the target."""
    t = _contingency(df, features, target)
    g = t.groupBy("feature").agg(
        F.sum(F.col("n_ab") * F.col("n_ab") / (F.col("n_a") * F.col("n_b"))).alias("s"),
        F.first("n").alias("n"),
        F.first("r").alias("r"),
        F.first("c").alias("c"),
    )
    chi2 = F.col("n") * (F.col("s") - 1)
    k = F.least(F.col("r"), F.col("c")) - 1
    v = F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("n") * F.nullif(k, F.lit(0))))
    return g.select("feature", chi2.alias("chi2"), v.alias("cramers_v"))


def theils_u(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Uncertainty coefficient U(target | feature) = 1 - H(target|feature)/H(target)."""
    t = _contingency(df, features, target)
    p_ab = F.col("n_ab") / F.col("n")
    h_b_given_a = -F.sum(p_ab * F.ln(F.col("n_ab") / F.col("n_a")))
    hb = t.select("feature", "b", "n_b", "n").distinct().groupBy("feature").agg(
        (-F.sum(F.col("n_b") / F.col("n") * F.ln(F.col("n_b") / F.col("n")))).alias("h_target")
    )
    cond = t.groupBy("feature").agg(h_b_given_a.alias("h_cond"))
    j = cond.join(hb, "feature")
    u = F.when(F.col("h_target") == 0, F.lit(1.0)).otherwise((F.col("h_target") - F.col("h_cond")) / F.col("h_target"))
    return j.select("feature", "h_target", "h_cond", u.alias("theils_u"))


def correlation_ratio(df: DataFrame, numeric: Sequence[str], category: str) -> DataFrame:
    """eta = sqrt(between-group SS / total SS) for each numeric column."""
    long = df.select(
        F.col(category).cast("string").alias("g"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), _val(df, c).alias("x")) for c in numeric])),
    ).where(F.col("x").isNotNull() & F.col("g").isNotNull())
    grp = long.groupBy("variable", "g").agg(F.count(F.lit(1)).alias("n_g"), F.avg("x").alias("m_g"))
    tot = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")
    )
    j = grp.join(tot, "variable")
    between = j.groupBy("variable").agg(
        F.sum(F.col("n_g") * (F.col("m_g") - F.col("m")) * (F.col("m_g") - F.col("m"))).alias("ss_between"),
        F.first(F.col("v") * F.col("n")).alias("ss_total"),
    )
    eta = F.sqrt(F.col("ss_between") / F.nullif(F.col("ss_total"), F.lit(0.0)))
    return between.select("variable", eta.alias("eta"))
