"""Cleaning and imputation composites (joins, parsing, ages, medians, caps).

Whole-table statistics (medians, bounds) are attached to rows as scalar
subqueries: Spark runs the small aggregate once and ships one row to the
tasks, so no cross join and no keyless window (which would be one task).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.session import checkpoint as _ckpt
from pyspark.sql import types as T

from sitewise.functions import columns as C
from sitewise.functions.quantiles import exact_quantiles, median_struct
from sitewise.operators.windows import attach

# Fixed value: the region parameter that means "no region filter".
ALL_REGIONS = "All Regions"


# ---------------------------------------------------------------- joins

def left_join(values: DataFrame, labels: DataFrame, on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """values left-joined to labels. With ``null_safe`` a missing key matches a
    missing key, as in the reference's join verbs."""
    on = list(on)
    if not null_safe:
        return values.join(labels, on, "left")
    v, lab = values.alias("v"), labels.alias("lab")
    cond = reduce(lambda a, b: a & b, [F.col(f"v.{k}").eqNullSafe(F.col(f"lab.{k}")) for k in on])
    rest = [F.col(f"lab.{c}") for c in labels.columns if c not in on]
    return v.join(lab, cond, "left").select("v.*", *rest)


def attach_group_stat(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a per-group statistic back onto each row (grouped mutate)."""
    return attach(df, stats, list(by))


# ---------------------------------------------------------------- imputation

def _typed(median: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.floor(median).cast(dtype)
    return median.cast(dtype)


def median_impute(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Missing (null or NaN) numeric values -> the column's exact median."""
    cols = list(cols) if cols is not None else C.columns_of_type(df, "numeric", exclude)
    if not cols:
        return df
    med = median_struct(df, cols)
    out = df.withColumn("_med", med)
    repl = {}
    for c in cols:
        dt = df.schema[c].dataType
        cur = C.nan_to_null(c) if isinstance(dt, C.FRACTIONAL_TYPES) else F.col(c)
        repl[c] = F.coalesce(cur, _typed(F.col("_med").getField(c), dt))
    return out.withColumns(repl).drop("_med")


def repair_negative(df: DataFrame, col: str) -> DataFrame:
    """Negative or missing value -> median of the column (negatives included)."""
    m = median_struct(df, [col]).getField(col)
    v = F.col(col)
    return df.withColumn(col, F.when(v.isNull() | (v < 0), m).otherwise(v))


# ---------------------------------------------------------------- caps and bins

def outlier_cap(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Drop zeros; bound = median + k * IQR of the rest; flag and truncate above it."""
    kept = df.where(F.col(col) != 0)
    q = exact_quantiles(kept, col, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    bound = q.select((F.col("q50") + F.lit(k) * (F.col("q75") - F.col("q25"))).alias("b")).scalar()
    return kept.withColumn("upper_bound", bound).withColumns(
        {
            "is_outlier": F.col(col) > F.col("upper_bound"),
            f"{col}_capped": F.when(F.col(col) > F.col("upper_bound"), F.col("upper_bound")).otherwise(F.col(col)),
        }
    )


def equal_width_bins(df: DataFrame, col: str, n_bins: int, out: str = "bin", by: Sequence[str] = ()) -> DataFrame:
    """Bin index 0..n-1 on [min, max] (per group if ``by``); max lands in the last bin."""
    by = list(by)
    x = C.nan_to_null(col) if C.is_fractional(df, col) else F.col(col)
    if by:
        ext = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        d = attach(df, ext, by, "inner")
    else:
        s = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()
        d = df.withColumn("_s", s).withColumns({"_lo": F.col("_s.lo"), "_hi": F.col("_s.hi")}).drop("_s")
    width = F.col("_hi") - F.col("_lo")
    raw = F.floor((x - F.col("_lo")) / F.nullif(width, F.lit(0)) * F.lit(n_bins))
    b = F.when(x.isNull(), None).when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(n_bins - 1)))
    return d.withColumn(out, b.cast("int")).drop("_lo", "_hi")


def quantile_bins(df: DataFrame, col: str, n_bins: int = 4, out: str = "bin") -> DataFrame:
    """Bin a heavy-tailed column by its exact quantiles: bin = number of the
    n-1 inner quantile boundaries strictly below the value (0..n-1)."""
    probs = [i / n_bins for i in range(1, n_bins)]
    names = [f"b{i}" for i in range(1, n_bins)]
    q = exact_quantiles(df, col, probs, names).select(F.array(*names).alias("b")).scalar()
    x = F.col(col)
    b = F.when(x.isNull(), None).otherwise(F.size(F.filter(F.col("_b"), lambda t: t < x)))
    return df.withColumn("_b", q).withColumn(out, b.cast("int")).drop("_b")


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / sd, sd the sample one; statistics in one scalar subquery."""
    s = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols]).alias("st")
    ).scalar()
    out = df.withColumn("_st", s)
    out = out.withColumns(
        {f"{c}_z": (F.col(c) - F.col(f"_st.{c}.m")) / F.nullif(F.col(f"_st.{c}.s"), F.lit(0.0)) for c in cols}
    )
    return out.drop("_st")


# ---------------------------------------------------------------- composites

def clean_table(
    values: DataFrame,
    labels: DataFrame,
    key: str,
    recorded: str,
    installed: str,
    region_col: str = "region",
    region: str | None = None,
    start_year: int | None = None,
    drop: Sequence[str] = (),
    impute_exclude: Sequence[str] = (),
    age_col: str = "asset_age",
    null_safe_key: bool = False,
    impute: bool = True,
    materialize: bool = True,
) -> DataFrame:
    """Join -> parse dates -> age -> Unknown level -> parameter filter -> drop
    -> age repair -> median imputation. Medians come from the filtered rows and
    are computed in one pass for every numeric column.

    With ``materialize`` the filtered join is checkpointed once into the
    shared folder, so the medians and the output read it instead of running
    the join twice (and a lost executor does not redo the join).
    ``impute=False`` stops after the filter and drop (for callers that only
    count rows per category, which imputation cannot change)."""
    df = left_join(values, labels, [key], null_safe_key)
    df = df.withColumns({recorded: C.as_date(df, recorded), installed: C.as_date(df, installed)})
    df = df.withColumn(age_col, C.age_years(recorded, installed))
    df = df.withColumns({c: C.unknown_level(c) for c in C.columns_of_type(df, "string")})
    if region is not None and region != ALL_REGIONS:
        df = df.where(F.col(region_col) == region)
    if start_year is not None:
        df = df.where(C.year_at_least(installed, start_year))
    df = df.drop(*drop)
    if not impute:
        return df
    if materialize:
        df = _ckpt(df)
    num = C.columns_of_type(df, "numeric", [key, *impute_exclude])
    med = median_struct(df, num)
    age = F.col(age_col)
    out = df.withColumn("_med", med).withColumn(
        age_col, F.when(age.isNull() | (age < 0), F.col("_med").getField(age_col)).otherwise(age)
    )
    repl = {}
    for c in num:
        if c == age_col:
            continue
        dt = df.schema[c].dataType
        cur = C.nan_to_null(c) if isinstance(dt, C.FRACTIONAL_TYPES) else F.col(c)
        repl[c] = F.coalesce(cur, _typed(F.col("_med").getField(c), dt))
    return out.withColumns(repl).drop("_med")


def clean_names_copy(df: DataFrame, drop: Sequence[str], text_cols: Sequence[str], recorded: str, installed: str,
                     age_col: str = "asset_age") -> DataFrame:
    """Alternative clean: drop name columns, add lower/trim ``*_cleaned`` copies, age."""
    out = df.drop(*drop)
    out = out.withColumns({f"{c}_cleaned": C.clean_string(c) for c in text_cols})
    return out.withColumn(age_col, C.age_years(C.as_date(out, recorded), C.as_date(out, installed)))


def column_profile_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_missing, n_distinct, min, max) per column, numeric values as double.

    One aggregate for all columns, then reshaped; distinct counts are exact."""
    aggs = []
    numeric = set(C.columns_of_type(df, "numeric"))
    for c in cols:
        frac = C.is_fractional(df, c)
        x = C.nan_to_null(c) if frac else F.col(c)
        num = c in numeric
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(C.is_missing(c, frac)).cast("long").alias("n_missing"),
                F.count_distinct(x).cast("long").alias("n_distinct"),
                (F.min(x).cast("double") if num else F.lit(None).cast("double")).alias("min"),
                (F.max(x).cast("double") if num else F.lit(None).cast("double")).alias("max"),
            )
        )
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def action_ledger(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Measured change per column between two versions of a table:
    dropped / imputed / changed / unchanged."""
    kept = [c for c in cols if c in after.columns]
    b = column_profile_long(before, cols).alias("b")
    a = column_profile_long(after, kept).alias("a") if kept else None
    if a is None:
        return b.select("column", F.lit("dropped").alias("action"), F.col("n_missing").alias("missing_before"),
                        F.lit(None).cast("long").alias("missing_after"))
    j = b.join(a, "column", "full")
    action = (
        F.when(F.col("a.n_missing").isNull(), "dropped")
        .when(F.col("a.n_missing") < F.col("b.n_missing"), "imputed")
        .when(
            (F.col("a.n_distinct") != F.col("b.n_distinct"))
            | ~F.col("a.min").eqNullSafe(F.col("b.min"))
            | ~F.col("a.max").eqNullSafe(F.col("b.max")),
            "changed",
        )
        .otherwise("unchanged")
    )
    return j.select(
        "column",
        action.alias("action"),
        F.col("b.n_missing").alias("missing_before"),
        F.col("a.n_missing").alias("missing_after"),
    )


def drop_sparse_columns(df: DataFrame, max_missing_share: float = 0.3) -> tuple[DataFrame, list[str]]:
    """Drop columns with more than the given share missing. One aggregate row
    (one number per column) is read on the driver to decide the projection."""
    if not df.columns:
        return df, []
    aggs = [
        F.avg(C.is_missing(c, C.is_fractional(df, c)).cast("double")).alias(c) for c in df.columns
    ]
    row = df.agg(*aggs).first()
    dropped = [c for c in df.columns if row[c] is not None and row[c] > max_missing_share]
    return df.drop(*dropped), dropped
