"""Exact quantiles and ordered prefix sums without one task per group.

Spark's exact ``percentile`` keeps a map of every distinct value of a group in
one aggregation buffer: fine for a few million values, fatal for a group that
holds a third of 100 TB. The helpers here keep the same result (linear
interpolation between order statistics, the rule of R's default quantile and
of DuckDB's ``quantile_cont``) with bounded per-task state:

* equal values are collapsed to (value, count), so a hot value becomes one row;
* the (group, value) keys are range-partitioned into slices (Spark's range
  partitioner: sampled bounds, binary search per row), each (group, slice) is
  totalled into a small table whose running sums give the offsets, and ranks
  are taken inside each (group, slice). A big group is spread over many slices
  and tasks, a small one lies in one. There is one path for all sizes, and a
  null group is a group like any other.

The same prefix sum serves the ROC curve, the rank-sum AUC, stratified
splits, folds and the row index used by permutation importance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _group_window(by: list[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def ordered_prefix(
    df: DataFrame,
    order: str | Sequence[str],
    by: Sequence[str] = (),
    weight: str | Sequence[str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``_cum`` (total weight of rows of the group whose order value is at
    or before this row's, ties included) and ``_n`` (group total weight). With
    several weights: ``_cum_<weight>`` and ``_n_<weight>`` of each.

    ``order`` is one or several non-null columns. Callers pass rows with
    distinct (group, order) keys -- values collapsed to counts, or a hash and
    the row's id -- so no range slice can hold a hot key.
    """
    from sitewise.session import checkpoint

    by = list(by)
    keys = [order] if isinstance(order, str) else list(order)
    sort = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    names = [weight] if weight is None or isinstance(weight, str) else list(weight)
    ends = [""] if weight is None or isinstance(weight, str) else [f"_{w}" for w in names]
    w = [F.lit(1).cast("long") if c is None else F.col(c) for c in names]
    wg = _group_window(by)
    # The slice id is part of the data from here on; the checkpoint pins it so
    # the totals and the ranks below read exactly the same slicing.
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = checkpoint(df.repartitionByRange(n_parts, *by, *sort).withColumn("_slice", F.spark_partition_id()))
    tot = sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_bt{e}") for c, e in zip(w, ends)])
    # About groups + n_parts rows: a per-group window over it is small.
    up = wg.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        F.col("_slice").alias("_by_slice"),
        *[F.coalesce(F.sum(f"_bt{e}").over(up), F.lit(0)).alias(f"_off{e}") for e in ends],
        *[F.sum(f"_bt{e}").over(wg).alias(f"_n{e}") for e in ends],
    )
    on = F.col("_slice") == F.col("_by_slice")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    b = sliced.join(tot, on)
    wi = Window.partitionBy(*by, "_slice").orderBy(*sort).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumns({f"_cum{e}": F.col(f"_off{e}") + F.sum(c).over(wi) for c, e in zip(w, ends)})
    return b.drop("_slice", "_by_slice", *[f"_off{e}" for e in ends], *[f"_by_{i}" for i in range(len(by))])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group with one column per probability (type-7 quantiles).

    Missing values (null, NaN) are ignored; a group with no values is absent
    (with no grouping: one row of nulls).
    """
    by = list(by)
    v = df.select(*by, F.col(value).cast("double").alias("_v"))
    v = v.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = v.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_w"))
    ranked = ordered_prefix(counted, "_v", by, weight="_w")
    # Row covers 0-based ranks [_cum - _w, _cum).
    lo_rank = F.col("_cum") - F.col("_w")
    hits, aggs = [], []
    for p, name in zip(probs, names):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        has_lo = (lo >= lo_rank) & (lo < F.col("_cum"))
        has_hi = (hi >= lo_rank) & (hi < F.col("_cum"))
        hits += [has_lo, has_hi]
        ranked = ranked.withColumn(f"_lo_{name}", F.when(has_lo, F.col("_v"))).withColumn(f"_hi_{name}", F.when(has_hi, F.col("_v")))
        aggs += [F.max(f"_lo_{name}").alias(f"_lo_{name}"), F.max(f"_hi_{name}").alias(f"_hi_{name}")]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    picked = ranked.where(any_hit).groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    out = []
    for p, name in zip(probs, names):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo_v, hi_v = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo_v + frac * (hi_v - lo_v)).alias(name))
    return picked.select(*by, *out)


def columns_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Quantiles of many columns in one pass: long form keyed by ``variable``."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), "variable", "value"
    )
    return exact_quantiles(long, "value", probs, names, [*by, "variable"])


def medians_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row frame holding the exact median of every column (null if none)."""
    long = columns_quantiles(df, cols, [0.5], ["median"])
    return long.groupBy().pivot("variable", list(cols)).agg(F.first("median"))


def median_struct(df: DataFrame, cols: Sequence[str]) -> Column:
    """Scalar-subquery column: a struct of the medians of ``cols``."""
    return medians_row(df, cols).select(F.struct(*[F.col(c) for c in cols]).alias("m")).scalar()


def row_index(df: DataFrame, order: str | Sequence[str]) -> DataFrame:
    """Dense 0-based position of each row in the order of a unique key."""
    return ordered_prefix(df, order).withColumn("_pos", F.col("_cum") - 1).drop("_cum", "_n")
