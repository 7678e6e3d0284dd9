"""Data-quality checks: keys, code/name mappings, hierarchies, coordinates,
missing counts (G1-G5, G10-G15, U3, U5, P9).

All checks are aggregations; none pulls rows to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import columns as C

# The valid coordinate box of the survey area (degrees).
LON_MIN, LON_MAX = 29.0, 41.0
LAT_MIN, LAT_MAX = -12.0, 0.0


def count_by(df: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Rows per key; a missing key is its own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return count_by(df, keys).where(F.col("n") > 1)


def distinct_with_missing(c: str) -> Column:
    """Distinct count where a missing value counts as one more value."""
    return (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).cast("long")


def mapping_violations(df: DataFrame, key: Sequence[str] | str, mapped: str, out: str = "n_distinct") -> DataFrame:
    """Keys that map to more than one value of ``mapped`` (mapping not a function)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(distinct_with_missing(mapped).alias(out)).where(F.col(out) > 1)


def hierarchy_violations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each (child, parent) pair: child values with several parents.

    One pass: the pairs are stacked into (hierarchy, child, parent) rows,
    then one aggregation keyed by (hierarchy, child)."""
    parts = [
        F.struct(
            F.lit(f"{child}>{parent}").alias("hierarchy"),
            F.col(child).cast("string").alias("child_value"),
            F.col(parent).cast("string").alias("parent_value"),
        )
        for child, parent in pairs
    ]
    long = df.select(F.inline(F.array(*parts)))
    return long.groupBy("hierarchy", "child_value").agg(distinct_with_missing("parent_value").alias("n_parents")).where(
        F.col("n_parents") > 1
    )


def invalid_coords(lon: str = "lon", lat: str = "lat") -> Column:
    """True when a coordinate is missing or outside the survey box; never null."""
    bad = C.is_missing(lon) | C.is_missing(lat)
    return bad | (F.col(lat) < LAT_MIN) | (F.col(lat) > LAT_MAX) | (F.col(lon) < LON_MIN) | (F.col(lon) > LON_MAX)


def spread_check(df: DataFrame, by: Sequence[str], lat: str, lon: str, threshold: float) -> DataFrame:
    """Sample sd of latitude and longitude per area; keep areas above a threshold."""
    g = df.groupBy(*by).agg(
        F.stddev_samp(lat).alias("lat_sd"), F.stddev_samp(lon).alias("lon_sd"), F.count(F.lit(1)).alias("n")
    )
    return g.where((F.col("lat_sd") > threshold) | (F.col("lon_sd") > threshold))


def na_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, na_count) for every column: one aggregate, then unpivot."""
    cols = list(cols) if cols is not None else df.columns
    wide = df.agg(*[F.count_if(C.is_missing(c, C.is_fractional(df, c))).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "na_count")


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """table(): counts per value, missing values left out."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def distinct_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
