"""Report tables (R1-R5) and the shares they are built from.

A report is one long table over one filtered input, built from a single
rollup aggregate. A batch of regions is one job keyed by region, never a loop
of jobs, and the national report is the same code with a constant region.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions import columns as C

# Report parameter rules.
MIN_START_YEAR = 2000
REPORT_TYPES = ("overall", "single", "batch")
ALL_REGIONS = "All Regions"


def share_within_group(df: DataFrame, by: Sequence[str], level: str, n: str = "n", share: str = "share") -> DataFrame:
    """Count per (group, level) and the level's share of its group.

    Counting first shrinks the data to groups x levels rows; the window then
    runs on that small result only."""
    by = list(by)
    counts = df.groupBy(*by, level).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn(share, F.round(F.col(n) / F.sum(n).over(w), 6))


def class_distribution(df: DataFrame, level: str) -> DataFrame:
    """Count per level and share of the whole table."""
    return share_within_group(df, [], level)


def headline_share(df: DataFrame, level: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows at the target level."""
    pct = F.round(F.avg((F.col(level) == target).cast("double")) * 100, 6).alias("pct")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pct)


def priority_areas(df: DataFrame, area: str, level: str, target: str, threshold: float = 0.3,
                   by: Sequence[str] = ()) -> DataFrame:
    """Areas where the target share exceeds the threshold."""
    share = F.avg((F.col(level) == target).cast("double"))
    g = df.groupBy(*by, area).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("share"))
    return g.where(F.col("share") > threshold)


def cohort_degradation(df: DataFrame, date_col: str, level: str, target: str, start_year: int,
                       lag_years: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Target share per installation year, from start_year + lag onwards."""
    yr = F.year(date_col).cast("int")
    d = df.where(C.year_at_least(date_col, start_year + lag_years))
    return d.groupBy(*by, yr.alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(level) == target).cast("double")), 6).alias("share")
    )


def install_trend(df: DataFrame, date_col: str, level: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per installation year and level."""
    return df.groupBy(*by, F.year(date_col).cast("int").alias("year"), level).agg(F.count(F.lit(1)).alias("n"))


def validate_params(report_type: str, region: str | None, start_year: int, known_regions: Sequence[str] | None = None) -> None:
    """Parameter checks (R4): type known, start year >= 2000, region known."""
    if report_type not in REPORT_TYPES:
        raise ValueError(f"unknown report type {report_type!r}")
    if start_year < MIN_START_YEAR:
        raise ValueError(f"start_year must be at least {MIN_START_YEAR}")
    if report_type == "single" and (region is None or region == ALL_REGIONS):
        raise ValueError("a single report needs a region")
    if known_regions is not None and region not in (None, ALL_REGIONS) and region not in known_regions:
        raise ValueError(f"unknown region {region!r}")


def region_known(df: DataFrame, region_col: str, region: str) -> DataFrame:
    """One row (region, known) -- a bounded lookup, not a scan to the driver (P10)."""
    hit = df.where(F.col(region_col) == region).limit(1).select(F.lit(1).alias("h"))
    return hit.groupBy().agg(F.count(F.lit(1)).alias("c")).select(
        F.lit(region).alias("region"), (F.col("c") > 0).alias("known")
    )


def batch_split(df: DataFrame, region_col: str, regions: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the requested regions, table of requested regions with no rows)."""
    spark = df.sparkSession
    req = spark.createDataFrame([(r,) for r in regions], f"{region_col} string")
    present = df.where(F.col(region_col).isin(list(regions)))
    rejected = req.join(present.select(region_col).distinct(), region_col, "left_anti").withColumn(
        "reason", F.lit("region not found")
    )
    return present, rejected


def report_long(df: DataFrame, region_col: str, level: str, date_col: str, target: str,
                by_region: bool = True, overall_label: str = ALL_REGIONS) -> DataFrame:
    """All report sections (R1-R3) as one long table from one pass.

    One ``rollup(region, level, year)`` aggregate gives the trend rows (full
    key), the distribution rows (region x level) and the headline rows
    (region) together, told apart by ``grouping_id()``; shares and the
    headline percentage come from windows over that small result, keyed by
    region. Columns: region, section, status_group, year, n, value."""
    reg = F.col(region_col) if by_region else F.lit(overall_label)
    d = df.select(reg.alias("region"), F.col(level).alias("status_group"), F.year(date_col).cast("int").alias("year"))
    r = d.rollup("region", "status_group", "year").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    # gid bits: region 4, status 2, year 1 -> 0 trend, 1 distribution, 3 headline, 7 grand total.
    r = r.where(F.col("gid").isin(0, 1, 3))
    w = Window.partitionBy("region")
    total = F.max(F.when(F.col("gid") == 3, F.col("n"))).over(w)
    hit = F.max(F.when((F.col("gid") == 1) & (F.col("status_group") == target), F.col("n"))).over(w)
    r = r.withColumns({"_total": total, "_hit": F.coalesce(hit, F.lit(0))})
    section = F.when(F.col("gid") == 0, "trend").when(F.col("gid") == 1, "distribution").otherwise("headline")
    value = (
        F.when(F.col("gid") == 3, F.round(F.col("_hit") * 100.0 / F.col("_total"), 6))
        .when(F.col("gid") == 1, F.round(F.col("n") / F.col("_total"), 6))
        .otherwise(F.lit(None).cast("double"))
    )
    return r.select(
        "region",
        section.alias("section"),
        F.when(F.col("gid") <= 1, F.col("status_group")).cast("string").alias("status_group"),
        F.when(F.col("gid") == 0, F.col("year")).cast("int").alias("year"),
        "n",
        value.alias("value"),
    )


def risk_strata(df: DataFrame, score: str, out: str = "stratum") -> DataFrame:
    """Tertiles of a risk score: low / medium / high by exact 1/3 and 2/3 quantiles."""
    from sitewise.functions.quantiles import exact_quantiles

    q = exact_quantiles(df, score, [1 / 3, 2 / 3], ["t1", "t2"]).select(F.struct("t1", "t2").alias("t")).scalar()
    x = F.col(score)
    s = F.when(x.isNull(), None).when(x <= F.col("_t.t1"), "low").when(x <= F.col("_t.t2"), "medium").otherwise("high")
    return df.withColumn("_t", q).withColumn(out, s).drop("_t")
