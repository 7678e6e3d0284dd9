"""Registered queries: cleaning composites and the flagship clean table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import clean as CL
from sitewise.plans import bindings as B
from sitewise.plans.registry import r6, register

CLEAN_DROP = ["l_partkey", "l_linestatus"]
NUM_COLS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "region_code", "o_totalprice"]


def cleaned(spark, d, region="AFRICA", start_year=1996, impute=True):
    df = CL.clean_table(
        B.site_values(spark, d),
        B.site_labels(spark, d),
        key="id",
        recorded="l_shipdate",
        installed="o_orderdate",
        region=region,
        start_year=start_year,
        drop=CLEAN_DROP,
        impute=impute,
    )
    if not impute:
        return df
    return df.withColumns({"asset_age": r6("asset_age"), "l_discount": r6("l_discount")})


def clean_sql(region: str | None = "AFRICA", start_year: int | None = 1996) -> str:
    """CTE chain ending in ``c`` = the cleaned table."""
    conds = []
    if region is not None and region != CL.ALL_REGIONS:
        conds.append(f"region = '{region}'")
    if start_year is not None:
        conds.append(f"o_orderdate >= DATE '{start_year}-01-01'")
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUM_COLS + ["asset_age"])
    return f"""
v AS ({B.SITE_VALUES_SQL}),
lab AS ({B.SITE_LABELS_SQL}),
j AS (
  SELECT v.id, v.l_linenumber, v.l_quantity, v.l_extendedprice, v.l_discount, v.l_tax,
         COALESCE(v.l_returnflag, 'Unknown') AS l_returnflag, CAST(v.l_shipdate AS DATE) AS l_shipdate,
         COALESCE(v.region, 'Unknown') AS region, v.region_code, COALESCE(v.lga, 'Unknown') AS lga,
         COALESCE(v.ward, 'Unknown') AS ward, COALESCE(lab.status_group, 'Unknown') AS status_group,
         CAST(lab.o_orderdate AS DATE) AS o_orderdate, lab.o_totalprice,
         CAST(date_diff('day', CAST(lab.o_orderdate AS DATE), CAST(v.l_shipdate AS DATE)) AS DOUBLE) / 365.25 AS asset_age
  FROM v LEFT JOIN lab ON v.id = lab.id),
f AS (SELECT * FROM j {where}),
m AS (SELECT {meds} FROM f),
c AS (
  SELECT id,
         COALESCE(l_linenumber, CAST(floor(m_l_linenumber) AS INTEGER)) AS l_linenumber,
         COALESCE(l_quantity, m_l_quantity) AS l_quantity,
         COALESCE(l_extendedprice, m_l_extendedprice) AS l_extendedprice,
         round(COALESCE(l_discount, m_l_discount), 6) AS l_discount,
         COALESCE(l_tax, m_l_tax) AS l_tax,
         l_returnflag, l_shipdate, region,
         COALESCE(region_code, CAST(floor(m_region_code) AS INTEGER)) AS region_code,
         lga, ward, status_group, o_orderdate,
         COALESCE(o_totalprice, m_o_totalprice) AS o_totalprice,
         round(CASE WHEN asset_age IS NULL OR asset_age < 0 THEN m_asset_age ELSE asset_age END, 6) AS asset_age
  FROM f, m)"""


register("clean_table", sql=f"WITH {clean_sql()} SELECT * FROM c")(lambda spark, d: cleaned(spark, d))


@register(
    "status_share_by_region",
    sql=f"""WITH {clean_sql(CL.ALL_REGIONS, 1996)}
SELECT region, status_group, COUNT(*) AS n,
       round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY region), 6) AS share
FROM c GROUP BY region, status_group""",
)
def status_share_by_region(spark, d):
    from sitewise.plans.report import share_within_group

    # Counts per (region, status) cannot change under imputation, so the
    # clean step stops after the filter; the result equals the full clean.
    df = cleaned(spark, d, CL.ALL_REGIONS, 1996, impute=False)
    return share_within_group(df, ["region"], "status_group")


# ---------------------------------------------------------------- single cleaning steps

AGE_SQL = """SELECT l.l_orderkey, l.l_linenumber,
  CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS DOUBLE) / 365.25 AS age
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""


def _ages(spark, d):
    from sitewise.functions import columns as C

    li, o = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", C.age_years(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("age"))


@register(
    "age_repair",
    sql=f"""WITH a AS ({AGE_SQL}), m AS (SELECT quantile_cont(age, 0.5) AS med FROM a)
SELECT l_orderkey, l_linenumber, round(CASE WHEN age IS NULL OR age < 0 THEN med ELSE age END, 6) AS age FROM a, m""",
)
def age_repair(spark, d):
    return CL.repair_negative(_ages(spark, d), "age").withColumn("age", r6("age"))


IMP_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
IMP_SRC = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, NULLIF(l_discount, 0.0) AS l_discount, NULLIF(l_tax, 0.0) AS l_tax FROM lineitem"


@register(
    "median_impute",
    sql=f"""WITH t AS ({IMP_SRC}),
m AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMP_COLS)} FROM t)
SELECT l_orderkey, l_linenumber, {", ".join(f"round(COALESCE({c}, m_{c}), 6) AS {c}" for c in IMP_COLS)} FROM t, m""",
)
def median_impute(spark, d):
    li = B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"), F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"))
    out = CL.median_impute(li, IMP_COLS)
    return out.withColumns({c: r6(c) for c in IMP_COLS})


@register(
    "outlier_cap",
    sql="""WITH k AS (SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <> 0),
q AS (SELECT quantile_cont(l_discount, 0.5) + 1.5 * (quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25)) AS b FROM k)
SELECT l_orderkey, l_linenumber, l_discount, round(b, 6) AS upper_bound, l_discount > b AS is_outlier,
       round(CASE WHEN l_discount > b THEN b ELSE l_discount END, 6) AS l_discount_capped FROM k, q""",
)
def outlier_cap(spark, d):
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    out = CL.outlier_cap(li, "l_discount", 1.5)
    return out.withColumns({"upper_bound": r6("upper_bound"), "l_discount_capped": r6("l_discount_capped")})


@register(
    "bin_amount",
    sql="""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS b1, quantile_cont(o_totalprice, 0.5) AS b2,
                         quantile_cont(o_totalprice, 0.75) AS b3 FROM orders)
SELECT o_orderkey, o_totalprice,
  CAST((CASE WHEN b1 < o_totalprice THEN 1 ELSE 0 END) + (CASE WHEN b2 < o_totalprice THEN 1 ELSE 0 END)
       + (CASE WHEN b3 < o_totalprice THEN 1 ELSE 0 END) AS INTEGER) AS bin FROM orders, q""",
)
def bin_amount(spark, d):
    o = B.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return CL.quantile_bins(o, "o_totalprice", 4)


@register(
    "standardize",
    sql="""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                         stddev_samp(l_extendedprice) AS sp FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity_z,
       round((l_extendedprice - mp) / sp, 6) AS l_extendedprice_z FROM lineitem, s""",
)
def standardize(spark, d):
    li = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    z = CL.standardize(li, ["l_quantity", "l_extendedprice"])
    return z.select("l_orderkey", "l_linenumber", r6("l_quantity_z"), r6("l_extendedprice_z"))


COPY_TEXT = ["region", "lga", "ward", "l_returnflag"]
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@register(
    "clean_names_copy",
    sql=f"""WITH v AS ({B.SITE_VALUES_SQL}), lab AS ({B.SITE_LABELS_SQL})
SELECT v.id, v.l_linenumber, v.region, v.lga, v.ward, v.l_returnflag, v.l_shipdate, lab.o_orderdate,
       {", ".join(f"lower({STRIP.format(c='v.' + c)}) AS {c}_cleaned" for c in COPY_TEXT)},
       round(CAST(date_diff('day', CAST(lab.o_orderdate AS DATE), CAST(v.l_shipdate AS DATE)) AS DOUBLE) / 365.25, 6) AS asset_age
FROM v LEFT JOIN lab ON v.id = lab.id""",
)
def clean_names_copy(spark, d):
    j = CL.left_join(B.site_values(spark, d), B.site_labels(spark, d), ["id"])
    j = j.select("id", "l_linenumber", "region", "lga", "ward", "l_returnflag", "l_shipdate", "o_orderdate", "l_partkey")
    out = CL.clean_names_copy(j, ["l_partkey"], COPY_TEXT, "l_shipdate", "o_orderdate")
    return out.withColumn("asset_age", r6("asset_age"))


LEDGER_COLS = ["l_discount", "l_quantity", "l_partkey", "l_linestatus", "region"]


def _profile_sql(src: str, cols, numeric) -> str:
    parts = []
    for c in cols:
        miss = f"{c} IS NULL OR isnan({c})" if c in ("l_discount", "l_quantity") else f"{c} IS NULL"
        mn = f"CAST(min({c}) AS DOUBLE)" if c in numeric else "NULL::DOUBLE"
        mx = f"CAST(max({c}) AS DOUBLE)" if c in numeric else "NULL::DOUBLE"
        parts.append(f"SELECT '{c}' AS col, COUNT(*) FILTER (WHERE {miss}) AS n_missing, COUNT(DISTINCT {c}) AS n_distinct, "
                     f"{mn} AS mn, {mx} AS mx FROM {src}")
    return " UNION ALL ".join(parts)


_NUMERIC = {"l_discount", "l_quantity", "l_partkey"}


@register(
    "action_ledger",
    sql=f"""WITH {clean_sql()},
raw AS (SELECT v.*, lab.status_group, lab.o_orderdate, lab.o_totalprice FROM v LEFT JOIN lab ON v.id = lab.id),
b AS ({_profile_sql("raw", LEDGER_COLS, _NUMERIC)}),
a AS ({_profile_sql("c", ["l_discount", "l_quantity", "region"], _NUMERIC)})
SELECT b.col AS "column",
  CASE WHEN a.n_missing IS NULL THEN 'dropped' WHEN a.n_missing < b.n_missing THEN 'imputed'
       WHEN a.n_distinct <> b.n_distinct OR a.mn IS DISTINCT FROM b.mn OR a.mx IS DISTINCT FROM b.mx THEN 'changed'
       ELSE 'unchanged' END AS action,
  b.n_missing AS missing_before, a.n_missing AS missing_after
FROM b FULL JOIN a ON b.col = a.col""",
)
def action_ledger(spark, d):
    raw = CL.left_join(B.site_values(spark, d), B.site_labels(spark, d), ["id"])
    after = cleaned(spark, d)
    return CL.action_ledger(raw, after, LEDGER_COLS)
