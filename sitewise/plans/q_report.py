"""Registered queries: report tables (R1-R5) and report figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import columns as C
from sitewise.plans import bindings as B
from sitewise.plans import report as RP
from sitewise.plans.registry import register

O = f"({B.ORDER_SITES_SQL}) o"
TARGET = "non functional"
START_YEAR = 2000
BATCH = ["AFRICA", "ASIA", "EUROPE", "Atlantis"]


def report_sql(where: str, by_region: bool) -> str:
    reg = "region" if by_region else "'All Regions'"
    grp = "GROUP BY region" if by_region else ""
    g2 = "region, " if by_region else ""
    part = f"PARTITION BY {reg}" if by_region else ""
    return f"""WITH f AS (SELECT * FROM {O} {where})
SELECT {reg} AS region, 'headline' AS section, NULL::VARCHAR AS status_group, NULL::INTEGER AS year, COUNT(*) AS n,
       round(SUM(CASE WHEN status_group = '{TARGET}' THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 6) AS value FROM f {grp}
UNION ALL
SELECT {reg}, 'distribution', status_group, NULL::INTEGER, COUNT(*),
       round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER ({part}), 6) FROM f GROUP BY {g2} status_group
UNION ALL
SELECT {reg}, 'trend', status_group, CAST(year(o_orderdate) AS INTEGER), COUNT(*), NULL::DOUBLE
FROM f GROUP BY {g2} status_group, year(o_orderdate)"""


@register("report_single", sql=report_sql("WHERE region = 'ASIA' AND o_orderdate >= DATE '2000-01-01'", True))
def report_single(s, d):
    RP.validate_params("single", "ASIA", START_YEAR)
    o = B.order_sites(s, d)
    f = o.where((F.col("region") == "ASIA") & C.year_at_least("o_orderdate", START_YEAR))
    return RP.report_long(f, "region", "status_group", "o_orderdate", TARGET)


@register("report_overall", sql=report_sql("WHERE o_orderdate >= DATE '2000-01-01'", False))
def report_overall(s, d):
    o = B.order_sites(s, d).where(C.year_at_least("o_orderdate", START_YEAR))
    return RP.report_long(o, "region", "status_group", "o_orderdate", TARGET, by_region=False)


@register(
    "report_batch",
    sql=report_sql("WHERE region IN ('AFRICA', 'ASIA', 'EUROPE', 'Atlantis') AND o_orderdate >= DATE '2000-01-01'", True),
)
def report_batch(s, d):
    present, _ = RP.batch_split(B.order_sites(s, d), "region", BATCH)
    return RP.report_long(present.where(C.year_at_least("o_orderdate", START_YEAR)), "region", "status_group", "o_orderdate", TARGET)


@register(
    "report_rejects",
    sql=f"""SELECT r AS region, 'region not found' AS reason FROM (VALUES ('AFRICA'), ('ASIA'), ('EUROPE'), ('Atlantis')) v(r)
WHERE r NOT IN (SELECT DISTINCT region FROM {O})""",
)
def report_rejects(s, d):
    _, rejected = RP.batch_split(B.order_sites(s, d), "region", BATCH)
    return rejected


register(
    "priority_areas",
    sql=f"""SELECT lga, COUNT(*) AS n, round(avg(CASE WHEN status_group = '{TARGET}' THEN 1.0 ELSE 0.0 END), 6) AS share
FROM {O} GROUP BY lga HAVING avg(CASE WHEN status_group = '{TARGET}' THEN 1.0 ELSE 0.0 END) > 0.3""",
)(lambda s, d: RP.priority_areas(B.order_sites(s, d), "lga", "status_group", TARGET, 0.3))

register(
    "cohort_degradation",
    sql=f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n,
  round(avg(CASE WHEN status_group = '{TARGET}' THEN 1.0 ELSE 0.0 END), 6) AS share
FROM {O} WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1""",
)(lambda s, d: RP.cohort_degradation(B.order_sites(s, d), "o_orderdate", "status_group", TARGET, 1990, 5))

register(
    "headline_share",
    sql=f"SELECT COUNT(*) AS n, round(avg(CASE WHEN status_group = '{TARGET}' THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct FROM {O}",
)(lambda s, d: RP.headline_share(B.order_sites(s, d), "status_group", TARGET))

register(
    "risk_strata",
    sql=f"""WITH t AS (SELECT quantile_cont(o_totalprice, 1.0/3) AS t1, quantile_cont(o_totalprice, 2.0/3) AS t2 FROM orders)
SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice <= t1 THEN 'low'
  WHEN o_totalprice <= t2 THEN 'medium' ELSE 'high' END AS stratum FROM orders, t""",
)(lambda s, d: RP.risk_strata(B.table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"))
