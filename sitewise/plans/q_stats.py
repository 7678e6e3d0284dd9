"""Registered queries: quality checks, aggregates, profiles, association
measures and windows (sections 2.4, 2.5 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions import columns as C
from sitewise.functions.quantiles import medians_row
from sitewise.operators import quality as QU
from sitewise.operators import stats as ST
from sitewise.operators import windows as WI
from sitewise.plans import bindings as B
from sitewise.plans.registry import register

T = B.table
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_NZ_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, l_extendedprice, NULLIF(l_discount, 0.0) AS l_discount, l_tax FROM lineitem"
O = f"({B.ORDER_SITES_SQL}) o"
CATS = ["region", "lga", "ward", "o_orderpriority"]


def li_nz(s, d) -> DataFrame:
    li = T(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice",
                     C.zero_as_missing("l_discount").alias("l_discount"), "l_tax")


def round_all(df: DataFrame, keep=()) -> DataFrame:
    """Round every floating column to 6 places (the oracle does the same)."""
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema.fields
                           if f.name not in keep and f.dataType.typeName() == "double"})


def rsql(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


# ---------------------------------------------------------------- counts and keys

register("count_by_key", sql=f"SELECT l_discount, COUNT(*) AS n FROM ({LI_NZ_SQL}) t GROUP BY l_discount")(
    lambda s, d: QU.count_by(li_nz(s, d), ["l_discount"])
)
register(
    "duplicate_ids",
    sql="SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
)(lambda s, d: QU.duplicate_keys(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]))

NDM = "CAST(COUNT(DISTINCT {m}) + MAX(CAST({m} IS NULL AS INTEGER)) AS BIGINT)"
register(
    "mapping_violations_fwd",
    sql=f"SELECT l_orderkey, l_linenumber, {NDM.format(m='l_partkey')} AS n_distinct FROM lineitem GROUP BY 1, 2 HAVING {NDM.format(m='l_partkey')} > 1",
)(lambda s, d: QU.mapping_violations(T(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey"))
register(
    "mapping_violations_rev",
    sql=f"SELECT p_name, {NDM.format(m='p_partkey')} AS n_distinct FROM part GROUP BY 1 HAVING {NDM.format(m='p_partkey')} > 1",
)(lambda s, d: QU.mapping_violations(T(s, d, "part"), "p_name", "p_partkey"))
register(
    "region_code_multiplicity",
    sql=f"SELECT region, {NDM.format(m='region_code')} AS n_distinct FROM {O} GROUP BY 1 HAVING {NDM.format(m='region_code')} > 1",
)(lambda s, d: QU.mapping_violations(B.order_sites(s, d), "region", "region_code"))

# ---------------------------------------------------------------- frequency, heatmap, divisions


@register(
    "spatial_spread_check",
    sql=f"""SELECT grp, {rsql('stddev_samp(lat)')} AS lat_sd, {rsql('stddev_samp(lon)')} AS lon_sd, COUNT(*) AS n
FROM ({B.POINTS_SQL}) p GROUP BY grp HAVING stddev_samp(lat) > 2.0 OR stddev_samp(lon) > 2.0""",
)
def spatial_spread_check(s, d):
    return round_all(QU.spread_check(B.points(s, d), ["grp"], "lat", "lon", 2.0))


register("frequency_table", sql=f"SELECT l_discount, COUNT(*) AS n FROM ({LI_NZ_SQL}) t WHERE l_discount IS NOT NULL GROUP BY 1")(
    lambda s, d: QU.frequency_table(li_nz(s, d), "l_discount")
)
register("region_code_heatmap", sql=f"SELECT region, region_code, COUNT(*) AS n FROM {O} GROUP BY 1, 2")(
    lambda s, d: QU.count_by(B.order_sites(s, d), ["region", "region_code"])
)
register(
    "admin_division_counts",
    sql=f"SELECT region, lga, ward, COUNT(*) AS n FROM {O} GROUP BY 1, 2, 3 ORDER BY region DESC NULLS LAST, n DESC",
)(lambda s, d: QU.count_by(B.order_sites(s, d), ["region", "lga", "ward"]).orderBy(F.col("region").desc_nulls_last(), F.desc("n")))


def _na_sql(cols_types):
    parts = []
    for c, frac in cols_types:
        cond = f"{c} IS NULL OR isnan({c})" if frac else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {cond}) AS na_count FROM ({LI_NZ_SQL}) t")
    return " UNION ALL ".join(parts)


register(
    "na_counts",
    sql=_na_sql([("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False), ("l_returnflag", False),
                 ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True)]),
)(lambda s, d: QU.na_counts(li_nz(s, d)))

# ---------------------------------------------------------------- summaries


def _summary_sql_long():
    parts = []
    for c in NUM:
        parts.append(
            f"SELECT '{c}' AS variable, {rsql(f'min({c})')} AS min, {rsql(f'quantile_cont({c}, 0.5)')} AS median, "
            f"{rsql(f'avg({c})')} AS mean, {rsql(f'stddev_samp({c})')} AS stdev, {rsql(f'quantile_cont({c}, 0.25)')} AS q25, "
            f"{rsql(f'quantile_cont({c}, 0.75)')} AS q75, {rsql(f'max({c})')} AS max FROM ({LI_NZ_SQL}) t"
        )
    return " UNION ALL ".join(parts)


register("numeric_summary_long", sql=_summary_sql_long())(lambda s, d: round_all(ST.numeric_summary_long(li_nz(s, d), NUM)))


def _summary_sql_wide():
    fn = {"min": "min({c})", "median": "quantile_cont({c}, 0.5)", "mean": "avg({c})", "stdev": "stddev_samp({c})",
          "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})"}
    cols = [f"{rsql(fn[st].format(c=c))} AS {c}_{st}" for c in NUM for st in ST.SUMMARY_STATS]
    return f"SELECT {', '.join(cols)} FROM ({LI_NZ_SQL}) t"


register("numeric_summary_wide", sql=_summary_sql_wide())(lambda s, d: round_all(ST.numeric_summary_wide(li_nz(s, d), NUM)))

register(
    "global_median",
    sql=f"SELECT {rsql('quantile_cont(l_extendedprice, 0.5)')} AS l_extendedprice, {rsql('quantile_cont(l_discount, 0.5)')} AS l_discount FROM ({LI_NZ_SQL}) t",
)(lambda s, d: round_all(medians_row(li_nz(s, d), ["l_extendedprice", "l_discount"])))

register(
    "iqr_bound",
    sql=f"""SELECT l_returnflag, {rsql('q25')} AS q25, {rsql('med')} AS median, {rsql('q75')} AS q75, {rsql('q75 - q25')} AS iqr,
  {rsql('med + 1.5 * (q75 - q25)')} AS upper_bound
FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS med,
             quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY 1) t""",
)(lambda s, d: round_all(ST.iqr_table(T(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"])))

# ---------------------------------------------------------------- histograms

HIST_SQL = """WITH x AS (SELECT {col} AS x FROM ({src}) t WHERE {col} IS NOT NULL),
e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 30), 29) END AS INTEGER) AS bin,
       COUNT(*) AS n, min(x) AS x_min, max(x) AS x_max
FROM x, e GROUP BY 1"""
register("histogram_30", sql=HIST_SQL.format(col="l_extendedprice", src="SELECT * FROM lineitem"))(
    lambda s, d: ST.histogram(T(s, d, "lineitem"), "l_extendedprice", 30)
)


def _hist_faceted_sql():
    parts = []
    for c in NUM:
        parts.append(
            f"SELECT '{c}' AS variable, * FROM ({HIST_SQL.format(col=c, src=LI_NZ_SQL)})"
        )
    return " UNION ALL ".join(parts)


register("histogram_faceted", sql=_hist_faceted_sql())(lambda s, d: ST.histogram_long(li_nz(s, d), NUM, 30))

# ---------------------------------------------------------------- class shares

register(
    "status_distribution",
    sql=f"SELECT status_group, COUNT(*) AS n, round(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 6) AS share FROM {O} GROUP BY 1",
)(lambda s, d: __import__("sitewise.plans.report", fromlist=["x"]).class_distribution(B.order_sites(s, d), "status_group"))

register(
    "install_trend",
    sql=f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, status_group, COUNT(*) AS n FROM {O} GROUP BY 1, 2",
)(lambda s, d: __import__("sitewise.plans.report", fromlist=["x"]).install_trend(B.order_sites(s, d), "o_orderdate", "status_group"))

register(
    "category_distributions",
    sql=" UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value, COUNT(*) AS n FROM {O} GROUP BY {c}" for c in CATS),
)(lambda s, d: ST.level_counts(B.order_sites(s, d), CATS))

# ---------------------------------------------------------------- profiles


def _profile_numeric_sql():
    parts = []
    for c in NUM:
        qs = ", ".join(f"{rsql(f'quantile_cont({c}, {p})')} AS p{int(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0))
        parts.append(
            f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS n_missing, "
            f"{rsql(f'avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE 1.0 END)')} AS complete_rate, "
            f"{rsql(f'avg({c})')} AS mean, {rsql(f'stddev_samp({c})')} AS sd, {qs} FROM ({LI_NZ_SQL}) t"
        )
    return " UNION ALL ".join(parts)


register("profile_numeric", sql=_profile_numeric_sql())(lambda s, d: round_all(ST.profile_numeric(li_nz(s, d), NUM)))

STR_COLS = ["c_name", "c_mktsegment"]


def _profile_string_sql():
    parts = []
    for c in STR_COLS:
        parts.append(
            f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
            f"{rsql(f'avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END)')} AS complete_rate, "
            f"CAST(min(length({c})) AS BIGINT) AS min_len, CAST(max(length({c})) AS BIGINT) AS max_len, "
            f"COUNT(*) FILTER (WHERE {c} = '') AS n_empty, COUNT(DISTINCT {c}) AS n_unique, "
            f"COUNT(*) FILTER (WHERE regexp_matches({c}, '^\\s+$')) AS n_whitespace FROM customer"
        )
    return " UNION ALL ".join(parts)


register("profile_string", sql=_profile_string_sql())(lambda s, d: round_all(ST.profile_string(T(s, d, "customer"), STR_COLS)))

DATE_SRC = "SELECT l.l_shipdate, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"


def _profile_date_sql():
    parts = []
    for c in ["l_shipdate", "o_orderdate"]:
        parts.append(
            f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, CAST(min({c}) AS DATE) AS min, "
            f"CAST(max({c}) AS DATE) AS max, COUNT(DISTINCT CAST({c} AS DATE)) AS n_unique, "
            f"CAST(DATE '1970-01-01' + CAST(floor(quantile_cont(date_diff('day', DATE '1970-01-01', CAST({c} AS DATE)), 0.5)) AS INTEGER) AS DATE) AS median "
            f"FROM ({DATE_SRC}) t"
        )
    return " UNION ALL ".join(parts)


@register("profile_date", sql=_profile_date_sql())
def profile_date(s, d):
    li, o = T(s, d, "lineitem"), T(s, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select("l_shipdate", "o_orderdate")
    return ST.profile_date(j, ["l_shipdate", "o_orderdate"])


register(
    "profile_top_counts",
    sql=f"""WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value, COUNT(*) AS n FROM {O} WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATS)})
SELECT * FROM (SELECT name, value, n, CAST(row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS INTEGER) AS rnk FROM c) t WHERE rnk <= 3""",
)(lambda s, d: ST.top_counts(B.order_sites(s, d), CATS, 3))

# ---------------------------------------------------------------- correlation and association


def _pairs_sql():
    from itertools import combinations

    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {rsql(f'corr({a}, {b})')} AS corr FROM ({LI_NZ_SQL}) t" for a, b in combinations(NUM, 2)
    )


register("correlation_pairs", sql=_pairs_sql())(lambda s, d: round_all(ST.correlation_pairs(li_nz(s, d), NUM)))


def _smooth_sql():
    from itertools import permutations

    return " UNION ALL ".join(
        f"SELECT '{y}' AS y, '{x}' AS x, {rsql(f'regr_slope({y}, {x})')} AS slope, {rsql(f'regr_intercept({y}, {x})')} AS intercept, "
        f"{rsql(f'regr_r2({y}, {x})')} AS r2 FROM ({LI_NZ_SQL}) t"
        for y, x in permutations(NUM, 2)
    )


register("linear_smooth_pairs", sql=_smooth_sql())(lambda s, d: round_all(ST.linear_smooth_pairs(li_nz(s, d), NUM)))

CONT_SQL = """cells AS (
  SELECT feature, a, b, COUNT(*) AS n_ab FROM (
    {unions}) t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, SUM(n_ab) OVER (PARTITION BY feature, a) AS n_a, SUM(n_ab) OVER (PARTITION BY feature, b) AS n_b,
             SUM(n_ab) OVER (PARTITION BY feature) AS n FROM cells),
rc AS (SELECT feature, COUNT(DISTINCT a) AS r, COUNT(DISTINCT b) AS c FROM cells GROUP BY 1)"""


def _cont_sql(features, target="status_group"):
    unions = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS a, CAST({target} AS VARCHAR) AS b FROM {O}" for f in features
    )
    return CONT_SQL.format(unions=unions)


def _cramers_sql(features):
    return f"""WITH {_cont_sql(features)},
g AS (SELECT feature, SUM(CAST(n_ab AS DOUBLE) * n_ab / (CAST(n_a AS DOUBLE) * n_b)) AS s, MAX(n) AS n FROM t GROUP BY 1)
SELECT g.feature, {rsql('g.n * (g.s - 1)')} AS chi2,
       {rsql('sqrt(greatest(g.n * (g.s - 1), 0.0) / (g.n * NULLIF(least(rc.r, rc.c) - 1, 0)))')} AS cramers_v
FROM g JOIN rc ON g.feature = rc.feature"""


register("cramers_v", sql=_cramers_sql(["o_orderpriority"]))(
    lambda s, d: round_all(ST.cramers_v(B.order_sites(s, d), ["o_orderpriority"], "status_group"))
)


def _theil_sql(features):
    return f"""WITH {_cont_sql(features)},
hb AS (SELECT feature, -SUM(CAST(n_b AS DOUBLE) / n * ln(CAST(n_b AS DOUBLE) / n)) AS h_target
       FROM (SELECT DISTINCT feature, b, n_b, n FROM t) x GROUP BY 1),
hc AS (SELECT feature, -SUM(CAST(n_ab AS DOUBLE) / n * ln(CAST(n_ab AS DOUBLE) / n_a)) AS h_cond FROM t GROUP BY 1)
SELECT hc.feature, {rsql('h_target')} AS h_target, {rsql('h_cond')} AS h_cond,
       {rsql('CASE WHEN h_target = 0 THEN 1.0 ELSE (h_target - h_cond) / h_target END')} AS theils_u
FROM hc JOIN hb ON hc.feature = hb.feature"""


register("theils_u", sql=_theil_sql(CATS))(lambda s, d: round_all(ST.theils_u(B.order_sites(s, d), CATS, "status_group")))

RATIO_NUM = ["o_totalprice", "c_acctbal"]


def _ratio_sql():
    unions = " UNION ALL ".join(f"SELECT '{c}' AS variable, status_group AS g, {c} AS x FROM {O}" for c in RATIO_NUM)
    return f"""WITH long AS (SELECT * FROM ({unions}) u WHERE x IS NOT NULL AND g IS NOT NULL),
grp AS (SELECT variable, g, COUNT(*) AS n_g, avg(x) AS m_g FROM long GROUP BY 1, 2),
tot AS (SELECT variable, COUNT(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1)
SELECT grp.variable, {rsql('sqrt(SUM(n_g * (m_g - m) * (m_g - m)) / NULLIF(MAX(v * n), 0.0))')} AS eta
FROM grp JOIN tot ON grp.variable = tot.variable GROUP BY grp.variable"""


register("correlation_ratio", sql=_ratio_sql())(
    lambda s, d: round_all(ST.correlation_ratio(B.order_sites(s, d), RATIO_NUM, "status_group"))
)


@register(
    "feature_association",
    sql=f"""WITH v AS ({_cramers_sql(CATS)})
SELECT feature, cramers_v, CAST(row_number() OVER (ORDER BY cramers_v DESC, feature) AS INTEGER) AS rnk FROM v""",
)
def feature_association(s, d):
    from pyspark.sql import Window

    v = round_all(ST.cramers_v(B.order_sites(s, d), CATS, "status_group")).select("feature", "cramers_v")
    # One row per feature: a keyless window over this small table is fine.
    return v.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("cramers_v"), "feature")).cast("int"))


# ---------------------------------------------------------------- windows

register(
    "region_code_id",
    sql=f"""SELECT id, region, region_code,
  CAST(CASE WHEN region_code IS NULL THEN NULL ELSE dense_rank() OVER (PARTITION BY region ORDER BY region_code) END AS INTEGER) AS code_rank
FROM {O}""",
)(lambda s, d: WI.dense_rank_within(B.order_sites(s, d).select("id", "region", "region_code"), ["region"], "region_code", "code_rank"))

register(
    "sample_per_group",
    sql=f"""SELECT id, region, status_group FROM (
  SELECT id, region, status_group, row_number() OVER (PARTITION BY region ORDER BY md5(concat(CAST(id AS VARCHAR), '123')), id) AS rn FROM {O}) t
WHERE rn <= 500""",
)(lambda s, d: WI.sample_per_group(B.order_sites(s, d).select("id", "region", "status_group"), ["region"], 500, "id", 123))

register(
    "vfold_assign",
    sql=f"""SELECT id, status_group,
  CAST((row_number() OVER (PARTITION BY status_group ORDER BY md5(concat(CAST(id AS VARCHAR), '123'))) - 1) % 5 AS INTEGER) AS fold
FROM {O}""",
)(lambda s, d: WI.vfold_assign(B.order_sites(s, d).select("id", "status_group"), "status_group", "id", 5, 123))

register(
    "stratified_split",
    sql=f"""SELECT id, status_group,
  CASE WHEN row_number() OVER (PARTITION BY status_group ORDER BY md5(concat(CAST(id AS VARCHAR), '123')))
            <= floor(COUNT(*) OVER (PARTITION BY status_group) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM {O}""",
)(lambda s, d: WI.stratified_split(B.order_sites(s, d).select("id", "status_group"), "status_group", "id", 0.8, 123))
