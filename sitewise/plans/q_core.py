"""Registered queries: projections, filters, joins, sorts, set ops, scalar
functions (sections 2.2, 2.3, 2.6, 2.7, 2.8 of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import columns as C
from sitewise.operators import clean as CL
from sitewise.operators import quality as QU
from sitewise.operators import windows as WI
from sitewise.plans import bindings as B
from sitewise.plans.registry import r6, register

T = B.table
STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"

# ---------------------------------------------------------------- projections

register("project_columns", sql="SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")(
    lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
)

register(
    "drop_columns", sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders"
)(lambda s, d: T(s, d, "orders").drop("o_orderstatus", "o_orderpriority"))


@register(
    "select_numeric",
    sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def select_numeric(s, d):
    li = T(s, d, "lineitem")
    return li.select(*C.columns_of_type(li, "numeric"))


@register(
    "across_transform",
    sql=f"""SELECT p_partkey, lower({STRIP.format(c='p_name')}) AS p_name, lower({STRIP.format(c='p_brand')}) AS p_brand,
       lower({STRIP.format(c='p_type')}) AS p_type, p_size, p_retailprice FROM part""",
)
def across_transform(s, d):
    p = T(s, d, "part")
    return p.withColumns({c: C.clean_string(c) for c in C.columns_of_type(p, "string")})


# ---------------------------------------------------------------- filters

register("filter_nonzero", sql="SELECT * FROM lineitem WHERE l_discount <> 0")(
    lambda s, d: T(s, d, "lineitem").where(F.col("l_discount") != 0)
)


@register(
    "param_filter",
    sql=f"""SELECT id, region, status_group, o_orderdate, o_totalprice FROM ({B.ORDER_SITES_SQL}) t
WHERE region = 'ASIA' AND o_orderdate >= DATE '1998-01-01'""",
)
def param_filter(s, d):
    o = B.order_sites(s, d)
    return o.where((F.col("region") == "ASIA") & C.year_at_least("o_orderdate", 1998)).select(
        "id", "region", "status_group", "o_orderdate", "o_totalprice"
    )


@register(
    "invalid_coords_flag",
    sql=f"""SELECT id, lon, lat,
  (lon IS NULL OR isnan(lon) OR lat IS NULL OR isnan(lat) OR lat < -12 OR lat > 0 OR lon < 29 OR lon > 41) AS invalid
FROM ({B.POINTS_SQL}) p""",
)
def invalid_coords_flag(s, d):
    return B.points(s, d).select("id", "lon", "lat", QU.invalid_coords().alias("invalid"))


@register(
    "validate_region_param",
    sql=f"""WITH o AS ({B.ORDER_SITES_SQL})
SELECT 'ASIA' AS region, EXISTS (SELECT 1 FROM o WHERE region = 'ASIA') AS known
UNION ALL SELECT 'Atlantis', EXISTS (SELECT 1 FROM o WHERE region = 'Atlantis')""",
)
def validate_region_param(s, d):
    from sitewise.plans.report import region_known

    o = B.order_sites(s, d)
    return region_known(o, "region", "ASIA").unionByName(region_known(o, "region", "Atlantis"))


@register(
    "standardize_missing",
    sql=f"""SELECT doc_id, md5(NULLIF({STRIP.format(c='text')}, '')) AS text_md5,
       length(NULLIF({STRIP.format(c='text')}, '')) AS n_chars,
       NULLIF({STRIP.format(c='lang')}, '') AS lang FROM documents""",
)
def standardize_missing(s, d):
    doc = T(s, d, "documents")
    t = C.standardize_missing("text")
    return doc.select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n_chars"),
                      C.standardize_missing("lang").alias("lang"))


@register(
    "zero_as_missing",
    sql="SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS l_discount, NULLIF(l_tax, 0) AS l_tax FROM lineitem",
)
def zero_as_missing(s, d):
    li = T(s, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.zero_as_missing("l_discount").alias("l_discount"),
                     C.zero_as_missing("l_tax").alias("l_tax"))


@register(
    "drop_sparse_columns",
    sql="""SELECT l_orderkey, l_linenumber, l_quantity, NULLIF(l_tax, 0) AS l_tax FROM lineitem""",
)
def drop_sparse_columns(s, d):
    li = T(s, d, "lineitem")
    # l_discount_sparse is missing for most rows (> 30%) and is dropped.
    wide = li.select(
        "l_orderkey", "l_linenumber", "l_quantity", C.zero_as_missing("l_tax").alias("l_tax"),
        F.when(F.col("l_discount") >= 0.08, F.col("l_discount")).alias("l_discount_sparse"),
    )
    out, _ = CL.drop_sparse_columns(wide, 0.3)
    return out


# ---------------------------------------------------------------- joins

@register(
    "left_join_labels",
    sql="""SELECT o.o_orderkey AS id, o.o_totalprice, l.l_linenumber, COALESCE(l.l_returnflag, 'Unknown') AS l_returnflag
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
)
def left_join_labels(s, d):
    v = T(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    lab = T(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_returnflag")
    j = CL.left_join(v, lab, ["id"])
    return j.withColumn("l_returnflag", C.unknown_level("l_returnflag"))


@register(
    "left_join_nullsafe",
    sql="""SELECT c.c_custkey, c.k, n.n_name
FROM (SELECT c_custkey, NULLIF(c_nationkey, 0) AS k FROM customer) c
LEFT JOIN (SELECT NULLIF(n_nationkey, 0) AS k, n_name FROM nation) n ON c.k IS NOT DISTINCT FROM n.k""",
)
def left_join_nullsafe(s, d):
    c = T(s, d, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(0)).alias("k"))
    n = F.broadcast(T(s, d, "nation").select(F.nullif(F.col("n_nationkey"), F.lit(0)).alias("k"), "n_name"))
    return CL.left_join(c, n, ["k"], null_safe=True)


@register(
    "region_dups",
    sql=f"""WITH o AS ({B.ORDER_SITES_SQL}),
dups AS (SELECT region, COUNT(DISTINCT region_code) + MAX(CAST(region_code IS NULL AS INTEGER)) AS n_codes
         FROM o GROUP BY region HAVING COUNT(DISTINCT region_code) + MAX(CAST(region_code IS NULL AS INTEGER)) > 1)
SELECT o.id, o.region, o.region_code, CAST(dups.n_codes AS BIGINT) AS n_codes FROM o LEFT JOIN dups ON o.region = dups.region""",
)
def region_dups(s, d):
    o = B.order_sites(s, d).select("id", "region", "region_code")
    dups = QU.mapping_violations(o, "region", "region_code", "n_codes")
    return WI.attach(o, dups, ["region"])


@register(
    "rows_in_multicode_regions",
    sql=f"""WITH o AS ({B.ORDER_SITES_SQL}),
dups AS (SELECT region FROM o GROUP BY region HAVING COUNT(DISTINCT region_code) > 1),
combos AS (SELECT DISTINCT o.region, o.region_code FROM o JOIN dups ON o.region = dups.region)
SELECT o.id, o.region, o.region_code, o.lga FROM o JOIN combos ON o.region = combos.region AND o.region_code = combos.region_code""",
)
def rows_in_multicode_regions(s, d):
    o = B.order_sites(s, d).select("id", "region", "region_code", "lga")
    dups = QU.mapping_violations(o, "region", "region_code").select("region")
    combos = o.select("region", "region_code").distinct().join(dups, "region")
    return WI.attach(o, combos, ["region", "region_code"], "inner")


@register(
    "stat_join_back",
    sql=f"""WITH o AS ({B.ORDER_SITES_SQL}),
m AS (SELECT region, quantile_cont(o_totalprice, 0.5) AS region_median FROM o GROUP BY region)
SELECT o.id, o.region, o.o_totalprice, round(m.region_median, 6) AS region_median,
       o.o_totalprice > m.region_median AS above_median
FROM o LEFT JOIN m ON o.region = m.region""",
)
def stat_join_back(s, d):
    from sitewise.functions.quantiles import exact_quantiles

    o = B.order_sites(s, d).select("id", "region", "o_totalprice")
    m = exact_quantiles(o, "o_totalprice", [0.5], ["region_median"], ["region"])
    j = CL.attach_group_stat(o, m, ["region"])
    return j.select("id", "region", "o_totalprice", r6("region_median"),
                    (F.col("o_totalprice") > F.col("region_median")).alias("above_median"))


# ---------------------------------------------------------------- sorts, limits

register(
    "sort_nulls_last",
    sql="SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS l_discount FROM lineitem ORDER BY 3 ASC NULLS LAST, 1, 2",
)(
    lambda s, d: T(s, d, "lineitem")
    .select("l_orderkey", "l_linenumber", C.zero_as_missing("l_discount").alias("l_discount"))
    .orderBy(F.col("l_discount").asc_nulls_last(), "l_orderkey", "l_linenumber")
)


@register(
    "top_n_codes",
    sql=f"""SELECT DISTINCT region, region_code, lga FROM ({B.ORDER_SITES_SQL}) o ORDER BY region, region_code LIMIT 40""",
)
def top_n_codes(s, d):
    o = B.order_sites(s, d)
    return o.select("region", "region_code", "lga").distinct().orderBy("region", "region_code").limit(40)


@register(
    "levels_by_count",
    sql=f"""WITH o AS ({B.ORDER_SITES_SQL}),
c AS (SELECT 'ward' AS name, ward AS value, COUNT(*) AS n FROM o GROUP BY ward
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, COUNT(*) FROM o GROUP BY o_orderpriority)
SELECT name, value, n, CAST(dense_rank() OVER (PARTITION BY name ORDER BY n DESC) AS INTEGER) AS rnk FROM c""",
)
def levels_by_count(s, d):
    from pyspark.sql import Window

    o = B.order_sites(s, d)
    long = o.select("ward", "o_orderpriority").unpivot([], ["ward", "o_orderpriority"], "name", "value")
    c = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rnk", F.dense_rank().over(Window.partitionBy("name").orderBy(F.desc("n"))).cast("int"))


# ---------------------------------------------------------------- set ops and reshaping

@register(
    "union_by_name",
    sql="""SELECT o_orderkey, o_totalprice, NULL::TIMESTAMP AS o_orderdate FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, NULL::DOUBLE, o_orderdate FROM orders WHERE o_orderstatus = 'O'""",
)
def union_by_name(s, d):
    o = T(s, d, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    b = o.where(F.col("o_orderstatus") == "O").select("o_orderdate", "o_orderkey")
    return a.unionByName(b, allowMissingColumns=True)


register("distinct_levels2", sql="SELECT DISTINCT p_type, p_brand FROM part")(
    lambda s, d: QU.distinct_levels(T(s, d, "part"), ["p_type", "p_brand"])
)
register("distinct_levels3", sql="SELECT DISTINCT p_type, p_brand, p_size FROM part")(
    lambda s, d: QU.distinct_levels(T(s, d, "part"), ["p_type", "p_brand", "p_size"])
)

UNPIVOT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "unpivot_numeric",
    sql="UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) "
    "ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME variable VALUE value",
)
def unpivot_numeric(s, d):
    li = T(s, d, "lineitem")
    return li.unpivot(["l_orderkey", "l_linenumber"], UNPIVOT_COLS, "variable", "value")


HIER = [("p_name", "p_type"), ("p_brand", "p_type"), ("p_name", "p_brand")]


@register(
    "hierarchy_violations",
    sql="""WITH long AS (
  SELECT 'p_name>p_type' AS hierarchy, p_name AS child_value, p_type AS parent_value FROM part
  UNION ALL SELECT 'p_brand>p_type', p_brand, p_type FROM part
  UNION ALL SELECT 'p_name>p_brand', p_name, p_brand FROM part)
SELECT hierarchy, child_value, CAST(COUNT(DISTINCT parent_value) + MAX(CAST(parent_value IS NULL AS INTEGER)) AS BIGINT) AS n_parents
FROM long GROUP BY hierarchy, child_value
HAVING COUNT(DISTINCT parent_value) + MAX(CAST(parent_value IS NULL AS INTEGER)) > 1""",
)
def hierarchy_violations(s, d):
    return QU.hierarchy_violations(T(s, d, "part"), HIER)


# ---------------------------------------------------------------- scalar functions

register(
    "clean_strings",
    sql=f"SELECT c_custkey, lower({STRIP.format(c='c_name')}) AS c_name, lower({STRIP.format(c='c_mktsegment')}) AS c_mktsegment FROM customer",
)(lambda s, d: T(s, d, "customer").select("c_custkey", C.clean_string("c_name").alias("c_name"),
                                         C.clean_string("c_mktsegment").alias("c_mktsegment")))

SQUISH = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@register(
    "squish_strings",
    sql=f"SELECT doc_id, md5({SQUISH}) AS text_md5, length({SQUISH}) AS n_chars FROM documents",
)
def squish_strings(s, d):
    t = C.squish("text")
    return T(s, d, "documents").select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n_chars"))


@register(
    "region_concat",
    sql=f"SELECT id, concat_ws('_', COALESCE(region, 'NA'), COALESCE(CAST(region_code AS VARCHAR), 'NA')) AS region_concat FROM ({B.ORDER_SITES_SQL}) o",
)
def region_concat(s, d):
    o = B.order_sites(s, d)
    return o.select("id", C.concat_with_na("_", "region", "region_code").alias("region_concat"))


register(
    "region_slug",
    sql=f"SELECT id, regexp_replace(lower(region), ' ', '_', 'g') AS region_slug FROM ({B.ORDER_SITES_SQL}) o",
)(lambda s, d: B.order_sites(s, d).select("id", C.slug("region").alias("region_slug")))

DATE_TEXT_SQL = """CASE WHEN o_orderkey % 7 = 0 THEN substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 8) || '31'
     WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END"""


@register(
    "parse_dates",
    sql=f"""SELECT o_orderkey, txt, CAST(try_strptime(txt, '%Y-%m-%d') AS DATE) AS parsed
FROM (SELECT o_orderkey, {DATE_TEXT_SQL} AS txt FROM orders) t""",
)
def parse_dates(s, d):
    o = T(s, d, "orders")
    txt = F.date_format("o_orderdate", "yyyy-MM-dd")
    messy = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.substring(txt, 1, 8), F.lit("31")))
        .when(F.col("o_orderkey") % 11 == 0, F.lit(""))
        .otherwise(txt)
    )
    return o.select("o_orderkey", messy.alias("txt")).withColumn("parsed", C.parse_date("txt"))


@register(
    "date_features",
    sql="SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders",
)
def date_features(s, d):
    o = T(s, d, "orders")
    return o.select("o_orderkey", F.year("o_orderdate").cast("int").alias("year"),
                    F.quarter("o_orderdate").cast("int").alias("quarter"))


@register(
    "asset_age",
    sql="""SELECT l.l_orderkey, l.l_linenumber,
  round(CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS DOUBLE) / 365.25, 6) AS age
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
)
def asset_age(s, d):
    li, o = T(s, d, "lineitem"), T(s, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", r6(C.age_years(F.to_date("l_shipdate"), F.to_date("o_orderdate")), "age"))


@register(
    "date_label",
    sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%B %d, %Y') AS long_label FROM orders",
)
def date_label(s, d):
    o = T(s, d, "orders")
    return o.select("o_orderkey", C.date_label("o_orderdate").alias("iso"),
                    C.date_label("o_orderdate", "MMMM dd, yyyy").alias("long_label"))


NUM_TEXT_SQL = """CASE l_linenumber WHEN 1 THEN 'x' WHEN 2 THEN '1e3' WHEN 3 THEN ' ' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END"""


@register(
    "safe_numeric",
    sql=f"SELECT l_orderkey, l_linenumber, txt, TRY_CAST(txt AS DOUBLE) AS num FROM (SELECT l_orderkey, l_linenumber, {NUM_TEXT_SQL} AS txt FROM lineitem) t",
)
def safe_numeric(s, d):
    li = T(s, d, "lineitem")
    txt = (
        F.when(F.col("l_linenumber") == 1, "x")
        .when(F.col("l_linenumber") == 2, "1e3")
        .when(F.col("l_linenumber") == 3, " ")
        .otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    )
    return li.select("l_orderkey", "l_linenumber", txt.alias("txt")).withColumn("num", C.safe_numeric("txt"))


@register(
    "cap_at_bound",
    sql="""SELECT l_orderkey, l_linenumber,
  CASE WHEN NULLIF(l_discount, 0) IS NULL THEN NULL WHEN NULLIF(l_discount, 0) > 0.05 THEN 0.05 ELSE NULLIF(l_discount, 0) END AS capped
FROM lineitem""",
)
def cap_at_bound(s, d):
    x = C.zero_as_missing("l_discount")
    return T(s, d, "lineitem").select("l_orderkey", "l_linenumber",
                                      C.guarded_when(x > 0.05, F.lit(0.05), x).alias("capped"))


@register(
    "unknown_level",
    sql="""SELECT o.o_orderkey, COALESCE(l.l_linestatus, 'Unknown') AS l_linestatus
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
)
def unknown_level(s, d):
    o, li = T(s, d, "orders"), T(s, d, "lineitem")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    return j.select("o_orderkey", C.unknown_level("l_linestatus").alias("l_linestatus"))


@register(
    "clean_names",
    sql="SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_totalprice AS total_price_usd, "
    "o_orderdate AS order_date, o_orderdate AS order_date_2 FROM orders",
)
def clean_names(s, d):
    o = T(s, d, "orders").select(
        F.col("o_orderkey").alias("OrderKey"), F.col("o_custkey").alias("cust Key"),
        F.col("o_totalprice").alias("Total.Price (USD)"), F.col("o_orderdate").alias("order-date"),
        F.col("o_orderdate").alias("Order Date"),
    )
    return C.clean_names(o)
