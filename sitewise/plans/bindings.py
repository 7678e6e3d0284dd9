"""Bound views: the reference's roles mapped onto the driver's test tables.

Each view exists twice, once as a DataFrame and once as SQL text for the
DuckDB oracle, and the two are kept next to each other on purpose.

Roles (see SURVEY 2.13): site rows = line items with their supplier's nation
and region; labels = orders (status mapped to three ordered levels); points =
embedding coordinates scaled into the survey's longitude/latitude box.
Dimension tables ``nation`` (25 rows) and ``region`` (5 rows) have a fixed
size by the schema's definition, so broadcasting them is safe at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The three status levels in their order, and the status code
# each one is bound to in the test tables.
STATUS_LEVELS = ["functional", "functional needs repair", "non functional"]
STATUS_CODES = {"F": "functional", "O": "functional needs repair", "P": "non functional"}


SPREAD_CONF = "sitewise.scan.spreadSingleSplit"
# Tables whose size is fixed by the schema's definition.
FIXED_SIZE = {"nation", "region"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Scan one test table. The bench may ask to spread a scan of one split (the
    test files hold a single row group); queries themselves never do."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    if name in FIXED_SIZE or spark.conf.get(SPREAD_CONF, "false") != "true":
        return df
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        df = df.repartition(par)
    return df


def status_expr(code_col: str = "o_orderstatus") -> F.Column:
    e = None
    for code, level in STATUS_CODES.items():
        e = (F.when if e is None else e.when)(F.col(code_col) == code, F.lit(level))
    return e


STATUS_SQL = (
    "CASE o_orderstatus WHEN 'F' THEN 'functional' WHEN 'O' THEN 'functional needs repair' "
    "WHEN 'P' THEN 'non functional' END"
)


# ---------------------------------------------------------------- site rows (line level)

def site_values(spark: SparkSession, d: str) -> DataFrame:
    """Line items with region, region code, lga (nation) and ward (supplier)."""
    li = table(spark, d, "lineitem")
    sup = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = F.broadcast(table(spark, d, "nation"))
    reg = F.broadcast(table(spark, d, "region"))
    j = (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return j.select(
        F.col("l_orderkey").alias("id"),
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
        F.col("r_name").alias("region"),
        F.col("n_nationkey").alias("region_code"),
        F.col("n_name").alias("lga"),
        F.col("s_name").alias("ward"),
    )


SITE_VALUES_SQL = """
SELECT l.l_orderkey AS id, l.l_linenumber, l.l_partkey, l.l_quantity, l.l_extendedprice,
       NULLIF(l.l_discount, 0.0) AS l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate,
       r.r_name AS region, n.n_nationkey AS region_code, n.n_name AS lga, s.s_name AS ward
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def site_labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), status_expr().alias("status_group"), "o_orderdate", "o_totalprice")


SITE_LABELS_SQL = f"SELECT o_orderkey AS id, {STATUS_SQL} AS status_group, o_orderdate, o_totalprice FROM orders"


# ---------------------------------------------------------------- order level (unique id)

def order_sites(spark: SparkSession, d: str) -> DataFrame:
    """One row per order (unique id) with status, dates and customer geography."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nat = F.broadcast(table(spark, d, "nation"))
    reg = F.broadcast(table(spark, d, "region"))
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return j.select(
        F.col("o_orderkey").alias("id"),
        status_expr().alias("status_group"),
        "o_orderdate",
        "o_totalprice",
        "o_orderpriority",
        "c_acctbal",
        F.col("r_name").alias("region"),
        F.col("n_nationkey").alias("region_code"),
        F.col("n_name").alias("lga"),
        F.col("c_mktsegment").alias("ward"),
    )


ORDER_SITES_SQL = f"""
SELECT o.o_orderkey AS id, {STATUS_SQL} AS status_group, o.o_orderdate, o.o_totalprice, o.o_orderpriority,
       c.c_acctbal, r.r_name AS region, n.n_nationkey AS region_code, n.n_name AS lga, c.c_mktsegment AS ward
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""


# ---------------------------------------------------------------- points

def points(spark: SparkSession, d: str) -> DataFrame:
    """(id, grp, lon, lat): embedding coordinates scaled around the survey box."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("grp"),
        (F.lit(35.0) + F.lit(20.0) * F.col("embedding")[0].cast("double")).alias("lon"),
        (F.lit(-6.0) + F.lit(20.0) * F.col("embedding")[1].cast("double")).alias("lat"),
    )


POINTS_SQL = """
SELECT vec_id AS id, label AS grp,
       35.0 + 20.0 * CAST(embedding[1] AS DOUBLE) AS lon,
       -6.0 + 20.0 * CAST(embedding[2] AS DOUBLE) AS lat
FROM embeddings
"""


# ---------------------------------------------------------------- score tables (metrics without a model)

PROB_COLS = {
    "functional": "p_functional",
    "functional needs repair": "p_functional_needs_repair",
    "non functional": "p_non_functional",
}

# Two deterministic "models": raw parts from order columns plus a bonus on
# the true level for most rows, normalised to probabilities.
_MODEL_PARTS = {
    "model_a": ("(o_totalprice % 1000.0) / 1000.0", "(o_custkey % 97) / 97.0",
                "CAST(day(o_orderdate) AS DOUBLE) / 31.0", "o_orderkey % 3 <> 0", 0.5),
    "model_b": ("(o_totalprice % 777.0) / 777.0", "(o_orderkey % 89) / 89.0",
                "CAST(month(o_orderdate) AS DOUBLE) / 12.0", "o_orderkey % 4 <> 1", 0.3),
}


def _parts_spark(model: str):
    o = F.col
    if model == "model_a":
        a = (o("o_totalprice") % 1000.0) / 1000.0
        b = (o("o_custkey") % 97) / 97.0
        c = F.dayofmonth("o_orderdate").cast("double") / 31.0
        boost, bonus = (o("o_orderkey") % 3) != 0, 0.5
    else:
        a = (o("o_totalprice") % 777.0) / 777.0
        b = (o("o_orderkey") % 89) / 89.0
        c = F.month("o_orderdate").cast("double") / 12.0
        boost, bonus = (o("o_orderkey") % 4) != 1, 0.3
    return a, b, c, boost, bonus


def scores(spark: SparkSession, d: str, model: str = "model_a") -> DataFrame:
    """(id, truth, pred, p_<level>...) for one deterministic scoring rule."""
    from sitewise.operators.metrics import argmax_level

    o = table(spark, d, "orders")
    a, b, c, boost, bonus = _parts_spark(model)
    truth = status_expr()
    raw = [a, b, c]
    raw = [r + F.when(boost & (truth == lv), F.lit(bonus)).otherwise(F.lit(0.0)) for r, lv in zip(raw, STATUS_LEVELS)]
    t = o.select(F.col("o_orderkey").alias("id"), truth.alias("truth"), *[r.alias(f"s{i}") for i, r in enumerate(raw)])
    tot = F.col("s0") + F.col("s1") + F.col("s2")
    t = t.select("id", "truth", *[(F.col(f"s{i}") / tot).alias(PROB_COLS[lv]) for i, lv in enumerate(STATUS_LEVELS)])
    return t.withColumn("pred", argmax_level(PROB_COLS))


def scores_sql(model: str = "model_a") -> str:
    a, b, c, boost, bonus = _MODEL_PARTS[model]
    lv = STATUS_LEVELS
    s = [f"{x} + CASE WHEN {boost} AND {STATUS_SQL} = '{l}' THEN {bonus} ELSE 0.0 END" for x, l in zip((a, b, c), lv)]
    p = list(PROB_COLS.values())
    return f"""SELECT id, truth, {p[0]}, {p[1]}, {p[2]},
  CASE WHEN {p[0]} >= {p[1]} AND {p[0]} >= {p[2]} THEN '{lv[0]}' WHEN {p[1]} >= {p[2]} THEN '{lv[1]}' ELSE '{lv[2]}' END AS pred
FROM (SELECT id, truth, s0 / (s0 + s1 + s2) AS {p[0]}, s1 / (s0 + s1 + s2) AS {p[1]}, s2 / (s0 + s1 + s2) AS {p[2]}
      FROM (SELECT o_orderkey AS id, {STATUS_SQL} AS truth, {s[0]} AS s0, {s[1]} AS s1, {s[2]} AS s2 FROM orders) r) q"""
