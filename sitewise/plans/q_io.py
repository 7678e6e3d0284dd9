"""Registered queries: scans and sinks (S1-S8). Each writes a table below the
session's shared checkpoint folder and reads it back through the reader
under test."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.plans import bindings as B
from sitewise.plans.q_clean import cleaned, clean_sql
from sitewise.plans.registry import register
from sitewise.session import shared_path
from sitewise.sources import io as IO

ORDERS_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


@register("scan_csv_typed", sql="SELECT * FROM orders")
def scan_csv_typed(s, d):
    p = IO.write_csv(B.table(s, d, "orders"), shared_path(s, "orders_csv"))
    return IO.read_csv_typed(s, p, ORDERS_SCHEMA)


@register(
    "scan_label_levels",
    sql="""SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS status,
  CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS INTEGER) AS status_ord FROM orders""",
)
def scan_label_levels(s, d):
    lab = B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    p = IO.write_csv(lab, shared_path(s, "labels_csv"))
    return IO.read_labels_with_levels(s, p, "id bigint, status string", "status", ["F", "O"], "status_ord")


STRING_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


@register(
    "scan_all_string",
    sql="""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
)
def scan_all_string(s, d):
    p = IO.write_csv(B.table(s, d, "orders").select(*STRING_COLS), shared_path(s, "orders_text"))
    return IO.read_all_string(s, p, STRING_COLS)


@register("sink_csv_roundtrip", sql=f"WITH {clean_sql()} SELECT * FROM c")
def sink_csv_roundtrip(s, d):
    df = cleaned(s, d)
    p = IO.write_csv(df, shared_path(s, "clean_csv"))
    return IO.read_csv_typed(s, p, df.schema)


@register("sink_parquet_roundtrip", sql=f"WITH {clean_sql()} SELECT * FROM c")
def sink_parquet_roundtrip(s, d):
    df = cleaned(s, d)
    p = IO.write_parquet(df, shared_path(s, "clean_parquet"), ["region"])
    return s.read.parquet(p).select(*df.columns)
