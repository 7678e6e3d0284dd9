"""Scans, sinks and input guards.

Readers always take an explicit schema (inference is a test convenience
only); text that does not parse becomes null (PERMISSIVE), matching the
reference's readers. Sinks write to caller-given paths; the registered
round-trip queries write below the session's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NTZ_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV scan with a declared schema; unparsable fields become null."""
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("timestampNTZFormat", NTZ_FORMAT)
        .csv(path)
    )


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Inferred types (tests and exploration only: inference costs a pass)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_all_string(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Every column read as text (the reference's default-character reads)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def with_levels(df: DataFrame, col: str, levels: Sequence[str], ord_col: str | None = None) -> DataFrame:
    """Ordered category: a value outside the level list becomes null; the
    1-based level position goes to ``ord_col``."""
    arr = F.array(*[F.lit(v) for v in levels])
    pos = F.array_position(arr, F.col(col))
    out = df.withColumn(col, F.when(pos > 0, F.col(col)))
    if ord_col:
        out = out.withColumn(ord_col, F.when(pos > 0, pos).cast("int"))
    return out


def read_labels_with_levels(spark: SparkSession, path: str, schema: T.StructType | str, label: str,
                            levels: Sequence[str], ord_col: str | None = None) -> DataFrame:
    return with_levels(read_csv_typed(spark, path, schema), label, levels, ord_col)


POLYGON_SCHEMA = "region string, ring array<struct<x:double,y:double>>"


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon layer: one JSON object per line with a region and its ring of
    points. Shapefile binaries are converted to this form beforehand."""
    return spark.read.schema(POLYGON_SCHEMA).json(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", NTZ_FORMAT).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def require_nonempty(df: DataFrame, what: str = "input") -> DataFrame:
    """Stop on an empty input (a LIMIT 1 probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def require_columns(df: DataFrame, cols: Sequence[str]) -> bool:
    """True when all columns exist; steps are skipped when this is False."""
    return all(c in df.columns for c in cols)
