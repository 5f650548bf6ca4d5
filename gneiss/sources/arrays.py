"""Constructors and Arrow exchange. The long form of an array has index columns i0.. and a value column v."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.errors import NumericError, ShapeError
from gneiss.meta import element_count, strides


def grid(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All index tuples of a shape."""
    s = strides(shape)
    n = F.col("id")
    return spark.range(element_count(shape)).select(*[(F.floor(n / s[k]) % shape[k]).cast("bigint").alias(f"i{k}") for k in range(len(shape))])


def full(spark: SparkSession, shape: tuple[int, ...], value: float | Column) -> DataFrame:
    return grid(spark, shape).withColumn("v", value if isinstance(value, Column) else F.lit(value))


def eye(spark: SparkSession, rows: int, columns: int | None = None) -> DataFrame:
    return grid(spark, (rows, columns if columns is not None else rows)).withColumn("v", (F.col("i0") == F.col("i1")).cast("double"))


def arange(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """Half-open integers; empty when the step leads away."""
    start, stop = (0, start) if stop is None else (start, stop)
    if step == 0:
        raise NumericError("arange: the step is zero")
    n = max(0, -(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * step).cast("bigint").alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, num: int, endpoint: bool = True) -> DataFrame:
    step = (stop - start) / max(1, num - 1 if endpoint else num)
    v = F.lit(float(start)) + F.col("id") * F.lit(step)
    if endpoint and num > 1:
        v = F.when(F.col("id") == num - 1, F.lit(float(stop))).otherwise(v)
    return spark.range(num).select(F.col("id").alias("i0"), v.cast("double").alias("v"))


def from_arrow(spark: SparkSession, data: pa.Table) -> DataFrame:
    """Columns of an Arrow table; nulls are not values here."""
    if any(c.null_count for c in data.columns):
        raise ShapeError("nulls cannot be imported")
    return spark.createDataFrame(data)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()
