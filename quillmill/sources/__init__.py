"""Where data comes from: Parquet tables as feature frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feature_frame(df: DataFrame, row_id: str, features: Sequence[str], label: str | None = None) -> DataFrame:
    """row_id, the features as doubles and the label; only these columns are read."""
    cols = [F.col(row_id).alias("row_id"), *[F.col(c).cast("double").alias(c) for c in features]]
    return df.select(*cols, *([F.col(label).alias("label")] if label else []))


def vector_frame(df: DataFrame, row_id: str, vector: str, size: int, prefix: str = "f") -> tuple[DataFrame, list[str]]:
    """An array column spread over double columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.select(F.col(row_id).alias("row_id"), *[F.get(vector, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names
