"""Incremental fits on streams: each micro-batch is one partial_fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def partial_fit_stream(stream: DataFrame, scaler, features: Sequence[str], checkpoint: str, model_path: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Fit a scaler with partial_fit on a stream. A batch that is sent again after a failure counts once; the model is saved after each if model_path is given.

    The batch number is kept with the scaler, so a restart from a saved model skips what it has seen.
    """
    names = list(features)

    def one(batch: DataFrame, epoch: int) -> None:
        if epoch <= getattr(scaler, "last_epoch", -1) or batch.isEmpty():
            return
        scaler.partial_fit(batch, names)
        scaler.last_epoch = epoch
        if model_path:
            scaler.save(batch.sparkSession, model_path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_moments(stream: DataFrame, time: str, column: str, window: str, late: str) -> DataFrame:
    """Count, mean and population variance of a column in tumbling windows; rows later than `late` are left out."""
    by = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
    return by.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_pop(column).alias("var")).select(F.col("w.start").alias("start"), "n", "mean", "var")


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
