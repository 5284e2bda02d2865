"""Reductions whose result doesn't depend on the number of tasks: rows are folded in blocks of their id and merged in order of blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16_384


def det_reduce(df: DataFrame, row_id: str, column: str, fold: Callable[[np.ndarray], float], merge: Callable[[float, float], float], identity: float, block: int = BLOCK) -> float:
    """fold gives a block's value from its values in order of row_id; the driver merges one number a block."""

    def one(t: pa.Table) -> pa.Table:
        x = t["x"].to_numpy()[np.argsort(t["i"].to_numpy(), kind="stable")]
        return pa.table({"b": pa.array([t["b"][0].as_py()], pa.int64()), "v": pa.array([float(fold(x))], pa.float64())})

    rows = df.select(F.col(row_id).cast("long").alias("i"), F.col(column).cast("double").alias("x")).withColumn("b", F.floor(F.col("i") / block).cast("long"))
    out = identity
    for r in rows.groupBy("b").applyInArrow(one, "b long, v double").orderBy("b").toLocalIterator():
        out = merge(out, r["v"])
    return out


def det_reduce_range(spark, n: int, fold: Callable[[np.ndarray], float], merge: Callable[[float, float], float], identity: float, block: int = BLOCK) -> float:
    """The same over the indices 0 to n - 1."""
    return det_reduce(spark.range(n).withColumn("x", F.col("id").cast("double")), "id", "x", fold, merge, identity, block)
