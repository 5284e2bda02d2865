"""Connected components of an edge table: of few edges on the driver, of more by labels that spread along edges and jump to their label's label."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder (spark.checkpoint.dir; one of our own only where none is set, as in tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
    return df.checkpoint()


def numbered(df: DataFrame, col: str, out: str) -> DataFrame:
    """df with the rank of each row by col, from 0 (rows without ties): ranks within ranges of col, and the counts of the ranges before."""
    ranged = checkpointed(df.repartitionByRange(F.col(col)).withColumn("_part", F.spark_partition_id()))
    total, before = 0, []
    for part, n in sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect()):  # a row for each partition
        before.append((part, total))
        total += n
    start = df.sparkSession.createDataFrame(before, "_part int, _before long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(col)) - 1
    return ranged.withColumn("_rank", rank).join(F.broadcast(start), "_part").withColumn(out, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


#: most edges that the driver takes (32 MB)
ON_DRIVER = 1 << 21


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of the component of each: roots hook onto lesser ones across edges, so they halve each round."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        x, y = root[one], root[two]
        apart = x != y
        if not apart.any():
            return node, node[root]
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def connected_components(edges: DataFrame, keep_loops: bool = False, rounds: int = 100) -> DataFrame:
    """(node, component), component the least node reached. Each round is checkpointed, so lost executors cost a round at most."""
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = checkpointed(e.union(e.select("b", "a")).distinct())
    if not keep_loops:
        both = both.where("a != b")
    once = both.where("a <= b")
    if once.count() <= ON_DRIVER:
        t = once.toArrow()
        node, root = roots(t["a"].to_numpy(), t["b"].to_numpy())
        found = pa.table({"node": pa.array(node, pa.int64()), "component": pa.array(root, pa.int64())})
        return edges.sparkSession.createDataFrame(found)
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = label.select(F.col("node").alias("n"), F.col("component").alias("c"))
        new = new.join(up, F.col("component") == F.col("n"), "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component")).checkpoint()
        changed = new.join(label.withColumnRenamed("component", "was"), "node").where("component != was").limit(1).count()
        label = new
        if not changed:
            break
    return label
