"""k nearest neighbours: queries against blocks of the stored rows, the nearest of each block merged."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillmill.base import MAX_BROADCAST, Predictor, check_counts, finite_checks, map_rows
from quillmill.errors import DimensionMismatch, InvalidInput, InvalidParameter
from quillmill.functions.distance import Metric
from quillmill.operators.preprocessing import label_mapping


def _parts(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows in parts of at most `size` that lie near each other: halves by the column that spreads most."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        spread = np.ptp(x[at], axis=0) if len(at) > size else np.zeros(1)
        if not spread.max() > 0:
            out += [at[i : i + size] for i in range(0, len(at), size)]
            continue
        half = len(at) // 2
        by = np.argpartition(x[at, int(spread.argmax())], half)
        stack += [at[by[half:]], at[by[:half]]]
    return out


class Boxes:
    """Stored rows in small parts with the box of each, so that a query meets only parts that may hold one of its nearest. Of many columns boxes say little: one part."""

    def __init__(self, x: np.ndarray, size: int = 32, columns: int = 8):
        self.x = x
        self.parts = _parts(x, size) if len(x) > 64 * size and x.shape[1] <= columns else [np.arange(len(x))]
        self.low, self.high = (np.stack([f(x[p], axis=0) for p in self.parts]) for f in (np.min, np.max))
        self.sizes = np.array([len(p) for p in self.parts])

    def near(self, q: np.ndarray, k: int, metric: Metric) -> np.ndarray:
        """Places, in order, of all rows that can be among the k nearest of a row of q."""
        if len(self.parts) == 1:
            return self.parts[0]
        low, high = q.min(0), q.max(0)
        least, most = (_norm(v, metric) for v in (np.maximum(0, np.maximum(self.low - high, low - self.high)), np.maximum(self.high - low, high - self.low)))
        by = np.argsort(most)
        bound = most[by[np.searchsorted(np.cumsum(self.sizes[by]), k)]]  # so near are k rows of any query
        return np.sort(np.concatenate([self.parts[i] for i in np.flatnonzero(least <= bound * (1 + 1e-9))]))


def _norm(v: np.ndarray, metric: Metric) -> np.ndarray:
    return np.sqrt((v * v).sum(1)) if metric.kind == "euclidean" else v.sum(1) if metric.kind == "manhattan" else (v**metric.p).sum(1) ** (1 / metric.p)


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows (the last axis), from differences in order of columns: equal distances come out equal, as in SQL."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for j in range(a.shape[-1]):
        e = a[..., j] - b[..., j]
        out += e * e
    return np.sqrt(out)


def nearest(q: np.ndarray, x: np.ndarray | Boxes, k: int, metric: Metric, block: int = 128, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k rows of x nearest to each row of q, by (distance, place)."""
    boxes = x if isinstance(x, Boxes) else Boxes(x)
    k = min(k, len(boxes.x))
    d_out, i_out = np.empty((len(q), k)), np.empty((len(q), k), np.int64)
    for rows in _parts(q, block) if len(boxes.parts) > 1 else [np.arange(i, min(i + block, len(q))) for i in range(0, len(q), block)]:
        at = boxes.near(q[rows], k, metric)
        some = boxes.x[at]
        step = max(1, most // len(at))
        for i in range(0, len(rows), step):
            mine = rows[i : i + step]
            a, slack = q[mine], 0.0
            if metric.kind == "euclidean" and a.shape[1] <= 16:
                d = _direct(a[:, None, :], some[None, :, :])
            else:
                d = metric.pairs(a, some)
                if metric.kind == "euclidean":  # of a product, so within rounding
                    slack = 1e-12 * a.shape[1] * ((a * a).sum(1) + (some * some).sum(1).max())[:, None]
            kth = np.partition(d, k - 1, 1)[:, k - 1 : k]
            r, c = np.nonzero(d <= kth if metric.kind != "euclidean" or a.shape[1] <= 16 else d * d <= kth * kth + slack)
            v = d[r, c] if metric.kind != "euclidean" or a.shape[1] <= 16 else _direct(a[r], some[c])
            by = np.lexsort((c, v, r))
            n = np.bincount(r, minlength=len(mine))
            take = by[(np.cumsum(n) - n)[:, None] + np.arange(k)]
            d_out[mine], i_out[mine] = v[take], at[c[take]]
    return d_out, i_out


def knn_join(queries: DataFrame, query_id: str, stored: DataFrame, stored_id: str, features: Sequence[str], k: int, metric: Metric = Metric(), block_rows: int = 50_000) -> DataFrame:
    """(query_id, stored_id, distance, rank): for each query its k nearest by (distance, id).

    Stored rows are dealt into blocks; a query meets each block once and keeps k of it, so a query sends k rows a block.
    """
    n_stored, n_query = stored.count(), queries.count()
    sb, qb = max(1, -(-n_stored // block_rows)), max(1, -(-n_query // block_rows))
    names = [f"f{i}" for i in range(len(features))]

    def rows(df: DataFrame, id_: str, blocks: int, other: int, mine: str, theirs: str, side: int) -> DataFrame:
        base = df.select(F.col(id_).cast("long").alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, names, strict=True)])
        return base.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select("qb", "sb", F.lit(side).alias("side"), "id", *names)

    both = rows(queries, query_id, qb, sb, "qb", "sb", 0).union(rows(stored, stored_id, sb, qb, "sb", "qb", 1))

    def best(t: pa.Table) -> pa.Table:
        x, side, ids = np.stack([t[c].to_numpy() for c in names], 1), t["side"].to_numpy(), t["id"].to_numpy()
        order = np.argsort(ids[side == 1], kind="stable")
        s, sid, q, qid = x[side == 1][order], ids[side == 1][order], x[side == 0], ids[side == 0]
        if not len(s) or not len(q):
            return pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        d, i = nearest(q, s, k, metric)
        return pa.table({"q": np.repeat(qid, d.shape[1]), "s": sid[i.ravel()], "d": d.ravel()})

    found = both.groupBy("qb", "sb").applyInArrow(best, "q long, s long, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "s"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("s").alias("stored_id"), F.col("d").alias("distance"), "rank")


def radius_join(df: DataFrame, row_id: str, features: Sequence[str], radius: float, metric: Metric = Metric(), block_rows: int = 20_000) -> DataFrame:
    """(a, b): all pairs within the radius, each row with itself too.

    Rows are dealt into a grid over the two features that spread over the most cells of the radius; a row is compared with its own and neighbouring cells.
    """
    spread = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"s{i}") for i, c in enumerate(features)]).first()
    dims = [c for _, c in sorted(((-(spread[f"s{i}"] or 0.0), i), c) for i, c in enumerate(features))][:2]
    names = [f"f{i}" for i in range(len(features))]
    cell = [F.floor(F.col(c).cast("double") / F.lit(float(radius))).cast("long") for c in dims]
    base = df.select(F.col(row_id).cast("long").alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, names, strict=True)], *[c.alias(f"g{i}") for i, c in enumerate(cell)])
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    theirs = base
    for i in range(len(dims)):
        theirs = theirs.withColumn(f"o{i}", F.explode(around)).withColumn(f"g{i}", F.col(f"g{i}") + F.col(f"o{i}")).drop(f"o{i}")
    d = F.lit(0.0)
    for x in names:
        e = F.col(f"l.{x}") - F.col(f"r.{x}")
        d = d + (e * e if metric.kind == "euclidean" else F.abs(e) if metric.kind == "manhattan" else F.pow(F.abs(e), F.lit(float(metric.p))))
    most = radius**2 if metric.kind == "euclidean" else radius if metric.kind == "manhattan" else radius**metric.p
    same = [F.col(f"l.g{i}") == F.col(f"r.g{i}") for i in range(len(dims))]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return base.alias("l").join(theirs.alias("r"), cond & (d <= F.lit(float(most)))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


class KNN(Predictor):
    """Votes of the k nearest by (distance, row order); ties go to the label seen first. weights: uniform, or distance (1 / d; exact matches vote alone)."""

    def __init__(self, k: int = 5, weights: str = "uniform", metric: Metric = Metric()):
        if k < 1 or weights not in ("uniform", "distance"):
            raise InvalidParameter("k must be positive, weights uniform or distance")
        self.k, self.weights, self.metric, self.features = k, weights, metric, None

    def fit(self, df: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id") -> KNN:
        n = check_counts(df.agg(*finite_checks(features)).first(), features)
        if n < self.k:
            raise InvalidInput(f"{self.k} rows are needed")
        self.features, self.label, self.row_id, self.n = list(features), label, row_id, n
        self._labels = [r[label] for r in label_mapping(df, label, row_id).orderBy("index").collect()]
        self._kind = df.schema[label].dataType
        self._stored = df.select(row_id, label, *features)
        return self

    def save(self, spark, path: str) -> None:
        self._check()
        self._stored.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(self.k, self.weights, self.metric.kind, self.metric.p, self.features, self.label, self.row_id)], "k int, weights string, metric string, p double, features array<string>, label string, row_id string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark, path: str) -> KNN:
        r = spark.read.parquet(f"{path}/model").first()
        out = cls(r["k"], r["weights"], Metric(r["metric"], r["p"]))
        return out.fit(spark.read.parquet(f"{path}/rows"), r["features"], r["label"], r["row_id"])

    def _vote(self, d: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.weights == "uniform":
            w = np.ones_like(d)
        else:
            exact = d == 0
            with np.errstate(divide="ignore"):
                w = np.where(exact.any(1, keepdims=True), exact, 1 / d)
        votes = np.zeros((len(d), len(self._labels)))
        np.add.at(votes, (np.arange(len(d))[:, None], y), w)
        return votes.argmax(1)

    def predict(self, df: DataFrame, out: str = "prediction", query_id: str | None = None) -> DataFrame:
        self._check(df)
        if any(c not in df.columns for c in self.features):
            raise DimensionMismatch(self.features, df.columns)
        at = {v: i for i, v in enumerate(self._labels)}
        if self.n * 8 * (len(self.features) + 1) <= MAX_BROADCAST:
            rows = self._stored.orderBy(self.row_id).toArrow()
            x = Boxes(np.stack([rows[c].cast(pa.float64()).to_numpy() for c in self.features], 1))
            y = np.array([at[v] for v in rows[self.label].to_pylist()])
            labels, k, metric = self._labels, self.k, self.metric
            if len(x.parts) > 1:  # a small file of queries may be one task's
                df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)

            def body(q: np.ndarray):
                d, i = nearest(q, x, k, metric)
                return [pa.array([labels[j] for j in self._vote(d, y[i])])]

            kept = self.__dict__.pop("_stored")  # a frame can't go to a task
            try:
                return map_rows(df, self.features, {out: self._kind.simpleString()}, body)
            finally:
                self._stored = kept
        if query_id is None:
            raise InvalidParameter("so many stored rows need query_id")
        pairs = knn_join(df, query_id, self._stored, self.row_id, self.features, self.k, self.metric)
        voted = pairs.join(self._stored.select(F.col(self.row_id).cast("long").alias("stored_id"), self.label), "stored_id")
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))
        w = F.lit(1.0) if self.weights == "uniform" else F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
        rank = df.sparkSession.createDataFrame([(v, i) for v, i in at.items()], StructType([self._stored.schema[self.label], StructField("_i", IntegerType())]))
        tally = voted.withColumn("_w", w).groupBy("query_id", self.label).agg(F.sum("_w").alias("_w")).join(F.broadcast(rank), self.label)
        best = tally.groupBy("query_id").agg(F.max(F.struct("_w", (-F.col("_i")).alias("_i"), F.col(self.label).alias("v"))).alias("m")).select("query_id", F.col("m.v").alias(out))
        return df.drop(out).join(best, F.col(query_id).cast("long") == F.col("query_id")).drop("query_id")

    predict_parallel = predict

