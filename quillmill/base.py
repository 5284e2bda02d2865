"""What estimators share: checks, feature matrices of Arrow batches, sums over all partitions, saving.

A feature matrix is a DataFrame with double columns, named by `features` (their order counts); a target is one more column. Rows
that must keep an order have an explicit id column.
"""

from __future__ import annotations

import copy
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from quillmill.errors import DimensionMismatch, EmptyInput, ModelIoError, NonFinite, NotFitted

EPS = float(np.finfo(np.float64).eps)
#: most bytes of a table that is sent to every task; larger ones take another way
MAX_BROADCAST = 256 << 20


class Estimator(ABC):
    """fit learns from a DataFrame and returns self."""

    features: Sequence[str] | None = None

    def _check(self, df: DataFrame | None = None) -> None:
        if self.features is None:
            raise NotFitted(f"{type(self).__name__} is not fitted")
        if df is not None and (missing := [c for c in self.features if c not in df.columns]):
            raise DimensionMismatch(list(self.features), f"no columns {missing}")

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row: the class and its state."""
        state = json.dumps(self.__dict__, default=_encode)
        spark.createDataFrame([(type(self).__module__, type(self).__qualname__, state)], "module string, kind string, state string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Estimator:
        try:
            row = spark.read.parquet(path).first()
        except Exception as e:
            raise ModelIoError(f"no model at {path}") from e
        if row is None or row["kind"] != cls.__qualname__:
            raise ModelIoError(f"the model is {row and row['kind']}, not {cls.__qualname__}")
        out = cls.__new__(cls)
        out.__dict__.update(json.loads(row["state"], object_hook=_decode))
        return out


def _encode(x):
    if isinstance(x, np.ndarray):
        return {"__array__": x.tolist(), "dtype": str(x.dtype)}
    if isinstance(x, np.generic):
        return x.item()
    if hasattr(x, "__dict__"):
        return {"__object__": [type(x).__module__, type(x).__qualname__], "state": x.__dict__}
    raise TypeError(f"{type(x)} can't be saved")


def _decode(x: dict):
    if "__array__" in x:
        return np.array(x["__array__"], x["dtype"])
    if "__object__" in x and x["__object__"][0].split(".")[0] == __name__.split(".")[0]:
        import importlib

        kind = getattr(importlib.import_module(x["__object__"][0]), x["__object__"][1])
        out = kind.__new__(kind)
        out.__dict__.update(x["state"])
        return out
    return x


class Predictor(Estimator):
    @abstractmethod
    def fit(self, df: DataFrame, features: Sequence[str], label: str): ...

    @abstractmethod
    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame: ...

    def fit_predict(self, df: DataFrame, features: Sequence[str], label: str, out: str = "prediction") -> DataFrame:
        return self.fit(df, features, label).predict(df, out)


class Transformer(Estimator):
    @abstractmethod
    def fit(self, df: DataFrame, features: Sequence[str]): ...

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def fit_transform(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        return self.fit(df, features).transform(df)


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]
    return np.stack(cols, 1) if cols else np.zeros((batch.num_rows, 0))


def bad(c: str) -> Column:
    """Not a finite number."""
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def finite_checks(names: Sequence[str]) -> list[Column]:
    """Aggregates for check_counts, to be put into a fit's own aggregate."""
    some = F.lit(False)
    for c in names:
        some = some | bad(c)
    return [F.count("*").alias("_n"), F.sum(F.when(some, 1).otherwise(0)).alias("_bad")]


def check_counts(row, names: Sequence[str]) -> int:
    if not names or not row["_n"]:
        raise EmptyInput("no rows or no columns")
    if row["_bad"]:
        raise NonFinite(f"{row['_bad']} rows with a value that is null, NaN or infinite")
    return row["_n"]


def partition_sums(df: DataFrame, columns: Sequence[str], part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(rows of the columns as a matrix) over all rows, added up in tasks and in at most 32 further ones, so the driver gets 32 vectors of `size` at most."""
    kind = "v binary"

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in it:
            if b.num_rows:
                total += np.asarray(part(matrix(b, columns)), float).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def second(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in it:
            for v in b.column(0).to_pylist():
                total += np.frombuffer(v, float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    sums = df.select(*columns).mapInArrow(first, kind)
    if df.rdd.getNumPartitions() > 64:
        sums = sums.repartition(32).mapInArrow(second, kind)
    return sum((np.frombuffer(bytes(r["v"]), float) for r in sums.collect()), np.zeros(size))


def map_rows(df: DataFrame, features: Sequence[str], columns: dict[str, str], body: Callable[[np.ndarray], Sequence]) -> DataFrame:
    """df with columns added that body computes from the feature matrix of a batch; existing ones of these names are replaced."""
    keep = df.drop(*columns)
    schema = StructType(list(keep.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, DataType.fromDDL(kind))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = body(matrix(b, features))
            arrays = [x if isinstance(x, pa.Array) else pa.array(list(x) if getattr(x, "ndim", 1) > 1 else x) for x in new]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *columns])

    return keep.mapInArrow(run, schema)


def collect_matrix(df: DataFrame, columns: Sequence[str], most: int = MAX_BROADCAST, order: str | None = None) -> np.ndarray:
    """All rows as a matrix on the driver, for algorithms that need them all at once; more than `most` bytes are an error."""
    n = df.count()
    if n * 8 * max(1, len(columns)) > most:
        raise EngineTooLarge(f"{n} rows by {len(columns)} columns are more than {most} bytes")
    rows = df.orderBy(order) if order else df
    got = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).toArrow()
    return np.stack([got[c].to_numpy() for c in columns], 1) if n else np.zeros((0, len(columns)))


def by_rows(spark: SparkSession, n: int, body: Callable[[np.ndarray], np.ndarray], columns: int, block: int = 256) -> np.ndarray:
    """body(places) of all places 0 .. n - 1 as an n by `columns` matrix: blocks of places are computed in tasks, which have what body holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a in b.column(0).to_pylist():
                x = np.asarray(body(np.arange(a, min(a + block, n))), float)
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["a", "x"])

    parts = max(1, min(-(-n // block), 4 * spark.sparkContext.defaultParallelism))
    got = spark.range(0, n, block, parts).mapInArrow(run, "a long, x binary").toArrow()
    out = np.empty((n, columns))
    for a, x in zip(got["a"].to_pylist(), got["x"].to_pylist(), strict=True):
        x = np.frombuffer(x, float).reshape(-1, columns)
        out[a : a + len(x)] = x
    return out


class EngineTooLarge(EmptyInput):
    """The input is too large for an algorithm that isn't distributed."""


def dot(names: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(names, weights, strict=True):
        out = out + F.col(c).cast("double") * F.lit(float(w))
    return out


def clone(x):
    return copy.deepcopy(x)
