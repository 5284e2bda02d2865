"""Splits, label encoding, one-shot standardise and normalise, and fitted scalers.

Fits are one aggregate each (quantiles exact); transforms are projections that stay in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillmill.base import EPS, Transformer, check_counts, finite_checks
from quillmill.errors import Computation, DimensionMismatch, EmptyInput, InvalidInput, InvalidParameter

# ---------------------------------------------------------------- splits


def _test_size(size: float) -> float:
    if not 0 < size < 1:
        raise InvalidParameter("test_size must be between 0 and 1")
    return size


def _hash_order(row_id: str, seed: int | None) -> Column:
    from quillmill.random import make_rng

    salt = seed if seed is not None else int(make_rng().integers(1 << 31))
    return F.xxhash64(F.col(row_id), F.lit(salt).cast("long"))


def train_test_split(df: DataFrame, row_id: str, test_size: float = 0.3, random_state: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exactly round(n * test_size) rows (1 to n - 1) go to the test part, by the order of a seeded hash of row_id.

    The cut is found from counts of hash buckets and a top-k within one of them: no global sort.
    """
    size, n = _test_size(test_size), df.count()
    if n < 2:
        raise EmptyInput("at least two rows are needed")
    n_test = min(n - 1, max(1, int(n * size + 0.5)))
    h = _hash_order(row_id, random_state)
    bucket = F.shiftright(h, 52)  # 4096 ranges of the hash
    total, cut = 0, None
    for b, m in sorted((r["b"], r["count"]) for r in df.select(bucket.alias("b")).groupBy("b").count().collect()):
        if total + m >= n_test:
            inside = df.where(bucket == b).select(h.alias("h"), F.col(row_id).alias("i")).orderBy("h", "i").limit(n_test - total).agg(F.max(F.struct("h", "i")).alias("x")).first()["x"]
            cut = (inside["h"], inside["i"])
            break
        total += m
    test = (h < cut[0]) | ((h == cut[0]) & (F.col(row_id) <= F.lit(cut[1])))
    return df.where(~test), df.where(test)


def train_test_split_stratified(df: DataFrame, row_id: str, label: str, test_size: float = 0.3, random_state: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same within each label (each needs two rows)."""
    size = _test_size(test_size)
    h = _hash_order(row_id, random_state)
    counts = df.groupBy(label).agg(F.count("*").alias("_m"))
    if (least := counts.agg(F.min("_m")).first()[0]) is None or least < 2:
        raise InvalidInput("each label needs two rows")
    cut = F.least(F.col("_m") - 1, F.greatest(F.lit(1), F.floor(F.col("_m") * size + 0.5)))
    # ranks come from (label, hash range) groups and the counts of the ranges before, so a large label is not one task
    ranged = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 52))
    before = ranged.groupBy(label, "_b").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", row_id)))
    marked = rank.join(before.select(label, "_b", "_before"), [label, "_b"]).join(counts, label).withColumn("_test", F.col("_before") + F.col("_r") <= cut)
    return marked.where(~F.col("_test")).select(df.columns), marked.where("_test").select(df.columns)


# ---------------------------------------------------------------- labels


def to_categorical(df: DataFrame, label: str, num_classes: int | None = None, out: str = "categorical") -> DataFrame:
    """One-hot array of doubles."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    if low is not None and low < 0:
        raise InvalidInput("labels must not be negative")
    need = 1 if high is None else int(high) + 1
    k = need if num_classes is None else num_classes
    if k < need:
        raise InvalidParameter(f"num_classes must be at least {need}")
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col(label)).cast("double")))


def label_mapping(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """(label, index): indices in the order of each label's first row; as many rows as labels."""
    firsts = df.groupBy(label).agg(F.min(row_id).alias("_first"))
    return firsts.withColumn("index", F.row_number().over(Window.orderBy("_first", label)) - 1).select(label, "index")


def to_categorical_with_mapping(df: DataFrame, label: str, row_id: str, num_classes: int | None = None, out: str = "categorical") -> tuple[DataFrame, dict]:
    mapping = {r[label]: r["index"] for r in label_mapping(df, label, row_id).collect()}
    k = max(1, len(mapping)) if num_classes is None else num_classes
    if k < len(mapping):
        raise InvalidParameter(f"num_classes must be at least {len(mapping)}")
    spark = df.sparkSession
    table = spark.createDataFrame(list(mapping.items()), StructType([df.schema[label], StructField("_index", IntegerType())]))
    joined = df.join(F.broadcast(table), df[label].eqNullSafe(table[label]), "left").drop(table[label])
    return joined.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("_index")).cast("double"))).drop("_index"), mapping


def to_sparse_categorical(df: DataFrame, categorical: str, out: str = "label") -> DataFrame:
    """Index of an array's greatest value, the first of equals."""
    c = F.col(categorical)
    return df.withColumn(out, (F.array_position(c, F.array_max(c)) - 1).cast("int"))


# ---------------------------------------------------------------- one-shot


def _columnwise(df: DataFrame, features: Sequence[str], terms) -> DataFrame:
    """terms(stats row) gives each column's expression; one aggregate."""
    return df.select(*[c for c in df.columns if c not in features], *terms)


def _constant(mean: float, var: float, n: int) -> bool:
    return var <= n * EPS * var + (n * mean * EPS) ** 2


def standardize(df: DataFrame, features: Sequence[str], axis: str = "column") -> DataFrame:
    """(x - mean) / population deviation by column, row, or over all values; constant lanes are only centred."""
    if axis == "row":
        a = F.array(*[F.col(c).cast("double") for c in features])
        n = float(len(features))
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
        named = df.withColumn("_a", a).withColumn("_mean", mean)
        var = F.aggregate("_a", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
        scaled = named.withColumn("_var", var).withColumn("_sd", F.when(F.col("_var") <= n * EPS * F.col("_var") + F.pow(n * F.col("_mean") * EPS, F.lit(2.0)), 1.0).otherwise(F.sqrt("_var")))
        return scaled.select(*[c if c not in features else ((F.col(c) - F.col("_mean")) / F.col("_sd")).alias(c) for c in df.columns])
    aggs = [x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    r = df.agg(*aggs, *finite_checks(features)).first()
    n = check_counts(r, features)
    if axis == "column":
        stats = {c: (r[f"m_{c}"], r[f"v_{c}"], n) for c in features}
    elif axis == "global":
        mean = sum(r[f"m_{c}"] for c in features) / len(features)
        var = sum(r[f"v_{c}"] + (r[f"m_{c}"] - mean) ** 2 for c in features) / len(features)
        stats = dict.fromkeys(features, (mean, var, n * len(features)))
    else:
        raise InvalidParameter(f"no axis {axis}")
    return df.select(*[c if c not in stats else ((F.col(c) - stats[c][0]) / (1.0 if _constant(*stats[c]) else stats[c][1] ** 0.5)).alias(c) for c in df.columns])


def norm_of(a: Column, order: str | float) -> Column:
    """The norm of an array column: l1, l2, max or a number p > 0."""
    if order == "l1":
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    if order == "l2":
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    if order == "max":
        return F.array_max(F.transform(a, lambda x: F.abs(x)))
    p = _power(order)
    return F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(p))), F.lit(1 / p))


def _power(order) -> float:
    if isinstance(order, str) or not order > 0:
        raise InvalidParameter(f"no norm {order}")
    return float(order)


def normalize(df: DataFrame, features: Sequence[str], axis: str = "row", order: str | float = "l2") -> DataFrame:
    """x / norm by row, column, or over all values; lanes with a norm under 10 eps stay."""
    tiny = 10 * EPS
    if axis == "row":
        named = df.withColumn("_norm", norm_of(F.array(*[F.col(c).cast("double") for c in features]), order))
        return named.select(*[c if c not in features else F.when(F.col("_norm") < tiny, F.col(c).cast("double")).otherwise(F.col(c) / F.col("_norm")).alias(c) for c in df.columns])
    p = {"l1": 1.0, "l2": 2.0}.get(order) if isinstance(order, str) and order != "max" else order
    term = (lambda c: F.max(F.abs(F.col(c)))) if order == "max" else (lambda c: F.sum(F.pow(F.abs(F.col(c).cast("double")), F.lit(_power(p)))))
    r = df.agg(*[term(c).alias(c) for c in features], *finite_checks(features)).first()
    check_counts(r, features)
    if axis == "column":
        norms = {c: r[c] if order == "max" else r[c] ** (1 / p) for c in features}
    elif axis == "global":
        norms = dict.fromkeys(features, max(r[c] for c in features) if order == "max" else sum(r[c] for c in features) ** (1 / p))
    else:
        raise InvalidParameter(f"no axis {axis}")
    if any(v == float("inf") for v in norms.values()):
        raise Computation("a norm overflowed")
    return df.select(*[c if c not in norms else (F.col(c).cast("double") if norms[c] < tiny else F.col(c) / F.lit(norms[c])).alias(c) for c in df.columns])


# ---------------------------------------------------------------- scalers


class _ColumnScaler(Transformer):
    """A scaler that maps each column by itself; _forward and _back give a column's expression."""

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return df.select(*[self._forward(c).alias(c) if c in self.features else c for c in df.columns])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return df.select(*[self._back(c).alias(c) if c in self.features else c for c in df.columns])

    @property
    def n_features(self) -> int:
        self._check()
        return len(self.features)

    def _same(self, features: Sequence[str]) -> None:
        if list(features) != list(self.features):
            raise DimensionMismatch(list(self.features), list(features))


class StandardScaler(_ColumnScaler):
    """Population mean and deviation; partial_fit merges a further batch's moments exactly."""

    def __init__(self, with_mean: bool = True, with_std: bool = True):
        self.with_mean, self.with_std, self.features = with_mean, with_std, None

    def _moments(self, df: DataFrame, features: Sequence[str]):
        r = df.agg(*[x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))], *finite_checks(features)).first()
        n = check_counts(r, features)
        return n, {c: float(r[f"m_{c}"]) for c in features}, {c: float(r[f"v_{c}"]) * n for c in features}

    def fit(self, df: DataFrame, features: Sequence[str]) -> StandardScaler:
        self.n, self.mean, self.m2 = self._moments(df, features)
        self.features = list(features)
        return self

    def partial_fit(self, df: DataFrame, features: Sequence[str]) -> StandardScaler:
        if self.features is None:
            return self.fit(df, features)
        self._same(features)
        n, mean, m2 = self._moments(df, features)
        total = self.n + n
        for c in features:
            d = mean[c] - self.mean[c]
            self.m2[c] += m2[c] + d * d * self.n * n / total
            self.mean[c] += d * n / total
        self.n = total
        return self

    @property
    def var(self) -> dict[str, float]:
        return {c: self.m2[c] / self.n for c in self.features}

    @property
    def scale(self) -> dict[str, float]:
        return {c: 1.0 if _constant(self.mean[c], v, self.n) else v**0.5 for c, v in self.var.items()}

    def _forward(self, c: str) -> Column:
        x = F.col(c) - F.lit(self.mean[c]) if self.with_mean else F.col(c).cast("double")
        return x / F.lit(self.scale[c]) if self.with_std else x

    def _back(self, c: str) -> Column:
        x = F.col(c) * F.lit(self.scale[c]) if self.with_std else F.col(c).cast("double")
        return x + F.lit(self.mean[c]) if self.with_mean else x


class MinMaxScaler(_ColumnScaler):
    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0), clip: bool = False):
        self.clip, self.features = clip, None
        self.with_feature_range(*feature_range)

    def with_feature_range(self, low: float, high: float) -> MinMaxScaler:
        if not low < high or abs(low) == float("inf") or abs(high) == float("inf"):
            raise InvalidParameter("the range must be finite and not empty")
        self.range = (float(low), float(high))
        return self

    def fit(self, df: DataFrame, features: Sequence[str]) -> MinMaxScaler:
        self.data_min, self.data_max = self._extremes(df, features)
        self.features = list(features)
        return self

    def _extremes(self, df: DataFrame, features: Sequence[str]):
        r = df.agg(*[x for c in features for x in (F.min(c).cast("double").alias(f"a_{c}"), F.max(c).cast("double").alias(f"z_{c}"))], *finite_checks(features)).first()
        check_counts(r, features)
        return {c: r[f"a_{c}"] for c in features}, {c: r[f"z_{c}"] for c in features}

    def partial_fit(self, df: DataFrame, features: Sequence[str]) -> MinMaxScaler:
        if self.features is None:
            return self.fit(df, features)
        self._same(features)
        low, high = self._extremes(df, features)
        self.data_min = {c: min(self.data_min[c], low[c]) for c in features}
        self.data_max = {c: max(self.data_max[c], high[c]) for c in features}
        return self

    @property
    def data_range(self) -> dict[str, float]:
        return {c: self.data_max[c] - self.data_min[c] for c in self.features}

    def _affine(self, c: str) -> tuple[float, float]:
        width = self.data_max[c] - self.data_min[c]
        scale = (self.range[1] - self.range[0]) / (1.0 if width < 10 * EPS else width)
        return scale, self.range[0] - self.data_min[c] * scale

    def _forward(self, c: str) -> Column:
        scale, offset = self._affine(c)
        x = F.col(c) * F.lit(scale) + F.lit(offset)
        return F.greatest(F.least(x, F.lit(self.range[1])), F.lit(self.range[0])) if self.clip else x

    def _back(self, c: str) -> Column:
        scale, offset = self._affine(c)
        return (F.col(c) - F.lit(offset)) / F.lit(scale)


class MaxAbsScaler(_ColumnScaler):
    def __init__(self):
        self.features = None

    def _greatest(self, df: DataFrame, features: Sequence[str]):
        r = df.agg(*[F.max(F.abs(c)).cast("double").alias(c) for c in features], *finite_checks(features)).first()
        check_counts(r, features)
        return {c: r[c] for c in features}

    def fit(self, df: DataFrame, features: Sequence[str]) -> MaxAbsScaler:
        self.max_abs, self.features = self._greatest(df, features), list(features)
        return self

    def partial_fit(self, df: DataFrame, features: Sequence[str]) -> MaxAbsScaler:
        if self.features is None:
            return self.fit(df, features)
        self._same(features)
        more = self._greatest(df, features)
        self.max_abs = {c: max(self.max_abs[c], more[c]) for c in features}
        return self

    def _scale(self, c: str) -> Column:
        return F.lit(1.0 if self.max_abs[c] < 10 * EPS else self.max_abs[c])

    def _forward(self, c: str) -> Column:
        return F.col(c) / self._scale(c)

    def _back(self, c: str) -> Column:
        return F.col(c) * self._scale(c)


class RobustScaler(_ColumnScaler):
    """Median and exact interpolated quantile range."""

    def __init__(self, with_centering: bool = True, with_scaling: bool = True, quantile_range: tuple[float, float] = (25.0, 75.0)):
        self.with_centering, self.with_scaling = with_centering, with_scaling
        self.with_quantile_range(*quantile_range)

    def with_quantile_range(self, low: float, high: float) -> RobustScaler:
        if not 0 <= low < high <= 100:
            raise InvalidParameter("quantiles must satisfy 0 <= low < high <= 100")
        self.quantile_range, self.features = (float(low), float(high)), None  # a new range undoes a fit
        return self

    def fit(self, df: DataFrame, features: Sequence[str]) -> RobustScaler:
        q = [self.quantile_range[0] / 100, 0.5, self.quantile_range[1] / 100]
        r = df.agg(*[F.percentile(F.col(c).cast("double"), q).alias(c) for c in features], *finite_checks(features)).first()
        check_counts(r, features)
        self.center = {c: r[c][1] for c in features}
        self.scale = {c: 1.0 if r[c][2] - r[c][0] < 10 * EPS else r[c][2] - r[c][0] for c in features}
        self.features = list(features)
        return self

    def _forward(self, c: str) -> Column:
        x = F.col(c) - F.lit(self.center[c]) if self.with_centering else F.col(c).cast("double")
        return x / F.lit(self.scale[c]) if self.with_scaling else x

    def _back(self, c: str) -> Column:
        x = F.col(c) * F.lit(self.scale[c]) if self.with_scaling else F.col(c).cast("double")
        return x + F.lit(self.center[c]) if self.with_centering else x


class Normalizer(Transformer):
    """Row-wise norms; fit learns only the columns."""

    def __init__(self, order: str | float = "l2"):
        norm_of(F.array(F.lit(1.0)), order)
        self.order, self.features = order, None

    def fit(self, df: DataFrame, features: Sequence[str]) -> Normalizer:
        check_counts(df.agg(*finite_checks(features)).first(), features)
        self.features = list(features)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return normalize(df, self.features, "row", self.order)
