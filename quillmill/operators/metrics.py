"""Metrics over DataFrames. A metric is a one-row DataFrame (scalar() gives its number); curves have a row per threshold."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.base import EPS
from quillmill.errors import EmptyInput, InvalidInput, InvalidParameter
from quillmill.functions.distance import Metric
from quillmill.plans.components import checkpointed


def scalar(df: DataFrame) -> float:
    r = df.first()
    if r is None or r[0] is None:
        raise EmptyInput("no rows")
    return r[0]


def _c(name: str) -> Column:
    return F.col(name).cast("double")


# ---------------------------------------------------------------- regression


def mean_squared_error(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    d = _c(y_true) - _c(y_pred)
    return df.agg(F.avg(d * d).alias("mse"))


def root_mean_squared_error(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return mean_squared_error(df, y_true, y_pred).select(F.sqrt("mse").alias("rmse"))


def mean_absolute_error(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.agg(F.avg(F.abs(_c(y_true) - _c(y_pred))).alias("mae"))


def _share(rest: Column, total: Column, constant: Column) -> Column:
    return F.when(constant, F.when(rest == 0, 1.0).otherwise(0.0)).otherwise(1 - rest / total)


def r2_score(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """1 - SSE / SST; for constant truth 1 if exact, else 0."""
    d = _c(y_true) - _c(y_pred)
    sums = df.agg(F.sum(d * d).alias("sse"), (F.var_pop(_c(y_true)) * F.count("*")).alias("sst"), (F.min(_c(y_true)) == F.max(_c(y_true))).alias("k"))
    return sums.select(_share(F.col("sse"), F.col("sst"), F.col("k")).alias("r2"))


def explained_variance_score(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """1 - Var(t - p) / Var(t), each over its finite values."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    t, d = finite(_c(y_true)), finite(_c(y_true) - _c(y_pred))
    v = df.agg(F.var_pop(d).alias("a"), F.var_pop(t).alias("b"))
    return v.select(_share(F.col("a"), F.col("b"), F.col("b") == 0).alias("explained_variance"))


def median_absolute_error(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.agg(F.percentile(F.abs(_c(y_true) - _c(y_pred)), 0.5).alias("median_ae"))


def mean_absolute_percentage_error(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.agg(F.avg(F.abs(_c(y_true) - _c(y_pred)) / F.greatest(F.abs(_c(y_true)), F.lit(EPS))).alias("mape"))


# ---------------------------------------------------------------- binary classification


def confusion(df: DataFrame, y_true: str, y_pred: str, negative: float = 0.0, positive: float = 1.0) -> DataFrame:
    """tp, fp, tn, fn in one pass; labels that are neither are an error when the row is read."""
    t, p = _c(y_true), _c(y_pred)
    known = t.isin(negative, positive) & p.isin(negative, positive)
    n = lambda a, b: F.sum(F.when((t == a) & (p == b), 1).otherwise(0))
    return df.where(F.when(known, True).otherwise(F.raise_error(F.lit("a label is neither of the two")).cast("boolean"))).agg(n(positive, positive).alias("tp"), n(negative, positive).alias("fp"), n(negative, negative).alias("tn"), n(positive, negative).alias("fn"))


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def binary_report(df: DataFrame, y_true: str, y_pred: str, negative: float = 0.0, positive: float = 1.0) -> DataFrame:
    """All binary scores of a confusion matrix."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp, 1.0)
    accuracy = _ratio(tp + tn, total)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return confusion(df, y_true, y_pred, negative, positive).select(
        "tp", "fp", "tn", "fn", accuracy.alias("accuracy"), (1 - accuracy).alias("error_rate"), precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"),
        _ratio(2 * precision * recall, precision + recall).alias("f1"), _ratio(tp * tn - fp * fn, root).alias("mcc"), ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


class ConfusionMatrix:
    """The counts and scores as numbers."""

    def __init__(self, df: DataFrame, y_true: str, y_pred: str, negative: float = 0.0, positive: float = 1.0):
        self._row = binary_report(df, y_true, y_pred, negative, positive).first().asDict()
        self._row |= {k: v or 0 for k, v in self._row.items() if k in ("tp", "fp", "tn", "fn")}

    def __getattr__(self, name: str):
        if name in self.__dict__.get("_row", {}):
            return lambda: self._row[name]
        raise AttributeError(name)

    def f1_score(self) -> float:
        return self._row["f1"]

    def get_counts(self) -> tuple[int, int, int, int]:
        return tuple(self._row[k] for k in ("tp", "fp", "tn", "fn"))

    def summary(self) -> str:
        tp, fp, tn, fn = self.get_counts()
        head = f"{'':>16}{'predicted 1':>14}{'predicted 0':>14}\n{'actual 1':>16}{tp:>14}{fn:>14}\n{'actual 0':>16}{fp:>14}{tn:>14}\n"
        return head + "\n".join(f"{k:>18}: {v:.4f}" for k, v in self._row.items() if k not in ("tp", "fp", "tn", "fn"))


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.agg(F.avg((F.abs(_c(y_true) - _c(y_pred)) < EPS).cast("double")).alias("accuracy"))


def ranked_cumulative(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, tp, fp: positives and negatives with at least this score, per distinct score.

    Running sums over ranges of scores and then within them, so that no task sorts all scores.
    """
    by = df.groupBy(_c(score).alias("score")).agg(F.sum(F.when(F.col(label).cast("boolean"), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    return running_sums(by, "score", {"tp": F.col("p"), "fp": F.col("n") - F.col("p")}, descending=True).select("score", "tp", "fp")


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = False, ranges: int = 200) -> DataFrame:
    """df with running sums (each row's included) in the order of a numeric column without repeats.

    Rows are dealt into quantile ranges; totals of earlier ranges (at most `ranges` rows) are added to the sums within a range.
    """
    probs = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.select(F.col(order).cast("double").alias("x")).approxQuantile("x", probs, 0.002)))
    spread = F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c <= F.col(order).cast("double"))) if cuts else F.lit(0)
    named = df.withColumn("_range", spread)
    for k, c in sums.items():
        named = named.withColumn(f"_{k}", c)
    direction = -1 if descending else 1
    totals = {r["_range"]: r for r in named.groupBy("_range").agg(*[F.sum(f"_{k}").alias(k) for k in sums]).collect()}  # a row for each range
    before, run = [], dict.fromkeys(sums, 0)
    for g in sorted(totals, reverse=descending):
        before.append((g, *(run[k] for k in sums)))
        run = {k: run[k] + (totals[g][k] or 0) for k in sums}
    if not before:
        return named.select(*df.columns, *[F.col(f"_{k}").alias(k) for k in sums])
    table = df.sparkSession.createDataFrame(before, ["_range", *[f"_before_{k}" for k in sums]])
    w = Window.partitionBy("_range").orderBy((F.col(order) * direction).asc()).rowsBetween(Window.unboundedPreceding, 0)
    return named.withColumns({f"_in_{k}": F.sum(f"_{k}").over(w) for k in sums}).join(F.broadcast(table), "_range").select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums])


def _totals(ranked: DataFrame) -> tuple[int, int]:
    r = ranked.agg(F.max("tp"), F.max("fp")).first()
    return r[0] or 0, r[1] or 0


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney statistic with half a win for ties."""
    by = df.groupBy(_c(score).alias("score")).agg(F.sum(F.when(F.col(label).cast("boolean"), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    cum = running_sums(by, "score", {"below": F.col("n") - F.col("p")})
    q = F.col("n") - F.col("p")
    wins = F.sum(F.col("p") * (F.col("below") - q / 2))
    total = F.sum("p").cast("double") * F.sum(q)
    return cum.agg(F.when(total > 0, wins / total).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """fpr, tpr, threshold: the origin at an infinite threshold, then each distinct score from the top."""
    ranked = ranked_cumulative(df, label, score)
    tp, fp = _totals(ranked)
    if not tp or not fp:
        raise InvalidInput("both classes are needed")
    origin = df.sparkSession.createDataFrame([(0.0, 0.0, float("inf"))], "fpr double, tpr double, threshold double")
    return ranked.select((F.col("fp") / F.lit(float(fp))).alias("fpr"), (F.col("tp") / F.lit(float(tp))).alias("tpr"), F.col("score").alias("threshold")).union(origin)


def precision_recall_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """precision, recall, threshold per distinct score, and (1, 0) without a threshold."""
    ranked = ranked_cumulative(df, label, score)
    tp, _ = _totals(ranked)
    if not tp:
        raise InvalidInput("a positive label is needed")
    end = df.sparkSession.createDataFrame([(1.0, 0.0, None)], "precision double, recall double, threshold double")
    return ranked.select((F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.lit(float(tp))).alias("recall"), F.col("score").alias("threshold")).union(end)


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times the step in recall: the step at a score is its own positives over all."""
    by = df.groupBy(_c(score).alias("score")).agg(F.sum(F.when(F.col(label).cast("boolean"), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    cum = running_sums(by, "score", {"tp": F.col("p"), "seen": F.col("n")}, descending=True)
    return cum.agg((F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")).alias("average_precision"))


def log_loss(df: DataFrame, y_true: str, probs: str) -> DataFrame:
    """-mean ln of the true class's share of a row's probabilities, clipped by eps."""
    p = F.get(F.col(probs), F.col(y_true).cast("int")) / F.aggregate(F.col(probs), F.lit(0.0), lambda s, x: s + x)
    known = F.when((F.col(y_true) < 0) | (F.col(y_true) >= F.size(probs)), F.raise_error(F.lit("label out of range")).cast("double")).otherwise(p)
    return df.agg((-F.avg(F.ln(F.greatest(F.least(known, F.lit(1 - EPS)), F.lit(EPS))))).alias("log_loss"))


def top_k_accuracy(df: DataFrame, y_true: str, probs: str, k: int) -> DataFrame:
    """A hit has fewer than k strictly greater scores."""
    if k < 1:
        raise InvalidParameter("k must be at least 1")
    mine = F.get(F.col(probs), F.col(y_true).cast("int"))
    named = df.withColumn("_mine", mine)
    return named.agg(F.avg((F.size(F.filter(F.col(probs), lambda x: x > F.col("_mine"))) < k).cast("double")).alias("top_k_accuracy"))


# ---------------------------------------------------------------- multiclass


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n for each pair that occurs."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


class MulticlassConfusionMatrix:
    """Counts over the sorted union of both columns' labels; the driver holds as many numbers as pairs of labels occur."""

    def __init__(self, df: DataFrame, y_true: str, y_pred: str):
        got = [(r["a"], r["b"], r["n"]) for r in contingency(df, y_true, y_pred).collect()]
        if not got:
            raise EmptyInput("no rows")
        self.labels = sorted({x for a, b, _ in got for x in (a, b)})
        at = {x: i for i, x in enumerate(self.labels)}
        self.matrix = np.zeros((len(at), len(at)), np.int64)
        for a, b, n in got:
            self.matrix[at[a], at[b]] = n

    @property
    def n_classes(self) -> int:
        return len(self.labels)

    def support(self) -> np.ndarray:
        return self.matrix.sum(1)

    def accuracy(self) -> float:
        return float(np.trace(self.matrix) / self.matrix.sum())

    def per_class_precision(self) -> np.ndarray:
        d = self.matrix.sum(0)
        return np.divide(np.diag(self.matrix), d, out=np.zeros(len(d)), where=d > 0)

    def per_class_recall(self) -> np.ndarray:
        d = self.matrix.sum(1)
        return np.divide(np.diag(self.matrix), d, out=np.zeros(len(d)), where=d > 0)

    def per_class_f1(self) -> np.ndarray:
        p, r = self.per_class_precision(), self.per_class_recall()
        return np.divide(2 * p * r, p + r, out=np.zeros(len(p)), where=p + r > 0)

    def _average(self, per: np.ndarray, average: str) -> float:
        if average == "macro":
            return float(per.mean())
        if average == "micro":
            return self.accuracy()
        if average == "weighted":
            return float((per * self.support()).sum() / self.support().sum())
        raise InvalidParameter(f"no average {average}")

    def precision(self, average: str = "macro") -> float:
        return self._average(self.per_class_precision(), average)

    def recall(self, average: str = "macro") -> float:
        return self._average(self.per_class_recall(), average)

    def f1(self, average: str = "macro") -> float:
        return self._average(self.per_class_f1(), average)

    def summary(self) -> str:
        lines = [f"{'label':>12}{'precision':>11}{'recall':>11}{'f1':>11}{'support':>10}"]
        for x, p, r, f, n in zip(self.labels, self.per_class_precision(), self.per_class_recall(), self.per_class_f1(), self.support(), strict=True):
            lines.append(f"{x!s:>12}{p:>11.4f}{r:>11.4f}{f:>11.4f}{n:>10}")
        lines += [f"{k:>12}{self.precision(k):>11.4f}{self.recall(k):>11.4f}{self.f1(k):>11.4f}{self.matrix.sum():>10}" for k in ("macro", "weighted")]
        return "\n".join([*lines, f"{'accuracy':>12}{self.accuracy():>11.4f}"])


def per_class_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """label, precision, recall, f1, support of every label, without collecting."""
    n = contingency(df, y_true, y_pred)
    marks = n.select(F.col("a").alias("label"), F.col("n").alias("s"), F.lit(0).alias("c"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("tp")).union(n.select("b", F.lit(0), "n", F.lit(0)))
    sums = marks.groupBy("label").agg(F.sum("s").alias("support"), F.sum("c").alias("called"), F.sum("tp").alias("tp"))
    p, r = _ratio(F.col("tp").cast("double"), F.col("called")), _ratio(F.col("tp").cast("double"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), "support")


def cohen_kappa(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """(po - pe) / (1 - pe), 1 where chance agreement is total."""
    n = contingency(df, y_true, y_pred)
    marks = n.select(F.col("a").alias("label"), F.col("n").alias("s"), F.lit(0).alias("c"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("tp")).union(n.select("b", F.lit(0), "n", F.lit(0)))
    sums = marks.groupBy("label").agg(F.sum("s").cast("double").alias("s"), F.sum("c").cast("double").alias("c"), F.sum("tp").alias("tp"))
    total = sums.agg(F.sum("s").alias("t"), F.sum(F.col("s") * F.col("c")).alias("x"), F.sum("tp").alias("tp"))
    po, pe = F.col("tp") / F.col("t"), F.col("x") / (F.col("t") * F.col("t"))
    return total.select(F.when(F.abs(1 - pe) < 1e-10, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


# ---------------------------------------------------------------- clustering


def _margins(df: DataFrame, a: str, b: str):
    """The pair counts with their row and column sums; as many rows as pairs of labels."""
    n = contingency(df, a, b)
    return n.withColumn("ra", F.sum("n").over(Window.partitionBy("a"))).withColumn("cb", F.sum("n").over(Window.partitionBy("b")))


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mi, h_a, h_b (nats), and the pair counts of all, rows, columns and cells."""
    m = _margins(df, a, b)
    t = m.agg(F.sum("n")).first()[0]
    if not t:
        raise EmptyInput("no rows")
    n, ra, cb, t = (F.col("n").cast("double"), F.col("ra").cast("double"), F.col("cb").cast("double"), F.lit(float(t)))
    pairs = lambda x: x * (x - 1) / 2
    return m.agg(
        t.alias("n"), F.sum(n / t * F.ln(n * t / (ra * cb))).alias("mi"), (-F.sum(n / t * F.ln(ra / t))).alias("h_a"), (-F.sum(n / t * F.ln(cb / t))).alias("h_b"),
        F.sum(pairs(n)).alias("same_both"), F.sum(n * (ra - 1) / 2).alias("same_a"), F.sum(n * (cb - 1) / 2).alias("same_b"),
    )


def normalized_mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    h = (F.col("h_a") + F.col("h_b")) / 2
    return cluster_agreement(df, a, b).select(F.when(h <= 1e-15, 0.0).otherwise(F.col("mi") / h).alias("nmi"))


def expected_mutual_information(rows: np.ndarray, cols: np.ndarray, n: int) -> float:
    """Of two labelings with these cluster sizes, by the hypergeometric model; equal sizes are computed once."""
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    out = 0.0
    ru, rc = np.unique(rows, return_counts=True)
    cu, cc = np.unique(cols, return_counts=True)
    for a, ka in zip(ru.tolist(), rc.tolist(), strict=True):
        for b, kb in zip(cu.tolist(), cc.tolist(), strict=True):
            k = np.arange(max(1, a + b - n), min(a, b) + 1)
            logp = lf[a] + lf[b] + lf[n - a] + lf[n - b] - lf[n] - lf[k] - lf[a - k] - lf[b - k] - lf[n - a - b + k]
            out += ka * kb * float((k / n * np.log(n * k / (a * b)) * np.exp(logp)).sum())
    return out


def adjusted_mutual_info(df: DataFrame, a: str, b: str) -> float:
    r = cluster_agreement(df, a, b).first()
    sizes = [np.array([x["count"] for x in df.groupBy(c).count().collect()]) for c in (a, b)]
    if len(sizes[0]) == len(sizes[1]) == 1:
        return 1.0
    emi = expected_mutual_information(*sizes, int(r["n"]))
    d = (r["h_a"] + r["h_b"]) / 2 - emi
    return 1.0 if abs(d) < 1e-10 else (r["mi"] - emi) / d


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y, both, t = F.col("same_a"), F.col("same_b"), F.col("same_both"), F.col("n") * (F.col("n") - 1) / 2
    expected = F.when(t > 0, x * y / t)
    d = (x + y) / 2 - expected
    return cluster_agreement(df, a, b).select(F.when((F.col("n") < 2) | (F.abs(d) < 1e-10), 1.0).otherwise((both - expected) / d).alias("ari"))


def homogeneity_completeness_v(df: DataFrame, a: str, b: str) -> DataFrame:
    h = F.when(F.col("h_a") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_a"))
    c = F.when(F.col("h_b") <= 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_b"))
    return cluster_agreement(df, a, b).select(h.alias("homogeneity"), c.alias("completeness")).withColumn("v_measure", _ratio(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")))


def homogeneity_score(df: DataFrame, a: str, b: str) -> DataFrame:
    return homogeneity_completeness_v(df, a, b).select("homogeneity")


def completeness_score(df: DataFrame, a: str, b: str) -> DataFrame:
    return homogeneity_completeness_v(df, a, b).select("completeness")


def v_measure_score(df: DataFrame, a: str, b: str) -> DataFrame:
    return homogeneity_completeness_v(df, a, b).select("v_measure")


def fowlkes_mallows_score(df: DataFrame, a: str, b: str) -> DataFrame:
    return cluster_agreement(df, a, b).select(_ratio(F.col("same_both"), F.sqrt(F.col("same_a") * F.col("same_b"))).alias("fowlkes_mallows"))


def _clusters(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_m"), *[F.avg(c).alias(f"_c_{c}") for c in features])


def _squared(features: list[str]) -> Column:
    out = F.lit(0.0)
    for c in features:
        d = F.col(c) - F.col(f"_c_{c}")
        out = out + d * d
    return out


def calinski_harabasz_score(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Between over within dispersion, 1 where nothing is within."""
    centres = _clusters(df, features, label)
    within = df.join(F.broadcast(centres), df[label] == centres["_label"]).agg(F.sum(_squared(features)).alias("w"), F.count("*").alias("n"))
    mean = df.agg(*[F.avg(c).alias(f"_g_{c}") for c in features])
    g = mean.first()
    between = F.lit(0.0)
    for c in features:
        between = between + F.col("_m") * F.pow(F.col(f"_c_{c}") - F.lit(g[f"_g_{c}"]), F.lit(2.0))
    b = centres.agg(F.sum(between), F.count("*")).first()
    return within.select(F.when(F.col("w") == 0, 1.0).otherwise(F.lit(b[0]) / F.col("w") * (F.col("n") - b[1]) / (b[1] - 1)).alias("calinski_harabasz"))


def davies_bouldin_score(df: DataFrame, features: list[str], label: str) -> float:
    """Mean over clusters of the worst (spread + spread) / distance of centres; the driver holds the centres."""
    centres = _clusters(df, features, label)
    spread = df.join(F.broadcast(centres), df[label] == centres["_label"]).groupBy("_label").agg(F.avg(F.sqrt(_squared(features))).alias("_s"), *[F.first(f"_c_{c}").alias(c) for c in features])
    got = spread.collect()
    s, c = np.array([r["_s"] for r in got]), np.array([[r[f] for f in features] for r in got])
    d = Metric().pairs(c, c)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(d > 0, (s[:, None] + s[None, :]) / d, 0.0)
    np.fill_diagonal(ratio, 0)
    return float(ratio.max(1).mean())


def silhouette_score(df: DataFrame, features: list[str], label: str, metric: Metric = Metric(), block: int = 4096) -> DataFrame:
    """Mean of (b - a) / max(a, b).

    Equal points of a cluster are one with a count. These are dealt into blocks; a task gets one block of points and streams one of others, and returns each point's sum of distances
    to each cluster. A point's sums are then added up. Work is quadratic in the different points by definition; memory is two blocks.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(sizes.values())
    if not 2 <= len(sizes) <= n - 1:
        raise InvalidInput("2 to n - 1 clusters are needed")
    names = [f"f{i}" for i in range(len(features))]
    points = df.select(F.col(label).cast("long").alias("label"), *[F.col(c).cast("double").alias(x) for c, x in zip(features, names, strict=True)]).groupBy("label", *names).agg(F.count("*").alias("w"))
    points = checkpointed(points.withColumn("id", F.monotonically_increasing_id()))  # ids that stay
    nb = max(1, -(-points.count() // block))
    rows = points.withColumn("b", F.pmod(F.xxhash64("id", *names), F.lit(nb)).cast("int"))
    sides = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select("*", F.lit(0).alias("side")).unionByName(rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select("id", "label", *names, "w", F.col("o").alias("b"), F.col("b").alias("o"), F.lit(1).alias("side")))

    def sums(t: pa.Table) -> pa.Table:
        x = np.stack([t[c].to_numpy() for c in names], 1)
        side, ids, lab = t["side"].to_numpy(), t["id"].to_numpy(), t["label"].to_numpy()
        p, q = side == 0, side == 1
        out: dict[str, list] = {"id": [], "label": [], "other": [], "d": []}
        kinds, at = np.unique(lab[q], return_inverse=True)
        onehot = np.eye(len(kinds))[at] * t["w"].to_numpy()[q][:, None]
        for i in range(0, int(p.sum()), 1024):
            d = metric.pairs(x[p][i : i + 1024], x[q]) @ onehot
            r, k = np.indices(d.shape)
            out["id"].append(ids[p][i : i + 1024][r.ravel()])
            out["label"].append(lab[p][i : i + 1024][r.ravel()])
            out["other"].append(kinds[k.ravel()])
            out["d"].append(d.ravel())
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.float64 if k == "d" else np.int64) for k, v in out.items()})

    total = sides.groupBy("b", "o").applyInArrow(sums, "id long, label long, other long, d double").groupBy("id", "label", "other").agg(F.sum("d").alias("d"))
    size = df.sparkSession.createDataFrame([(int(k), int(v)) for k, v in sizes.items()], "other long, m long")
    mean = total.join(F.broadcast(size), "other").withColumn("own", F.col("other") == F.col("label"))
    per = mean.groupBy("id", "label").agg(F.max(F.when(F.col("own"), F.col("d") / F.greatest(F.col("m") - 1, F.lit(1)))).alias("a"), F.min(F.when(~F.col("own"), F.col("d") / F.col("m"))).alias("b"), F.max(F.when(F.col("own"), F.col("m"))).alias("m"))
    one = F.when((F.col("m") == 1) | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.join(points.select("id", "w"), "id").agg((F.sum(one * F.col("w")) / F.sum("w")).alias("silhouette"))
