"""Decision trees grown level by level, and isolation forests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.base import Estimator, Predictor, check_counts, finite_checks, map_rows, matrix
from quillmill.errors import InvalidInput, InvalidParameter, TreeError
from quillmill.random import make_rng


@dataclass
class Node:
    """A leaf has no feature; a numeric split sends x <= threshold to children[0], a categorical one to the child of its value."""

    value: float = 0.0
    probabilities: list[float] = field(default_factory=list)
    feature: int | None = None
    threshold: float | None = None
    categories: list[float] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    n: int = 0
    impurity: float = 0.0

    @classmethod
    def leaf(cls, value: float, probabilities: list[float] | None = None) -> Node:
        return cls(value, probabilities or [])

    @classmethod
    def internal(cls, feature: int, threshold: float) -> Node:
        return cls(feature=feature, threshold=threshold)

    @classmethod
    def categorical(cls, feature: int, categories: list[float]) -> Node:
        return cls(feature=feature, categories=list(categories))


class DecisionTree(Predictor):
    """algorithm: cart (Gini or variance), id3 (entropy) or c45 (gain ratio).

    A level of the tree is one job: rows carry their node; per node and feature the counts of each distinct value are summed, and running sums over them score
    every midpoint. Of equal splits the first of a feature's values and the last feature wins (a seed draws among features).
    """

    def __init__(self, algorithm: str = "cart", is_classifier: bool = True, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, random_state: int | None = None, categorical_features: Sequence[int] = ()):
        if algorithm not in ("cart", "id3", "c45") or not is_classifier and algorithm != "cart":
            raise InvalidParameter("algorithm is cart, id3 or c45; only cart regresses")
        if min_samples_split < 2 or min_samples_leaf < 1 or min_samples_leaf > min_samples_split or min_impurity_decrease < 0:
            raise InvalidParameter("a limit is out of range")
        if categorical_features and algorithm == "cart":
            raise InvalidParameter("cart has no categorical splits")
        self.algorithm, self.is_classifier, self.max_depth, self.min_samples_split, self.min_samples_leaf = algorithm, is_classifier, max_depth, min_samples_split, min_samples_leaf
        self.min_impurity_decrease, self.random_state, self.categorical_features, self.features = min_impurity_decrease, random_state, list(categorical_features), None

    def _impurity(self, p: np.ndarray) -> np.ndarray:
        if self.algorithm == "cart":
            return 1 - (p * p).sum(-1)
        return -(p * np.log2(np.maximum(p, 1e-300))).sum(-1)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> DecisionTree:
        cols = list(features)
        r = df.agg(*finite_checks([*cols, label]), F.max(F.col(label).cast("double")).alias("_hi"), F.sum(F.when((F.col(label) < 0) | (F.col(label) != F.floor(label)), 1).otherwise(0)).alias("_odd")).first()
        n = check_counts(r, cols)
        if self.is_classifier and r["_odd"]:
            raise InvalidInput("labels must be whole and not negative")
        self.n_classes = int(r["_hi"]) + 1 if self.is_classifier else 0
        rng = make_rng(self.random_state) if self.random_state is not None else None
        rows = df.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y")).persist(StorageLevel.DISK_ONLY)
        d = len(cols)
        self.nodes, self.features = [Node()], cols
        try:
            level, depth = [0], 0
            self._describe(rows, level, d)
            while level and (self.max_depth is None or depth < self.max_depth):
                open_ = [i for i in level if self.nodes[i].impurity > 1e-10 and self.nodes[i].n >= self.min_samples_split]
                best = self._splits(rows, open_, d, rng) if open_ else {}
                level = []
                for i, (gain, f, threshold, values) in best.items():
                    node = self.nodes[i]
                    if gain <= 0 or node.n / n * gain < self.min_impurity_decrease:
                        continue
                    node.feature, node.threshold, node.categories = f, threshold, values or []
                    for _ in values or (0, 1):
                        node.children.append(len(self.nodes))
                        level.append(len(self.nodes))
                        self.nodes.append(Node())
                if level:
                    self._describe(rows, level, d)
                depth += 1
        finally:
            rows.unpersist()
        return self

    def _at(self, rows: DataFrame, d: int) -> DataFrame:
        """rows with the node that each has come to."""
        return map_rows(rows, [f"f{i}" for i in range(d)], {"node": "int"}, self._walk)

    def _walk(self, x: np.ndarray) -> list[np.ndarray]:
        at = np.zeros(len(x), np.int32)
        moving = np.ones(len(x), bool)
        while True:
            again = False
            for i in np.unique(at[moving]).tolist():
                node, here = self.nodes[i], np.flatnonzero((at == i) & moving)
                if node.feature is None:
                    moving[here] = False
                    continue
                v = x[here, node.feature]
                if node.categories:
                    keys = np.round(np.array(node.categories), 6)
                    spot = np.minimum(np.searchsorted(keys, np.round(v, 6)), len(keys) - 1)
                    known = keys[spot] == np.round(v, 6)
                    at[here[known]] = np.array(node.children, np.int32)[spot[known]]
                    moving[here[~known]] = False  # an unknown value stays with this node's own value
                else:
                    at[here] = np.where(v <= node.threshold, node.children[0], node.children[1])
                again = True
            if not again:
                return [at]

    def _describe(self, rows: DataFrame, level: list[int], d: int) -> None:
        at = self._at(rows, d).where(F.col("node").isin(level))
        if self.is_classifier:
            counts = {i: np.zeros(self.n_classes) for i in level}
            for r in at.groupBy("node", "y").count().collect():  # a row for each node and class
                counts[r["node"]][int(r["y"])] = r["count"]
            for i, c in counts.items():
                node = self.nodes[i]
                node.n, node.probabilities = int(c.sum()), (c / max(1, c.sum())).tolist()
                node.impurity = float(self._impurity(c / max(1, c.sum())))
                node.value = float(self.n_classes - 1 - int(np.argmax(c[::-1])))  # of equal classes the highest
        else:
            for r in at.groupBy("node").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).collect():
                node = self.nodes[r["node"]]
                node.n, node.value, node.impurity = r["n"], r["m"], r["v"]

    def _splits(self, rows: DataFrame, level: list[int], d: int, rng) -> dict[int, tuple]:
        """Best (gain, feature, threshold, categories) of each node; the running sums are windows by (node, feature), so a task holds the distinct values of one."""
        at = self._at(rows, d).where(F.col("node").isin(level))
        stack = ", ".join(f"{i}, f{i}" for i in range(d))
        long = at.selectExpr("node", "y", f"stack({d}, {stack}) as (f, v)")
        if self.is_classifier:
            sums = [F.sum(F.when(F.col("y") == k, 1.0).otherwise(0.0)).alias(f"c{k}") for k in range(self.n_classes)]
            names = [f"c{k}" for k in range(self.n_classes)]
        else:
            sums = [F.count("*").cast("double").alias("c0"), F.sum("y").alias("c1"), F.sum(F.col("y") * F.col("y")).alias("c2")]
            names = ["c0", "c1", "c2"]
        by = long.groupBy("node", "f", F.col("v").alias("v")).agg(*sums)
        best: dict[int, list[tuple]] = {}
        numeric = [f for f in range(d) if f not in self.categorical_features]
        if numeric:
            w = Window.partitionBy("node", "f").orderBy("v")
            run = w.rowsBetween(Window.unboundedPreceding, 0)
            whole = Window.partitionBy("node", "f")
            swept = by.where(F.col("f").isin(numeric)).select("node", "f", "v", F.lead("v").over(w).alias("next"), *[F.sum(c).over(run).alias(f"l_{c}") for c in names], *[F.sum(c).over(whole).alias(f"t_{c}") for c in names]).where("next is not null")
            schema = "node int, f int, gain double, threshold double"

            def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in it:
                    left = matrix(b, [f"l_{c}" for c in names])
                    gain = self._gain(left, matrix(b, [f"t_{c}" for c in names]) - left)
                    mid = (b.column(2).to_numpy() + b.column(3).to_numpy()) / 2
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gain), pa.array(mid)], names=["node", "f", "gain", "threshold"])

            top = swept.mapInArrow(score, schema).where("gain > 0").groupBy("node", "f").agg(F.max(F.struct("gain", (-F.col("threshold")).alias("t"))).alias("m"))
            for r in top.collect():  # a row for each node and feature
                best.setdefault(r["node"], []).append((r["m"]["gain"], r["f"], -r["m"]["t"], None))
        if self.categorical_features:
            cats = by.where(F.col("f").isin(self.categorical_features)).withColumn("v", F.round("v", 6)).groupBy("node", "f").agg(F.collect_list(F.struct("v", *names)).alias("all"))
            for r in cats.collect():  # a categorical feature has few values
                values = sorted(r["all"], key=lambda s: s["v"])
                c = np.array([[s[k] for k in names] for s in values])
                if len(c) < 2 or c.sum(1).min() < self.min_samples_leaf:
                    continue
                total, size = c.sum(0), c.sum(1)
                gain = float(self._impurity(total / total.sum()) - (size / size.sum() * self._impurity(c / size[:, None])).sum())
                if self.algorithm == "c45":
                    gain /= max(float(self._impurity(size / size.sum())), 1e-12)
                best.setdefault(r["node"], []).append((gain, r["f"], None, [s["v"] for s in values]))
        out = {}
        for i, found in best.items():
            most = max(x[0] for x in found)
            tied = sorted((x for x in found if x[0] >= most - 1e-12), key=lambda x: x[1])
            out[i] = tied[int(rng.integers(len(tied)))] if rng is not None else tied[-1]
        return out

    def _gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.is_classifier:
            nl, nr = left.sum(1), right.sum(1)
            n = nl + nr
            gain = self._impurity((left + right) / n[:, None]) - nl / n * self._impurity(left / nl[:, None]) - nr / n * self._impurity(right / nr[:, None])
            if self.algorithm == "c45":
                gain = gain / np.maximum(self._impurity(np.stack([nl / n, nr / n], 1)), 1e-12)
        else:
            nl, nr = left[:, 0], right[:, 0]
            n = nl + nr
            var = lambda s: np.maximum(s[:, 2] / s[:, 0] - (s[:, 1] / s[:, 0]) ** 2, 0)
            gain = var(left + right) - nl / n * var(left) - nr / n * var(right)
        return np.where((nl >= self.min_samples_leaf) & (nr >= self.min_samples_leaf), gain, -1.0)

    @property
    def root(self) -> Node:
        self._check()
        return self.nodes[0]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._check(df)
        value = np.array([x.value for x in self.nodes])
        return map_rows(df, self.features, {out: "double"}, lambda x: [value[self._walk(x)[0]]])

    def predict_proba(self, df: DataFrame, out: str = "probabilities") -> DataFrame:
        self._check(df)
        if not self.is_classifier:
            raise TreeError("a regression tree has no probabilities")
        p = np.array([x.probabilities for x in self.nodes])
        return map_rows(df, self.features, {out: "array<double>"}, lambda x: [list(p[self._walk(x)[0]])])

    def predict_one(self, x: Sequence[float]) -> float:
        self._check()
        return self.nodes[int(self._walk(np.array([x], float))[0][0])].value

    def predict_proba_one(self, x: Sequence[float]) -> list[float]:
        if not self.is_classifier:
            raise TreeError("a regression tree has no probabilities")
        return self.nodes[int(self._walk(np.array([x], float))[0][0])].probabilities

    def generate_tree_structure(self) -> str:
        self._check()
        lines: list[str] = []

        def show(i: int, depth: int, head: str) -> None:
            node = self.nodes[i]
            what = f"value {node.value:g}" if node.feature is None else f"{self.features[node.feature]}" + (f" <= {node.threshold:g}" if node.threshold is not None else "")
            lines.append("  " * depth + head + what + f" (n {node.n})")
            for k, c in enumerate(node.children):
                show(c, depth + 1, f"= {node.categories[k]:g}: " if node.categories else ("yes: ", "no: ")[k])

        show(0, 0, "")
        return "\n".join(lines)


def average_path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n: 0, 1, exact harmonic numbers to 50, the asymptote after."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    h = float((1 / np.arange(1, int(n))).sum()) if n <= 50 else float(np.log(n - 1) + 0.5772156649015329)
    return 2 * h - 2 * (n - 1) / n


class IsolationForest(Estimator):
    """Trees of random cuts, each on its own sample (rows of least seeded hash); contamination: "auto" (offset -0.5) or a share up to 0.5."""

    def __init__(self, n_estimators: int = 100, max_samples: int = 256, max_depth: int | None = None, random_state: int | None = None, contamination: str | float = "auto"):
        if n_estimators < 1 or max_samples < 1 or max_depth is not None and max_depth < 1 or contamination != "auto" and not 0 < contamination <= 0.5:
            raise InvalidParameter("a parameter is out of range")
        self.n_estimators, self.max_samples, self.max_depth, self.random_state, self.contamination, self.features = n_estimators, max_samples, max_depth, random_state, contamination, None

    def fit(self, df: DataFrame, features: Sequence[str]) -> IsolationForest:
        cols = list(features)
        n = check_counts(df.agg(*finite_checks(cols)).first(), cols)
        psi = min(self.max_samples, n)
        depth = self.max_depth or max(1, int(np.ceil(np.log2(max(2, psi)))))
        base = int(make_rng(self.random_state).integers(1 << 31)) if self.random_state is None else self.random_state
        # one pass: a row joins a tree's pool with probability 4 psi / n, its tree keeps the psi of least hash
        share = min(1.0, 4.0 * psi / n)
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).withColumn("_row", F.monotonically_increasing_id())
        trees = F.filter(F.transform(F.sequence(F.lit(0), F.lit(self.n_estimators - 1)), lambda t: F.struct(t.alias("t"), F.xxhash64(F.col("_row"), *cols, t, F.lit(base)).alias("h"))), lambda s: F.lit(share >= 1) | (F.pmod(s["h"], F.lit(1 << 40)).cast("double") < share * float(1 << 40)))
        pool = rows.select(*cols, F.inline(trees))

        def grow(t: pa.Table) -> pa.Table:
            x, h = np.stack([t[c].to_numpy() for c in cols], 1), t["h"].to_numpy()
            x = x[np.argsort(h, kind="stable")[:psi]]
            tree = t["t"][0].as_py()
            flat = _isolation_tree(x, depth, np.random.default_rng([base, tree]))
            return pa.table({"t": pa.array([tree], pa.int32()), "nodes": pa.array([flat.tobytes()], pa.binary())})

        got = sorted(pool.groupBy("t").applyInArrow(grow, "t int, nodes binary").collect(), key=lambda r: r["t"])
        self.trees = [np.frombuffer(bytes(r["nodes"])).reshape(-1, 5).copy() for r in got]
        self.psi, self.features = psi, cols
        self.offset = -0.5 if self.contamination == "auto" else float(self.score_samples(df, "_s").agg(F.percentile("_s", float(self.contamination))).first()[0])
        return self

    def _score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at, depth, going = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
            while going.any():
                f = tree[at, 0].astype(np.int64)
                going = f >= 0
                i = np.flatnonzero(going)
                less = x[i, f[i]] < tree[at[i], 1]
                at[i] = np.where(less, tree[at[i], 2], tree[at[i], 3]).astype(np.int64)
                depth[i] += 1
            total += depth + np.array([average_path_length(v) for v in tree[:, 4]])[at]
        return -(2.0 ** (-total / len(self.trees) / max(average_path_length(self.psi), 1e-12)))

    def score_samples(self, df: DataFrame, out: str = "score") -> DataFrame:
        """-2 ** (-depth / c): lower is stranger."""
        self._check(df)
        return map_rows(df, self.features, {out: "double"}, lambda x: [self._score(x)])

    def score_sample(self, x: Sequence[float]) -> float:
        self._check()
        return float(self._score(np.array([x], float))[0])

    def decision_function(self, df: DataFrame, out: str = "decision") -> DataFrame:
        return self.score_samples(df, out).withColumn(out, F.col(out) - F.lit(self.offset))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.decision_function(df, "_d").withColumn(out, F.when(F.col("_d") < 0, -1).otherwise(1)).drop("_d")

    def fit_predict(self, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
        return self.fit(df, features).predict(df, out)


def _isolation_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Rows (feature or -1, threshold, left, right, size)."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, left: int) -> int:
        i = len(nodes)
        nodes.append([-1, 0, 0, 0, len(rows)])
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        wide = np.flatnonzero(high > low)
        if left == 0 or len(rows) <= 1 or not len(wide):
            return i
        f = int(rng.choice(wide))
        cut = rng.uniform(low[f], high[f])
        less = rows[:, f] < cut
        nodes[i][:2] = [f, cut]
        nodes[i][2] = grow(rows[less], left - 1)
        nodes[i][3] = grow(rows[~less], left - 1)
        return i

    grow(x, depth)
    return np.array(nodes, float)
