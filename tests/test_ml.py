"""Estimators, scalers and metrics against numpy and known values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.errors import EmptyInput, InvalidInput, InvalidParameter, NonFinite, NotFitted
from quillmill.functions import distance as D
from quillmill.functions import linalg, reduction
from quillmill.functions.kernels import Kernel
from quillmill.operators import metrics as M
from quillmill.operators import preprocessing as P
from quillmill.operators.clustering import DBSCAN, KMeans, MeanShift, estimate_bandwidth
from quillmill.operators.decomposition import PCA, TSNE, KernelPCA
from quillmill.operators.discriminant import LDA
from quillmill.operators.linear import LinearRegression, LinearSVC, LogisticRegression, Penalty, generate_polynomial_features
from quillmill.operators.neighbors import KNN, knn_join
from quillmill.operators.svm import SVC
from quillmill.operators.trees import DecisionTree, IsolationForest, average_path_length

R = np.random.default_rng(3)


def frame(spark, x, **more):
    x = np.asarray(x, float)
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), *(v[i] for v in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["row_id", *cols, *more]), cols


def got(df, *cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("row_id").collect()], float)


def blobs(n=15):
    c = np.array([[0, 0], [10, 0], [5, 10]])
    return np.concatenate([c[i] + R.uniform(-0.05, 0.05, (n // 3, 2)) for i in range(3)])


def test_scalers(spark):
    x = R.normal(3, 2, (40, 3))
    df, cols = frame(spark, x)
    s = P.StandardScaler().fit(df.where("row_id < 15"), cols).partial_fit(df.where("row_id >= 15"), cols)
    z = s.transform(df)
    assert got(z, *cols) == pytest.approx((x - x.mean(0)) / x.std(0)) and got(s.inverse_transform(z), *cols) == pytest.approx(x)
    m = P.MinMaxScaler((-1, 1), clip=True).fit(df.where("row_id < 30"), cols)
    assert got(m.transform(df), *cols).min() == -1 and got(m.partial_fit(df, cols).transform(df), *cols).max() == pytest.approx(1)
    assert got(P.MaxAbsScaler().fit_transform(df, cols), *cols) == pytest.approx(x / np.abs(x).max(0))
    small, c3 = frame(spark, [[1, -2, 2], [-2, 1, 3], [4, 1, -2]])
    assert got(P.RobustScaler().fit_transform(small, c3), *c3) == pytest.approx(np.array([[0, -2, 0], [-1, 0, 0.4], [1, 0, -1.6]]))
    one, c2 = frame(spark, [[3, 4], [0, 0]])
    assert got(P.Normalizer().fit_transform(one, c2), *c2) == pytest.approx(np.array([[0.6, 0.8], [0, 0]]))
    with pytest.raises(NotFitted):
        P.StandardScaler().transform(df)
    with pytest.raises(EmptyInput):
        P.StandardScaler().fit(df.limit(0), cols)
    with pytest.raises(NonFinite):
        P.MinMaxScaler().fit(df.withColumn("f0", F.lit(float("nan"))), cols)
    with pytest.raises(InvalidParameter):
        P.RobustScaler(quantile_range=(80, 20))


def test_one_shot(spark):
    x = R.normal(size=(6, 4))
    df, cols = frame(spark, x)
    assert got(P.standardize(df, cols, "column"), *cols) == pytest.approx((x - x.mean(0)) / x.std(0))
    assert got(P.standardize(df, cols, "row"), *cols) == pytest.approx((x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True))
    assert got(P.standardize(df, cols, "global"), *cols) == pytest.approx((x - x.mean()) / x.std())
    for order, p in (("l1", 1), ("l2", 2), ("max", np.inf), (3.0, 3)):
        assert got(P.normalize(df, cols, "row", order), *cols) == pytest.approx(x / np.linalg.norm(x, p, axis=1, keepdims=True))
        assert got(P.normalize(df, cols, "column", order), *cols) == pytest.approx(x / np.linalg.norm(x, p, axis=0))
        assert got(P.normalize(df, cols, "global", order), *cols) == pytest.approx(x / np.linalg.norm(x.ravel(), p))


def test_splits_and_labels(spark):
    df = spark.range(101).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("y"))
    a, b = P.train_test_split(df, "row_id", 0.3, 7)
    assert (a.count(), b.count()) == (71, 30) and a.join(b, "row_id").count() == 0
    a, b = P.train_test_split_stratified(df, "row_id", "y", 0.25, 7)
    assert sorted(r["count"] for r in b.groupBy("y").count().collect()) == [8, 9, 9] and a.count() + b.count() == 101
    labels = spark.createDataFrame([(i, v) for i, v in enumerate("bacab")], "row_id long, y string")
    hot, mapping = P.to_categorical_with_mapping(labels, "y", "row_id")
    assert mapping == {"b": 0, "a": 1, "c": 2} and hot.orderBy("row_id").first()["categorical"] == [1, 0, 0]
    back = P.to_sparse_categorical(P.to_categorical(df, "y"), "categorical")
    assert back.where("label != y").count() == 0
    with pytest.raises(EmptyInput):
        P.train_test_split(df.limit(1), "row_id")


def test_regression_metrics(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "t double, p double")
    v = lambda f: M.scalar(f(df, "t", "p"))
    assert v(M.mean_squared_error) == pytest.approx(0.375) and v(M.mean_absolute_error) == pytest.approx(0.5) and v(M.root_mean_squared_error) == pytest.approx(0.375**0.5)
    assert v(M.r2_score) == pytest.approx(0.9486081370) and v(M.explained_variance_score) == pytest.approx(0.957173447) and v(M.median_absolute_error) == pytest.approx(0.5)
    assert v(M.mean_absolute_percentage_error) == pytest.approx(0.3273809523)


def test_classification_metrics(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.6), (True, 0.4), (False, 0.1)], "y boolean, s double")
    c = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_curve(df, "y", "s").collect())[::-1]
    assert [x[1] for x in c] == [0, 0, 0.5, 0.5, 1] and [x[2] for x in c] == [0, 0.5, 0.5, 1, 1]
    assert M.scalar(M.roc_auc(df, "y", "s")) == pytest.approx(0.75) and M.scalar(M.average_precision(df, "y", "s")) == pytest.approx(0.5 + 0.5 * 2 / 3)
    pr = sorted(M.precision_recall_curve(df, "y", "s").collect(), key=lambda r: (r["threshold"] is None, r["threshold"]))
    assert [r["recall"] for r in pr] == [1, 1, 0.5, 0.5, 0]
    n = 500
    y, s = R.integers(0, 2, n), np.round(R.normal(size=n), 1)
    big = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s)], "y boolean, s double")
    wins = sum((s[y == 1][:, None] > s[y == 0]).sum(1) + 0.5 * (s[y == 1][:, None] == s[y == 0]).sum(1))
    assert M.scalar(M.roc_auc(big, "y", "s")) == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()))
    b = spark.createDataFrame([(1.0, 1.0)] * 3 + [(0.0, 1.0)] + [(0.0, 0.0)] * 2 + [(1.0, 0.0)] * 2, "t double, p double")
    m = M.ConfusionMatrix(b, "t", "p")
    assert m.get_counts() == (3, 1, 2, 2) and m.accuracy() == pytest.approx(5 / 8) and "precision" in m.summary() and m.f1_score() == pytest.approx(2 / 3)
    k = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 1), (0, 0)], "t int, p int")
    c = M.MulticlassConfusionMatrix(k, "t", "p")
    assert c.accuracy() == pytest.approx(0.6) and c.f1("macro") == pytest.approx(0.5) and c.precision("micro") == pytest.approx(0.6) and "macro" in c.summary()
    per = {r["label"]: r["f1"] for r in M.per_class_report(k, "t", "p").collect()}
    assert [per[i] for i in range(3)] == pytest.approx(list(c.per_class_f1()))
    assert M.scalar(M.cohen_kappa(k, "t", "p")) == pytest.approx((0.6 - 9 / 25) / (1 - 9 / 25))
    prob = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0, 3.0])], "y int, p array<double>")
    assert M.scalar(M.log_loss(prob, "y", "p")) == pytest.approx(-(np.log(0.5) + np.log(0.75)) / 2) and M.scalar(M.top_k_accuracy(prob, "y", "p", 1)) == 1


def test_cluster_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [0, 0, 1, 2, 1, 2])), "a long, b long")
    assert M.scalar(M.adjusted_rand_index(df, "a", "b")) == pytest.approx(1 / 6) and M.scalar(M.adjusted_rand_index(df, "a", "a")) == 1
    assert M.adjusted_mutual_info(df, "a", "a") == pytest.approx(1) and M.scalar(M.normalized_mutual_info(df, "a", "a")) == pytest.approx(1)
    assert 0 < M.scalar(M.v_measure_score(df, "a", "b")) < 1 and M.scalar(M.fowlkes_mallows_score(df, "a", "a")) == 1
    x = blobs(30)
    f, cols = frame(spark, x, y=[i // 10 for i in range(30)])
    assert M.scalar(M.silhouette_score(f, cols, "y", block=7)) > 0.98 and M.davies_bouldin_score(f, cols, "y") < 0.1 and M.scalar(M.calinski_harabasz_score(f, cols, "y")) > 1000


def test_linear_models(spark):
    x = np.array([[1, 2], [2, 1], [3, 4], [4, 3], [5, 5]], float)
    y = x @ [1.5, -0.5] + 2 + R.normal(0, 0.1, 5)
    df, cols = frame(spark, x, y=[float(v) for v in y])
    m = LinearRegression().fit(df, cols, "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(5)], y, rcond=None)[0]
    assert [*m.coefficients, m.intercept] == pytest.approx(list(want)) and m.score(df, "y") > 0.99
    ridge = LinearRegression(penalty=Penalty("l2", 0.1)).fit(df, cols, "y")
    xc = x - x.mean(0)
    assert ridge.coefficients == pytest.approx(np.linalg.solve(xc.T @ xc + 0.5 * np.eye(2), xc.T @ (y - y.mean())))
    g = LinearRegression(solver="gradient", learning_rate=0.05, max_iter=60, tol=1e-9).fit(df, cols, "y")
    assert g.n_iter == 60 and g.score(df, "y") > 0.5
    x = R.normal(size=(80, 2))
    df, cols = frame(spark, x, y=[float(v) for v in (x[:, 0] - x[:, 1] > 0)])
    lr = LogisticRegression(learning_rate=0.5, max_iter=40).fit(df, cols, "y")
    assert M.scalar(M.accuracy(lr.predict(df), "y", "prediction")) > 0.9
    svc = LinearSVC(max_iter=15, learning_rate=0.1, penalty=Penalty("l2", 0.01), random_state=1).fit(df, cols, "y")
    assert M.scalar(M.accuracy(svc.predict(df), "y", "prediction")) > 0.9
    poly = generate_polynomial_features(df, cols, 3)
    assert len([c for c in poly.columns if c.startswith("poly")]) == 9
    with pytest.raises(InvalidInput):
        LogisticRegression().fit(df.withColumn("y", F.lit(2.0)), cols, "y")


def test_neighbours(spark):
    x, q = R.normal(size=(60, 3)), R.normal(size=(9, 3))
    df, cols = frame(spark, x, y=[str(int(v > 0)) for v in x[:, 0]])
    qf, _ = frame(spark, q)
    pairs = knn_join(qf, "row_id", df, "row_id", cols, 4, block_rows=13).collect()
    d = D.Metric().pairs(q, x)
    want = {(i, int(j)) for i in range(9) for j in np.argsort(d[i])[:4]}
    assert {(r["query_id"], r["stored_id"]) for r in pairs} == want
    knn = KNN(3).fit(df, cols, "y")
    ours = [r["prediction"] for r in knn.predict(qf).orderBy("row_id").collect()]
    vote = [max("01", key=lambda v: sum(str(int(x[j, 0] > 0)) == v for j in np.argsort(d[i])[:3])) for i in range(9)]
    assert ours == vote


def test_svm_and_lda(spark):
    t = np.linspace(0, 2 * np.pi, 24, endpoint=False)
    x = np.concatenate([np.c_[np.cos(t), np.sin(t)] * 0.5, np.c_[np.cos(t), np.sin(t)] * 3])
    df, cols = frame(spark, x, y=[0.0] * 24 + [1.0] * 24)
    m = SVC(Kernel("rbf", 0.5)).fit(df, cols, "y")
    assert M.scalar(M.accuracy(m.predict(df), "y", "prediction")) == 1
    b = blobs(30)
    f, cols = frame(spark, b, y=[i // 10 for i in range(30)])
    for solver in ("svd", "eigen", "lsqr"):
        lda = LDA(solver=solver, shrinkage="auto" if solver == "svd" else None).fit(f, cols, "y")
        assert lda.predict(f).where("prediction != y").count() == 0
    assert len([c for c in lda.transform(f).columns if c.startswith("ld")]) == 2
    assert sum(lda.predict_proba(f).first()["probabilities"]) == pytest.approx(1)


def test_clustering(spark):
    f, cols = frame(spark, blobs())
    km = KMeans(3, n_init=3, random_state=1).fit(f, cols)
    lab = got(km.predict(f), "cluster")[:, 0]
    assert all(len(set(lab[i : i + 5])) == 1 for i in (0, 5, 10)) and len(set(lab)) == 3 and km.inertia < 0.2
    x = [[0, 0], [0.1, 0], [0, 0.1], [0.1, 0.1], [10, 10], [10.1, 10], [10, 10.1], [10.1, 10.1], [5, 5]]
    f, cols = frame(spark, x)
    db = DBSCAN(0.5, 3)
    assert got(db.fit_predict(f, cols), "cluster")[:, 0].tolist() == [0] * 4 + [1] * 4 + [-1]
    assert got(db.predict(f), "cluster")[:, 0].tolist() == [0] * 4 + [1] * 4 + [-1]
    y = np.concatenate([R.normal(0, 0.1, (5, 2)), R.normal(20, 0.1, (5, 2))])
    f, cols = frame(spark, y)
    for seeding in (False, True):
        ms = MeanShift(2.0, bin_seeding=seeding).fit(f, cols)
        assert len(ms.cluster_centers) == 2 and len(set(got(ms.predict(f), "cluster")[:5, 0])) == 1
    assert estimate_bandwidth(f, cols, 0.3) > 0


def test_decomposition(spark):
    x = R.normal(size=(40, 4)) @ np.diag([3, 2, 1, 0.1])
    df, cols = frame(spark, x)
    for solver in ("full", "randomized", "power"):
        p = PCA(2, solver).fit(df, cols)
        assert p.singular_values == pytest.approx(np.linalg.svd(x - x.mean(0))[1][:2], rel=1e-4)
    z = p.transform(df)
    assert np.abs(got(p.inverse_transform(z.drop(*cols)), *cols) - x).mean() < 0.8
    k = KernelPCA(Kernel("linear"), 2).fit(df, cols)
    assert k.eigenvalues == pytest.approx(p.singular_values**2, rel=1e-3)
    lan = KernelPCA(Kernel("rbf", 0.1), 2, "lanczos").fit(df, cols)
    dense = KernelPCA(Kernel("rbf", 0.1), 2).fit(df, cols)
    assert lan.eigenvalues == pytest.approx(dense.eigenvalues, rel=1e-6) and len(dense.transform(df).first()["kpca"]) == 2
    six, cols = frame(spark, [[0, 0], [0, 1], [1, 0], [9, 9], [9, 8], [8, 9]])
    y = np.array([r["embedding"] for r in TSNE(2, 2, n_iter=60, random_state=0, learning_rate=10).fit_transform(six, cols).orderBy("row_id").collect()])
    assert y.shape == (6, 2) and np.abs(y.mean(0)).max() < 1e-9


def test_trees_and_isolation(spark):
    x = R.integers(0, 5, (60, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] > 1)).astype(float)
    df, cols = frame(spark, x, y=[float(v) for v in y])
    for algo in ("cart", "id3", "c45"):
        t = DecisionTree(algo).fit(df, cols, "y")
        assert t.predict(df).where("prediction != y").count() == 0
    assert "<=" in t.generate_tree_structure() and t.predict_one([4, 4, 0]) == 1 and sum(t.predict_proba_one([0, 0, 0])) == 1
    c = DecisionTree("id3", categorical_features=[0]).fit(df, cols, "y")
    assert c.predict(df).where("prediction != y").count() == 0
    r = DecisionTree("cart", is_classifier=False, max_depth=3).fit(df.withColumn("y", F.col("f0") * 2), cols, "y")
    assert M.scalar(M.mean_squared_error(r.predict(df.withColumn("y", F.col("f0") * 2)), "y", "prediction")) < 0.5
    pts = np.concatenate([R.normal(0, 0.1, (9, 2)), [[10, 10]]])
    f, cols = frame(spark, pts)
    iso = IsolationForest(30, 10, random_state=1, contamination=0.1).fit(f, cols)
    assert got(iso.predict(f), "prediction")[:, 0].tolist() == [1] * 9 + [-1]
    assert average_path_length(2) == 1 and average_path_length(256) == pytest.approx(10.24, abs=0.1)


def test_functions_and_saving(spark, tmp_path):
    a = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<double>, b array<double>")
    v = a.select(D.distance(F.col("a"), F.col("b")), D.manhattan(F.col("a"), F.col("b")), D.minkowski(F.col("a"), F.col("b"), 3), D.within(F.col("a"), F.col("b"), 5.0)).first()
    assert v[0] == 5 and v[1] == 7 and v[2] == pytest.approx((27 + 64) ** (1 / 3)) and v[3]
    assert reduction.det_reduce_range(spark, 1000, np.sum, lambda x, y: x + y, 0.0, 128) == 499500
    s = R.normal(size=(12, 12))
    s = s @ s.T
    w = np.linalg.eigvalsh(s)[::-1]
    assert linalg.top_eigenpairs_power_iteration(s, 2, 1, 5000, 1e-12)[0] == pytest.approx(w[:2], rel=1e-4) and linalg.top_eigenpairs_lanczos(s, 3)[0] == pytest.approx(w[:3])
    assert linalg.lsqr_solve(s, np.ones(12)) == pytest.approx(np.linalg.solve(s, np.ones(12)), rel=1e-3)
    df, cols = frame(spark, R.normal(size=(20, 2)), y=[float(i % 2) for i in range(20)])
    for m in (P.StandardScaler().fit(df, cols), LinearRegression().fit(df, cols, "y"), PCA(1).fit(df, cols), DecisionTree(max_depth=2).fit(df, cols, "y"), KMeans(2, n_init=1, random_state=0).fit(df, cols), SVC(Kernel("linear")).fit(df, cols, "y")):
        path = str(tmp_path / type(m).__name__)
        m.save(spark, path)
        again = type(m).load(spark, path)
        use = (lambda x: x.transform(df)) if hasattr(m, "transform") else (lambda x: x.predict(df))
        assert sorted(map(str, use(again).collect())) == sorted(map(str, use(m).collect()))


def test_network_on_a_frame(spark, tmp_path):
    from quillmill import nn

    x = R.normal(size=(30, 3)).astype(np.float32)
    y = (x @ [[1], [2], [-1]]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in a], float(b[0])) for i, (a, b) in enumerate(zip(x, y))], "row_id long, x array<float>, y float")
    make = lambda: nn.Sequential().add(nn.Dense(3, 4, "tanh", random_state=1)).add(nn.Dense(4, 1, random_state=2)).compile(nn.Adam(0.05), nn.MeanSquaredError())
    a, b = make(), make()
    assert a.fit(x, y, 3).loss == pytest.approx(b.fit_frame(df, "x", "y", 3, (3,)).loss, rel=1e-4)
    out = np.array([r["prediction"] for r in b.predict_frame(df, "x", (3,)).orderBy("row_id").collect()])
    assert out == pytest.approx(b.predict(x), rel=1e-4)
    b.save(spark, str(tmp_path / "w"))
    assert make().load(spark, str(tmp_path / "w")).predict(x) == pytest.approx(b.predict(x))


def test_kernel_between_all_rows_in_blocks(spark):
    from quillmill.functions.kernels import Kernel

    x = np.random.default_rng(3).normal(size=(53, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    got = {(r["a"], r["b"]): r["k"] for r in Kernel("rbf", 0.1).between(df, "id", ["x", "y"], block_rows=10).collect()}
    want = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(got) == 53 * 53 and all(abs(got[i, j] - want[i, j]) < 1e-12 for i in range(53) for j in range(53))


def test_frame_training_draws_new_masks_and_learns_in_batches(spark):
    from quillmill import nn

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)).astype(np.float32)
    y = (x @ np.array([1.0, -2.0, 0.5], np.float32)).reshape(-1, 1)
    df = spark.createDataFrame([(v.tolist(), w.tolist(), "b") for v, w in zip(x, y)], "x array<float>, y array<float>, _batch string").repartition(3)

    def network(rate, seed=1):
        return nn.Sequential(seed=3).add(nn.Dense(3, 8, random_state=seed)).add(nn.Dropout(rate, random_state=2)).add(nn.Dense(8, 1, random_state=5))

    still = [network(0.5).compile(nn.SGD(1e-12), nn.MeanSquaredError()).fit_frame(df, "x", "y", 4, (3,)).loss for _ in range(2)]
    assert len({round(v, 6) for v in still[0]}) == 4  # a mask of its own each epoch
    plain = network(0.0).compile(nn.SGD(1e-12), nn.MeanSquaredError()).fit(x, y, 1).loss[0]
    assert np.mean(still[0]) > plain * 0.8
    m = network(0.0).compile(nn.Adam(0.02), nn.MeanSquaredError())
    loss = m.fit_frame(df, "x", "y", 4, (3,), batch_size=64).loss
    assert len(loss) == 4 and loss[-1] < 0.2 * loss[0]
    assert m.evaluate(x, y) < loss[0] * 0.2
    with pytest.raises(InvalidParameter):
        m.fit_frame(df, "x", "y", 1, (3,), batch_size=0)


def test_ranks_come_from_ranges(spark):
    from quillmill.plans.components import numbered

    values = [int(v) for v in np.random.default_rng(8).choice(10_000, 500, replace=False)]
    df = spark.createDataFrame([(v, f"x{v}") for v in values], "root long, name string")
    got = sorted((r["cluster"], r["root"], r["name"]) for r in numbered(df, "root", "cluster").collect())
    assert got == [(i, v, f"x{v}") for i, v in enumerate(sorted(values))]
    assert numbered(df.limit(0), "root", "cluster").count() == 0


def test_nearest_takes_ties_by_place_and_skips_far_parts():
    """Against all distances in order of columns: equal ones come out equal, whatever the sizes; only some parts are met."""
    from quillmill.operators.neighbors import Boxes, nearest

    rng = np.random.default_rng(3)
    for n, columns, m in ((5000, 2, 300), (50, 2, 20), (3000, 20, 40), (4000, 3, 200)):
        x = np.round(rng.normal(size=(n, columns)) * 3, 2 if columns < 20 else 0) / 1000 + 7
        x = x[rng.integers(0, n // 3, n)]  # copies
        q = np.concatenate([np.round(rng.normal(size=(m, columns)) * 3, 2) / 1000 + 7, x[:10]])
        d = np.zeros((len(q), n))
        for j in range(columns):
            d += (q[:, j, None] - x[None, :, j]) ** 2
        d = np.sqrt(d)
        got_d, got_i = nearest(q, x, 5, D.Metric())
        want = np.argsort(d, 1, kind="stable")[:, :5]
        assert (got_i == want).all() and (got_d == np.take_along_axis(d, want, 1)).all()
    boxes = Boxes(rng.normal(size=(20000, 2)))
    assert len(boxes.near(boxes.x[:1], 5, D.Metric())) < 1000


def test_equal_points_count_each_in_silhouette(spark):
    """Against all pairs; blocks hold points, and equal ones are one."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 4, (90, 2)).astype(float), rng.integers(0, 3, 90)
    f, cols = frame(spark, x, y=[int(v) for v in y])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    a = np.array([d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1) for i in range(90)])
    b = np.array([min(d[i, y == k].mean() for k in range(3) if k != y[i]) for i in range(90)])
    want = np.mean(np.where(np.maximum(a, b) == 0, 0, (b - a) / np.maximum(a, b)))
    assert M.scalar(M.silhouette_score(f, cols, "y", block=7)) == pytest.approx(want, abs=1e-12)
    from pyspark.sql import functions as F

    many = f.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50))))
    plan = M.silhouette_score(many, cols, "y", block=16)
    assert M.scalar(plan) == pytest.approx(M.scalar(M.silhouette_score(many, cols, "y", block=5000)), abs=1e-12)


def test_dbscan_joins_different_points_only(spark, monkeypatch):
    """Copies weigh as much as they are, but aren't paired with each other."""
    from quillmill.operators import clustering

    x = [[0.0], [0.4], [0.8], [5.0], [9.0]]
    rows = [(i, *x[i % 5]) for i in range(200)]
    df = spark.createDataFrame([*rows, (200, 20.0)], "row_id long, x double")
    sizes = []
    join = clustering.radius_join
    monkeypatch.setattr(clustering, "radius_join", lambda *a, **k: (lambda out: (sizes.append(out.count()), out)[1])(join(*a, **k)))
    got = {r["row_id"]: r["cluster"] for r in clustering.DBSCAN(0.5, 40).fit_predict(df, ["x"]).collect()}
    assert sizes == [10]  # 6 points with themselves, 2 pairs in both orders
    assert got == {i: -1 if i == 200 else (0, 0, 0, 1, 2)[i % 5] for i in range(201)}


def test_components_of_a_long_chain_are_found_at_once(spark):
    from quillmill.plans.components import connected_components

    ids = np.random.default_rng(4).permutation(3000)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids[:-1], ids[1:])] + [(5000, 5001), (7000, 7000)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, keep_loops=True).collect()}
    assert got == {**{i: 0 for i in range(3000)}, 5000: 5000, 5001: 5000, 7000: 7000}
    assert 7000 not in {r["node"] for r in connected_components(edges).collect()}


def test_kernel_pca_of_more_rows_than_a_matrix_may_have(spark):
    """Copies weigh, and products in tasks give the pairs of the dense matrix over all rows."""
    x = np.repeat(np.random.default_rng(6).normal(size=(60, 2)), 3, axis=0)[:170]
    df, cols = frame(spark, x)
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    centred = k - k.mean(0)[None] - k.mean(1)[:, None] + k.mean()
    w, v = np.linalg.eigh(centred)
    for most in (2000, 10):
        m = KernelPCA(Kernel("rbf", 0.5), 2).fit(df, cols, max_rows=most)
        assert m.eigenvalues == pytest.approx(w[::-1][:2], rel=1e-8)
        z = np.array([r["kpca"] for r in m.transform(df).orderBy("row_id").collect()])
        assert np.abs(np.abs(z) - np.abs(v[:, ::-1][:, :2] * np.sqrt(w[::-1][:2]))).max() < 1e-6


def test_svc_of_more_rows_than_a_matrix_may_have(spark):
    """Decisions of points with weights are those of all rows, with the matrix or with rows of it."""
    from quillmill.operators.svm import smo

    rng = np.random.default_rng(7)
    x = np.repeat(np.round(rng.normal(size=(60, 2)), 1), 3, axis=0)
    y = (x[:, 0] + 0.3 * rng.normal(size=180) > 0).astype(float)
    df, cols = frame(spark, x, y=[float(v) for v in y])
    k = Kernel("rbf", 0.5).matrix(x, x)
    alpha, b, _ = smo(k, np.where(y > 0, 1.0, -1.0), 1.0, 1e-6, 1000, rng)
    want = k @ (alpha * np.where(y > 0, 1.0, -1.0)) + b
    for most in (2000, 10):
        m = SVC(Kernel("rbf", 0.5), tol=1e-6).fit(df, cols, "y", max_rows=most)
        assert got(m.decision_function(df), "decision")[:, 0] == pytest.approx(want, abs=1e-3)


def test_tsne_of_more_rows_than_a_matrix_may_have(spark):
    """Neighbours and repulsion from tasks move the rows as the dense matrices do."""
    x = np.random.default_rng(9).normal(size=(70, 3))
    df, cols = frame(spark, x)
    one, two = (
        np.array([r["embedding"] for r in TSNE(2, 5, n_iter=8, random_state=1, learning_rate=20).fit_transform(df, cols, max_rows=most).orderBy("row_id").collect()]) for most in (2000, 10)
    )
    assert np.abs(one - two).max() < 1e-6 * np.abs(one).max()


def test_tsne_query_takes_all_steps(spark, monkeypatch):
    """As many as the class and the original do by default; 30 were not even the early part of 250."""
    from quillmill.operators import decomposition
    from quillmill.plans import queries

    steps = []
    monkeypatch.setattr(queries, "_points", lambda s, d: s.createDataFrame([(i, i / 10, float(i % 7)) for i in range(20)], "row_id long, x double, y double"))
    monkeypatch.setattr(decomposition.TSNE, "embed", lambda self, x, session=None: (steps.append(self.n_iter), np.zeros((len(x), 2)))[1])
    assert queries.tsne(spark, "").count() == 20 and steps == [1000]


def test_tsne_repulsion_by_grid_is_that_of_all_pairs():
    from quillmill.operators.decomposition import repulsion_by_grid

    rng = np.random.default_rng(3)
    for dims in (1, 2):
        for scale in (1e-4, 0.1, 2, 20):
            y = rng.normal(0, scale, (300, dims)) * np.array([1, 3])[:dims]
            d = y[:, None] - y[None]
            w = 1 / (1 + (d * d).sum(2))
            np.fill_diagonal(w, 0)
            want = ((w * w)[..., None] * d).sum(1)
            push, total = repulsion_by_grid(y, {})
            assert np.abs(push - want).max() < 1e-3 * np.abs(want).max() and total == pytest.approx(w.sum(), rel=1e-4)
    assert repulsion_by_grid(rng.normal(size=(9, 3)), {}) is None and repulsion_by_grid(np.zeros((9, 2)), {}) is None


def test_kernel_pca_holds_small_blocks_of_the_kernel(spark, monkeypatch):
    """In the fit's products and in transform: a batch of rows by all points was held at once."""
    from quillmill.operators import decomposition

    x = np.random.default_rng(8).normal(size=(3000, 2))
    sizes = []
    matrix = Kernel.matrix
    monkeypatch.setattr(Kernel, "matrix", lambda self, a, b: (sizes.append(len(a) * len(b)), matrix(self, a, b))[1])
    monkeypatch.setattr(decomposition, "by_rows", lambda s, n, body, columns: np.concatenate([body(np.arange(i, min(i + 256, n))) for i in range(0, n, 256)]))
    monkeypatch.setattr(decomposition, "map_rows", lambda df, names, kinds, body: body(x))
    df, cols = frame(spark, x)
    m = KernelPCA(Kernel("rbf", 0.5), 2).fit(df, cols)
    z = np.array(m.transform(df)[0])
    assert max(sizes) <= 256 * 2048
    k = matrix(m.kernel, x, x)
    centred = k - k.mean(0)[None] - k.mean(1)[:, None] + k.mean()
    assert np.abs(np.linalg.norm(z, axis=0) ** 2 - m.eigenvalues).max() < 1e-6 * m.eigenvalues[0]
    assert np.abs(centred @ z - z * m.eigenvalues).max() < 1e-6 * m.eigenvalues[0]


def test_dbscan_of_dense_rows_on_a_line_joins_no_pairs(spark, monkeypatch):
    """The labels are those of the pairs, with cores, borders between clusters, noise, and ranges of several tasks."""
    from quillmill.operators import clustering

    rng = np.random.default_rng(11)
    x = np.round(np.concatenate([rng.normal(0, 1, 150), rng.uniform(5, 40, 150), [100.0, 100.5, 101.0]]), 1)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(rng.permutation(len(x)), x)], "row_id long, x double")
    for least in (1, 3, 9):
        want = {r["id"]: (r["cluster"], r["core"]) for r in clustering.DBSCAN(0.5, least).fit(df, ["x"]).labels.collect()}
        with monkeypatch.context() as m:
            m.setattr(clustering, "MOST_PAIRS", 0, raising=False)
            m.setattr(clustering, "LINE_ROWS", 20, raising=False)
            m.setattr(clustering, "radius_join", lambda *a: pytest.fail("pairs are joined"))
            got = {r["id"]: (r["cluster"], r["core"]) for r in clustering.DBSCAN(0.5, least).fit(df, ["x"]).labels.collect()}
        assert got == want and len(got) == len(x)
