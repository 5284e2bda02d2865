"""Registered queries of the library's own operators over the driver's tables, with DuckDB SQL where SQL can express them.

Numbers are rounded in both, as sums come in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import distance as D
from quillmill.functions.kernels import Kernel
from quillmill.nn.activations import Activation
from quillmill.operators import metrics as M
from quillmill.operators import preprocessing as P
from quillmill.sources import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _sql_round(x: Column, n: int) -> Column:
    """As DuckDB rounds a double: of x * 10 ** n as a double, halves away from 0, and 0 keeps its sign (Spark's own rounds its decimal digits)."""
    y = F.abs(x) * 10.0**n
    whole = F.floor(y).cast("double")
    r = F.when(y >= 2.0**52, y).otherwise(whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**n
    return F.when(F.isnan(x) | (y == float("inf")), x).when((x < 0) | (x.cast("string") == "-0.0"), -r).otherwise(r)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


ITEM = ["l_quantity", "l_extendedprice", "l_discount"]
_KEY = "l_orderkey, l_linenumber"


def _scaled(df: DataFrame, names=ITEM, n: int = 6) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *[_r(c, n).alias(c) for c in names])


def _over(expr: str, names=ITEM, n: int = 6) -> str:
    return f"select {_KEY}, " + ", ".join(f"round({expr.format(c=c)}, {n}) as {c}" for c in names) + " from lineitem"


# ---------------------------------------------------------------- preprocessing


@query(_over("({c} - avg({c}) over ()) / stddev_pop({c}) over ()"))
def standard_scaler(spark, d):
    return _scaled(P.StandardScaler().fit_transform(_lines(spark, d), ITEM))


@query(_over("({c} - avg({c}) over ()) / stddev_pop({c}) over ()"))
def standard_scaler_partial_fit(spark, d):
    df = _lines(spark, d)
    s = P.StandardScaler().fit(df.where("l_linenumber <= 2"), ITEM).partial_fit(df.where("l_linenumber > 2"), ITEM)
    return _scaled(s.transform(df))


@query(_over("{c}", n=5))
def standard_scaler_inverse(spark, d):
    df = _lines(spark, d)
    s = P.StandardScaler().fit(df, ITEM)
    return _scaled(s.inverse_transform(s.transform(df)), n=5)


@query(_over("2 * ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) - 1"))
def min_max_scaler(spark, d):
    return _scaled(P.MinMaxScaler((-1, 1)).fit_transform(_lines(spark, d), ITEM))


@query(_over("{c} / max(abs({c})) over ()"))
def max_abs_scaler(spark, d):
    return _scaled(P.MaxAbsScaler().fit_transform(_lines(spark, d), ITEM))


@query("with q as (select " + ", ".join(f"quantile_cont({c}, 0.25) as a_{c}, quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.75) as z_{c}" for c in ITEM) + f" from lineitem) select {_KEY}, " + ", ".join(f"round(({c} - m_{c}) / (z_{c} - a_{c}), 6) as {c}" for c in ITEM) + " from lineitem, q")
def robust_scaler(spark, d):
    return _scaled(P.RobustScaler().fit_transform(_lines(spark, d), ITEM))


_L2 = "sqrt(" + " + ".join(f"{c} * {c}" for c in ITEM) + ")"


@query(_over("{c} / " + _L2, n=9))
def normalizer(spark, d):
    return _scaled(P.Normalizer().fit_transform(_lines(spark, d), ITEM), n=9)


@query(_over("{c} / greatest(" + ", ".join(f"abs({c})" for c in ITEM) + ")", n=9))
def normalize_row_max(spark, d):
    return _scaled(P.normalize(_lines(spark, d), ITEM, "row", "max"), n=9)


@query(_over("{c} / sum(abs({c})) over ()", n=12))
def normalize_column_l1(spark, d):
    return _scaled(P.normalize(_lines(spark, d), ITEM, "column", "l1"), n=12)


_MEAN = "((" + " + ".join(ITEM) + ") / 3)"


@query(_over("({c} - " + _MEAN + ") / sqrt((" + " + ".join(f"pow({c} - {_MEAN}, 2)" for c in ITEM) + ") / 3)"))
def standardize_row(spark, d):
    return _scaled(P.standardize(_lines(spark, d), ITEM, "row"))


@query("select doc_id, lang, [case when lang = v then 1.0::double else 0.0::double end for v in (select list(lang order by f) from (select lang, min(doc_id) f from documents where lang is not null group by lang))]::double[] as categorical from documents where lang is not null")
def to_categorical_with_mapping(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang").where("lang is not null")
    return P.to_categorical_with_mapping(docs, "lang", "doc_id")[0]


@query("select l_orderkey, l_linenumber, [case when l_linenumber = v then 1.0::double else 0.0::double end for v in range(0, (select max(l_linenumber) + 1 from lineitem))]::double[] as categorical from lineitem")
def to_categorical(spark, d):
    return P.to_categorical(_lines(spark, d).select("l_orderkey", "l_linenumber"), "l_linenumber")


@query("select l_orderkey, l_linenumber, l_linenumber as label from lineitem")
def to_sparse_categorical(spark, d):
    hot = P.to_categorical(_lines(spark, d).select("l_orderkey", "l_linenumber"), "l_linenumber")
    return P.to_sparse_categorical(hot, "categorical").select("l_orderkey", "l_linenumber", "label")


@query("select 'test' as part, cast(least(count(*) - 1, greatest(1, floor(count(*) * 0.25 + 0.5))) as bigint) as n from orders union all select 'train', cast(count(*) - least(count(*) - 1, greatest(1, floor(count(*) * 0.25 + 0.5))) as bigint) from orders")
def train_test_split(spark, d):
    train, test = P.train_test_split(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, 42)
    return train.agg(F.count("*").alias("n")).select(F.lit("train").alias("part"), "n").union(test.agg(F.count("*").alias("n")).select(F.lit("test"), "n"))


@query("select o_orderstatus, cast(least(count(*) - 1, greatest(1, floor(count(*) * 0.25 + 0.5))) as bigint) as n from orders group by o_orderstatus")
def train_test_split_stratified(spark, d):
    return P.train_test_split_stratified(read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.25, 42)[1].groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- metrics


def _pair(spark, d):
    return _lines(spark, d).select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500 + 100).alias("p"))


_PAIR = "with x as (select l_extendedprice t, l_quantity * 1500 + 100 p from lineitem) "
for _name, _f, _sql in (
    ("mse", M.mean_squared_error, "avg((t - p) * (t - p))"),
    ("rmse", M.root_mean_squared_error, "sqrt(avg((t - p) * (t - p)))"),
    ("mae", M.mean_absolute_error, "avg(abs(t - p))"),
    ("r2", M.r2_score, "1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*))"),
    ("explained_variance", M.explained_variance_score, "1 - var_pop(t - p) / var_pop(t)"),
    ("median_ae", M.median_absolute_error, "quantile_cont(abs(t - p), 0.5)"),
    ("mape", M.mean_absolute_percentage_error, "avg(abs(t - p) / greatest(abs(t), 2.220446049250313e-16))"),
):
    QUERIES[f"regression_{_name}"] = lambda spark, d, f=_f, n=_name: f(_pair(spark, d), "t", "p").select(_r(n, 3 if n in ("mse",) else 6).alias(n))
    ORACLE[f"regression_{_name}"] = f"{_PAIR} select round({_sql}, {3 if _name in ('mse',) else 6}) as {_name} from x"

_FLAG = "with x as (select case when l_returnflag = 'R' then 1.0 else 0.0 end t, case when l_quantity > 30 then 1.0 else 0.0 end p from lineitem), "


def _flags(spark, d):
    return _lines(spark, d).select((F.col("l_returnflag") == "R").cast("double").alias("t"), (F.col("l_quantity") > 30).cast("double").alias("p"), "l_quantity")


@query(
    _FLAG + "c as (select sum(t * p) tp, sum((1 - t) * p) fp, sum((1 - t) * (1 - p)) tn, sum(t * (1 - p)) fn from x) "
    "select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(tn as bigint) as tn, cast(fn as bigint) as fn, round((tp + tn) / (tp + fp + tn + fn), 9) as accuracy, round(1 - (tp + tn) / (tp + fp + tn + fn), 9) as error_rate, "
    "round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(tn / (tn + fp), 9) as specificity, round(2 * tp / (2 * tp + fp + fn), 9) as f1, "
    "round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) as mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) as balanced_accuracy from c"
)
def binary_report(spark, d):
    r = M.binary_report(_flags(spark, d), "t", "p")
    return r.select("tp", "fp", "tn", "fn", *[_r(c, 9).alias(c) for c in r.columns[4:]])


@query(_FLAG + "z as (select 1) select round(avg(case when abs(t - p) < 2.220446049250313e-16 then 1.0 else 0.0 end), 9) as accuracy from x")
def accuracy(spark, d):
    return M.accuracy(_flags(spark, d), "t", "p").select(_r("accuracy", 9).alias("accuracy"))


_SCORES = "with s as (select l_quantity s, sum(case when l_returnflag = 'R' then 1 else 0 end) p, count(*) n from lineitem group by 1), c as (select s, p, n, sum(p) over (order by s desc) tp, sum(n - p) over (order by s desc) fp, sum(n - p) over (order by s) below, (select sum(p) from s) np, (select sum(n - p) from s) nn from s) "


@query(_SCORES + "select round(sum(p * (below - (n - p) / 2.0)) / max(np * nn), 9) as auc from c")
def roc_auc(spark, d):
    return M.roc_auc(_flags(spark, d), "t", "l_quantity").select(_r("auc", 9).alias("auc"))


@query(_SCORES + "select round(fp / nn, 9) as fpr, round(tp / np, 9) as tpr, s as threshold from c union all select 0, 0, 'infinity'::double")
def roc_curve(spark, d):
    return M.roc_curve(_flags(spark, d), "t", "l_quantity").select(_r("fpr", 9).alias("fpr"), _r("tpr", 9).alias("tpr"), "threshold")


@query(_SCORES + "select round(tp / (tp + fp), 9) as precision, round(tp / np, 9) as recall, s as threshold from c union all select 1, 0, null")
def precision_recall_curve(spark, d):
    return M.precision_recall_curve(_flags(spark, d), "t", "l_quantity").select(_r("precision", 9).alias("precision"), _r("recall", 9).alias("recall"), "threshold")


@query(_SCORES + "select round(sum(p * tp / (tp + fp)) / max(np), 9) as average_precision from c")
def average_precision(spark, d):
    return M.average_precision(_flags(spark, d), "t", "l_quantity").select(_r("average_precision", 9).alias("average_precision"))


def _orders(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("a"), F.substring("o_orderpriority", 1, 1).alias("b"), "o_totalprice")


_ORD = "with o as (select o_orderstatus a, substr(o_orderpriority, 1, 1) b from orders), n as (select a, b, count(*)::double n from o group by a, b), m as (select *, sum(n) over (partition by a) ra, sum(n) over (partition by b) cb, sum(n) over () t from n), g as (select max(t) t, sum(n / t * ln(n * t / (ra * cb))) mi, -sum(n / t * ln(ra / t)) ha, -sum(n / t * ln(cb / t)) hb, sum(n * (n - 1) / 2) sb, sum(n * (ra - 1) / 2) sa, sum(n * (cb - 1) / 2) sc from m) "


@query("select o_orderstatus as a, substr(o_orderpriority, 1, 1) as b, count(*) as n from orders group by 1, 2")
def contingency_matrix(spark, d):
    return M.contingency(_orders(spark, d), "a", "b")


@query(_ORD + "select round(case when ha + hb <= 2e-15 then 0 else mi / ((ha + hb) / 2) end, 9) as nmi from g")
def normalized_mutual_info(spark, d):
    return M.normalized_mutual_info(_orders(spark, d), "a", "b").select(_r("nmi", 9).alias("nmi"))


@query(_ORD + "select round((sb - sa * sc / (t * (t - 1) / 2)) / ((sa + sc) / 2 - sa * sc / (t * (t - 1) / 2)), 9) as ari from g")
def adjusted_rand_index(spark, d):
    return M.adjusted_rand_index(_orders(spark, d), "a", "b").select(_r("ari", 9).alias("ari"))


@query(_ORD + "select round(mi / ha, 9) as homogeneity, round(mi / hb, 9) as completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 9) as v_measure from g")
def homogeneity_completeness_v(spark, d):
    r = M.homogeneity_completeness_v(_orders(spark, d), "a", "b")
    return r.select(*[_r(c, 9).alias(c) for c in r.columns])


@query(_ORD + "select round(sb / sqrt(sa * sc), 9) as fowlkes_mallows from g")
def fowlkes_mallows_score(spark, d):
    return M.fowlkes_mallows_score(_orders(spark, d), "a", "b").select(_r("fowlkes_mallows", 9).alias("fowlkes_mallows"))


@query(
    _ORD + ", r as (select distinct a, ra from m), q as (select distinct b, cb from m), k as (select ra, cb, t, unnest(range(greatest(1, ra + cb - t)::bigint, least(ra, cb)::bigint + 1)) k from r, q, g), "
    "e as (select sum(k / t * ln(t * k / (ra * cb)) * exp(lgamma(ra + 1) + lgamma(cb + 1) + lgamma(t - ra + 1) + lgamma(t - cb + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(ra - k + 1) - lgamma(cb - k + 1) - lgamma(t - ra - cb + k + 1))) emi from k) "
    "select round((mi - emi) / ((ha + hb) / 2 - emi), 9) as ami from g, e"
)
def adjusted_mutual_info(spark, d):
    return spark.createDataFrame([(round(M.adjusted_mutual_info(_orders(spark, d), "a", "b"), 9),)], "ami double")


def _two(spark, d):
    return _lines(spark, d).select(F.col("l_returnflag").alias("t"), F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("p"))


_TWO = "with x as (select l_returnflag t, case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end p from lineitem), l as (select t as label from x union select p from x), k as (select label, (select count(*) from x where t = label)::double s, (select count(*) from x where p = label)::double c, (select count(*) from x where t = label and p = label)::double tp from l) "


@query(_TWO + "select label, round(case when c = 0 then 0 else tp / c end, 9) as precision, round(case when s = 0 then 0 else tp / s end, 9) as recall, round(case when tp = 0 then 0 else 2 * tp / (s + c) end, 9) as f1, cast(s as bigint) as support from k")
def multiclass_report(spark, d):
    r = M.per_class_report(_two(spark, d), "t", "p")
    return r.select("label", *[_r(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_TWO + "select round((sum(tp) / sum(s) - sum(s * c) / (sum(s) * sum(s))) / (1 - sum(s * c) / (sum(s) * sum(s))), 9) as kappa from k")
def cohen_kappa(spark, d):
    return M.cohen_kappa(_two(spark, d), "t", "p").select(_r("kappa", 9).alias("kappa"))


def _probs(spark, d):
    e = read_table(spark, d, "embeddings")
    p = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")) + 0.01)
    return e.select(F.pmod("label", F.lit(10)).alias("y"), p.alias("p"))


_PROB = "with x as (select ((label % 10) + 10) % 10 y, list_transform(embedding[1:10], lambda v: abs(v::double) + 0.01) p from embeddings) "


@query(_PROB + "select round(-avg(ln(greatest(least(p[y + 1] / list_sum(p), 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 9) as log_loss from x")
def log_loss(spark, d):
    return M.log_loss(_probs(spark, d), "y", "p").select(_r("log_loss", 9).alias("log_loss"))


@query(_PROB + "select round(avg(case when len(list_filter(p, lambda v: v > p[y + 1])) < 3 then 1.0 else 0.0 end), 9) as top_k_accuracy from x")
def top_k_accuracy(spark, d):
    return M.top_k_accuracy(_probs(spark, d), "y", "p", 3).select(_r("top_k_accuracy", 9).alias("top_k_accuracy"))


def _parts(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), F.pmod("p_partkey", F.lit(3)).cast("long").alias("c"))


_PARTS = "with q as (select p_partkey row_id, p_size::double x, p_retailprice / 100 y, p_partkey % 3 c from part), m as (select c, count(*)::double n, avg(x) mx, avg(y) my from q group by c), g as (select avg(x) gx, avg(y) gy, count(*)::double n from q) "


@query(_PARTS + ", w as (select sum(pow(x - mx, 2) + pow(y - my, 2)) w from q join m using (c)), b as (select sum(m.n * (pow(mx - gx, 2) + pow(my - gy, 2))) b, count(*) k, max(g.n) n from m, g) select round(b / w * (n - k) / (k - 1), 6) as calinski_harabasz from w, b")
def calinski_harabasz_score(spark, d):
    return M.calinski_harabasz_score(_parts(spark, d), ["x", "y"], "c").select(_r("calinski_harabasz").alias("calinski_harabasz"))


@query(_PARTS + ", s as (select c, any_value(mx) mx, any_value(my) my, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2))) s from q join m using (c) group by c), r as (select a.c, max((a.s + b.s) / sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2))) r from s a join s b on a.c <> b.c group by a.c) select round(avg(r), 6) as davies_bouldin from r")
def davies_bouldin_score(spark, d):
    return spark.createDataFrame([(round(M.davies_bouldin_score(_parts(spark, d), ["x", "y"], "c"), 6),)], "davies_bouldin double")


@query(_PARTS + ", p as (select a.row_id, a.c own, b.c other, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) d, count(*)::double m from q a, q b group by 1, 2, 3), e as (select row_id, max(case when own = other then d / greatest(m - 1, 1) end) a, min(case when own <> other then d / m end) b from p group by row_id) select round(avg(case when greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from e")
def silhouette_score(spark, d):
    return M.silhouette_score(_parts(spark, d), ["x", "y"], "c").select(_r("silhouette").alias("silhouette"))


# ---------------------------------------------------------------- functions


def _vectors(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return read_table(spark, d, "embeddings").select("vec_id", v.alias("a"), F.reverse(v).alias("b"))


_VEC = "with v as (select vec_id, list_transform(embedding, lambda x: x::double) a, list_reverse(list_transform(embedding, lambda x: x::double)) b from embeddings) select vec_id, "
_ZIP = "list_sum(list_transform(list_zip(a, b), lambda z: {}))"


@query(_VEC + f"round(sqrt({_ZIP.format('(z[1] - z[2]) * (z[1] - z[2])')}), 9) as euclidean, round({_ZIP.format('abs(z[1] - z[2])')}, 9) as manhattan, round(pow({_ZIP.format('pow(abs(z[1] - z[2]), 3)')}, 1.0 / 3), 9) as minkowski from v")
def distances(spark, d):
    a, b = F.col("a"), F.col("b")
    return _vectors(spark, d).select("vec_id", _r(D.distance(a, b), 9).alias("euclidean"), _r(D.manhattan(a, b), 9).alias("manhattan"), _r(D.minkowski(a, b, 3), 9).alias("minkowski"))


_ACT = {
    "relu": "greatest({x}, 0)", "sigmoid": "1 / (1 + exp(-({x})))", "tanh": "(exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1)", "leaky_relu": "case when {x} >= 0 then {x} else 0.3 * ({x}) end",
    "elu": "case when {x} > 0 then {x} else exp({x}) - 1 end", "selu": "1.050701 * case when {x} > 0 then {x} else 1.6732632 * (exp({x}) - 1) end", "softplus": "greatest({x}, 0) + ln(1 + exp(-abs({x})))",
    "softsign": "({x}) / (1 + abs({x}))", "hard_sigmoid": "greatest(0, least(6, ({x}) + 3)) / 6", "exponential": "exp({x})",
}
_ARG = "(l_quantity - 25) / 10"


@query(f"select {_KEY}, " + ", ".join(f"round({s.format(x=_ARG)}, 6) as {n}" for n, s in _ACT.items()) + " from lineitem")
def activations(spark, d):
    x = (F.col("l_quantity") - 25) / 10
    return _lines(spark, d).select("l_orderkey", "l_linenumber", *[_r(Activation(n).column(x)).alias(n) for n in _ACT])


@query("with s as (select s_suppkey, s_acctbal / 1000 x, (s_suppkey % 7)::double y from supplier) select a.s_suppkey as a, b.s_suppkey as b, round(exp(-0.1 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 9) as k from s a, s b")
def rbf_kernel_matrix(spark, d):
    """The kernel of all suppliers with all."""
    s = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.pmod("s_suppkey", F.lit(7)).cast("double").alias("y"))
    return Kernel("rbf", 0.1).between(s, "s_suppkey", ["x", "y"]).select("a", "b", _r("k", 9).alias("k"))


@query("select l_orderkey, l_linenumber, round(q, 6) as poly0, round(t, 6) as poly1, round(q * q, 6) as poly2, round(q * t, 6) as poly3, round(t * t, 6) as poly4 from (select l_orderkey, l_linenumber, l_quantity q, l_tax t from lineitem)")
def polynomial_features(spark, d):
    from quillmill.operators.linear import generate_polynomial_features

    p = generate_polynomial_features(_lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], 2)
    return p.select("l_orderkey", "l_linenumber", *[_r(f"poly{i}").alias(f"poly{i}") for i in range(5)])


# ---------------------------------------------------------------- estimators


@query("with m as (select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from lineitem) select l_orderkey, l_linenumber, round(a + b * l_quantity, 3) as prediction from lineitem, m")
def linear_regression(spark, d):
    from quillmill.operators.linear import LinearRegression

    df = _lines(spark, d)
    return LinearRegression().fit(df, ["l_quantity"], "l_extendedprice").predict(df).select("l_orderkey", "l_linenumber", _r("prediction", 3).alias("prediction"))


def _weighted(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *[((F.col(c) - m) / s).alias(c) for c, m, s in (("l_quantity", 25.0, 15.0), ("l_extendedprice", 38000.0, 23000.0), ("l_discount", 0.05, 0.03))], (F.col("l_returnflag") == "R").cast("double").alias("y"))


def _logistic_sql(steps: int, rate: float) -> str:
    """Each step's weights are a table of their own."""
    odds = "1 / (1 + exp(-(a * x + b * y + c * z + i)))"
    sql = f"with d as (select {_KEY}, (l_quantity - 25) / 15 x, (l_extendedprice - 38000) / 23000 y, (l_discount - 0.05) / 0.03 z, case when l_returnflag = 'R' then 1.0::double else 0 end l from lineitem), w0 as (select 0::double a, 0::double b, 0::double c, 0::double i)"
    for k in range(steps):
        sql += f", w{k + 1} as (select any_value(a) - {rate} * avg(e * x) a, any_value(b) - {rate} * avg(e * y) b, any_value(c) - {rate} * avg(e * z) c, any_value(i) - {rate} * avg(e) i from (select *, {odds} - l e from d, w{k}))"
    return f"{sql} select {_KEY}, round({odds}, 6) as probability from d, w{steps}"


@query(_logistic_sql(5, 0.5))
def logistic_regression(spark, d):
    from quillmill.operators.linear import LogisticRegression

    df = _weighted(_lines(spark, d))
    return LogisticRegression(learning_rate=0.5, max_iter=5).fit(df, ITEM, "y").predict_proba(df).select("l_orderkey", "l_linenumber", _r("probability").alias("probability"))


@query()
def linear_svc(spark, d):
    from quillmill.operators.linear import LinearSVC, Penalty

    df = _weighted(_lines(spark, d).where("l_linenumber is not null"))
    return LinearSVC(max_iter=1, learning_rate=0.05, penalty=Penalty("l2", 0.01), random_state=1).fit(df, ITEM, "y").decision_function(df).select("l_orderkey", "l_linenumber", _r("decision").alias("decision"))


def _points(spark, d):
    return read_table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("row_id"), (F.col("s_acctbal") / 1000).alias("x"), F.pmod("s_suppkey", F.lit(7)).cast("double").alias("y"), (F.col("s_acctbal") > 4000).cast("double").alias("label"))


@query("with s as (select s_suppkey k, s_acctbal / 1000 x, (s_suppkey % 7)::double y from supplier), q as (select c_custkey i, c_acctbal / 1000 x, (c_custkey % 7)::double y from customer), r as (select i, k, sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2)) d from q, s), n as (select *, row_number() over (partition by i order by d, k) rank from r) select i as query_id, k as stored_id, round(d, 9) as distance, rank::int as rank from n where rank <= 5")
def knn_join(spark, d):
    from quillmill.operators.neighbors import knn_join as join

    q = read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), (F.col("c_acctbal") / 1000).alias("x"), F.pmod("c_custkey", F.lit(7)).cast("double").alias("y"))
    return join(q, "row_id", _points(spark, d), "row_id", ["x", "y"], 5).select("query_id", "stored_id", _r("distance", 9).alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("with s as (select s_suppkey k, s_acctbal / 1000 x, (s_suppkey % 7)::double y, case when s_acctbal > 4000 then 1.0 else 0.0 end l from supplier), q as (select c_custkey i, c_acctbal / 1000 x, (c_custkey % 7)::double y from customer), r as (select i, l, row_number() over (partition by i order by sqrt(pow(q.x - s.x, 2) + pow(q.y - s.y, 2)), k) r from q, s) select i as row_id, case when sum(l) * 2 > 5 then 1.0 else 0.0 end as prediction from r where r <= 5 group by i")
def knn_classifier(spark, d):
    from quillmill.operators.neighbors import KNN

    q = read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), (F.col("c_acctbal") / 1000).alias("x"), F.pmod("c_custkey", F.lit(7)).cast("double").alias("y"))
    return KNN(5).fit(_points(spark, d), ["x", "y"], "label").predict(q).select("row_id", "prediction")


@query()
def svc(spark, d):
    from quillmill.operators.svm import SVC

    df = _points(spark, d)
    return SVC(Kernel("rbf", 0.5)).fit(df, ["x", "y"], "label").predict(df).select("row_id", "prediction")


#: class means, the pooled covariance with its small ridge, and its inverse by cofactors
_LDA = (
    "with d as (select *, row_number() over () r, l_quantity x, l_extendedprice y, l_discount z, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end l from lineitem), m as (select l, count(*)::double n, avg(x) mx, avg(y) my, avg(z) mz from d group by l), "
    "s as (select sum((x - mx) * (x - mx)) xx, sum((x - mx) * (y - my)) xy, sum((x - mx) * (z - mz)) xz, sum((y - my) * (y - my)) yy, sum((y - my) * (z - mz)) yz, sum((z - mz) * (z - mz)) zz, count(*) - 3 f from d join m using (l)), "
    "v as (select xx / f + g a, xy / f b, xz / f c, yy / f + g e, yz / f h, zz / f + g i from (select *, 1e-6 * (xx + yy + zz) / f / 3 g from s)), t as (select *, a * (e * i - h * h) - b * (b * i - h * c) + c * (b * h - e * c) t from v), "
    "k as (select l, n / sum(n) over () p, mx, my, mz, (mx * (e * i - h * h) + my * (c * h - b * i) + mz * (b * h - c * e)) / t wx, (mx * (c * h - b * i) + my * (a * i - c * c) + mz * (b * c - a * h)) / t wy, (mx * (b * h - c * e) + my * (b * c - a * h) + mz * (a * e - b * b)) / t wz from m, t), "
    f"q as (select {_KEY}, r, k.l, x * wx + y * wy + z * wz + ln(p) - 0.5 * (mx * wx + my * wy + mz * wz) q from d, k) select {_KEY}, arg_max(l, q)::int as prediction from q group by r, {_KEY}"
)


@query(_LDA)
def lda(spark, d):
    from quillmill.operators.discriminant import LDA

    df = _lines(spark, d).withColumn("y", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    return LDA().fit(df, ITEM, "y").predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query()
def kmeans(spark, d):
    from quillmill.operators.clustering import KMeans

    df = _weighted(_lines(spark, d))
    return KMeans(3, max_iter=5, n_init=1, random_state=1).fit(df, ITEM).predict(df).select("l_orderkey", "l_linenumber", "cluster")


@query("with p as (select c_custkey i, c_acctbal x from customer), g as (select i, x, case when x - lag(x) over (order by x, i) <= 1.5 then 0 else 1 end n from p), c as (select i, sum(n) over (order by x, i) k from g), f as (select k, min(i) r from c group by k), o as (select k, row_number() over (order by r) - 1 z from f) select i as row_id, cast(z as bigint) as cluster from c join o using (k)")
def dbscan(spark, d):
    from quillmill.operators.clustering import DBSCAN

    df = read_table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("row_id"), F.col("c_acctbal").alias("x"))
    return DBSCAN(1.5, 1).fit_predict(df, ["x"]).select("row_id", "cluster")


@query()
def mean_shift(spark, d):
    from quillmill.operators.clustering import MeanShift

    df = _points(spark, d)
    return MeanShift(2.0, bin_seeding=True).fit(df, ["x", "y"]).predict(df).select("row_id", "cluster")


@query("with c as (select var_samp(x) a, var_samp(y) b, covar_samp(x, y) k, avg(x) mx, avg(y) my from (select l_quantity / 10 x, l_extendedprice / 10000 y from lineitem)), e as (select *, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + k * k) w from c), v as (select *, k / sqrt(k * k + pow(w - a, 2)) vx, (w - a) / sqrt(k * k + pow(w - a, 2)) vy from e) select l_orderkey, l_linenumber, round(abs((l_quantity / 10 - mx) * vx + (l_extendedprice / 10000 - my) * vy), 6) as pc0 from lineitem, v")
def pca(spark, d):
    from quillmill.operators.decomposition import PCA

    df = _lines(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))
    return PCA(1).fit(df, ["x", "y"]).transform(df).select("l_orderkey", "l_linenumber", _r(F.abs("pc0")).alias("pc0"))


@query()
def kernel_pca(spark, d):
    from quillmill.operators.decomposition import KernelPCA

    df = _points(spark, d)
    return KernelPCA(Kernel("rbf", 0.1), 2).fit(df, ["x", "y"]).transform(df).select("row_id", F.transform("kpca", lambda v: F.round(v, 6)).alias("kpca"))


@query()
def tsne(spark, d):
    from quillmill.operators.decomposition import TSNE

    return TSNE(2, 10, random_state=1).fit_transform(_points(spark, d), ["x", "y"]).select("row_id", "embedding")


@query("with s as (select l_quantity v, count(*)::double n, sum(l_extendedprice) y, sum(l_extendedprice * l_extendedprice) y2 from lineitem group by 1), r as (select v, lead(v) over (order by v) nx, sum(n) over (order by v) n, sum(y) over (order by v) y, sum(y2) over (order by v) y2, sum(n) over () tn, sum(y) over () ty, sum(y2) over () ty2 from s), g as (select (v + nx) / 2 t, n / tn * (y2 / n - pow(y / n, 2)) + (tn - n) / tn * ((ty2 - y2) / (tn - n) - pow((ty - y) / (tn - n), 2)) w, y / n l, (ty - y) / (tn - n) h from r where nx is not null), b as (select t, l, h from g order by w, t limit 1) select l_orderkey, l_linenumber, round(case when l_quantity <= t then l else h end, 3) as prediction from lineitem, b")
def decision_stump(spark, d):
    from quillmill.operators.trees import DecisionTree

    df = _lines(spark, d)
    return DecisionTree("cart", is_classifier=False, max_depth=1).fit(df, ["l_quantity"], "l_extendedprice").predict(df).select("l_orderkey", "l_linenumber", _r("prediction", 3).alias("prediction"))


@query()
def decision_tree(spark, d):
    from quillmill.operators.trees import DecisionTree

    df = _lines(spark, d).withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return DecisionTree("cart", max_depth=3).fit(df, ["l_quantity", "l_discount", "l_tax"], "y").predict(df).select("l_orderkey", "l_linenumber", "prediction")


@query()
def isolation_forest(spark, d):
    from quillmill.operators.trees import IsolationForest

    df = _lines(spark, d)
    return IsolationForest(20, 128, random_state=1).fit(df, ITEM).score_samples(df).select("l_orderkey", "l_linenumber", _r("score", 9).alias("score"))


@query("select vec_id, list_transform(range(0, 4), lambda j: round(greatest(0, list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::double * (((i * 7 + j * 3) % 11) - 5) / 10.0)) + j / 10.0), 3)) as prediction from embeddings")
def dense_predict(spark, d):
    import numpy as np

    from quillmill import nn

    layer = nn.Dense(64, 4, "relu").double()
    layer.set_weights(weight=[[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(4)] for i in range(64)], bias=np.arange(4) / 10)
    out = nn.Sequential().add(layer).predict_frame(read_table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", (64,))
    return out.select("vec_id", F.transform("prediction", lambda v: _sql_round(v, 3)).alias("prediction"))


#: an embedding as a sequence of 64 steps with one channel, through a convolution of fixed weights and an average of each four steps
_CONV = (
    "with e as (select vec_id, list_transform(embedding, lambda v: v::double) v from embeddings), c as (select vec_id, list_transform(range(0, 62), lambda t: [greatest(0, 0.5 * v[t + 1] - 0.25 * v[t + 2] + 0.75 * v[t + 3] + 0.1), greatest(0, v[t + 2] - v[t + 1] - 0.2)]) c from e) "
    "select vec_id, list_transform(range(0, 30), lambda j: round((c[j // 2 * 4 + 1][j % 2 + 1] + c[j // 2 * 4 + 2][j % 2 + 1] + c[j // 2 * 4 + 3][j % 2 + 1] + c[j // 2 * 4 + 4][j % 2 + 1]) / 4, 3)) as prediction from c"
)


@query(_CONV)
def convolution_predict(spark, d):
    from quillmill import nn

    conv = nn.Conv1D(2, 3, (64, 1), activation="relu").double()
    conv.set_weights(weight=[[[0.5, -1.0]], [[-0.25, 1.0]], [[0.75, 0.0]]], bias=[0.1, -0.2])
    net = nn.Sequential().add(conv).add(nn.AveragePooling1D(4).double())
    out = net.predict_frame(read_table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", (64, 1))
    return out.select("vec_id", F.transform("prediction", lambda v: _sql_round(v, 3)).alias("prediction"))


_VEC = "with e as (select vec_id, label, list_transform(embedding, lambda v: v::double) v from embeddings) "


def _layers(spark, d, *layers, shape=(64,), first=64, digits=3, plus_zero=False):
    """The first numbers of the layers' output for each embedding, in 64 bits as in SQL. plus_zero: SQL adds 0, so none is -0."""
    from quillmill import nn

    net = nn.Sequential()
    for layer in layers:
        net.add(layer.double())
    out = net.predict_frame(read_table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", shape)
    return out.select("vec_id", F.transform(F.slice("prediction", 1, first), lambda v: _sql_round(v, digits) + F.lit(0.0) if plus_zero else _sql_round(v, digits)).alias("prediction"))


@query(_VEC + "select vec_id, [round(list_reduce(list_prepend(0::double, v), lambda h, x: tanh(0.5 * x + 0.3 * h + 0.1)), 3)] as prediction from e")
def recurrent_predict(spark, d):
    from quillmill import nn

    rnn = nn.SimpleRNN(1, 1).double()
    rnn.set_weights(kernel=[[0.5]], recurrent=[[0.3]], bias=[0.1])
    return _layers(spark, d, rnn, shape=(64, 1))


@query(_VEC + "select vec_id, list_transform(range(0, 16), lambda i: round(list_max(v[i * 4 + 1 : i * 4 + 4]), 6)) as prediction from e")
def max_pooling_predict(spark, d):
    from quillmill import nn

    return _layers(spark, d, nn.MaxPooling1D(4), shape=(64, 1), digits=6)


@query(_VEC + "select vec_id, list_transform(v[1:3], lambda x: round((x - list_avg(v)) / sqrt(list_var_pop(v) + 0.001), 2) + 0::double) as prediction from e")
def layer_normalization(spark, d):
    from quillmill import nn

    return _layers(spark, d, nn.LayerNormalization((64,)), first=3, digits=2, plus_zero=True)


@query(_VEC + "select vec_id, list_transform(range(0, 3), lambda i: round((v[i + 1] - list_avg(v[1:16])) / sqrt(list_var_pop(v[1:16]) + 0.001), 2) + 0::double) as prediction from e")
def group_normalization(spark, d):
    from quillmill import nn

    return _layers(spark, d, nn.GroupNormalization((64,), 4), first=3, digits=2, plus_zero=True)


@query(
    _VEC + ", p as (select label % 2 y, 1 / (1 + exp(-list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * (i * 7 % 11 - 5) / 20)))) p from e) "
    "select 'mean_squared_error' as loss, round(avg((y - p) * (y - p)), 4) as value from p union all select 'mean_absolute_error', round(avg(abs(y - p)), 4) from p union all select 'binary_cross_entropy', round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 4) from p"
)
def network_losses(spark, d):
    from quillmill import nn

    e = read_table(spark, d, "embeddings").select("embedding", F.pmod("label", F.lit(2)).cast("float").alias("y"))
    layer = nn.Dense(64, 1, "sigmoid")
    layer.set_weights(weight=[[(i * 7 % 11 - 5) / 20] for i in range(64)], bias=[0.0])
    losses = {"mean_squared_error": nn.MeanSquaredError(), "mean_absolute_error": nn.MeanAbsoluteError(), "binary_cross_entropy": nn.BinaryCrossEntropy()}
    return spark.createDataFrame([(k, round(nn.Sequential().add(layer).compile(nn.SGD(0.1), f).evaluate_frame(e, "embedding", "y", (64,)), 4)) for k, f in losses.items()], "loss string, value double")


@query()
def network_training(spark, d):
    from quillmill import nn

    e = read_table(spark, d, "embeddings").select("vec_id", "embedding", F.pmod("label", F.lit(2)).cast("float").alias("y"))
    m = nn.Sequential().add(nn.Dense(64, 8, "relu", random_state=1)).add(nn.Dense(8, 1, "sigmoid", random_state=2)).compile(nn.Adam(0.01), nn.BinaryCrossEntropy())
    loss = m.fit_frame(e, "embedding", "y", 3, (64,)).loss
    return spark.createDataFrame([(i, round(v, 5)) for i, v in enumerate(loss)], "epoch long, loss double")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Standardised line items with the price that a regression on them predicts."""
    from quillmill.operators.linear import LinearRegression

    df = P.StandardScaler().fit_transform(_lines(spark, folder), ["l_quantity", "l_discount", "l_tax"])
    return LinearRegression().fit(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").predict(df).select("l_orderkey", "l_linenumber", "l_extendedprice", _r("prediction", 3).alias("prediction"))
