"""Network queries against their SQL bit for bit, on rows where 32 bits or Spark's rounding gave another last digit (found among 300,000 drawn ones)."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillmill.plans import queries as Q

ROWS = {
    "dense_predict": [122980, 43402, 84575, 78252, 106299, 178157, 42246, 58141],
    "convolution_predict": [27423, 111642, 276832, 291459, 236479, 290600, 4122, 268918],
    "recurrent_predict": [100634, 101598, 111296, 11951, 125526, 13987, 145009, 160521],
    "max_pooling_predict": [270272, 121793, 176938, 19115, 153732, 87884, 27931],
    "group_normalization": [107063, 180136, 95500],
    "layer_normalization": [153839, 132155, 178029],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("embeddings")
    n = np.arange(300_000)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(len(n), 64)) / 8).astype(np.float32)
    some = np.unique(np.concatenate([n[:200], *ROWS.values()]))
    pq.write_table(pa.table({"vec_id": some, "label": (some % 20).astype(np.int32), "embedding": pa.array(list(x[some]), pa.list_(pa.float32()))}), d / "embeddings.parquet")
    return d


@pytest.mark.parametrize("name", sorted(ROWS))
def test_every_digit_is_that_of_sql(spark, folder, name):
    ours = {r["vec_id"]: repr(r["prediction"]) for r in Q.QUERIES[name](spark, str(folder)).collect()}
    theirs = duckdb.connect().sql(Q.ORACLE[name].replace("from embeddings", f"from '{folder}/embeddings.parquet'")).to_arrow_table()
    assert ours == dict(zip(theirs["vec_id"].to_pylist(), map(repr, theirs["prediction"].to_pylist()), strict=True))


def test_max_pooling_of_signed_zeros_and_great_numbers_is_that_of_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = [*rng.choice([-0.0, 0.0, np.inf, -np.inf, -1.0], (60, 64), p=[0.4, 0.4, 0.02, 0.02, 0.16]), *(rng.normal(size=(60, 64)) * 10.0 ** rng.uniform(0, 30, (60, 1)))]
    pq.write_table(pa.table({"vec_id": range(len(x)), "embedding": pa.array([v.astype(np.float32) for v in x], pa.list_(pa.float32())), "label": [0] * len(x)}), tmp_path / "embeddings.parquet")
    ours = {r["vec_id"]: repr(r["prediction"]) for r in Q.QUERIES["max_pooling_predict"](spark, str(tmp_path)).collect()}
    theirs = duckdb.connect().sql(Q.ORACLE["max_pooling_predict"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet'")).to_arrow_table()
    assert ours == dict(zip(theirs["vec_id"].to_pylist(), map(repr, theirs["prediction"].to_pylist()), strict=True))
