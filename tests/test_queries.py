"""Every registered query of the library's own operators against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from quillmill.plans import queries as Q

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for k in df:
        df[k] = df[k].map(lambda v: str(np.round(np.asarray(v, float), 4).tolist()) if isinstance(v, (list, np.ndarray)) else str(round(v, 4) + 0.0) if isinstance(v, float) else str(v))
    return sorted(map(tuple, df.itertuples(index=False))), list(df.columns)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    ours, cols = plain(Q.QUERIES[name](spark, str(FOLDER)).toPandas())
    theirs, names = plain(duck.sql(Q.ORACLE[name]).df())
    assert cols == names and len(ours) == len(theirs)
    assert sum(a != b for a, b in zip(ours, theirs)) <= 1e-3 * len(ours)  # a number may round the other way


def test_entry(spark):
    df = Q.entry(spark, str(FOLDER))
    assert df.columns == ["l_orderkey", "l_linenumber", "l_extendedprice", "prediction"] and df.count() > 5000
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_partial_fit_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmill.operators.preprocessing import StandardScaler
    from quillmill.streaming import parquet_stream, partial_fit_stream, windowed_moments

    events = spark.read.parquet(str(FOLDER / "events.parquet")).select("ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    s = StandardScaler()
    partial_fit_stream(parquet_stream(spark, str(tmp_path / "in"), events.schema), s, ["value"], str(tmp_path / "check"), str(tmp_path / "model")).awaitTermination()
    want = events.agg(F.avg("value"), F.var_pop("value"), F.count("*")).first()
    assert s.n == want[2] and s.mean["value"] == pytest.approx(want[0]) and s.var["value"] == pytest.approx(want[1])
    assert StandardScaler.load(spark, str(tmp_path / "model")).mean == pytest.approx(s.mean)
    q = windowed_moments(parquet_stream(spark, str(tmp_path / "in"), events.schema), "ts", "value", "1 day", "1 hour").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("moments").agg(F.sum("n")).first()[0] == want[2]
