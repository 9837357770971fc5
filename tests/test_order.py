"""Exact quantiles by cells of a sketch and quantiles of a growing past, against sorting everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.functions import order


def brute(values, q):
    return float(np.quantile(values, q)) if len(values) else None


@pytest.mark.parametrize("accuracy", [10_000, 10])
def test_quantiles(spark, monkeypatch, accuracy):
    """Whatever the sketch is worth: many ties, one value, one row, nulls, a null key."""
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "ties": [float(rng.randrange(4)) for _ in range(2000)], "same": [7.0] * 500, "one": [1.5], "two": [-1.0, 2.0], None: [rng.random() for _ in range(300)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, n double").repartition(7)
    qs = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p90": 0.9, "high": 1.0}
    got = {r["run"]: r for r in order.quantiles(df.withColumnRenamed("n", "v"), ["run"], "v", qs).collect()}
    assert set(got) == {*groups, "none"}
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        for name, q in qs.items():
            assert got[k][name] == pytest.approx(brute(vs, q), abs=1e-12), (k, name)
    assert got["none"]["n"] == 0 and got["none"]["mid"] is None


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    (row,) = order.quantiles(df, [], "v", {"a": 0.25, "b": 0.9}).collect()
    assert (row["n"], row["a"], row["b"]) == (1001, 250.0, 900.0)
    (row,) = order.quantiles(df.limit(0), [], "v", {"a": 0.25}).collect()
    assert (row["n"], row["a"]) == (0, None)
    assert order.quantiles(df.limit(0).withColumn("run", F.lit("x")), ["run"], "v", {"a": 0.25}).collect() == []


def test_running_quantile(spark):
    """Ties, nulls and several series with the same places; 600 rows are three levels of the tree."""
    rng = random.Random(5)
    rows = []
    for key, n in (("a", 600), ("b", 40), (None, 20), ("c", 1)):
        rows += [(key, i, None if rng.random() < 0.1 else (float(rng.randrange(9)) if i % 3 else rng.gauss(4, 3))) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i int, x double").repartition(5)
    for q, least in ((0.9, 5), (0.0, 1), (0.5, 1), (1.0, 2)):
        got = {(r["s"], r["i"]): r["p"] for r in order.running_quantile(df, ["s"], "i", "x", q, "p", least).collect()}
        assert len(got) == len(rows)
        for key, i, _ in rows:
            past = [x for k, j, x in rows if k == key and j < i and x is not None]
            want = brute(past, q) if len(past) >= least else None
            assert got[key, i] == (want if want is None else pytest.approx(want, abs=1e-12)), (q, key, i)


def test_running_quantile_of_one_series(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("x"))
    got = order.running_quantile(df, [], "id", "x", 0.5, "p").orderBy("id").collect()
    xs = [r["x"] for r in got]
    assert [r["p"] for r in got] == [brute(xs[:i], 0.5) for i in range(50)]
    assert order.running_quantile(df.limit(0), [], "id", "x", 0.5, "p").collect() == []
