"""Linear models from sums by date against Spark ML and against all rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from paneltide.operators import learn, moments

COLUMNS = ["u", "v", "w"]
NETS = {"none": (0.0, 0.0), "ridge": (0.2, 0.0), "both": (0.05, 0.5), "lasso": (0.1, 1.0), "all gone": (50.0, 1.0)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for n in range(60):
        for s in "abcd":
            u, v = rng.normal(3, 1), rng.normal(-1, 20)
            y = 0.5 * u - 0.02 * v + rng.normal() if rng.random() > 0.1 else None
            data.append((s, dt.date(2020, 1, 1) + dt.timedelta(n), n, u, v, u + rng.normal(0, 0.3) if rng.random() > 0.05 else None, y))
    return spark.createDataFrame(data, "symbol string, ts date, n long, u double, v double, w double, label double").repartition(3).cache()


@pytest.mark.parametrize("name", NETS)
def test_equal_to_spark_ml(spark, rows, name):
    folds = [(0, 0, 20, 22, 30), (1, 5, 33, 40, 60)]
    got = {r["fold"]: r for r in moments.fits(rows, {name: NETS[name]}, moments.fold_frame(rows, folds), COLUMNS, "label", "n").collect()}
    for fold, a, z, *_ in folds:
        known = rows.where((F.col("n") >= a) & (F.col("n") < z)).na.drop()
        reg, mix = NETS[name]
        model = LinearRegression(regParam=reg, elasticNetParam=mix, maxIter=1000, tol=1e-12, solver="normal").fit(VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(known))
        assert np.allclose(got[fold]["coefficients"], model.coefficients.toArray(), atol=1e-6) and abs(got[fold]["intercept"] - model.intercept) < 1e-6


def test_errors_from_sums_equal_those_of_rows(rows):
    folds = moments.fold_frame(rows, [(0, 0, 30, 35, 50), (1, 0, 50, 55, 60)])
    fitted = moments.fits(rows, NETS, folds, COLUMNS, "label", "n")
    by_row = {(r["model"], r["fold"]): r["e"] for r in moments.scored(rows, fitted, COLUMNS, "n").groupBy("model", "fold").agg(F.avg((F.col("score") - F.col("label")) ** 2).alias("e")).collect()}
    tests = moments.span_sums(moments.date_sums(rows, COLUMNS, "label", "n"), folds.select("fold", F.col("test_start").alias("start"), F.col("test_end").alias("end")), 3)
    from_sums = fitted.select("fold", "model", "intercept", "coefficients").join(tests, "fold").select("model", "fold", moments.squared_error(tests, 3).alias("e"))
    assert len(by_row) == 10
    for r in from_sums.collect():
        assert abs(r["e"] - by_row[r["model"], r["fold"]]) < 1e-9


def test_spans_of_dates_with_gaps_and_without_rows(spark, rows):
    odd = rows.where("n % 3 = 0")
    spans = spark.createDataFrame([("whole", 0, 60), ("gap", 1, 3), ("one", 3, 4), ("late", 100, 120), ("early", -5, 0)], "name string, start long, end long")
    got = {r["name"]: (round(r["s_0_0"]), r["s_0_1"]) for r in moments.span_sums(moments.date_sums(odd, COLUMNS, "label", "n"), spans, 3).collect()}
    known = odd.na.drop().toPandas()
    for name, a, z in (("whole", 0, 60), ("gap", 1, 3), ("one", 3, 4), ("late", 100, 120), ("early", -5, 0)):
        part = known[(known.n >= a) & (known.n < z)]
        assert got[name][0] == len(part) and abs(got[name][1] - part.u.sum()) < 1e-9


def test_awkward_rows(spark, rows):
    flat = rows.withColumn("v", F.lit(2.0)).withColumn("label", F.when(F.col("n") > 5, F.col("label")))
    folds = moments.fold_frame(rows, [(0, 0, 5, 10, 20), (1, 0, 30, 35, 40)])
    got = {r["fold"]: r for r in moments.fits(flat, {"x": (0.01, 0.5)}, folds, COLUMNS, "label", "n").collect()}
    assert got[0]["intercept"] is None and got[1]["coefficients"][1] == 0 and np.isfinite(got[1]["intercept"])
    assert moments.scored(flat, moments.fits(flat, {"x": (0.01, 0.5)}, folds, COLUMNS, "label", "n"), COLUMNS, "n").where("fold = 0 AND score IS NOT NULL").count() == 0
    assert moments.fits(rows.limit(0), {"x": (0.0, 0.0)}, folds, COLUMNS, "label", "n").where("intercept IS NOT NULL").count() == 0


def test_a_grid_is_one_pass_whatever_its_size(spark, rows):
    """As many jobs for forty models as for one: none is started for a model or a fold."""
    folds = [(k, 0, 20 + 5 * k, 22 + 5 * k, 27 + 5 * k) for k in range(6)]
    seen = []
    for models in ({"a": (0.1, 0.5)}, {f"m{i}": (0.01 * i, i / 40) for i in range(40)}):
        spark.sparkContext.setJobGroup(f"grid{len(models)}", "")
        out = learn.grid_search(rows, models, folds, "n", F.avg(F.signum("score") * F.col("label")), COLUMNS).collect()
        assert len(out) == 6 * len(models)
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid{len(models)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[1] <= seen[0] + 2


def test_later_rows_do_not_change_a_fit(rows):
    folds = moments.fold_frame(rows, [(0, 0, 20, 25, 30)])
    a, b = (moments.fits(x, {"m": (0.01, 0.5)}, folds, COLUMNS, "label", "n").first() for x in (rows, rows.withColumn("label", F.when(F.col("n") < 20, F.col("label")).otherwise(9.0))))
    assert np.allclose(a["coefficients"], b["coefficients"], atol=1e-9)
