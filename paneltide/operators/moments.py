"""Linear models from sums of cross products by date: all folds and penalties of a grid in one pass over the rows.

What a linear model needs of its training rows are the sums of products of the features, the label and 1. These are added up for each date,
and over the dates before; the sums of any span of dates are the difference of two of these rows. Every fold and every penalty is then solved from
a few numbers, by coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sweeps of coordinate descent at most, and the change at which it ends.
SWEEPS, ENOUGH = 10_000, 1e-13


def names(k: int) -> list[str]:
    """Columns s_i_j: sums of z_i * z_j over the rows of z = (1, features, label)."""
    return [f"s_{i}_{j}" for i in range(k + 2) for j in range(i, k + 2)]


def date_sums(rows: DataFrame, columns: list[str], label: str, order: str) -> DataFrame:
    """order and the sums over the rows of each date that have all features and a label; a date without any has zeros."""
    z = [F.lit(1.0), *(F.col(c).cast("double") for c in [*columns, label])]
    known = F.lit(True)
    for x in z[1:]:
        known = known & x.isNotNull() & ~F.isnan(x)
    sums = [F.coalesce(F.sum(F.when(known, z[i] * z[j])), F.lit(0.0)).alias(f"s_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    return rows.groupBy(F.col(order).alias("n")).agg(*sums)


def span_sums(dates: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """spans (any columns, start, end) with the sums of the dates numbered start to end - 1: the difference of two running sums.

    A span that begins or ends between the numbers of dates has those that lie in it.
    """
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    running = dates.select("n", F.lead("n").over(Window.orderBy("n")).alias("next"), *(F.sum(c).over(before).alias(c) for c in names(k)))
    keys = spans.columns
    ends = spans.select(*keys, F.explode(F.array(F.struct((F.col("start") - 1).alias("at"), F.lit(-1.0).alias("sign")), F.struct((F.col("end") - 1).alias("at"), F.lit(1.0).alias("sign")))).alias("e")).select(*keys, "e.*")
    # the last date at or before the border; spans are few
    met = ends.join(running, (F.col("n") <= F.col("at")) & (F.col("next").isNull() | (F.col("next") > F.col("at"))), "left")
    return met.groupBy(*keys).agg(*(F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0.0)).alias(c) for c in names(k)))


def descend(sums: np.ndarray, reg: float, mix: float) -> np.ndarray:
    """Intercept and coefficients of the elastic net of the rows that the matrix of sums is of; nulls (NaN) where there are too few.

    The penalty is on coefficients of features in units of their deviation, its square part in units of the label's too, as in Spark ML.
    """
    k, n = len(sums) - 2, sums[0, 0]
    if n < 2:
        return np.full(k + 1, np.nan)
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    used = np.flatnonzero(scale[:k] > 1e-12 * np.maximum(1, np.abs(mean[:k])))
    out = np.zeros(k)
    if len(used) and scale[k] > 0:
        r = cov[np.ix_(used, used)] / np.outer(scale[used], scale[used])
        c, w = cov[used, k] / scale[used], np.zeros(len(used))
        flat, round_ = reg * mix, reg * (1 - mix) / scale[k]
        for _ in range(SWEEPS):
            most = 0.0
            for j in range(len(w)):
                part = c[j] - r[j] @ w + r[j, j] * w[j]
                new = np.sign(part) * max(abs(part) - flat, 0.0) / (r[j, j] + round_)
                most, w[j] = max(most, abs(new - w[j])), new
            if most < ENOUGH * max(1.0, np.abs(w).max()):
                break
        out[used] = w / scale[used]
    return np.append(mean[k] - out @ mean[:k], out)


def solve(sums: DataFrame, models: DataFrame, k: int) -> DataFrame:
    """The columns of sums but s_i_j, model, reg, mix, intercept and coefficients for every row of sums and model: both are few, each is a few numbers."""
    keys = [c for c in sums.columns if c not in names(k)]
    both = sums.crossJoin(models.select("model", "reg", "mix"))  # the fits asked for
    upper = np.triu_indices(k + 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            fits = []
            for s, reg, mix in zip(df[names(k)].to_numpy(float), df["reg"], df["mix"]):
                full = np.zeros((k + 2, k + 2))
                full[upper] = s
                fits.append(descend(full + np.triu(full, 1).T, reg, mix))
            fits = np.array(fits).reshape(len(df), k + 1)
            yield df[[*keys, "model", "reg", "mix"]].assign(intercept=fits[:, 0], coefficients=list(fits[:, 1:]))

    schema = both.select(*keys, "model", "reg", "mix").schema.add("intercept", "double").add("coefficients", T.ArrayType(T.DoubleType()))
    return both.mapInPandas(run, schema)


def predicted(columns: list[str]) -> Column:
    """Score of a row beside a model's intercept and coefficients; null without a fit."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    return F.nanvl(F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v), F.lit(None).cast("double"))


def fold_frame(rows: DataFrame, folds: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end (ends are outside)."""
    return rows.sparkSession.createDataFrame([tuple(map(int, f)) for f in folds], "fold long, train_start long, train_end long, test_start long, test_end long")


def fits(rows: DataFrame, models: dict[str, tuple[float, float]], folds: DataFrame, columns: list[str], label: str, order: str) -> DataFrame:
    """fold, test_start, test_end, model, reg, mix, intercept, coefficients: {model: (penalty, share of its absolute part)} on the training dates of all folds."""
    spans = folds.select("fold", "test_start", "test_end", F.col("train_start").alias("start"), F.col("train_end").alias("end"))
    table = rows.sparkSession.createDataFrame([(m, float(r), float(x)) for m, (r, x) in models.items()], "model string, reg double, mix double")
    return solve(span_sums(date_sums(rows, columns, label, order), spans, len(columns)), table, len(columns)).drop("start", "end")


def scored(rows: DataFrame, fitted: DataFrame, columns: list[str], order: str) -> DataFrame:
    """rows of the fold's test dates with model, fold and score, once for each model."""
    own = fitted.select("model", "fold", "intercept", "coefficients", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("__n"))
    return rows.join(own, F.col(order) == F.col("__n")).withColumn("score", predicted(columns)).drop("__n", "intercept", "coefficients")


def squared_error(sums: DataFrame, k: int) -> Column:
    """Mean squared error over the rows that s_i_j are of, beside intercept and coefficients: from the sums alone."""
    s = lambda i, j: F.col(f"s_{min(i, j)}_{max(i, j)}")
    w = [F.col("intercept"), *(F.get("coefficients", F.lit(i)) for i in range(k)), F.lit(-1.0)]
    total = F.lit(0.0)
    for i in range(k + 2):
        for j in range(k + 2):
            total = total + w[i] * w[j] * s(i, j)
    return F.try_divide(total, s(0, 0))
