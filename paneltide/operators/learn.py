"""Models on panels: training as Spark ML jobs on explicit rows, labels that are not known yet left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import change, rolling
from . import moments, trees


def assembled(columns: list[str], model, out: str = "features") -> Pipeline:
    """Columns to a vector, standardised on the training rows, then the model."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol=out, withMean=True), model])


def direction_model(kind: str, columns: list[str], seed: int = 7, **options) -> Pipeline:
    """A classifier of the next bar's direction: `gbt` boosted trees or `forest`."""
    make = {"gbt": GBTClassifier, "forest": RandomForestClassifier}[kind]
    return assembled(columns, make(featuresCol="features", labelCol="label", seed=seed, **options))


def return_model(kind: str, columns: list[str], seed: int = 7, **options) -> Pipeline:
    """A regression of the next return: `net` (elastic net) or `gbt`."""
    if kind == "net":
        return assembled(columns, LinearRegression(featuresCol="features", labelCol="label", elasticNetParam=0.5, regParam=options.pop("regParam", 0.01), **options))
    return assembled(columns, GBTRegressor(featuresCol="features", labelCol="label", seed=seed, **options))


def fit_predict(rows: DataFrame, pipeline: Pipeline, train: str = "test_mask = 0", test: str = "test_mask = 1") -> DataFrame:
    """Predictions of test rows by a model of the training rows whose label is known; clean.split_dates() keeps a gap between the two."""
    model = pipeline.fit(rows.where(train).where("label IS NOT NULL"))
    out = model.transform(rows.where(test))
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    else:
        out = out.withColumnRenamed("prediction", "score")
    return out.drop("__raw", "features", "rawPrediction", "probability", "prediction")


def class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: for label 1 the number of zeros over that of ones, else 1."""
    n = rows.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    return rows.join(F.broadcast(n), how="cross").withColumn("weight", F.when(F.col(label) == 1, F.try_divide("n0", "n1")).otherwise(1.0)).drop("n0", "n1")  # one row


#: Edges of the bins of features that are in units of their deviation.
EDGES = [i / 8 for i in range(-16, 17)]


def refit_members(panel: DataFrame, dates: list, columns: list[str], every: int, least_dates: int) -> DataFrame:
    """Members (model, row, bins, target, weight, tested) of the refits of walk_forward_ranker()."""
    at = panel.sparkSession.createDataFrame(list(enumerate(dates)), f"at int, ts {panel.schema['ts'].dataType.simpleString()}")  # the schedule
    rows = panel.join(at, "ts").select("at", F.struct("ts", "symbol").alias("row"), trees.binned(columns, EDGES).alias("bins"), F.col("target").cast("double").alias("target"))
    return trees.refits(rows, least_dates + 1, every, len(dates) - 1).drop("at")


def walk_forward_ranker(panel: DataFrame, dates: list, columns: list[str], every: int = 4, least_dates: int = 104) -> DataFrame:
    """(ts, symbol, score): at each refit date boosted trees for `target` on rows of earlier dates whose target was known, used until the next.

    `dates` are the schedule's dates in order; the target of a date is known at the next one. All refits grow side by side.
    """
    scored, _ = trees.boosted(refit_members(panel, dates, columns, every, least_dates))
    return scored.where("tested").select("row.*", "score")


def bagged(rows: DataFrame, columns: list[str], edges: list[float], key: list[str], n: int = 5, fraction: float = 0.8) -> DataFrame:
    """(key, score): mean score of n boosted models for test rows, each of a bootstrap sample of the training rows. All bags grow side by side."""
    test = F.col("test_mask") == 1
    used = rows.where("test_mask IS NOT NULL").select(F.struct(*key).alias("row"), trees.binned(columns, edges).alias("bins"), F.col("label").cast("double").alias("target"), (~test).cast("double").alias("weight"), test.alias("tested"))
    scored, _ = trees.boosted(trees.bags(used, n, fraction, ["row"]))
    return scored.where("tested").groupBy("row").agg(F.avg("score").alias("score")).select("row.*", "score")


def grid_search(rows: DataFrame, models: dict[str, tuple[float, float]], folds: list[tuple[int, int, int, int, int]], order: str, metric, columns: list[str] | None = None) -> DataFrame:
    """(model, fold, value): every elastic net {name: (penalty, share of its absolute part)} on every forward fold, in one job.

    rows have a date number `order`, features and a label; metric gives one value of scored rows.
    """
    columns = columns or [c for c in rows.columns if c not in ("symbol", "ts", "label", "fwd", "test_mask", order)]
    fitted = moments.fits(rows, models, moments.fold_frame(rows, folds), columns, "label", order)
    return moments.scored(rows, fitted, columns, order).groupBy("model", "fold").agg(metric.alias("value"))


def two_components(x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and covariances of a mixture of two Gaussians, by expectation and maximisation from calm and wild rows (last column)."""
    own = np.stack([x[:, -1] <= np.median(x[:, -1]), x[:, -1] > np.median(x[:, -1])], 1).astype(float)
    for _ in range(rounds):
        n = own.sum(0) + 1e-9
        mean = own.T @ x / n[:, None]
        cov = np.stack([(own[:, [k]] * (x - mean[k])).T @ (x - mean[k]) / n[k] + 1e-6 * np.eye(x.shape[1]) for k in range(2)])
        own = _belongs(x, n / n.sum(), mean, cov)
    return n / n.sum(), mean, cov


def _belongs(x: np.ndarray, share: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    logs = np.stack([np.log(share[k]) - 0.5 * (np.linalg.slogdet(cov[k])[1] + np.einsum("ij,ij->i", (x - mean[k]) @ np.linalg.inv(cov[k]), x - mean[k])) for k in range(2)], 1)
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sums(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Expected sums of products of 1 and the columns, for both components."""
    z = np.column_stack([np.ones(len(x)), x])
    return np.einsum("ik,ij,il->kjl", own, z, z)


def _mixture(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, means and covariances from expected sums."""
    n = sums[:, 0, 0] + 1e-9
    mean = sums[:, 0, 1:] / n[:, None]
    cov = sums[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    return n / n.sum(), mean, cov + 1e-6 * np.eye(mean.shape[1])


#: Rounds of expectation and maximisation over a block when its rows come in.
ROUNDS = 3


def bear_state(bench: DataFrame, every: int = 63, least: int = 504) -> DataFrame:
    """ts, ret, vol, bear of a series (ts, bench): whether a date belongs to the component with the lower mean return of a mixture of
    two Gaussians over return and 21-day volatility, fitted on the dates before its block of `every` dates.

    The first `least` dates have no state; they are fitted together and set the units. From then on only expected sums are carried: a
    block gets its states from the mixture so far, then goes through a few rounds of expectation and maximisation beside the sums of all
    before it, and its own sums are added. So each row is read once, whatever the length of the series, a task holds a batch and a
    block, and later dates change no state. Rows without return or volatility are left out.
    """
    by = Window.orderBy("ts")  # one series of dates
    rows = bench.withColumn("ret", change(F.col("bench"), 1, by)).withColumn("vol", rolling(F.stddev_samp, F.col("ret"), 21, by)).na.drop(subset=["ret", "vol"])
    rows = rows.select("ts", "ret", "vol").repartition(1).sortWithinPartitions("ts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = pd.DataFrame(columns=["ts", "ret", "vol"]), None
        for batch in batches:
            held = pd.concat([held, batch]) if len(held) else batch
            if sums is None and len(held) >= least:
                x = held[["ret", "vol"]].to_numpy(float)[:least]
                mean, scale = x.mean(0), x.std(0, ddof=1) + 1e-12
                x = (x - mean) / scale
                sums, held = _sums(x, _belongs(x, *two_components(x))), held.iloc[least:]
            while sums is not None and len(held) >= every:
                block, held = held.iloc[:every], held.iloc[every:]
                x = (block[["ret", "vol"]].to_numpy(float) - mean) / scale
                model = _mixture(sums)
                own = _belongs(x, *model)
                yield block.assign(bear=own.argmax(1) == int(model[1][1, 0] < model[1][0, 0]))
                for _ in range(ROUNDS):
                    own = _belongs(x, *_mixture(sums + _sums(x, own)))
                sums = sums + _sums(x, own)
        if sums is not None and len(held):
            model = _mixture(sums)
            own = _belongs((held[["ret", "vol"]].to_numpy(float) - mean) / scale, *model)
            yield held.assign(bear=own.argmax(1) == int(model[1][1, 0] < model[1][0, 0]))

    return rows.mapInPandas(run, f"ts {bench.schema['ts'].dataType.simpleString()}, ret double, vol double, bear boolean")


def fit_folds(rows: DataFrame, folds: DataFrame, columns: list[str], label: str = "label", ridge: float = 0.0) -> DataFrame:
    """(run, ts, n, fold, score): predictions of each fold's test rows by a linear model of its training rows, stitched together.

    rows are (run, ts, n, ...) numbered from 0 in each run, folds as of fold_table(): training rows are slice_start to train_end, so
    that labels that reach over the border are left out; with short test spans and a fixed slice it is a model that is fitted again every
    few bars. A fold's rows are a group: the length of its slice, whatever the number of runs.
    """
    spans = folds.withColumnRenamed("run", "__run")
    train = (F.col("n") >= F.col("slice_start")) & (F.col("n") < F.col("train_end"))
    test = (F.col("n") >= F.col("test_start")) & (F.col("n") < F.col("test_end"))
    used = rows.join(spans, (F.col("run") == F.col("__run")) & (train | test)).select("run", "ts", "n", "fold", *(F.col(c).cast("double").alias(c) for c in columns), F.col(label).cast("double").alias("__y"), test.alias("__test"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        known = df[~df["__test"]].dropna(subset=[*columns, "__y"])
        rest = df[df["__test"]].sort_values("n")
        out = rest[["run", "ts", "n", "fold"]].assign(score=np.nan)
        if len(known) > len(columns):
            x = known[columns].to_numpy()
            mean, scale = x.mean(0), x.std(0) + 1e-12
            a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
            w = np.linalg.lstsq(a.T @ a + ridge * np.diag([0.0] + [1.0] * len(columns)), a.T @ known["__y"].to_numpy(), rcond=None)[0]
            out["score"] = np.column_stack([np.ones(len(rest)), (rest[columns].to_numpy() - mean) / scale]) @ w
        return out

    kind = rows.schema["ts"].dataType.simpleString()
    return used.groupBy("run", "fold").applyInPandas(run, f"run string, ts {kind}, n long, fold long, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def best_features(rows: DataFrame, columns: list[str], k: int) -> list[str]:
    """The k columns with the largest F-scores against a 0/1 label."""
    v = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(rows.where("label IS NOT NULL"))
    selector = UnivariateFeatureSelector(featuresCol="__x", labelCol="label", outputCol="__y", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return [columns[i] for i in selector.fit(v).selectedFeatures]


def eliminate(rows: DataFrame, pipeline_of, columns: list[str], keep: int) -> list[str]:
    """Columns left when the least important one of a tree model goes, again and again."""
    columns = list(columns)
    while len(columns) > keep:
        model = pipeline_of(columns).fit(rows.where("label IS NOT NULL"))
        weights = model.stages[-1].featureImportances
        columns.pop(min(range(len(columns)), key=lambda i: weights[i]))
    return columns
