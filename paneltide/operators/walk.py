"""Walk-forward portfolios as runs of one job: scores, selection, sizing, exposure and a no-trade band, each of which can be replaced."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import change, lag, ratio, rolling
from ..sources.store import stored
from . import backtest, clean, cross

#: From (run, ts, symbol, score, sd, k, cap) the rows that are held; from weights (run, ts, symbol, weight) the exposure (run, ts, exposure).
Selector = Callable[[DataFrame], DataFrame]
Exposure = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    """What one run does; `weekday` None decides on the last date of each week, else on the last up to that weekday."""

    run: str
    k: int = 5
    lookbacks: tuple[int, ...] = (252, 126)
    skip: int = 21
    vol: int = 63
    cap: float = 0.3
    ma: int = 200
    low: float = 0.5
    weekday: int | None = None
    reversal: float = 0.0


def warmup(configs: list[Config]) -> int:
    """Rows before the first decision, the same for all runs, so that they are compared on the same dates."""
    return max(max(max(c.lookbacks) + c.skip, c.ma) for c in configs) + 5


def scored(panel: DataFrame, configs: list[Config], first_row: int = 0) -> DataFrame:
    """(run, ts, symbol, score, sd, k, cap) on each run's decision dates from row `first_row` of the dates on; scores of all runs come from one pass over the panel."""
    c = F.col("close")
    moms = sorted({(c.skip, n) for c in configs for n in c.lookbacks})
    rows = panel.withColumns({"__r": change(c), "__rev": change(c, 5), **{f"__m{s}_{n}": ratio(lag(c, s), lag(c, n)) - 1 for s, n in moms}})
    rows = rows.withColumns({f"__sd{v}": rolling(F.stddev_samp, F.col("__r"), v) for v in sorted({c.vol for c in configs})})
    dates = panel.select("ts").distinct().withColumn("__i", F.row_number().over(Window.orderBy("ts")) - 1)  # one row a date
    days = dates.where(F.col("__i") >= first_row).select("ts")
    schedules = None
    for w in sorted({c.weekday for c in configs}, key=str):
        # weeks as they are, not as the first row cuts them
        one = clean.weekly_schedule(dates, w).join(days, "ts", "left_semi").select("ts", F.array(*(F.lit(c.run) for c in configs if c.weekday == w)).alias("__runs"))
        schedules = one if schedules is None else schedules.unionByName(one)
    schedules = schedules.groupBy("ts").agg(F.flatten(F.collect_list("__runs")).alias("__runs"))
    rows = rows.join(schedules, "ts")
    z = lambda x: cross.zscore(F.col(x))
    rows = rows.withColumns({"__zrev": z("__rev"), **{f"__z{s}_{n}": z(f"__m{s}_{n}") for s, n in moms}})

    def row(c: Config):
        score = sum((F.col(f"__z{c.skip}_{n}") for n in c.lookbacks[1:]), F.col(f"__z{c.skip}_{c.lookbacks[0]}")) / len(c.lookbacks)
        if c.reversal:
            score = (1 - c.reversal) * score - c.reversal * F.col("__zrev")
        return F.struct(F.lit(c.run).alias("run"), score.alias("score"), F.col(f"__sd{c.vol}").alias("sd"), F.lit(c.k).alias("k"), F.lit(c.cap).alias("cap"))

    rows = rows.where("close IS NOT NULL").select("ts", "symbol", "__runs", F.explode(F.array(*map(row, configs))).alias("x"))
    return rows.where(F.array_contains("__runs", F.col("x.run"))).select("ts", "symbol", "x.*").where("score IS NOT NULL AND sd IS NOT NULL")


def best(rows: DataFrame) -> DataFrame:
    """The k best of each decision, ties by name."""
    rank = F.row_number().over(Window.partitionBy("run", "ts").orderBy(F.col("score").desc(), "symbol"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.col("k"))


def buffered(buffer: float, k: int) -> Selector:
    """Keeps incumbents ranked within ceil(buffer * k), fills up with the best."""

    def select(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("run", "ts").orderBy(F.col("score").desc(), "symbol"))
        return rows.join(backtest.buffered(rows.withColumn("rank", rank), k, buffer), ["run", "ts", "symbol"])

    return select


def random_names(seeds: int) -> Selector:
    """For each of `seeds` runs k names of each decision at random; the run's own names stay beside them."""

    def select(rows: DataFrame) -> DataFrame:
        names = rows.groupBy("ts").agg(F.max("k").alias("__most"), F.collect_list(F.struct(*(c for c in rows.columns if c not in ("run", "ts")))).alias("__names"))  # all names of a date
        runs = names.withColumn("run", F.explode(F.transform(F.sequence(F.lit(1), F.lit(seeds)), lambda x: F.concat(F.lit("seed "), x.cast("string")))))
        order = F.array_sort(F.transform("__names", lambda x: F.struct(backtest.draw("run", "ts", x["symbol"]).alias("draw"), x.alias("row"))))
        drawn = runs.select("run", "ts", F.posexplode(F.slice(order, 1, F.col("__most"))).alias("__at", "x")).select("run", "ts", "x.row.*", (F.col("__at") + 1).alias("rank"))
        return best(rows).unionByName(drawn.where(F.col("rank") <= F.col("k")))

    return select


def gate(bench: DataFrame, configs: list[Config]) -> Exposure:
    """1 while the benchmark is at or above its average, else the run's low exposure; a run that is not configured is like the first."""
    by = Window.orderBy("ts")  # one series of dates
    ma = {n: rolling(F.avg, F.col("bench"), n, by) for n in {c.ma for c in configs}}
    rule = lambda c: F.when(ma[c.ma].isNull() | (F.col("bench") >= ma[c.ma]), 1.0).otherwise(c.low)
    names = F.array(*(F.struct(F.lit(c.run).alias("run"), rule(c).alias("exposure")) for c in configs))
    table = bench.select("ts", names.alias("x"))

    def expose(weights: DataFrame) -> DataFrame:
        known = F.filter("x", lambda e: e["run"] == F.col("run"))
        value = F.when(F.size(known) > 0, known[0]["exposure"]).otherwise(F.col("x")[0]["exposure"])
        return weights.select("run", "ts").distinct().join(table, "ts", "left").select("run", "ts", F.coalesce(value, F.lit(1.0)).alias("exposure"))

    return expose


def book_risk(panel: DataFrame, weights: DataFrame, windows: tuple[int, ...] = (21, 63)) -> DataFrame:
    """(run, ts, risk_n ...): yearly volatility of each decided book, fully invested, over the last n returns of its names.

    That of w'r is the root of w' S w over the covariance S of these returns. Null unless all names have all n returns.
    """
    size = max(windows)
    days = panel.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)  # one row a date
    returns = panel.select("ts", "symbol", change(F.col("close")).alias("r")).join(days, "ts").select("symbol", "r", F.col("i").alias("j"), F.floor(F.col("i") / size).alias("block"))
    w = F.col("weight") / F.sum("weight").over(Window.partitionBy("run", "ts"))
    held = weights.select("run", "ts", "symbol", w.alias("w")).join(days, "ts").withColumn("block", F.explode(F.array(F.floor(F.col("i") / size), F.floor(F.col("i") / size) - 1)))
    inside = held.join(returns, ["symbol", "block"]).where((F.col("j") <= F.col("i")) & (F.col("j") > F.col("i") - size))
    names = weights.groupBy("run", "ts").agg(F.count(F.lit(1)).alias("names"))
    daily = inside.groupBy("run", "ts", "i", "j").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count("r").alias("n")).join(names, ["run", "ts"])
    daily = daily.withColumn("r", F.when(F.col("n") == F.col("names"), F.col("r")))
    near = lambda n: F.when(F.col("j") > F.col("i") - n, F.col("r"))
    risk = [F.when(F.count(near(n)) == n, F.stddev_samp(near(n)) * 252**0.5).alias(f"risk_{n}") for n in windows]
    return daily.groupBy("run", "ts").agg(*risk)


def vol_target(panel: DataFrame, target: float, windows: tuple[int, ...] = (21, 63), low: float = 0.0, high: float = 1.0) -> Exposure:
    """Target over the larger estimate of the book's volatility, within bounds; the upper one where there is no estimate."""

    def expose(weights: DataFrame) -> DataFrame:
        worst = F.array_max(F.array(*(F.col(f"risk_{n}") for n in windows)))
        value = F.when(worst > 0, F.least(F.greatest(target / worst, F.lit(low)), F.lit(high))).otherwise(high)
        risk = book_risk(panel, weights, windows)
        return weights.select("run", "ts").distinct().join(risk, ["run", "ts"], "left").select("run", "ts", value.alias("exposure"))

    return expose


def combined(*exposures: Exposure) -> Exposure:
    """The product of several."""

    def expose(weights: DataFrame) -> DataFrame:
        out = weights.select("run", "ts").distinct().withColumn("exposure", F.lit(1.0))
        for e in exposures:
            out = out.join(e(weights).withColumnRenamed("exposure", "__e"), ["run", "ts"]).select("run", "ts", (F.col("exposure") * F.col("__e")).alias("exposure"))
        return out

    return expose


def with_learned(rows: DataFrame, learned: DataFrame, weight: float) -> DataFrame:
    """scored rows whose score is the mean of percentile ranks of the score and of a learned one (ts, symbol, learned), the former alone where that is null."""
    both = rows.join(learned.select("ts", "symbol", "learned"), ["ts", "symbol"], "left")
    keys = ("run", "ts")
    a, b = cross.pct_rank(F.col("score"), keys), cross.pct_rank(F.col("learned"), keys)
    both = both.withColumns({"__a": a, "__b": b})
    return both.withColumn("score", (1 - weight) * F.col("__a") + weight * F.coalesce("__b", "__a")).drop("__a", "__b", "learned")


def banded(weights: DataFrame, band: float) -> DataFrame:
    """Weights of each decision after those were left alone that change by less than `band`; each symbol of a run is a sorted stream of decisions."""
    decisions = weights.select("run", "ts").distinct()
    grid = decisions.join(weights.select("run", "symbol").distinct(), "run")
    first = Window.partitionBy("run").orderBy("ts")
    rows = grid.join(weights, ["run", "ts", "symbol"], "left").join(decisions.withColumn("first", F.row_number().over(first) == 1), ["run", "ts"])
    rows = rows.select("run", "symbol", "ts", F.coalesce("weight", F.lit(0.0)).alias("weight"), "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, 0.0
        for batch in batches:
            out = []
            for r, s, target, start in zip(batch["run"], batch["symbol"], batch["weight"], batch["first"]):
                if (r, s) != key:
                    key, now = (r, s), 0.0
                now = target if start or abs(target - now) >= band else now
                out.append(now)
            yield batch[["run", "ts", "symbol"]].assign(weight=out)

    kind = weights.schema["ts"].dataType.simpleString()
    dealt = rows.repartition("run", "symbol").sortWithinPartitions("run", "symbol", "ts")
    return dealt.mapInPandas(run, f"run string, ts {kind}, symbol string, weight double").where("weight > 0")


def weights(rows: DataFrame, selector: Selector = best, exposure: Exposure | None = None, band: float = 0.0) -> DataFrame:
    """(run, ts, symbol, weight) of scored rows: selection, inverse volatility with the run's cap, exposure, band."""
    out = cross.inverse_vol(selector(rows), "sd", "cap", ("run", "ts"))
    if exposure is not None:
        out = stored(out, "sized")
        out = out.join(exposure(out), ["run", "ts"]).select("run", "ts", "symbol", (F.col("weight") * F.col("exposure")).alias("weight"))
    return banded(stored(out, "targets"), band) if band > 0 else out


def performance(daily: DataFrame) -> DataFrame:
    """Per run of a portfolio: days, Sharpe ratio, yearly turnover and mean exposure."""
    r = F.col("r")
    return daily.groupBy("run").agg(F.count(r).alias("days"), (ratio(F.avg(r), F.stddev_samp(r)) * 252**0.5).alias("sharpe"), (F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))) * 52).alias("turnover"), F.avg("exposure").alias("exposure"))
