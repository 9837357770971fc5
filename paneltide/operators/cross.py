"""Cross-sections: scores, ranks and weights of all symbols on a date. Panels are long and dense (ts, symbol, close)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import log_return, rsi, sma
from ..functions.order import quantiles, running_quantile
from ..functions.windows import by_date, by_symbol, change, lag, ratio, rolling
from .sliding import distances

EPS = 1e-12


def zscore(x: Column, spec=None) -> Column:
    return (x - F.avg(x).over(spec or by_date())) / (F.stddev_samp(x).over(spec or by_date()) + EPS)


def pct_rank(x: Column, keys: tuple[str, ...] = ("ts",)) -> Column:
    """Rank over the number of values, ties at their mean rank; null for a null."""
    by = Window.partitionBy(*keys)
    rank = F.rank().over(by.orderBy(x.asc_nulls_last()))
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / 2) / F.count(x).over(by))


def momentum(panel: DataFrame, lookbacks: tuple[int, ...] = (252, 126), skip: int = 21) -> DataFrame:
    """Adds score: mean z-score of past returns that end `skip` rows ago; null unless all are there."""
    names = [f"__m{n}" for n in lookbacks]
    rows = panel.withColumns({c: ratio(lag(F.col("close"), skip), lag(F.col("close"), n)) - 1 for c, n in zip(names, lookbacks)})
    score = reduce(lambda a, b: a + b, (zscore(F.col(c)) for c in names)) / len(names)
    return rows.withColumn("score", score).drop(*names)


def reversal(panel: DataFrame, window: int = 5) -> DataFrame:
    """Adds reversal: z-score of the last `window` rows' return."""
    return panel.withColumn("__r", change(F.col("close"), window)).withColumn("reversal", zscore(F.col("__r"))).drop("__r")


def blend(scored: DataFrame, weight: float = 0.3) -> DataFrame:
    """score less its share of the reversal."""
    return scored.withColumn("blend", (1 - weight) * F.col("score") - weight * F.col("reversal"))


def top_k(scored: DataFrame, k: int, score: str = "score", keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The k best of each date, ties by name; adds rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "symbol")
    return scored.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cap_weights(w: Column, cap: float | Column, rounds: int = 20) -> Column:
    """Weights (an array) with the excess over `cap` given to those not over it in proportion, at most `rounds` times."""

    def step(x: Column, _: Column) -> Column:
        excess = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.greatest(v - cap, F.lit(0.0)))
        room = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.when(v > cap, 0.0).otherwise(v))
        return F.when(excess > 0, F.transform(x, lambda v: F.when(v > cap, cap if isinstance(cap, Column) else F.lit(cap)).otherwise(F.when(room > 0, v + excess * v / room).otherwise(v)))).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), w, step)


def inverse_vol(chosen: DataFrame, sd: str, cap: float | str = 0.3, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(keys, symbol, weight): weights of the chosen of each date by the inverse of their volatility, capped by a number or by a column."""
    cap = F.col(cap) if isinstance(cap, str) else F.lit(cap)
    lists = chosen.where(F.col(sd).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("symbol", (1 / (F.col(sd) + EPS)).alias("v")))).alias("s"), F.max(cap).alias("__cap"))  # top k names
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["v"])
    w = cap_weights(F.transform("s", lambda x: x["v"] / total), F.col("__cap"))
    return lists.select(*keys, F.explode(F.arrays_zip(F.col("s.symbol").alias("symbol"), w.alias("weight"))).alias("x")).select(*keys, "x.symbol", "x.weight")


def regime_gate(bench: DataFrame, n: int = 200, low: float = 0.5) -> DataFrame:
    """(ts, bench) with gate: 1 at or above the average of n rows or without it, else low."""
    by = Window.orderBy("ts")  # one series of dates
    return bench.withColumn("ma", rolling(F.avg, F.col("bench"), n, by)).withColumn("gate", F.when(F.col("ma").isNull() | (F.col("bench") >= F.col("ma")), 1.0).otherwise(low))


def book_vol(weighted: DataFrame, n: int, keys: tuple[str, ...] = ("run",)) -> Column:
    """Yearly volatility of the last n returns r of a run, null until there are n."""
    by = Window.partitionBy(*keys).orderBy("ts")
    return rolling(F.stddev_samp, F.col("r"), n, by) * 252**0.5


def vol_target(returns: DataFrame, target: float = 0.3, low: float = 0.2, high: float = 1.0, windows: tuple[int, ...] = (21, 63)) -> DataFrame:
    """(run, ts, r) with exposure: target over the larger volatility estimate, within bounds; the upper one where there is none."""
    worst = F.greatest(*(book_vol(returns, n) for n in windows))
    return returns.withColumn("estimate", worst).withColumn("exposure", F.when(F.col("estimate") > 0, F.least(F.greatest(target / F.col("estimate"), F.lit(low)), F.lit(high))).otherwise(high))


def no_trade_band(target: DataFrame, current: DataFrame, band: float) -> DataFrame:
    """(symbol, weight) twice: the current weight where the target is less than `band` away, else the target; none at or below 0."""
    t, c = target.select("symbol", F.col("weight").alias("t")), current.select("symbol", F.col("weight").alias("c"))
    both = t.join(c, "symbol", "full").select("symbol", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("c", F.lit(0.0)).alias("c"))
    return both.select("symbol", F.when(F.abs(F.col("t") - F.col("c")) < band, F.col("c")).otherwise(F.col("t")).alias("weight")).where("weight > 0")


#: Features of each symbol on a decision date.
FEATURES = ["ret_5", "ret_21", "ret_63", "mom_126", "mom_252", "vol_21", "vol_63", "sma_50", "sma_200", "rsi"]


def features(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """On schedule dates: features of each symbol as z-scores across the symbols that have them, and the percentile rank of the
    return to the next date, null on the last. Rows that lack a feature are left out, but count in the ranks."""
    c = F.col("close")
    rows = panel.withColumn("__r", change(c))
    raw = {
        "ret_5": change(c, 5), "ret_21": change(c, 21), "ret_63": change(c, 63), "mom_126": ratio(lag(c, 21), lag(c, 126)) - 1, "mom_252": ratio(lag(c, 21), lag(c, 252)) - 1,
        "vol_21": rolling(F.stddev_samp, F.col("__r"), 21), "vol_63": rolling(F.stddev_samp, F.col("__r"), 63), "sma_50": ratio(c, sma(c, 50)) - 1, "sma_200": ratio(c, sma(c, 200)) - 1, "rsi": rsi(14, c, eps=EPS),
    }
    rows = rows.withColumns(raw).join(schedule.select("ts").distinct(), "ts", "left_semi")
    rows = rows.withColumn("__next", ratio(F.lead(c).over(by_symbol()), c) - 1)
    return rows.select("ts", "symbol", *(zscore(F.col(k)).alias(k) for k in raw), pct_rank(F.col("__next")).alias("target")).na.drop(subset=list(raw))


def turbulence_gate(turbulence: DataFrame, q: float = 0.9) -> DataFrame:
    """(symbol, ts, x): per date the largest x, and whether it is over the q-quantile of all dates."""
    day = turbulence.groupBy("ts").agg(F.max("x").alias("x"))
    return day.join(F.broadcast(quantiles(day, [], "x", {"limit": q})), how="cross").select("ts", "x", (F.col("x") > F.col("limit")).alias("halt"))  # one row


def mahalanobis(panel: DataFrame, dates: DataFrame, window: int = 126, block: int = 64) -> DataFrame:
    """ts, turbulence: distance of a date's returns from those of the `window` dates before it, over symbols with all of them.

    Blocks of dates, each with the `window` dates before it, are worked on side by side: a task holds block + window rows of
    all symbols, and carries the inverse of their scatter from date to date (sliding.py).
    """
    import numpy as np
    import pandas as pd

    days = panel.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)  # one row a date
    days = days.join(dates.select("ts").distinct().withColumn("wanted", F.lit(True)), "ts", "left")
    rows = panel.withColumn("r", change(F.col("close"))).select("ts", "symbol", "r").join(days, "ts")
    first = F.floor(F.col("i") / block)
    rows = rows.select("*", F.explode(F.sequence(first, F.floor((F.col("i") + window) / block))).alias("block"))

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        wide = df.pivot(index="i", columns="symbol", values="r").sort_index()
        meta = df.drop_duplicates("i").set_index("i").sort_index()
        index, asked = wide.index.to_numpy(), meta["wanted"].to_numpy() == True  # noqa: E712
        at = np.flatnonzero((index >= max(key[0] * block, window)) & (index < (key[0] + 1) * block) & asked)
        return pd.DataFrame({"ts": meta["ts"].to_numpy()[at], "turbulence": pd.array(distances(wide.to_numpy(float), at, window), dtype="Float64")})

    return rows.groupBy("block").applyInPandas(run, f"ts {panel.schema['ts'].dataType.simpleString()}, turbulence double")


def rank_average(scored: DataFrame, base: str, other: str) -> DataFrame:
    """Adds blend: the mean of both percentile ranks, that of the base alone where the other is null."""
    a, b = pct_rank(F.col(base)), pct_rank(F.col(other))
    return scored.withColumns({"__a": a, "__b": b}).withColumn("blend", (F.col("__a") + F.coalesce("__b", "__a")) / 2).drop("__a", "__b")


def regime_score(series: DataFrame, n: int = 40, least: int = 52) -> DataFrame:
    """(ts, bench, bear, turbulence) with score: 1, 0.65 or 0.3 for none, one or more of: below the average of n rows, a bear
    state, turbulence over the 90th percentile of its past (once there are `least` values)."""
    by = Window.orderBy("ts")  # one series of dates
    rows = series.withColumn("ma", rolling(F.avg, F.col("bench"), n, by))
    rows = running_quantile(rows, [], "ts", "turbulence", 0.9, "limit", least)
    flags = [F.col("bench") < F.col("ma"), F.col("bear"), F.col("turbulence") > F.col("limit")]
    bad = reduce(lambda a, b: a + b, (F.coalesce(f.cast("int"), F.lit(0)) for f in flags))
    return rows.withColumn("score", F.when(bad == 0, 1.0).when(bad == 1, 0.65).otherwise(0.3))


def composite_exposure(target: Column, gate: Column, low: float = 0.1, high: float = 1.0) -> Column:
    """Product of the volatility target's exposure and the gate, within bounds."""
    return F.least(F.greatest(target * gate, F.lit(low)), F.lit(high))
