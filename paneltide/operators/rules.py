"""Rule positions: 0/1 columns over (symbol, ts, ...), and the machines that need a fold over a symbol's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import atr, bollinger, ma_angle, macd, sma
from ..functions.machine import machine
from ..functions.windows import by_symbol, held, lag


def signal(position: Column) -> Column:
    """Change of the position, 0 on the first row, within -1 and 1."""
    return F.greatest(F.lit(-1), F.least(F.lit(1), F.coalesce(position - lag(position), F.lit(0))))


def buy_and_hold(df: DataFrame) -> DataFrame:
    n, all_ = F.row_number().over(by_symbol()), F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumn("position", ((n > 1) & (n < all_)).cast("int"))


def bollinger_reversion(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Long from a close below the lower band until one at or above the middle."""
    b = bollinger(n, k)
    rows = df.withColumns({"mid": b["mid"], "lower": b["lower"]})
    return rows.withColumn("position", held(F.col("close") < F.col("lower"), F.col("close") >= F.col("mid")))


def macd_cross(df: DataFrame, zero_filter: bool = True, k: int = 3) -> DataFrame:
    """Long from the line's crossing above its signal with a rising histogram (both above 0), until the mirror image."""
    rows = macd(df, k=k)
    m, s, d = F.col("macd"), F.col("macd_signal"), F.col("hist_change")
    up, down = (m > s) & (lag(m) <= lag(s)) & (d > 0), (m < s) & (lag(m) >= lag(s)) & (d < 0)
    if zero_filter:
        up, down = up & (m > 0) & (s > 0), down & (m < 0) & (s < 0)
    return rows.withColumn("position", held(up, down))


def ma_cross(df: DataFrame, short: int = 10, long: int = 30, angle: float = 0.0, vol: float = 0.0, causal: bool = True) -> DataFrame:
    """Long from short over long average with an angle and range above thresholds, until the mirror image."""
    rows = df.withColumns({"short": sma(F.col("close"), short), "long": sma(F.col("close"), long), "angle": ma_angle(short, long, causal), "range": atr(14) / F.col("close")})
    above = F.coalesce(F.col("short") > F.col("long"), F.lit(False))
    wide = F.col("range") > vol
    return rows.withColumn("position", held(above & (F.col("angle") >= angle) & wide, ~above & (F.col("angle") <= -angle) & wide))


def at_least(score: Column, threshold: float) -> Column:
    """Position of a probability with one threshold for entry and exit; the last known one where it is null."""
    raw = F.when(score.isNotNull(), (score >= threshold).cast("int"))
    return F.coalesce(F.last(raw, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), F.first(raw, ignorenulls=True).over(by_symbol().rowsBetween(0, Window.unboundedFollowing)), F.lit(0))


def filtered(df: DataFrame, raw: Column, allowed: Column) -> DataFrame:
    """position: the raw 0/1 position of the last bar on which a change was allowed, 0 before the first."""
    return df.withColumn("position", held(allowed & (raw == 1), allowed & (raw == 0)))


def long_top(df: DataFrame, score: Column, k: int) -> DataFrame:
    """position 1 for the k symbols of each date with the highest score (ties by name), else 0; a null score is never held."""
    rank = F.row_number().over(Window.partitionBy("ts").orderBy(score.desc_nulls_last(), "symbol"))
    return df.withColumn("position", (score.isNotNull() & (rank <= k)).cast("int"))


def hold_step(signal: float | None, days_left: int, position: int, threshold: float, horizon: int) -> tuple[int, int]:
    """One bar of the minimum-holding-period machine: days left and position after it."""
    value = 0.0 if signal is None or signal != signal else signal
    if days_left > 0:
        return days_left - 1 + (value >= threshold), position
    if position == 0 and value > threshold:
        return horizon - 1, 1
    if position == 1 and value <= 0:
        return 0, 0
    return 0, position


def holding_period(df: DataFrame, signal: str, threshold: float, horizon: int) -> DataFrame:
    """symbol, ts, position of the minimum-holding-period machine: state 0 is flat, 1 + n is held with n days left."""

    def step(state: Column, value: Column) -> Column:
        v = F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
        return F.when(state > 1, state - 1 + (v >= threshold).cast("int")).when((state == 0) & (v > threshold), F.lit(max(1, horizon))).when((state == 1) & (v <= 0), F.lit(0)).otherwise(state)

    rows = machine(df, ["symbol"], F.col(signal).cast("double"), max(1, horizon) + 1, step)
    return rows.select("symbol", "ts", (F.col("state") > 0).cast("int").alias("position"))


def pair_positions(zscores: DataFrame, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """(symbol_1, symbol_2, ts, z) to the pair's state: long, flat or short the first; one change in a bar."""

    def step(state: Column, value: Column) -> Column:
        z = F.nanvl(value, F.lit(None).cast("double"))  # states 0, 1 and 2 are short, flat and long
        return F.when(z.isNull(), state).when(state == 1, F.when(z > enter, 0).when(z < -enter, 2).otherwise(1)).when(((state == 2) & (z > -leave)) | ((state == 0) & (z < leave)), F.lit(1)).otherwise(state)

    rows = machine(zscores, ["symbol_1", "symbol_2"], F.col("z").cast("double"), 3, step, start=1)
    return rows.select("symbol_1", "symbol_2", "ts", F.col("value").alias("z"), (F.col("state") - 1).alias("state"))


def pair_legs(states: DataFrame) -> DataFrame:
    """Position of each symbol over all its pairs, within -1 and 1."""
    legs = states.select(F.col("symbol_1").alias("symbol"), "ts", "state").union(states.select("symbol_2", "ts", -F.col("state")))
    return legs.groupBy("symbol", "ts").agg(F.greatest(F.lit(-1), F.least(F.lit(1), F.sum("state"))).cast("int").alias("position"))


def trade_events(df: DataFrame) -> DataFrame:
    """Rows on which the position changes, with what happens: entry, exit, short or cover."""
    s, p = F.col("signal"), F.col("position")
    label = F.when((s > 0) & (p > 0), "entry").when((s < 0) & (p == 0), "exit").when((s < 0) & (p < 0), "short").when((s > 0) & (p == 0), "cover")
    return df.where("signal <> 0").withColumn("event", label)


def poll_decision(position: Column, previous: Column, days_left: Column) -> Column:
    """What a polling trader does: buy, sell or hold."""
    return F.when((position == 1) & (previous == 0), "buy").when((position == 0) & (previous == 1) & (days_left <= 0), "sell").otherwise("hold")
