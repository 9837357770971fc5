"""Technical indicators as columns over (symbol, ts, open, high, low, close, volume); those with an exponential average take the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ema import ema, wilder
from .windows import by_symbol, change, lag, ratio, rolling, running, trailing


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg, x, n)


def rolling_std(x: Column, n: int) -> Column:
    return rolling(F.stddev_samp, x, n)


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(F.col("close"), n), rolling_std(F.col("close"), n)
    return {"mid": mid, "upper": mid + k * sd, "lower": mid - k * sd}


def rsi(n: int = 14, x: Column | None = None, eps: float = 0.0) -> Column:
    """Relative strength from simple means of gains and losses: 100 without losses; with `eps` the loss is guarded instead."""
    x = F.col("close") if x is None else x
    d = x - lag(x)
    known = lambda v: F.when(d.isNotNull(), F.greatest(v, F.lit(0.0)))
    up, down = sma(known(d), n), sma(known(-d), n)
    if eps:
        return 100 - 100 / (1 + up / (down + eps))
    return F.when(down == 0, F.when(up > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(up, down)))


def true_range() -> Column:
    before = lag(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(n: int = 14) -> Column:
    return rolling(F.avg, true_range(), n)


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Adds plus_di, minus_di, adx; all averages are Wilder's."""
    up, down = F.col("high") - lag(F.col("high")), lag(F.col("low")) - F.col("low")
    rows = df.withColumns({"__tr": true_range(), "__p": F.when((up > down) & (up > 0), up).otherwise(0.0), "__m": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    for name in ("__tr", "__p", "__m"):
        rows = wilder(rows, f"{name}_s", F.col(name), n)
    rows = rows.withColumns({"plus_di": 100 * ratio(F.col("__p_s"), F.col("__tr_s")), "minus_di": 100 * ratio(F.col("__m_s"), F.col("__tr_s"))})
    dx = F.coalesce(100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.lit(0.0))
    return wilder(rows.withColumn("__dx", dx), "adx", F.col("__dx"), n).drop("__tr", "__p", "__m", "__tr_s", "__p_s", "__m_s", "__dx")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, k: int = 3) -> DataFrame:
    """Adds macd, macd_signal, macd_hist and hist_change over k bars."""
    rows = ema(ema(df, "__fast", F.col("close"), span=fast), "__slow", F.col("close"), span=slow).withColumn("macd", F.col("__fast") - F.col("__slow"))
    rows = ema(rows, "macd_signal", F.col("macd"), span=signal).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return rows.withColumn("hist_change", F.col("macd_hist") - lag(F.col("macd_hist"), k)).drop("__fast", "__slow")


def obv() -> Column:
    """Running sum of volume signed by the close's change."""
    return F.sum(F.coalesce(F.signum(F.col("close") - lag(F.col("close"))), F.lit(0.0)) * F.col("volume")).over(running())


def stochastic(n: int = 14, d: int = 3) -> dict[str, Column]:
    low, high = rolling(F.min, F.col("low"), n), rolling(F.max, F.col("high"), n)
    return {"stoch_k": 100 * ratio(F.col("close") - low, high - low)}


def cci(n: int = 10) -> Column:
    """Distance of the typical price from its mean in units of 0.015 mean absolute deviations."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    mean, values = sma(tp, n), F.collect_list(tp).over(trailing(n))
    mad = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / n
    return ratio(tp - mean, 0.015 * mad)


def ichimoku(conversion: int = 9, base: int = 26, span: int = 52) -> dict[str, Column]:
    mid = lambda n: (rolling(F.max, F.col("high"), n) + rolling(F.min, F.col("low"), n)) / 2
    return {"conversion": mid(conversion), "base": mid(base), "lead_a": (mid(conversion) + mid(base)) / 2, "lead_b": mid(span)}


def skewness(x: Column, n: int) -> Column:
    """Sample skewness without bias, as the population's times G1."""
    return rolling(F.skewness, x, n) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurtosis(x: Column, n: int) -> Column:
    """Sample excess kurtosis without bias."""
    return ((n + 1) * rolling(F.kurtosis, x, n) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def anchored_vwap() -> Column:
    return ratio(F.sum(F.col("close") * F.col("volume")).over(running()), F.sum(F.col("volume")).over(running()))


def rolling_vwap(n: int) -> Column:
    return ratio(rolling(F.sum, F.col("close") * F.col("volume"), n), rolling(F.sum, F.col("volume"), n))


def log_return(n: int = 1, x: Column | None = None) -> Column:
    x = F.col("close") if x is None else x
    return F.ln(ratio(x, lag(x, n)))


def turbulence(n: int = 252, r: Column | None = None) -> Column:
    """Squared distance of a log return from the mean of the n before it in units of their variance; 0 where there are fewer."""
    r = log_return() if r is None else r
    before = by_symbol().rowsBetween(-n, -1)
    var = F.var_samp(r).over(before)
    value = F.coalesce(ratio(F.pow(r - F.avg(r).over(before), 2), var), F.lit(0.0))
    return F.when(r.isNotNull(), F.when(F.count(r).over(before) < n, 0.0).otherwise(value))


def threshold(vol: Column, base: float = 0.5, shift: float = 0.1, n: int = 20) -> Column:
    """A threshold that moves with the latest volatility against its mean, within 0 and 1."""
    z = (rolling(F.stddev_samp, vol, n // 2) - rolling(F.avg, vol, n)) / (rolling(F.stddev_samp, vol, n) + 1e-8)
    return F.coalesce(F.least(F.greatest(base + shift * F.tanh(z), F.lit(0.0)), F.lit(1.0)), F.lit(base))


def ma_angle(short: int, long: int, causal: bool = False) -> Column:
    """Angle of the distance of two averages over their mean distance: of the whole series, or (causal) of the past."""
    d = sma(F.col("close"), short) - sma(F.col("close"), long)
    mean = F.avg(d).over(running() if causal else by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.degrees(F.atan(ratio(d, mean)))


def ma_error(n: int) -> Column:
    """Mean squared distance of the close from its average."""
    return rolling(F.avg, F.pow(F.col("close") - sma(F.col("close"), n), 2), n)


def calendar_waves(ts: Column) -> dict[str, Column]:
    dow, month = F.weekday(ts), F.month(ts) - 1
    tau = 2 * 3.141592653589793
    return {"dow_sin": F.sin(tau * dow / 7), "dow_cos": F.cos(tau * dow / 7), "month_sin": F.sin(tau * month / 12), "month_cos": F.cos(tau * month / 12)}


def forward_return(h: int) -> Column:
    """Log return of the next h bars; null where they are not there yet."""
    return F.ln(ratio(F.lead(F.col("close"), h).over(by_symbol()), F.col("close")))


def with_lags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds each column's value on the bar before (_1) and the change since (_inc)."""
    return df.withColumns({k: v for c in columns for k, v in ((f"{c}_1", lag(F.col(c))), (f"{c}_inc", F.col(c) - lag(F.col(c))))})


def roc(n: int) -> Column:
    return change(F.col("close"), n)
