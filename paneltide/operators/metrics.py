"""Performance and risk of return series (run, ts, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..functions.windows import ratio, rolling
from ..sources.store import stored

PER_YEAR = 252


def drawdown(returns: DataFrame) -> DataFrame:
    """run, max_dd: the lowest of the curve over its highest point so far, less 1."""
    by = Window.partitionBy("run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.where("r IS NOT NULL").withColumn("curve", F.product(1 + F.col("r")).over(by))
    return curve.withColumn("dd", F.col("curve") / F.max("curve").over(by) - 1).groupBy("run").agg(F.min("dd").alias("max_dd"))


def performance(returns: DataFrame, per_year: int = PER_YEAR) -> DataFrame:
    """Per run: n, total, cagr, vol, sharpe, sortino, max_dd, calmar."""
    r = F.col("r")
    root = per_year**0.5
    base = returns.where("r IS NOT NULL").groupBy("run").agg(F.count("r").alias("n"), F.product(1 + r).alias("growth"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.stddev_samp(F.when(r < 0, r)).alias("down"))
    out = base.join(drawdown(returns), "run")
    cagr = F.when(F.col("growth") > 0, F.pow("growth", per_year / F.col("n"))) - 1
    return out.select(
        "run", "n", (F.col("growth") - 1).alias("total"), cagr.alias("cagr"), (F.col("sd") * root).alias("vol"), (ratio(F.col("m"), F.col("sd")) * root).alias("sharpe"),
        F.when(F.col("down") > 0, F.col("m") / F.col("down") * root).alias("sortino"), "max_dd", F.when(F.col("max_dd") < 0, cagr / F.abs("max_dd")).alias("calmar"),
    )


def yearly(returns: DataFrame) -> DataFrame:
    """Compounded return of each run by year, and of all years (year is null)."""
    return returns.rollup("run", F.year("ts").alias("year")).agg((F.product(1 + F.col("r")) - 1).alias("total")).where("run IS NOT NULL")


def equity_metrics(equity: DataFrame, per_year: int = PER_YEAR) -> DataFrame:
    """performance() of an equity curve (run, ts, equity)."""
    by = Window.partitionBy("run").orderBy("ts")
    return performance(equity.select("run", "ts", (ratio(F.col("equity"), F.lag("equity").over(by)) - 1).alias("r")), per_year)


def engine(rows: DataFrame, cash: float = 10_000.0, per_year: int = PER_YEAR) -> DataFrame:
    """One row over all symbols of (symbol, ts, r, growth, equity, signal): profit, final_equity, turnover, fitness, profit_per_trade.

    Turnover is the smaller of what was bought and sold (equity times signal) over the final equity, fitness the Sharpe ratio over it.
    """
    daily = rows.groupBy("ts").agg(F.sum("equity").alias("equity"), F.avg("r").alias("r"), F.avg("growth").alias("growth"))
    end = daily.agg(F.max_by("equity", "ts").alias("final_equity"), F.max_by("growth", "ts").alias("total"), (ratio(F.avg("r"), F.stddev_samp("r")) * per_year**0.5).alias("sharpe"))
    traded = F.col("equity") * F.col("signal")
    moved = rows.agg(F.sum(F.greatest(traded, F.lit(0.0))).alias("bought"), F.sum(F.greatest(-traded, F.lit(0.0))).alias("sold"), (F.sum(F.abs("signal")) / 2).alias("trades"), (cash * F.countDistinct("symbol")).alias("cash"))
    turnover = ratio(F.least("bought", "sold"), F.col("final_equity"))
    both = end.join(F.broadcast(moved), how="cross").withColumn("turnover", turnover)  # a row each
    return both.select((F.col("final_equity") - F.col("cash")).alias("profit"), "final_equity", "turnover", F.when(F.col("turnover") > 0, F.col("sharpe") / F.col("turnover")).alias("fitness"), ratio(F.col("total"), F.col("trades")).alias("profit_per_trade"))


def confusion(df: DataFrame, truth: Column, guess: Column, by: list[str]) -> DataFrame:
    """Counts and accuracy, precision, recall, f1 of 0/1 labels."""
    n = lambda c: F.count_if(c)
    rows = df.where(truth.isNotNull() & guess.isNotNull()).groupBy(*by).agg(n((truth == 1) & (guess == 1)).alias("tp"), n((truth == 0) & (guess == 1)).alias("fp"), n((truth == 1) & (guess == 0)).alias("fn"), n((truth == 0) & (guess == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return rows.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def auc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """Area under the ROC curve per run from rank sums, ties at their mean rank."""
    rows = df.select("run", truth.alias("y"), score.alias("s")).where("y IS NOT NULL AND s IS NOT NULL")
    levels = rows.groupBy("run", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = levels.withColumn("rank", below + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("run").agg(F.sum(F.col("pos") * F.col("rank")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select("run", ratio(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def signal_sharpe(df: DataFrame, guess: Column, y: Column) -> DataFrame:
    """Sharpe of yesterday's sign of the guess times today's return, the first row of a run left out."""
    by = Window.partitionBy("run").orderBy("ts")
    rows = df.select("run", (F.lag(F.signum(guess)).over(by) * y).alias("r")).where("r IS NOT NULL")
    return rows.groupBy("run").agg((ratio(F.avg("r"), F.stddev_samp("r")) * PER_YEAR**0.5).alias("sharpe"))


def regression_fit(df: DataFrame, y: Column, guess: Column) -> DataFrame:
    """R squared and share of equal signs per run."""
    rows = df.select("run", y.alias("y"), guess.alias("g")).where("y IS NOT NULL AND g IS NOT NULL")
    a = rows.groupBy("run").agg(F.count("y").alias("n"), F.sum(F.pow(F.col("y") - F.col("g"), 2)).alias("err"), (F.var_pop("y") * F.count("y")).alias("dev"), F.avg((F.signum("y") == F.signum("g")).cast("double")).alias("hits"))
    return a.select("run", "n", (1 - ratio(F.col("err"), F.col("dev"))).alias("r2"), "hits")


def rolling_sharpe_min(returns: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("run").orderBy("ts")
    r = F.col("r")
    s = ratio(rolling(F.avg, r, n, by), rolling(F.stddev_samp, r, n, by)) * PER_YEAR**0.5
    return returns.withColumn("s", s).groupBy("run").agg(F.min("s").alias("sharpe_min"))


def correlations(panel: DataFrame, value: str) -> DataFrame:
    """Correlation and covariance of all pairs of symbols on their common dates."""
    from .clean import pairs

    p = pairs(panel.where(F.col(value).isNotNull()), [value])
    x, y = f"{value}_1", f"{value}_2"
    return p.groupBy("symbol_1", "symbol_2").agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("corr"), F.covar_samp(x, y).alias("cov"))


def correlated(panel: DataFrame, value: str, least: float, tile: int = 128) -> DataFrame:
    """symbol_1, symbol_2, n, corr of the pairs of symbols whose correlation on their common dates is `least` or more in size.

    Symbols are dealt to tiles of about `tile`; a task multiplies the matrices of two tiles (values, squares, presence) and puts out
    only the pairs that reach `least`, so that pairs of rows are never formed: a row is copied once for each tile, whereas
    correlations() forms one for each pair of symbols and date. A task holds two tiles' series. Nulls are missing dates; a pair has no
    correlation below two common dates or where one side is constant; a row that is repeated counts once, the larger value of two
    on one date.
    """
    import numpy as np
    import pandas as pd

    cells = panel.where(F.col(value).isNotNull() & F.col("symbol").isNotNull()).groupBy("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).agg(F.max(F.col(value).cast("double")).alias("v"))
    series = stored(cells.groupBy("symbol").agg(F.collect_list("at").alias("at"), F.collect_list("v").alias("v")), "series")
    tiles = max(1, -(-series.count() // tile))
    mine, other = F.pmod(F.xxhash64("symbol"), F.lit(tiles)), F.col("other")
    rows = series.withColumn("tile", mine).select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    rows = rows.withColumns({"low": F.least("tile", other), "high": F.greatest("tile", other)})

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        names = df["symbol"].to_numpy()
        dates, where = np.unique(np.concatenate(df["at"].tolist()), return_inverse=True)
        row = np.repeat(np.arange(len(df)), [len(a) for a in df["at"]])
        x, there = np.zeros((len(df), len(dates))), np.zeros((len(df), len(dates)))
        x[row, where], there[row, where] = np.concatenate(df["v"].tolist()), 1.0
        count = there.sum(1, keepdims=True)
        x = (x - x.sum(1, keepdims=True) / count) * there  # about its own mean, which leaves the correlation as it is
        scale = np.sqrt((x * x).sum(1, keepdims=True))
        x /= np.where(scale > 0, scale, 1.0)
        a = df["tile"].to_numpy() == key[0]
        b = df["tile"].to_numpy() == key[1]
        n, sx, sy = there[a] @ there[b].T, x[a] @ there[b].T, there[a] @ x[b].T
        xx, yy, xy = (x * x)[a] @ there[b].T, there[a] @ (x * x)[b].T, x[a] @ x[b].T
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = xx - sx * sx / n, yy - sy * sy / n
            corr = (xy - sx * sy / n) / np.sqrt(np.where((vx > 1e-12 * xx) & (vy > 1e-12 * yy), vx * vy, np.nan))
        i, j = np.nonzero((n >= 2) & (np.abs(corr) >= least))
        one, two = names[a][i], names[b][j]
        keep = (one < two) if key[0] == key[1] else np.ones(len(i), bool)
        turned = one > two
        return pd.DataFrame({"symbol_1": np.where(turned, two, one)[keep], "symbol_2": np.where(turned, one, two)[keep], "n": n[i, j].astype("int64")[keep], "corr": corr[i, j][keep]})

    return rows.groupBy("low", "high").applyInPandas(run, "symbol_1 string, symbol_2 string, n long, corr double")


def unit_root_t(df: DataFrame, key: list[str], x: str, order: str = "ts") -> DataFrame:
    """Dickey-Fuller t of dx = a + b x' (no lags) per key, from sums."""
    by = Window.partitionBy(*key).orderBy(order)
    rows = df.withColumn("__l", F.lag(x).over(by)).where("__l IS NOT NULL").withColumn("__d", F.col(x) - F.col("__l"))
    a = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.var_pop("__l").alias("vx"), F.covar_pop("__l", "__d").alias("c"), F.var_pop("__d").alias("vy"))
    b = ratio(F.col("c"), F.col("vx"))
    rest = F.col("n") * (F.col("vy") - b * F.col("c"))
    error = F.sqrt(F.greatest(rest, F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2) / (F.col("n") * F.col("vx")))
    return a.select(*key, "n", ratio(b, error).alias("t"))


def sweep_summary(results: DataFrame, value: str, base: float) -> DataFrame:
    """By parameter and over all: median, 10th percentile, least, most, share above `base`, spread, best run."""
    v = F.col(value)
    return results.rollup("param").agg(F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.1)).alias("p10"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg((v > base).cast("double")).alias("beats"), (F.max(v) - F.min(v)).alias("spread"), F.max_by("run", F.struct(v, F.col("run"))).alias("best"))


def tail_risk(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Empirical value at risk and mean of the tail, per run."""
    q = quantiles(returns, ["run"], "r", {"var": alpha}).drop("n")
    return returns.join(q, "run").groupBy("run").agg(F.first("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"))


def extreme_tail(returns: DataFrame, u: float = 0.9, alpha: float = 0.99) -> DataFrame:
    """Losses over the u-quantile as a generalised Pareto tail fitted by moments: VaR and CVaR at alpha; null below 5 excesses."""
    loss = returns.select("run", (-F.col("r")).alias("x"))
    q = quantiles(loss, ["run"], "x", {"u": u})
    over = loss.join(q, "run").withColumn("e", F.when(F.col("x") > F.col("u"), F.col("x") - F.col("u")))
    a = over.groupBy("run").agg(F.first("u").alias("u"), F.first("n").alias("n"), F.count("e").alias("k"), F.avg("e").alias("m"), F.var_samp("e").alias("s2"))
    g = ratio(F.col("m") * F.col("m"), F.col("s2"))
    a = a.withColumns({"xi": 0.5 * (1 - g), "beta": 0.5 * F.col("m") * (1 + g)})
    rate = F.col("k") / F.col("n")
    tail = F.col("u") + F.when(F.abs("xi") < 1e-9, -F.col("beta") * F.ln((1 - alpha) / rate)).otherwise(ratio(F.col("beta"), F.col("xi")) * (F.pow((1 - alpha) / rate, -F.col("xi")) - 1))
    a = a.withColumn("evt_var", F.when(F.col("k") >= 5, tail))
    return a.select("run", "k", "xi", "beta", "evt_var", F.when(F.col("xi") < 1, ratio(F.col("evt_var") + F.col("beta") - F.col("xi") * F.col("u"), 1 - F.col("xi"))).alias("evt_cvar"))


def ledger(trades: DataFrame) -> DataFrame:
    """Running cash, number of trades and position of (account, ts, id, qty, price): a buy takes cash, a sale brings it."""
    by = Window.partitionBy("account").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumns({"cash": F.sum(-F.col("qty") * F.col("price")).over(by), "trades": F.count(F.lit(1)).over(by), "position": F.sum("qty").over(by)})
