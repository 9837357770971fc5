"""Strategies by name: functions from bars to bars with a position, and runs of many of them in one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from . import backtest, rules

Strategy = Callable[[DataFrame], DataFrame]

STRATEGIES: dict[str, Strategy] = {
    "buy and hold": rules.buy_and_hold,
    "bollinger": lambda df: rules.bollinger_reversion(df, k=1.0),
}

#: Features by name, built when a session is there.
FEATURES: dict[str, Callable[[], Column]] = {
    "log_return": I.log_return,
    "roc_10": lambda: I.roc(10),
    "rsi_14": lambda: I.rsi(14),
    "vol_20": lambda: I.rolling_std(I.log_return(), 20),
}


def register(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def run(bars: DataFrame, names: list[str] | None = None, bps: float = 10.0) -> DataFrame:
    """(run, ts, r, equity): the book of each strategy over all symbols."""
    out = []
    for name in names or list(STRATEGIES):
        rows = backtest.profit(bars.transform(STRATEGIES[name]).select("symbol", "ts", "close", "position"), bps)
        out.append(backtest.book(rows).select(F.lit(name).alias("run"), "ts", "r", "equity"))
    return reduce(DataFrame.unionByName, out)


class PanelFeatures(Transformer):
    """Adds features by name, as a stage of a Spark ML pipeline."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.names = names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset
        for name in self.names:
            if name == "vol_20":  # a window over a window: the inner one becomes a column first
                rows = rows.withColumn("__r", I.log_return()).withColumn(name, I.rolling_std(F.col("__r"), 20)).drop("__r")
            else:
                rows = rows.withColumn(name, FEATURES[name]())
        return rows
