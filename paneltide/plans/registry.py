"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from . import extras, features, learning, market, more, portfolios, scans, streams  # noqa: F401  they register their queries
from .oracle import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark, sf_dir):
    return market.boll_backtest_metrics(spark, sf_dir)
