"""Distances by a carried inverse against a pseudo-inverse of each window."""

import numpy as np
import pytest

from paneltide.operators.sliding import Scatter, distances


def brute(x, at, window):
    past = x[at - window : at]
    good = ~np.isnan(past).any(0) & ~np.isnan(x[at])
    if good.sum() < 2:
        return None
    d = x[at, good] - past[:, good].mean(0)
    return d @ np.linalg.pinv(np.cov(past[:, good], rowvar=False)) @ d


@pytest.mark.parametrize("step", [1, 5, 40])
def test_distances(step):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.02, (500, 12)) @ rng.normal(size=(12, 12))
    x[200:230, 3] = np.nan
    x[rng.random(500) < 0.01, 5] = np.nan
    x[300] *= 40  # comes and goes
    x[350:420, 7] = 0.01  # constant for longer than a window: the pseudo-inverse
    wanted = np.arange(60, 500, step)
    for at, got in zip(wanted, distances(x, wanted, 60), strict=True):
        want = brute(x, at, 60)
        assert got == (want if want is None else pytest.approx(want, rel=1e-8)), at


def test_few_rows_and_columns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 30))
    got = distances(x, np.arange(10, 80), 10)  # fewer rows than columns
    assert got == [pytest.approx(brute(x, at, 10), rel=1e-8) for at in range(10, 80)]
    assert distances(x[:, :1], np.arange(10, 20), 10) == [None] * 10


def test_inverse_is_carried(monkeypatch):
    made = []
    plain = Scatter.__init__
    monkeypatch.setattr(Scatter, "__init__", lambda self, *a: (made.append(1), plain(self, *a))[1])
    x = np.random.default_rng(3).normal(size=(400, 8))
    distances(x, np.arange(100, 400), 100)
    assert len(made) == 10  # 300 rows, a fresh one every 33
