"""States of a mixture that carries sums, against one that keeps every row and its weights."""

import datetime as dt

import numpy as np
import pytest

from paneltide.operators import learn


def prices(n, seed=4):
    rng = np.random.default_rng(seed)
    calm = (np.arange(n) // 90) % 3 != 2
    r = np.where(calm, rng.normal(0.001, 0.006, n), rng.normal(-0.004, 0.025, n))
    return [(dt.date(2015, 1, 1) + dt.timedelta(days=i), float(p)) for i, p in enumerate(100 * np.exp(np.cumsum(r)))]


def brute(ret, vol, every, least):
    """All rows so far with their weights; means and covariances from them as numpy has them."""
    x = np.column_stack([ret, vol])
    x = (x - x[:least].mean(0)) / (x[:least].std(0, ddof=1) + 1e-12)
    own = learn._belongs(x[:least], *learn.two_components(x[:least]))

    def model(own):
        part = x[: len(own)]
        mean = np.stack([np.average(part, axis=0, weights=own[:, k]) for k in range(2)])
        cov = np.stack([np.cov(part, rowvar=False, aweights=own[:, k], ddof=0) + 1e-6 * np.eye(2) for k in range(2)])
        return own.sum(0) / own.sum(), mean, cov

    out = []
    for at in range(least, len(x), every):
        now = model(own)
        block = x[at : at + every]
        out += list(learn._belongs(block, *now).argmax(1) == now[1][:, 0].argmin())
        fresh = learn._belongs(block, *now)
        for _ in range(learn.ROUNDS):
            fresh = learn._belongs(block, *model(np.vstack([own, fresh])))
        own = np.vstack([own, fresh])
    return out


@pytest.mark.parametrize(("every", "batch"), [(40, 10_000), (63, 17), (1000, 100)])
def test_states(spark, every, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = learn.bear_state(spark.createDataFrame(prices(900), "ts date, bench double").repartition(5), every, 300).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    p = np.array([p for _, p in prices(900)])
    ret = p[1:] / p[:-1] - 1
    vol = np.array([ret[i - 20 : i + 1].std(ddof=1) for i in range(20, len(ret))])
    want = brute(ret[20:], vol, every, 300)
    assert list(got["bear"]) == want and 50 < sum(want) < len(want) - 50
    wild = [(d.toordinal() - dt.date(2015, 1, 1).toordinal()) // 90 % 3 == 2 for d in got["ts"]]
    assert np.mean(np.array(wild) == got["bear"]) > 0.8


def test_short_series(spark):
    rows = spark.createDataFrame(prices(120), "ts date, bench double")
    assert learn.bear_state(rows, 10, 200).count() == 0
    assert learn.bear_state(rows.limit(0), 10, 20).count() == 0
