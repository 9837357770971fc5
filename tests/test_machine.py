"""State machines as a scan over blocks, and selectors as a fold, against plain loops; no Python on the executors."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from paneltide.functions.machine import machine
from paneltide.operators import backtest, rules


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    return df


def series(seed, n=700, keys="abc"):
    rng = random.Random(seed)
    return [(k, dt.date(2015, 1, 1) + dt.timedelta(2 * i), rng.choice([None, math.nan, -3.0, -0.2, 0.0, 0.05, 0.3, 2.5])) for k in keys for i in range(n) if rng.random() > 0.1]


@pytest.mark.parametrize("block", ["MONTH", "YEAR", "CENTURY"])
def test_machine_equals_the_loop(spark, block):
    rows = series(1)
    rows.append((None, dt.date(2020, 1, 1), 2.5))
    df = spark.createDataFrame(rows, "k string, ts date, x double").repartition(5)
    step = lambda s, v: F.when(v > 1, (s * 2 + 1) % 5).when(v < 0, (s + 3) % 5).otherwise(s)  # noqa: E731  no state forgets the others
    out = no_python(machine(df, ["k"], F.nanvl("x", F.lit(None).cast("double")), 5, step, start=2, block=block))
    got = {(r["k"], r["ts"]): r["state"] for r in out.collect()}
    state = {}
    for k, t, v in rows:
        s = state.get(k, 2)
        s = s if v is None or v != v else (s * 2 + 1) % 5 if v > 1 else (s + 3) % 5 if v < 0 else s
        state[k] = s
        assert got.pop((k, t)) == s
    assert not got
    assert machine(df.limit(0), ["k"], F.col("x"), 5, step).count() == 0


@pytest.mark.parametrize("horizon", [1, 2, 7])
def test_holding_period_equals_its_steps(spark, horizon):
    rows = series(2)
    got = {(r["symbol"], r["ts"]): r["position"] for r in no_python(rules.holding_period(spark.createDataFrame(rows, "symbol string, ts date, x double"), "x", 0.05, horizon)).collect()}
    now = {}
    for k, t, v in rows:
        now[k] = rules.hold_step(v, *now.get(k, (0, 0)), 0.05, horizon)
        assert got[k, t] == now[k][1]


def test_pair_positions_equal_the_loop(spark):
    rows = [(k, "z", t, v) for k, t, v in series(3)]
    out = no_python(rules.pair_positions(spark.createDataFrame(rows, "symbol_1 string, symbol_2 string, ts date, z double"), 2.0, 0.1))
    got, now = {(r["symbol_1"], r["ts"]): r["state"] for r in out.collect()}, {}
    for k, _, t, z in rows:
        s = now.get(k, 0)
        if z is not None and z == z:
            s = (-1 if z > 2 else 1 if z < -2 else 0) if s == 0 else 0 if (s == 1 and z > -0.1) or (s == -1 and z < 0.1) else s
        now[k] = s
        assert got[k, t] == s


@pytest.mark.parametrize("k,buffer", [(3, 1.0), (3, 1.5), (3, 4.0), (20, 1.5), (1, 0.5)])
def test_buffered_equals_the_loop(spark, k, buffer):
    rng = random.Random(int(k * buffer))
    rows = [(f"r{j}", dt.date(2020, 1, 1 + d), f"S{i:02d}", n + 1) for j in range(3) for d in range(20) for n, i in enumerate(rng.sample(range(12), rng.randint(1, 12)))]
    got = {tuple(r) for r in no_python(backtest.buffered(spark.createDataFrame(rows, "run string, ts date, symbol string, rank int").repartition(4), k, buffer)).select("run", "ts", "symbol").collect()}
    want, reach = set(), math.ceil(buffer * k)
    for j in range(3):
        held = []
        for d in range(20):
            names = [s for r, t, s, _ in rows if r == f"r{j}" and t.day == 1 + d]
            size = min(k, len(names))
            stay = [s for s in held if s in names[:reach]][:size]
            fill = [s for s in names if s not in stay][: size - len(stay)]
            held = sorted([*stay, *fill], key=names.index)
            want |= {(f"r{j}", dt.date(2020, 1, 1 + d), s) for s in held}
    assert got == want


@pytest.mark.parametrize("k,swap", [(4, 1), (4, 0), (3, 5)])
def test_sticky_random_equals_the_loop(spark, k, swap):
    import hashlib

    rng = random.Random(9)
    rows = [(dt.date(2020, 1, 1 + d), f"S{i}", None if rng.random() < 0.3 else 1.0) for d in range(15) for i in range(9)]
    panel, seeds = spark.createDataFrame(rows, "ts date, symbol string, close double"), spark.range(3).withColumnRenamed("id", "run")
    got = {tuple(r) for r in no_python(backtest.sticky_random(panel, seeds, k, swap)).select("run", "ts", "symbol").collect()}
    want = set()
    for run in range(3):
        held = []
        for d in range(15):
            t = dt.date(2020, 1, 1 + d)
            names = sorted((s for u, s, c in rows if u == t and c is not None), key=lambda s: hashlib.md5(f"{run}|{t}|{s}".encode()).hexdigest())
            stay = [s for s in held if s in names]
            stay = stay[min(swap, len(stay)) :] if len(stay) == k else stay
            held = [*stay, *[s for s in names if s not in held][: k - len(stay)]][:k]
            want |= {(run, t, s) for s in held}
    assert got == want
