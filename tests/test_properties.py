"""Invariants of the operators that SQL does not check: identities, causality, bounds, folds, and small worked cases."""

import datetime as dt
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paneltide.functions import indicators as I
from paneltide.functions.ema import ema, ema_adjusted
from paneltide.operators import backtest, clean, cross, learn, metrics, orders, rules, walk
from paneltide.plans import features, market, registry
from paneltide.streaming import ticks

SMALL = "/root/testdata/sf0.001"


def panel(spark, symbols=6, rows=300, seed=1, dead=None):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(symbols):
        price = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.012, rows)))
        for i in range(rows):
            gone = dead == k and i >= rows - 40
            out.append((f"S{k:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=i), None if gone else float(price[i])))
    return spark.createDataFrame(out, "symbol string, ts date, close double")


def series(spark, values):
    return spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(None if v is None else float(v) for v in values)], "symbol string, ts date, close double")


def test_ema_equals_pandas(spark):
    rng = np.random.default_rng(0)
    for n, span in ((1, 5), (700, 5), (700, 200), (700, 1.2)):
        x = [None, None] + list(rng.normal(100, 5, n))
        got = ema(series(spark, x), "e", F.col("close"), span=span).orderBy("ts").toPandas()["e"]
        want = pd.Series(x, dtype=float).ewm(span=span, adjust=False).mean()
        assert np.allclose(got, want, rtol=1e-10, equal_nan=True)
    got = ema_adjusted(series(spark, x), "e", F.col("close"), span=7).orderBy("ts").toPandas()["e"]
    assert np.allclose(got, pd.Series(x, dtype=float).ewm(span=7).mean(), rtol=1e-10, equal_nan=True)


def test_ffill_limit(spark):
    x = [1.0] + [None] * 6 + [2.0]
    got = [r["f"] for r in series(spark, x).withColumn("f", clean.ffill(F.col("close"), 5)).orderBy("ts").collect()]
    assert got == [1.0] * 6 + [None, 2.0]


def test_profit_timing(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 1 + i), c, p) for i, (c, p) in enumerate(zip([100.0, 110.0, 121.0, 121.0, 121.0], [1, 1, 0, 0, 0]))], "symbol string, ts date, close double, position int")
    free = backtest.profit(df, bps=0).orderBy("ts").collect()
    assert math.isclose(free[-1]["growth"], 0.21)
    assert backtest.profit(df, bps=10).orderBy("ts").collect()[-1]["equity"] < free[-1]["equity"]


def test_weights_are_capped_and_full(spark):
    rows = spark.createDataFrame([(dt.date(2020, 1, 1), f"S{i}", s) for i, s in enumerate([0.01, 0.02, 0.05, 0.05, 0.1])], "ts date, symbol string, sd double")
    w = {r["symbol"]: r["weight"] for r in cross.inverse_vol(rows, "sd", 0.3).collect()}
    assert math.isclose(sum(w.values()), 1) and max(w.values()) <= 0.3 + 1e-3 and len(w) == 5


def test_buffer_of_one_is_top_k(spark):
    rng = random.Random(2)
    rows = [("r", dt.date(2020, 1, 1 + d), f"S{i}", k + 1) for d in range(20) for k, i in enumerate(rng.sample(range(10), 10))]
    scored = spark.createDataFrame(rows, "run string, ts date, symbol string, rank int")
    top = {(r["ts"], r["symbol"]) for r in scored.where("rank <= 3").collect()}
    assert {(r["ts"], r["symbol"]) for r in backtest.buffered(scored, 3, 1.0).collect()} == top
    wide = backtest.buffered(scored, 3, 3.0)
    assert {r["n"] for r in wide.groupBy("ts").agg(F.count("*").alias("n")).collect()} == {3}

    def turnover(picks):
        days = {}
        for r in picks.collect():
            days.setdefault(r["ts"], set()).add(r["symbol"])
        keys = sorted(days)
        return sum(len(days[a] ^ days[b]) for a, b in zip(keys, keys[1:]))

    assert turnover(wide) < turnover(scored.where("rank <= 3"))


def test_future_does_not_change_the_past(spark):
    p = panel(spark)
    cut = dt.date(2020, 9, 1)
    args = {"k": 2, "lookbacks": (60, 30), "skip": 5, "vol": 20, "ma": 50}

    def run(df):
        schedule = clean.weekly_schedule(df.select("ts").distinct())
        bench = df.groupBy("ts").agg(F.avg("close").alias("bench"))
        return backtest.portfolio(df, backtest.momentum_weights(df, schedule, bench, **args))

    # the last week of the shorter panel ends early: compare what lies a week before the cut
    past = F.col("ts") < F.lit(cut - dt.timedelta(days=8))
    whole = {r["ts"]: round(r["r"], 10) for r in run(p).where(past).collect()}
    part = {r["ts"]: round(r["r"], 10) for r in run(p.where(F.col("ts") < F.lit(cut))).where(past).collect()}
    assert part and whole == part


def test_a_dead_name_becomes_cash(spark):
    p = panel(spark, symbols=3, rows=100, dead=0)
    last = p.where("close IS NOT NULL").groupBy("symbol").agg(F.max("ts").alias("ts")).where("symbol = 'S00'").first()["ts"]
    w = spark.createDataFrame([(dt.date(2020, 2, 1), s, 1 / 3) for s in ("S00", "S01", "S02")], "ts date, symbol string, weight double")
    rows = {r["ts"]: r["exposure"] for r in backtest.portfolio(p, w).collect()}
    assert math.isclose(rows[last], 1) and math.isclose(rows[last + dt.timedelta(days=1)], 2 / 3)


def test_holding_period_against_the_loop_and_the_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), i, rng.choice([None, -0.2, 0.0, 0.05, 0.3])) for s in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, id long, x double")
    got = {(r["symbol"], r["ts"]): r["position"] for r in rules.holding_period(df, "x", 0.1, 5).collect()}
    for s in "ab":
        left = position = 0
        for r in (r for r in rows if r[0] == s):
            value = r[3] or 0.0
            if left > 0:
                left = left - 1 + (value >= 0.1)
            elif position == 0 and value > 0.1:
                position, left = 1, 4
            elif position == 1 and value <= 0:
                position = 0
            assert got[s, r[1]] == position
    for k in range(4):
        df.where(F.col("id").between(50 * k, 50 * k + 49)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = ticks.drain(ticks.holding_period(stream, "x", 0.1, 5), [], mode="append")
    assert {(r["symbol"], r["ts"]): r["position"] for r in out.collect()} == got


def test_pair_machine_takes_one_step_a_bar(spark):
    z = [0.0, 2.5, None, 0.4, -3.0, -3.0, 0.0]
    df = spark.createDataFrame([("a", "b", dt.date(2020, 1, 1 + i), v) for i, v in enumerate(z)], "symbol_1 string, symbol_2 string, ts date, z double")
    assert [r["state"] for r in rules.pair_positions(df).orderBy("ts").collect()] == [0, -1, -1, 0, 1, 1, 0]
    legs = {(r["symbol"], r["ts"].day): r["position"] for r in rules.pair_legs(rules.pair_positions(df)).collect()}
    assert legs["a", 2] == -1 and legs["b", 2] == 1


def test_folds_table_equals_folds(spark):
    dates = spark.createDataFrame([("r", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(203)], "run string, ts date")
    for expanding in (True, False):
        got = [tuple(r)[1:] for r in backtest.fold_table(dates, 60, 20, 5, expanding).orderBy("fold").collect()]
        assert got == backtest.folds(203, 60, 20, 5, expanding)
    assert all(end <= start - 5 for _, _, end, start, _ in backtest.folds(203, 60, 20))
    with pytest.raises(ValueError):
        backtest.folds(50, 60, 20)


def test_orders(spark):
    t = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.2)], "symbol string, weight double")
    b = spark.createDataFrame([("A", 60_000.0), ("D", 10_000.0), ("C", 19_900.0)], "symbol string, notional double")
    rows = [tuple(r) for r in orders.build_orders(t, b, F.lit(100_000.0)).orderBy("seq").collect()]
    assert rows == [(1, "A", "sell", 10_000.0, False), (2, "D", "sell", None, True), (3, "B", "buy", 30_000.0, False)]


def test_sleeves(spark):
    s = spark.createDataFrame([("m", 0.7, True, [], 2, 0.6), ("d", 0.3, False, ["X", "Y"], 2, 0.6)], "sleeve string, allocation double, residual boolean, universe array<string>, top_k int, cap double")
    assert orders.sleeve_faults(s).count() == 0
    book = spark.createDataFrame([("X", 1.0), ("Z", 1.0)], "symbol string, notional double")
    assert [r["symbol"] for r in orders.orphans(book, s).collect()] == ["Z"]
    ready = spark.createDataFrame([("d",)], "sleeve string")
    assert {r["symbol"] for r in orders.managed(book, s, ready).collect()} == {"X", "Y"}  # a skipped sleeve's names are left alone
    bad = s.withColumns({"allocation": F.lit(0.9), "residual": F.lit(True), "cap": F.lit(0.1)})
    assert {r["fault"] for r in orders.sleeve_faults(bad).collect()} == {"allocations", "residual", "cap"}


def test_vol_target_bounds_and_identity(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("r", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(rng.normal(0, 0.02, 200))], "run string, ts date, r double")
    e = [r["exposure"] for r in cross.vol_target(df, 0.2, 0.3, 1.0).collect()]
    assert min(e) >= 0.3 and max(e) <= 1.0 and min(e) < 1.0
    assert {r["exposure"] for r in cross.vol_target(df, 99.0).collect()} == {1.0}


@pytest.mark.parametrize("block", [7, 64, 500])
def test_mahalanobis_equals_numpy(spark, block):
    p = panel(spark, symbols=4, rows=90, dead=2)
    rows = cross.mahalanobis(p, p.select("ts").distinct(), 60, block).orderBy("ts").toPandas()
    wide = p.toPandas().pivot(index="ts", columns="symbol", values="close").sort_index()
    r = wide.pct_change(fill_method=None)
    want = []
    for t in range(60, 90):
        past, now = r.iloc[t - 60 : t], r.iloc[t]
        names = [c for c in r.columns if past[c].notna().all() and not np.isnan(now[c])]
        d = (now[names] - past[names].mean()).to_numpy()
        want.append(d @ np.linalg.pinv(past[names].cov().to_numpy()) @ d if len(names) > 1 else np.nan)
    assert list(rows["ts"]) == list(wide.index[60:]) and np.allclose(rows["turbulence"].astype(float), want, equal_nan=True)


def test_bias_corrections_equal_pandas(spark):
    p = panel(spark, symbols=1, rows=80)
    got = p.withColumns({"s": I.skewness(F.col("close"), 20), "k": I.kurtosis(F.col("close"), 20)}).orderBy("ts").toPandas()
    assert np.allclose(got["s"], got["close"].rolling(20).skew(), equal_nan=True) and np.allclose(got["k"], got["close"].rolling(20).kurt(), equal_nan=True)


def test_random_k_is_fixed_by_its_seed(spark):
    p = panel(spark, rows=30)
    seeds = spark.range(5).select(F.col("id").alias("run"))
    a, b = ({tuple(r) for r in backtest.random_k(p, seeds, 2).collect()} for _ in range(2))
    assert a == b and len(a) == 5 * 30 * 2


def test_idempotent_sink(spark, tmp_path):
    write = ticks.idempotent_sink(str(tmp_path))
    for _ in range(2):
        write(spark.range(3), 7)
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_bars_round_trip(spark, tmp_path):
    from paneltide.sources import panels

    bars = panel(spark, rows=20).select("symbol", "ts", *(F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume")))
    panels.write_bars(bars, f"{tmp_path}/p")
    assert panels.read_bars(spark, f"{tmp_path}/p", ["S00"], "2020-01-05").count() == 16
    bars.coalesce(1).write.csv(f"{tmp_path}/c", header=True)
    assert panels.read_bars_csv(spark, f"{tmp_path}/c").count() == bars.count()
    (tmp_path / "f.csv").write_text("Text\n\n,Mkt,RF\n20200102, 0.5,-0.1\n20200103,1.25,0.0\nCopyright\n")
    assert [tuple(r)[1:] for r in panels.read_factor_csv(spark, str(tmp_path / "f.csv"), ["mkt", "rf"]).orderBy("ts").collect()] == [(0.5, -0.1), (1.25, 0.0)]


def test_rows_for_models_end_before_their_labels(spark):
    from paneltide.plans import learning

    rows = learning.rows(spark, SMALL)
    assert rows.where("label IS NULL").count() <= rows.select("symbol").distinct().count()
    score = learn.fit_predict(rows, learn.direction_model("forest", learning.FEATURES, numTrees=3, maxDepth=2))
    assert score.where("NOT score BETWEEN 0 AND 1").count() == 0


@pytest.mark.parametrize("name", sorted({"turbulence_nd", "bear_state", "holistic_learned"}))
def test_queries_without_sql_run(spark, name):
    registry.queries()[name](spark, SMALL).toPandas()


def bench(spark, rows, seed=3):
    rng = np.random.default_rng(seed)
    x = 100 * np.exp(np.cumsum(rng.normal(0, np.where(np.arange(rows) // 80 % 2, 0.03, 0.01))))
    return spark.createDataFrame([(dt.date(2018, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "ts date, bench double")


def test_states_do_not_depend_on_later_dates(spark):
    whole, part = (learn.bear_state(bench(spark, 400).where(f"ts < date_add(DATE '2018-01-01', {n})"), every=40, least=150).orderBy("ts").toPandas() for n in (400, 300))
    assert len(part) > 100 and (whole.iloc[: len(part)]["bear"] == part["bear"]).all()
    assert 0 < whole["bear"].mean() < 1 and whole.loc[whole["bear"], "vol"].mean() != whole.loc[~whole["bear"], "vol"].mean()


def test_split_by_date_leaves_a_gap(spark):
    p = panel(spark, symbols=2, rows=100).where("symbol = 'S00' OR ts > '2020-02-20'")  # one begins later
    rows = clean.split_dates(p, 0.7, 3).toPandas()
    last, first = rows.loc[rows["test_mask"] == 0, "ts"].max(), rows.loc[rows["test_mask"] == 1, "ts"].min()
    assert (first - last).days == 4 and (rows.loc[rows["ts"] < first, "test_mask"].fillna(0) == 0).all()


def test_predictions_of_folds_equal_numpy_and_ignore_the_future(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = x @ [0.5, -0.2] + 0.1 * rng.normal(size=200)
    df = pd.DataFrame({"run": "a", "ts": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(200)], "n": range(200), "u": x[:, 0], "v": x[:, 1], "label": y})
    folds = backtest.fold_table(spark.createDataFrame(df), 60, 20, 5, False)
    got = learn.fit_folds(spark.createDataFrame(df), folds, ["u", "v"]).orderBy("n").toPandas()
    for f in folds.collect():
        a = np.column_stack([np.ones(60), x[f["slice_start"] : f["train_end"]]])
        w = np.linalg.lstsq(a, y[f["slice_start"] : f["train_end"]], rcond=None)[0]
        mine = got[got["fold"] == f["fold"]]
        assert list(mine["n"]) == list(range(f["test_start"], f["test_end"])) and np.allclose(mine["score"], w[0] + x[mine["n"]] @ w[1:])
    later = df.assign(label=np.where(df["n"] >= 100, 9.0, df["label"]))
    again = learn.fit_folds(spark.createDataFrame(later), folds, ["u", "v"]).orderBy("n").toPandas()
    assert np.allclose(got["score"][got["n"] < 105], again["score"][again["n"] < 105])


def held(weights):
    return {(r["run"], r["ts"], r["symbol"]): round(r["weight"], 9) for r in weights.collect()}


def test_layers_that_are_off_change_nothing(spark):
    p, b = panel(spark, symbols=8, rows=420), bench(spark, 900)
    base = walk.Config("r", k=3, lookbacks=(60, 30), skip=5, vol=20, ma=50)
    rows = walk.scored(p, [base])
    plain = backtest.momentum_weights(p, clean.weekly_schedule(p.select("ts").distinct()), b, k=3, cap=0.3, lookbacks=(60, 30), skip=5, vol=20, ma=50)
    want = held(plain.withColumn("run", F.lit("r")))
    assert len(want) > 100 and held(walk.weights(rows, exposure=walk.gate(b, [base]))) == want
    off = walk.combined(walk.gate(b, [base]), walk.vol_target(p, 1e9))  # a target that no book reaches
    none = p.select("ts", "symbol", F.lit(None).cast("double").alias("learned"))
    assert held(walk.weights(walk.with_learned(rows, none, 0.5), walk.buffered(1.0, 3), off, band=1e-12)) == want
    assert held(walk.weights(walk.scored(p, [walk.Config("r", k=3, lookbacks=(60, 30), skip=5, vol=20, ma=50, reversal=1e-15)]), exposure=walk.gate(b, [base]))) == want
    # each layer that is on changes something
    for other in (walk.weights(rows, walk.buffered(2.0, 3), walk.gate(b, [base])), walk.weights(rows, exposure=walk.vol_target(p, 0.05)), walk.weights(rows, exposure=walk.gate(b, [base]), band=0.05)):
        assert held(other) != want


def test_runs_of_a_sweep_equal_runs_alone(spark):
    p, b = panel(spark, symbols=8, rows=300), bench(spark, 900)
    configs = [walk.Config("a", 3, (60, 30), 5, 20, ma=50), walk.Config("b", 2, (40,), 0, 10, cap=0.6, ma=80, weekday=2), walk.Config("c", 3, (60, 30), 5, 20, ma=50, reversal=0.4)]
    first = walk.warmup(configs)
    all_ = held(walk.weights(walk.scored(p, configs, first), exposure=walk.gate(b, configs)))
    assert all_ == {k: v for c in configs for k, v in held(walk.weights(walk.scored(p, [c], first), exposure=walk.gate(b, [c]))).items()}
    days = sorted({r["ts"] for r in p.select("ts").distinct().collect()})
    assert {k[0] for k in all_} == {"a", "b", "c"} and min(k[1] for k in all_) >= days[first]


def test_book_risk_equals_the_covariance_form(spark):
    p = panel(spark, symbols=5, rows=150)
    weights = spark.createDataFrame([("r", dt.date(2020, 1, 1) + dt.timedelta(days=d), f"S{k:02d}", 0.1 + 0.1 * k) for d in (30, 100, 149) for k in range(3)], "run string, ts date, symbol string, weight double")
    got = {r["ts"]: (r["risk_21"], r["risk_63"]) for r in walk.book_risk(p, weights).collect()}
    r = p.toPandas().pivot(index="ts", columns="symbol", values="close").pct_change()
    w = np.array([0.1, 0.2, 0.3]) / 0.6
    for ts, risks in got.items():
        for n, risk in zip((21, 63), risks):
            past = r.loc[:ts].iloc[-n:][["S00", "S01", "S02"]]
            if past.notna().all().all() and len(past) == n:
                assert math.isclose(risk, math.sqrt(w @ past.cov().to_numpy() @ w * 252))
            else:
                assert risk is None
    assert len(got) == 3 and got[dt.date(2020, 1, 31)][1] is None


def test_band_leaves_small_changes_alone(spark):
    rows = [("r", dt.date(2020, 1, 1 + d), s, w) for d, ws in enumerate([{"A": 0.5, "B": 0.01}, {"A": 0.515, "C": 0.3}, {"A": 0.54, "C": 0.29}, {"C": 0.31}]) for s, w in ws.items()]
    got = held(walk.banded(spark.createDataFrame(rows, "run string, ts date, symbol string, weight double"), 0.02))
    a, b, c = ({k[1].day: v for k, v in got.items() if k[2] == s} for s in "ABC")
    assert a == {1: 0.5, 2: 0.5, 3: 0.54} and b == {1: 0.01, 2: 0.01, 3: 0.01, 4: 0.01} and c == {2: 0.3, 3: 0.3, 4: 0.3}


def test_stale_symbols_do_not_depend_on_batches(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in (0, 10, 100, 110, 300, 301, 700)]
    rows = [(i, t, 1, "A" if i % 2 else "B", 1.0) for i, t in enumerate(at)]
    out = []
    for files in (1, 4):
        path = f"{tmp_path}/{files}/events.parquet"
        for k in range(files):
            part = spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1)
            part.write.mode("append").parquet(path)
        users = ticks.read_ticks(spark, f"{tmp_path}/{files}", 1)
        out.append(sorted((r["symbol"], r["last"]) for r in ticks.drain(ticks.stale_symbols(users), [], mode="append").collect()))
    last = {s: [t for (i, t, *_), k in zip(rows, range(99)) if ("A" if i % 2 else "B") == s] for s in "AB"}
    want = sorted((s, t) for s, ts in last.items() for t, nx in zip(ts, ts[1:]) if (nx - t).total_seconds() > 3600)
    assert out[0] == out[1] and set(want) <= set(out[0])


def shuffled_ticks(spark, path, files, seed):
    """600 ticks of three symbols in files whose ticks are up to four minutes out of order; the ticks."""
    rng = random.Random(seed)
    minutes = sorted(rng.sample(range(9000), 600))
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m, microseconds=rng.randrange(1000)), rng.randrange(3), rng.choice("ABC"), float(rng.randrange(100))) for i, m in enumerate(minutes)]
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=4 * rng.random()))
    for k in range(files):
        part = arrival[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(rng.sample(part, len(part)), "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
        time.sleep(0.02)  # files are read by time of writing
    return rows


@pytest.mark.parametrize("files", [1, 5])
def test_ordered_streams_do_not_depend_on_arrival(spark, tmp_path, files):
    rows = shuffled_ticks(spark, tmp_path, files, files)
    stream = ticks.read_ticks(spark, str(tmp_path), 1, closing=f"{tmp_path}/closing-a")
    out = ticks.drain(ticks.holding_period(stream, "price", 90, 5, "10 minutes"), [], "append", f"{tmp_path}/closing-a").collect()
    want = {}
    for s in "ABC":
        left = position = 0
        for i, ts, _, symbol, price in rows:
            if symbol == s:
                left, position = rules.hold_step(price, left, position, 90, 5)
                want[i] = (s, ts, position)
    assert len(out) == len(want) and {r["id"]: (r["symbol"], r["ts"], r["position"]) for r in out} == want
    stream = ticks.read_ticks(spark, str(tmp_path), 1, closing=f"{tmp_path}/closing-b")
    out = ticks.drain(ticks.stale_symbols(stream), [], "append", f"{tmp_path}/closing-b").collect()
    newest = max(r[1] for r in rows)
    late = []
    for s in "ABC":
        at = [r[1] for r in rows if r[3] == s]
        late += [(s, a) for a, b in zip(at, at[1:]) if b - a > dt.timedelta(hours=1)]
        late += [(s, at[-1])] * (at[-1] + dt.timedelta(minutes=70) < newest)
    assert sorted((r["symbol"], r["last"]) for r in out) == sorted(late)


def test_state_holds_what_the_watermark_has_not_passed(spark, tmp_path):
    rows = shuffled_ticks(spark, tmp_path, 3, 9)
    stream = ticks.holding_period(ticks.read_ticks(spark, str(tmp_path), 1), "price", 90, 5, "10 minutes")
    before = spark.conf.get(ticks.STORE[0])
    spark.conf.set(*ticks.STORE)
    try:
        q = stream.writeStream.outputMode("append").format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/state").collect()
    finally:
        spark.conf.set(ticks.STORE[0], before)
    mark = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    assert {r["list_element"]["id"] for r in waiting} == {r[0] for r in rows if r[1] > mark}


def test_fits_do_not_read_the_line_items_again(spark):
    from paneltide.plans import learning

    files = learning.rows(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_closes_equal_those_of_bars_without_putting_all_items_in_order(spark, tmp_path):
    from paneltide.sources import panels

    day = dt.datetime(2000, 1, 3, 7)
    # order, line, part, supplier, price, date: ties of order, line, part and supplier, orders that are null, other hours and dates
    rows = [(1, 1, 1, 1, 5.0, day), (9, 1, 1, 1, 6.0, day), (9, 2, 1, 1, 7.0, day), (9, 2, 1, 2, 8.0, day), (9, 2, 1, 2, 8.5, day), (9, 2, 1, 2, None, day), (None, 7, 1, 1, 1.0, day), (9, 3, 2, 1, 2.0, day), (8, 9, 2, 9, 3.0, day.replace(hour=9))]
    rows += [(None, 1, 3, 1, 4.0, day), (None, 2, 3, 1, 4.5, day), (None, None, 3, 1, 9.0, day), (7, 1, 4, 1, 3.5, day), (6, 1, 4, 1, 3.0, None), (5, 1, 99, 1, 2.5, day), (5, 1, None, 1, 2.5, day), (4, 1, 5, 1, None, day), (9, 9, 2, 1, 1.5, day.replace(day=4))]
    items = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate timestamp").withColumn("l_quantity", F.lit(2.0))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "d"), (5, "e"), (5, "e")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got, want = (sorted(map(str, df.select("symbol", "ts", "close").collect())) for df in (panels.closes_daily(spark, str(tmp_path)), panels.bars_daily(spark, str(tmp_path))))
    assert got == want and len(got) == 8
    for f in (SMALL, "/root/testdata/sf0.01"):
        assert panels.closes_daily(spark, f).exceptAll(panels.bars_daily(spark, f).select("symbol", "ts", "close")).count() == 0
    plan = panels.closes_daily(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "partial_" in line]
    assert any("HashAggregate" in line and "partial_max(l_orderkey" in line for line in first)
    seen = []
    wrapped = panels.closes_daily
    with pytest.MonkeyPatch.context() as m:
        m.setattr(panels, "closes_daily", lambda *a: seen.append(a) or wrapped(*a))
        features.dense(spark, SMALL)
    assert seen  # panels of portfolios are made of these


def test_grid_search_covers_every_bar(spark, monkeypatch):
    from paneltide.operators import learn
    from paneltide.plans import more

    seen = {}
    monkeypatch.setattr(learn, "grid_search", lambda df, models, folds, order, metric: seen.update(df=df, folds=folds, order=order))
    more.grid_search(spark, "/root/testdata/sf0.01")
    folds, n = sorted(seen["folds"]), F.col(seen["order"])
    assert all(a == 0 and a < z < start < end for _, a, z, start, end in folds) and all(x[4] == y[3] for x, y in zip(folds, folds[1:]))
    inside = " OR ".join(f"n BETWEEN {start} AND {end - 1}" for *_, start, end in folds)
    left = seen["df"].where("label IS NOT NULL").withColumn("n", n).where(f"NOT ({inside}) AND n >= {folds[0][3]}").count()
    assert left == 0
    assert seen["df"].where("label IS NOT NULL").where(n < folds[0][3]).where(n >= folds[-1][2]).count() == 0
