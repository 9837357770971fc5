"""Correlated pairs by tiles against correlations of all pairs."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from paneltide.operators import clean, metrics


@pytest.mark.parametrize("tile", [3, 1000])
def test_correlated(spark, tile):
    """Gaps, nulls, a constant, a series of one date, repeated rows; whatever the size of the tiles."""
    rng = np.random.default_rng(2)
    dates = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    common = rng.normal(size=120)
    wide = pd.DataFrame({f"S{k:02d}": (k % 4) * 0.5 * (-1) ** (k // 4) * common + rng.normal(size=120) + 50 for k in range(20)}, index=dates)
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    wide["FLAT"], wide["ONE"] = 3.25, np.nan
    wide.loc[dates[5], "ONE"] = 1.0
    rows = [(s, d, None if np.isnan(v) else float(v)) for s in wide for d, v in wide[s].items()]
    df = spark.createDataFrame(rows + rows[:7], "symbol string, ts date, r double")
    got = {(r["symbol_1"], r["symbol_2"]): (r["n"], r["corr"]) for r in metrics.correlated(df, "r", 0.3, tile).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(wide.columns), 2):
        both = wide[[a, b]].dropna()
        c = both[a].corr(both[b]) if len(both) > 1 and both[a].nunique() > 1 and both[b].nunique() > 1 else np.nan
        if abs(c) >= 0.3:
            want[a, b] = (len(both), pytest.approx(c, abs=1e-10))
    assert 10 < len(want) < 190 and got == want
    assert metrics.correlated(df.limit(0), "r", 0.3, tile).collect() == []


def test_rows_of_chosen_pairs(spark):
    df = spark.createDataFrame([(s, dt.date(2021, 1, d), float(d)) for s in "abc" for d in (1, 2)], "symbol string, ts date, r double")
    chosen = spark.createDataFrame([("a", "c")], "symbol_1 string, symbol_2 string")
    got = clean.pair_rows(df, chosen, ["r"])
    assert sorted(map(tuple, got.select("symbol_1", "symbol_2", "ts", "r_1", "r_2").collect())) == [("a", "c", dt.date(2021, 1, d), float(d), float(d)) for d in (1, 2)]
