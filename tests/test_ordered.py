"""State of ordered streams without a stream: what a call holds, and what comes out."""

import random
from types import SimpleNamespace

import pandas as pd

from paneltide.operators.rules import hold_step
from paneltide.streaming import ordered, ticks


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]


def handle():
    return SimpleNamespace(getValueState=lambda *_: Value(), getListState=lambda *_: Value(), registerTimer=lambda at: None)


def at(mark):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: mark // 1000)


def test_stale_symbols_of_a_group_in_one_call():
    rng = random.Random(4)
    rows = sorted((rng.randrange(0, 900_000, 1000), i, f"s{rng.randrange(40)}") for i in range(600))
    machine = ticks._Stale(60_000, 10_000)
    machine.init(handle())
    out = []
    for a in range(0, 600, 150):
        part = pd.DataFrame(rng.sample(rows[a : a + 150], 150), columns=["at", "id", "symbol"])
        out += [x for df in machine.handleInputRows((1,), iter([part[:70], part[70:]]), at(rows[a][0] - 1000)) for x in df.itertuples(index=False, name=None)]
    out += [x for df in machine.handleExpiredTimer((1,), at(901_000), None) for x in df.itertuples(index=False, name=None)]
    want = []
    for s in {r[2] for r in rows}:
        times = [r[0] for r in rows if r[2] == s]
        want += [(s, x) for x, y in zip(times, times[1:]) if y - x > 60_000] + [(s, times[-1])] * (times[-1] + 70_000 < 901_000)
    assert sorted(out) == sorted(want) and not machine.state["waiting"].exists()


def test_rows_of_a_key_are_folded_in_parts(monkeypatch):
    monkeypatch.setattr(ordered, "AT_ONCE", 16)
    rng = random.Random(5)
    rows = [(1000 * i, i, rng.choice([None, -0.2, 0.05, 0.3])) for i in range(200)]
    machine = ticks._Holding(True, 0.1, 5)
    machine.init(handle())
    frame = pd.DataFrame(rng.sample(rows, 200), columns=["at", "id", "x"])
    out = list(machine.handleInputRows(("A",), iter([frame]), at(0))) + list(machine.handleExpiredTimer(("A",), at(10**6), None))
    left = position = 0
    want = []
    for t, i, x in rows:
        left, position = hold_step(x, left, position, 0.1, 5)
        want.append(("A", t, i, position))
    assert max(map(len, out)) <= 16 and [r for df in out for r in df.itertuples(index=False, name=None)] == want
    assert not machine.rows.exists()
