"""Rows of a key in their order, from a stream in which they come in another: state that waits for the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def whole(out: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows with plain Python objects for strings, which the state operator wants; nothing if there are none."""
    if len(out):
        yield out.astype({c: object for c in out.columns if not pd.api.types.is_numeric_dtype(out[c])})


#: Rows that go through a fold, or back to the state, at once as Python objects.
AT_ONCE = 1 << 15


class Ordered(StatefulProcessor):
    """A fold over the rows of a key by (at, id), `at` in microseconds.

    List state keeps the rows that the watermark has not passed, value state what the fold remembers. A timer
    stands at the first row that waits. So a key's state is what comes within the delay, whatever the length of the stream.
    Without `late`, all rows are folded as they come. A key's rows of a micro-batch are arrays of numbers, AT_ONCE are Python objects.

    A subclass gives `waiting` and `memory` (schemas; `waiting` begins with at and id, all long or double), `start` (the first memory) and fold().
    """

    waiting: str
    memory: str
    start: tuple

    def __init__(self, late: bool):
        self.late = late

    def fold(self, key: tuple, memory: tuple, rows: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        """Memory and output after these rows, a part of those of a micro-batch."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.remembered = handle.getValueState("remembered", self.memory)
        self.rows = handle.getListState("waiting", self.waiting) if self.late else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for df in rows:
            df = df[df["id"].notna() & df["at"].notna()]
            part = np.empty(len(df), self.kind())
            for c in part.dtype.names:
                part[c] = df[c].to_numpy(part.dtype[c])
            parts.append(part)
        new = np.concatenate(parts) if parts else np.empty(0, self.kind())
        if len(new):
            yield from self.settle(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, np.empty(0, self.kind()), timerValues)

    def kind(self) -> np.dtype:
        return np.dtype([(c.split()[0], "f8" if c.split()[1] == "double" else "i8") for c in self.waiting.split(",")])

    def settle(self, key: tuple, new: np.ndarray, times) -> Iterator[pd.DataFrame]:
        memory = self.remembered.get() if self.remembered.exists() else self.start
        before = memory = tuple(memory)
        waited = self.late and self.rows.exists()
        rows, first = new, None
        if waited:
            old = np.fromiter((tuple(np.nan if v is None else v for v in r) for r in self.rows.get()), self.kind())
            rows, first = np.concatenate([old, new]), int(old["at"].min())
        rows = rows[np.lexsort((rows["id"], rows["at"]))]
        ready = int(np.searchsorted(rows["at"], times.getCurrentWatermarkInMs() * 1000, side="right")) if self.late else len(rows)
        for a in range(0, ready, AT_ONCE):
            memory, out = self.fold(key, memory, rows[a : min(ready, a + AT_ONCE)].tolist())
            yield from whole(out)
        if memory != before or not self.late:
            self.remembered.update(memory)
        rest = rows[ready:]
        if waited and (ready or len(new)):
            self.rows.clear()
        if len(rest) and (ready or len(new)):
            for a in range(0, len(rest), AT_ONCE):
                self.rows.appendList(rest[a : a + AT_ONCE].tolist())
        if len(rest) and int(rest["at"][0]) != first:
            self.handle.registerTimer(int(rest["at"][0]) // 1000 + 1)

    def close(self) -> None:
        pass
