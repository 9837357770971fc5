"""Structured Streaming over ticks: bars, sessions, state machines, ledgers, and sinks that can be written again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import hold_step
from ..sources.store import folder
from .ordered import Ordered, whole

#: State with timers needs this store; see drain().
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_ticks(spark: SparkSession, sf_dir: str, files: int | None = None, closing: str | None = None) -> DataFrame:
    """The events table as a stream of (symbol, ts, id, price, user); with `files`, so many files of it in one micro-batch.

    `closing` is a folder for the tick that closes the stream (see drain): it is read beside the table.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema)
    one_or_folder = f"{sf_dir}/events.parque[t]"
    raw = (source if files is None else source.option("maxFilesPerTrigger", files)).parquet(one_or_folder)
    ticks = raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("user_id").alias("user")
    )
    if closing is None:
        return ticks
    spark.createDataFrame([], ticks.schema).write.mode("append").parquet(closing)
    return ticks.unionByName(spark.readStream.schema(ticks.schema).parquet(closing))


def tumbling_bars(ticks: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and number of ticks by symbol and interval; ticks later than `late` are dropped."""
    key = F.struct("ts", "id", "price")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "symbol")
    return bars.agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


def sliding_means(ticks: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    means = ticks.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "symbol")
    return means.agg(F.avg("price").alias("mean"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("ts"), "mean", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: from a tick until none comes for `gap`."""
    s = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user")
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


class _Holding(Ordered):
    """The minimum-holding-period machine over the rows of a symbol, in their order."""

    waiting, memory, start = "at long, id long, x double", "left int, position int", (0, 0)

    def __init__(self, late: bool, threshold: float, horizon: int):
        super().__init__(late)
        self.threshold, self.horizon = threshold, horizon

    def fold(self, key: tuple, memory: tuple, rows: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        left, position = memory
        out = []
        for at, i, x in rows:
            left, position = hold_step(x, left, position, self.threshold, self.horizon)
            out.append((key[0], at, i, position))
        return (left, position), pd.DataFrame(out, columns=["symbol", "at", "id", "position"])


def holding_period(rows: DataFrame, signal: str, threshold: float, horizon: int, late: str | None = None) -> DataFrame:
    """The minimum-holding-period machine with its state (days left, position) kept by symbol across batches.

    With `late`, rows may come in any order within that time: they wait in the state until the watermark has passed them,
    then go through the machine by (ts, id); the last ones come out when the stream is closed (see drain). Rows that come
    later than that are dropped. Without it, rows of a symbol must come in order from batch to batch, are sorted within a
    batch, and come out at once. Null signals count as 0; rows without an id or a time are left out.
    """
    marked = rows.withWatermark("ts", late or "0 seconds")
    keyed = marked.select("symbol", "ts", F.unix_micros("ts").alias("at"), "id", F.col(signal).cast("double").alias("x")).groupBy("symbol")
    machine = _Holding(late is not None, threshold, horizon)
    out = keyed.transformWithStateInPandas(machine, "symbol string, at long, id long, position int", "append", "eventTime" if late else "none")
    return out.select("symbol", F.timestamp_micros("at").alias("ts"), "id", "position")


#: Groups of symbols by a hash: a call and a state of stale_symbols() for each group, not for each symbol.
GROUPS = 256
_TICK = pa.schema([("symbol", pa.string()), ("at", pa.int64()), ("id", pa.int64())])


class _Stale(StatefulProcessor):
    """Ticks of a group's symbols after which none came for `gap`; the state is the ticks that the watermark has not passed, and of each symbol the last one that is settled and not reported yet."""

    def __init__(self, gap: int, grace: int):
        self.gap, self.grace = gap, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = {name: handle.getValueState(name, "ticks binary") for name in ("waiting", "remembered")}

    def load(self, name: str) -> pd.DataFrame:
        ticks = self.state[name].get()[0] if self.state[name].exists() else pa.RecordBatch.from_pylist([], _TICK).serialize().to_pybytes()
        return pa.ipc.read_record_batch(pa.py_buffer(bytes(ticks)), _TICK).to_pandas()

    def store(self, name: str, ticks: pd.DataFrame) -> None:
        if len(ticks):
            self.state[name].update((pa.RecordBatch.from_pandas(ticks, _TICK, preserve_index=False).serialize().to_pybytes(),))
        elif self.state[name].exists():
            self.state[name].clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([df.loc[df["id"].notna() & df["at"].notna(), _TICK.names].astype({"at": "int64", "id": "int64"}) for df in rows])
        if len(new):
            yield from self.settle(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(None, timerValues)

    def settle(self, new: pd.DataFrame | None, times) -> Iterator[pd.DataFrame]:
        mark = times.getCurrentWatermarkInMs() * 1000
        rows = self.load("waiting") if new is None else pd.concat([self.load("waiting"), new])
        rest = rows[rows["at"] > mark]
        ticks = pd.concat([self.load("remembered"), rows[rows["at"] <= mark]], ignore_index=True)
        ticks = ticks.iloc[np.lexsort((ticks["id"], ticks["at"], code := pd.factorize(ticks["symbol"], use_na_sentinel=False)[0]))].assign(code=np.sort(code))
        at = ticks["at"].to_numpy()
        newest = np.append(np.diff(ticks["code"]) != 0, True)[: len(ticks)]
        silent = at + self.gap + self.grace < mark
        out = np.where(newest, silent, np.append(np.diff(at), 0)[: len(ticks)] > self.gap)
        remembered = ticks.loc[newest & ~silent, _TICK.names]
        if new is not None or len(rest) < len(rows):
            self.store("waiting", rest)
        self.store("remembered", remembered)
        wake = [int(x.min()) for x in (rest["at"], remembered["at"] + self.gap + self.grace) if len(x)]
        if wake:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        yield from whole(ticks.loc[out, ["symbol", "at"]].rename(columns={"at": "last"}))

    def close(self) -> None:
        pass


def stale_symbols(ticks: DataFrame, after: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The ticks after which a symbol had none for `after`: found when the next one is settled, or by a timer.

    Ticks may come in any order within `late`. A symbol that stays silent is reported once the watermark is more than
    `after` and `late` behind its last tick; a tick that comes then begins anew. Ticks without an id are left out.
    """
    gap, grace = (int(pd.Timedelta(x).total_seconds() * 1e6) for x in (after, late))
    group = F.pmod(F.xxhash64("symbol"), F.lit(GROUPS)).alias("group")
    keyed = ticks.withWatermark("ts", late).select(group, "symbol", "ts", F.unix_micros("ts").alias("at"), "id").groupBy("group")
    out = keyed.transformWithStateInPandas(_Stale(gap, grace), "symbol string, last long", "append", "eventTime")
    return out.select("symbol", F.timestamp_micros("last").alias("last"))


def ledger(ticks: DataFrame) -> DataFrame:
    """Running turnover and number of trades of each user, in update mode."""
    return ticks.groupBy("user").agg(F.sum("price").alias("cash"), F.count(F.lit(1)).alias("trades"))


def enrich(ticks: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """A stream with the columns of a small static table."""
    return ticks.join(dimension, on, "left")


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function whose output of a batch replaces what an earlier try of it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def drain(stream: DataFrame, keys: list[str], mode: str = "update", closing: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Run a stream until its source has no more and return the last row of each key, written batch by batch.

    With `closing`, the folder that read_ticks was given, a tick without symbol and id is then written there, so late that
    the watermark (`late` behind the newest tick) passes all ticks, and the stream goes on from its checkpoint: rows that
    waited for the watermark come out.
    """
    spark = stream.sparkSession
    path = folder(spark, "stream")

    def run() -> dict:
        before = spark.conf.get(STORE[0])
        spark.conf.set(*STORE)
        try:
            query = stream.writeStream.outputMode(mode).foreachBatch(idempotent_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        finally:
            spark.conf.set(STORE[0], before)
        query.awaitTermination()
        return query.lastProgress

    progress = run()
    if closing is not None:
        mark = F.to_timestamp(F.lit(progress["eventTime"]["watermark"]))
        end = mark + F.expr(f"INTERVAL {late}") * 2 + F.expr("INTERVAL '0.002' SECOND")
        schema = spark.read.parquet(closing).schema
        row = spark.range(1).select(*((end if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        row.write.mode("append").parquet(closing)
        run()
    rows = spark.read.schema(stream.schema.add("batch_id", "long")).option("basePath", f"{path}/out").parquet(f"{path}/out")
    if not keys:
        return rows.drop("batch_id")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))
