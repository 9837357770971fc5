"""Finite state machines over series as a scan: blocks of a series work side by side, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a series by time: some dozen to some hundred rows of a daily one.
QUARTER = "QUARTER"


def machine(df: DataFrame, keys: list[str], value: Column, states: int, step: Callable[[Column, Column], Column], start: int = 0, block: str = QUARTER) -> DataFrame:
    """keys, ts, value and state (0 to states - 1) after each row of each series, in order of ts (of one ts, of the value).

    step(state, value) is the next state. A block of rows (those of one `block` of time) is a map of states to states: where the series
    would be after it, from each state. Maps of the blocks before one, put together in order, give the state in which it begins; then its rows are filled in.
    A series of n rows is as many tasks as it has blocks; its own row of maps has `states` numbers for each block.
    """
    rows = df.select(*keys, "ts", value.alias("value"), F.date_trunc(block, F.col("ts")).alias("block"))
    blocks = rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("rows"))
    every = F.array(*(F.lit(i) for i in range(states)))
    mapped = blocks.withColumn("map", F.aggregate("rows", every, lambda now, r: F.transform(now, lambda s: step(s, r["value"]))))
    none = F.array().cast("array<struct<block:timestamp,state:int>>")
    zero = F.struct(F.lit(start).alias("state"), none.alias("out"))
    onward = lambda acc, b: F.struct(F.get(b["map"], acc["state"]).alias("state"), F.concat(acc["out"], F.array(F.struct(b["block"].alias("block"), acc["state"].alias("state")))).alias("out"))
    starts = mapped.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "map"))).alias("maps"))
    starts = starts.select(*keys, F.explode(F.aggregate("maps", zero, onward)["out"]).alias("x")).select(*keys, "x.block", F.col("x.state").alias("start"))
    zero = F.struct(F.col("start").alias("state"), F.array().cast("array<int>").alias("out"))

    def fill(acc: Column, r: Column) -> Column:
        now = step(acc["state"], r["value"])
        return F.struct(now.alias("state"), F.concat(acc["out"], F.array(now)).alias("out"))

    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "block"]]
    both = blocks.alias("a").join(starts.alias("b"), same)
    filled = both.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.rows").alias("rows"), F.aggregate("rows", zero, fill)["out"].alias("out"))
    return filled.select(*keys, F.explode(F.arrays_zip("rows", F.col("out").alias("state"))).alias("x")).select(*keys, "x.rows.ts", "x.rows.value", "x.state")
