"""Backtests: profit and loss of positions and of portfolios of weights, folds, blends and sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_symbol, change, rolling, running
from ..sources.store import stored
from .cross import inverse_vol, momentum, regime_gate, top_k


def profit(df: DataFrame, bps: float = 10.0, cash: float = 10_000.0) -> DataFrame:
    """(symbol, ts, close, position) with r, growth and equity: yesterday's position earns, changes cost."""
    p = F.col("position")
    before = F.coalesce(F.lag(p).over(by_symbol()), F.lit(0))
    r = F.coalesce(change(F.col("close")) * before, F.lit(0.0)) - F.abs(p - before) * (bps / 1e4)
    rows = df.withColumn("r", r)
    rows = rows.withColumn("growth", F.product(1 + F.col("r")).over(running()) - 1)
    return rows.withColumn("equity", cash * (1 + F.col("growth")))


def book(df: DataFrame) -> DataFrame:
    """All symbols of profit() together by date: sum of equity, mean return."""
    return df.groupBy("ts").agg(F.sum("equity").alias("equity"), F.avg("r").alias("r"))


def momentum_weights(panel: DataFrame, schedule: DataFrame, bench: DataFrame, k: int = 5, cap: float = 0.3, lookbacks: tuple[int, ...] = (252, 126), skip: int = 21, vol: int = 63, ma: int = 200, low: float = 0.5) -> DataFrame:
    """(ts, symbol, weight) on schedule dates: the k best by momentum, inverse volatility, less in a falling market."""
    rows = momentum(panel, lookbacks, skip).withColumn("sd", rolling(F.stddev_samp, change(F.col("close")), vol))
    rows = rows.join(F.broadcast(schedule.select("ts").distinct()), "ts", "left_semi")  # dates alone
    rows = rows.where("close IS NOT NULL AND sd IS NOT NULL")
    weights = inverse_vol(top_k(rows, k), "sd", cap)
    gate = regime_gate(bench, ma, low).select("ts", "gate")
    return weights.join(gate, "ts", "left").select("ts", "symbol", (F.col("weight") * F.coalesce("gate", F.lit(1.0))).alias("weight"))


def in_force(days: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, decided, until, ts): for each decision (keys, ts) the days after it up to the next one of its keys (until, null for the last).

    Dates of both are numbered, a decision's days are listed by number and met by an equality join: as many rows as there are days in force.
    """
    numbers = days.select("ts", F.lit(True).alias("day")).unionByName(decisions.select("ts", F.lit(False).alias("day"))).groupBy("ts").agg(F.max("day").alias("day"))
    numbers = numbers.withColumn("i", F.row_number().over(Window.orderBy("ts"))).withColumn("last", F.max("i").over(Window.partitionBy()))  # one row a date
    by = Window.partitionBy(*keys).orderBy("ts") if keys else Window.orderBy("ts")
    spans = decisions.join(numbers.select("ts", "i", "last"), "ts").withColumns({"until": F.lead("ts").over(by), "end": F.coalesce(F.lead("i").over(by), "last")}).where("i < end")
    listed = spans.select(*keys, F.col("ts").alias("decided"), "until", F.explode(F.sequence(F.col("i") + 1, F.col("end"))).alias("i"))
    return listed.join(numbers.where("day").select("ts", "i"), "i").drop("i")


def portfolio(panel: DataFrame, weights: DataFrame, keys: tuple[str, ...] = (), bps: float = 10.0) -> DataFrame:
    """Daily returns (keys, ts, r, turnover, exposure) of weights (keys, ts, symbol, weight) over a dense panel (ts, symbol, close).

    Weights decided at a date's close hold from the next date on, until those of the next decision; a name without a price
    is cash from that date to the next decision. Costs of a decision fall on its date. Dates before the first decision
    are left out.
    """
    weights = stored(weights, "weights")  # a few names for each decision, read four times
    decisions = weights.select(*keys, "ts").distinct()
    calendar = in_force(panel.select("ts").distinct(), decisions, keys)
    gone = F.max(F.when(F.col("close").isNull(), F.col("ts"))).over(running())  # the last date without a price
    r = panel.select("ts", "symbol", "close", change(F.col("close"), 1, by_symbol()).alias("ret"), gone.alias("gone"))
    held = calendar.join(weights.withColumnRenamed("ts", "decided"), [*keys, "decided"]).join(r, ["ts", "symbol"], "left")
    live = F.col("close").isNotNull() & (F.col("gone").isNull() | (F.col("gone") <= F.col("decided")))
    held = held.withColumn("live", live.cast("int"))
    daily = held.groupBy(*keys, "ts").agg(F.sum(F.col("weight") * F.col("live") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.col("weight") * F.col("live")).alias("exposure"))
    # what is left of each holding on the date of the next decision
    left = held.where("ts = until").select(*keys, "ts", "symbol", (F.col("weight") * F.col("live")).alias("was"))
    moved = weights.join(left, [*keys, "ts", "symbol"], "full").groupBy(*keys, "ts").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))).alias("turnover"))
    out = daily.join(moved, [*keys, "ts"], "full")
    return out.select(*keys, "ts", (F.coalesce("gross", F.lit(0.0)) - F.coalesce("turnover", F.lit(0.0)) * (bps / 1e4)).alias("r"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("exposure", F.lit(0.0)).alias("exposure"))


def folded(decisions: DataFrame, decide: Callable[[Column, Column], Column]) -> DataFrame:
    """(run, ts, symbol) of decisions (run, ts, names, ...): in order of ts, decide(held names, decision) gives the names held from it on. A run's decisions are one row."""
    kind = f"struct<ts:{decisions.schema['ts'].dataType.simpleString()},names:array<string>>"
    zero = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast(f"array<{kind}>").alias("out"))

    def onward(acc: Column, d: Column) -> Column:
        names = decide(acc["held"], d)
        return F.struct(names.alias("held"), F.concat(acc["out"], F.array(F.struct(d["ts"].alias("ts"), names.alias("names")))).alias("out"))

    others = [c for c in decisions.columns if c not in ("run", "ts")]
    runs = decisions.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("ts", *others))).alias("d"))
    out = runs.select("run", F.explode(F.aggregate("d", zero, onward)["out"]).alias("x"))
    return out.select("run", "x.ts", F.explode("x.names").alias("symbol"))


def without(names: Column, others: Column) -> Column:
    return F.filter(names, lambda s: ~F.array_contains(others, s))


def buffered(scored: DataFrame, k: int, buffer: float, keys: str = "run") -> DataFrame:
    """(run, ts, symbol) held by a selector that keeps incumbents ranked within ceil(buffer * k), and fills up with the best.

    scored is (run, ts, symbol, rank): a row for each name and decision. Names beyond these ranks and k cannot be chosen; a decision has the others in order.
    """
    reach = math.ceil(buffer * k)
    ranked = scored.select(F.col(keys).cast("string").alias("run"), "ts", "symbol", "rank")
    n = F.row_number().over(Window.partitionBy("run", "ts").orderBy("rank", "symbol"))
    ranked = ranked.withColumn("n", n).where(F.col("n") <= max(reach, k))
    names = F.transform(F.sort_array(F.collect_list(F.struct("n", "symbol"))), lambda x: x["symbol"])

    def decide(held: Column, d: Column) -> Column:
        size, top = F.least(F.lit(k), F.size(d["names"])), F.slice(d["names"], 1, reach)
        stay = F.slice(F.filter(held, lambda s: F.array_contains(top, s)), F.lit(1), size)
        fill = F.slice(without(d["names"], stay), F.lit(1), size - F.size(stay))
        return F.filter(d["names"], lambda s: F.array_contains(F.concat(stay, fill), s))

    return folded(ranked.groupBy("run", "ts").agg(names.alias("names")), decide)


def draw(*columns: str | Column) -> Column:
    """A random text for each row, the MD5 of some of its columns as text: any engine can draw the same."""
    return F.md5(F.concat_ws("|", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns)))


def random_k(panel: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(run, ts, symbol): k names at random for each seed and date, by a hash; all seeds in one job."""
    rows = panel.where("close IS NOT NULL").select("ts", "symbol").crossJoin(F.broadcast(seeds.select(F.col("run"))))  # the runs asked for
    w = Window.partitionBy("run", "ts").orderBy(draw("run", "ts", "symbol"))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def folds(n: int, train: int, test: int, purge: int = 5, expanding: bool = True) -> list[tuple[int, int, int, int]]:
    """(fold, first training row, training end, test start, test end): tests follow each other, a last one under 5 rows is left out."""
    first = train + purge
    if first + 5 > n:
        raise ValueError("not enough rows for one fold")
    out, start = [], first
    while start < n and min(start + test, n) - start >= 5:
        out.append((len(out), 0 if expanding else start - purge - train, start - purge, start, min(start + test, n)))
        start += test
    return out


def fold_table(dates: DataFrame, train: int, test: int, purge: int = 5, expanding: bool = True) -> DataFrame:
    """folds() of each run's dates as rows (run, fold, slice_start, train_end, test_start, test_end), built by Spark."""
    n = dates.groupBy("run").agg(F.countDistinct("ts").alias("n")).where(F.col("n") >= train + purge + 5)
    rows = n.select("run", "n", F.posexplode(F.sequence(F.lit(train + purge), F.col("n") - 1, F.lit(test))).alias("fold", "test_start"))
    rows = rows.withColumn("test_end", F.least(F.col("test_start") + test, F.col("n"))).where(F.col("test_end") - F.col("test_start") >= 5)
    start = F.lit(0) if expanding else F.col("test_start") - purge - train
    return rows.select("run", "fold", start.cast("long").alias("slice_start"), (F.col("test_start") - purge).alias("train_end"), "test_start", "test_end")


def blend_daily(returns: DataFrame, shares: Column) -> DataFrame:
    """Returns of sleeves (run, ts, r) mixed each day by shares (a map from run)."""
    return returns.withColumn("__w", shares[F.col("run")]).where("__w IS NOT NULL").groupBy("ts").agg(F.sum(F.col("__w") * F.col("r")).alias("r"))


def blend_weekly(returns: DataFrame, shares: Column) -> DataFrame:
    """The same with shares restored on the first date of each ISO week and drifting within it."""
    week = F.extract(F.lit("YEAROFWEEK"), F.col("ts")) * 100 + F.weekofyear("ts")
    rows = returns.withColumns({"__w": shares[F.col("run")], "week": week}).where("__w IS NOT NULL")
    inside = Window.partitionBy("run", "week").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    value = rows.withColumn("v", F.col("__w") * F.product(1 + F.col("r")).over(inside)).groupBy("week", "ts").agg(F.sum("v").alias("v"), F.sum("__w").alias("w"))
    by = Window.partitionBy("week").orderBy("ts")
    return value.select("ts", (F.col("v") / F.coalesce(F.lag("v").over(by), F.col("w")) - 1).alias("r"))


def yearly_turnover(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean turnover of a decision times 52, mean exposure, and the cost a year in basis points times 1e-4."""
    return daily.groupBy(*keys).agg((F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))) * 52).alias("turnover"), F.avg("exposure").alias("exposure"))


def sticky_random(panel: DataFrame, seeds: DataFrame, k: int, swap: int) -> DataFrame:
    """(run, ts, symbol): k names a date of which `swap` are replaced at the next, by a hash."""
    rows = panel.where("close IS NOT NULL").select("ts", "symbol").crossJoin(F.broadcast(seeds.select("run")))  # the runs asked for
    names = F.transform(F.sort_array(F.collect_list(F.struct(draw("run", "ts", "symbol").alias("h"), "symbol"))), lambda x: x["symbol"])

    def decide(held: Column, d: Column) -> Column:
        stay = F.filter(held, lambda s: F.array_contains(d["names"], s))
        stay = F.when(F.size(stay) == k, F.slice(stay, min(swap, k) + 1, k)).otherwise(stay)
        return F.slice(F.concat(stay, F.slice(without(d["names"], held), F.lit(1), k - F.size(stay))), 1, k)

    return folded(rows.groupBy("run", "ts").agg(names.alias("names")), decide)


def schedule_weights(scored: DataFrame, schedules: DataFrame, k: int, cap: float = 0.3) -> DataFrame:
    """(run, ts, symbol, weight) of the k best of each run's own decision dates, from scores of all dates (score, sd)."""
    rows = scored.join(F.broadcast(schedules.select("run", "ts")), "ts").where("close IS NOT NULL AND sd IS NOT NULL")  # dates of each run
    return inverse_vol(top_k(rows, k, keys=("run", "ts")), "sd", cap, ("run", "ts"))


def assign_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows (run, n, ...) of number n within a run with the fold in whose test span they are, and test_mask."""
    inside = (F.col("n") >= F.col("test_start")) & (F.col("n") < F.col("test_end"))
    spans = folds.select("run", "fold", "test_start", "test_end")
    return rows.join(F.broadcast(spans), (rows["run"] == spans["run"]) & inside, "left").select(rows["*"], "fold", F.col("fold").isNotNull().cast("int").alias("test_mask"))  # folds are few
