"""Cleaning and calendars: (symbol, ts, ...) in, the same out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..functions.windows import by_symbol, running


def ffill(x: Column, limit: int | None = None) -> Column:
    """The last value that is not null, at most `limit` rows back."""
    w = running() if limit is None else by_symbol().rowsBetween(-limit, 0)
    return F.last(x, ignorenulls=True).over(w)


def bfill(x: Column) -> Column:
    return F.first(x, ignorenulls=True).over(by_symbol().rowsBetween(0, Window.unboundedFollowing))


def densify(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """A row for each symbol and each date of the calendar (by default all dates of the bars); what is missing is null."""
    calendar = bars.select("ts").distinct() if calendar is None else calendar.select("ts").distinct()
    grid = calendar.crossJoin(bars.select("symbol").distinct())  # dates x symbols: the panel itself
    return grid.join(bars, ["ts", "symbol"], "left")


def complete_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that are never null."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count(c).alias(c) for c in columns)).first()
    return [c for c in columns if counts[c] == counts["__n"]]


def alive(panel: DataFrame) -> DataFrame:
    """Symbols with a close on the last date of the panel."""
    last = panel.groupBy("symbol").agg(F.max_by(F.struct("ts", "close"), "ts").alias("last"))
    end = panel.agg(F.max("ts").alias("end"))
    return last.join(F.broadcast(end), (F.col("last.ts") == F.col("end")) & F.col("last.close").isNotNull(), "left_semi").select("symbol")


def enough_history(panel: DataFrame, n: int) -> DataFrame:
    """Rows of symbols with more than n closes."""
    return panel.join(panel.groupBy("symbol").agg(F.count("close").alias("__n")).where(F.col("__n") > n), "symbol", "left_semi")


def iqr_filter(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles, column after column: later quartiles see what is left."""
    for c in columns:
        q = quantiles(df, [], c, {"__a": 0.25, "__z": 0.75}).drop("n")
        room = k * (F.col("__z") - F.col("__a"))
        df = df.join(F.broadcast(q), F.col(c).between(F.col("__a") - room, F.col("__z") + room)).drop("__a", "__z")
    return df


def split(df: DataFrame, fraction: float) -> DataFrame:
    """Adds test_mask: 1 for the rows of a symbol after the first `fraction` of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return df.withColumn("test_mask", (F.row_number().over(by_symbol()) > F.floor(n * fraction)).cast("int"))


def split_dates(df: DataFrame, fraction: float, gap: int = 1) -> DataFrame:
    """Adds test_mask for symbols that are trained on together: 1 on the dates after the first `fraction` of all dates, 0 before,
    null on the last `gap` of these, whose labels reach over the split."""
    dates = df.select("ts").distinct().withColumn("__n", F.row_number().over(Window.orderBy("ts")))  # one row a date
    cut = F.floor(F.col("__all") * fraction)
    dates = dates.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy()))
    mask = F.when(F.col("__n") > cut, 1).when(F.col("__n") <= cut - gap, 0)
    return df.join(dates.select("ts", mask.alias("test_mask")), "ts")


def weekly_schedule(dates: DataFrame, weekday: int | None = None) -> DataFrame:
    """The last date of each ISO week, or the last one on or before a weekday (Monday is 0)."""
    if weekday is not None:
        dates = dates.where(F.weekday("ts") <= weekday)
    return dates.groupBy(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).alias("year"), F.weekofyear("ts").alias("week")).agg(F.max("ts").alias("ts"))


def trim_warmup(returns: DataFrame) -> DataFrame:
    """Rows of a run from its first return that is not 0."""
    first = returns.where("r <> 0").groupBy("run").agg(F.min("ts").alias("__from"))
    return returns.join(first, "run").where("ts >= __from").drop("__from")


def common_window(returns: DataFrame) -> DataFrame:
    """Rows from the date on which all runs have begun, on dates that all runs have."""
    runs = returns.select("run").distinct().count()
    start = returns.where("r <> 0").groupBy("run").agg(F.min("ts").alias("s")).agg(F.max("s").alias("__from"))
    full = returns.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == runs).select("ts")
    return returns.join(full, "ts", "left_semi").join(F.broadcast(start), F.col("ts") >= F.col("__from")).drop("__from")


def staleness(panel: DataFrame, as_of: Column, days: int = 4) -> DataFrame:
    """Per symbol its last date, its age in days, and whether it is too old."""
    last = panel.where("close IS NOT NULL").groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    return last.select("symbol", "last_ts", F.datediff(as_of, "last_ts").alias("age"), (F.datediff(as_of, "last_ts") > days).alias("stale"))


def asof(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (symbol, ts, ...) with the latest `value` of right (symbol, ts, value) at or before ts: one shuffle, no range join."""
    a = left.withColumns({"__k": F.lit(1), "__v": F.lit(None).cast("double")})
    b = right.select("symbol", "ts", F.col(value).cast("double").alias("__v")).withColumn("__k", F.lit(0))
    w = Window.partitionBy("symbol").orderBy("ts", "__k").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return rows.where("__k = 1").drop("__k", "__v")


def merge_series(series: DataFrame, names: list[str]) -> DataFrame:
    """(name, ts, value) to one row for each date with a column for each name, gaps filled forward, then backward."""
    wide = series.groupBy("ts").pivot("name", names).agg(F.first("value"))
    by = Window.orderBy("ts")  # dates alone: some thousand rows
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    filled = wide.select("ts", *(F.last(c, ignorenulls=True).over(back).alias(c) for c in names))
    return filled.select("ts", *(F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(ahead)).alias(c) for c in names))


def pairs(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of two symbols on one date, the first before the second by name: columns with suffixes _1 and _2."""
    a = panel.select("ts", F.col("symbol").alias("symbol_1"), *(F.col(c).alias(f"{c}_1") for c in columns))
    b = panel.select("ts", F.col("symbol").alias("symbol_2"), *(F.col(c).alias(f"{c}_2") for c in columns))
    return a.join(b, "ts").where("symbol_1 < symbol_2")


def pair_rows(panel: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the chosen pairs (symbol_1, symbol_2) alone on their common dates: columns with suffixes _1 and _2."""
    a = panel.select("ts", F.col("symbol").alias("symbol_1"), *(F.col(c).alias(f"{c}_1") for c in columns))
    b = panel.select("ts", F.col("symbol").alias("symbol_2"), *(F.col(c).alias(f"{c}_2") for c in columns))
    return chosen.select("symbol_1", "symbol_2").join(a, "symbol_1").join(b, ["symbol_2", "ts"])
