"""Exponential averages (seed: the first value) as a scan in blocks: windows over one partitioning, no Python, no join.

Inside a block the recurrence is a scaled running sum; the value carried into a block is a weighted sum of the ends of
earlier blocks, of which only those that still matter in double precision are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(df: DataFrame, out: str, x: Column, span: float | None = None, alpha: float | None = None) -> DataFrame:
    """df (symbol, ts, ...) with column `out`: e = (1 - a) e' + a x, from the first row on which x is not null.

    a is `alpha` or 2 / (span + 1). Rows before the first value, or without one later, have null; x must have no later gaps.
    """
    a = alpha if alpha is not None else 2 / (span + 1)
    if a >= 1:
        return df.withColumn(out, x)
    keep = 1 - a
    block = max(1, min(256, int(600 / -math.log(keep))))  # powers of `keep` stay within the range of doubles
    reach = max(1, math.ceil(40 / (-math.log(keep) * block)))  # blocks after which a value is below rounding
    by = Window.partitionBy("symbol").orderBy("ts")
    rows = df.withColumn("__x", x)
    rows = rows.withColumn("__n", F.count("__x").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumns({"__b": F.floor(F.col("__n") / block), "__j": F.col("__n") % block})
    weight = F.when(F.col("__n") == 0, 1.0).otherwise(a)
    scaled = F.when(F.col("__x").isNotNull(), weight * F.col("__x") * F.pow(F.lit(keep), -F.col("__j")))
    inside = Window.partitionBy("symbol", "__b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__e", F.sum(scaled).over(inside) * F.pow(F.lit(keep), F.col("__j")))
    # the ends of the last blocks, oldest first: one value a block, in the same partition as all else
    ends = F.when((F.col("__j") == block - 1) & F.col("__x").isNotNull(), F.col("__e"))
    past = Window.partitionBy("symbol").orderBy("__b").rangeBetween(-reach, -1)
    rows = rows.withColumn("__ends", F.collect_list(ends).over(past))
    rows = rows.withColumn("__carry", F.aggregate("__ends", F.lit(0.0), lambda acc, e: acc * keep**block + e))
    value = F.col("__e") + F.col("__carry") * F.pow(F.lit(keep), F.col("__j") + 1)
    return rows.withColumn(out, F.when(F.col("__x").isNotNull(), value)).drop("__x", "__n", "__b", "__j", "__e", "__ends", "__carry")


def wilder(df: DataFrame, out: str, x: Column, n: int) -> DataFrame:
    return ema(df, out, x, alpha=1 / n)


def ema_adjusted(df: DataFrame, out: str, x: Column, span: float) -> DataFrame:
    """The average with weights that sum to 1 at every row: a plain scan over x by the same scan over 1 less what the seed adds."""
    a = 2 / (span + 1)
    # with weights (1-a)^k for all rows: (e - (1-a)^(n+1) x0) / (1 - (1-a)^(n+1)) where e has the seed x0 in full
    by = Window.partitionBy("symbol").orderBy("ts")
    rows = ema(df.withColumn("__v", x), "__full", F.col("__v"), alpha=a)
    n = F.count("__v").over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__v", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.pow(F.lit(1 - a), n)
    return rows.withColumn(out, (F.col("__full") - gone * first) / (1 - gone)).drop("__v", "__full")
