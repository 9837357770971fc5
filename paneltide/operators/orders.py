"""Sleeves of one account: ownership, net targets, orders, and checks of their configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def net_targets(targets: DataFrame, sleeves: DataFrame) -> DataFrame:
    """(sleeve, symbol, weight) and (sleeve, allocation): weight of each symbol over all sleeves."""
    s = sleeves.select("sleeve", "allocation")
    return targets.join(F.broadcast(s), "sleeve").groupBy("symbol").agg(F.sum(F.col("weight") * F.col("allocation")).alias("weight"))  # sleeves are few


def owned(sleeves: DataFrame) -> DataFrame:
    return sleeves.where("NOT residual").select("sleeve", F.explode("universe").alias("symbol"))


def orphans(book: DataFrame, sleeves: DataFrame) -> DataFrame:
    """Held symbols that no sleeve claims; a residual sleeve, if there is one, takes them."""
    return book.join(owned(sleeves).select("symbol").distinct(), "symbol", "left_anti")


def ready(sleeves: DataFrame, priced: DataFrame) -> DataFrame:
    """The sleeves that can be computed: at least top_k names of their universe are in `priced` (symbol)."""
    names = sleeves.select("sleeve", "top_k", F.explode("universe").alias("symbol")).join(priced.select("symbol").distinct(), "symbol", "left_semi")
    return names.groupBy("sleeve", "top_k").agg(F.count(F.lit(1)).alias("n")).where("n >= top_k").select("sleeve")


def managed(book: DataFrame, sleeves: DataFrame, ready: DataFrame) -> DataFrame:
    """(sleeve, symbol) that the ready sleeves manage: their universes, and for a residual one the orphans."""
    rest = orphans(book, sleeves).select("symbol").crossJoin(F.broadcast(sleeves.where("residual").select("sleeve")))  # one at most
    return owned(sleeves).unionByName(rest.select("sleeve", "symbol")).join(ready.select("sleeve"), "sleeve", "left_semi")


def foreign(book: DataFrame, sleeves: DataFrame, mine: str) -> DataFrame:
    """Held symbols that belong to another sleeve than `mine`."""
    return book.join(owned(sleeves).where(F.col("sleeve") != mine).select("symbol"), "symbol", "left_semi")


def build_orders(targets: DataFrame, book: DataFrame, equity: Column, least: float = 1.0, share: float = 0.005) -> DataFrame:
    """(symbol, weight) against (symbol, notional): seq, symbol, side, notional, close_all; sales first, then by size.

    A difference under the larger of `least` and `share` of equity is left alone; a target under `least` closes the position.
    """
    t, b = targets.select("symbol", "weight"), book.select("symbol", F.col("notional").alias("now"))
    both = t.join(b, "symbol", "full").select("symbol", (equity * F.coalesce("weight", F.lit(0.0))).alias("to"), F.coalesce("now", F.lit(0.0)).alias("now"))
    rows = both.withColumn("delta", F.col("to") - F.col("now")).where(F.abs("delta") >= F.greatest(F.lit(least), share * equity))
    out = (F.col("to") < least) & (F.col("now") > 0)
    w = Window.orderBy((F.col("delta") > 0), F.abs("delta").desc(), "symbol")  # the orders of one account
    return rows.select(F.row_number().over(w).alias("seq"), "symbol", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.when(~out, F.round(F.abs("delta"), 2)).alias("notional"), out.alias("close_all"))


def drop_small(weights: DataFrame) -> DataFrame:
    """Weights of at least 1 / (5 n), made to sum to 1 again."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    kept = weights.withColumn("__n", n).where(F.col("weight") >= 1 / (5 * F.col("__n"))).drop("__n")
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def sleeve_faults(sleeves: DataFrame) -> DataFrame:
    """fault, detail: what is wrong with (sleeve, allocation, residual, universe, top_k, cap)."""
    total = sleeves.agg(F.sum("allocation").alias("s"), F.count_if("residual").alias("r"), F.count(F.lit(1)).alias("n"), F.countDistinct("sleeve").alias("d"))
    out = total.where(F.abs(F.col("s") - 1) > 1e-9).select(F.lit("allocations").alias("fault"), F.lit("do not sum to 1").alias("detail"))
    out = out.union(total.where("r > 1").select(F.lit("residual"), F.lit("more than one")))
    out = out.union(total.where("n > d").select(F.lit("names"), F.lit("not unique")))
    twice = owned(sleeves).distinct().groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = out.union(twice.select(F.lit("universe"), F.col("symbol")))
    return out.union(sleeves.where("top_k * cap < 1").select(F.lit("cap"), F.col("sleeve")))


def universe_check(fresh: DataFrame, last: DataFrame, low: int, high: int, pattern: str = r"^[A-Z][A-Z0-9#.\-]{0,9}$", least: float = 0.85) -> DataFrame:
    """n, bad, jaccard, valid of a list of tickers against the last good one."""
    f, old = fresh.select(F.collect_set("ticker").alias("f"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ticker").rlike(pattern)).alias("bad")), last.select(F.collect_set("ticker").alias("o"))
    both = f.crossJoin(old)  # a row each
    j = F.try_divide(F.size(F.array_intersect("f", "o")), F.size(F.array_union("f", "o")))
    rows = both.select("n", "bad", j.alias("jaccard"))
    return rows.withColumn("valid", F.col("n").between(low, high) & (F.col("bad") == 0) & (F.col("jaccard") >= least))


def with_fallback(fresh: DataFrame, last: DataFrame, check: DataFrame) -> DataFrame:
    """The fresh list if the check passed, else the last good one."""
    ok = F.broadcast(check.select("valid"))  # one row
    return fresh.select("ticker").join(ok, F.col("valid")).select("ticker").union(last.select("ticker").join(ok, ~F.col("valid")).select("ticker"))
