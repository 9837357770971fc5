"""Order statistics of many rows: exact quantiles of groups of any size, and quantiles of all that came before a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

#: Ranks that a sketch may be off by, as a share of a group's rows: 1 / ACCURACY.
ACCURACY = 10_000
#: Distances of cuts from a quantile, in units of 1 / ACCURACY.
AROUND = (2, 16, 128, 1024)
#: Children of a node of the tree of ranks: 2 ** BITS.
BITS = 4


def _between(low, high, share):
    return F.when(share > 0, low * (1 - share) + high * share).otherwise(low)


def quantiles(df: DataFrame, keys: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """keys, n and a column for each of qs: its quantile of x within the keys, between two values in proportion, as F.percentile has it.

    F.percentile keeps every different value of a group in one task. Here a mergeable sketch of a group gives cuts around each
    quantile, exact counts between the cuts say which cell has the value, and only the rows of that cell are put in order, equal values
    as one with a count. The cuts decide how much is left to be sorted, never the result: a poor sketch makes cells larger. Nulls of
    x do not count; a group of nulls has n = 0 and null quantiles; null keys are a group; an empty table gives no rows (one row of
    n = 0 without keys).
    """
    rows = stored(df.select(*keys, F.col(x).cast("double").alias("__x")), "quantiles")
    cuts = sorted({min(1.0, max(0.0, q + s * a / ACCURACY)) for q in qs.values() for a in AROUND for s in (-1, 1)})
    groups = rows.groupBy(*keys).agg(F.percentile_approx("__x", F.array(*map(F.lit, cuts)), F.lit(ACCURACY)).alias("__cuts"), F.count("__x").alias("n"))
    groups = groups.withColumn("__cuts", F.array_distinct("__cuts"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]

    def joined(left: DataFrame, right: DataFrame, *more) -> DataFrame:
        on = [*same, *more]
        return left.alias("r").join(right.alias("g"), reduce(lambda a, b: a & b, on) if on else F.lit(True))  # without keys the right side is one row a quantile

    inside = joined(rows.where("__x IS NOT NULL"), groups)
    inside = inside.select(*(F.col(f"r.{k}").alias(k) for k in keys), "__x", F.size(F.filter("__cuts", lambda c: c < F.col("__x"))).alias("__cell"))
    cells = inside.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__m"))
    by = Window.partitionBy(*keys).orderBy("__cell")  # a few cells
    cells = cells.withColumn("__to", F.sum("__m").over(by)).withColumn("__from", F.col("__to") - F.col("__m"))

    at = lambda q: q * (F.col("n") - 1)
    places = F.array(*(F.struct(F.lit(name).alias("__q"), F.lit(side).alias("__side"), f(at(q)).cast("long").alias("__place")) for name, q in qs.items() for side, f in ((0, F.floor), (1, F.ceil))))
    wanted = groups.where("n > 0").select(*keys, F.inline(places))
    found = joined(cells, wanted, F.col("g.__place") >= F.col("r.__from"), F.col("g.__place") < F.col("r.__to"))
    found = found.select(*(F.col(f"r.{k}").alias(k) for k in keys), "__cell", "__q", "__side", (F.col("__place") - F.col("__from")).alias("__place"))

    held = joined(inside, found.select(*keys, "__cell").distinct(), F.col("g.__cell") == F.col("r.__cell")).select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("r.__cell").alias("__cell"), "__x")
    values = held.groupBy(*keys, "__cell", "__x").agg(F.count(F.lit(1)).alias("__m"))
    values = values.withColumn("__to", F.sum("__m").over(Window.partitionBy(*keys, "__cell").orderBy("__x")))
    picked = joined(values, found, F.col("g.__cell") == F.col("r.__cell"), F.col("g.__place") < F.col("r.__to"), F.col("g.__place") >= F.col("r.__to") - F.col("r.__m"))
    picked = picked.groupBy(*(F.col(f"r.{k}").alias(k) for k in keys)).agg(*(F.max(F.when((F.col("__q") == name) & (F.col("__side") == s), F.col("__x"))).alias(f"__{name}{s}") for name in qs for s in (0, 1)))

    share = lambda q: at(q) - F.floor(at(q))
    out = groups.alias("r").join(picked.alias("g"), reduce(lambda a, b: a & b, same) if same else F.lit(True), "left")
    return out.select(*(F.col(f"r.{k}").alias(k) for k in keys), "n", *(_between(F.col(f"__{name}0"), F.col(f"__{name}1"), share(q)).alias(name) for name, q in qs.items()))


def running_quantile(df: DataFrame, keys: list[str], order: str, x: str, q: float, name: str = "quantile", least: int = 1) -> DataFrame:
    """df with `name`: the q-quantile of x over all rows of the keys before a row (by `order`, which is unique within them), null
    where fewer than `least` of these have an x.

    A tree over the ranks of all values: a row asks the root how many of each child's values came before it, goes on to the child that
    has the place it looks for, and so on to a single rank. A level is one running count within the nodes, so n rows take n times
    the logarithm of n steps, where an exact percentile over a growing frame takes n for each row. The root's count and the ranks
    are one task for each series; null keys are a series. An empty table gives no rows.
    """
    series, (by, no) = [f"__k{i}" for i in range(len(keys))], ("__i", "__no")
    named = stored(df, "running")
    base = named.select(*(F.col(k).alias(s) for k, s in zip(keys, series)), F.col(order).alias(by), F.col(x).cast("double").alias("__x"))
    before = Window.partitionBy(*series).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ranks = Window.partitionBy(*series).orderBy(F.col("__x").asc_nulls_last(), by)
    base = base.withColumns({"__n": F.count("__x").over(before), no: F.when(F.col("__x").isNotNull(), F.row_number().over(ranks) - 1)})
    base = stored(base, "ranks")
    most = base.agg(F.max(no)).first()[0] or 0
    levels = max(1, -(-int(most).bit_length() // BITS))

    place = F.lit(q) * (F.col("__n") - 1)
    kinds = F.array(
        F.struct(F.lit(2).alias("kind"), F.lit(None).cast("long").alias("place"), F.col(no).cast("long").alias("rank")),
        F.struct(F.lit(0).alias("kind"), F.floor(place).alias("place"), F.lit(None).cast("long").alias("rank")),
        F.struct(F.lit(1).alias("kind"), F.ceil(place).alias("place"), F.lit(None).cast("long").alias("rank")),
    )
    asked = base.where(f"{no} IS NOT NULL OR __n >= {max(1, least)}").select(*series, by, "__n", F.lit(0).cast("long").alias("node"), F.inline(kinds))
    rows = asked.where(f"CASE WHEN kind = 2 THEN rank IS NOT NULL ELSE __n >= {max(1, least)} END")
    for level in range(levels - 1, -1, -1):
        digit = F.shiftright("rank", BITS * level).bitwiseAND(2**BITS - 1)
        seen = Window.partitionBy(*series, "node").orderBy(by, "kind").rowsBetween(Window.unboundedPreceding, 0)  # what asks comes before what is asked
        counts = F.array(*(F.sum((F.coalesce(digit, F.lit(-1)) == c).cast("long")).over(seen) for c in range(2**BITS)))
        rows = rows.withColumns({"digit": digit, "counts": counts})
        start = F.struct(F.lit(0).cast("long").alias("c"), F.col("place").alias("rest"), F.lit(False).alias("found"))
        down = F.aggregate(
            "counts", start,
            lambda a, n: F.when(a["found"] | (a["rest"] < n), F.struct(a["c"].alias("c"), a["rest"].alias("rest"), F.lit(True).alias("found"))).otherwise(F.struct((a["c"] + 1).alias("c"), (a["rest"] - n).alias("rest"), F.lit(False).alias("found"))),
        )
        rows = rows.withColumn("down", F.when(F.col("kind") < 2, down))
        rows = rows.select(*series, by, "__n", (F.col("node") * 2**BITS + F.coalesce("digit", "down.c")).alias("node"), "kind", F.col("down.rest").alias("place"), "rank")

    # a node is a rank by now
    rows = rows.where("kind < 2").select(*series, by, "__n", "kind", F.col("node").alias(no))
    known = base.where(f"{no} IS NOT NULL").select(*(F.col(s).alias(f"{s}v") for s in series), F.col(no).cast("long").alias("__rank"), "__x")
    same = reduce(lambda a, b: a & b, [F.col(no) == F.col("__rank"), *(F.col(s).eqNullSafe(F.col(f"{s}v")) for s in series)])
    ends = rows.join(known, same).groupBy(*series, by).agg(F.max("__n").alias("__n"), *(F.max(F.when(F.col("kind") == k, F.col("__x"))).alias(f"__e{k}") for k in (0, 1)))
    ends = ends.select(*series, by, _between(F.col("__e0"), F.col("__e1"), place - F.floor(place)).alias(name))
    on = reduce(lambda a, b: a & b, [F.col(order).eqNullSafe(F.col(by)), *(F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, series))])
    return named.join(ends, on, "left").drop(*series, by)
