"""Boosted regression trees of many models at once, as aggregations over (model, node, feature, bin).

A row is a member of every model that learns from it or scores it. Level by level, one aggregation gives the histograms of all nodes of all
models, the best split of each node is taken from them, and the members move on to the nodes below. So refits, bags and grids of
trees take as many passes as one model. Squared error, histograms of numbered bins, the same depth for all nodes that can still be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored

#: Rounds, levels of a tree, rate of learning, summed weight of a leaf at least.
ROUNDS, DEPTH, RATE, LEAST = 10, 3, 0.1, 5.0


def binned(columns: list[str], edges: list[float]) -> Column:
    """Numbers of bins of the columns: how many edges (rising) lie below the value; a null or NaN is in the lowest."""
    grid = F.array(*map(F.lit, edges))
    one = lambda c: F.coalesce(F.size(F.filter(grid, lambda e: e < F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))), F.lit(0))
    return F.array(*map(one, columns))


def splits(members: DataFrame, least: float = LEAST) -> DataFrame:
    """model, node, feature, bin, gain, left, right: the best split of each node that has one, of members (model, node, bins, rest, weight).

    Rows up to the bin go left. left and right are the mean rests there. Of equal gains (to nine digits) the first feature and bin is taken.
    """
    at = members.where("weight > 0").select("model", "node", "weight", (F.col("weight") * F.col("rest")).alias("g"), F.posexplode("bins").alias("feature", "bin"))
    cells = at.groupBy("model", "node", "feature", "bin").agg(F.sum("weight").alias("n"), F.sum("g").alias("g"))
    all_ = Window.partitionBy("model", "node", "feature")
    up_to = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("model", "node", "feature", "bin", F.sum("n").over(up_to).alias("nl"), F.sum("g").over(up_to).alias("gl"), F.sum("n").over(all_).alias("n"), F.sum("g").over(all_).alias("g"))
    nr, gr = F.col("n") - F.col("nl"), F.col("g") - F.col("gl")
    cells = cells.where((F.col("nl") >= least) & (nr >= least)).withColumns({"left": F.col("gl") / F.col("nl"), "right": gr / nr})
    gain = F.round(F.col("gl") * F.col("left") + gr * F.col("right") - F.col("g") * F.col("g") / F.col("n"), 9)
    best = cells.where(gain > 0).groupBy("model", "node").agg(F.min(F.struct((-gain).alias("loss"), "feature", "bin", "left", "right")).alias("s"))
    return best.select("model", "node", "s.feature", "s.bin", (-F.col("s.loss")).alias("gain"), "s.left", "s.right")


def moved(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members below the splits of their nodes (2n left, 2n + 1 right), with the mean rest there; those of a node without one stay."""
    s = found.select("model", "node", "feature", F.col("bin").alias("__bin"), "left", "right")
    goes = F.get("bins", F.col("feature")) > F.col("__bin")
    out = members.join(s, ["model", "node"], "left")
    return out.withColumns({"node": F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + goes.cast("long")), "value": F.coalesce(F.when(goes, F.col("right")).otherwise(F.col("left")), F.col("value"))}).drop("feature", "__bin", "left", "right")


def boosted(members: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """members (model, row, bins, target, weight, tested) with their score, and the trees (model, round, node, feature, bin, gain, left, right).

    Members of weight 0 or without a target are scored alone. A model's first score is its mean target; each round adds `rate` times a tree of what is left of it.
    A level is one job for all models, the last of a round with the scores after it: rounds * depth jobs, and one for the means.
    """
    weight = F.when(F.col("target").isNull() | F.isnan("target"), F.lit(0.0)).otherwise(F.col("weight").cast("double"))
    base = members.select("model", "row", "bins", F.col("target").cast("double").alias("target"), weight.alias("weight"), "tested")
    means = base.where("weight > 0").groupBy("model").agg((F.sum(F.col("weight") * F.col("target")) / F.sum("weight")).alias("score"))
    state = stored(base.join(means, "model"), "boosted")  # a model without rows to learn from scores none
    trees = None
    for i in range(rounds):
        now = state.withColumns({"rest": F.coalesce(F.col("target") - F.col("score"), F.lit(0.0)), "node": F.lit(1).cast("long"), "value": F.lit(0.0)})
        for level in range(depth):
            found = stored(splits(now, least), "splits")
            grown = found.withColumn("round", F.lit(i))
            trees = grown if trees is None else trees.unionByName(grown)
            now = moved(now, found)
        state = now.withColumn("score", F.col("score") + rate * F.col("value")).drop("rest", "node", "value")
        if i % 4 == 3 or i + 1 == rounds:  # lineage of a few rounds: joins with small tables
            state = stored(state, "boosted")
    return state, trees


def refits(rows: DataFrame, first: int, every: int, last: int, gap: int = 1) -> DataFrame:
    """Members of walk-forward refits of rows with a date number `at`: model i scores the dates first + i * every on, up to the next model, and learns from those before its first by more than `gap`.

    Weight is 1 where it learns, tested where it scores. `last` is the largest date number of any row.
    """
    count = max(0, -(-(last + 1 - first) // every))
    learns = F.greatest(F.lit(0), F.ceil((F.col("at") + gap + 1 - first) / every)).cast("int")
    train = rows.where(learns <= count - 1).withColumns({"model": F.explode(F.sequence(learns, F.lit(count - 1))), "weight": F.lit(1.0), "tested": F.lit(False)}) if count else rows.limit(0).withColumns({"model": F.lit(0), "weight": F.lit(1.0), "tested": F.lit(False)})
    test = rows.where(F.col("at") >= first).withColumns({"model": F.floor((F.col("at") - first) / every).cast("int"), "weight": F.lit(0.0), "tested": F.lit(True)})
    return train.unionByName(test)


def bags(rows: DataFrame, n: int, fraction: float, key: list[str]) -> DataFrame:
    """Members of n bags of rows (weight, ...): a row is in a bag as often as a Poisson number of mean `fraction` says, drawn by a hash of its key."""
    u = F.pmod(F.xxhash64(*key, F.col("model"), F.lit("bag")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    term, below, times = 2.718281828459045**-fraction, 0.0, F.lit(0)
    for k in range(12):
        below += term
        times = times + (u >= below).cast("int")
        term *= fraction / (k + 1)
    drawn = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return drawn.withColumn("weight", F.col("weight") * times)
