"""Boosted trees of many models at once against a plain fit of each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.operators import trees

COLUMNS, EDGES = ["u", "v"], [-1.0, -0.5, 0.0, 0.5, 1.0]


def data(seed, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        u, v = rng.gauss(0, 1), rng.choice([None, float("nan"), rng.gauss(0, 1)]) if rng.random() < 0.1 else rng.gauss(0, 1)
        y = None if rng.random() < 0.05 else (u > 0.5) * 2.0 + (0.7 if v is not None and v > 0 and u < 0 else 0.0) + rng.gauss(0, 0.3)
        out.append((i, i // 4, u, v, y))
    return out


def bins(*x):
    return [0 if v is None or v != v else sum(e < v for e in EDGES) for v in x]


def plain(rows, rounds, depth, rate, least):
    """Scores of (bins, target, weight) by a fit of one model."""
    learn = [i for i, (_, y, w) in enumerate(rows) if w > 0 and y is not None]
    if not learn:
        return None
    w = np.array([r[2] for r in rows], float)
    score = np.full(len(rows), np.average([rows[i][1] for i in learn], weights=w[learn]))
    for _ in range(rounds):
        rest = np.array([0.0 if r[1] is None else r[1] for r in rows]) - score
        node, value = np.ones(len(rows), int), np.zeros(len(rows))
        for _ in range(depth):
            for k in set(node[learn]):
                mine = [i for i in learn if node[i] == k]
                best = None
                for f in range(2):
                    for b in range(len(EDGES) + 1):
                        l = [i for i in mine if rows[i][0][f] <= b]
                        r = [i for i in mine if rows[i][0][f] > b]
                        nl, nr = w[l].sum(), w[r].sum()
                        if not any(rows[i][0][f] == b for i in mine) or nl < least or nr < least:
                            continue
                        gl, gr = (w[l] * rest[l]).sum(), (w[r] * rest[r]).sum()
                        gain = round(gl * gl / nl + gr * gr / nr - (gl + gr) ** 2 / (nl + nr), 9)
                        if gain > 0 and (best is None or (-gain, f, b) < best[:3]):
                            best = (-gain, f, b, gl / nl, gr / nr)
                if best:
                    _, f, b, left, right = best
                    here = node == k
                    goes = np.array([r[0][f] > b for r in rows])
                    value[here] = np.where(goes, right, left)[here]
                    node[here] = (2 * node + goes)[here]
        score = score + rate * value
    return score


@pytest.mark.parametrize("depth,rounds", [(1, 1), (3, 5), (2, 3)])
def test_refits_equal_plain_fits(spark, depth, rounds):
    rows, first, every = data(depth), 30, 12
    df = spark.createDataFrame(rows, "row long, at int, u double, v double, target double").repartition(3)
    members = trees.refits(df.select("row", "at", trees.binned(COLUMNS, EDGES).alias("bins"), "target"), first, every, 59).drop("at")
    scored, grown = trees.boosted(members, rounds, depth, 0.3, 5.0)
    got = {r["row"]: (r["model"], r["score"]) for r in scored.where("tested").collect()}
    assert sorted(got) == [r[0] for r in rows if r[1] >= first]
    for m in range(3):
        start = first + m * every
        train = [r for r in rows if r[1] < start - 1]
        test = [r for r in rows if start <= r[1] < start + every]
        want = plain([(bins(u, v), y, 1.0) for *_, u, v, y in train] + [(bins(u, v), None, 0.0) for *_, u, v, _ in test], rounds, depth, 0.3, 5.0)[len(train) :]
        for r, s in zip(test, want):
            assert got[r[0]][0] == m and abs(got[r[0]][1] - s) < 1e-9
    assert {r["model"] for r in grown.select("model").distinct().collect()} == {0, 1, 2}
    assert grown.agg(F.max("round")).first()[0] == rounds - 1


def test_bags_and_weights(spark):
    rows = data(7)
    df = spark.createDataFrame([(i, u, v, y, 1.0 if at < 40 else 0.0, at >= 40) for i, at, u, v, y in rows], "row long, u double, v double, target double, weight double, tested boolean")
    members = trees.bags(df.select("row", trees.binned(COLUMNS, EDGES).alias("bins"), "target", "weight", "tested"), 3, 0.8, ["row"]).cache()
    mean = members.where("NOT tested").groupBy("model").agg(F.avg("weight").alias("m"), F.max("weight").alias("most")).collect()
    assert len(mean) == 3 and all(0.6 < r["m"] < 1.0 and r["most"] >= 2 for r in mean)
    got = {(r["model"], r["row"]): r["score"] for r in trees.boosted(members, 3, 2, 0.5, 5.0)[0].collect()}
    for m in range(3):
        mine = members.where(F.col("model") == m).orderBy("row").collect()
        want = plain([(list(r["bins"]), r["target"], r["weight"]) for r in mine], 3, 2, 0.5, 5.0)
        assert all(abs(got[m, r["row"]] - s) < 1e-9 for r, s in zip(mine, want))


def test_as_many_jobs_for_many_models_as_for_few(spark):
    df = spark.createDataFrame(data(3), "row long, at int, u double, v double, target double").select("row", "at", trees.binned(COLUMNS, EDGES).alias("bins"), "target")
    seen = []
    for every in (30, 2):
        spark.sparkContext.setJobGroup(f"trees{every}", "")
        scored, _ = trees.boosted(trees.refits(df, 30, every, 59).drop("at"), 2, 2)
        scored.count()
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees{every}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[1] <= seen[0] + 2


def test_trees_awkward(spark):
    df = spark.createDataFrame(data(5), "row long, at int, u double, v double, target double").select("row", "at", trees.binned(COLUMNS, EDGES).alias("bins"), "target")
    assert trees.boosted(trees.refits(df.limit(0), 30, 12, 59).drop("at"), 2, 2)[0].count() == 0
    assert trees.refits(df, 70, 12, 59).count() == 0  # no date is late enough for a refit
    none = df.withColumn("target", F.lit(None).cast("double"))
    assert trees.boosted(trees.refits(none, 30, 12, 59).drop("at"), 1, 1)[0].count() == 0
    same = df.withColumn("target", F.lit(2.5))
    scored, grown = trees.boosted(trees.refits(same, 30, 12, 59).drop("at"), 2, 2)
    assert grown.count() == 0 and {r["score"] for r in scored.select("score").distinct().collect()} == {2.5}
    twice = trees.boosted(trees.refits(df.unionByName(df), 30, 30, 59).drop("at"), 1, 1)[0].where("tested")
    assert twice.groupBy("row").agg(F.countDistinct("score").alias("n"), F.count("*").alias("c")).where("n > 1 OR c <> 2").count() == 0
