"""Joins, set operations, ordering and the remaining small operators as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import change
from ..operators import backtest, clean, cross, metrics, orders, rules
from ..sources import panels
from .features import D
from .market import account, returns, sleeve_table, _BOOK, _SLEEVES, _TARGET
from .oracle import BARS, BENCH, RETURNS, S, WEEKLY, day, fix, fixed, query, sfix, sfixed


@query(f"WITH {BARS}, {BENCH}, l AS (SELECT symbol, max(ts) AS ts FROM bars GROUP BY 1) SELECT symbol, CAST(ts AS VARCHAR) AS d, {sfix('close', 3)} AS close, {sfix('bench', 3)} AS bench FROM l JOIN bars USING (symbol, ts) JOIN bench USING (ts)")
def last_bar_per_symbol(spark, sf_dir):
    last = panels.bars_daily(spark, sf_dir).groupBy("symbol").agg(F.max_by(F.struct("ts", "close"), "ts").alias("l")).select("symbol", "l.*")
    return last.join(panels.bench_daily(spark, sf_dir), "ts").select("symbol", day(), *fixed({"close": 3, "bench": 3}))


@query(f"WITH {BARS} SELECT symbol, CAST(max_by(ts, (close, ts)) AS VARCHAR) AS best_d, CAST(min_by(ts, (close, ts)) AS VARCHAR) AS worst_d, {sfix('max(close)', 3)} AS best FROM bars GROUP BY 1")
def extreme_days(spark, sf_dir):
    key = F.struct("close", "ts")
    return panels.bars_daily(spark, sf_dir).groupBy("symbol").agg(F.max_by("ts", key).cast("string").alias("best_d"), F.min_by("ts", key).cast("string").alias("worst_d"), fix(F.max("close"), 3).alias("best"))


@query(f"WITH {BARS}, n AS (SELECT *, row_number() OVER ({S}) AS rn, count(*) OVER (PARTITION BY symbol) AS c FROM bars) SELECT symbol, {D}, rn FROM n WHERE rn > c - 10")
def last_rows(spark, sf_dir):
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    return panels.bars_daily(spark, sf_dir).withColumns({"rn": rn, "n": n}).where(F.col("rn") > F.col("n") - 10).select("symbol", day(), F.col("rn").cast("long").alias("rn"))


@query(f"WITH {WEEKLY} SELECT {D}, " + ", ".join(f"{sfix(f'max(CASE WHEN symbol = {chr(39)}{s}{chr(39)} THEN close END)', 2)} AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM weekly GROUP BY ts")
def close_matrix(spark, sf_dir):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = panels.bars_weekly(spark, sf_dir).groupBy("ts").pivot("symbol", names).agg(F.first("close"))
    return wide.select(day(), *(fix(n, 2).alias(n.lower()) for n in names))


@query(f"WITH {WEEKLY}, w AS (SELECT ts, min(close) AS low, max(close) AS high FROM weekly GROUP BY 1) SELECT {D}, name, {sfix('value', 2)} AS value FROM (UNPIVOT w ON low, high INTO NAME name VALUE value)")
def unpivot_range(spark, sf_dir):
    wide = panels.bars_weekly(spark, sf_dir).groupBy("ts").agg(F.min("close").alias("low"), F.max("close").alias("high"))
    return wide.unpivot(["ts"], ["low", "high"], "name", "value").select(day(), "name", *fixed({"value": 2}))


@query("WITH a AS (SELECT DISTINCT p_brand AS s FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_brand AS s FROM part WHERE p_retailprice > 1500) SELECT 'union' AS op, count(*) AS n FROM (SELECT s FROM a UNION SELECT s FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT s FROM a INTERSECT SELECT s FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT s FROM a EXCEPT SELECT s FROM b)")
def symbol_sets(spark, sf_dir):
    part = panels.table(spark, sf_dir, "part")
    a, b = part.where("p_size < 10").select(F.col("p_brand").alias("s")).distinct(), part.where("p_retailprice > 1500").select(F.col("p_brand").alias("s")).distinct()
    sets = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    from functools import reduce

    return reduce(lambda x, y: x.union(y), (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, df in sets.items()))


@query(f"WITH {BARS}, f AS (SELECT p_brand AS symbol, avg(p_retailprice) AS price, avg(p_size) AS size FROM part GROUP BY 1) SELECT b.symbol, count(*) AS n, {sfix('avg(close) / min(price)', 4)} AS ratio, {sfix('min(price) / nullif(min(size) - 25, 0)', 2)} AS per_size FROM bars b LEFT JOIN f ON f.symbol = b.symbol GROUP BY 1")
def fundamentals_join(spark, sf_dir):
    part = panels.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    rows = panels.bars_daily(spark, sf_dir).join(part, "symbol", "left").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("c"), F.min("price").alias("p"), F.min("size").alias("s"))
    return rows.select("symbol", "n", fix(F.try_divide("c", "p"), 4).alias("ratio"), fix(F.try_divide("p", F.col("s") - 25), 2).alias("per_size"))


@query(f"WITH {RETURNS}, f AS (SELECT run, min(ts) AS t FROM returns WHERE r <> 0 GROUP BY 1), a AS (SELECT r.* FROM returns r JOIN f ON f.run = r.run AND r.ts >= f.t) SELECT run, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_d FROM a GROUP BY 1")
def trimmed_warmup(spark, sf_dir):
    return clean.trim_warmup(returns(spark, sf_dir)).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first_d"))


@query(f"WITH {RETURNS}, f AS (SELECT max(t) AS t FROM (SELECT run, min(ts) AS t FROM returns WHERE r <> 0 GROUP BY 1)), d AS (SELECT ts FROM returns GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT run) FROM returns)) SELECT run, {D} FROM returns JOIN d USING (ts), f WHERE ts >= t")
def common_window(spark, sf_dir):
    return clean.common_window(returns(spark, sf_dir)).select("run", day())


@query(f"WITH {_BOOK}, {_SLEEVES}, rest AS (SELECT sl.sleeve, book.symbol FROM book, sl WHERE residual AND book.symbol NOT IN (SELECT symbol FROM own)) SELECT sleeve, symbol FROM own UNION ALL SELECT sleeve, symbol FROM rest")
def managed_symbols(spark, sf_dir):
    sleeves = sleeve_table(spark, sf_dir)
    return orders.managed(account(spark, sf_dir)[0], sleeves, sleeves.select("sleeve"))


@query(f"WITH {_BOOK}, {_SLEEVES} SELECT symbol, {sfix('notional', 1)} AS notional FROM book WHERE symbol IN (SELECT symbol FROM own WHERE sleeve <> (SELECT max(sleeve) FROM sl))")
def foreign_positions(spark, sf_dir):
    sleeves = sleeve_table(spark, sf_dir)
    last = sleeves.agg(F.max("sleeve")).first()[0]
    return orders.foreign(account(spark, sf_dir)[0], sleeves, last).select("symbol", *fixed({"notional": 1}))


@query(f"WITH {_TARGET}, k AS (SELECT *, count(*) OVER () AS n FROM target), m AS (SELECT symbol, weight FROM k WHERE weight >= 1.0 / (5 * n)) SELECT symbol, {sfix('weight / sum(weight) OVER ()')} AS weight FROM m")
def renormalised_weights(spark, sf_dir):
    return orders.drop_small(account(spark, sf_dir)[1]).select("symbol", *fixed({"weight": 5}))


@query("WITH f AS (SELECT DISTINCT p_brand AS ticker FROM part WHERE p_size <= 2), o AS (SELECT DISTINCT p_brand AS ticker FROM part) SELECT ticker FROM o WHERE NOT ((SELECT count(*) FROM f) BETWEEN 26 AND 30) UNION ALL SELECT ticker FROM f WHERE (SELECT count(*) FROM f) BETWEEN 26 AND 30")
def universe_fallback(spark, sf_dir):
    part = panels.table(spark, sf_dir, "part")
    fresh, last = part.where("p_size <= 2").select(F.col("p_brand").alias("ticker")).distinct(), part.select(F.col("p_brand").alias("ticker")).distinct()
    return orders.with_fallback(fresh, last, orders.universe_check(fresh, last, 26, 30))


@query(f"WITH {BARS}, a AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS r FROM bars), p AS (SELECT symbol, ts, CASE WHEN r < -0.5 THEN 1 WHEN r > 0.5 THEN 0 END AS e FROM a), h AS (SELECT symbol, ts, coalesce(last_value(e IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS position FROM p), q AS (SELECT *, lag(position, 1, 0) OVER ({S}) AS was FROM h) SELECT CASE WHEN position = 1 AND was = 0 THEN 'buy' WHEN position = 0 AND was = 1 THEN 'sell' ELSE 'hold' END AS action, count(*) AS n FROM q GROUP BY 1")
def poll_decisions(spark, sf_dir):
    from ..functions.windows import by_symbol, held

    r = change(F.col("close"))
    rows = panels.bars_daily(spark, sf_dir).withColumn("r", r).withColumn("position", held(F.col("r") < -0.5, F.col("r") > 0.5))
    rows = rows.withColumn("was", F.lag("position", 1, 0).over(by_symbol()))
    return rows.groupBy(rules.poll_decision(F.col("position"), F.col("was"), F.lit(0)).alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WEEKLY}, a AS (SELECT symbol, ts, ln(close) AS x FROM weekly), b AS (SELECT *, x - lag(x) OVER ({S}) AS dx FROM a), c AS (SELECT symbol, 0 AS d, ts, x FROM b UNION ALL SELECT symbol, 1, ts, dx FROM b WHERE dx IS NOT NULL), l AS (SELECT *, lag(x) OVER (PARTITION BY symbol, d ORDER BY ts) AS l FROM c), g AS (SELECT symbol, d, count(*) AS n, var_pop(l) AS vx, covar_pop(l, x - l) AS c, var_pop(x - l) AS vy FROM l WHERE l IS NOT NULL GROUP BY 1, 2) SELECT symbol, CAST(d AS BIGINT) AS diff, n, {sfix('(c / vx) / sqrt(n * (vy - c * c / vx) / (n - 2) / (n * vx))', 3)} AS t FROM g")
def differencing_order(spark, sf_dir):
    by = Window.partitionBy("symbol").orderBy("ts")
    x = panels.bars_weekly(spark, sf_dir).select("symbol", "ts", F.ln("close").alias("x")).withColumn("dx", F.col("x") - F.lag("x").over(by))
    rows = x.select("symbol", "ts", F.lit(0).cast("long").alias("diff"), "x").unionByName(x.where("dx IS NOT NULL").select("symbol", "ts", F.lit(1).cast("long").alias("diff"), F.col("dx").alias("x")))
    return metrics.unit_root_t(rows, ["symbol", "diff"], "x").select("symbol", "diff", "n", *fixed({"t": 3}))


@query(f"WITH {RETURNS}, {BENCH}, b AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS ts, avg(bench) AS bench FROM bench GROUP BY 1), br AS (SELECT 'BENCH' AS run, ts, bench / lag(bench) OVER (ORDER BY ts) - 1 AS r FROM b), u AS (SELECT * FROM returns WHERE r IS NOT NULL UNION ALL SELECT * FROM br WHERE r IS NOT NULL) SELECT coalesce(run, 'ALL') AS run, count(*) AS n, {sfix('avg(r) / stddev_samp(r)')} AS sharpe FROM u GROUP BY GROUPING SETS ((run), ())")
def strategy_comparison(spark, sf_dir):
    """Each run, the benchmark, and all together."""
    week = panels.bench_daily(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("ts")).agg(F.avg("bench").alias("bench"))
    bench = week.select(F.lit("BENCH").alias("run"), "ts", change(F.col("bench"), 1, Window.orderBy("ts")).alias("r"))  # one series of dates
    both = returns(spark, sf_dir).unionByName(bench).where("r IS NOT NULL")
    return both.rollup("run").agg(F.count(F.lit(1)).alias("n"), fix(F.avg("r") / F.stddev_samp("r")).alias("sharpe")).select(F.coalesce("run", F.lit("ALL")).alias("run"), "n", "sharpe")


@query(f"WITH {RETURNS}, w AS (SELECT unnest(range(6)) / 5.0 AS a), p AS (SELECT a, ts, sum(CASE run WHEN 'BUILDING' THEN a WHEN 'FURNITURE' THEN 1 - a END * r) AS r FROM returns, w WHERE run IN ('BUILDING', 'FURNITURE') AND r IS NOT NULL GROUP BY 1, 2), q AS (SELECT a, quantile_cont(r, 0.05) AS v FROM p GROUP BY 1), o AS (SELECT p.a, avg(r) - 2 * var_samp(r) + 0.5 * avg(CASE WHEN r <= v THEN r END) AS goal FROM p JOIN q ON p.a = q.a GROUP BY 1) SELECT CAST(round(a * 5) AS BIGINT) AS fifth, {sfix('goal')} AS goal, goal = (SELECT max(goal) FROM o) AS best FROM o")
def candidate_weights(spark, sf_dir):
    """Mean less twice the variance plus half the tail's mean, for a grid of weights."""
    two = returns(spark, sf_dir).where("r IS NOT NULL AND run IN ('BUILDING', 'FURNITURE')")
    w = F.when(F.col("run") == "BUILDING", F.col("fifth") / 5).otherwise(1 - F.col("fifth") / 5)
    mixed = two.crossJoin(F.broadcast(spark.range(6).select(F.col("id").alias("fifth")))).groupBy("fifth", "ts").agg(F.sum(w * F.col("r")).alias("r"))  # six rows
    tail = metrics.tail_risk(mixed.withColumnRenamed("fifth", "run")).select(F.col("run").alias("fifth"), "cvar")
    goal = mixed.groupBy("fifth").agg(F.avg("r").alias("m"), F.var_samp("r").alias("v")).join(tail, "fifth").select("fifth", (F.col("m") - 2 * F.col("v") + 0.5 * F.col("cvar")).alias("goal"))
    return goal.withColumn("best", F.col("goal") == F.max("goal").over(Window.partitionBy())).select("fifth", fix("goal").alias("goal"), "best")
