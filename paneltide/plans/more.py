"""Further queries: regimes, folds, sweeps by weekday, round trips of snapshots, states and models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import indicators as I
from ..functions.windows import by_symbol, change, lag, ratio, rolling
from ..operators import backtest, clean, cross, learn, metrics, moments, orders, rules, strategies
from ..sources import panels, sinks
from ..sources.store import folder, stored
from .features import D, dense
from .learning import FEATURES, FOLDS, ROWS, SCORE, net_sql, rows
from .market import _BOLL, _BOOK, _CAPPED, _CHOSEN, _MOM, _PERF, _PERF_SQL, _TARGET, _WALK, _scored, _z, account, pair_zscores, returns, walk
from .oracle import BARS, BENCH, DENSE, RETURNS, S, WEEKLY, day, fix, fixed, query, sfix, sfixed, srolling


@query("SELECT 'o_orderkey' AS name UNION ALL SELECT 'c_nationkey'")
def complete_columns(spark, sf_dir):
    """Of three columns of a left join those that are never null."""
    o, c = panels.table(spark, sf_dir, "orders"), panels.table(spark, sf_dir, "customer")
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("o_orderstatus"))
    names = clean.complete_columns(df, df.columns)
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, names))).alias("name"))


@query("SELECT DISTINCT p_brand AS ticker, '2024-01-01' AS as_of FROM part")
def universe_snapshot(spark, sf_dir):
    """Written as CSV with a date and read back with a schema."""
    path = folder(spark, "snapshot")
    panels.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.lit("2024-01-01").alias("as_of")).distinct().write.csv(path, header=True)
    return spark.read.schema("ticker string, as_of string").csv(path, header=True)


@query(f"WITH {BARS} SELECT symbol, CAST(max(ts) AS VARCHAR) AS d, {sfix('last(close ORDER BY ts)', 3)} AS close FROM bars GROUP BY 1")
def state_table(spark, sf_dir):
    """The latest row of each symbol, kept as a table that a later run replaces."""
    path = folder(spark, "state")
    state = panels.bars_daily(spark, sf_dir).groupBy("symbol").agg(F.max_by(F.struct("ts", "close"), "ts").alias("s")).select("symbol", "s.*")
    for _ in range(2):
        state.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("symbol", day(), *fixed({"close": 3}))


@query(f"""WITH {BARS}, a AS (SELECT symbol, ts, close / nullif({srolling('max', 'high', 20)}, 0) AS p FROM bars), b AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END END AS e FROM a)
SELECT symbol, {D}, CAST(coalesce(last_value(e IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), first_value(e IGNORE NULLS) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS position FROM b""")
def hysteresis_positions(spark, sf_dir):
    df = panels.bars_daily(spark, sf_dir).withColumn("p", ratio(F.col("close"), rolling(F.max, F.col("high"), 20)))
    return df.withColumn("position", rules.at_least(F.col("p"), 0.5).cast("long")).select("symbol", day(), "position")


@query(f"""WITH {BARS}, {BENCH}, rg AS (SELECT ts, abs(bench / lag(bench, 21) OVER (ORDER BY ts) - 1) < 0.05 AS flat FROM bench), a AS (SELECT *, close > {srolling('avg', 'close', 10)} AS up FROM bars),
p AS (SELECT a.symbol, a.ts, CAST(CASE WHEN coalesce(flat, true) THEN 0 WHEN up THEN 1 ELSE 0 END AS BIGINT) AS position FROM a JOIN rg ON rg.ts = a.ts) SELECT symbol, {D}, position, coalesce(position - lag(position) OVER ({S}), 0) AS signal FROM p""")
def regime_dispatch(spark, sf_dir):
    """A trend rule that is flat in a sideways market; changes are taken within each symbol."""
    regime = panels.bench_daily(spark, sf_dir).select("ts", (F.abs(change(F.col("bench"), 21, Window.orderBy("ts"))) < 0.05).alias("flat"))  # one series of dates
    df = panels.bars_daily(spark, sf_dir).withColumn("up", F.col("close") > I.sma(F.col("close"), 10)).join(regime, "ts")
    df = df.withColumn("position", F.when(F.coalesce("flat", F.lit(True)), 0).when(F.col("up"), 1).otherwise(0).cast("long"))
    return df.withColumn("signal", rules.signal(F.col("position"))).select("symbol", day(), "position", "signal")


@query(f"""WITH {BENCH}, w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS ts, avg(bench) AS bench FROM bench GROUP BY 1), r AS (SELECT *, bench / lag(bench) OVER (ORDER BY ts) - 1 AS r FROM w),
f AS (SELECT *, {srolling('avg', 'bench', 40, 'ORDER BY ts')} AS ma, r < -0.05 AS bear, abs(r) AS t FROM r), l AS (SELECT *, CASE WHEN count(t) OVER p >= 52 THEN quantile_cont(t, 0.9) OVER p END AS lim FROM f WINDOW p AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT ts, coalesce(CAST(bench < ma AS INT), 0) + coalesce(CAST(bear AS INT), 0) + coalesce(CAST(t > lim AS INT), 0) AS bad FROM l) SELECT {D}, CAST(CASE bad WHEN 0 THEN 1 WHEN 1 THEN 0.65 ELSE 0.3 END AS DOUBLE) AS score FROM b""")
def regime_scores(spark, sf_dir):
    return _regime(spark, sf_dir).select(day(), "score")


def _regime(spark, sf_dir) -> DataFrame:
    week = panels.bench_daily(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("ts")).agg(F.avg("bench").alias("bench"))
    r = change(F.col("bench"), 1, Window.orderBy("ts"))  # one series of weeks
    return cross.regime_score(week.withColumn("r", r).select("ts", "bench", (F.col("r") < -0.05).alias("bear"), F.abs("r").alias("turbulence")))


_PCT = "(rank() OVER (PARTITION BY ts ORDER BY {0} NULLS LAST) + (count({0}) OVER (PARTITION BY ts, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY ts)"


@query(f"WITH {_MOM}, rv AS (SELECT mo.symbol, mo.ts, score, CASE WHEN d2.x > 0 THEN d2.x END AS x FROM mo JOIN (SELECT symbol, ts, close / lag(close, 5) OVER ({S}) - 1 AS x FROM dense) d2 ON mo.symbol = d2.symbol AND mo.ts = d2.ts), pk AS (SELECT symbol, ts, score, x, CASE WHEN score IS NOT NULL THEN {_PCT.format('score')} END AS a, CASE WHEN x IS NOT NULL THEN {_PCT.format('x')} END AS b FROM rv) SELECT symbol, {D}, {sfix('(a + coalesce(b, a)) / 2')} AS blend FROM pk WHERE score IS NOT NULL")
def rank_average(spark, sf_dir):
    r = change(F.col("close"), 5)
    df = cross.momentum(dense(spark, sf_dir)).withColumn("x", r).withColumn("x", F.when(F.col("x") > 0, F.col("x")))
    return cross.rank_average(df, "score", "x").where("score IS NOT NULL").select("symbol", day(), *fixed({"blend": 5}))


@query(f"WITH {RETURNS}, {BENCH}, w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS ts, avg(bench) AS bench FROM bench GROUP BY 1), g AS (SELECT ts, CASE WHEN ma IS NULL OR bench >= ma THEN 1.0 ELSE 0.5 END AS gate FROM (SELECT ts, bench, {srolling('avg', 'bench', 40, 'ORDER BY ts')} AS ma FROM w)), e AS (SELECT *, greatest({srolling('stddev_samp', 'r', 21, 'PARTITION BY run ORDER BY ts')}, {srolling('stddev_samp', 'r', 63, 'PARTITION BY run ORDER BY ts')}) * sqrt(252) AS e FROM returns) SELECT run, CAST(e.ts AS VARCHAR) AS d, {sfix('least(greatest(CASE WHEN e > 0 THEN least(greatest(3.0 / e, 0.2), 1.0) ELSE 1.0 END * gate, 0.1), 1.0)')} AS exposure FROM e JOIN g ON g.ts = e.ts")
def composite_exposure(spark, sf_dir):
    week = panels.bench_daily(spark, sf_dir).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("ts")).agg(F.avg("bench").alias("bench"))
    gate = cross.regime_gate(week, 40).select("ts", "gate")
    df = cross.vol_target(returns(spark, sf_dir), 3.0).join(gate, "ts")
    return df.select("run", day(), fix(cross.composite_exposure(F.col("exposure"), F.col("gate"))).alias("exposure"))


@query(f"WITH RECURSIVE {_CHOSEN}, {_CAPPED} SELECT symbol, {D}, {sfix('w')} AS weight FROM cp WHERE it = 20 AND ts = (SELECT max(ts) FROM top)")
def one_shot_weights(spark, sf_dir):
    """Weights of the last decision date alone."""
    df = _scored(spark, sf_dir).where("score IS NOT NULL")
    last = df.agg(F.max("ts").alias("ts"))
    return cross.inverse_vol(cross.top_k(df.join(F.broadcast(last), "ts"), 5), "sd").select("symbol", day(), *fixed({"weight": 5}))  # one date


@query(f"WITH {RETURNS}, n AS (SELECT run, ts, row_number() OVER (PARTITION BY run ORDER BY ts) - 1 AS n, count(*) OVER (PARTITION BY run) AS c FROM returns), a AS (SELECT *, CASE WHEN n >= 109 AND least(109 + ((n - 109) // 26) * 26 + 26, c) - (109 + ((n - 109) // 26) * 26) >= 5 THEN (n - 109) // 26 END AS fold FROM n) SELECT run, fold, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_d FROM a GROUP BY 1, 2")
def fold_assignment(spark, sf_dir):
    r = returns(spark, sf_dir)
    numbered = r.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("ts")) - 1)
    df = backtest.assign_folds(numbered, backtest.fold_table(r, 104, 26))
    return df.groupBy("run", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first_d"))


@query(f"WITH RECURSIVE {_WALK} SELECT {sfix('avg(CASE WHEN turnover > 0 THEN turnover END) * 52 * 0.001', 6)} AS drag, {sfix('sum(turnover) * 0.001', 5)} AS paid FROM walk")
def cost_drag(spark, sf_dir):
    return walk(spark, sf_dir).agg(fix(F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))) * 52 * 0.001, 6).alias("drag"), fix(F.sum("turnover") * 0.001).alias("paid"))


@query(f"WITH {BARS}, a AS (SELECT symbol, ts, ln(close / lag(close) OVER ({S})) AS r FROM bars), b AS (SELECT *, {srolling('avg', 'r', 3)} AS m FROM a) SELECT symbol, {D}, {sfix('m')} AS smooth, CAST(CASE WHEN m > 0.1 THEN 1 WHEN m IS NOT NULL THEN 0 END AS BIGINT) AS event FROM b")
def smoothed_predictions(spark, sf_dir):
    df = panels.bars_daily(spark, sf_dir).withColumn("r", I.log_return()).withColumn("m", rolling(F.avg, F.col("r"), 3))
    return df.select("symbol", day(), fix("m").alias("smooth"), F.when(F.col("m") > 0.1, 1).when(F.col("m").isNotNull(), 0).cast("long").alias("event"))


_PAIR = "PARTITION BY symbol_1, symbol_2 ORDER BY ts"


@query(f"WITH {WEEKLY}, p AS (SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, a.ts, ln(a.close) - ln(b.close) AS s FROM weekly a JOIN weekly b ON a.ts = b.ts AND a.symbol < b.symbol), z AS (SELECT *, (s - ({srolling('avg', 's', 26, _PAIR)})) / ({srolling('stddev_samp', 's', 26, _PAIR)}) AS z FROM p) SELECT symbol_1, symbol_2, {D}, {sfix('z', 4)} AS z FROM z")
def pair_spread_z(spark, sf_dir):
    return pair_zscores(spark, sf_dir).select("symbol_1", "symbol_2", day(), *fixed({"z": 4}))


@query(f"WITH {WEEKLY}, a AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS r FROM weekly), t AS (SELECT ts, max(abs(r)) AS x FROM a GROUP BY 1 HAVING max(abs(r)) IS NOT NULL) SELECT a.symbol, CAST(a.ts AS VARCHAR) AS d, {sfix('r')} AS r, {sfix('x')} AS x FROM a JOIN t ON t.ts = a.ts WHERE r IS NOT NULL")
def turbulence_attached(spark, sf_dir):
    """A scalar of each date beside every symbol."""
    df = panels.bars_weekly(spark, sf_dir).withColumn("r", change(F.col("close")))
    day_x = df.groupBy("ts").agg(F.max(F.abs("r")).alias("x"))
    return df.join(day_x, "ts", "left").na.drop(subset=["r", "x"]).select("symbol", day(), *fixed({"r": 5, "x": 5}))


@query(f"""WITH {_BOOK}, {_TARGET}, eq AS (SELECT sum(notional) AS e FROM book JOIN target USING (symbol)), j AS (SELECT coalesce(t.symbol, b.symbol) AS symbol, e * coalesce(weight, 0) AS t, coalesce(notional, 0) AS now FROM target t FULL JOIN (SELECT * FROM book WHERE symbol IN (SELECT symbol FROM target)) b ON b.symbol = t.symbol, eq), o AS (SELECT *, t - now AS delta FROM j WHERE abs(t - now) >= 1)
SELECT row_number() OVER (ORDER BY delta > 0, abs(delta) DESC, symbol) AS seq, symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN NOT (t < 1 AND now > 0) THEN {sfix('abs(delta)', 1)} END AS notional FROM o""")
def monthly_rebalance(spark, sf_dir):
    """Orders that bring the names of the target to their weights of what they are worth together."""
    book, target = account(spark, sf_dir)
    mine = book.join(target.select("symbol"), "symbol", "left_semi")
    equity = mine.agg(F.sum("notional").alias("e")).first()["e"] or 0.0
    out = orders.build_orders(target, mine, F.lit(equity), 1.0, 0.0)
    return out.select(F.col("seq").cast("long").alias("seq"), "symbol", "side", fix("notional", 1).alias("notional"))


@query()
def model_round_trip(spark, sf_dir):
    """A forest saved, loaded and applied to the latest row of each symbol."""
    df, path = rows(spark, sf_dir), folder(spark, "model")
    learn.direction_model("forest", FEATURES, numTrees=8, maxDepth=3).fit(df.where("test_mask = 0 AND label IS NOT NULL")).write().overwrite().save(path)
    latest = df.groupBy("symbol").agg(F.max_by(F.struct("ts", *FEATURES), "ts").alias("l")).select("symbol", "l.*")
    return PipelineModel.load(path).transform(latest).select("symbol", day(), "prediction")


def forward_folds(df: DataFrame, parts: int = 6) -> tuple[DataFrame, list[tuple[int, int, int, int, int]]]:
    """Rows with the number n of their date, and folds (fold, train, train end, test, test end). The last fold reaches the last date, though its test span then is longer."""
    dates = df.select(F.lit("all").alias("run"), "ts").distinct()
    span = dates.count() // parts
    folds = [tuple(r)[1:] for r in backtest.fold_table(dates, span, max(5, span)).orderBy("fold").collect()]
    if not folds:
        raise ValueError("too few dates for forward folds")
    n = dates.withColumn("n", F.row_number().over(Window.orderBy("ts")) - 1).select("ts", "n")  # one row a date
    folds[-1] = (*folds[-1][:4], dates.count())  # dates too few for a fold of their own are the last one's
    return df.join(F.broadcast(n), "ts"), folds


#: Elastic nets by name: penalty, and the share of its absolute part.
NETS = {f"reg {r} mix {x}": (r, x) for r in (0.001, 0.01, 0.1) for x in (0.0, 0.5, 1.0)}
_NETS = "models(model, reg, mix) AS (VALUES " + ", ".join(f"('{m}', {r}, {x})" for m, (r, x) in NETS.items()) + ")"


@query(f"""WITH RECURSIVE {ROWS}, {FOLDS}, {_NETS}, {net_sql('folds', 'models')}, sc AS (SELECT model, net.fold, sign({SCORE}) * fwd AS r FROM net JOIN folds ON folds.fold = net.fold JOIN e ON dn - 1 >= t AND dn - 1 < folds.e)
SELECT model, fold, {sfix('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0)', 3)} AS value FROM sc GROUP BY 1, 2""")
def grid_search(spark, sf_dir):
    """Elastic nets on forward folds, by the Sharpe ratio of their signs: all of them from one pass over the rows."""
    df = rows(spark, sf_dir).select("symbol", "ts", *FEATURES, F.col("fwd").alias("label"))
    path = folder(spark, "grid")
    df.write.parquet(path)  # its dates decide the folds
    df, folds = forward_folds(spark.read.parquet(path))
    metric = F.try_divide(F.avg(F.signum("score") * F.col("label")), F.stddev_samp(F.signum("score") * F.col("label"))) * 252**0.5
    out = learn.grid_search(df, NETS, folds, "n", metric)
    return out if out is None else out.select("model", "fold", fix("value", 3).alias("value"))


def _parts(folds: DataFrame) -> DataFrame:
    """fold, part, start, end."""
    ends = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end")) for p in ("train", "test")))
    return folds.select("fold", F.explode(ends).alias("x")).select("fold", "x.*")


def _forward(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Rows with date numbers and their forward folds as a table."""
    path = folder(spark, "forward")
    rows(spark, sf_dir).withColumn("label", F.col("fwd")).write.parquet(path)
    df, folds = forward_folds(spark.read.parquet(path))
    return df, moments.fold_frame(df, folds)


_Z = f"[1, {', '.join(FEATURES)}, fwd]"
_PARTS = "parts AS (SELECT fold, 'train' AS part, a AS since, z AS till FROM folds UNION ALL SELECT fold, 'test', t, e FROM folds)"


@query(f"""WITH {ROWS}, {FOLDS}, {_PARTS}, zz AS (SELECT fold, part, {_Z} AS z FROM parts JOIN e ON dn - 1 >= since AND dn - 1 < till WHERE fwd IS NOT NULL)
SELECT fold, part, i, j, count(*) AS n, {sfix('avg(z[i + 1] * z[j + 1])', 4)} AS mean FROM zz, range({len(FEATURES) + 2}) AS ri(i), range({len(FEATURES) + 2}) AS rj(j) WHERE i <= j GROUP BY ALL""")
def fold_moments(spark, sf_dir):
    """Means of all products of 1, features and label over each fold's training and test rows, from running sums by date."""
    df, folds = _forward(spark, sf_dir)
    k = len(FEATURES)
    sums = moments.span_sums(moments.date_sums(df, FEATURES, "label", "n"), _parts(folds), k)
    cells = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(f"s_{i}_{j}").alias("s")) for i in range(k + 2) for j in range(i, k + 2)))
    return sums.select("fold", "part", F.round("s_0_0").cast("long").alias("n"), F.explode(cells).alias("x")).select("fold", "part", "x.i", "x.j", "n", fix(F.col("x.s") / F.col("n"), 4).alias("mean"))


def _draw(what: str) -> str:
    return f"('0x' || substr(md5('{what}|' || i), 1, 8))::BIGINT / 4294967296.0"


@query(f"""WITH RECURSIVE {ROWS}, {FOLDS}, models AS (SELECT 'draw ' || i AS model, pow(10, -4 + 3 * ({_draw('penalty')})) AS reg, {_draw('mix')} AS mix FROM range(12) AS r(i)), {net_sql('folds', 'models')},
er AS (SELECT model, net.fold, avg(pow({SCORE} - fwd, 2)) AS mse FROM net JOIN folds ON folds.fold = net.fold JOIN e ON dn - 1 >= t AND dn - 1 < folds.e WHERE fwd IS NOT NULL GROUP BY 1, 2)
SELECT model, {sfix('any_value(reg)', 6)} AS reg, {sfix('any_value(mix)')} AS mix, {sfix('avg(mse)')} AS mse FROM er JOIN models USING (model) GROUP BY model""")
def random_search(spark, sf_dir):
    """Twelve elastic nets with random penalties by their mean error on the test spans, which the sums of products give without the rows."""
    df, folds = _forward(spark, sf_dir)
    k, u = len(FEATURES), lambda what: F.conv(F.substring(F.md5(F.concat(F.lit(f"{what}|"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    models = spark.range(12).select(F.concat(F.lit("draw "), F.col("id").cast("string")).alias("model"), F.pow(F.lit(10.0), u("penalty") * 3 - 4).alias("reg"), u("mix").alias("mix"))
    sums = stored(moments.span_sums(moments.date_sums(df, FEATURES, "label", "n"), _parts(folds), k), "sums")
    fitted = moments.solve(sums.where("part = 'train'"), models, k).select("fold", "model", "reg", "mix", "intercept", "coefficients")
    tested = fitted.join(sums.where("part = 'test'"), "fold").withColumn("mse", moments.squared_error(sums, k))
    return tested.groupBy("model").agg(F.first("reg").alias("reg"), F.first("mix").alias("mix"), F.avg("mse").alias("mse")).select("model", *fixed({"reg": 6, "mix": 5, "mse": 5}))


@query()
def sequence_classifier(spark, sf_dir):
    """A small network on windows of the last 8 weekly returns that tells the sign of the next."""
    df = panels.bars_weekly(spark, sf_dir).withColumn("r", change(F.col("close")))
    df = df.withColumn("l", F.collect_list("r").over(by_symbol().rowsBetween(-8, -1))).where(F.size("l") == 8)
    df = clean.split_dates(df.select("symbol", "ts", *(F.col("l")[i].alias(f"x{i}") for i in range(8)), (F.col("r") > 0).cast("double").alias("label")), 0.7)
    names = [f"x{i}" for i in range(8)]
    net = learn.assembled(names, MultilayerPerceptronClassifier(layers=[8, 6, 2], maxIter=30, seed=7, featuresCol="features", labelCol="label"))
    return learn.fit_predict(df, net).select("symbol", day(), "label", "score")


_HOLD = f"hn AS (SELECT *, row_number() OVER ({S}) AS rn, count(*) OVER (PARTITION BY symbol) AS c FROM weekly), hp AS (SELECT symbol, ts, close, CASE WHEN rn > 1 AND rn < c THEN 1 ELSE 0 END AS position FROM hn)"


@query(f"WITH {WEEKLY}, {_HOLD}, {_BOLL.format('weekly')}, u AS (SELECT 'buy and hold' AS run, symbol, ts, close, position FROM hp UNION ALL SELECT 'bollinger', symbol, ts, close, position FROM pos), ub AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY run, symbol ORDER BY ts), 0) AS before, close / lag(close) OVER (PARTITION BY run, symbol ORDER BY ts) - 1 AS ret FROM u), q AS (SELECT run, ts, avg(coalesce(ret * before, 0) - abs(position - before) * 0.001) AS r FROM ub GROUP BY 1, 2), {_PERF_SQL.format('q', '52.0')} SELECT run, n, {sfixed(_PERF)} FROM pf")
def strategy_engine(spark, sf_dir):
    """All registered strategies over all symbols, and their performance."""
    rows = strategies.run(panels.bars_weekly(spark, sf_dir), ["buy and hold", "bollinger"])
    return metrics.performance(rows.select("run", "ts", "r"), 52).withColumn("log_total", F.log1p("total")).select("run", "n", *fixed(_PERF))


@query(f"WITH {RETURNS} SELECT run || ' ' || count(*) AS line FROM returns WHERE r IS NOT NULL GROUP BY run UNION ALL SELECT 'all ' || count(*) FROM returns WHERE r IS NOT NULL")
def report_lines(spark, sf_dir):
    """Lines appended by two runs and read back."""
    path = folder(spark, "report")
    r = returns(spark, sf_dir).where("r IS NOT NULL")
    sinks.append_report(r.groupBy("run").agg(F.count(F.lit(1)).alias("n")), path, F.concat_ws(" ", "run", F.col("n").cast("string")))
    sinks.append_report(r.agg(F.count(F.lit(1)).alias("n")), path, F.concat(F.lit("all "), F.col("n").cast("string")))
    return sinks.read_report(spark, path).select(F.col("value").alias("line"))
