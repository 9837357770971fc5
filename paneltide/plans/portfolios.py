"""Queries over walk-forward portfolios: sweeps, null tests, layers. Their SQL is put together from the same configurations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import backtest, clean, cross, learn, walk
from ..operators.walk import Config
from ..sources import panels
from ..sources.store import stored
from .features import dense
from .oracle import BENCH, DENSE, RETURNS, S, WEEKLY, day, fix, fixed, query, sfix, sfixed, srolling

BASE = Config("base")


def _z(x: str) -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY ts)) / (stddev_samp({x}) OVER (PARTITION BY ts) + 1e-12)"


def _scored(configs: list[Config], first: int = 0) -> str:
    """CTEs up to sc (run, symbol, ts, score, sd, k, cap), and pl (symbol, ts, close, r) for portfolios."""
    moms = sorted({(c.skip, n) for c in configs for n in c.lookbacks})
    lags = ", ".join(f"lag(close, {n}) OVER ({S}) AS l{n}" for n in sorted({x for pair in moms for x in pair}))
    sds = ", ".join(f"{srolling('stddev_samp', 'r', v)} AS sd{v}" for v in sorted({c.vol for c in configs}))
    raw = ", ".join(f"l{s} / l{n} - 1 AS m{s}_{n}" for s, n in moms)
    zs = ", ".join(f"{_z(f'm{s}_{n}')} AS z{s}_{n}" for s, n in moms)

    def one(c: Config) -> str:
        score = f"({' + '.join(f'z{c.skip}_{n}' for n in c.lookbacks)}) / {len(c.lookbacks)}"
        score = f"{1 - c.reversal} * {score} - {c.reversal} * zrev" if c.reversal else score
        week = f" WHERE isodow(ts) <= {c.weekday + 1}" if c.weekday is not None else ""
        return f"SELECT '{c.run}' AS run, symbol, ts, close, {score} AS score, sd{c.vol} AS sd, {c.k} AS k, {c.cap}::DOUBLE AS cap FROM pz WHERE ts IN (SELECT max(ts) FROM days{week} GROUP BY isoyear(ts), weekofyear(ts))"

    return f"""{DENSE}, {BENCH}, days AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT DISTINCT ts FROM dense)),
pl AS (SELECT symbol, ts, close, close / lag(close) OVER ({S}) - 1 AS r, close / lag(close, 5) OVER ({S}) - 1 AS rev, {lags} FROM dense),
ps AS (SELECT *, {sds}, {raw} FROM pl), pz AS (SELECT *, {zs}, {_z('rev')} AS zrev FROM ps),
sa AS ({' UNION ALL '.join(map(one, configs))}),
sc AS (SELECT * FROM sa WHERE score IS NOT NULL AND sd IS NOT NULL AND close IS NOT NULL AND ts IN (SELECT ts FROM days WHERE i >= {first}))"""


_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY run, ts ORDER BY score DESC, symbol) AS rank FROM sc)"
_BEST = f"{_RANKED}, top AS (SELECT * FROM rk WHERE rank <= k)"
#: Weights sz (run, ts, symbol, w) of the rows top: twenty rounds of capping as steps of a recursion.
_SIZED = """w0 AS (SELECT run, ts, symbol, cap, (1 / (sd + 1e-12)) / sum(1 / (sd + 1e-12)) OVER (PARTITION BY run, ts) AS w FROM top),
cp AS (SELECT 0 AS it, run, ts, symbol, cap, w FROM w0 UNION ALL
SELECT it + 1, run, ts, symbol, cap, CASE WHEN ex > 0 THEN CASE WHEN w > cap THEN cap WHEN room > 0 THEN w + ex * w / room ELSE w END ELSE w END FROM (SELECT *, sum(greatest(w - cap, 0)) OVER (PARTITION BY run, ts) AS ex, sum(CASE WHEN w > cap THEN 0 ELSE w END) OVER (PARTITION BY run, ts) AS room FROM cp WHERE it < 20)),
sz AS (SELECT run, ts, symbol, w FROM cp WHERE it = 20)"""


def _gated(configs: list[Config]) -> str:
    """wt (run, ts, symbol, weight): sz times the gate of its run, or of the first one."""
    one = lambda c: f"SELECT '{c.run}' AS run, ts, CASE WHEN ma IS NULL OR bench >= ma THEN 1.0 ELSE {c.low} END AS gate FROM (SELECT ts, bench, {srolling('avg', 'bench', c.ma, 'ORDER BY ts')} AS ma FROM bench)"
    return f"gt AS ({' UNION ALL '.join(map(one, configs))}), wt AS (SELECT sz.run, sz.ts, symbol, w * coalesce(a.gate, b.gate, 1.0) AS weight FROM sz LEFT JOIN gt a ON a.run = sz.run AND a.ts = sz.ts LEFT JOIN gt b ON b.run = '{configs[0].run}' AND b.ts = sz.ts)"


#: Daily walk (run, ts, r, turnover, exposure) of weights wt over a panel pl, and its summary by run.
_WALK = """dc AS (SELECT run, ts AS decided, lead(ts) OVER (PARTITION BY run ORDER BY ts) AS until FROM (SELECT DISTINCT run, ts FROM wt)),
hd AS (SELECT d.run, c.ts, d.decided, d.until, wt.symbol, wt.weight, pl.close, pl.r AS ret FROM (SELECT DISTINCT ts FROM pl) c JOIN dc d ON c.ts > d.decided AND (d.until IS NULL OR c.ts <= d.until) JOIN wt ON wt.run = d.run AND wt.ts = d.decided LEFT JOIN pl ON pl.ts = c.ts AND pl.symbol = wt.symbol),
lv AS (SELECT *, min(CASE WHEN close IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY run, decided, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS live FROM hd),
dy AS (SELECT run, ts, sum(weight * live * coalesce(ret, 0)) AS gross, sum(weight * live) AS exposure FROM lv GROUP BY 1, 2),
lf AS (SELECT run, ts, symbol, weight * live AS was FROM lv WHERE ts = until),
tn AS (SELECT coalesce(wt.run, lf.run) AS run, coalesce(wt.ts, lf.ts) AS ts, sum(abs(coalesce(weight, 0) - coalesce(was, 0))) AS turnover FROM wt FULL JOIN lf ON wt.run = lf.run AND wt.ts = lf.ts AND wt.symbol = lf.symbol GROUP BY 1, 2),
walk AS (SELECT coalesce(dy.run, tn.run) AS run, coalesce(dy.ts, tn.ts) AS ts, coalesce(gross, 0) - coalesce(turnover, 0) * 0.001 AS r, coalesce(turnover, 0) AS turnover, coalesce(exposure, 0) AS exposure FROM dy FULL JOIN tn ON dy.run = tn.run AND dy.ts = tn.ts),
rs AS (SELECT run, count(r) AS days, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, avg(CASE WHEN turnover > 0 THEN turnover END) * 52 AS turnover, avg(exposure) AS exposure FROM walk GROUP BY 1)"""
_DIGITS = {"sharpe": 4, "turnover": 4, "exposure": 4}


def _panel(spark, sf_dir):
    return stored(dense(spark, sf_dir), "panel")


def _run(spark, sf_dir, configs: list[Config], first: int = 0, selector: walk.Selector = walk.best):
    panel = _panel(spark, sf_dir)
    weights = walk.weights(walk.scored(panel, configs, first), selector, walk.gate(panels.bench_daily(spark, sf_dir), configs))
    return backtest.portfolio(panel, weights, ("run",))


#: One parameter differs from the base in each run.
SWEEP = [BASE, *(replace(BASE, run=f"{name} {value}".replace(",", ""), **{name: value}) for name, values in {"k": (3, 8), "lookbacks": ((126, 63), (252,)), "skip": (0, 42), "vol": (21, 126), "cap": (0.2, 0.5), "ma": (100, 300)}.items() for value in values)]


@query(f"WITH RECURSIVE {_scored(SWEEP, walk.warmup(SWEEP))}, {_BEST}, {_SIZED}, {_gated(SWEEP)}, {_WALK} SELECT run, days, {sfixed(_DIGITS)} FROM rs")
def portfolio_sweep(spark, sf_dir):
    """The weekly portfolio with one parameter at a time changed, all runs from the same date on, in one job."""
    return walk.performance(_run(spark, sf_dir, SWEEP, walk.warmup(SWEEP))).select("run", "days", *fixed(_DIGITS))


_DAYS = [replace(BASE, run=f"day {k}", weekday=k) for k in range(5)]


@query(f"WITH RECURSIVE {_scored(_DAYS)}, {_BEST}, {_SIZED}, {_gated(_DAYS)}, {_WALK} SELECT run, days, {sfixed(_DIGITS)} FROM rs")
def weekday_sweep(spark, sf_dir):
    """The weekly portfolio decided on each weekday, all in one job."""
    return walk.performance(_run(spark, sf_dir, _DAYS)).select("run", "days", *fixed(_DIGITS))


SEEDS = 200
_P = (5, 25, 50, 75, 95, 99)
_DRAWN = f"""{_RANKED}, dr AS (SELECT 'seed ' || s AS run, symbol, ts, score, sd, k, cap FROM sc, (SELECT unnest(range(1, {SEEDS + 1})) AS s)),
rn AS (SELECT *, row_number() OVER (PARTITION BY run, ts ORDER BY md5(run || '|' || CAST(ts AS VARCHAR) || '|' || symbol)) AS rank FROM dr),
top AS (SELECT run, symbol, ts, sd, cap FROM rk WHERE rank <= k UNION ALL SELECT run, symbol, ts, sd, cap FROM rn WHERE rank <= k)"""


@query(f"WITH RECURSIVE {_scored([BASE])}, {_DRAWN}, {_SIZED}, {_gated([BASE])}, {_WALK}, re AS (SELECT * FROM rs WHERE run = 'base'), nu AS (SELECT * FROM rs WHERE run <> 'base') SELECT count(nu.run) AS runs, {', '.join(sfix(f'quantile_cont(nu.sharpe, {p / 100})', 4) + f' AS p{p}' for p in _P)}, {sfix('min(re.sharpe)', 4)} AS real, {sfix('avg(CASE WHEN nu.sharpe < re.sharpe THEN 100.0 ELSE 0.0 END)', 2)} AS percentile, {sfix('median(nu.turnover) / min(re.turnover)', 4)} AS turnover_ratio FROM nu, re")
def null_test(spark, sf_dir):
    """Two hundred portfolios of random names beside the real one, the same pipeline and costs, in one job: the percentiles of their
    Sharpe ratios, and that of the real one among them."""
    runs = walk.performance(_run(spark, sf_dir, [BASE], selector=walk.random_names(SEEDS)))
    real = runs.where("run = 'base'").select(F.col("sharpe").alias("real"), F.col("turnover").alias("paid"))
    both = runs.where("run <> 'base'").join(F.broadcast(real), how="cross")  # one row
    ps = [fix(F.percentile("sharpe", F.lit(p / 100)), 4).alias(f"p{p}") for p in _P]
    return both.agg(F.count("run").alias("runs"), *ps, fix(F.min("real"), 4).alias("real"), fix(F.avg(F.when(F.col("sharpe") < F.col("real"), 100.0).otherwise(0.0)), 2).alias("percentile"), fix(F.percentile("turnover", F.lit(0.5)) / F.min("paid"), 4).alias("turnover_ratio"))


def _held(names: str, k: int, reach: int) -> str:
    """hs (run, n, ts, held): what a buffered selector holds, from lists of names by rank, decision after decision."""
    return f"""ds AS (SELECT run, ts, row_number() OVER (PARTITION BY run ORDER BY ts) AS n, names FROM (SELECT run, ts, list(symbol ORDER BY rank) AS names FROM {names} GROUP BY 1, 2)),
hs AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS ts, CAST([] AS VARCHAR[]) AS held FROM ds UNION ALL
SELECT x.run, x.n, x.ts, list_filter(x.names, lambda y: list_contains(list_concat(x.stay, list_filter(x.names, lambda v: NOT list_contains(x.stay, v))[1:{k} - len(x.stay)]), y)) FROM
(SELECT ds.run, ds.n, ds.ts, ds.names, list_filter(hs.held, lambda v: list_contains(ds.names[1:{reach}], v))[1:{k}] AS stay FROM hs JOIN ds ON ds.run = hs.run AND ds.n = hs.n + 1) x)"""


@query(f"WITH RECURSIVE {_scored([BASE])}, {_RANKED}, {_held('rk', 5, 8)} SELECT run, CAST(ts AS VARCHAR) AS d, unnest(held) AS symbol FROM hs WHERE n > 0")
def buffered_selection(spark, sf_dir):
    """Five names that stay while they are among the first eight."""
    return walk.buffered(1.5, 5)(walk.scored(_panel(spark, sf_dir), [BASE])).select("run", day(), "symbol")


_RISK = f"""wn AS (SELECT sz.run, sz.ts, d.i, symbol, w / sum(w) OVER (PARTITION BY sz.run, sz.ts) AS w, count(*) OVER (PARTITION BY sz.run, sz.ts) AS names FROM sz JOIN days d ON d.ts = sz.ts),
bk AS (SELECT wn.run, wn.ts, wn.i, d.i AS j, CASE WHEN count(pl.r) = min(names) THEN sum(w * pl.r) END AS r FROM wn JOIN days d ON d.i <= wn.i AND d.i > wn.i - 63 JOIN pl ON pl.symbol = wn.symbol AND pl.ts = d.ts GROUP BY 1, 2, 3, 4),
rv AS (SELECT run, ts, CASE WHEN count(CASE WHEN j > i - 21 THEN r END) = 21 THEN stddev_samp(CASE WHEN j > i - 21 THEN r END) * sqrt(252) END AS risk_21, CASE WHEN count(r) = 63 THEN stddev_samp(r) * sqrt(252) END AS risk_63 FROM bk GROUP BY 1, 2),
ex AS (SELECT run, ts, risk_21, risk_63, CASE WHEN greatest(risk_21, risk_63) > 0 THEN least(greatest(4.0 / greatest(risk_21, risk_63), 0.2), 1.0) ELSE 1.0 END AS exposure FROM rv)"""


@query(f"WITH RECURSIVE {_scored([BASE])}, {_BEST}, {_SIZED}, {_RISK} SELECT run, CAST(ts AS VARCHAR) AS d, {sfixed({'risk_21': 4, 'risk_63': 4, 'exposure': 4})} FROM ex")
def book_volatility(spark, sf_dir):
    """The volatility of each decided book over the covariance of its names, and the exposure that it leaves."""
    panel = _panel(spark, sf_dir)
    weights = stored(walk.weights(walk.scored(panel, [BASE])), "weights")
    exposure = walk.vol_target(panel, 4.0, low=0.2)(weights)
    return walk.book_risk(panel, weights).join(exposure, ["run", "ts"]).select("run", day(), *fixed({"risk_21": 4, "risk_63": 4, "exposure": 4}))


_LAYERS = [replace(BASE, run="layers", reversal=0.25)]
_BAND = """tg AS (SELECT sz.run, sz.ts, symbol, w * exposure * gate AS t FROM sz JOIN ex ON ex.run = sz.run AND ex.ts = sz.ts JOIN gt ON gt.run = sz.run AND gt.ts = sz.ts),
dn AS (SELECT run, ts, row_number() OVER (PARTITION BY run ORDER BY ts) AS n FROM (SELECT DISTINCT run, ts FROM tg)),
gr AS (SELECT dn.run, dn.ts, dn.n, s.symbol, coalesce(t, 0) AS t FROM dn JOIN (SELECT DISTINCT run, symbol FROM tg) s ON s.run = dn.run LEFT JOIN tg ON tg.run = dn.run AND tg.ts = dn.ts AND tg.symbol = s.symbol),
bd AS (SELECT run, n, ts, symbol, t AS now FROM gr WHERE n = 1 UNION ALL SELECT gr.run, gr.n, gr.ts, gr.symbol, CASE WHEN abs(gr.t - bd.now) >= 0.02 THEN gr.t ELSE bd.now END FROM bd JOIN gr ON gr.run = bd.run AND gr.symbol = bd.symbol AND gr.n = bd.n + 1),
wt AS (SELECT run, ts, symbol, now AS weight FROM bd WHERE now > 0)"""


@query(f"WITH RECURSIVE {_scored(_LAYERS)}, {_RANKED}, {_held('rk', 5, 8)}, top AS (SELECT rk.* FROM rk JOIN (SELECT run, ts, unnest(held) AS symbol FROM hs) h ON h.run = rk.run AND h.ts = rk.ts AND h.symbol = rk.symbol), {_SIZED}, {_RISK}, {_gated(_LAYERS).partition(', wt AS')[0]}, {_BAND}, {_WALK} SELECT CAST(ts AS VARCHAR) AS d, {sfixed({'r': 4, 'turnover': 4, 'exposure': 4})} FROM walk")
def holistic_walkforward(spark, sf_dir):
    """The weekly portfolio with its layers on: momentum less reversal, buffered names, volatility target times regime gate, a band without trades."""
    panel = _panel(spark, sf_dir)
    exposure = walk.combined(walk.vol_target(panel, 4.0, low=0.2), walk.gate(panels.bench_daily(spark, sf_dir), _LAYERS))
    weights = walk.weights(walk.scored(panel, _LAYERS), walk.buffered(1.5, 5), exposure, band=0.02)
    return backtest.portfolio(panel, weights, ("run",)).select(day(), *fixed({"r": 4, "turnover": 4, "exposure": 4}))


@query()
def holistic_learned(spark, sf_dir):
    """The same with the learned layer and the full gate: ranks of a model refitted on the past, and the score of three health checks."""
    panel = _panel(spark, sf_dir)
    schedule = clean.weekly_schedule(panel.select("ts").distinct())
    features = stored(cross.features(panel, schedule), "features")
    dates = [r["ts"] for r in schedule.select("ts").orderBy("ts").toLocalIterator()]  # the weeks of the calendar
    learned = learn.walk_forward_ranker(features, dates, cross.FEATURES, every=104, least_dates=104).withColumnRenamed("score", "learned")
    bench = stored(panels.bench_daily(spark, sf_dir), "bench")
    states = learn.bear_state(bench, every=252, least=504)
    turbulence = cross.mahalanobis(panel, schedule, 126)
    series = bench.join(schedule.select("ts"), "ts").join(states.select("ts", "bear"), "ts", "left").join(turbulence, "ts", "left")
    checks = cross.regime_score(series, 40).select("ts", F.col("score").alias("exposure"))

    def exposure(weights):
        return weights.select("run", "ts").distinct().join(checks, "ts", "left").select("run", "ts", F.coalesce("exposure", F.lit(1.0)).alias("exposure"))

    weights = walk.weights(walk.with_learned(walk.scored(panel, _LAYERS), learned, 0.5), exposure=exposure)
    return backtest.portfolio(panel, weights, ("run",)).select(day(), "r", "turnover", "exposure")


_STICKY = f"""{WEEKLY}, pl AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS r FROM weekly), sd AS (SELECT unnest(range(20)) AS run),
ds AS (SELECT run, ts, row_number() OVER (PARTITION BY run ORDER BY ts) AS n, names FROM (SELECT run, ts, list(symbol ORDER BY md5(run || '|' || CAST(ts AS VARCHAR) || '|' || symbol)) AS names FROM weekly, sd GROUP BY 1, 2)),
hs AS (SELECT run, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS ts, CAST([] AS VARCHAR[]) AS held FROM sd UNION ALL
SELECT run, n, ts, list_concat(stay, list_filter(names, lambda v: NOT list_contains(held, v))[1:3 - len(stay)]) FROM
(SELECT run, n, ts, names, held, CASE WHEN len(here) = 3 THEN here[2:] ELSE here END AS stay FROM
(SELECT ds.run, ds.n, ds.ts, ds.names, hs.held, list_filter(hs.held, lambda v: list_contains(ds.names, v)) AS here FROM hs JOIN ds ON ds.run = hs.run AND ds.n = hs.n + 1))),
wt AS (SELECT run, ts, unnest(held) AS symbol, 1.0 / 3 AS weight FROM hs WHERE n > 0)"""


@query(f"WITH RECURSIVE {_STICKY}, {_WALK} SELECT CAST(run AS BIGINT) AS run, {sfix('avg(turnover)', 4)} AS turnover, {sfix('avg(r)', 4)} AS r FROM walk GROUP BY 1")
def sticky_null_test(spark, sf_dir):
    """Turnover of random portfolios that change one of three names a week."""
    panel = stored(panels.bars_weekly(spark, sf_dir), "weekly")
    picks = backtest.sticky_random(panel, spark.range(20).select(F.col("id").alias("run")), 3, 1)
    weights = picks.select("run", "ts", "symbol", F.lit(1 / 3).alias("weight"))
    return backtest.portfolio(panel, weights, ("run",)).groupBy("run").agg(fix(F.avg("turnover"), 4).alias("turnover"), fix(F.avg("r"), 4).alias("r"))


_DRAWS = f"""{RETURNS}, dy AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM returns WHERE r IS NOT NULL)),
dw AS (SELECT sim, step, ('0x' || substr(md5(sim || '|' || step), 1, 12))::BIGINT AS h FROM (SELECT unnest(range(2000)) AS sim), (SELECT unnest(range(10)) AS step)),
jn AS (SELECT sim, step, ts FROM dw JOIN (SELECT DISTINCT n FROM dy) m ON true JOIN dy ON dy.k = dw.h % m.n),
st AS (SELECT sim, step, run, ln(1 + greatest(r, -0.99)) AS l FROM jn JOIN returns USING (ts) WHERE r IS NOT NULL)"""


def _simulated(spark, sf_dir, sims: int = 2000, steps: int = 10):
    """(sim, step, run, l): log returns of all assets on dates drawn at random, the same date for all of them."""
    rows = panels.bars_weekly(spark, sf_dir).transform(lambda df: df.select(F.col("symbol").alias("run"), "ts", cross.change(F.col("close")).alias("r"))).where("r IS NOT NULL")
    days = rows.select("ts").distinct()
    from pyspark.sql import Window

    days = days.withColumn("k", F.row_number().over(Window.orderBy("ts")) - 1)  # one series of dates
    n = days.agg(F.count(F.lit(1)).alias("n"))
    draws = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")).join(F.broadcast(n), how="cross")  # one row
    h = F.conv(F.substring(backtest.draw("sim", "step"), 1, 12), 16, 10).cast("long")
    drawn = draws.withColumn("k", (h % F.col("n")).cast("int")).join(days, "k")
    return drawn.join(rows, "ts").select("sim", "step", "run", F.log1p(F.greatest("r", F.lit(-0.99))).alias("l"))


@query(f"WITH {_DRAWS}, bk AS (SELECT sim, step, avg(exp(l) - 1) AS r FROM st GROUP BY 1, 2), tt AS (SELECT sim, exp(sum(ln(1 + r))) - 1 AS r FROM bk GROUP BY 1), q AS (SELECT quantile_cont(r, 0.05) AS v FROM tt) SELECT 'mix' AS run, {sfix('min(v)')} AS var, {sfix('avg(CASE WHEN r <= v THEN r END)')} AS cvar FROM tt, q")
def bootstrap_scenarios(spark, sf_dir):
    """Joint returns of dates drawn at random over horizons of 10 draws, with the risk of an equal mix."""
    from ..operators import metrics

    book = _simulated(spark, sf_dir).groupBy("sim", "step").agg(F.avg(F.exp("l") - 1).alias("r"))
    total = book.groupBy("sim").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("r"))
    return metrics.tail_risk(total.select(F.lit("mix").alias("run"), "r")).select("run", *fixed({"var": 5, "cvar": 5}))


@query(f"WITH {_DRAWS}, tt AS (SELECT sim, run, exp(sum(l)) - 1 AS r FROM st GROUP BY 1, 2) SELECT run, {sfix('avg(r)', 4)} AS mean, {sfix('var_samp(r)', 3)} AS var FROM tt GROUP BY 1")
def simulated_assets(spark, sf_dir):
    """Mean and variance of each asset's simulated return."""
    total = _simulated(spark, sf_dir).groupBy("sim", "run").agg((F.exp(F.sum("l")) - 1).alias("r"))
    return total.groupBy("run").agg(fix(F.avg("r"), 4).alias("mean"), fix(F.var_samp("r"), 3).alias("var"))


@query(f"WITH {_DRAWS}, bk AS (SELECT sim, step, ln(avg(exp(l))) AS l FROM st GROUP BY 1, 2), pt AS (SELECT sim, step, exp(sum(l) OVER (PARTITION BY sim ORDER BY step ROWS UNBOUNDED PRECEDING)) - 1 AS r FROM bk) SELECT step, {sfix('avg(r)', 4)} AS mean, {sfix('quantile_cont(r, 0.05)', 4)} AS low, {sfix('quantile_cont(r, 0.95)', 4)} AS high FROM pt GROUP BY 1")
def fan_chart(spark, sf_dir):
    """Mean and quantile bands of the simulated paths of an equal mix by step."""
    from pyspark.sql import Window

    book = _simulated(spark, sf_dir).groupBy("sim", "step").agg(F.ln(F.avg(F.exp("l"))).alias("l"))
    path = F.exp(F.sum("l").over(Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))) - 1
    paths = book.withColumn("r", path)
    return paths.groupBy(F.col("step").cast("long").alias("step")).agg(fix(F.avg("r"), 4).alias("mean"), fix(F.percentile("r", F.lit(0.05)), 4).alias("low"), fix(F.percentile("r", F.lit(0.95)), 4).alias("high"))
