"""Queries that train models on the daily panel; checked by properties, the preparation of rows by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.windows import by_symbol, change, lag, rolling
from ..operators import backtest, clean, cross, learn, moments, trees
from ..sources import panels
from ..sources.store import stored
from .features import D, dense
from .oracle import BARS, DENSE, ORACLES, RETURNS, S, day, fix, fixed, query, sfix, sfixed, srolling

FEATURES = ["ret_1", "ret_5", "vol_10", "sma_ratio", "rsi"]


def rows(spark, sf_dir) -> DataFrame:
    """Features, label (whether the next close is higher) and test_mask of each bar with all features.

    Bars and rows are stored, as a fit reads its rows again and again: the line items are read once, whatever the model.
    """
    c = F.col("close")
    bars = stored(panels.bars_daily(spark, sf_dir), "bars").withColumn("r", I.log_return())
    bars = bars.withColumns({"ret_1": lag(F.col("r"), 0), "ret_5": I.log_return(5), "vol_10": rolling(F.stddev_samp, F.col("r"), 10), "sma_ratio": c / I.sma(c, 20), "rsi": I.rsi(14, c, eps=1e-12)})
    nxt = F.lead(c).over(by_symbol())
    bars = bars.withColumns({"label": F.when(nxt.isNotNull(), (nxt > c).cast("double")), "fwd": F.ln(nxt / c)})
    return stored(clean.split_dates(bars.na.drop(subset=FEATURES), 0.7), "rows")


@query(f"""WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({S})) AS r, ln(close / lag(close, 5) OVER ({S})) AS ret_5, close / ({srolling('avg', 'close', 20)}) AS sma_ratio FROM bars),
b AS (SELECT *, {srolling('stddev_samp', 'r', 10)} AS vol_10 FROM a), e AS (SELECT * FROM b WHERE r IS NOT NULL AND ret_5 IS NOT NULL AND vol_10 IS NOT NULL AND sma_ratio IS NOT NULL),
n AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS rn, (SELECT count(DISTINCT ts) FROM e) AS c FROM e), t AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM n WHERE rn <= floor(c * CAST(0.7 AS DOUBLE)) - 1) SELECT symbol, {D}, {sfix('(r - m) / s', 4)} AS z FROM n, t WHERE rn > floor(c * CAST(0.7 AS DOUBLE))""")
def scaled_features(spark, sf_dir):
    """A feature of test rows in units of the training rows' deviation."""
    df = rows(spark, sf_dir)
    fit = df.where("test_mask = 0").agg(F.avg("ret_1").alias("m"), F.stddev_samp("ret_1").alias("s"))
    return df.where("test_mask = 1").join(F.broadcast(fit), how="cross").select("symbol", day(), fix((F.col("ret_1") - F.col("m")) / F.col("s"), 4).alias("z"))  # one row


#: Rows that models learn from, by the number dn of their date.
ROWS = f"""{BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({S})) AS ret_1, ln(close / lag(close, 5) OVER ({S})) AS ret_5, close / ({srolling('avg', 'close', 20)}) AS sma_ratio, lead(close) OVER ({S}) AS nx, close - lag(close) OVER ({S}) AS x FROM bars),
b AS (SELECT *, {srolling('stddev_samp', 'ret_1', 10)} AS vol_10, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS u, CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END AS w FROM a), c AS (SELECT *, 100 - 100 / (1 + ({srolling('avg', 'u', 14)}) / (({srolling('avg', 'w', 14)}) + 1e-12)) AS rsi FROM b),
e AS (SELECT *, ln(nx / close) AS fwd, dense_rank() OVER (ORDER BY ts) AS dn FROM c WHERE {' AND '.join(f'{k} IS NOT NULL' for k in FEATURES)}), m AS (SELECT floor(max(dn) * CAST(0.7 AS DOUBLE)) AS cut FROM e)"""
#: Forward folds of the dates (numbers from 0), as of forward_folds().
FOLDS = """n0 AS (SELECT count(DISTINCT dn) AS c, count(DISTINCT dn) // 6 AS span FROM e), f0 AS (SELECT t, c, span FROM (SELECT c, span, unnest(range(span + 5, c, greatest(5, span))) AS t FROM n0) WHERE least(t + greatest(5, span), c) - t >= 5),
folds AS (SELECT (t - span - 5) // greatest(5, span) AS fold, 0 AS a, t - 5 AS z, t, CASE WHEN t = max(t) OVER () THEN c ELSE least(t + greatest(5, span), c) END AS e FROM f0)"""


def net_sql(spans: str, models: str, sweeps: int = 400) -> str:
    """Tables up to `net` (fold, model, intercept, w0, w1, ...): elastic nets on rows e by spans (fold, a, z) and models (model, reg, mix), by sweeps of coordinate descent."""
    k = range(len(FEATURES))
    r = lambda i, j: f"r{min(i, j)}_{max(i, j)}"
    cov = lambda x, y: f"(avg({x} * {y}) - avg({x}) * avg({y}))"
    stats = [f"avg({FEATURES[i]}) AS m{i}, sqrt{cov(FEATURES[i], FEATURES[i])} AS s{i}, {cov(FEATURES[i], 'fwd')} / sqrt{cov(FEATURES[i], FEATURES[i])} AS c{i}" for i in k]
    stats += [f"{cov(FEATURES[i], FEATURES[j])} / sqrt({cov(FEATURES[i], FEATURES[i])} * {cov(FEATURES[j], FEATURES[j])}) AS {r(i, j)}" for i in k for j in k if i < j]
    step = []
    for i in k:  # those before have moved already
        part = f"(c{i} - " + " - ".join(f"{r(i, j)} * {'v' if j < i else 'w'}{j}" for j in k if j != i) + ")"
        step.append(f"sign({part}) * greatest(abs({part}) - reg * mix, 0) / (1 + reg * (1 - mix) / sy) AS v{i}")
    return f"""st AS MATERIALIZED (SELECT fold, avg(fwd) AS my, sqrt{cov('fwd', 'fwd')} AS sy, {', '.join(stats)} FROM {spans} JOIN e ON dn - 1 >= a AND dn - 1 < z WHERE fwd IS NOT NULL GROUP BY fold),
cd AS (SELECT fold, model, 0 AS step, {', '.join(f'CAST(0 AS DOUBLE) AS v{i}' for i in k)} FROM st, {models} UNION ALL SELECT fold, model, step + 1, {', '.join(f'v{i}' for i in k)} FROM (SELECT fold, model, step, {', '.join(step)} FROM (SELECT fold, model, step, {', '.join(f'v{i} AS w{i}' for i in k)} FROM cd) JOIN st USING (fold) JOIN {models} USING (model) WHERE step < {sweeps})),
net AS MATERIALIZED (SELECT fold, model, my - {' - '.join(f'm{i} * v{i} / s{i}' for i in k)} AS intercept, {', '.join(f'v{i} / s{i} AS w{i}' for i in k)} FROM cd JOIN st USING (fold) WHERE step = {sweeps})"""


SCORE = "intercept + " + " + ".join(f"w{i} * {x}" for i, x in enumerate(FEATURES))


@query(f"""WITH {ROWS}
SELECT symbol, {D}, {sfixed({'ret_1': 4, 'ret_5': 4, 'vol_10': 4, 'sma_ratio': 4, 'rsi': 3})}, CAST(CASE WHEN nx IS NOT NULL THEN nx > close END AS INT) AS label, {sfix('fwd', 4)} AS fwd, CAST(CASE WHEN dn > cut THEN 1 WHEN dn <= cut - 1 THEN 0 END AS INT) AS test_mask FROM e, m""")
def model_rows(spark, sf_dir):
    """What the models of bars learn from and are tested on: features, label, forward return, and the split with its gap."""
    return rows(spark, sf_dir).select("symbol", day(), *fixed({"ret_1": 4, "ret_5": 4, "vol_10": 4, "sma_ratio": 4, "rsi": 3}), F.col("label").cast("int").alias("label"), fix("fwd", 4).alias("fwd"), F.col("test_mask").cast("int").alias("test_mask"))


@query(f"WITH {BARS}, a AS (SELECT symbol, lead(close) OVER ({S}) > close AS up FROM bars), n AS (SELECT count(*) FILTER (NOT up) AS n0, count(*) FILTER (up) AS n1 FROM a) SELECT CAST(up AS BIGINT) AS label, count(*) AS n, {sfix('CASE WHEN up THEN min(n0) / min(n1) ELSE 1 END')} AS weight FROM a, n WHERE up IS NOT NULL GROUP BY up")
def class_weights(spark, sf_dir):
    df = panels.bars_daily(spark, sf_dir).select((F.lead("close").over(by_symbol()) > F.col("close")).cast("long").alias("label")).where("label IS NOT NULL")
    return learn.class_weight(df).groupBy("label").agg(F.count(F.lit(1)).alias("n"), fix(F.first("weight")).alias("weight"))


def _scores(df: DataFrame) -> DataFrame:
    return df.select("symbol", day(), "label", "score")


@query()
def gbt_direction(spark, sf_dir):
    return _scores(learn.fit_predict(rows(spark, sf_dir), learn.direction_model("gbt", FEATURES, maxIter=8, maxDepth=3)))


@query()
def forest_direction(spark, sf_dir):
    return _scores(learn.fit_predict(rows(spark, sf_dir), learn.direction_model("forest", FEATURES, numTrees=15, maxDepth=4)))


@query(f"""WITH RECURSIVE {ROWS}, one AS (SELECT 0 AS fold, 0 AS a, cut - 1 AS z FROM m), models(model, reg, mix) AS (VALUES ('net', 0.01, 0.5)), {net_sql('one', 'models')}
SELECT symbol, {D}, {sfix('fwd', 4)} AS label, {sfix(SCORE, 4)} AS score FROM e, m, net WHERE dn > cut""")
def elastic_net_return(spark, sf_dir):
    """Next returns by an elastic net of the training rows' sums of products."""
    df = stored(numbered(rows(spark, sf_dir).withColumn("label", F.col("fwd"))), "net")
    cut = F.floor((F.max("n") + 1) * 0.7)
    fold = df.agg(F.lit(0).cast("long").alias("fold"), F.lit(0).cast("long").alias("train_start"), (cut - 1).alias("train_end"), cut.alias("test_start"), (F.max("n") + 1).cast("long").alias("test_end"))
    out = moments.scored(df, moments.fits(df, {"net": (0.01, 0.5)}, fold, FEATURES, "label", "n"), FEATURES, "n")
    return out.select("symbol", day(), *fixed({"label": 4, "score": 4}))


def numbered(df: DataFrame) -> DataFrame:
    """Rows with the number n of their date, from 0."""
    n = df.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")).cast("long") - 1)  # one row a date
    return df.join(n, "ts")


@query()
def boosted_return(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("label", F.col("fwd"))
    return _scores(learn.fit_predict(df, learn.return_model("gbt", FEATURES, maxIter=8, maxDepth=3)))


#: Edges of bins of the features as they are: returns and deviations, ratios, index points.
GRID = [-0.5, -0.2, -0.1, -0.05, -0.02, 0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.5, 30.0, 40.0, 45.0, 50.0, 55.0, 60.0, 70.0]


@query()
def bagged_return(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("label", F.col("fwd"))
    return learn.bagged(df, FEATURES, GRID, ["symbol", "ts"], n=5).select("symbol", day(), "score")


RANKED = cross.FEATURES


def ranked_panel(spark, sf_dir) -> tuple[DataFrame, list]:
    panel = stored(dense(spark, sf_dir), "panel")
    schedule = clean.weekly_schedule(panel.select("ts").distinct())
    dates = [r["ts"] for r in schedule.select("ts").orderBy("ts").toLocalIterator()]  # the weeks of the calendar
    return cross.features(panel, schedule), dates


def _z(x: str) -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY ts)) / (stddev_samp({x}) OVER (PARTITION BY ts) + 1e-12)"


@query(f"""WITH {DENSE}, a AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS r, close - lag(close) OVER ({S}) AS x FROM dense), b AS (SELECT *, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS u, CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END AS w FROM a),
c AS (SELECT symbol, ts, close, close / lag(close, 5) OVER ({S}) - 1 AS ret_5, close / lag(close, 21) OVER ({S}) - 1 AS ret_21, close / lag(close, 63) OVER ({S}) - 1 AS ret_63, lag(close, 21) OVER ({S}) / lag(close, 126) OVER ({S}) - 1 AS mom_126, lag(close, 21) OVER ({S}) / lag(close, 252) OVER ({S}) - 1 AS mom_252,
{srolling('stddev_samp', 'r', 21)} AS vol_21, {srolling('stddev_samp', 'r', 63)} AS vol_63, close / ({srolling('avg', 'close', 50)}) - 1 AS sma_50, close / ({srolling('avg', 'close', 200)}) - 1 AS sma_200, 100 - 100 / (1 + ({srolling('avg', 'u', 14)}) / (({srolling('avg', 'w', 14)}) + 1e-12)) AS rsi FROM b),
e AS (SELECT *, lead(close) OVER ({S}) / close - 1 AS nx FROM c WHERE ts IN (SELECT max(ts) FROM (SELECT DISTINCT ts FROM dense) GROUP BY isoyear(ts), weekofyear(ts))),
f AS (SELECT symbol, ts, {', '.join(f'{_z(k)} AS {k}' for k in RANKED)}, CASE WHEN nx IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY nx NULLS LAST) + (count(nx) OVER (PARTITION BY ts, nx) - 1) / 2.0) / count(nx) OVER (PARTITION BY ts) END AS target FROM e)
SELECT symbol, {D}, {sfixed({k: 4 for k in [*RANKED, 'target']})} FROM f WHERE {' AND '.join(f'{k} IS NOT NULL' for k in RANKED)}""")
def feature_panel(spark, sf_dir):
    return ranked_panel(spark, sf_dir)[0].select("symbol", day(), *fixed({k: 4 for k in [*RANKED, "target"]}))


#: Features and target of the ranker, by the number of the date in the schedule, and members of its refits (every 52 dates after 105).
_fp = ORACLES["feature_panel"]
RANK_SQL = _fp[len("WITH "):_fp.rindex("SELECT symbol,")].rstrip() + f""",
sd AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS nth FROM (SELECT max(ts) AS ts FROM (SELECT DISTINCT ts FROM dense) GROUP BY isoyear(ts), weekofyear(ts))),
rk AS (SELECT f.*, nth, (SELECT max(nth) FROM sd) AS mx FROM f JOIN sd USING (ts) WHERE {' AND '.join(f'{k} IS NOT NULL' for k in RANKED)}),
mb AS (SELECT rk.*, model FROM rk, range(50) AS r(model) WHERE target IS NOT NULL AND 105 + model * 52 <= mx AND nth < 105 + model * 52 - 1)"""
#: The best split of each model's rows as of trees.splits(), of a table mb (model, y and bins by feature).
_BIN = lambda x: f"len([q FOR q IN {learn.EDGES} IF q < {x}])"


@query(f"""WITH {RANK_SQL}, base AS (SELECT model, avg(target) AS mean FROM mb GROUP BY 1), ex AS (SELECT model, target - mean AS g, unnest([{', '.join(map(str, range(len(RANKED))))}]) AS feature, unnest([{', '.join(_BIN(k) for k in RANKED)}]) AS bin FROM mb JOIN base USING (model)),
h AS (SELECT model, feature, bin, count(*) AS n, sum(g) AS g FROM ex GROUP BY ALL), cu AS (SELECT model, feature, bin, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER a AS n, sum(g) OVER a AS g FROM h WINDOW w AS (PARTITION BY model, feature ORDER BY bin), a AS (PARTITION BY model, feature)),
gn AS (SELECT *, gl / nl AS l, (g - gl) / (n - nl) AS r, round(gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n, 9) AS gain FROM cu WHERE nl >= 5 AND n - nl >= 5)
SELECT model, feature, bin, {sfix('gain', 4)} AS gain, {sfix('l', 4)} AS "left", {sfix('r', 4)} AS "right" FROM gn WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY gain DESC, feature, bin) = 1""")
def first_splits(spark, sf_dir):
    """The first split of the first tree of every refit of the ranker."""
    panel, dates = ranked_panel(spark, sf_dir)
    _, grown = trees.boosted(learn.refit_members(panel, dates, RANKED, 52, 104), rounds=1, depth=1)
    return grown.select(F.col("model").cast("long").alias("model"), F.col("feature").cast("long").alias("feature"), F.col("bin").cast("long").alias("bin"), *fixed({"gain": 4, "left": 4, "right": 4}))


@query()
def gbt_ranker(spark, sf_dir):
    """A ranker refitted every year, of rows whose target was known by then."""
    panel, dates = ranked_panel(spark, sf_dir)
    return learn.walk_forward_ranker(panel, dates, RANKED, every=52, least_dates=104).select("symbol", day(), "score")


@query()
def bear_state(spark, sf_dir):
    """States of the benchmark by return and volatility, each by a fit on earlier dates."""
    return learn.bear_state(panels.bench_daily(spark, sf_dir)).select(day(), "ret", "vol", "bear")


_RT = f"""{RETURNS}, nb AS (SELECT run, ts, r, lead(r) OVER (PARTITION BY run ORDER BY ts) AS y, row_number() OVER (PARTITION BY run ORDER BY ts) - 1 AS n, count(*) OVER (PARTITION BY run) AS c FROM returns)"""


def _folded(train: int, test: int, purge: int, expanding: bool) -> str:
    """Folds of each run, a line fitted on each fold's training rows, and the test rows' predictions."""
    start = "0" if expanding else f"t - {purge} - {train}"
    return f"""{_RT}, fd AS (SELECT run, (t - {train + purge}) // {test} AS fold, {start} AS a, t - {purge} AS z, t, least(t + {test}, c) AS e FROM (SELECT run, c, unnest(range({train + purge}, c, {test})) AS t FROM (SELECT DISTINCT run, c FROM nb)) WHERE least(t + {test}, c) - t >= 5),
ft AS (SELECT fd.run, fd.fold, regr_slope(y, r) AS b, regr_intercept(y, r) AS a FROM fd JOIN nb ON nb.run = fd.run AND nb.n >= fd.a AND nb.n < fd.z WHERE y IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT nb.run, nb.ts, fd.fold, ft.a + ft.b * nb.r AS score FROM nb LEFT JOIN fd ON fd.run = nb.run AND nb.n >= fd.t AND nb.n < fd.e LEFT JOIN ft ON ft.run = fd.run AND ft.fold = fd.fold)"""


def _predicted(spark, sf_dir, train: int, test: int, purge: int, expanding: bool) -> DataFrame:
    r = panels.bars_weekly(spark, sf_dir).select(F.col("symbol").alias("run"), "ts", change(F.col("close")).alias("r"))
    by = Window.partitionBy("run").orderBy("ts")
    rows = r.withColumns({"n": F.row_number().over(by) - 1, "label": F.lead("r").over(by)})
    folds = backtest.fold_table(r, train, test, purge, expanding)
    return backtest.assign_folds(rows, folds).drop("fold").join(learn.fit_folds(rows, folds, ["r"]).select("run", "ts", "fold", "score"), ["run", "ts"], "left")


@query(f"WITH {_folded(104, 26, 5, True)} SELECT run, {D}, CAST(fold AS BIGINT) AS fold, CAST(fold IS NOT NULL AS BIGINT) AS test_mask, {sfix('score', 4)} AS score, CAST(coalesce(score > 0, false) AS BIGINT) AS position FROM pr")
def stitched_predictions(spark, sf_dir):
    """Out-of-sample predictions of all folds in one series, with positions that are flat before the first fold."""
    rows = _predicted(spark, sf_dir, 104, 26, 5, True)
    return rows.select("run", day(), F.col("fold").cast("long").alias("fold"), F.col("test_mask").cast("long").alias("test_mask"), fix("score", 4).alias("score"), F.coalesce(F.col("score") > 0, F.lit(False)).cast("long").alias("position"))


@query(f"WITH {_folded(60, 10, 1, False)} SELECT run, {D}, {sfix('score', 4)} AS score FROM pr WHERE fold IS NOT NULL")
def rolling_retrain(spark, sf_dir):
    """A model for each symbol fitted again every ten bars on the last sixty whose label was known."""
    return _predicted(spark, sf_dir, 60, 10, 1, False).where("test_mask = 1").select("run", day(), *fixed({"score": 4}))


@query()
def selected_features(spark, sf_dir):
    """The three features that tell directions apart best, and what is left by elimination."""
    df = rows(spark, sf_dir).where("test_mask = 0")
    best = learn.best_features(df, FEATURES, 3)
    left = learn.eliminate(df, lambda c: learn.direction_model("forest", c, numTrees=8, maxDepth=3), FEATURES, 3)
    names = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(c in best).alias("best"), F.lit(c in left).alias("left")) for c in FEATURES))).alias("x")
    return df.agg(F.count(F.lit(1)).alias("n")).select("n", names).select("x.*", "n")
