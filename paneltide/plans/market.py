"""Queries over positions, portfolios, sleeves, orders and risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.windows import by_symbol, change, lag, ratio, rolling
from ..operators import backtest, clean, cross, metrics, orders, rules
from ..sources import panels
from .features import _MACD_SQL, D, dense
from .oracle import BARS, BENCH, DENSE, RETURNS, S, WEEKLY, day, fix, fixed, query, sema, sfix, sfixed, srolling


def returns(spark, sf_dir) -> DataFrame:
    return panels.bars_weekly(spark, sf_dir).select(F.col("symbol").alias("run"), "ts", change(F.col("close")).alias("r"))


def _pnl(positions: str) -> str:
    """CTE pnl (symbol, ts, r) from a CTE with symbol, ts, close, position."""
    return f"""pb AS (SELECT *, coalesce(lag(position) OVER ({S}), 0) AS before, close / lag(close) OVER ({S}) - 1 AS ret FROM {positions}),
pnl AS (SELECT symbol, ts, close, position, coalesce(ret * before, 0) - abs(position - before) * 0.001 AS r FROM pb)"""


_BOLL = f"""ba AS (SELECT *, {srolling('avg', 'close', 20)} AS mid, {srolling('stddev_samp', 'close', 20)} AS sd FROM {{0}}),
bb AS (SELECT *, CASE WHEN close < mid - sd THEN 1 WHEN close >= mid THEN 0 END AS e FROM ba),
pos AS (SELECT symbol, ts, close, coalesce(last_value(e IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS position FROM bb)"""


@query(f"WITH {BARS}, {_BOLL.format('bars')}, s AS (SELECT *, coalesce(position - lag(position) OVER ({S}), 0) AS signal FROM pos) SELECT symbol, {D}, CAST(position AS BIGINT) AS position, CAST(signal AS BIGINT) AS signal FROM s")
def bollinger_positions(spark, sf_dir):
    rows = rules.bollinger_reversion(panels.bars_daily(spark, sf_dir), k=1.0)
    return rows.withColumn("signal", rules.signal(F.col("position"))).select("symbol", day(), F.col("position").cast("long").alias("position"), F.col("signal").cast("long").alias("signal"))


_PERF = {"log_total": 5, "cagr": 5, "vol": 5, "sharpe": 5, "sortino": 5, "max_dd": 5, "calmar": 5}
_PERF_SQL = """c AS (SELECT run, ts, r, product(1 + r) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS curve FROM {0} WHERE r IS NOT NULL),
dd AS (SELECT run, ts, r, curve / max(curve) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c),
p AS (SELECT run, count(r) AS n, product(1 + r) AS growth, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS down, min(dd) AS max_dd FROM dd GROUP BY run),
perf AS (SELECT run, n, ln(growth) AS log_total, CASE WHEN growth > 0 THEN pow(growth, {1} / n) END - 1 AS cagr, sd * sqrt({1}) AS vol, CASE WHEN sd <> 0 THEN m / sd END * sqrt({1}) AS sharpe, CASE WHEN down > 0 THEN m / down * sqrt({1}) END AS sortino, max_dd FROM p),
pf AS (SELECT *, CASE WHEN max_dd < 0 THEN cagr / abs(max_dd) END AS calmar FROM perf)"""


@query(f"WITH {WEEKLY}, {_BOLL.format('weekly')}, {_pnl('pos')}, q AS (SELECT symbol AS run, ts, r FROM pnl), {_PERF_SQL.format('q', '52.0')} SELECT run, n, {sfixed(_PERF)} FROM pf")
def boll_backtest_metrics(spark, sf_dir):
    rows = backtest.profit(rules.bollinger_reversion(panels.bars_weekly(spark, sf_dir), k=1.0))
    return metrics.performance(rows.select(F.col("symbol").alias("run"), "ts", "r"), 52).withColumn("log_total", F.log1p("total")).select("run", "n", *fixed(_PERF))


@query(f"WITH {RETURNS}, {_PERF_SQL.format('returns', '52.0')} SELECT run, n, {sfixed(_PERF)} FROM pf")
def performance_weekly(spark, sf_dir):
    return metrics.performance(returns(spark, sf_dir), 52).withColumn("log_total", F.log1p("total")).select("run", "n", *fixed(_PERF))


@query(f"WITH {WEEKLY}, e AS (SELECT symbol AS run, ts, close / lag(close) OVER ({S}) - 1 AS r FROM weekly), {_PERF_SQL.format('e', '52.0')} SELECT run, {sfixed({'cagr': 5, 'sharpe': 5, 'max_dd': 5})} FROM pf")
def equity_curve_metrics(spark, sf_dir):
    curve = panels.bars_weekly(spark, sf_dir).select(F.col("symbol").alias("run"), "ts", F.col("close").alias("equity"))
    return metrics.equity_metrics(curve, 52).select("run", *fixed({"cagr": 5, "sharpe": 5, "max_dd": 5}))


@query(f"WITH RECURSIVE {BARS}, {_MACD_SQL}, x AS (SELECT *, lag(macd) OVER ({S}) AS m1, lag(macd_signal) OVER ({S}) AS s1 FROM mc), e AS (SELECT *, CASE WHEN macd > macd_signal AND m1 <= s1 AND hist_change > 0 AND macd > 0 AND macd_signal > 0 THEN 1 WHEN macd < macd_signal AND m1 >= s1 AND hist_change < 0 AND macd < 0 AND macd_signal < 0 THEN 0 END AS e FROM x) SELECT symbol, {D}, CAST(coalesce(last_value(e IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS position FROM e")
def macd_positions(spark, sf_dir):
    return rules.macd_cross(panels.bars_daily(spark, sf_dir)).select("symbol", day(), F.col("position").cast("long").alias("position"))


@query(f"""WITH {BARS}, a AS (SELECT *, {srolling('avg', 'close', 10)} AS sh, {srolling('avg', 'close', 30)} AS lo, lag(close) OVER ({S}) AS p FROM bars),
b AS (SELECT *, sh - lo AS df, CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM a),
c AS (SELECT *, avg(df) OVER ({S} ROWS UNBOUNDED PRECEDING) AS md, ({srolling('avg', 'tr', 14)}) / close AS rg FROM b),
e AS (SELECT *, CASE WHEN md <> 0 THEN degrees(atan(df / md)) END AS ang FROM c),
f AS (SELECT *, CASE WHEN coalesce(sh > lo, false) AND ang >= 5 AND rg > 0.01 THEN 1 WHEN NOT coalesce(sh > lo, false) AND ang <= -5 AND rg > 0.01 THEN 0 END AS e FROM e)
SELECT symbol, {D}, CAST(coalesce(last_value(e IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS position FROM f""")
def ma_positions(spark, sf_dir):
    bars = panels.bars_daily(spark, sf_dir).withColumns({"short": I.sma(F.col("close"), 10), "long": I.sma(F.col("close"), 30), "tr": I.true_range()})
    bars = bars.withColumns({"df": F.col("short") - F.col("long"), "range": rolling(F.avg, F.col("tr"), 14) / F.col("close")})
    bars = bars.withColumn("angle", F.degrees(F.atan(ratio(F.col("df"), F.avg("df").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))))))
    above = F.coalesce(F.col("short") > F.col("long"), F.lit(False))
    from ..functions.windows import held

    position = held(above & (F.col("angle") >= 5) & (F.col("range") > 0.01), ~above & (F.col("angle") <= -5) & (F.col("range") > 0.01))
    return bars.withColumn("position", position).select("symbol", day(), F.col("position").cast("long").alias("position"))


@query(f"WITH {WEEKLY}, n AS (SELECT *, row_number() OVER ({S}) AS rn, count(*) OVER (PARTITION BY symbol) AS c FROM weekly), pos AS (SELECT symbol, ts, close, CASE WHEN rn > 1 AND rn < c THEN 1 ELSE 0 END AS position FROM n), {_pnl('pos')}, g AS (SELECT symbol, ts, product(1 + r) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS growth FROM pnl) SELECT symbol, {D}, {sfix('ln(1 + growth)')} AS log_growth FROM g")
def buy_and_hold_equity(spark, sf_dir):
    return backtest.profit(rules.buy_and_hold(panels.bars_weekly(spark, sf_dir))).select("symbol", day(), fix(F.log1p("growth")).alias("log_growth"))


_ENGINE = {"log_equity": 4, "profit_share": 4, "turnover": 4, "fitness": 4, "log_per_trade": 4}


@query(f"""WITH {WEEKLY}, {_BOLL.format('weekly')}, {_pnl('pos')}, g AS (SELECT symbol, ts, r, product(1 + r) OVER ({S} ROWS UNBOUNDED PRECEDING) AS c, coalesce(position - lag(position) OVER ({S}), 0) AS sg FROM pnl),
e AS (SELECT *, 10000 * c AS equity FROM g), d AS (SELECT ts, sum(equity) AS equity, avg(r) AS r, avg(c - 1) AS cum FROM e GROUP BY 1), l AS (SELECT last(equity ORDER BY ts) AS fin, last(cum ORDER BY ts) AS cum, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe FROM d),
t AS (SELECT sum(CASE WHEN sg > 0 THEN equity * sg ELSE 0 END) AS bought, -sum(CASE WHEN sg < 0 THEN equity * sg ELSE 0 END) AS sold, sum(abs(sg)) / 2 AS trades, 10000 * count(DISTINCT symbol) AS cash FROM e), f AS (SELECT fin - cash AS profit, fin AS final_equity, least(bought, sold) / fin AS turnover, sharpe / nullif(least(bought, sold) / fin, 0) AS fitness, cum / nullif(trades, 0) AS profit_per_trade FROM l, t), h AS (SELECT ln(abs(final_equity)) AS log_equity, profit / final_equity AS profit_share, turnover, fitness, ln(abs(profit_per_trade)) AS log_per_trade FROM f) SELECT {sfixed(_ENGINE)} FROM h""")
def engine_performance(spark, sf_dir):
    """Final equity, profit, turnover by the smaller of what is bought and sold, Sharpe over turnover, return of a trade; what compounds as logarithms."""
    rows = backtest.profit(rules.bollinger_reversion(panels.bars_weekly(spark, sf_dir), k=1.0))
    out = metrics.engine(rows.withColumn("signal", rules.signal(F.col("position"))))
    out = out.withColumns({"log_equity": F.ln(F.abs("final_equity")), "profit_share": ratio(F.col("profit"), F.col("final_equity")), "log_per_trade": F.ln(F.abs("profit_per_trade"))})
    return out.select(*fixed(_ENGINE))


@query(f"""WITH {BARS}, a AS (SELECT *, close / nullif({srolling('max', 'high', 20)}, 0) AS p, lag(close) OVER ({S}) AS pc FROM bars), b AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END END AS e, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM a),
c AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), first_value(e IGNORE NULLS) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS raw, ({srolling('avg', 'tr', 14)}) / close AS rg FROM b),
f AS (SELECT symbol, ts, coalesce(last_value(CASE WHEN rg > 0.5 THEN raw END IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), 0) AS position FROM c) SELECT symbol, {D}, CAST(position AS BIGINT) AS position, CAST(coalesce(position - lag(position) OVER ({S}), 0) AS BIGINT) AS signal FROM f""")
def volatility_filtered(spark, sf_dir):
    """Positions of a probability that change only on bars with a wide enough range."""
    df = panels.bars_daily(spark, sf_dir).withColumns({"p": ratio(F.col("close"), rolling(F.max, F.col("high"), 20)), "tr": I.true_range()})
    df = df.withColumns({"raw": rules.at_least(F.col("p"), 0.5), "wide": rolling(F.avg, F.col("tr"), 14) / F.col("close") > 0.5})
    df = rules.filtered(df, F.col("raw"), F.col("wide"))
    return df.withColumn("signal", rules.signal(F.col("position"))).select("symbol", day(), F.col("position").cast("long").alias("position"), F.col("signal").cast("long").alias("signal"))


@query(f"WITH {BARS}, a AS (SELECT symbol, ts, close / nullif({srolling('max', 'high', 20)}, 0) AS p FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY p DESC NULLS LAST, symbol) AS rk FROM a), b AS (SELECT symbol, ts, CASE WHEN p IS NOT NULL AND rk <= 3 THEN 1 ELSE 0 END AS position FROM k) SELECT symbol, {D}, CAST(position AS BIGINT) AS position, CAST(coalesce(position - lag(position) OVER ({S}), 0) AS BIGINT) AS signal FROM b")
def long_top_k(spark, sf_dir):
    """Long the three symbols of each date with the highest probability."""
    df = panels.bars_daily(spark, sf_dir).withColumn("p", ratio(F.col("close"), rolling(F.max, F.col("high"), 20)))
    df = rules.long_top(df, F.col("p"), 3)
    return df.withColumn("signal", rules.signal(F.col("position"))).select("symbol", day(), F.col("position").cast("long").alias("position"), F.col("signal").cast("long").alias("signal"))


@query(f"WITH {WEEKLY}, {_BOLL.format('weekly')}, {_pnl('pos')}, g AS (SELECT symbol, ts, r, 10000 * product(1 + r) OVER ({S} ROWS UNBOUNDED PRECEDING) AS equity FROM pnl) SELECT {D}, {sfix('ln(sum(equity))')} AS log_equity, {sfix('avg(r)')} AS r FROM g GROUP BY ts")
def engine_book(spark, sf_dir):
    rows = backtest.book(backtest.profit(rules.bollinger_reversion(panels.bars_weekly(spark, sf_dir), k=1.0)))
    return rows.select(day(), fix(F.ln("equity")).alias("log_equity"), fix("r").alias("r"))


@query(f"WITH {BARS}, {_BOLL.format('bars')}, s AS (SELECT *, coalesce(position - lag(position) OVER ({S}), 0) AS signal FROM pos) SELECT symbol, {D}, CASE WHEN signal > 0 THEN 'entry' ELSE 'exit' END AS event FROM s WHERE signal <> 0")
def trade_events(spark, sf_dir):
    rows = rules.bollinger_reversion(panels.bars_daily(spark, sf_dir), k=1.0)
    return rules.trade_events(rows.withColumn("signal", rules.signal(F.col("position")))).select("symbol", day(), "event")


@query(f"""WITH {BARS}, a AS (SELECT *, lead(close) OVER ({S}) - close AS nx, close - lag(close) OVER ({S}) AS pv FROM bars), b AS (SELECT symbol, CASE WHEN nx > 0 THEN 1 WHEN nx IS NOT NULL THEN 0 END AS y, CASE WHEN pv < 0 THEN 1 WHEN pv IS NOT NULL THEN 0 END AS g FROM a),
c AS (SELECT symbol, count(*) FILTER (y = 1 AND g = 1) AS tp, count(*) FILTER (y = 0 AND g = 1) AS fp, count(*) FILTER (y = 1 AND g = 0) AS fn, count(*) FILTER (y = 0 AND g = 0) AS tn FROM b GROUP BY 1)
SELECT symbol, tp, fp, fn, tn, {sfix('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {sfix('tp / (tp + fp)')} AS precision, {sfix('tp / (tp + fn)')} AS recall, {sfix('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    c = F.col("close")
    rows = panels.bars_daily(spark, sf_dir).withColumns({"y": (F.lead(c).over(by_symbol()) > c).cast("int"), "g": (c < lag(c)).cast("int")})
    return metrics.confusion(rows, F.col("y"), F.col("g"), ["symbol"]).select("symbol", "tp", "fp", "fn", "tn", *fixed({"accuracy": 5, "precision": 5, "recall": 5, "f1": 5}))


@query(f"""WITH {BARS}, a AS (SELECT symbol AS run, lead(close) OVER ({S}) AS nx, close, close - lag(close) OVER ({S}) AS pv FROM bars), b AS (SELECT run, CASE WHEN nx > close THEN 1 ELSE 0 END AS y, -pv AS s FROM a WHERE nx IS NOT NULL AND pv IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY s) + (count(*) OVER (PARTITION BY run, s) - 1) / 2.0 AS rk FROM b) SELECT run, {sfix('(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))')} AS auc FROM r GROUP BY 1""")
def auc_reversal(spark, sf_dir):
    c = F.col("close")
    nxt = F.lead(c).over(by_symbol())
    rows = panels.bars_daily(spark, sf_dir).select(F.col("symbol").alias("run"), "ts", F.when(nxt.isNotNull(), (nxt > c).cast("int")).alias("y"), (lag(c) - c).alias("s"))
    return metrics.auc(rows, F.col("y"), F.col("s")).select("run", *fixed({"auc": 5}))


@query(f"WITH {RETURNS}, a AS (SELECT *, lag(r) OVER (PARTITION BY run ORDER BY ts) AS g FROM returns), b AS (SELECT run, lag(sign(-g)) OVER (PARTITION BY run ORDER BY ts) * r AS r FROM a) SELECT run, {sfix('avg(r) / stddev_samp(r) * sqrt(252)')} AS sharpe FROM b WHERE r IS NOT NULL GROUP BY 1")
def signal_sharpe(spark, sf_dir):
    rows = returns(spark, sf_dir).withColumn("g", F.lag("r").over(Window.partitionBy("run").orderBy("ts")))
    return metrics.signal_sharpe(rows, -F.col("g"), F.col("r")).select("run", *fixed({"sharpe": 5}))


@query(f"WITH {RETURNS}, a AS (SELECT run, r AS y, -0.5 * lag(r) OVER (PARTITION BY run ORDER BY ts) AS g FROM returns), b AS (SELECT * FROM a WHERE y IS NOT NULL AND g IS NOT NULL) SELECT run, count(*) AS n, {sfix('1 - sum(pow(y - g, 2)) / (var_pop(y) * count(*))')} AS r2, {sfix('avg(CASE WHEN sign(y) = sign(g) THEN 1.0 ELSE 0.0 END)')} AS hits FROM b GROUP BY 1")
def regression_fit(spark, sf_dir):
    rows = returns(spark, sf_dir).withColumn("g", -0.5 * F.lag("r").over(Window.partitionBy("run").orderBy("ts")))
    return metrics.regression_fit(rows, F.col("r"), F.col("g")).select("run", "n", *fixed({"r2": 5, "hits": 5}))


@query(f"WITH {RETURNS} SELECT run, CAST(year(ts) AS BIGINT) AS year, {sfix('product(1 + r) - 1', 4)} AS total FROM returns WHERE r IS NOT NULL GROUP BY ROLLUP (run, year(ts)) HAVING run IS NOT NULL")
def yearly_returns_rollup(spark, sf_dir):
    return metrics.yearly(returns(spark, sf_dir).where("r IS NOT NULL")).select("run", F.col("year").cast("long").alias("year"), *fixed({"total": 4}))


@query(f"WITH {RETURNS} SELECT {D}, {sfix('avg(r)')} AS r FROM returns WHERE r IS NOT NULL GROUP BY ts")
def equal_weight_benchmark(spark, sf_dir):
    return returns(spark, sf_dir).where("r IS NOT NULL").groupBy("ts").agg(F.avg("r").alias("r")).select(day(), *fixed({"r": 5}))


@query(f"WITH {RETURNS}, s AS (SELECT run, {srolling('avg', 'r', 156, 'PARTITION BY run ORDER BY ts')} AS m, {srolling('stddev_samp', 'r', 156, 'PARTITION BY run ORDER BY ts')} AS sd FROM returns) SELECT run, {sfix('min(m / sd) * sqrt(252)')} AS sharpe_min FROM s GROUP BY 1")
def rolling_sharpe_min(spark, sf_dir):
    return metrics.rolling_sharpe_min(returns(spark, sf_dir), 156).select("run", *fixed({"sharpe_min": 5}))


@query(f"WITH {RETURNS}, q AS (SELECT run, quantile_cont(r, 0.05) AS v FROM returns GROUP BY 1) SELECT r.run, {sfix('min(v)')} AS var, {sfix('avg(CASE WHEN r <= v THEN r END)')} AS cvar FROM returns r JOIN q ON q.run = r.run GROUP BY 1")
def var_cvar(spark, sf_dir):
    return metrics.tail_risk(returns(spark, sf_dir)).select("run", *fixed({"var": 5, "cvar": 5}))


@query(f"""WITH {RETURNS}, l AS (SELECT run, -r AS x FROM returns WHERE r IS NOT NULL), q AS (SELECT run, quantile_cont(x, 0.9) AS u, count(*) AS n FROM l GROUP BY 1), e AS (SELECT l.run, u, n, CASE WHEN x > u THEN x - u END AS e FROM l JOIN q ON l.run = q.run),
a AS (SELECT run, min(u) AS u, min(n) AS n, count(e) AS k, avg(e) AS m, var_samp(e) AS s2 FROM e GROUP BY 1), b AS (SELECT *, 0.5 * (1 - m * m / s2) AS xi, 0.5 * m * (1 + m * m / s2) AS beta FROM a),
c AS (SELECT *, CASE WHEN k >= 5 THEN u + beta / xi * (pow((1 - 0.99) / (k / n), -xi) - 1) END AS evt_var FROM b) SELECT run, k, {sfix('xi', 4)} AS xi, {sfix('beta', 4)} AS beta, {sfix('evt_var', 4)} AS evt_var, {sfix('CASE WHEN xi < 1 THEN (evt_var + beta - xi * u) / (1 - xi) END', 4)} AS evt_cvar FROM c""")
def evt_tail(spark, sf_dir):
    return metrics.extreme_tail(returns(spark, sf_dir).where("r IS NOT NULL")).select("run", "k", *fixed({"xi": 4, "beta": 4, "evt_var": 4, "evt_cvar": 4}))


@query(f"WITH {RETURNS}, t AS (SELECT run AS account, ts, row_number() OVER (PARTITION BY run ORDER BY ts) AS id, sign(r) AS qty, 100 * (1 + r) AS price FROM returns WHERE r IS NOT NULL) SELECT account, {D}, {sfix('sum(-qty * price) OVER w', 3)} AS cash, count(*) OVER w AS trades, {sfix('sum(qty) OVER w', 0)} AS position FROM t WINDOW w AS (PARTITION BY account ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def cash_ledger(spark, sf_dir):
    rows = returns(spark, sf_dir).where("r IS NOT NULL").select(F.col("run").alias("account"), "ts", F.lit(0).alias("id"), F.signum("r").alias("qty"), (100 * (1 + F.col("r"))).alias("price"))
    return metrics.ledger(rows).select("account", day(), fix("cash", 3).alias("cash"), "trades", fix("position", 0).alias("position"))


def _z(x: str) -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY ts)) / (stddev_samp({x}) OVER (PARTITION BY ts) + 1e-12)"


_MOM = f"""{DENSE}, mm AS (SELECT *, lag(close, 21) OVER ({S}) / lag(close, 252) OVER ({S}) - 1 AS m1, lag(close, 21) OVER ({S}) / lag(close, 126) OVER ({S}) - 1 AS m2, close / lag(close) OVER ({S}) - 1 AS r FROM dense),
mo AS (SELECT symbol, ts, close, ({_z('m1')} + {_z('m2')}) / 2 AS score, {srolling('stddev_samp', 'r', 63)} AS sd FROM mm)"""


@query(f"WITH {_MOM} SELECT symbol, {D}, {sfix('score', 4)} AS score FROM mo WHERE score IS NOT NULL")
def momentum_scores(spark, sf_dir):
    return cross.momentum(dense(spark, sf_dir)).where("score IS NOT NULL").select("symbol", day(), *fixed({"score": 4}))


@query(f"WITH {_MOM}, rv AS (SELECT symbol, ts, close / lag(close, 5) OVER ({S}) - 1 AS x FROM dense), r2 AS (SELECT symbol, ts, {_z('x')} AS reversal FROM rv) SELECT mo.symbol, CAST(mo.ts AS VARCHAR) AS d, {sfix('reversal', 4)} AS reversal, {sfix('0.7 * score - 0.3 * reversal', 4)} AS blend FROM mo JOIN r2 ON mo.symbol = r2.symbol AND mo.ts = r2.ts WHERE score IS NOT NULL")
def reversal_blend(spark, sf_dir):
    rows = cross.blend(cross.reversal(cross.momentum(dense(spark, sf_dir))))
    return rows.where("score IS NOT NULL").select("symbol", day(), *fixed({"reversal": 4, "blend": 4}))


@query(f"WITH {DENSE}, a AS (SELECT symbol, ts, close / lag(close, 5) OVER ({S}) - 1 AS x FROM dense) SELECT symbol, {D}, CASE WHEN x IS NOT NULL THEN {sfix('(rank() OVER (PARTITION BY ts ORDER BY x NULLS LAST) + (count(x) OVER (PARTITION BY ts, x) - 1) / 2.0) / count(x) OVER (PARTITION BY ts)')} END AS pct FROM a")
def pct_rank_target(spark, sf_dir):
    rows = dense(spark, sf_dir).withColumn("x", change(F.col("close"), 5))
    return rows.select("symbol", day(), fix(cross.pct_rank(F.col("x"))).alias("pct"))


_SCHED = "sched AS (SELECT max(ts) AS ts FROM (SELECT DISTINCT ts FROM bars) GROUP BY isoyear(ts), weekofyear(ts))"
_CHOSEN = f"""{_MOM}, {_SCHED}, el AS (SELECT mo.* FROM mo JOIN sched USING (ts) WHERE score IS NOT NULL AND close IS NOT NULL AND sd IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS rank FROM el), top AS (SELECT * FROM rk WHERE rank <= 5)"""
#: Twenty rounds of capping as steps of a recursion over all dates at once.
_CAPPED = """w0 AS (SELECT ts, symbol, (1 / (sd + 1e-12)) / sum(1 / (sd + 1e-12)) OVER (PARTITION BY ts) AS w FROM top),
cp AS (SELECT 0 AS it, ts, symbol, w FROM w0 UNION ALL
SELECT it + 1, ts, symbol, CASE WHEN ex > 0 THEN CASE WHEN w > 0.3 THEN 0.3 WHEN room > 0 THEN w + ex * w / room ELSE w END ELSE w END FROM (SELECT *, sum(greatest(w - 0.3, 0)) OVER (PARTITION BY ts) AS ex, sum(CASE WHEN w > 0.3 THEN 0 ELSE w END) OVER (PARTITION BY ts) AS room FROM cp WHERE it < 20))"""


@query(f"WITH {_CHOSEN} SELECT {D}, symbol, rank FROM top")
def topk_select(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return cross.top_k(rows, 5).select(day(), "symbol", F.col("rank").cast("long").alias("rank"))


def _scored(spark, sf_dir) -> DataFrame:
    """Scores and volatilities of names with a price on the weekly schedule."""
    panel = dense(spark, sf_dir)
    rows = cross.momentum(panel.withColumn("__r", change(F.col("close")))).withColumn("sd", rolling(F.stddev_samp, F.col("__r"), 63))
    schedule = clean.weekly_schedule(panel.select("ts").distinct())
    return rows.join(F.broadcast(schedule.select("ts")), "ts", "left_semi").where("close IS NOT NULL AND sd IS NOT NULL").drop("__r")  # dates alone


@query(f"WITH RECURSIVE {_CHOSEN}, {_CAPPED} SELECT {D}, symbol, {sfix('w')} AS weight FROM cp WHERE it = 20")
def inverse_vol_weights(spark, sf_dir):
    return cross.inverse_vol(cross.top_k(_scored(spark, sf_dir), 5), "sd", 0.3).select(day(), "symbol", *fixed({"weight": 5}))


@query(f"WITH {BENCH}, a AS (SELECT ts, bench, {srolling('avg', 'bench', 200, 'ORDER BY ts')} AS ma FROM bench) SELECT {D}, CASE WHEN ma IS NULL OR bench >= ma THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS gate FROM a")
def regime_gate(spark, sf_dir):
    return cross.regime_gate(panels.bench_daily(spark, sf_dir)).select(day(), "gate")


@query(f"WITH {RETURNS}, a AS (SELECT *, greatest({srolling('stddev_samp', 'r', 21, 'PARTITION BY run ORDER BY ts')}, {srolling('stddev_samp', 'r', 63, 'PARTITION BY run ORDER BY ts')}) * sqrt(252) AS e FROM returns) SELECT run, {D}, {sfix('CASE WHEN e > 0 THEN least(greatest(3.0 / e, 0.2), 1.0) ELSE 1.0 END')} AS exposure FROM a")
def vol_target(spark, sf_dir):
    return cross.vol_target(returns(spark, sf_dir), 3.0).select("run", day(), *fixed({"exposure": 5}))


_WALK = f"""{_CHOSEN}, {_CAPPED}, {BENCH}, gt AS (SELECT ts, CASE WHEN ma IS NULL OR bench >= ma THEN 1.0 ELSE 0.5 END AS gate FROM (SELECT ts, bench, {srolling('avg', 'bench', 200, 'ORDER BY ts')} AS ma FROM bench)),
wt AS (SELECT cp.ts, symbol, w * gate AS weight FROM cp JOIN gt ON gt.ts = cp.ts WHERE it = 20),
dec AS (SELECT ts AS decided, lead(ts) OVER (ORDER BY ts) AS until FROM (SELECT DISTINCT ts FROM wt)),
hd AS (SELECT c.ts, d.decided, d.until, wt.symbol, wt.weight, mm.close, mm.r AS ret FROM (SELECT DISTINCT ts FROM dense) c JOIN dec d ON c.ts > d.decided AND (d.until IS NULL OR c.ts <= d.until) JOIN wt ON wt.ts = d.decided LEFT JOIN mm ON mm.ts = c.ts AND mm.symbol = wt.symbol),
lv AS (SELECT *, min(CASE WHEN close IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY decided, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS live FROM hd),
dy AS (SELECT ts, sum(weight * live * coalesce(ret, 0)) AS gross, sum(weight * live) AS exposure FROM lv GROUP BY 1),
lf AS (SELECT ts, symbol, weight * live AS was FROM lv WHERE ts = until),
tn AS (SELECT coalesce(wt.ts, lf.ts) AS ts, sum(abs(coalesce(weight, 0) - coalesce(was, 0))) AS turnover FROM wt FULL JOIN lf ON wt.ts = lf.ts AND wt.symbol = lf.symbol GROUP BY 1),
walk AS (SELECT coalesce(dy.ts, tn.ts) AS ts, coalesce(gross, 0) - coalesce(turnover, 0) * 0.001 AS r, coalesce(turnover, 0) AS turnover, coalesce(exposure, 0) AS exposure FROM dy FULL JOIN tn ON dy.ts = tn.ts)"""


def walk(spark, sf_dir, k: int = 5) -> DataFrame:
    panel = dense(spark, sf_dir)
    schedule = clean.weekly_schedule(panel.select("ts").distinct())
    weights = backtest.momentum_weights(panel, schedule, panels.bench_daily(spark, sf_dir), k=k)
    return backtest.portfolio(panel, weights)


@query(f"WITH RECURSIVE {_WALK} SELECT {D}, {sfixed({'r': 4, 'turnover': 4, 'exposure': 4})} FROM walk")
def walkforward_weekly(spark, sf_dir):
    """Weekly momentum portfolio with inverse volatility, caps, a regime gate, liquidation and costs."""
    return walk(spark, sf_dir).select(day(), *fixed({"r": 4, "turnover": 4, "exposure": 4}))


@query(f"WITH RECURSIVE {_WALK} SELECT {sfix('avg(CASE WHEN turnover > 0 THEN turnover END) * 52', 4)} AS turnover, {sfix('avg(exposure)', 4)} AS exposure FROM walk")
def walkforward_turnover(spark, sf_dir):
    return backtest.yearly_turnover(walk(spark, sf_dir)).select(*fixed({"turnover": 4, "exposure": 4}))


@query("WITH d AS (SELECT DISTINCT c_mktsegment AS run, date_trunc('week', o_orderdate) AS ts FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT run, count(*) AS n FROM d GROUP BY 1), f AS (SELECT run, n, unnest(range(109, n, 26)) AS test_start FROM n) SELECT run, CAST((test_start - 109) / 26 AS BIGINT) AS fold, CAST(0 AS BIGINT) AS slice_start, test_start - 5 AS train_end, test_start, least(test_start + 26, n) AS test_end FROM f WHERE least(test_start + 26, n) - test_start >= 5")
def walkforward_folds(spark, sf_dir):
    rows = backtest.fold_table(returns(spark, sf_dir), 104, 26)
    return rows.select("run", *(F.col(c).cast("long").alias(c) for c in ("fold", "slice_start", "train_end", "test_start", "test_end")))


_BOOK = "book AS (SELECT p_brand AS symbol, sum(p_retailprice) AS notional FROM part WHERE p_brand < 'Brand#2' GROUP BY 1)"
_TARGET = "target AS (SELECT symbol, v / sum(v) OVER () AS weight FROM (SELECT p_brand AS symbol, CAST(count(*) AS DOUBLE) AS v FROM part WHERE p_size <= 10 AND p_brand > 'Brand#12' GROUP BY 1))"


def account(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A book (symbol, notional) and targets (symbol, weight) made of the parts."""
    part = panels.table(spark, sf_dir, "part")
    book = part.where("p_brand < 'Brand#2'").groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("p_retailprice").alias("notional"))
    n = part.where("p_size <= 10 AND p_brand > 'Brand#12'").groupBy(F.col("p_brand").alias("symbol")).agg(F.count(F.lit(1)).alias("v"))
    return book, n.select("symbol", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("weight"))


@query(f"WITH {_BOOK}, {_TARGET}, c AS (SELECT symbol, notional / 1000000 AS c FROM book), j AS (SELECT coalesce(t.symbol, c.symbol) AS symbol, coalesce(weight, 0) AS t, coalesce(c, 0) AS c FROM target t FULL JOIN c ON c.symbol = t.symbol), w AS (SELECT symbol, CASE WHEN abs(t - c) < 0.03 THEN c ELSE t END AS weight FROM j) SELECT symbol, {sfix('weight')} AS weight FROM w WHERE weight > 0")
def no_trade_band(spark, sf_dir):
    book, target = account(spark, sf_dir)
    current = book.select("symbol", (F.col("notional") / 1_000_000).alias("weight"))
    return cross.no_trade_band(target, current, 0.03).select("symbol", *fixed({"weight": 5}))


@query(f"""WITH {_BOOK}, {_TARGET}, j AS (SELECT coalesce(t.symbol, b.symbol) AS symbol, 2000000.0 * coalesce(weight, 0) AS t, coalesce(notional, 0) AS now FROM target t FULL JOIN book b ON b.symbol = t.symbol), o AS (SELECT *, t - now AS delta FROM j WHERE abs(t - now) >= greatest(1.0, 10000.0))
SELECT row_number() OVER (ORDER BY delta > 0, abs(delta) DESC, symbol) AS seq, symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN NOT (t < 1 AND now > 0) THEN {sfix('abs(delta)', 1)} END AS notional, t < 1 AND now > 0 AS close_all FROM o""")
def order_list(spark, sf_dir):
    book, target = account(spark, sf_dir)
    rows = orders.build_orders(target, book, F.lit(2_000_000.0))
    return rows.select(F.col("seq").cast("long").alias("seq"), "symbol", "side", fix("notional", 1).alias("notional"), "close_all")


def sleeve_table(spark, sf_dir) -> DataFrame:
    """Sleeves by part type: the first holds the rest, the others the brands of their type's largest parts."""
    part = panels.table(spark, sf_dir, "part")
    types = part.where("p_size = 50").groupBy(F.col("p_type").alias("sleeve")).agg(F.sort_array(F.collect_set("p_brand")).alias("universe"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    first = F.row_number().over(Window.orderBy("sleeve"))  # six rows
    return types.select("sleeve", (1 / n).alias("allocation"), (first == 1).alias("residual"), "universe", F.lit(2).alias("top_k"), F.lit(0.6).alias("cap"))


_SLEEVES = "sl AS (SELECT p_type AS sleeve, list_sort(list(DISTINCT p_brand)) AS universe, row_number() OVER (ORDER BY p_type) = 1 AS residual FROM part WHERE p_size = 50 GROUP BY 1), own AS (SELECT sleeve, unnest(universe) AS symbol FROM sl WHERE NOT residual)"


@query(f"WITH {_BOOK}, {_SLEEVES} SELECT symbol, {sfix('notional', 1)} AS notional FROM book WHERE symbol NOT IN (SELECT symbol FROM own)")
def orphan_positions(spark, sf_dir):
    return orders.orphans(account(spark, sf_dir)[0], sleeve_table(spark, sf_dir)).select("symbol", *fixed({"notional": 1}))


@query(f"WITH {_SLEEVES}, dup AS (SELECT symbol FROM (SELECT DISTINCT sleeve, symbol FROM own) GROUP BY 1 HAVING count(*) > 1) SELECT 'universe' AS fault, symbol AS detail FROM dup")
def sleeve_validation(spark, sf_dir):
    return orders.sleeve_faults(sleeve_table(spark, sf_dir))


@query(f"WITH {_SLEEVES}, {_TARGET}, t AS (SELECT sl.sleeve, target.symbol, weight FROM target, sl) SELECT symbol, {sfix('sum(weight * (1.0 / (SELECT count(*) FROM sl)))')} AS weight FROM t GROUP BY 1")
def net_targets(spark, sf_dir):
    sleeves = sleeve_table(spark, sf_dir)
    targets = account(spark, sf_dir)[1].crossJoin(F.broadcast(sleeves.select("sleeve")))  # six rows
    return orders.net_targets(targets, sleeves).select("symbol", *fixed({"weight": 5}))


@query("WITH f AS (SELECT DISTINCT upper(replace(p_brand, '.', '-')) AS ticker FROM part), o AS (SELECT DISTINCT upper(p_brand) AS ticker FROM part WHERE p_size > 1) SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f WHERE NOT regexp_matches(ticker, '^[A-Z][A-Z0-9#.\\-]{0,9}$')) AS bad, " + sfix("(SELECT count(*) FROM f JOIN o USING (ticker)) / (SELECT count(*) FROM (SELECT * FROM f UNION SELECT * FROM o))") + " AS jaccard, (SELECT count(*) FROM f) BETWEEN 20 AND 30 AS valid")
def universe_validation(spark, sf_dir):
    part = panels.table(spark, sf_dir, "part")
    fresh = part.select(F.upper(F.regexp_replace("p_brand", r"\.", "-")).alias("ticker")).distinct()
    last = part.where("p_size > 1").select(F.upper("p_brand").alias("ticker")).distinct()
    return orders.universe_check(fresh, last, 20, 30).select("n", "bad", fix("jaccard").alias("jaccard"), "valid")


_MIX = "CASE run WHEN 'BUILDING' THEN 0.6 WHEN 'MACHINERY' THEN 0.4 END"


def _shares():
    return F.create_map(F.lit("BUILDING"), F.lit(0.6), F.lit("MACHINERY"), F.lit(0.4))


@query(f"WITH {RETURNS} SELECT {D}, {sfix(f'sum({_MIX} * r)')} AS r FROM returns WHERE r IS NOT NULL AND {_MIX} IS NOT NULL GROUP BY ts")
def blend_daily(spark, sf_dir):
    return backtest.blend_daily(returns(spark, sf_dir).where("r IS NOT NULL"), _shares()).select(day(), *fixed({"r": 5}))


_DAILY2 = "day2 AS (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2)"


@query(f"""WITH {_DAILY2}, re AS (SELECT symbol AS run, ts, 0.01 * ln(close / lag(close) OVER ({S})) AS r FROM day2), b AS (SELECT *, {_MIX} AS w, isoyear(ts) * 100 + weekofyear(ts) AS wk FROM re WHERE r IS NOT NULL),
v AS (SELECT wk, ts, w * product(1 + r) OVER (PARTITION BY run, wk ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v, w FROM b), s AS (SELECT wk, ts, sum(v) AS v, sum(w) AS w FROM v GROUP BY 1, 2) SELECT {D}, {sfix('v / coalesce(lag(v) OVER (PARTITION BY wk ORDER BY ts), w) - 1', 6)} AS r FROM s""")
def blend_weekly(spark, sf_dir):
    o, c = panels.table(spark, sf_dir, "orders"), panels.table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    bars = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("close"))
    rows = bars.select(F.col("symbol").alias("run"), "ts", (0.01 * I.log_return()).alias("r")).where("r IS NOT NULL")
    return backtest.blend_weekly(rows, _shares()).select(day(), *fixed({"r": 6}))


@query(f"WITH {RETURNS}, g AS (SELECT unnest(range(11)) / 10.0 AS w), b AS (SELECT w AS run, ts, sum(CASE run WHEN 'BUILDING' THEN w ELSE 1 - w END * r) AS r FROM returns, g WHERE run IN ('BUILDING', 'MACHINERY') AND r IS NOT NULL GROUP BY 1, 2), {_PERF_SQL.format('b', '52.0')} SELECT CAST(round(run * 10) AS BIGINT) AS tenth, {sfixed({'sharpe': 5, 'max_dd': 5, 'vol': 5})} FROM pf")
def split_sweep(spark, sf_dir):
    grid = spark.range(11).select(F.col("id").alias("tenth"))
    two = returns(spark, sf_dir).where("r IS NOT NULL AND run IN ('BUILDING', 'MACHINERY')")
    w = F.when(F.col("run") == "BUILDING", F.col("tenth") / 10).otherwise(1 - F.col("tenth") / 10)
    rows = two.crossJoin(F.broadcast(grid)).groupBy("tenth", "ts").agg(F.sum(w * F.col("r")).alias("r"))  # eleven rows
    return metrics.performance(rows.withColumnRenamed("tenth", "run"), 52).select(F.col("run").alias("tenth"), *fixed({"sharpe": 5, "max_dd": 5, "vol": 5}))


_SPANS = (5, 10, 15, 20, 30, 40)


@query(f"""WITH {WEEKLY}, g AS (SELECT unnest([5, 10, 15, 20, 30, 40]) AS n), rn AS (SELECT *, row_number() OVER ({S}) AS k, close / lag(close) OVER ({S}) - 1 AS ret FROM weekly),
m AS (SELECT g.n, a.symbol, a.ts, a.close, a.ret, avg(b.close) AS ma, count(*) AS c FROM rn a CROSS JOIN g JOIN rn b ON b.symbol = a.symbol AND b.k BETWEEN a.k - g.n + 1 AND a.k GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT *, CASE WHEN c = n AND close > ma THEN 1 ELSE 0 END AS position FROM m), q AS (SELECT n, symbol, ts, lag(position) OVER (PARTITION BY n, symbol ORDER BY ts) * ret AS r FROM p),
s AS (SELECT n, symbol, avg(r) / stddev_samp(r) AS sharpe FROM q GROUP BY 1, 2) SELECT CAST(n AS BIGINT) AS param, {sfix('quantile_cont(sharpe, 0.5)')} AS median, {sfix('quantile_cont(sharpe, 0.1)')} AS p10, {sfix('min(sharpe)')} AS least, {sfix('max(sharpe)')} AS most, {sfix('avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END)')} AS beats FROM s GROUP BY ROLLUP (n)""")
def param_sweep(spark, sf_dir):
    """One job over all spans: each is a run, not a loop of jobs."""
    bars = panels.bars_weekly(spark, sf_dir).withColumn("ret", change(F.col("close")))
    position = {n: (rolling(F.avg, F.col("close"), n) < F.col("close")).cast("int") for n in _SPANS}
    rows = bars.withColumn("p", F.array(*(F.struct(F.lit(n).alias("n"), F.coalesce(p, F.lit(0)).alias("position")) for n, p in position.items()))).select("symbol", "ts", "ret", F.inline("p"))
    before = F.lag("position").over(Window.partitionBy("n", "symbol").orderBy("ts"))
    runs = rows.select("n", "symbol", (before * F.col("ret")).alias("r")).groupBy("n", "symbol").agg((F.avg("r") / F.stddev_samp("r")).alias("sharpe"))
    out = metrics.sweep_summary(runs.withColumnsRenamed({"n": "param", "symbol": "run"}), "sharpe", 0.0)
    return out.select(F.col("param").cast("long").alias("param"), *fixed({"median": 5, "p10": 5, "least": 5, "most": 5, "beats": 5}))


@query(f"WITH {DENSE}, {BENCH}, tu AS (SELECT symbol, ts, abs(close / lag(close) OVER ({S}) - 1) AS x FROM dense), dy AS (SELECT ts, max(x) AS x FROM tu WHERE x IS NOT NULL GROUP BY 1), q AS (SELECT quantile_cont(x, 0.9) AS l FROM dy) SELECT {D}, {sfix('x', 4)} AS x, x > l AS halt FROM dy, q")
def turbulence_gate(spark, sf_dir):
    rows = dense(spark, sf_dir).select("symbol", "ts", F.abs(change(F.col("close"))).alias("x")).where("x IS NOT NULL")
    return cross.turbulence_gate(rows).select(day(), fix("x", 4).alias("x"), "halt")


def _machine(rows: str, value: str, threshold: float, horizon: int) -> str:
    """CTE hm (symbol, rn, ts, lft, pos): the minimum-holding-period machine over rows (symbol, rn, ts) one after the other."""
    v = f"coalesce(x.{value}, 0)"
    return f"""hm AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS ts, 0 AS lft, 0 AS pos FROM {rows} UNION ALL
SELECT x.symbol, x.rn, x.ts, CASE WHEN m.lft > 0 THEN m.lft - 1 + CAST({v} >= {threshold} AS INT) WHEN m.pos = 0 AND {v} > {threshold} THEN {horizon - 1} ELSE 0 END,
CASE WHEN m.lft > 0 THEN m.pos WHEN m.pos = 0 AND {v} > {threshold} THEN 1 WHEN m.pos = 1 AND {v} <= 0 THEN 0 ELSE m.pos END FROM hm m JOIN {rows} x ON x.symbol = m.symbol AND x.rn = m.rn + 1)"""


@query(f"WITH RECURSIVE {BARS}, xs AS (SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, ln(close / lag(close) OVER ({S})) AS x, row_number() OVER ({S}) AS rn FROM bars), {_machine('xs', 'x', 0.02, 10)} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(pos AS INT) AS position FROM hm WHERE rn > 0")
def hold_period_positions(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumn("x", I.log_return())
    return rules.holding_period(rows, "x", 0.02, 10).select("symbol", day(), "position")


def pair_zscores(spark, sf_dir, n: int = 26) -> DataFrame:
    p = clean.pairs(panels.bars_weekly(spark, sf_dir).select("symbol", "ts", F.ln("close").alias("y")), ["y"]).withColumn("s", F.col("y_1") - F.col("y_2"))
    by = Window.partitionBy("symbol_1", "symbol_2").orderBy("ts")
    return p.withColumn("z", ratio(F.col("s") - rolling(F.avg, F.col("s"), n, by), rolling(F.stddev_samp, F.col("s"), n, by)))


_PAIRS = "PARTITION BY symbol_1, symbol_2 ORDER BY ts"
_SPREAD = f"pr AS (SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, a.ts, ln(a.close) - ln(b.close) AS s FROM weekly a JOIN weekly b ON a.ts = b.ts AND a.symbol < b.symbol), zs AS (SELECT symbol_1, symbol_2, ts, (s - ({srolling('avg', 's', 26, _PAIRS)})) / ({srolling('stddev_samp', 's', 26, _PAIRS)}) AS z, row_number() OVER ({_PAIRS}) AS rn FROM pr)"


@query(f"""WITH RECURSIVE {WEEKLY}, {_SPREAD}, st AS (SELECT DISTINCT symbol_1, symbol_2, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS ts, 0 AS state FROM zs UNION ALL
SELECT z.symbol_1, z.symbol_2, z.rn, z.ts, CASE WHEN z.z IS NULL THEN st.state WHEN st.state = 0 THEN CASE WHEN z.z > 2 THEN -1 WHEN z.z < -2 THEN 1 ELSE 0 END WHEN (st.state = 1 AND z.z > -0.5) OR (st.state = -1 AND z.z < 0.5) THEN 0 ELSE st.state END FROM st JOIN zs z ON z.symbol_1 = st.symbol_1 AND z.symbol_2 = st.symbol_2 AND z.rn = st.rn + 1),
lg AS (SELECT symbol_1 AS symbol, ts, state FROM st WHERE rn > 0 UNION ALL SELECT symbol_2, ts, -state FROM st WHERE rn > 0) SELECT symbol, {D}, CAST(greatest(-1, least(1, sum(state))) AS INT) AS position FROM lg GROUP BY symbol, ts""")
def pair_positions(spark, sf_dir):
    return rules.pair_legs(rules.pair_positions(pair_zscores(spark, sf_dir))).select("symbol", day(), "position")


@query()
def turbulence_nd(spark, sf_dir):
    panel = panels.bars_weekly(spark, sf_dir)
    return cross.mahalanobis(panel, panel.select("ts").distinct(), 52).select(day(), "turbulence")


@query(f"""WITH w AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, sum(l_extendedprice) / sum(l_quantity) AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1),
r AS (SELECT ts, a / lag(a) OVER (ORDER BY ts) - 1 AS x, b / lag(b) OVER (ORDER BY ts) - 1 AS y, row_number() OVER (ORDER BY ts) AS n FROM w),
s AS (SELECT ts, n, x - avg(x) OVER p AS dx, y - avg(y) OVER p AS dy, count(x) OVER p AS k, var_samp(x) OVER p AS vx, var_samp(y) OVER p AS vy, covar_samp(x, y) OVER p AS c
FROM r WINDOW p AS (ORDER BY ts ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
SELECT {D}, {sfix('CASE WHEN k = 52 THEN (dx * dx * vy - 2 * c * dx * dy + dy * dy * vx) / (vx * vy - c * c) END', 3)} AS turbulence FROM s WHERE n > 52""")
def turbulence_price_volume(spark, sf_dir):
    """How unusual a week's price and volume of the whole market are together, beside the year before."""
    week = panels.table(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("ts"))
    week = week.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"))
    panel = week.unpivot("ts", ["price", "volume"], "symbol", "close")
    return cross.mahalanobis(panel, panel.select("ts").distinct(), 52).select(day(), fix("turbulence", 3).alias("turbulence"))
