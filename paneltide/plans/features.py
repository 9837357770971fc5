"""Queries over daily bars: scans, cleaning and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.ema import ema, ema_adjusted
from ..functions.windows import by_symbol, change, lag, ratio, rolling
from ..operators import clean, metrics
from ..sources import panels
from ..sources.store import stored
from .oracle import BARS, BENCH, DENSE, S, WEEKLY, day, fix, fixed, query, sema, sfix, sfixed, srolling

D = "CAST(ts AS VARCHAR) AS d"
_OHLCV = {"open": 3, "high": 3, "low": 3, "close": 3, "volume": 2}


def dense(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """The daily closes on all dates, filled; the bars are stored, as their dates and symbols make the grid, and portfolios read it several times."""
    bars = stored(panels.closes_daily(spark, sf_dir), "bars")
    return clean.densify(bars).withColumn("close", clean.ffill(F.col("close"), limit))


@query(f"WITH {BARS} SELECT symbol, {D}, {sfixed(_OHLCV)} FROM bars")
def bars_daily(spark, sf_dir):
    return panels.bars_daily(spark, sf_dir).select("symbol", day(), *fixed(_OHLCV))


@query(f"WITH {WEEKLY} SELECT symbol, {D}, {sfix('close', 3)} AS close FROM weekly")
def bars_weekly(spark, sf_dir):
    return panels.bars_weekly(spark, sf_dir).select("symbol", day(), *fixed({"close": 3}))


@query(f"WITH {BENCH} SELECT {D}, {sfix('bench', 3)} AS bench FROM bench")
def bench_daily(spark, sf_dir):
    return panels.bench_daily(spark, sf_dir).select(day(), *fixed({"bench": 3}))


@query("SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS VARCHAR) AS d, first(value ORDER BY ts, event_id, value) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id, value) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2")
def bars_hourly(spark, sf_dir):
    ticks = panels.table(spark, sf_dir, "events").withColumn("time", F.col("ts"))
    return panels.to_bars(ticks, F.col("event_type"), F.date_trunc("hour", "time"), F.col("value"), F.lit(1.0), ["time", "event_id"]).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("d"), *_OHLCV)


@query(f"WITH {DENSE} SELECT symbol, {D}, {sfix('close', 3)} AS close FROM dense")
def panel_dense_ffill5(spark, sf_dir):
    return dense(spark, sf_dir).select("symbol", day(), *fixed({"close": 3}))


@query(f"WITH {DENSE}, f AS (SELECT symbol, ts, coalesce(last_value(raw IGNORE NULLS) OVER ({S} ROWS UNBOUNDED PRECEDING), first_value(raw IGNORE NULLS) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM grid) SELECT symbol, {D}, {sfix('close', 3)} AS close FROM f")
def panel_fill_both_ways(spark, sf_dir):
    panel = clean.densify(panels.bars_daily(spark, sf_dir).select("symbol", "ts", "close"))
    return panel.withColumn("close", F.coalesce(clean.ffill(F.col("close")), clean.bfill(F.col("close")))).select("symbol", day(), *fixed({"close": 3}))


#: Bars of which some symbols end before the others, on all dates.
_ENDING = BARS.replace("bars AS (", "bars0 AS (", 1) + ", bars AS (SELECT * FROM bars0 WHERE NOT (symbol LIKE 'Brand#1%' AND ts > DATE '1999-12-31'))" + DENSE.removeprefix(BARS)


@query(f"WITH {_ENDING} SELECT symbol FROM dense WHERE ts = (SELECT max(ts) FROM dense) AND close IS NULL")
def dead_names(spark, sf_dir):
    """Names without a price on the last date; some end two years before the others."""
    bars = panels.bars_daily(spark, sf_dir).select("symbol", "ts", "close").where("NOT (symbol LIKE 'Brand#1%' AND ts > DATE '1999-12-31')")
    panel = clean.densify(stored(bars, "bars")).withColumn("close", clean.ffill(F.col("close"), 5))
    return panel.select("symbol").distinct().join(clean.alive(panel), "symbol", "left_anti")


@query(f"WITH {BARS} SELECT symbol, count(close) AS n FROM bars GROUP BY 1 HAVING count(close) > 300")
def min_history(spark, sf_dir):
    return clean.enough_history(panels.bars_daily(spark, sf_dir), 300).groupBy("symbol").agg(F.count("close").alias("n"))


@query("WITH a AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), b AS (SELECT l.* FROM lineitem l, a WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)), c AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM b), e AS (SELECT b.* FROM b, c WHERE l_quantity BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)) SELECT l_returnflag, count(*) AS n, " + sfix("sum(l_extendedprice)", 0) + " AS total FROM e GROUP BY 1")
def iqr_filter(spark, sf_dir):
    rows = clean.iqr_filter(panels.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], 0.4)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), fix(F.sum("l_extendedprice"), 0).alias("total"))


@query(f"WITH {BARS}, n AS (SELECT *, row_number() OVER ({S}) AS rn, count(*) OVER (PARTITION BY symbol) AS c FROM bars) SELECT symbol, CAST(CASE WHEN rn > floor(c * CAST(0.7 AS DOUBLE)) THEN 1 ELSE 0 END AS BIGINT) AS test_mask, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first_ts FROM n GROUP BY 1, 2")
def train_test_split(spark, sf_dir):
    return clean.split(panels.bars_daily(spark, sf_dir), 0.7).groupBy("symbol", F.col("test_mask").cast("long").alias("test_mask")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("string").alias("first_ts"))


@query(f"WITH {BENCH} SELECT CAST(max(ts) AS VARCHAR) AS d FROM bench GROUP BY isoyear(ts), weekofyear(ts)")
def weekly_schedule(spark, sf_dir):
    return clean.weekly_schedule(panels.bench_daily(spark, sf_dir)).select(day())


@query(f"WITH {BENCH}, w AS (SELECT day, max(ts) AS ts FROM bench, (SELECT unnest(range(5)) AS day) WHERE isodow(ts) - 1 <= day GROUP BY day, isoyear(ts), weekofyear(ts)) SELECT CAST(day AS BIGINT) AS weekday, {D} FROM w")
def weekday_schedules(spark, sf_dir):
    dates = panels.bench_daily(spark, sf_dir).select("ts")
    from functools import reduce

    return reduce(DataFrame.unionByName, [clean.weekly_schedule(dates, k).select(F.lit(k).cast("long").alias("weekday"), day()) for k in range(5)])


@query(f"WITH {BARS}, a AS (SELECT symbol, max(ts) AS t FROM bars GROUP BY 1) SELECT symbol, CAST(t AS VARCHAR) AS last_d, date_diff('day', t, DATE '2001-12-31') AS age, date_diff('day', t, DATE '2001-12-31') > 4 AS stale FROM a")
def stale_symbols(spark, sf_dir):
    rows = clean.staleness(panels.bars_daily(spark, sf_dir), F.lit("2001-12-31").cast("date"))
    return rows.select("symbol", F.col("last_ts").cast("string").alias("last_d"), F.col("age").cast("long").alias("age"), "stale")


_SMA = {"sma10": 3, "sma20": 3, "mid": 3, "upper": 3, "lower": 3, "cv": 6}


@query(f"WITH {BARS}, a AS (SELECT *, {srolling('avg', 'close', 10)} AS sma10, {srolling('avg', 'close', 20)} AS sma20, {srolling('stddev_samp', 'close', 20)} AS sd FROM bars), b AS (SELECT *, sma20 AS mid, sma20 + 2 * sd AS upper, sma20 - 2 * sd AS lower, sd / sma20 AS cv FROM a) SELECT symbol, {D}, {sfixed(_SMA)} FROM b")
def sma_bollinger(spark, sf_dir):
    b = I.bollinger()
    rows = panels.bars_daily(spark, sf_dir).withColumns({"sma10": I.sma(F.col("close"), 10), "sma20": I.sma(F.col("close"), 20), **b, "cv": ratio(I.rolling_std(F.col("close"), 20), I.sma(F.col("close"), 20))})
    return rows.select("symbol", day(), *fixed(_SMA))


@query(f"WITH RECURSIVE {BARS}, {sema('bars', 'close', '(2.0 / 13)', 'e12')}, {sema('bars', 'close', '(2.0 / 201)', 'e200')} SELECT a.symbol, CAST(a.ts AS VARCHAR) AS d, {sfix('e12', 2)} AS e12, {sfix('e200', 2)} AS e200 FROM e12_r a JOIN e200_r b ON a.symbol = b.symbol AND a.ts = b.ts")
def ema_spans(spark, sf_dir):
    rows = ema(ema(panels.bars_daily(spark, sf_dir), "e12", F.col("close"), span=12), "e200", F.col("close"), span=200)
    return rows.select("symbol", day(), *fixed({"e12": 2, "e200": 2}))


@query(f"WITH RECURSIVE {WEEKLY}, n AS (SELECT *, row_number() OVER ({S}) AS rn FROM weekly), r AS (SELECT symbol, ts, rn, close AS num, CAST(1 AS DOUBLE) AS den FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.ts, n.rn, r.num * (1 - 2.0 / 11) + n.close, r.den * (1 - 2.0 / 11) + 1 FROM r JOIN n ON n.symbol = r.symbol AND n.rn = r.rn + 1) SELECT symbol, {D}, {sfix('num / den', 2)} AS e FROM r")
def ema_adjusted_weekly(spark, sf_dir):
    return ema_adjusted(panels.bars_weekly(spark, sf_dir), "e", F.col("close"), span=10).select("symbol", day(), *fixed({"e": 2}))


@query(f"""WITH {BARS}, a AS (SELECT *, close - lag(close) OVER ({S}) AS x FROM bars), b AS (SELECT *, greatest(x, 0) AS u0, greatest(-x, 0) AS d0 FROM a),
c AS (SELECT *, CASE WHEN x IS NOT NULL THEN u0 END AS u1, CASE WHEN x IS NOT NULL THEN d0 END AS d1 FROM b),
e AS (SELECT *, {srolling('avg', 'u1', 14)} AS u, {srolling('avg', 'd1', 14)} AS dn FROM c) SELECT symbol, {D}, {sfix('CASE WHEN dn = 0 THEN CASE WHEN u > 0 THEN 100 END ELSE 100 - 100 / (1 + u / dn) END', 4)} AS rsi FROM e""")
def rsi(spark, sf_dir):
    bars = panels.bars_daily(spark, sf_dir).withColumn("__d", F.col("close") - lag(F.col("close")))
    bars = bars.withColumns({"__u": F.when(F.col("__d").isNotNull(), F.greatest("__d", F.lit(0.0))), "__w": F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), F.lit(0.0)))})
    up, down = I.sma(F.col("__u"), 14), I.sma(F.col("__w"), 14)
    value = F.when(down == 0, F.when(up > 0, 100.0)).otherwise(100 - 100 / (1 + ratio(up, down)))
    return bars.withColumn("rsi", value).select("symbol", day(), *fixed({"rsi": 4}))


@query(f"WITH {BARS}, a AS (SELECT *, lag(close) OVER ({S}) AS p FROM bars), b AS (SELECT *, CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM a), c AS (SELECT *, {srolling('avg', 'tr', 14)} AS atr FROM b) SELECT symbol, {D}, {sfix('atr', 3)} AS atr FROM c")
def atr(spark, sf_dir):
    bars = panels.bars_daily(spark, sf_dir).withColumn("tr", I.true_range())
    return bars.withColumn("atr", rolling(F.avg, F.col("tr"), 14)).select("symbol", day(), *fixed({"atr": 3}))


_ADX = {"plus_di": 3, "minus_di": 3, "adx": 3}


@query(f"""WITH RECURSIVE {BARS}, a AS (SELECT *, lag(close) OVER ({S}) AS p, high - lag(high) OVER ({S}) AS up, lag(low) OVER ({S}) - low AS dn FROM bars),
b AS (SELECT symbol, ts, CASE WHEN p IS NULL THEN high - low ELSE greatest(high - low, abs(high - p), abs(low - p)) END AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pd, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS md FROM a),
n AS (SELECT *, row_number() OVER ({S}) AS rn FROM b),
r AS (SELECT symbol, ts, rn, tr AS t, CAST(pd AS DOUBLE) AS pl, CAST(md AS DOUBLE) AS mi FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.ts, n.rn, t * 13 / 14 + n.tr / 14, pl * 13 / 14 + n.pd / 14, mi * 13 / 14 + n.md / 14 FROM r JOIN n ON n.symbol = r.symbol AND n.rn = r.rn + 1),
x AS (SELECT symbol, ts, rn, CASE WHEN t <> 0 THEN 100 * pl / t END AS plus_di, CASE WHEN t <> 0 THEN 100 * mi / t END AS minus_di FROM r),
y AS (SELECT *, coalesce(CASE WHEN plus_di + minus_di <> 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END, 0) AS dx FROM x),
z AS (SELECT symbol, ts, rn, plus_di, minus_di, dx AS adx FROM y WHERE rn = 1 UNION ALL SELECT y.symbol, y.ts, y.rn, y.plus_di, y.minus_di, z.adx * 13 / 14 + y.dx / 14 FROM z JOIN y ON y.symbol = z.symbol AND y.rn = z.rn + 1)
SELECT symbol, {D}, {sfixed(_ADX)} FROM z""")
def adx(spark, sf_dir):
    return I.adx(panels.bars_daily(spark, sf_dir)).select("symbol", day(), *fixed(_ADX))


_MACD = {"macd": 2, "macd_signal": 2, "macd_hist": 2, "hist_change": 2}
_MACD_SQL = f"""{sema('bars', 'close', '(2.0 / 13)', 'fa')}, {sema('bars', 'close', '(2.0 / 27)', 'sl')},
m AS (SELECT a.symbol, a.ts, fa - sl AS macd FROM fa_r a JOIN sl_r b ON a.symbol = b.symbol AND a.ts = b.ts), {sema('m', 'macd', '(2.0 / 10)', 'sg')},
h AS (SELECT m.symbol, m.ts, macd, sg AS macd_signal, macd - sg AS macd_hist FROM m JOIN sg_r g ON m.symbol = g.symbol AND m.ts = g.ts),
mc AS (SELECT *, macd_hist - lag(macd_hist, 3) OVER ({S}) AS hist_change FROM h)"""


@query(f"WITH RECURSIVE {BARS}, {_MACD_SQL} SELECT symbol, {D}, {sfixed(_MACD)} FROM mc")
def macd(spark, sf_dir):
    return I.macd(panels.bars_daily(spark, sf_dir)).select("symbol", day(), *fixed(_MACD))


_STOCH = {"stoch_k": 4, "stoch_d": 4, "cci": 4}


@query(f"""WITH {BARS}, a AS (SELECT *, {srolling('min', 'low', 14)} AS lo, {srolling('max', 'high', 14)} AS hi, (high + low + close) / 3 AS tp FROM bars),
b AS (SELECT *, CASE WHEN hi <> lo THEN 100 * (close - lo) / (hi - lo) END AS stoch_k, {srolling('avg', 'tp', 10)} AS m, list(tp) OVER ({S} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM a),
c AS (SELECT *, {srolling('avg', 'stoch_k', 3)} AS stoch_d, list_sum(list_transform(l, lambda v: abs(v - m))) / 10 AS mad FROM b)
SELECT symbol, {D}, {sfix('stoch_k', 4)} AS stoch_k, {sfix('stoch_d', 4)} AS stoch_d, {sfix('CASE WHEN mad <> 0 THEN (tp - m) / (0.015 * mad) END', 4)} AS cci FROM c""")
def stochastic_cci(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumns({**I.stochastic(), "cci": I.cci()})
    return rows.withColumn("stoch_d", rolling(F.avg, F.col("stoch_k"), 3)).select("symbol", day(), *fixed(_STOCH))


_ICHI = {"conversion": 3, "base": 3, "span_a": 3, "span_b": 3}


def _smid(n: int) -> str:
    return f"(({srolling('max', 'high', n)}) + ({srolling('min', 'low', n)})) / 2"


@query(f"WITH {BARS}, a AS (SELECT *, {_smid(9)} AS conversion, {_smid(26)} AS base, {_smid(52)} AS b FROM bars), c AS (SELECT *, lag((conversion + base) / 2, 26) OVER ({S}) AS span_a, lag(b, 26) OVER ({S}) AS span_b FROM a) SELECT symbol, {D}, {sfixed(_ICHI)} FROM c")
def ichimoku(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumns(I.ichimoku())
    return rows.withColumns({"span_a": lag(F.col("lead_a"), 26), "span_b": lag(F.col("lead_b"), 26)}).select("symbol", day(), *fixed(_ICHI))


_OBV = {"obv": 2, "vwap": 3, "vwap20": 3, "away": 5}


@query(f"WITH {BARS}, a AS (SELECT *, coalesce(sign(close - lag(close) OVER ({S})), 0) * volume AS sv, close * volume AS cv FROM bars), b AS (SELECT *, sum(sv) OVER ({S} ROWS UNBOUNDED PRECEDING) AS obv, sum(cv) OVER ({S} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({S} ROWS UNBOUNDED PRECEDING) AS vwap, ({srolling('sum', 'cv', 20)}) / ({srolling('sum', 'volume', 20)}) AS vwap20 FROM a), c AS (SELECT *, close / vwap - 1 AS away FROM b) SELECT symbol, {D}, {sfixed(_OBV)} FROM c")
def obv_vwap(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumn("sv", F.coalesce(F.signum(F.col("close") - lag(F.col("close"))), F.lit(0.0)) * F.col("volume"))
    rows = rows.withColumns({"obv": F.sum("sv").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), "vwap": I.anchored_vwap(), "vwap20": I.rolling_vwap(20)})
    return rows.withColumn("away", ratio(F.col("close"), F.col("vwap")) - 1).select("symbol", day(), *fixed(_OBV))


_LOG = {"r1": 6, "r5": 6, "vol": 6, "skew": 4, "kurt": 3, "roc": 5}


@query(f"""WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({S})) AS r1, ln(close / lag(close, 5) OVER ({S})) AS r5, close / lag(close, 10) OVER ({S}) - 1 AS roc FROM bars),
b AS (SELECT *, {srolling('stddev_samp', 'r1', 20)} AS vol, {srolling('avg', 'r1', 20)} AS m, list(r1) OVER ({S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l, count(r1) OVER ({S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c FROM a),
e AS (SELECT *, list_sum(list_transform(l, lambda v: pow(v - m, 2))) / 20 AS m2, list_sum(list_transform(l, lambda v: pow(v - m, 3))) / 20 AS m3, list_sum(list_transform(l, lambda v: pow(v - m, 4))) / 20 AS m4 FROM b),
f AS (SELECT *, CASE WHEN c = 20 THEN m3 / pow(m2, 1.5) * sqrt(20 * 19) / 18 END AS skew, CASE WHEN c = 20 THEN 19.0 / (18 * 17) * (21 * (m4 / (m2 * m2) - 3) + 6) END AS kurt FROM e) SELECT symbol, {D}, {sfixed(_LOG)} FROM f""")
def log_moments(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumns({"r1": I.log_return(), "r5": I.log_return(5), "roc": I.roc(10)})
    r = F.col("r1")
    return rows.withColumns({"vol": I.rolling_std(r, 20), "skew": I.skewness(r, 20), "kurt": I.kurtosis(r, 20)}).select("symbol", day(), *fixed(_LOG))


@query(f"WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({S})) AS r FROM bars), b AS (SELECT *, count(r) OVER w AS c, avg(r) OVER w AS m, var_samp(r) OVER w AS v FROM a WINDOW w AS ({S} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) SELECT symbol, {D}, {sfix('CASE WHEN r IS NOT NULL THEN CASE WHEN c < 252 THEN 0 ELSE coalesce(CASE WHEN v <> 0 THEN pow(r - m, 2) / v END, 0) END END', 4)} AS x FROM b")
def turbulence_1d(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumn("r", I.log_return())
    return rows.withColumn("x", I.turbulence(252, F.col("r"))).select("symbol", day(), *fixed({"x": 4}))


@query(f"""WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({S})) AS r FROM bars), b AS (SELECT *, {srolling('stddev_samp', 'r', 10)} AS v FROM a),
c AS (SELECT *, {srolling('stddev_samp', 'v', 10)} AS s, {srolling('avg', 'v', 20)} AS m, {srolling('stddev_samp', 'v', 20)} AS s20 FROM b) SELECT symbol, {D}, {sfix('coalesce(least(greatest(0.5 + 0.1 * tanh((s - m) / (s20 + 1e-8)), 0), 1), 0.5)')} AS x FROM c""")
def adaptive_threshold(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumn("r", I.log_return())
    rows = rows.withColumn("v", I.rolling_std(F.col("r"), 10))
    return rows.withColumn("x", I.threshold(F.col("v"))).select("symbol", day(), *fixed({"x": 5}))


@query(f"WITH {BARS}, a AS (SELECT *, {srolling('avg', 'close', 10)} AS m FROM bars), b AS (SELECT *, pow(close - m, 2) AS e FROM a) SELECT symbol, {D}, {sfix('ln(1 + (' + srolling('avg', 'e', 10) + '))')} AS x FROM b")
def ma_error(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumn("m", I.sma(F.col("close"), 10)).withColumn("e", F.pow(F.col("close") - F.col("m"), 2))
    return rows.withColumn("x", F.log1p(rolling(F.avg, F.col("e"), 10))).select("symbol", day(), *fixed({"x": 5}))


_WAVES = {"dow_sin": 6, "dow_cos": 6, "month_sin": 6, "month_cos": 6}


@query(f"WITH {BENCH}, a AS (SELECT ts, sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos, sin(2 * pi() * (month(ts) - 1) / 12) AS month_sin, cos(2 * pi() * (month(ts) - 1) / 12) AS month_cos FROM bench) SELECT {D}, {sfixed(_WAVES)} FROM a")
def calendar_waves(spark, sf_dir):
    return panels.bench_daily(spark, sf_dir).withColumns(I.calendar_waves(F.col("ts"))).select(day(), *fixed(_WAVES))


@query(f"WITH {BARS}, a AS (SELECT *, lead(close, 5) OVER ({S}) AS n5, lead(close) OVER ({S}) AS n1 FROM bars) SELECT symbol, {D}, {sfix('ln(n5 / close)', 6)} AS fwd5, CAST(CASE WHEN n5 IS NOT NULL THEN CASE WHEN ln(n5 / close) > 0.02 THEN 1 ELSE 0 END END AS BIGINT) AS event, CAST(sign(n1 - close) AS BIGINT) AS next_sign FROM a")
def labels_fwd(spark, sf_dir):
    f = I.forward_return(5)
    rows = panels.bars_daily(spark, sf_dir).withColumns({"fwd5": f, "event": F.when(f.isNotNull(), (f > 0.02).cast("long")), "next_sign": F.signum(F.lead("close").over(by_symbol()) - F.col("close")).cast("long")})
    return rows.select("symbol", day(), *fixed({"fwd5": 6}), "event", "next_sign")


@query(f"WITH {WEEKLY}, a AS (SELECT *, close / lag(close) OVER ({S}) - 1 AS r FROM weekly), b AS (SELECT symbol, ts, list(r) OVER ({S} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l, count(r) OVER ({S} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS n, r FROM a) SELECT symbol, {D}, {sfix('l[1]')} AS oldest, {sfix('l[8]')} AS latest, {sfix('list_sum(l)')} AS total, {sfix('r')} AS label FROM b WHERE n = 8")
def sequence_windows(spark, sf_dir):
    rows = panels.bars_weekly(spark, sf_dir).withColumn("r", change(F.col("close")))
    rows = rows.withColumn("l", F.collect_list("r").over(by_symbol().rowsBetween(-8, -1))).where(F.size("l") == 8)
    return rows.select("symbol", day(), fix(F.col("l")[0]).alias("oldest"), fix(F.col("l")[7]).alias("latest"), fix(F.aggregate("l", F.lit(0.0), lambda a, x: a + x)).alias("total"), fix("r").alias("label"))


@query(f"""WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({S})) AS y FROM bars), b AS (SELECT *, lag(y) OVER ({S}) AS x FROM a),
c AS (SELECT *, count(x) OVER w AS n, regr_slope(y, x) OVER w AS slope, regr_intercept(y, x) OVER w AS icpt FROM b WINDOW w AS ({S} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) SELECT symbol, {D}, {sfix('CASE WHEN n = 252 THEN y - (icpt + slope * x) END', 4)} AS resid FROM c""")
def ar1_residual(spark, sf_dir):
    rows = panels.bars_daily(spark, sf_dir).withColumn("y", I.log_return())
    rows = rows.withColumn("x", lag(F.col("y")))
    w = by_symbol().rowsBetween(-251, 0)
    fit = F.regr_intercept("y", "x").over(w) + F.regr_slope("y", "x").over(w) * F.col("x")
    return rows.withColumn("resid", F.when(F.count("x").over(w) == 252, F.col("y") - fit)).select("symbol", day(), *fixed({"resid": 4}))


_MACRO = """macro AS (SELECT r_name AS region, CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 HAVING weekofyear(CAST(date_trunc('week', o_orderdate) AS DATE)) % 3 <> 0)"""


@query(f"WITH {BARS}, {_MACRO}, m AS (SELECT * FROM macro WHERE region = 'ASIA') SELECT b.symbol, CAST(b.ts AS VARCHAR) AS d, {sfix('m.value', 2)} AS value FROM bars b ASOF LEFT JOIN m ON b.ts >= m.ts")
def macro_asof(spark, sf_dir):
    bars = panels.bars_daily(spark, sf_dir).select("symbol", "ts")
    macro = panels.macro_weekly(spark, sf_dir).where("region = 'ASIA'")
    right = macro.crossJoin(F.broadcast(bars.select("symbol").distinct())).select("symbol", "ts", "value")  # weeks x symbols
    return clean.asof(bars, right, "value").select("symbol", day(), *fixed({"value": 2}))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("WITH " + _MACRO + ", k AS (SELECT DISTINCT ts FROM macro), w AS (SELECT k.ts, " + ", ".join(f"max(CASE WHEN region = '{r}' THEN value END) AS \"{r}\"" for r in _REGIONS) + " FROM k JOIN macro USING (ts) GROUP BY 1) SELECT CAST(ts AS VARCHAR) AS d, " + ", ".join(sfix(f"coalesce(last_value(\"{r}\" IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(\"{r}\" IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 2) + f" AS v{i}" for i, r in enumerate(_REGIONS)) + " FROM w")
def macro_outer_merge(spark, sf_dir):
    series = panels.macro_weekly(spark, sf_dir).withColumnRenamed("region", "name")
    rows = clean.merge_series(series, _REGIONS)
    return rows.select(day(), *(fix(F.col(f"`{r}`"), 2).alias(f"v{i}") for i, r in enumerate(_REGIONS)))


@query(f"WITH {WEEKLY}, a AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS r FROM weekly) SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, count(*) AS n, {sfix('corr(a.r, b.r)')} AS corr, {sfix('covar_samp(a.r, b.r)')} AS cov FROM a JOIN a b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2")
def pairs_corr(spark, sf_dir):
    panel = panels.bars_weekly(spark, sf_dir).withColumn("r", change(F.col("close")))
    return metrics.correlations(panel, "r").select("symbol_1", "symbol_2", "n", *fixed({"corr": 5, "cov": 5}))


@query(f"WITH {WEEKLY}, a AS (SELECT symbol, ts, close / lag(close) OVER ({S}) - 1 AS r FROM weekly) SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, count(*) AS n, {sfix('corr(a.r, b.r)')} AS corr FROM a JOIN a b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING abs(corr(a.r, b.r)) >= 0.08")
def correlated_pairs(spark, sf_dir):
    """Pairs of symbols whose weekly returns go together or against each other, by products of matrices of tiles."""
    panel = panels.bars_weekly(spark, sf_dir).withColumn("r", change(F.col("close")))
    return metrics.correlated(panel, "r", 0.08).select("symbol_1", "symbol_2", "n", fix("corr", 5).alias("corr"))


def _residual_t(p: DataFrame) -> DataFrame:
    """symbol_1, symbol_2, n, t: Dickey-Fuller t of what is left of y_1 when it is regressed on y_2, pair by pair."""
    fit = p.groupBy("symbol_1", "symbol_2").agg(F.regr_slope("y_1", "y_2").alias("s"), F.regr_intercept("y_1", "y_2").alias("i"))
    rows = p.join(fit, ["symbol_1", "symbol_2"]).withColumn("e", F.col("y_1") - (F.col("i") + F.col("s") * F.col("y_2")))
    return metrics.unit_root_t(rows, ["symbol_1", "symbol_2"], "e").select("symbol_1", "symbol_2", "n", *fixed({"t": 3}))


@query(f"""WITH {WEEKLY}, p AS (SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, a.ts, ln(a.close) AS y, ln(b.close) AS x FROM weekly a JOIN weekly b ON a.ts = b.ts AND a.symbol < b.symbol),
f AS (SELECT symbol_1, symbol_2, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p GROUP BY 1, 2), e AS (SELECT p.*, y - (i + s * x) AS e FROM p JOIN f USING (symbol_1, symbol_2)),
l AS (SELECT *, lag(e) OVER (PARTITION BY symbol_1, symbol_2 ORDER BY ts) AS l FROM e), g AS (SELECT symbol_1, symbol_2, count(*) AS n, var_pop(l) AS vx, covar_pop(l, e - l) AS c, var_pop(e - l) AS vy FROM l WHERE l IS NOT NULL GROUP BY 1, 2)
SELECT symbol_1, symbol_2, n, {sfix('(c / vx) / sqrt(n * (vy - c * c / vx) / (n - 2) / (n * vx))', 3)} AS t FROM g""")
def pairs_df_screen(spark, sf_dir):
    return _residual_t(clean.pairs(panels.bars_weekly(spark, sf_dir).select("symbol", "ts", F.ln("close").alias("y")), ["y"]))


@query(f"""WITH {WEEKLY}, p0 AS (SELECT a.symbol AS symbol_1, b.symbol AS symbol_2, a.ts, a.close AS y, b.close AS x FROM weekly a JOIN weekly b ON a.ts = b.ts AND a.symbol < b.symbol),
ch AS (SELECT symbol_1, symbol_2 FROM p0 GROUP BY 1, 2 HAVING abs(corr(y, x)) >= 0.05 AND count(*) >= 26), p AS (SELECT p0.* FROM p0 JOIN ch USING (symbol_1, symbol_2)),
f AS (SELECT symbol_1, symbol_2, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p GROUP BY 1, 2), e AS (SELECT p.*, y - (i + s * x) AS e FROM p JOIN f USING (symbol_1, symbol_2)),
l AS (SELECT *, lag(e) OVER (PARTITION BY symbol_1, symbol_2 ORDER BY ts) AS l FROM e), g AS (SELECT symbol_1, symbol_2, count(*) AS n, var_pop(l) AS vx, covar_pop(l, e - l) AS c, var_pop(e - l) AS vy FROM l WHERE l IS NOT NULL GROUP BY 1, 2)
SELECT symbol_1, symbol_2, n, {sfix('(c / vx) / sqrt(n * (vy - c * c / vx) / (n - 2) / (n * vx))', 3)} AS t FROM g""")
def pairs_prefiltered_screen(spark, sf_dir):
    """The same on closes, for pairs with 26 common weeks whose closes correlate alone; tiles find them, rows of other pairs are not formed."""
    rows = panels.bars_weekly(spark, sf_dir).select("symbol", "ts", F.col("close").alias("y"))
    return _residual_t(clean.pair_rows(rows, metrics.correlated(rows, "y", 0.05).where("n >= 26"), ["y"]))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def nested_props(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query("WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)) AS name FROM pages) SELECT name, count(*) AS n, count(DISTINCT page_id) AS pages FROM a GROUP BY 1")
def page_constituents(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a>'), 1)).alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))
