"""Queries that read panels back from files, and lags of bars; further checks of sleeves and books."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.windows import lag
from ..operators import cross, orders
from ..sources import formats, panels
from ..sources.store import folder, stored
from .features import D, _OHLCV
from .market import _BOOK, _SLEEVES, _TARGET, account, returns, sleeve_table
from .oracle import BARS, RETURNS, S, WEEKLY, day, fix, fixed, query, sema, sfix, sfixed, srolling


@query(f"WITH {BARS} SELECT symbol, {D}, {sfixed(_OHLCV)} FROM bars")
def csv_bars(spark, sf_dir):
    """Bars written as CSV with a header and read with their schema."""
    path = folder(spark, "csv")
    panels.bars_daily(spark, sf_dir).select(*panels.BARS.names).write.csv(path, header=True)
    return panels.read_bars_csv(spark, path).select("symbol", day(), *fixed(_OHLCV))


@query(f"WITH {BARS} SELECT symbol, {D}, {sfixed(_OHLCV)} FROM bars WHERE ts BETWEEN DATE '1996-03-01' AND DATE '1998-10-31' AND symbol IN ('Brand#11', 'Brand#22', 'Brand#3', 'Brand#5') AND close IS NOT NULL")
def bars_of_symbols_and_dates(spark, sf_dir):
    """Bars stored by year, of some symbols between two dates: the scan reads their years and filters by both."""
    path = folder(spark, "bars")
    panels.write_bars(panels.bars_daily(spark, sf_dir), path)
    return panels.read_bars(spark, path, ["Brand#11", "Brand#22", "Brand#3", "Brand#5"], "1996-03-01", "1998-10-31").select("symbol", day(), *fixed(_OHLCV))


@query(
    f"WITH {BARS} SELECT symbol, {D}, {sfixed(_OHLCV)} FROM bars WHERE ts >= DATE '1996-03-15' AND ts < DATE '1997-10-31'"
    " AND symbol IN ('Brand#11', 'Brand#22', 'Brand#35', 'Brand#54', 'Brand 0') AND volume > 10"
)
def quotes_of_symbols(spark, sf_dir):
    """Bars in folders by symbol and year through a source of its own, which opens the files of these symbols and years only."""
    path = folder(spark, "quotes")
    formats.write_quotes(panels.bars_daily(spark, sf_dir), path)
    rows = formats.read_quotes(spark, path, ["Brand#11", "Brand#22", "Brand#35", "Brand#54", "Brand 0"], "1996-03-15", "1997-10-30")
    return rows.where("volume > 10").select("symbol", day(), *fixed(_OHLCV))


@query(f"WITH {RETURNS} SELECT {D}, {sfix('100 * max(r)', 2)} AS high, {sfix('100 * min(r)', 2)} AS low FROM returns WHERE r IS NOT NULL GROUP BY ts")
def factor_file(spark, sf_dir):
    """Weekly factor returns in percent from a text file with lines before and after the table."""
    path = folder(spark, "factors")
    rows = returns(spark, sf_dir).where("r IS NOT NULL").groupBy("ts").agg(F.format_string("%.6f", 100 * F.max("r")).alias("high"), F.format_string("%.6f", 100 * F.min("r")).alias("low"))
    lines = rows.select(F.concat_ws(",", F.date_format("ts", "yyyyMMdd"), "high", "low").alias("value"))
    for text in ("made of weekly closes", ",high,low", "  annual 1995", "Copyright"):
        lines = lines.union(spark.createDataFrame([(text,)], "value string"))
    lines.write.text(path)
    return panels.read_factor_csv(spark, path, ["high", "low"]).select(day(), *fixed({"high": 2, "low": 2}))


@query(f"WITH {WEEKLY}, m AS (SELECT n, symbol, ts, close, close / lag(close, n) OVER (PARTITION BY n, symbol ORDER BY ts) - 1 AS x FROM weekly, (SELECT unnest([4, 13, 26]) AS n)) SELECT CAST(n AS BIGINT) AS span, symbol, {sfix('avg(x)', 4)} AS mean FROM m GROUP BY 1, 2")
def stored_panel_sweep(spark, sf_dir):
    """A panel stored once and read by each part of a sweep."""
    panel = stored(panels.bars_weekly(spark, sf_dir), "weekly")
    parts = [panel.withColumn("x", cross.change(F.col("close"), n)).groupBy("symbol").agg(fix(F.avg("x"), 4).alias("mean")).select(F.lit(n).cast("long").alias("span"), "symbol", "mean") for n in (4, 13, 26)]
    return reduce(DataFrame.unionByName, parts)


_LAGS = {"close_1": 3, "close_inc": 3, "volume_1": 2, "volume_inc": 2, **{f"ma{n}{x}": 3 for n in (5, 10, 20) for x in ("", "_1", "_inc")}}


@query(f"WITH {BARS}, a AS (SELECT *, {', '.join(f'{srolling('avg', 'close', n)} AS ma{n}' for n in (5, 10, 20))} FROM bars), b AS (SELECT symbol, ts, {', '.join(f'{c}, lag({c}) OVER ({S}) AS {c}_1, {c} - lag({c}) OVER ({S}) AS {c}_inc' for c in ('close', 'volume', 'ma5', 'ma10', 'ma20'))} FROM a) SELECT symbol, {D}, {sfixed(_LAGS)} FROM b WHERE ma20_1 IS NOT NULL")
def lags_and_increments(spark, sf_dir):
    """Each of close, volume and three averages with its value a bar before and the change; bars without all of them are left out."""
    bars = panels.bars_daily(spark, sf_dir).withColumns({f"ma{n}": I.sma(F.col("close"), n) for n in (5, 10, 20)})
    bars = I.with_lags(bars, ["close", "volume", "ma5", "ma10", "ma20"])
    return bars.na.drop(subset=list(_LAGS)).select("symbol", day(), *fixed(_LAGS))


@query(f"WITH {BARS}, a AS (SELECT *, ln(close / lag(close) OVER ({S})) AS log_return, close / lag(close, 10) OVER ({S}) - 1 AS roc_10, close - lag(close) OVER ({S}) AS x FROM bars), b AS (SELECT *, {srolling('stddev_samp', 'log_return', 20)} AS vol_20, CASE WHEN x IS NOT NULL THEN greatest(x, 0) END AS u, CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END AS w FROM a), c AS (SELECT *, {srolling('avg', 'u', 14)} AS mu, {srolling('avg', 'w', 14)} AS mw FROM b) SELECT symbol, {D}, {sfix('log_return')} AS log_return, {sfix('roc_10')} AS roc_10, {sfix('CASE WHEN mw = 0 THEN CASE WHEN mu > 0 THEN 100 END ELSE 100 - 100 / (1 + mu / mw) END', 4)} AS rsi_14, {sfix('vol_20')} AS vol_20 FROM c")
def pipeline_features(spark, sf_dir):
    """Features by name as a stage of a model pipeline."""
    from ..operators import strategies

    names = {"log_return": 5, "roc_10": 5, "rsi_14": 4, "vol_20": 5}
    return strategies.PanelFeatures(list(names)).transform(panels.bars_daily(spark, sf_dir)).select("symbol", day(), *fixed(names))


@query(f"WITH {_TARGET} SELECT row_number() OVER (ORDER BY weight DESC, symbol) AS place, symbol, {sfix('weight')} AS weight FROM target")
def sorted_book(spark, sf_dir):
    """The book by weight, largest first."""
    place = F.row_number().over(Window.orderBy(F.col("weight").desc(), "symbol"))  # one account
    return account(spark, sf_dir)[1].select(place.cast("long").alias("place"), "symbol", fix("weight").alias("weight"))


#: A sleeve is ready with at least `top_k` priced names: here brands with a large part of retail price over a bound.
_READY = "pc AS (SELECT DISTINCT p_brand AS symbol FROM part WHERE p_retailprice > 1900), rd AS (SELECT sl.sleeve FROM sl JOIN (SELECT sleeve, unnest(universe) AS symbol FROM sl) u ON u.sleeve = sl.sleeve JOIN pc ON pc.symbol = u.symbol GROUP BY 1 HAVING count(*) >= 2)"


@query(f"WITH {_BOOK}, {_SLEEVES}, {_READY}, {_TARGET}, rest AS (SELECT sl.sleeve, book.symbol FROM book, sl WHERE residual AND book.symbol NOT IN (SELECT symbol FROM own)), mg AS (SELECT * FROM own UNION ALL SELECT * FROM rest), t AS (SELECT DISTINCT mg.symbol FROM mg JOIN rd ON rd.sleeve = mg.sleeve), w AS (SELECT symbol, sum(weight * (1.0 / (SELECT count(*) FROM sl))) AS weight FROM (SELECT rd.sleeve, target.* FROM target, rd) GROUP BY 1) SELECT b.symbol, CASE WHEN t.symbol IS NULL THEN 'left alone' WHEN w.weight IS NULL THEN 'close' ELSE 'to target' END AS action FROM book b LEFT JOIN t ON t.symbol = b.symbol LEFT JOIN w ON w.symbol = b.symbol")
def failed_sleeves(spark, sf_dir):
    """Sleeves without enough priced names are left out: their symbols get no orders, and no target of zero."""
    book, target = account(spark, sf_dir)
    sleeves = sleeve_table(spark, sf_dir)
    priced = panels.table(spark, sf_dir, "part").where("p_retailprice > 1900").select(F.col("p_brand").alias("symbol")).distinct()
    ready = orders.ready(sleeves, priced)
    mine = orders.managed(book, sleeves, ready).select("symbol").distinct().withColumn("managed", F.lit(True))
    net = orders.net_targets(target.join(F.broadcast(ready.select("sleeve")), how="cross"), sleeves)  # sleeves are few
    rows = book.join(mine, "symbol", "left").join(net, "symbol", "left")
    action = F.when(F.col("managed").isNull(), "left alone").when(F.col("weight").isNull(), "close").otherwise("to target")
    return rows.select("symbol", action.alias("action"))


@query("""WITH b AS (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS universe, row_number() OVER (ORDER BY p_type) AS k FROM part WHERE p_size = 50 GROUP BY 1), s AS (SELECT CASE WHEN k <= 2 THEN 'twice' ELSE p_type END AS sleeve, 0.3 AS allocation, k <= 2 AS residual, universe, 2 AS top_k, CASE WHEN k = 3 THEN 0.4 ELSE 0.6 END AS cap FROM b),
o AS (SELECT DISTINCT sleeve, unnest(universe) AS symbol FROM s WHERE NOT residual), t AS (SELECT sum(allocation) AS a, count(*) FILTER (residual) AS r, count(*) AS n, count(DISTINCT sleeve) AS d FROM s)
SELECT 'allocations' AS fault, 'do not sum to 1' AS detail FROM t WHERE abs(a - 1) > 1e-9 UNION ALL SELECT 'residual', 'more than one' FROM t WHERE r > 1 UNION ALL SELECT 'names', 'not unique' FROM t WHERE n > d UNION ALL SELECT 'universe', symbol FROM o GROUP BY symbol HAVING count(*) > 1 UNION ALL SELECT 'cap', sleeve FROM s WHERE top_k * cap < 1""")
def faulty_sleeves(spark, sf_dir):
    """A configuration with every fault: shares, two residual sleeves, a name twice, overlapping universes, a cap that cannot hold."""
    k = F.row_number().over(Window.orderBy("sleeve"))  # six rows
    s = sleeve_table(spark, sf_dir).withColumn("k", k)
    s = s.select(F.when(F.col("k") <= 2, "twice").otherwise(F.col("sleeve")).alias("sleeve"), F.lit(0.3).alias("allocation"), (F.col("k") <= 2).alias("residual"), "universe", "top_k", F.when(F.col("k") == 3, 0.4).otherwise(0.6).alias("cap"))
    return orders.sleeve_faults(s)
