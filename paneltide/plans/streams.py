"""Streaming queries over the events table; their oracles are the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import formats, panels
from ..sources.store import folder
from ..streaming import ticks
from .market import _machine
from .oracle import fix, query, sfix

_TICKS = "t AS (SELECT event_type AS symbol, ts, event_id AS id, value AS price, user_id AS \"user\" FROM events)"


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"WITH {_TICKS} SELECT symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS d, first(price ORDER BY ts, id, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, id, price) AS close, count(*) AS n FROM t GROUP BY 1, 2")
def stream_bars(spark, sf_dir):
    bars = ticks.drain(ticks.tumbling_bars(ticks.read_ticks(spark, sf_dir)), ["symbol", "ts"])
    return bars.select("symbol", _stamp("ts").alias("d"), "open", "high", "low", "close", "n")


@query(f"WITH {_TICKS}, w AS (SELECT symbol, price, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * k) MINUTE AS s FROM t, (SELECT unnest(range(4)) AS k)) SELECT symbol, strftime(s, '%Y-%m-%d %H:%M:%S') AS d, {sfix('avg(price)', 4)} AS mean, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    rows = ticks.drain(ticks.sliding_means(ticks.read_ticks(spark, sf_dir)), ["symbol", "ts"])
    return rows.select("symbol", _stamp("ts").alias("d"), fix("mean", 4).alias("mean"), "n")


@query(f"""WITH {_TICKS}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY "user" ORDER BY ts, id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM t), s AS (SELECT *, sum(new) OVER (PARTITION BY "user" ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT "user", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, {sfix('sum(price)', 3)} AS total FROM s GROUP BY "user", k""")
def stream_sessions(spark, sf_dir):
    rows = ticks.drain(ticks.sessions(ticks.read_ticks(spark, sf_dir)), ["user", "start"], mode="complete")
    return rows.select("user", _stamp("start").alias("start"), "n", fix("total", 3).alias("total"))


@query(f"WITH {_TICKS} SELECT \"user\", {sfix('sum(price)', 3)} AS cash, count(*) AS trades FROM t GROUP BY 1")
def stream_ledger(spark, sf_dir):
    rows = ticks.drain(ticks.ledger(ticks.read_ticks(spark, sf_dir)), ["user"])
    return rows.select("user", fix("cash", 3).alias("cash"), "trades")


@query(f"WITH {_TICKS} SELECT id, symbol, n_name FROM t LEFT JOIN nation ON n_nationkey = \"user\" % 25")
def stream_enriched(spark, sf_dir):
    nation = panels.table(spark, sf_dir, "nation").select((F.col("n_nationkey")).cast("long").alias("k"), "n_name")
    rows = ticks.enrich(ticks.read_ticks(spark, sf_dir).withColumn("k", F.col("user") % 25), nation, "k")
    return ticks.drain(rows.select("id", "symbol", "n_name"), [], mode="append")


@query(f"WITH RECURSIVE {_TICKS}, xs AS (SELECT symbol, ts, id, (price - 50) / 500 AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS rn FROM t), {_machine('xs', 'x', 0.1, 5)} SELECT hm.symbol, strftime(hm.ts, '%Y-%m-%d %H:%M:%S') AS d, id, CAST(pos AS INT) AS position FROM hm JOIN xs ON xs.symbol = hm.symbol AND xs.rn = hm.rn")
def stream_positions(spark, sf_dir):
    """The holding-period machine over ticks as a stream, which may come in any order within ten minutes."""
    closing = folder(spark, "closing")
    rows = ticks.read_ticks(spark, sf_dir, closing=closing).withColumn("x", (F.col("price") - 50) / 500)
    return ticks.drain(ticks.holding_period(rows, "x", 0.1, 5, "10 minutes"), [], "append", closing).select("symbol", _stamp("ts").alias("d"), "id", "position")


@query(f"""WITH {_TICKS}, n AS (SELECT "user", ts, lead(ts) OVER (PARTITION BY "user" ORDER BY ts, id) AS nx, (SELECT max(ts) FROM t) - INTERVAL 10 MINUTE AS mark FROM t) SELECT CAST("user" AS VARCHAR) AS "user", strftime(ts, '%Y-%m-%d %H:%M:%S') AS last FROM n WHERE nx > ts + INTERVAL 1 HOUR OR (nx IS NULL AND ts + INTERVAL 1 HOUR < mark)""")
def stream_stale(spark, sf_dir):
    """The ticks after which a user had none for an hour, also where none came before the stream's end."""
    closing = folder(spark, "closing")
    users = ticks.read_ticks(spark, sf_dir, closing=closing).withColumn("symbol", F.col("user").cast("string"))
    return ticks.drain(ticks.stale_symbols(users), [], "append", closing).select(F.col("symbol").alias("user"), _stamp("last").alias("last"))


@query(f"WITH {_TICKS} SELECT id, symbol, CAST(\"user\" AS BIGINT) AS \"user\", CASE WHEN price > 100 THEN 'sell' ELSE 'buy' END AS side, {sfix('price', 3)} AS price FROM t WHERE price > 100 OR price < 20")
def stream_orders(spark, sf_dir):
    """Orders of ticks at a high or low price, in a sink that commits each batch once, read back from it."""
    path = folder(spark, "orders")
    rows = ticks.read_ticks(spark, sf_dir).where("price > 100 OR price < 20")
    rows = rows.select("id", "symbol", F.col("user").cast("long").alias("user"), F.when(F.col("price") > 100, "sell").otherwise("buy").alias("side"), fix("price", 3).alias("price"))
    formats.write_committed(rows, f"{path}/out", f"{path}/state")
    return formats.read_committed(spark, f"{path}/out", rows.schema)
