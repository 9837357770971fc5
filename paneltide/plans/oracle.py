"""A registry of queries with the SQL that gives the same rows, and SQL fragments that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name; sql is its oracle."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Rounding with boundaries away from round numbers, so that sums in another order give the same digits.
OFFSET = 0.49871


def fix(x: Column | str, digits: int = 5) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x.cast("double") * 10**digits + OFFSET) / float(10**digits)


def sfix(x: str, digits: int = 5) -> str:
    return f"floor(CAST(({x}) AS DOUBLE) * {10**digits} + {OFFSET}) / {float(10**digits)}"


def fixed(columns: dict[str, int]) -> list[Column]:
    return [fix(c, n).alias(c) for c, n in columns.items()]


def sfixed(columns: dict[str, int]) -> str:
    return ", ".join(f"{sfix(c, n)} AS {c}" for c, n in columns.items())



def day() -> Column:
    return F.col("ts").cast("string").alias("d")


#: Panels as in paneltide.sources.panels.
BARS = """px AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS px, l_quantity AS q, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4 FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT symbol, ts, first(px ORDER BY k1, k2, k3, k4, px) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY k1, k2, k3, k4, px) AS close, sum(q) AS volume FROM px GROUP BY symbol, ts)"""
WEEKLY = """weekly AS (SELECT c_mktsegment AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, avg(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
BENCH = """bench AS (SELECT CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) / sum(l_quantity) AS bench FROM lineitem GROUP BY 1)"""
DENSE = f"""{BARS},
grid AS (SELECT s.symbol, c.ts, b.open, b.high, b.low, b.close AS raw, b.volume FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT ts FROM bars) c LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = c.ts),
dense AS (SELECT symbol, ts, last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM grid)"""
S = "PARTITION BY symbol ORDER BY ts"
#: Weekly returns and their runs, for metrics.
RETURNS = f"""{WEEKLY}, returns AS (SELECT symbol AS run, ts, close / lag(close) OVER ({S}) - 1 AS r FROM weekly)"""


def back(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def srolling(f: str, x: str, n: int, by: str = S) -> str:
    w = f"OVER ({by} {back(n)})"
    return f"CASE WHEN count({x}) {w} = {n} THEN {f}({x}) {w} END"


def sema(source: str, x: str, alpha: str, name: str) -> str:
    """CTEs that add column `name`, the exponential average of x, to a table (symbol, ts, ...) without gaps in x after its first value."""
    return f"""{name}_n AS (SELECT *, row_number() OVER ({S}) AS rn FROM {source} WHERE {x} IS NOT NULL),
{name}_r AS (SELECT symbol, ts, rn, {x} AS {name} FROM {name}_n WHERE rn = 1 UNION ALL SELECT n.symbol, n.ts, n.rn, (1 - {alpha}) * r.{name} + {alpha} * n.{x} FROM {name}_r r JOIN {name}_n n ON n.symbol = r.symbol AND n.rn = r.rn + 1)"""
