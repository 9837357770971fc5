"""Panels of bars: scans, and the panels that the supplied tables make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a CSV file with a header, columns as in BARS."""
    return spark.read.schema(BARS).csv(path, header=True)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of Parquet files; symbols and dates are filtered in the scan."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end).cast("date"))
    return df.select(*BARS.names).na.drop()


def read_factor_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Factor returns from a CSV file with text before and after the table: rows that begin with a date yyyyMMdd."""
    row = F.split("value", r"\s*,\s*")
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d{8}\s*,"))
    return lines.select(F.to_date(F.trim(row[0]), "yyyyMMdd").alias("ts"), *(F.try_to_number(F.trim(row[i + 1]), F.lit("S999999.999999")).cast("double").alias(n) for i, n in enumerate(names)))


def write_bars(df: DataFrame, path: str) -> None:
    """Parquet by year, rows of a symbol together and in order: scans of symbols or years read what they need."""
    df.withColumn("year", F.year("ts")).repartition("year", "symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").partitionBy("year").parquet(path)


def to_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: list[str]) -> DataFrame:
    """Bars of ticks by symbol and ts (a date or the start of an interval); `order` tells first and last, ties by price."""
    key = F.struct(*order, "__p")
    rows = ticks.withColumns({"symbol": symbol, "ts": ts, "__p": price, "__v": volume})
    return rows.groupBy("symbol", "ts").agg(F.min_by("__p", key).alias("open"), F.max("__p").alias("high"), F.min("__p").alias("low"), F.max_by("__p", key).alias("close"), F.sum("__v").alias("volume"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by brand: unit prices of line items."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return to_bars(rows, F.col("p_brand"), F.to_date("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def closes_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, close) of bars_daily().

    A bar's last order is found first, in a hash aggregation of three columns of the line items; only the items of such orders are then
    put in order. Ordering all items by the whole key would sort all of them, and join all columns of the key with the parts.
    """
    items = table(spark, sf_dir, "lineitem").withColumn("ts", F.to_date("l_shipdate"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    sold = F.col("l_partkey") == F.col("p_partkey")
    last = items.select("ts", "l_partkey", "l_orderkey").join(part, sold).groupBy("symbol", "ts").agg(F.max("l_orderkey").alias("__order"))
    last = last.select(F.col("symbol").alias("__symbol"), F.col("ts").alias("__ts"), "__order")
    # a row for each brand and date; the last order is null where all are
    ends = items.join(F.broadcast(last), F.col("ts").eqNullSafe(F.col("__ts")) & F.col("l_orderkey").eqNullSafe(F.col("__order")))
    ends = ends.join(part, sold & F.col("symbol").eqNullSafe(F.col("__symbol")))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return ends.groupBy("symbol", "ts").agg(F.max_by(price, F.struct("l_linenumber", "l_partkey", "l_suppkey", price)).alias("close"))


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly mean order price by market segment: (symbol, ts, close)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("symbol"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("ts")).agg(F.avg("o_totalprice").alias("close"))


def bench_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of all line items of a day by volume: (ts, bench)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("ts")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("bench"))


def macro_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by region and week, without every third week: (region, ts, value)."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    return rows.groupBy(F.col("r_name").alias("region"), week.alias("ts")).agg(F.avg("o_totalprice").alias("value")).where(F.weekofyear("ts") % 3 != 0)
