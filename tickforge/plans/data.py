"""Inputs of the queries: bars, ticks, positions and social tables from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.sources.bars import bars_from_trades, sequence_key
from tickforge.sources.stored import stored_by_symbol

AS_OF = dt.date(2001, 11, 4)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trades(spark: SparkSession, sf: str, symbol: Column) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    seq = sequence_key((F.col("l_orderkey"), 15), (F.col("l_linenumber"), 2),
                       (F.col("l_partkey"), 15))
    return rows.select(symbol.alias("symbol"), F.col("l_shipdate").alias("ts"),
                       F.try_divide("l_extendedprice", "l_quantity").alias("price"),
                       F.col("l_quantity").alias("volume"), seq.alias("seq"))


def flag_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Few symbols, long daily history."""
    return bars_from_trades(trades(spark, sf, F.col("l_returnflag")))


def supplier_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Many symbols, shorter daily history."""
    return bars_from_trades(trades(spark, sf, F.col("l_suppkey").cast("string")))


def stored_supplier_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a table in buckets of symbols, as a user would keep it, for jobs with several branches over bars."""
    return stored_by_symbol(supplier_bars(spark, sf))


def market_bars(spark: SparkSession, sf: str) -> DataFrame:
    """One market series: mean order value per day."""
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("close"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").alias("ts"),
                       F.col("value").alias("price"), F.lit(1.0).alias("volume"),
                       F.col("ts").alias("seq"))


# SQL twins of the inputs, as CTEs --------------------------------------------------------

def _bars_sql(name: str, symbol: str) -> str:
    return f"""{name} AS (
  SELECT {symbol} AS symbol, l_shipdate AS ts,
         arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey)) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


FLAG_SQL = _bars_sql("bars", "l_returnflag")
SUPPLIER_SQL = _bars_sql("bars", "CAST(l_suppkey AS VARCHAR)")
AS_OF_SQL = "DATE '2001-11-04'"
DAY_SQL = "strftime(ts, '%Y-%m-%d')"


def day(col: str = "ts") -> Column:
    return F.date_format(col, "yyyy-MM-dd")
