"""Streams over the events and orders tables (survey 2.10), checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import tail_rows
from tickforge.plans.data import SUPPLIER_SQL, day, supplier_bars, table
from tickforge.plans.portfolio_queries import _PID
from tickforge.plans.registry import query
from tickforge.sources.stored import stored
from tickforge.streaming import live as L


def _schema(spark, sf, name):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf, name).schema)


def _ticks(spark, sf):
    rows = L.ticks_from_events(spark, sf, _schema(spark, sf, "events"))
    return rows.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))


def _orders(spark, sf):
    return (spark.readStream.schema(_schema(spark, sf, "orders"))
            .option("pathGlobFilter", "orders.parquet").parquet(sf))


@query("stream_live_price", "SELECT event_type AS symbol, arg_max(value, ts) AS price, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_update FROM events GROUP BY 1")
def _(spark, sf):
    p = L.settle(L.live_price(_ticks(spark, sf)), ["symbol"])
    return p.select("symbol", "price", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss").alias("last_update"))


def _bars_sql(interval):
    return f"""SELECT event_type AS symbol, strftime(time_bucket(INTERVAL {interval}, ts), '%Y-%m-%d %H:%M') AS slot, arg_min(value, ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2"""


for _tf, _iv in (("1h", "1 HOUR"), ("4h", "4 HOUR"), ("1d", "1 DAY")):
    @query(f"stream_bars_{_tf}", _bars_sql(_iv))
    def _(spark, sf, _tf=_tf):
        b = L.settle(L.live_bars(_ticks(spark, sf), _tf), ["symbol", "ts"])
        return b.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("slot"), "open", "high", "low", "close", "volume")


@query("stream_live_candle", f"""WITH {SUPPLIER_SQL}, p AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_acctbal AS price FROM supplier WHERE s_acctbal > 0),
 l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, round(open, 4) AS open, round(greatest(high, price), 4) AS high, round(least(low, price), 4) AS low, round(coalesce(price, close), 4) AS close
FROM l LEFT JOIN p USING (symbol)""")
def _(spark, sf):
    stream = (spark.readStream.schema(_schema(spark, sf, "supplier")).option("pathGlobFilter", "supplier.parquet").parquet(sf))
    quotes = stream.select(F.col("s_suppkey").cast("string").alias("symbol"), F.lit("2001-11-05 10:00:00").cast("timestamp").alias("ts"), F.col("s_acctbal").alias("price"))
    newest = stored(tail_rows(supplier_bars(spark, sf), 1), "candles")
    c = L.newest_candles(L.settle(L.live_candles(quotes, newest), ["symbol", "slot"]), newest)
    return c.select("symbol", day().alias("day"), *[rnd(x, 4).alias(x) for x in ("open", "high", "low", "close")])


# Every order is a click: a user whose last order of a portfolio is divisible by four has taken the reaction back.
@query("stream_reaction_counts", f"""WITH r AS (SELECT {_PID} AS portfolio_id, o_orderkey % 3 AS user_id, arg_max(o_orderkey % 4 <> 0, o_orderkey) AS active
 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) SELECT portfolio_id, count(*) FILTER (active) AS n FROM r GROUP BY 1""")
def _(spark, sf):
    r = _orders(spark, sf).where("o_orderstatus = 'F'").selectExpr(f"{_PID} AS portfolio_id", "o_orderkey % 3 AS user_id", "o_orderkey AS seq", "o_orderkey % 4 <> 0 AS active")
    return L.reaction_counts(L.settle(L.reaction_states(r), ["portfolio_id", "user_id"]))


@query("stream_ticker_events", f"""WITH s AS (SELECT {_PID} AS p, o_orderkey AS seq, [concat('T', o_orderkey % 5), concat('U', o_orderkey % 3)] AS now FROM orders),
 d AS (SELECT *, lag(now) OVER (PARTITION BY p ORDER BY seq) AS old FROM s)
SELECT p AS portfolio_id, seq, 'buy' AS action, unnest(list_filter(now, lambda x: NOT list_contains(old, x))) AS ticker FROM d WHERE old IS NOT NULL UNION ALL
SELECT p, seq, 'sell', unnest(list_filter(old, lambda x: NOT list_contains(now, x))) FROM d WHERE old IS NOT NULL""")
def _(spark, sf):
    s = _orders(spark, sf).selectExpr(f"CAST({_PID} AS BIGINT) AS portfolio_id", "o_orderkey AS seq",
                                      "array(concat('T', o_orderkey % 5), concat('u', o_orderkey % 3)) AS tickers")
    return L.settle(s, ["portfolio_id"], mode="append", step=L.ticker_events)
