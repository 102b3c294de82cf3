"""Scan, cleaning, resampling, tails and risk inputs (survey 2.1-2.5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import tail_rows
from tickforge.operators import risk
from tickforge.plans.data import (AS_OF, AS_OF_SQL, DAY_SQL, FLAG_SQL, SUPPLIER_SQL, day,
                                  flag_bars, market_bars, supplier_bars, table, ticks)
from tickforge.plans.registry import query
from tickforge.sources import bars as B
from tickforge.sources.stored import scratch_table, stored_by_symbol

OHLC4 = ("open", "high", "low", "close")


def _bars_out(df, extra=()):
    return df.select("symbol", day().alias("day"), *[rnd(c, 4).alias(c) for c in OHLC4],
                     rnd("volume", 4).alias("volume"), *extra)


_BARS_OUT = (f"symbol, {DAY_SQL} AS day, round(open,4) AS open, round(high,4) AS high, "
             "round(low,4) AS low, round(close,4) AS close, round(volume,4) AS volume")


@query("bars_from_trades", f"WITH {SUPPLIER_SQL} SELECT {_BARS_OUT} FROM bars")
def _(spark, sf):
    return _bars_out(supplier_bars(spark, sf))


@query("scan_bars", f"""WITH {SUPPLIER_SQL} SELECT {_BARS_OUT} FROM bars
WHERE ts >= {AS_OF_SQL} - INTERVAL 72 MONTH""")
def _(spark, sf):
    name, folder = scratch_table(spark, "history")
    B.write_bars(supplier_bars(spark, sf), name, folder, buckets=8)
    return _bars_out(B.scan_bars(spark, name, since=B.period_start("quote", "1d", AS_OF)))


@query("scan_bars_of_symbols", f"""WITH {SUPPLIER_SQL} SELECT {_BARS_OUT} FROM bars
WHERE ts >= {AS_OF_SQL} - INTERVAL 24 MONTH AND symbol IN ('3', '7')""")
def _(spark, sf):
    name, folder = scratch_table(spark, "history")
    B.write_bars(supplier_bars(spark, sf), name, folder, buckets=8)
    return _bars_out(B.scan_bars(spark, name, ["3", "7"], B.period_start("technicals", "1d", AS_OF)))


# Raw bars with gaps to clean, derived from the trades: every fifth day lacks high and low,
# every seventh lacks volume, every eleventh lacks a close; numbers arrive as text.
def _dirty(spark, sf):
    b = supplier_bars(spark, sf)
    d = F.unix_date(F.col("ts").cast("date"))
    text = {c: F.col(c).cast("string") for c in OHLC4 + ("volume",)}
    return b.select(
        "symbol", "ts", text["open"].alias("open"),
        F.when(d % 5 != 0, text["high"]).otherwise("n/a").alias("high"),
        F.when(d % 5 != 0, text["low"]).alias("low"),
        F.when(d % 11 != 0, text["close"]).otherwise("-").alias("close"),
        F.when(d % 7 != 0, text["volume"]).alias("volume"))


_DIRTY_SQL = SUPPLIER_SQL + """, dirty AS (
 SELECT symbol, ts, open,
   CASE WHEN d % 5 <> 0 THEN high END AS high, CASE WHEN d % 5 <> 0 THEN low END AS low,
   CASE WHEN d % 11 <> 0 THEN close END AS close, CASE WHEN d % 7 <> 0 THEN volume END AS volume
 FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d FROM bars))"""


@query("clean_bars", f"""WITH {_DIRTY_SQL}
SELECT symbol, {DAY_SQL} AS day, round(open,4) AS open, round(coalesce(high, close),4) AS high,
  round(coalesce(low, close),4) AS low, round(close,4) AS close,
  round(coalesce(volume, 0),4) AS volume FROM dirty WHERE close IS NOT NULL""")
def _(spark, sf):
    return _bars_out(B.clean_bars(_dirty(spark, sf)))


@query("clean_bars_quote", f"""WITH {_DIRTY_SQL}
SELECT symbol, {DAY_SQL} AS day, round(open,4) AS open, round(coalesce(high, close),4) AS high,
  round(coalesce(low, close),4) AS low, round(close,4) AS close,
  round(volume,4) AS volume FROM dirty WHERE close IS NOT NULL""")
def _(spark, sf):
    return _bars_out(B.clean_bars(_dirty(spark, sf), fill_volume=False))


@query("clean_bars_strict", f"""WITH {_DIRTY_SQL}
SELECT symbol, {DAY_SQL} AS day, round(open,2) AS open, round(high,2) AS high,
  round(low,2) AS low, round(close,2) AS close FROM dirty
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""")
def _(spark, sf):
    return B.clean_bars_strict(_dirty(spark, sf)).select("symbol", day().alias("day"), *OHLC4)


def _dated(spark, sf):
    """Display rows: odd months as yyyy-MM, some dates unreadable, some prices missing."""
    b = _dirty(spark, sf)
    d = F.unix_date(F.col("ts").cast("date"))
    idx = F.row_number().over(B.by_time()) - 1
    date = (F.when(d % 13 == 0, "soon").when(F.month("ts") % 2 == 1, F.date_format("ts", "yyyy-MM"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return b.withColumn("idx", idx).withColumn("date", date)


@query("valid_gap_rows", f"""WITH {_DIRTY_SQL}, dated AS (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx,
   CASE WHEN date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 13 = 0 THEN NULL
        WHEN month(ts) % 2 = 1 THEN strftime(ts, '%Y-%m') || '-01'
        ELSE strftime(ts, '%Y-%m-%d') END AS day FROM dirty)
SELECT symbol, idx, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS pos, day,
 round(close,4) AS close FROM dated
WHERE day IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""")
def _(spark, sf):
    return B.valid_gap_rows(_dated(spark, sf)).select(
        "symbol", "idx", "pos", day().alias("day"), rnd("close", 4).alias("close"))


@query("sort_bars", f"""WITH {SUPPLIER_SQL}
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
 round(close,4) AS close FROM bars""")
def _(spark, sf):
    zoned = supplier_bars(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return B.naive_sorted(zoned).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "pos",
        rnd("close", 4).alias("close"))


@query("format_bar_date", """WITH b AS (
 SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts FROM events GROUP BY 1, 2)
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS date_4h, strftime(ts, '%Y-%m-%d %H:%M') AS date_1mo,
 strftime(ts, '%Y-%m-%d') AS date_1d FROM b""")
def _(spark, sf):
    b = B.bars_from_trades(ticks(spark, sf), F.window("ts", "4 hours")["start"])
    ts = F.col("ts")
    return b.select("symbol", B.bar_date("240m", ts).alias("date_4h"),
                    B.bar_date("1mo", ts).alias("date_1mo"), B.bar_date("1d", ts).alias("date_1d"))


_WEEK = "CAST(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS TIMESTAMP)"


def _resample_sql(slot):
    return f"""WITH {SUPPLIER_SQL}, r AS (
 SELECT symbol, {slot} AS slot, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)
 SELECT {_BARS_OUT} FROM (SELECT * REPLACE (slot AS slot), slot AS ts FROM r)"""


@query("resample_weekly", _resample_sql(_WEEK))
def _(spark, sf):
    return _bars_out(B.resample(supplier_bars(spark, sf), "W-FRI"))


@query("resample_monthly", _resample_sql("CAST(last_day(ts) AS TIMESTAMP)"))
def _(spark, sf):
    return _bars_out(B.resample(supplier_bars(spark, sf), "ME"))


@query("tail_n", f"""WITH {SUPPLIER_SQL} SELECT {_BARS_OUT} FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120""")
def _(spark, sf):
    return _bars_out(tail_rows(supplier_bars(spark, sf), 120))


@query("history_rows", f"""WITH {SUPPLIER_SQL} SELECT symbol, strftime(ts, '%Y-%m-%d') AS date,
 round(open,2) AS open, round(high,2) AS high, round(low,2) AS low, round(close,2) AS close
FROM bars WHERE ts >= {AS_OF_SQL} - INTERVAL 6 MONTH
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120""")
def _(spark, sf):
    return B.history(supplier_bars(spark, sf), "1d", AS_OF).select("symbol", "date", *OHLC4)


@query("ffill", f"""WITH {_DIRTY_SQL}
SELECT symbol, {DAY_SQL} AS day,
 round(last_value(close IGNORE NULLS) OVER w, 4) AS close,
 round(last_value(high IGNORE NULLS) OVER w, 4) AS high FROM dirty
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    b = _dirty(spark, sf)
    num = b.select("symbol", "ts", F.col("close").try_cast("double").alias("close"),
                   F.col("high").try_cast("double").alias("high"))
    return risk.ffill(num, ("close", "high")).select(
        "symbol", day().alias("day"), rnd("close", 4).alias("close"),
        rnd("high", 4).alias("high"))


@query("downsample", f"""WITH {SUPPLIER_SQL}, n AS (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, {DAY_SQL} AS day, round(close,4) AS close FROM n
WHERE n <= 260 OR p % CAST(ceil(n / 260.0) AS BIGINT) = 0 OR p = n - 1""")
def _(spark, sf):
    return B.downsample(supplier_bars(spark, sf), 260).select(
        "symbol", day().alias("day"), rnd("close", 4).alias("close"))


_LAG = "lag(close) OVER (PARTITION BY symbol ORDER BY ts)"


@query("daily_change", f"""WITH {SUPPLIER_SQL} SELECT symbol, {DAY_SQL} AS day,
 round((close - {_LAG}) / {_LAG} * 100, 2) AS daily_change FROM bars""")
def _(spark, sf):
    return risk.daily_change(supplier_bars(spark, sf)).select(
        "symbol", day().alias("day"), "daily_change")


@query("price_only", f"""WITH {SUPPLIER_SQL}, c AS (SELECT *, {_LAG} AS prev FROM bars)
SELECT symbol, round(close,4) AS current_price, round((close - prev) / prev * 100, 2) AS daily_change,
 round(low,4) AS daily_low, round(high,4) AS daily_high FROM c
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def _(spark, sf):
    p = risk.price_only(supplier_bars(spark, sf))
    return p.select("symbol", rnd("current_price", 4).alias("current_price"), "daily_change",
                    rnd("daily_low", 4).alias("daily_low"),
                    rnd("daily_high", 4).alias("daily_high"))


@query("pct_change_n", f"""WITH {SUPPLIER_SQL} SELECT symbol, {DAY_SQL} AS day,
 {", ".join(f"round((close / lag(close, {n}) OVER w - 1) * 100, 4) AS {k}" for k, n in
            {"return_1w": 5, "return_1m": 21, "return_3m": 63, "return_1y": 252, "return_5y": 1260}.items())}
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, sf):
    from tickforge.functions.windows import positioned
    from tickforge.operators.indicators import RETURN_STEPS, with_returns
    s = with_returns(positioned(supplier_bars(spark, sf)), RETURN_STEPS)
    return s.select("symbol", day().alias("day"), *[rnd(c, 4).alias(c) for c in RETURN_STEPS])


@query("daily_returns", f"""WITH {SUPPLIER_SQL} SELECT symbol, {DAY_SQL} AS day,
 round(close / {_LAG} - 1, 6) AS ret FROM bars QUALIFY {_LAG} IS NOT NULL""")
def _(spark, sf):
    return risk.daily_returns(supplier_bars(spark, sf)).select(
        "symbol", day().alias("day"), rnd("ret", 6).alias("ret"))


@query("avg_volume_30", f"""WITH {SUPPLIER_SQL}, t AS (SELECT * FROM bars
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 30)
SELECT symbol, round(avg(volume), 4) AS avg_volume FROM t GROUP BY 1""")
def _(spark, sf):
    return risk.avg_volume(supplier_bars(spark, sf)).select(
        "symbol", rnd("avg_volume", 4).alias("avg_volume"))


@query("year_high_low", f"""WITH {SUPPLIER_SQL} SELECT symbol, round(min(low),4) AS year_low,
 round(max(high),4) AS year_high FROM bars WHERE ts >= {AS_OF_SQL} - INTERVAL 12 MONTH GROUP BY 1""")
def _(spark, sf):
    return risk.year_high_low(supplier_bars(spark, sf), AS_OF).select(
        "symbol", rnd("year_low", 4).alias("year_low"),
        rnd("year_high", 4).alias("year_high"))


# Dividends per supplier from the trades' tax amounts, one payment per trade row.
@query("trailing_dividend", f"""SELECT CAST(l_suppkey AS VARCHAR) AS symbol,
 round(sum(l_extendedprice * l_tax), 2) AS dividend_rate FROM lineitem
WHERE l_shipdate >= {AS_OF_SQL} - INTERVAL 365 DAY AND l_tax > 0 GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_tax") > 0)
    pay = li.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"),
                    (F.col("l_extendedprice") * F.col("l_tax")).alias("amount"))
    return risk.trailing_dividend(pay, AS_OF).select(
        "symbol", rnd("dividend_rate", 2).alias("dividend_rate"))


_N = "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"


@query("calc_return_n", f"""WITH {FLAG_SQL}, c AS (SELECT *, {", ".join(
    f"lag(close, {n}) OVER w AS c{n}" for n in (21, 63, 252, 756, 1260))}
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, {", ".join(f"round((close - c{n}) / c{n} * 100, 2) AS {k}" for k, n in
 {"momentum_1m": 21, "momentum_3m": 63, "return_1y": 252, "return_3y": 756, "return_5y": 1260}.items())}
FROM c QUALIFY {_N} = 1""")
def _(spark, sf):
    return risk.performance(flag_bars(spark, sf)).select(
        "symbol", "momentum_1m", "momentum_3m", "return_1y", "return_3y", "return_5y")


def _risk_cte(bars_sql):
    return f"""{bars_sql}, rr AS (SELECT symbol, ts, close, close / lag(close) OVER w - 1 AS ret,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 st AS (SELECT symbol, count(*) AS n, count(ret) AS nr,
  round(stddev_samp(ret) * sqrt(252) * 100, 2) AS volatility,
  CASE WHEN count(ret) >= 30 THEN round(stddev_samp(ret) FILTER (rn <= 30) * sqrt(252) * 100, 2) END AS volatility_30d,
  CASE WHEN count(ret) >= 252 THEN round(stddev_samp(ret) FILTER (rn <= 252) * sqrt(252) * 100, 2) END AS volatility_1y,
  pow(1 + avg(ret) FILTER (rn <= 252), 252) - 1 AS ann,
  CASE WHEN count(*) FILTER (ret < 0 AND rn <= 252) > 1 THEN stddev_samp(ret) FILTER (ret < 0 AND rn <= 252) * sqrt(252) END AS dd
  FROM rr GROUP BY symbol),
 mx AS (SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS d FROM rr WHERE rn <= 252),
 md AS (SELECT symbol, CASE WHEN count(*) >= 252 THEN round(min(d) * 100, 2) END AS max_drawdown_1y FROM mx GROUP BY symbol),
 ratios AS (SELECT st.*, max_drawdown_1y,
  CASE WHEN volatility_1y > 0 THEN round((ann - 0.01) / (volatility_1y / 100), 2) END AS sharpe_ratio,
  CASE WHEN dd > 0 THEN round((ann - 0.01) / dd, 2) END AS sortino_ratio
  FROM st JOIN md USING (symbol))"""


@query("annualized_vol", f"""WITH {_risk_cte(SUPPLIER_SQL)}
SELECT symbol, volatility, volatility_30d, volatility_1y FROM ratios""")
def _(spark, sf):
    return risk.performance(supplier_bars(spark, sf)).select(
        "symbol", "volatility", "volatility_30d", "volatility_1y")


@query("cummax", f"""WITH {SUPPLIER_SQL} SELECT symbol, {DAY_SQL} AS day,
 round(max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS peak FROM bars""")
def _(spark, sf):
    return risk.cummax(supplier_bars(spark, sf)).select(
        "symbol", day().alias("day"), rnd("peak", 4).alias("peak"))


@query("max_drawdown_1y", f"WITH {_risk_cte(SUPPLIER_SQL)} SELECT symbol, max_drawdown_1y FROM ratios")
def _(spark, sf):
    return risk.performance(supplier_bars(spark, sf)).select("symbol", "max_drawdown_1y")


for _name, _col in (("sharpe", "sharpe_ratio"),
                    ("sortino", "sortino_ratio")):
    @query(_name, f"WITH {_risk_cte(SUPPLIER_SQL)} SELECT symbol, printf('%.6e', {_col}) AS {_col} FROM ratios")
    def _(spark, sf, _col=_col):
        # prices of the test tables jump so much that ratios need a relative comparison
        return risk.performance(supplier_bars(spark, sf)).select(
            "symbol", F.format_string("%.6e", _col).alias(_col))


_BETA_CTE = """m AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS close FROM orders GROUP BY 1),
 mr AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS mret FROM m WHERE ts >= DATE '2000-11-04'),
 al AS (SELECT symbol, ret, mret FROM rr JOIN mr USING (ts) WHERE rn <= 252 AND ret IS NOT NULL AND mret IS NOT NULL),
 bt AS (SELECT symbol, CASE WHEN count(*) > 10 AND var_samp(mret) > 0
   THEN round(covar_samp(ret, mret) / var_samp(mret), 2) END AS beta FROM al GROUP BY symbol)"""


# The symbol's tail of 252 bars has 251 returns: the first bar of the tail has no return.
_BETA_CTE = _BETA_CTE.replace("rn <= 252", "rn <= 251")


@query("beta_join", f"""WITH {_risk_cte(FLAG_SQL)}, {_BETA_CTE}
SELECT symbol, count(*) AS n, round(sum(ret * mret), 6) AS cross FROM al GROUP BY symbol""")
def _(spark, sf):
    al = risk.beta_join(flag_bars(spark, sf), market_bars(spark, sf), AS_OF)
    return al.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"),
                                    rnd(F.sum(F.col("ret") * F.col("mret")), 6).alias("cross"))


@query("beta", f"WITH {_risk_cte(FLAG_SQL)}, {_BETA_CTE} SELECT symbol, beta FROM bt")
def _(spark, sf):
    return risk.beta(flag_bars(spark, sf), market_bars(spark, sf), AS_OF)


def _clamp(e):
    return f"CASE WHEN ({e}) IS NULL THEN NULL ELSE greatest(0.0, least(1.0, {e})) END"


_INDEX_SQL = f"""WITH {_risk_cte(FLAG_SQL)}, {_BETA_CTE},
 q AS (SELECT symbol, avg(volume) AS av FROM (SELECT * FROM bars QUALIFY {_N} <= 30) GROUP BY 1),
 px AS (SELECT symbol, close AS price FROM bars QUALIFY {_N} = 1),
 mc AS (SELECT symbol, sum(volume) * 1000 AS shares FROM bars GROUP BY 1),
 j AS (SELECT r.*, beta, av * price AS adv, shares * price AS cap,
   volatility_30d / CASE WHEN volatility > 0 THEN volatility END AS regime
   FROM ratios r LEFT JOIN bt USING (symbol) JOIN q USING (symbol) JOIN px USING (symbol) JOIN mc USING (symbol)),
 sc AS (SELECT symbol, unnest([
  {{'v': {_clamp("(volatility - 15) / 25.0")}, 'w': 0.20::DOUBLE}},
  {{'v': {_clamp("(volatility_30d - 15) / 25.0")}, 'w': 0.10::DOUBLE}},
  {{'v': {_clamp("(abs(max_drawdown_1y) - 10) / 25.0")}, 'w': 0.20::DOUBLE}},
  {{'v': {_clamp("(beta - 0.9) / 0.6")}, 'w': 0.10::DOUBLE}},
  {{'v': {_clamp("(1.2 - sharpe_ratio) / 1.2")}, 'w': 0.10::DOUBLE}},
  {{'v': {_clamp("(1.4 - sortino_ratio) / 1.4")}, 'w': 0.10::DOUBLE}},
  {{'v': {_clamp("(7.3 - log10(CASE WHEN adv > 0 THEN adv END)) / 1.0")}, 'w': 0.10::DOUBLE}},
  {{'v': {_clamp("(10.0 - log10(CASE WHEN cap > 0 THEN cap END)) / 0.7")}, 'w': 0.05::DOUBLE}},
  {{'v': {_clamp("(regime - 1) / 0.6")}, 'w': 0.05::DOUBLE}}]) AS s FROM j),
 ix AS (SELECT symbol, CAST(round(sum(s.v * s.w) FILTER (s.v IS NOT NULL) / sum(s.w) FILTER (s.v IS NOT NULL) * 100) AS INTEGER) AS risk_index FROM sc GROUP BY 1)
SELECT symbol, risk_index, CASE WHEN risk_index IS NULL THEN 'N/D' WHEN risk_index >= 67 THEN 'Alto'
 WHEN risk_index >= 34 THEN 'Medio' ELSE 'Basso' END AS risk_level FROM ix"""


def _risk_inputs(spark, sf):
    """All of the trades' bars from one written table: five branches read it, none reads the trades again."""
    bars = stored_by_symbol(flag_bars(spark, sf), "risk-bars")
    cap = bars.groupBy("symbol").agg((F.sum("volume") * 1000).alias("shares"), F.max_by("volume", "ts").alias("last_volume"))
    quote = (risk.price_only(bars).join(risk.avg_volume(bars), "symbol").join(cap, "symbol")
             .withColumn("market_cap", F.col("shares") * F.col("current_price")))
    return (risk.performance(bars)
            .join(risk.beta(bars, market_bars(spark, sf), AS_OF), "symbol", "left")
            .join(quote.select("symbol", "current_price", "avg_volume", "market_cap", "last_volume"),
                  "symbol", "left"))


@query("risk_index", _INDEX_SQL)
def _(spark, sf):
    return risk.risk_index(_risk_inputs(spark, sf)).select("symbol", "risk_index", "risk_level")


# the average is unknown for R and 0 for A: the newest bar's volume stands in
@query("risk_index_volume", _INDEX_SQL.replace("avg(volume) AS av FROM", "CASE WHEN symbol IN ('R', 'A') THEN arg_max(volume, ts) ELSE avg(volume) END AS av FROM"))
def _(spark, sf):
    average = F.when(F.col("symbol") == "A", F.lit(0.0)).when(F.col("symbol") != "R", F.col("avg_volume"))
    rows = _risk_inputs(spark, sf).withColumns({"avg_volume": average, "volume": F.col("last_volume")})
    return risk.risk_index(rows).select("symbol", "risk_index", "risk_level")


@query("custom_performance", f"""WITH {SUPPLIER_SQL}, f AS (SELECT symbol, arg_min(close, ts) AS initial_price,
 arg_max(close, ts) AS final_price, count(*) AS n FROM bars
 WHERE ts >= DATE '1996-01-01' AND ts <= DATE '2000-12-31' GROUP BY 1)
SELECT symbol, round(initial_price,4) AS initial_price, round(final_price,4) AS final_price,
 round((final_price - initial_price) / initial_price * 100, 4) AS return_pct,
 round((pow(final_price / initial_price, 1 / (date_diff('day', DATE '1996-01-01', DATE '2000-12-31') / 365.25)) - 1) * 100, 4) AS cagr
FROM f WHERE n >= 2""")
def _(spark, sf):
    p = risk.custom_performance(supplier_bars(spark, sf), dt.date(1996, 1, 1), dt.date(2000, 12, 31))
    return p.select("symbol", *[rnd(c, 4).alias(c) for c in
                                ("initial_price", "final_price", "return_pct", "cagr")])
