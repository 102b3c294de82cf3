"""Technical indicators, votes and the feature frame (survey 2.6, 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import SEGMENT, positioned
from tickforge.operators import indicators as I
from tickforge.plans.data import AS_OF, AS_OF_SQL, DAY_SQL, FLAG_SQL, SUPPLIER_SQL, day, flag_bars, supplier_bars
from tickforge.plans.registry import query
from tickforge.sources.bars import clean_bars

P = I.MA_PERIODS

# Building blocks of the SQL twins: frames of n rows with a full-window guard.


def _fr(n):
    return f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


def _roll(agg, x, n):
    return f"CASE WHEN count({x}) OVER {_fr(n)} = {n} THEN {agg}({x}) OVER {_fr(n)} END"


def _wma(x, n):
    f = _fr(n)
    return (f"CASE WHEN count({x}) OVER {f} = {n} THEN (sum(pos * {x}) OVER {f} - (pos - {n}) * "
            f"sum({x}) OVER {f}) / {n * (n + 1) / 2} END")


def _ema(x, span):
    a = f"(2.0::DOUBLE / {span + 1})"
    return (f"pow(1 - {a}, pos) * sum(CASE WHEN pos = 0 THEN 1.0 ELSE {a} END * {x} * pow(1 - {a}, -pos)) "
            "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)")


_W = "(PARTITION BY symbol ORDER BY ts)"


def _series_sql(bars_sql=SUPPLIER_SQL, where=""):
    """CTE chain s0..s5 with every indicator column; DuckDB prunes what a query leaves out."""
    s1 = [f"lag(close) OVER {_W} AS pc", f"lag(high) OVER {_W} AS ph", f"lag(low) OVER {_W} AS pl",
          *[f"lag(close, {n}) OVER {_W} AS c{n}" for n in (5, 6, 10, 12, 20, 21, 63, 252, 1260)],
          *[f"{_roll('avg', 'close', p)} AS sma{p}" for p in P],
          *[f"{_wma('close', p)} AS wma{p}" for p in sorted({*P, *[p // 2 for p in P]})],
          *[f"{_ema('close', s)} AS ema{s}" for s in P],
          f"{_ema('close', 12)} - {_ema('close', 26)} AS macd", f"{_ema('close', 15)} AS x1",
          *[f"{_roll('min', 'low', n)} AS lo{n}" for n in (14, 50)],
          *[f"{_roll('max', 'high', n)} AS hi{n}" for n in (14, 50)],
          "(high + low + close) / 3 AS tp",
          *[f"{_roll('sum', 'close - low', n)} AS bp{n}" for n in (7, 14, 28)],
          *[f"{_roll('sum', 'high - low', n)} AS rg{n}" for n in (7, 14, 28)],
          f"{_roll('sum', '((close - low) - (high - close)) / nullif(high - low, 0) * volume', 20)} AS mf20",
          f"{_roll('sum', 'volume', 20)} AS vol20"]
    s2 = ["close - pc AS d", "greatest(high - low, abs(high - pc), abs(low - pc)) AS tr",
          "CASE WHEN ph IS NOT NULL THEN greatest(high - ph, 0) END AS pdm",
          "CASE WHEN pl IS NOT NULL THEN greatest(pl - low, 0) END AS mdm",
          *[f"2 * wma{p // 2} - wma{p} AS h{p}" for p in P],
          f"{_ema('macd', 9)} AS macd_signal", f"{_ema('x1', 15)} AS x2",
          *[f"{_ema(f'ema{p}', p)} AS t{p}_2" for p in P],
          *[f"CASE WHEN count(tp) OVER {_fr(n)} = {n} THEN list(tp) OVER {_fr(n)} END AS l{n}" for n in (20, 50)]]
    s3 = ["CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up",
          "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn",
          f"{_roll('avg', 'tr', 14)} AS atr14",
          f"100 * {_roll('sum', 'pdm', 14)} / nullif({_roll('sum', 'tr', 14)}, 0) AS pdi",
          f"100 * {_roll('sum', 'mdm', 14)} / nullif({_roll('sum', 'tr', 14)}, 0) AS mdi",
          *[f"CASE WHEN count(h{p}) OVER {_fr(int(p ** .5))} = {int(p ** .5)} THEN avg(h{p}) OVER {_fr(int(p ** .5))} END AS hma{p}" for p in P],
          "macd - macd_signal AS macd_hist", f"{_ema('x2', 15)} AS x3",
          *[f"{_ema(f't{p}_2', p)} AS t{p}_3" for p in P],
          *[f"(tp - list_avg(l{n})) / nullif(0.015 * list_avg(list_transform(l{n}, lambda q: abs(q - list_avg(l{n})))), 0) AS cci{n}" for n in (20, 50)]]
    s4 = [*[f"100 * {_roll('avg', 'up', n)} / nullif({_roll('avg', 'up', n)} + {_roll('avg', 'dn', n)}, 0) AS rsi{n}" for n in (14, 7, 21)],
          "abs(pdi - mdi) / nullif(pdi + mdi, 0) * 100 AS dx",
          f"(x3 - lag(x3) OVER {_W}) / nullif(lag(x3) OVER {_W}, 0) * 100 AS trix15",
          *[f"3 * ema{p} - 3 * t{p}_2 + t{p}_3 AS tema{p}" for p in P],
          *[f"100 * (close - lo{n}) / nullif(hi{n} - lo{n}, 0) AS stochastic{n}" for n in (14, 50)],
          *[f"-100 * (hi{n} - close) / nullif(hi{n} - lo{n}, 0) AS williams_r{n}" for n in (14, 50)],
          *[f"(close - c{n}) / c{n} * 100 AS roc{n}" for n in (12, 6)],
          *[f"close - c{n} AS momentum{n}" for n in (10, 20, 63)],
          "100 * (4 * (bp7 / nullif(rg7, 0)) + 2 * (bp14 / nullif(rg14, 0)) + bp28 / nullif(rg28, 0)) / 7 AS ultimate_osc",
          "mf20 / nullif(vol20, 0) AS cmf20",
          *[f"(close - c{n}) / c{n} * 100 AS {k}" for k, n in I.RETURN_STEPS.items()]]
    s5 = [f"{_roll('avg', 'dx', 14)} AS adx14"]
    chain = f"""{bars_sql}, s0 AS (SELECT *, row_number() OVER {_W} - 1 AS pos,
 count(*) OVER (PARTITION BY symbol) AS n FROM bars {where})"""
    for i, cols in enumerate((s1, s2, s3, s4, s5), start=1):
        chain += f",\n s{i} AS (SELECT *, {', '.join(cols)} FROM s{i - 1})"
    return chain


_SERIES = _series_sql()


def _indicator(name, cols, build, digits=2, bars=supplier_bars, chain=_SERIES, segment=SEGMENT):
    sql = (f"WITH {chain} SELECT symbol, {DAY_SQL} AS day, "
           + ", ".join(f"round({c}, {digits}) AS {c}" for c in cols) + " FROM s5")

    @query(name, sql)
    def _(spark, sf):
        s = build(positioned(clean_bars(bars(spark, sf)), segment))
        return s.select("symbol", day().alias("day"), *[rnd(c, digits).alias(c) for c in cols])


_indicator("sma", [f"sma{p}" for p in P], I.with_sma)
_indicator("ema", [f"ema{p}" for p in P], I.with_ma_ema)
# histories of many short segments: the carried value matters
_indicator("ema_segments", [f"ema{p}" for p in P], lambda s: I.with_ma_ema(s, segment=16), segment=16)
_indicator("wma", [f"wma{p}" for p in P], lambda s: I.with_wma(s, P))
_indicator("hma", [f"hma{p}" for p in P], I.with_hma)
_indicator("tema", [f"tema{p}" for p in P], I.with_tema)
_indicator("rsi", ["rsi14", "rsi7", "rsi21"], I.with_rsi)
_indicator("macd", ["macd", "macd_signal"], I.with_macd)
_indicator("macd_hist", ["macd_hist"], I.with_macd)
_indicator("stochastic14", ["stochastic14"], I.with_stochastic)
# the slow form reports the plain 14-bar value: its smoothed line is never used
_indicator("stoch_slow", ["stochastic14"], I.with_stochastic)
_indicator("atr14", ["atr14"], I.with_atr)
_indicator("cci", ["cci20", "cci50"], I.with_cci)
_indicator("adx14", ["adx14"], I.with_adx)
_indicator("williams_r", ["williams_r14", "williams_r50"], lambda s: I.with_stochastic(s, (14, 50)))
_indicator("roc", ["roc12", "roc6"], I.with_change)
_indicator("momentum", ["momentum10", "momentum20", "momentum63"], I.with_change)
_indicator("trix15", ["trix15"], I.with_trix)
_indicator("ultimate_osc", ["ultimate_osc"], I.with_ultimate)
# most supplier days have a single trade and so no range, which leaves no money flow
_indicator("cmf20", ["cmf20"], I.with_cmf, digits=4, bars=flag_bars, chain=_series_sql(FLAG_SQL))


def _band(x, sell, buy):
    return f"CASE WHEN {x} > {sell} THEN 'Sell' WHEN {x} < {buy} THEN 'Buy' ELSE 'Neutral' END"


def _cmp(x, y):
    return f"CASE WHEN {x} > {y} THEN 'Buy' WHEN {x} < {y} THEN 'Sell' ELSE 'Neutral' END"


def _rows_sql(bars_sql, where=f"WHERE ts >= {AS_OF_SQL} - INTERVAL 24 MONTH"):
    ma = [f"SELECT symbol, 'ma' AS grp, '{k.upper()}{p}' AS name, round({k}{p}, 2) AS value, "
          f"{_cmp('close', f'{k}{p}')} AS action FROM last WHERE n >= {p}"
          for p in P for k in ("sma", "ema", "wma", "hma", "tema")]
    osc = [("RSI14", "rsi14", _band("rsi14", 70, 30)), ("MACD", "macd", _cmp("macd", "macd_signal")),
           ("Stochastic14", "stochastic14", _band("stochastic14", 80, 20)), ("ATR14", "atr14", "'Neutral'"),
           *[(f"CCI{n}", f"cci{n}", f"CASE WHEN cci{n} < -100 THEN 'Buy' WHEN cci{n} > 100 THEN 'Sell' ELSE 'Neutral' END") for n in (20, 50)],
           ("ADX14", "adx14", "CASE WHEN adx14 > 25 THEN 'Tendenza Forte' ELSE 'Neutro' END"),
           *[(f"WilliamsR{n}", f"williams_r{n}", _band(f"williams_r{n}", -20, -80)) for n in (14, 50)],
           *[(f"ROC{n}", f"roc{n}", _cmp(f"roc{n}", 0)) for n in (12, 6)],
           *[(f"Momentum{n}", f"momentum{n}", _cmp(f"momentum{n}", 0)) for n in (10, 20)],
           ("Momentum3M", "coalesce(momentum63, 0)", _cmp("momentum63", 0)),
           ("TRIX15", "trix15", _cmp("trix15", 0)), ("UltimateOsc", "ultimate_osc", _band("ultimate_osc", 70, 30)),
           *[(f"RSI{n}", f"rsi{n}", _band(f"rsi{n}", 70, 30)) for n in (7, 21)],
           ("StochSlow", "stochastic14", _band("stochastic14", 80, 20)),
           ("MACD_Hist", "macd_hist", _cmp("macd_hist", 0)), ("CMF20", "cmf20", _cmp("cmf20", 0))]
    rows = ma + [f"SELECT symbol, 'osc', '{n}', round({v}, 2), {a} FROM last" for n, v, a in osc]
    return (_series_sql(bars_sql, where)
            + ",\n last AS MATERIALIZED (SELECT * FROM s5 WHERE pos = n - 1),\n tr AS MATERIALIZED ("
            + "\n UNION ALL ".join(rows) + ")")


VOTES_SQL = """, votes AS (SELECT symbol,
 count(*) FILTER (grp = 'ma' AND action = 'Buy') AS ma_buy, count(*) FILTER (grp = 'ma' AND action = 'Sell') AS ma_sell,
 count(*) FILTER (grp = 'osc' AND action = 'Buy') AS osc_buy, count(*) FILTER (grp = 'osc' AND action = 'Sell') AS osc_sell,
 count(*) FILTER (action = 'Buy') AS buy, count(*) FILTER (action = 'Sell') AS sell,
 count(*) FILTER (action = 'Neutral') AS neutral FROM tr GROUP BY 1),
 sig AS (SELECT *, CASE WHEN ma_buy > ma_sell THEN 'Buy' WHEN ma_sell > ma_buy THEN 'Sell' ELSE 'Neutral' END AS ma_signal,
 CASE WHEN osc_buy > osc_sell THEN 'Buy' WHEN osc_sell > osc_buy THEN 'Sell' ELSE 'Neutral' END AS osc_signal FROM votes),
 summary AS (SELECT symbol, buy, sell, neutral, greatest(buy, sell)::DOUBLE / (buy + sell + neutral) AS strength,
 CASE WHEN buy > greatest(sell, neutral) THEN 'Buy' WHEN sell > greatest(buy, neutral) THEN 'Sell' ELSE 'Neutral' END AS general
 FROM votes)"""
SUPPLIER_ROWS_SQL = _rows_sql(SUPPLIER_SQL)


@query("technicals_rows", f"WITH {_rows_sql(FLAG_SQL)} SELECT * FROM tr")
def _(spark, sf):
    return I.technicals_rows(flag_bars(spark, sf), as_of=AS_OF)


@query("vote_counts", f"""WITH {SUPPLIER_ROWS_SQL}{VOTES_SQL}
SELECT symbol, ma_buy, ma_sell, osc_buy, osc_sell, ma_signal, osc_signal,
 CASE WHEN ma_signal = osc_signal THEN ma_signal ELSE 'Neutral' END AS overall FROM sig""")
def _(spark, sf):
    v = I.vote_counts(I.technicals_rows(supplier_bars(spark, sf), as_of=AS_OF))
    return v.select("symbol", "ma_buy", "ma_sell", "osc_buy", "osc_sell", "ma_signal",
                    "osc_signal", "overall")


@query("tech_summary", f"""WITH {_rows_sql(FLAG_SQL)}{VOTES_SQL}
SELECT symbol, buy, sell, neutral, round(strength, 6) AS strength, general,
 CASE WHEN strength > 0.7 THEN 'Strong' WHEN strength > 0.55 THEN 'Moderate' ELSE 'Weak' END AS strength_label
FROM summary""")
def _(spark, sf):
    t = I.tech_summary(I.vote_counts(I.technicals_rows(flag_bars(spark, sf), as_of=AS_OF)))
    return t.select("symbol", "buy", "sell", "neutral", rnd("strength", 6).alias("strength"),
                    "general", "strength_label")


@query("technicals_summary", f"""WITH {SUPPLIER_ROWS_SQL}{VOTES_SQL}
SELECT symbol, buy, sell, neutral, ma_signal, osc_signal, general,
 CASE WHEN ma_signal = osc_signal THEN ma_signal ELSE 'Neutral' END AS overall,
 CASE WHEN strength > 0.7 THEN 'Strong' WHEN strength > 0.55 THEN 'Moderate' ELSE 'Weak' END AS strength_label
FROM sig JOIN summary USING (symbol, buy, sell, neutral)""")
def _(spark, sf):
    t = I.tech_summary(I.vote_counts(I.technicals_rows(supplier_bars(spark, sf), as_of=AS_OF)))
    return t.select("symbol", "buy", "sell", "neutral", "ma_signal", "osc_signal", "general",
                    "overall", "strength_label")


@query("feature_frame", f"""WITH {_series_sql(FLAG_SQL)}, f AS (SELECT symbol, ts, {', '.join(I.FEATURES)} FROM s5
 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in I.FEATURES)})
SELECT symbol, {DAY_SQL} AS day, {', '.join(f'round({c}, 3) AS {c}' for c in I.FEATURES)} FROM f
QUALIFY count(*) OVER (PARTITION BY symbol) >= 50""")
def _(spark, sf):
    f = I.feature_frame(flag_bars(spark, sf), as_of=AS_OF)
    return f.select("symbol", day().alias("day"), *[rnd(c, 3).alias(c) for c in I.FEATURES])
