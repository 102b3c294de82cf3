"""Technical indicators as series columns, and the votes on each symbol's newest bar.

All functions take a positioned series (``functions.windows.positioned``) with clean OHLCV and
add columns; unused ones are pruned by Catalyst, so a query pays for what it selects. Means are
window aggregates over their frame at every length: differences of running sums would lose the digits
of small prices after large ones.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import SEGMENT, along, positioned, roll, with_ema
from tickforge.sources.bars import clean_bars, in_period

MA_PERIODS = (10, 20, 50, 100, 200)

def _full(p: int) -> Column:
    return F.col("pos") >= F.lit(p - 1)


def with_sma(s: DataFrame, periods: Iterable[int] = MA_PERIODS) -> DataFrame:
    return s.withColumns({f"sma{p}": roll(F.avg, F.col("close"), p, along()) for p in periods})


def with_ma_ema(s: DataFrame, periods: Iterable[int] = MA_PERIODS, segment: int = SEGMENT) -> DataFrame:
    return with_ema(s, {f"ema{p}": ("close", p) for p in periods}, segment)


def with_wma(s: DataFrame, periods: Iterable[int]) -> DataFrame:
    """Weights 1..p, newest heaviest: two sums over the frame, of closes and of places times closes."""
    out = {}
    for p in sorted(set(periods)):
        frame = along().rowsBetween(-(p - 1), 0)
        plain = F.sum("close").over(frame)
        # the weight of a row is its place, counted from the row before the frame
        placed = F.sum(F.col("pos") * F.col("close")).over(frame) - (F.col("pos") - p) * plain
        out[f"wma{p}"] = F.when(_full(p), placed / F.lit(p * (p + 1) / 2))
    return s.withColumns(out)


def with_hma(s: DataFrame, periods: Iterable[int] = MA_PERIODS) -> DataFrame:
    """``2*WMA(p/2) - WMA(p)``, then a plain mean over int(sqrt(p)) rows."""
    periods = list(periods)
    have = set(s.columns)
    need = {q for p in periods for q in (p, p // 2)}
    s = with_wma(s, [q for q in need if f"wma{q}" not in have])
    s = s.withColumns({f"_h{p}": F.lit(2.0) * F.col(f"wma{p // 2}") - F.col(f"wma{p}")
                       for p in periods})
    s = s.withColumns({f"hma{p}": roll(F.avg, F.col(f"_h{p}"), math.isqrt(p), along())
                       for p in periods})
    return s.drop(*[f"_h{p}" for p in periods])


def _triple(s: DataFrame, names: dict[str, int]) -> DataFrame:
    """EMA of EMA of EMA: ``{tag: span}`` -> ``_{tag}1.._{tag}3``."""
    for level in (1, 2, 3):
        source = (lambda t: "close") if level == 1 else (lambda t, lv=level: f"_{t}{lv - 1}")
        s = with_ema(s, {f"_{t}{level}": (source(t), span) for t, span in names.items()})
    return s


def with_tema(s: DataFrame, periods: Iterable[int] = MA_PERIODS) -> DataFrame:
    tags = {f"t{p}x": p for p in periods}
    s = _triple(s, tags)
    s = s.withColumns({f"tema{p}": F.lit(3.0) * F.col(f"_{t}1") - F.lit(3.0) * F.col(f"_{t}2")
                       + F.col(f"_{t}3") for t, p in tags.items()})
    return s.drop(*[f"_{t}{i}" for t in tags for i in (1, 2, 3)])


def with_trix(s: DataFrame, span: int = 15) -> DataFrame:
    s = _triple(s, {"x": span})
    prev = F.lag("_x3").over(along())
    return (s.withColumn(f"trix{span}", F.try_divide(F.col("_x3") - prev, prev) * 100)
            .drop("_x1", "_x2", "_x3"))


def with_macd(s: DataFrame) -> DataFrame:
    s = with_ema(s, {"_e12": ("close", 12), "_e26": ("close", 26)})
    s = s.withColumn("macd", F.col("_e12") - F.col("_e26"))
    s = with_ema(s, {"macd_signal": ("macd", 9)})
    return s.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_e12", "_e26")


def with_rsi(s: DataFrame, periods: Iterable[int] = (14, 7, 21)) -> DataFrame:
    """Simple means of gains and losses; no losses -> 100, no moves -> null."""
    change = F.col("close") - F.lag("close").over(along())
    s = s.withColumn("_d", change)
    up = F.greatest(F.col("_d"), F.lit(0.0))
    down = F.greatest(-F.col("_d"), F.lit(0.0))
    s = s.withColumns({"_up": F.when(F.col("_d").isNotNull(), up),
                       "_dn": F.when(F.col("_d").isNotNull(), down)})
    cols = {}
    for p in periods:
        u, d = (roll(F.avg, F.col(c), p, along()) for c in ("_up", "_dn"))
        cols[f"rsi{p}"] = F.try_divide(100 * u, u + d)
    return s.withColumns(cols).drop("_d", "_up", "_dn")


def with_stochastic(s: DataFrame, periods: Iterable[int] = (14,)) -> DataFrame:
    """Position of the close in the p-bar range: %K and Williams %R."""
    cols = {}
    for p in periods:
        low = roll(F.min, F.col("low"), p, along())
        high = roll(F.max, F.col("high"), p, along())
        cols[f"stochastic{p}"] = F.try_divide(100 * (F.col("close") - low), high - low)
        cols[f"williams_r{p}"] = F.try_divide(-100 * (high - F.col("close")), high - low)
    return s.withColumns(cols)


def _true_range() -> Column:
    prev = F.lag("close").over(along())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                      F.abs(F.col("low") - prev))


def with_atr(s: DataFrame, p: int = 14) -> DataFrame:
    s = s.withColumn("_tr", _true_range())
    return s.withColumn(f"atr{p}", roll(F.avg, F.col("_tr"), p, along())).drop("_tr")


def with_adx(s: DataFrame, p: int = 14) -> DataFrame:
    """Directional moves are clipped at zero but not compared with each other."""
    def clipped(move):
        return F.when(move.isNotNull(), F.greatest(move, F.lit(0.0)))

    s = s.withColumns({
        "_tr": _true_range(),
        "_pdm": clipped(F.col("high") - F.lag("high").over(along())),
        "_mdm": clipped(F.lag("low").over(along()) - F.col("low"))})
    tr = roll(F.sum, F.col("_tr"), p, along())
    s = s.withColumns({"_pdi": F.try_divide(100 * roll(F.sum, F.col("_pdm"), p, along()), tr),
                       "_mdi": F.try_divide(100 * roll(F.sum, F.col("_mdm"), p, along()), tr)})
    dx = F.try_divide(F.abs(F.col("_pdi") - F.col("_mdi")), F.col("_pdi") + F.col("_mdi")) * 100
    s = s.withColumn("_dx", dx)
    return (s.withColumn(f"adx{p}", roll(F.avg, F.col("_dx"), p, along()))
            .drop("_tr", "_pdm", "_mdm", "_pdi", "_mdi", "_dx"))


def _abs_deviation(values: Column, center: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - center))


def with_cci(s: DataFrame, periods: Iterable[int] = (20, 50)) -> DataFrame:
    """Mean deviation is taken around each window's own mean."""
    periods = list(periods)
    s = s.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    s = s.withColumns({f"_tps{p}": F.collect_list("_tp").over(along().rowsBetween(-(p - 1), 0))
                       for p in periods})
    s = s.withColumns({f"_tpm{p}": roll(F.avg, F.col("_tp"), p, along()) for p in periods})
    s = s.withColumns({f"cci{p}": F.try_divide(
        F.col("_tp") - F.col(f"_tpm{p}"),
        F.lit(0.015) * _abs_deviation(F.col(f"_tps{p}"), F.col(f"_tpm{p}")) / F.lit(float(p)))
        for p in periods})
    return s.drop("_tp", *[f"_tps{p}" for p in periods], *[f"_tpm{p}" for p in periods])


def with_change(s: DataFrame, roc: Iterable[int] = (12, 6),
                momentum: Iterable[int] = (10, 20, 63)) -> DataFrame:
    cols = {}
    for n in roc:
        old = F.lag("close", n).over(along())
        cols[f"roc{n}"] = F.try_divide(F.col("close") - old, old) * 100
    for n in momentum:
        cols[f"momentum{n}"] = F.col("close") - F.lag("close", n).over(along())
    return s.withColumns(cols)


def with_ultimate(s: DataFrame) -> DataFrame:
    """Weights 4/2/1 over 7/14/28 bars; the true low is the bar's own low."""
    pressure, span = F.col("close") - F.col("low"), F.col("high") - F.col("low")
    avg = {n: F.try_divide(roll(F.sum, pressure, n, along()), roll(F.sum, span, n, along()))
           for n in (7, 14, 28)}
    return s.withColumn("ultimate_osc", 100 * (4 * avg[7] + 2 * avg[14] + avg[28]) / 7)


def with_cmf(s: DataFrame, p: int = 20) -> DataFrame:
    """A bar without range has no money flow, which empties every frame that holds it."""
    flow = F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")),
                        F.col("high") - F.col("low")) * F.col("volume")
    return s.withColumn(f"cmf{p}", F.try_divide(roll(F.sum, flow, p, along()),
                                                roll(F.sum, F.col("volume"), p, along())))


# --- votes -------------------------------------------------------------------------------

def _cmp(x: Column, y: Column) -> Column:
    return F.when(x > y, "Buy").when(x < y, "Sell").otherwise("Neutral")


def _band_sql(x: str, sell_above: float, buy_below: float) -> str:
    return f"CASE WHEN {x} > {sell_above} THEN 'Sell' WHEN {x} < {buy_below} THEN 'Buy' ELSE 'Neutral' END"


def _cmp_sql(x: str, y: str) -> str:
    return f"CASE WHEN {x} > {y} THEN 'Buy' WHEN {x} < {y} THEN 'Sell' ELSE 'Neutral' END"


def _tail(a: str, n: int) -> str:
    return f"slice({a}, -{n}, {n})"


def _sum_sql(a: str) -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + x)"


def _dot_sql(weights: list[float], n: int) -> str:
    w = ", ".join(f"{x!r}D" for x in weights)
    return _sum_sql(f"zip_with({_tail('c', n)}, array({w}), (x, w) -> x * w)")


def _wma_weights(p: int, length: int, shift: int) -> list[float]:
    """Weights of WMA(p) ended ``shift`` bars ago, over the last ``length`` bars."""
    out = [0.0] * length
    for k in range(p):
        out[length - shift - p + k] = (k + 1) / (p * (p + 1) / 2)
    return out


def _hma_weights(p: int) -> list[float]:
    """HMA is linear in the closes too: one list of weights over its p + sqrt(p) - 1 bars."""
    half, root = p // 2, math.isqrt(p)
    n = p + root - 1
    out = [0.0] * n
    for shift in range(root):
        a, b = _wma_weights(half, n, shift), _wma_weights(p, n, shift)
        out = [o + (2 * x - y) / root for o, x, y in zip(out, a, b)]
    return out


def _ema_pass() -> str:
    """One fold over the closes that carries every exponential mean of the summary."""
    def step(prev, x, span):
        a = 2.0 / (span + 1.0)
        return f"({a!r}D * {x} + {1.0 - a!r}D * {prev})"

    first, fields = [], []

    def add(name, init, expr):
        first.append(f"{init} AS {name}")
        fields.append(f"{expr} AS {name}")

    for p in MA_PERIODS + (15,):
        e1 = step(f"s.e{p}", "x", p)
        e2 = step(f"s.f{p}", e1, p)
        e3 = step(f"s.g{p}", e2, p)
        for name, e in (("e", e1), ("f", e2), ("g", e3)):
            add(f"{name}{p}", "c[0]", e)
    add("old15", "CAST(NULL AS DOUBLE)", "s.g15")
    e12, e26 = step("s.e12", "x", 12), step("s.e26", "x", 26)
    add("e12", "c[0]", e12)
    add("e26", "c[0]", e26)
    add("sig", "0D", step("s.sig", f"({e12} - {e26})", 9))
    return (f"aggregate(slice(c, 2, greatest(n - 1, 0)), struct({', '.join(first)}), "
            f"(s, x) -> struct({', '.join(fields)}))")


def _latest_columns() -> list[dict[str, str]]:
    """SQL of the newest bar's values over the arrays c, h, l, v of n bars; in two layers
    where a value is needed more than once."""
    first: dict[str, str] = {"m": _ema_pass(), "last": "c[n - 1]"}
    out: dict[str, str] = {}
    for p in MA_PERIODS:
        out[f"sma{p}"] = f"{_sum_sql(_tail('c', p))} / {p}D"
        out[f"wma{p}"] = _dot_sql(_wma_weights(p, p, 0), p)
        n = p + math.isqrt(p) - 1
        out[f"hma{p}"] = f"CASE WHEN n >= {n} THEN {_dot_sql(_hma_weights(p), n)} END"
        out[f"ema{p}"] = f"m.e{p}"
        out[f"tema{p}"] = f"3 * m.e{p} - 3 * m.f{p} + m.g{p}"
    out["macd"], out["macd_signal"] = "m.e12 - m.e26", "m.sig"
    out["macd_hist"] = "m.e12 - m.e26 - m.sig"
    out["trix15"] = "try_divide(m.g15 - m.old15, m.old15) * 100"
    for p in (14, 7, 21):
        first[f"d{p}"] = f"zip_with({_tail('c', p)}, slice(c, -{p + 1}, {p}), (x, y) -> x - y)"
        up = f"aggregate(d{p}, 0D, (s, x) -> s + greatest(x, 0D))"
        down = f"aggregate(d{p}, 0D, (s, x) -> s + greatest(-x, 0D))"
        out[f"rsi{p}"] = f"CASE WHEN n > {p} THEN try_divide(100 * {up}, {up} + {down}) END"
    for p in (14, 50):
        hi, lo = f"array_max({_tail('h', p)})", f"array_min({_tail('l', p)})"
        out[f"stochastic{p}"] = f"CASE WHEN n >= {p} THEN try_divide(100 * (last - {lo}), {hi} - {lo}) END"
        out[f"williams_r{p}"] = f"CASE WHEN n >= {p} THEN try_divide(-100 * ({hi} - last), {hi} - {lo}) END"
    # the last 27 bars: true range and directional moves, null where no bar precedes
    first["tr"] = ("transform(sequence(n - 27, n - 1), i -> greatest(get(h, i) - get(l, i), "
                   "abs(get(h, i) - get(c, i - 1)), abs(get(l, i) - get(c, i - 1))))")
    first["up"] = "transform(sequence(n - 27, n - 1), i -> get(h, i) - get(h, i - 1))"
    first["down"] = "transform(sequence(n - 27, n - 1), i -> get(l, i - 1) - get(l, i))"
    out["atr14"] = f"CASE WHEN n >= 14 THEN {_sum_sql(_tail('tr', 14))} / 14D END"

    def moved(a):
        return f"aggregate(slice({a}, j, 14), 0D, (s, x) -> s + greatest(x, 0D))"

    # both lines share the range sum as divisor, which cancels unless it is zero
    dx = (f"CASE WHEN aggregate(slice(tr, j, 14), 0D, (s, x) -> s + x) <> 0 THEN "
          f"try_divide(abs({moved('up')} - {moved('down')}), {moved('up')} + {moved('down')}) * 100 END")
    out["adx14"] = f"CASE WHEN n >= 28 THEN {_sum_sql(f'transform(sequence(1, 14), j -> {dx})')} / 14D END"
    for p in (20, 50):
        first[f"tp{p}"] = (f"zip_with(zip_with({_tail('h', p)}, {_tail('l', p)}, (x, y) -> x + y), "
                           f"{_tail('c', p)}, (x, y) -> (x + y) / 3)")
    out_mean = {f"tpm{p}": f"{_sum_sql(f'tp{p}')} / {p}D" for p in (20, 50)}
    for p in (20, 50):
        dev = f"aggregate(tp{p}, 0D, (s, x) -> s + abs(x - tpm{p})) / {p}D"
        out[f"cci{p}"] = f"CASE WHEN n >= {p} THEN try_divide(element_at(tp{p}, -1) - tpm{p}, 0.015D * {dev}) END"
    for k in (12, 6):
        out[f"roc{k}"] = f"try_divide(last - get(c, n - 1 - {k}), get(c, n - 1 - {k})) * 100"
    for k in (10, 20, 63):
        out[f"momentum{k}"] = f"last - get(c, n - 1 - {k})"

    def ratio(k):
        press = _sum_sql(f"zip_with({_tail('c', k)}, {_tail('l', k)}, (x, y) -> x - y)")
        span = _sum_sql(f"zip_with({_tail('h', k)}, {_tail('l', k)}, (x, y) -> x - y)")
        return f"try_divide({press}, {span})"

    out["ultimate_osc"] = f"CASE WHEN n >= 28 THEN 100 * (4 * {ratio(7)} + 2 * {ratio(14)} + {ratio(28)}) / 7 END"
    flow = ("transform(sequence(n - 20, n - 1), i -> try_divide((get(c, i) - get(l, i)) - "
            "(get(h, i) - get(c, i)), get(h, i) - get(l, i)) * get(v, i))")
    out["cmf20"] = f"CASE WHEN n >= 20 THEN try_divide({_sum_sql(flow)}, {_sum_sql(_tail('v', 20))}) END"
    return [first, out_mean, out]


def latest_indicators(bars: DataFrame) -> DataFrame:
    """All indicator values of each symbol's newest bar, and its number of bars ``n``.

    The summary looks at a bounded period (two years of days, sixty days of hours), so a symbol
    is one short array. One group-by collects it and folds evaluate only the newest bar,
    where the series columns above would evaluate every bar.
    """
    cell = F.struct("ts", "high", "low", "close", "volume")
    s = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(cell)).alias("b"))
    s = s.selectExpr("symbol", "b.close AS c", "b.high AS h", "b.low AS l", "b.volume AS v",
                     "size(b) AS n")
    for layer in _latest_columns():
        s = s.selectExpr("*", *[f"{sql} AS {name}" for name, sql in layer.items()])
    return s


def _vote_rows() -> list[str]:
    rows = []
    for p in MA_PERIODS:
        for kind in ("sma", "ema", "wma", "hma", "tema"):
            v = f"{kind}{p}"
            rows.append(f"CASE WHEN n >= {p} THEN struct('ma' AS grp, '{v.upper()}' AS name, {v} AS value, "
                        f"{_cmp_sql('last', v)} AS action) END")
    cci = {p: f"CASE WHEN cci{p} < -100 THEN 'Buy' WHEN cci{p} > 100 THEN 'Sell' ELSE 'Neutral' END"
           for p in (20, 50)}
    mom3 = "coalesce(momentum63, 0D)"
    oscillators = [
        ("RSI14", "rsi14", _band_sql("rsi14", 70, 30)),
        ("MACD", "macd", _cmp_sql("macd", "macd_signal")),
        ("Stochastic14", "stochastic14", _band_sql("stochastic14", 80, 20)),
        ("ATR14", "atr14", "'Neutral'"),
        ("CCI20", "cci20", cci[20]),
        ("ADX14", "adx14", "CASE WHEN adx14 > 25 THEN 'Tendenza Forte' ELSE 'Neutro' END"),
        ("WilliamsR14", "williams_r14", _band_sql("williams_r14", -20, -80)),
        ("ROC12", "roc12", _cmp_sql("roc12", "0")),
        ("Momentum10", "momentum10", _cmp_sql("momentum10", "0")),
        ("Momentum3M", mom3, _cmp_sql(mom3, "0")),
        ("TRIX15", "trix15", _cmp_sql("trix15", "0")),
        ("UltimateOsc", "ultimate_osc", _band_sql("ultimate_osc", 70, 30)),
        ("CCI50", "cci50", cci[50]),
        ("RSI7", "rsi7", _band_sql("rsi7", 70, 30)),
        ("RSI21", "rsi21", _band_sql("rsi21", 70, 30)),
        ("StochSlow", "stochastic14", _band_sql("stochastic14", 80, 20)),
        ("WilliamsR50", "williams_r50", _band_sql("williams_r50", -20, -80)),
        ("MACD_Hist", "macd_hist", _cmp_sql("macd_hist", "0")),
        ("ROC6", "roc6", _cmp_sql("roc6", "0")),
        ("Momentum20", "momentum20", _cmp_sql("momentum20", "0")),
        ("CMF20", "cmf20", _cmp_sql("cmf20", "0"))]
    for name, value, action in oscillators:
        rows.append(f"struct('osc' AS grp, '{name}' AS name, CAST({value} AS DOUBLE) AS value, {action} AS action)")
    return rows


def technicals_rows(bars: DataFrame, timeframe: str = "1d",
                    as_of: dt.date | None = None) -> DataFrame:
    """Long form ``(symbol, grp, name, value, action)`` for each symbol's newest bar."""
    if as_of is not None:
        bars = in_period(bars, "technicals", timeframe, as_of)
    last = latest_indicators(clean_bars(bars))
    rows = last.selectExpr("symbol", f"inline(array_compact(array({', '.join(_vote_rows())})))")
    return rows.withColumn("value", rnd("value", 2))


def vote_counts(rows: DataFrame) -> DataFrame:
    """Buy/sell counts of both lists; the overall vote needs both lists to agree."""
    def n(grp, action):
        return F.count_if((F.col("grp") == grp) & (F.col("action") == action))

    out = rows.groupBy("symbol").agg(
        n("ma", "Buy").alias("ma_buy"), n("ma", "Sell").alias("ma_sell"),
        n("ma", "Neutral").alias("ma_neutral"),
        n("osc", "Buy").alias("osc_buy"), n("osc", "Sell").alias("osc_sell"),
        n("osc", "Neutral").alias("osc_neutral"))
    ma = _cmp(F.col("ma_buy"), F.col("ma_sell"))
    osc = _cmp(F.col("osc_buy"), F.col("osc_sell"))
    out = out.withColumns({"ma_signal": ma, "osc_signal": osc})
    agree = F.when((F.col("ma_signal") == F.col("osc_signal")), F.col("ma_signal"))
    return out.withColumn("overall", F.coalesce(agree, F.lit("Neutral")))


def tech_summary(votes: DataFrame) -> DataFrame:
    """Totals over both lists, strength and the strict-majority signal."""
    out = votes.withColumns({a.lower(): F.col(f"ma_{a.lower()}") + F.col(f"osc_{a.lower()}")
                             for a in ("Buy", "Sell", "Neutral")})
    b, s, n = F.col("buy"), F.col("sell"), F.col("neutral")
    out = out.withColumn("strength", F.coalesce(
        F.try_divide(F.greatest(b, s).cast("double"), b + s + n), F.lit(0.0)))
    return out.withColumns({
        "strength_label": F.when(F.col("strength") > 0.7, "Strong")
        .when(F.col("strength") > 0.55, "Moderate").otherwise("Weak"),
        "general": F.when(b > F.greatest(s, n), "Buy").when(s > F.greatest(b, n), "Sell")
        .otherwise("Neutral")})


# --- the 25 variables of the correlation study --------------------------------------------

FEATURES = ("return_1w", "return_1m", "return_3m", "return_1y", "return_5y",
            "sma10", "ema10", "sma50", "ema50", "sma200", "ema200", "rsi14", "macd",
            "macd_hist", "stochastic14", "williams_r14", "cci20", "adx14", "roc12",
            "momentum10", "momentum20", "momentum63", "trix15", "cmf20", "ultimate_osc")


def with_returns(s: DataFrame, steps: dict[str, int]) -> DataFrame:
    """Percent change against the close ``n`` bars back."""
    cols = {}
    for name, n in steps.items():
        old = F.lag("close", n).over(along())
        cols[name] = F.try_divide(F.col("close") - old, old) * 100
    return s.withColumns(cols)


RETURN_STEPS = {"return_1w": 5, "return_1m": 21, "return_3m": 63, "return_1y": 252,
                "return_5y": 1260}


def feature_frame(bars: DataFrame, least: int = 50, as_of: dt.date | None = None) -> DataFrame:
    """Complete rows of the 25 variables, for symbols that have at least ``least`` of them."""
    if as_of is not None:
        bars = in_period(bars, "correlation", "1d", as_of)
    s = positioned(clean_bars(bars))
    s = with_returns(s, RETURN_STEPS)
    s = with_sma(s, (10, 50, 200))
    s = with_rsi(s, (14,))
    s = with_stochastic(s, (14,))
    s = with_cci(s, (20,))
    s = with_adx(s)
    s = with_change(s, roc=(12,))
    s = with_cmf(s)
    s = with_ultimate(s)
    s = with_ma_ema(s, (10, 50, 200))
    s = with_macd(s)
    s = with_trix(s)
    full = s.select("symbol", "ts", *FEATURES).na.drop()
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return full.withColumn("_n", size).where(F.col("_n") >= least).drop("_n")
