"""Composite trading signal: one row per symbol in, one row per symbol out.

``signal_inputs`` gathers the parts by symbol; everything after it is a projection, so the
stages below add no shuffle. Column expressions are SQL texts because a step reads like the
rule it implements.

Input columns: price, support and resistance (arrays of level prices), gap_up and gap_down
(nearest open gap above and below the price: struct start, end, center, dist), current_median,
next_median, general, strength, buy, sell, neutral, state, state_strength, close_prob.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import positioned, tail_rows
from tickforge.operators import gaps as G
from tickforge.operators import seasonality as S
from tickforge.operators import zones as Z
from tickforge.operators.indicators import tech_summary, technicals_rows, vote_counts
from tickforge.sources.bars import clean_bars_strict, in_period, period_start, resample, slots, whole_slots
from tickforge.sources.stored import stored_by_symbol

# Weights of the five scores with and without the technical filter.
WEIGHTS = {True: {"sr": 0.32, "gap": 0.23, "season": 0.20, "tech": 0.17, "market": 0.10},
           False: {"sr": 0.40, "gap": 0.25, "season": 0.25, "tech": 0.0, "market": 0.10}}
# Least strength, damping of contradicted scores, words of market states.
MIN_TECH_STRENGTH = 55
DENIAL = {"season": 0.72, "tech": 0.68, "market": 0.80}

BUY_WORDS = ("BUY", "BULL", "SUPPORT", "LONG")
SELL_WORDS = ("SELL", "BEAR", "RESIST", "SHORT")
# Opt-in: gives the zone states the direction their names suggest.
ZONE_STATES = {"IN_DEMAND": 1, "IN_SUPPLY": -1}


def _clamp(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}D), {hi}D)"


def season_score(df: DataFrame) -> DataFrame:
    """Change of the cumulative median from this month to the next."""
    delta = "(next_median - current_median)"
    return df.selectExpr(
        "*", f"CASE WHEN {delta} IS NULL THEN 0D ELSE {_clamp(f'{delta} / 10', -1, 1)} END AS season_score",
        f"CASE WHEN {delta} > 0.15D THEN 'up' WHEN {delta} < -0.15D THEN 'down' ELSE 'neutral' END "
        "AS season_direction")


def sr_score(df: DataFrame) -> DataFrame:
    """Closer to support is bullish, closer to resistance bearish; one-sided levels +-0.35."""
    df = df.withColumns({
        "supports": Z.nearest_levels(F.col("support"), F.col("price"), below=True),
        "resistances": Z.nearest_levels(F.col("resistance"), F.col("price"), below=False)})
    df = df.selectExpr("*", "get(supports, 0) AS _s", "get(resistances, 0) AS _r")
    part = "try_divide((_r - price) - (price - _s), (_r - price) + (price - _s))"
    df = df.selectExpr(
        "*", f"CASE WHEN _s IS NOT NULL AND _r IS NOT NULL THEN coalesce({_clamp(part, -1, 1)}, 0D) "
        "WHEN _s IS NOT NULL THEN 0.35D WHEN _r IS NOT NULL THEN -0.35D ELSE 0D END AS sr_score")
    return df.selectExpr("* EXCEPT (_s, _r)", "CASE WHEN sr_score > 0.08D THEN 'up' "
                         "WHEN sr_score < -0.08D THEN 'down' ELSE 'neutral' END AS trend")


def gap_score(df: DataFrame) -> DataFrame:
    """Nearest open gap in the trend's direction, weighted by distance and closing odds."""
    df = df.selectExpr(
        "*", "CASE WHEN trend = 'up' THEN gap_up WHEN trend = 'down' THEN gap_down "
        "WHEN gap_up IS NULL OR gap_down.dist < gap_up.dist THEN coalesce(gap_down, gap_up) "
        "ELSE gap_up END AS target_gap")
    df = df.selectExpr("*", "CASE WHEN target_gap IS NULL THEN 'none' WHEN target_gap.center >= price "
                       "THEN 'up' ELSE 'down' END AS target_direction",
                       "CASE WHEN target_gap.center >= price THEN 1D ELSE -1D END AS _sign")
    base = f"_sign * {_clamp('1 - abs(target_gap.center - price) / price * 100 / 9', 0.15, 1)}"
    edge = _clamp("(close_prob - 50) / 50", -1, 1)
    blend = _clamp(f"{base} * 0.8D + _sign * {edge} * 0.25D", -1, 1)
    return df.selectExpr("* EXCEPT (_sign)", f"CASE WHEN target_gap IS NULL THEN 0D WHEN close_prob IS NULL "
                         f"THEN {base} ELSE {blend} END AS gap_score")


def tech_score(df: DataFrame, use_filter: bool = True) -> DataFrame:
    if not use_filter:
        return df.selectExpr("*", "CAST(NULL AS DOUBLE) AS tech_strength_pct",
                             "'neutral' AS tech_direction", "0D AS tech_score")
    df = df.selectExpr(
        "*", f"{_clamp('strength * 100', 0, 100)} AS _p",
        "CASE WHEN lower(coalesce(general, '')) LIKE '%buy%' THEN 'up' "
        "WHEN lower(coalesce(general, '')) LIKE '%sell%' THEN 'down' ELSE 'neutral' END AS tech_direction",
        "coalesce(try_divide(CAST(coalesce(buy, 0) - coalesce(sell, 0) AS DOUBLE), "
        "coalesce(buy, 0) + coalesce(sell, 0) + coalesce(neutral, 0)), 0D) AS _diff")
    df = df.selectExpr("* EXCEPT (_p)", "CASE WHEN strength IS NOT NULL THEN _p END AS tech_strength_pct")
    edge = f"CASE WHEN tech_strength_pct IS NULL THEN 0D ELSE {_clamp('(tech_strength_pct - 50) / 45', -1, 1)} END"
    raw = _clamp(f"({edge}) * 0.65D + _diff * 0.35D", -1, 1)
    return df.selectExpr("* EXCEPT (_diff)", f"CASE tech_direction WHEN 'up' THEN greatest({raw}, 0.15D) "
                         f"WHEN 'down' THEN least({raw}, -0.15D) ELSE {raw} END AS tech_score")


def market_score(df: DataFrame, states: dict[str, int] | None = None) -> DataFrame:
    """Direction by words in the state; zone states carry none of them unless mapped."""
    mapped = " ".join(f"WHEN upper(state) = '{k}' THEN {v}" for k, v in (states or {}).items())
    buy, sell = "|".join(BUY_WORDS), "|".join(SELL_WORDS)
    df = df.selectExpr("*", f"CASE {mapped} WHEN upper(coalesce(state, '')) RLIKE '{buy}' THEN 1 "
                       f"WHEN upper(coalesce(state, '')) RLIKE '{sell}' THEN -1 ELSE 0 END AS market_direction",
                       f"{_clamp('coalesce(state_strength, 0D)', 0, 100)} AS _p")
    return df.selectExpr("* EXCEPT (_p)", "market_direction * "
                         + _clamp("0.35D + (_p / 100) * 0.65D", 0, 1) + " AS market_score")


def denial_and_setup(df: DataFrame, use_filter: bool = True,
                     least: float = MIN_TECH_STRENGTH) -> DataFrame:
    """Contradictions to the trend, and whether the conditions of an entry hold."""
    strong = f"(tech_strength_pct IS NULL OR tech_strength_pct >= {least})"
    tech_ok = {d: f"tech_direction <> '{d}' AND {strong}" if use_filter else "true" for d in ("down", "up")}
    denies = "(trend <> 'neutral' AND {0} <> 'neutral' AND {0} <> trend)"
    df = df.selectExpr(
        "*", f"{denies.format('season_direction')} AS season_denies",
        (denies.format("tech_direction") if use_filter else "false") + " AS tech_denies",
        "((trend = 'up' AND market_direction < 0) OR (trend = 'down' AND market_direction > 0)) AS market_denies",
        "(trend = 'up' AND target_direction = 'up') AS long_setup",
        "(trend = 'down' AND target_direction = 'down') AS short_setup",
        "season_direction <> 'down' AS season_long_ok", "season_direction <> 'up' AS season_short_ok",
        f"({tech_ok['down']}) AS _tl", f"({tech_ok['up']}) AS _ts")
    return df.selectExpr("* EXCEPT (_tl, _ts)",
                         "(long_setup AND season_long_ok AND _tl) AS confirmed_buy",
                         "(short_setup AND season_short_ok AND _ts) AS confirmed_sell")


def month_end_bonus(df: DataFrame, as_of: dt.date) -> DataFrame:
    """In the month's last five days a sign change of the medians counts eight points."""
    day = f"DATE '{as_of.isoformat()}'"
    df = df.selectExpr("*", "coalesce(current_median < 0 AND next_median > 0, false) AS month_end_buy",
                       "coalesce(current_median > 0 AND next_median < 0, false) AS month_end_sell",
                       f"(day({day}) >= day(last_day({day})) - 4) AS _end")
    return df.selectExpr("* EXCEPT (_end)", "CASE WHEN _end AND month_end_buy THEN 8D "
                         "WHEN _end AND month_end_sell THEN -8D ELSE 0D END AS month_end_bonus")


def directional_score(df: DataFrame, use_filter: bool = True) -> DataFrame:
    total = " + ".join(f"{k}_score * {w}D" for k, w in WEIGHTS[use_filter].items())
    damp = " * ".join(f"CASE WHEN {k}_denies THEN {f}D ELSE 1D END" for k, f in DENIAL.items())
    return df.selectExpr("*", f"{_clamp(f'({total}) * {damp}', -1, 1)} AS score")


def votes(df: DataFrame, use_filter: bool = True) -> DataFrame:
    """Each block votes with strength 0, 1 (from .16) or 2 (from .5) for its side."""
    blocks = ["sr_score", "gap_score", "season_score", "market_score"] + ["tech_score"] * use_filter

    def side(sign):
        weight = [f"CASE WHEN {sign}{b} >= 0.5D THEN 2 WHEN {sign}{b} >= 0.16D THEN 1 ELSE 0 END" for b in blocks]
        return " + ".join(weight)

    df = df.selectExpr("*", f"{side('')} AS bullish", f"{side('-')} AS bearish")
    return df.selectExpr(
        "*", "coalesce(try_divide(CAST(bullish - bearish AS DOUBLE), bullish + bearish), 0D) AS consensus",
        "coalesce(try_divide(CAST(greatest(bullish, bearish) AS DOUBLE), bullish + bearish), 0D) AS alignment")


def confidence(df: DataFrame, use_filter: bool = True) -> DataFrame:
    base = _clamp("abs(score) * 55 + alignment * 25 + CASE WHEN bullish + bearish > 0 THEN 12 ELSE 0 END", 0, 100)
    if use_filter:
        base = (f"CASE WHEN tech_strength_pct IS NULL THEN {base} ELSE "
                + _clamp(f"{base} + (tech_strength_pct - 50) * 0.15D", 0, 100) + " END")
    df = df.selectExpr("*", f"{base} AS _c")
    return df.selectExpr("* EXCEPT (_c)", f"CASE WHEN target_gap IS NULL THEN {_clamp('_c - 8', 0, 100)} "
                         "ELSE _c END AS confidence_pct")


def signal_label(df: DataFrame) -> DataFrame:
    """Buy score, label, tone, regime and the label shown near the end of a month."""
    raw = _clamp("50 + score * 40 + month_end_bonus + consensus * 12 + (confidence_pct - 50) * 0.15D", 0, 100)
    df = df.selectExpr("*", f"{raw} AS _b")
    df = df.selectExpr("* EXCEPT (_b)", f"CASE WHEN confirmed_buy THEN {_clamp('_b + 5', 0, 100)} "
                       f"WHEN confirmed_sell THEN {_clamp('_b - 5', 0, 100)} ELSE _b END AS score_pct")
    df = df.selectExpr(
        "*", "CASE WHEN abs(score) >= 0.5D THEN 'Trend forte' WHEN abs(score) >= 0.25D THEN 'Trend moderato' "
        "ELSE 'Range' END AS regime",
        "CASE WHEN score_pct >= 76 AND confidence_pct >= 70 AND bullish >= 3 AND confirmed_buy THEN 'Compra forte' "
        "WHEN score_pct >= 60 AND confidence_pct >= 56 AND bullish >= 2 AND "
        "(long_setup OR season_long_ok OR consensus > 0.2D) THEN 'Compra' "
        "WHEN score_pct <= 24 AND confidence_pct >= 70 AND bearish >= 3 AND confirmed_sell THEN 'Vendi forte' "
        "WHEN score_pct <= 40 AND confidence_pct >= 56 AND bearish >= 2 AND "
        "(short_setup OR season_short_ok OR consensus < -0.2D) THEN 'Vendi' ELSE 'Neutro' END AS label")
    df = df.selectExpr("*", "CASE WHEN label LIKE 'Compra%' THEN 'buy' WHEN label LIKE 'Vendi%' THEN 'sell' "
                       "ELSE 'neutral' END AS tone")
    return df.selectExpr(
        "*", "CASE WHEN tone = 'buy' AND month_end_buy AND score_pct >= 62 THEN "
        "CASE WHEN label = 'Compra forte' THEN 'Compra forte fine mese' ELSE 'Compra a fine mese' END "
        "WHEN tone = 'sell' AND month_end_sell AND score_pct <= 38 THEN "
        "CASE WHEN label = 'Vendi forte' THEN 'Vendi forte fine mese' ELSE 'Vendi fine mese' END "
        "ELSE label END AS display_label")


def execution_plan(df: DataFrame, tone: str = "tone") -> DataFrame:
    """Entry band, stop, two targets and two risk/reward ratios.

    Without a level or gap to aim at, the first target is 1.6 risks from the current price (not from
    the band's end); the second is 0.9 of the first step beyond the first.
    """
    df = df.selectExpr("*", "get(supports, 0) AS _s1", "get(supports, 1) AS _s2",
                       "get(resistances, 0) AS _r1", "get(resistances, 1) AS _r2",
                       "greatest(target_gap.start, target_gap.end) AS _top",
                       "least(target_gap.start, target_gap.end) AS _bottom")
    df = df.selectExpr(
        "*", f"CASE {tone} WHEN 'buy' THEN least(price, coalesce(_s1 * 1.006D, price * 0.996D)) "
        f"WHEN 'sell' THEN least(price, coalesce(_r1 * 0.985D, price * 0.996D)) END AS _min",
        f"CASE {tone} WHEN 'buy' THEN greatest(price, coalesce(_s1 * 1.015D, price * 1.004D)) "
        f"WHEN 'sell' THEN greatest(price, coalesce(_r1 * 0.994D, price * 1.004D)) END AS _max",
        f"CASE {tone} WHEN 'buy' THEN coalesce(_s1 * 0.992D, price * 0.972D) "
        f"WHEN 'sell' THEN coalesce(_r1 * 1.008D, price * 1.028D) END AS _stop")
    df = df.selectExpr(
        "*", f"CASE {tone} WHEN 'buy' THEN coalesce(array_min(filter(array(_r1, _top), x -> x > _max)), "
        "price + (_max - _stop) * 1.6D) WHEN 'sell' THEN coalesce(array_max(filter(array(_s1, _bottom), "
        "x -> x < _min)), price - (_stop - _min) * 1.6D) END AS _t1")
    df = df.selectExpr(
        "*", f"CASE {tone} WHEN 'buy' THEN coalesce(array_min(filter(array(_r2, _top), x -> x > _t1)), "
        "_t1 + (_t1 - _max) * 0.9D) WHEN 'sell' THEN coalesce(array_max(filter(array(_s2, _bottom), "
        "x -> x < _t1)), _t1 - (_min - _t1) * 0.9D) END AS _t2",
        f"CASE {tone} WHEN 'buy' THEN greatest(_max - _stop, 1e-9D) "
        f"WHEN 'sell' THEN greatest(_stop - _min, 1e-9D) END AS _risk")
    ratio = {t: f"CASE {tone} WHEN 'buy' THEN ({t} - _max) / _risk WHEN 'sell' THEN (_min - {t}) / _risk END"
             for t in ("_t1", "_t2")}
    df = df.selectExpr("*", f"{ratio['_t1']} AS _rr1", f"{ratio['_t2']} AS _rr2")
    plan = F.when(F.col(tone).isin("buy", "sell") & (F.col("price") > 0), F.struct(
        F.when(F.col(tone) == "buy", "long").otherwise("short").alias("side"),
        rnd("_min", 4).alias("entry_min"), rnd("_max", 4).alias("entry_max"),
        rnd("_stop", 4).alias("stop"), rnd("_t1", 4).alias("target1"), rnd("_t2", 4).alias("target2"),
        rnd("_rr1", 2).alias("risk_reward1"), rnd("_rr2", 2).alias("risk_reward2")))
    return df.withColumn("plan", plan).drop(
        "_s1", "_s2", "_r1", "_r2", "_top", "_bottom", "_min", "_max", "_stop", "_t1", "_t2",
        "_risk", "_rr1", "_rr2")


def label_for_timeframe(df: DataFrame, timeframe: str, as_of: dt.date) -> DataFrame:
    """Daily: plain label. Weekly: delayed to the week's end early in the week unless sure."""
    if timeframe not in ("1d", "1w"):
        return df
    base = "CASE tone WHEN 'buy' THEN 'Compra' WHEN 'sell' THEN 'Vendi' ELSE 'Neutro' END"
    shown = base
    sunday_based = (as_of.weekday() + 1) % 7
    if timeframe == "1w" and sunday_based < 4:
        shown = ("CASE WHEN tone = 'neutral' OR confidence_pct >= 72 THEN " + base
                 + " WHEN tone = 'buy' THEN 'Compra a fine settimana' ELSE 'Vendi a fine settimana' END")
    return df.selectExpr("* EXCEPT (label, display_label)", f"{base} AS label", f"{shown} AS display_label")


def _settled(df: DataFrame) -> DataFrame:
    """Fix the columns computed so far behind a generator of one row.

    The stages reuse earlier columns many times over; without a boundary the optimizer would
    inline them into each other (and into pushed-down filters) again and again.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def unified_signal(df: DataFrame, as_of: dt.date, use_filter: bool = True,
                   states: dict[str, int] | None = None) -> DataFrame:
    """All stages in order; symbols without a positive price get the neutral default."""
    s = season_score(df)
    s = _settled(gap_score(sr_score(s)))
    s = market_score(tech_score(s, use_filter), states)
    s = _settled(denial_and_setup(s, use_filter))
    s = directional_score(month_end_bonus(s, as_of), use_filter)
    s = _settled(votes(s, use_filter))
    s = _settled(signal_label(confidence(s, use_filter)))
    return or_neutral(_settled(execution_plan(s)))


# The answer for symbols without a usable price.
NEUTRAL = {"label": "Neutro", "display_label": "Neutro", "tone": "neutral", "score": 0.0, "score_pct": 50.0,
           "confidence_pct": 0.0, "regime": "Dati insufficienti", "target_direction": "none", "target_gap": None, "plan": None,
           "season_score": 0.0, "gap_score": 0.0, "sr_score": 0.0, "tech_score": 0.0, "market_score": 0.0,
           "month_end_bonus": 0, "consensus": 0.0, "bullish": 0, "bearish": 0, "alignment": 0.0}


def or_neutral(signal: DataFrame) -> DataFrame:
    """Columns of ``NEUTRAL`` replaced where the price is missing or not positive; no row is lost."""
    valid = F.coalesce(F.col("price") > 0, F.lit(False))
    types = dict(signal.dtypes)
    return signal.withColumns({c: F.when(valid, F.col(c)).otherwise(F.lit(v).cast(types[c]))
                               for c, v in NEUTRAL.items() if c in types})


# --- gathering the parts ---------------------------------------------------------------------

def nearest_open_gaps(status: DataFrame, prices: DataFrame) -> DataFrame:
    """Nearest open gap above and below each symbol's price, and ``close_prob`` of all its gaps: one pass over the
    gaps, aggregates only, no gap lists. Symbols without a price have the probability alone."""
    g = status.join(prices, "symbol", "left")
    center = (F.col("start") + F.col("end")) / 2
    g = g.withColumns({"center": center, "dist": F.abs(center - F.col("price"))})
    gap = F.struct("start", "end", "center", "dist")
    rank = F.struct("dist", "ord", "pos")
    above = F.col("center") >= F.col("price")
    return g.groupBy("symbol").agg(F.min_by(gap, F.when(~F.col("closed") & above, rank)).alias("gap_up"),
                                   F.min_by(gap, F.when(~F.col("closed") & ~above, rank)).alias("gap_down"),
                                   G.close_probability().alias("close_prob"))


def season_medians(daily: DataFrame, as_of: dt.date, months: DataFrame | None = None) -> DataFrame:
    """Winsorised cumulative medians of the current and the next month."""
    curve = S.seasonal_curve(S.monthly_returns(daily, as_of, months), as_of)
    p = S.client_cumulative_percentiles(S.client_winsorize(curve))

    def at(m):
        return F.max(F.when(F.col("month") == m, F.col("median")))

    return p.groupBy("symbol").agg(at(as_of.month).alias("current_median"),
                                   at(as_of.month % 12 + 1).alias("next_median"))


RULES = {"1d": None, "1w": "W-FRI", "1mo": "ME"}


def timeframe_bars(daily: DataFrame, timeframe: str, slots: DataFrame | None = None) -> DataFrame:
    if timeframe not in RULES:
        raise ValueError(f"daily bars give no {timeframe} bars")
    if slots is not None:
        return whole_slots(slots)
    return resample(daily, RULES[timeframe]) if RULES[timeframe] else daily


def stored_slots(daily: DataFrame, timeframe: str, as_of: dt.date) -> DataFrame | None:
    """Weeks or months of the daily bars as a table in buckets of symbols, for all parts of a signal; None for days.

    They are split where the period of the zones begins; for months that is the period of the season as well."""
    rule = RULES.get(timeframe)
    return stored_by_symbol(slots(daily, rule, period_start("zones", timeframe, as_of)), "slots") if rule else None


def gap_rows(daily: DataFrame, timeframe: str, as_of: dt.date, slots: DataFrame | None = None) -> DataFrame:
    """Bars the gaps come from: five years of days for months, else the shown history."""
    if timeframe == "1mo":
        rows = G.gap_history(in_period(daily, "quote", "1d", as_of), as_of)
    else:
        bars = in_period(timeframe_bars(daily, timeframe, slots), "history", timeframe, as_of)
        rows = clean_bars_strict(tail_rows(bars, 120))
    return positioned(rows).drop("seg")


def _part(df: DataFrame) -> DataFrame:
    """One part as a table in buckets of symbols, a row per symbol.

    All parts and the signal in one stage are more compiled classes than Spark keeps (100 by default), so that every
    task would compile them anew, and the sorts of all parts would share the memory of a task. The zones and the season
    are the parts with the most steps."""
    return stored_by_symbol(df, "part", order="symbol")


def signal_inputs(daily: DataFrame, timeframe: str, as_of: dt.date, slots: DataFrame | None = None) -> DataFrame:
    """Five parts joined by symbol, each already one row per symbol; every symbol with a bar has one.

    With ``slots`` (``stored_slots``) the days are made into weeks or months once, else by every part that needs them."""
    z = Z.supply_demand(daily, timeframe, as_of, slots=slots)
    zones = _part(z.select("symbol", "price", F.col("support.price").alias("support"),
                           F.col("resistance.price").alias("resistance"), "state", "state_strength"))
    status = G.gap_closed(gap_rows(daily, timeframe, as_of, slots))
    prices = Z.zone_price(daily, timeframe, as_of) if slots is None else zones.select("symbol", "price")
    gaps = nearest_open_gaps(status, prices)
    tech = tech_summary(vote_counts(technicals_rows(timeframe_bars(daily, timeframe, slots), timeframe, as_of)))
    tech = tech.select("symbol", "general", "strength", "buy", "sell", "neutral")
    symbols = (daily if slots is None else slots).select("symbol").distinct()
    out = symbols.join(zones, "symbol", "left").join(gaps, "symbol", "left").join(tech, "symbol", "left")
    if timeframe == "1mo":
        return out.join(_part(season_medians(daily, as_of, slots)), "symbol", "left")
    none = F.lit(None).cast("double")
    return out.withColumns({"current_median": none, "next_median": none})


def portfolio_signal(daily: DataFrame, as_of: dt.date, timeframe: str = "1mo",
                     states: dict[str, int] | None = None, slots: DataFrame | None = None) -> DataFrame:
    """Signal of every symbol; ``has_data`` needs season percentiles, so only months have it."""
    s = unified_signal(signal_inputs(daily, timeframe, as_of, slots), as_of, True, states)
    s = label_for_timeframe(s, timeframe, as_of)
    return s.withColumn("has_data", F.col("current_median").isNotNull())


def timeframe_signal(daily: DataFrame, timeframe: str, as_of: dt.date, slots: DataFrame | None = None) -> DataFrame:
    """Forecast-page form: same stages on the zones and gaps of one timeframe."""
    return label_for_timeframe(
        unified_signal(signal_inputs(daily, timeframe, as_of, slots), as_of), timeframe, as_of)


def sr_only_signal(zones: DataFrame) -> DataFrame:
    """Range position and distances to the nearest levels; needs price, support, resistance."""
    z = zones.withColumns({
        "s": F.get(Z.nearest_levels(F.col("support"), F.col("price"), True, 1), F.lit(0)),
        "r": F.get(Z.nearest_levels(F.col("resistance"), F.col("price"), False, 1), F.lit(0))})
    z = z.selectExpr("*", "(price - s) / price * 100 AS dist_support_pct",
                     "(r - price) / price * 100 AS dist_resistance_pct")
    place = f"(0.5D - {_clamp('(price - s) / nullif(r - s, 0)', 0, 1)}) * 2"
    balance = ("try_divide(dist_resistance_pct - dist_support_pct, "
               "dist_support_pct + dist_resistance_pct)")
    z = z.selectExpr(
        "*", f"CASE WHEN r > s THEN coalesce({place} * 0.6D + {balance} * 0.4D, {place}) "
        "WHEN s IS NOT NULL AND r IS NULL THEN 0.2D WHEN s IS NULL AND r IS NOT NULL THEN -0.2D "
        "ELSE 0D END AS _n")
    z = z.selectExpr("* EXCEPT (_n)", f"{_clamp('_n * 100', -100, 100)} AS score_pct")
    return z.selectExpr("*", "CASE WHEN score_pct >= 20 THEN 'buy' WHEN score_pct <= -20 THEN 'sell' "
                        "ELSE 'neutral' END AS tone", "CASE WHEN score_pct >= 20 THEN 'Compra' "
                        "WHEN score_pct <= -20 THEN 'Vendi' ELSE 'Neutrale' END AS action")


def sr_horizons(daily: DataFrame, as_of: dt.date) -> DataFrame:
    """The level-only signal on day, week and month zones against the daily price."""
    price = daily.select("symbol").distinct().join(
        Z.supply_demand(daily, "1d", as_of).select("symbol", "price"), "symbol", "left")
    out = None
    for tf in ("1d", "1w", "1mo"):
        z = Z.supply_demand(daily, tf, as_of).select(
            "symbol", F.col("support.price").alias("support"),
            F.col("resistance.price").alias("resistance"))
        part = sr_only_signal(price.join(z, "symbol", "left")).withColumn("timeframe", F.lit(tf))
        out = part if out is None else out.unionByName(part)
    return out


def structured(signal: DataFrame) -> DataFrame:
    """Nested form of a signal row: components, target gap and plan as structs."""
    parts = {n: F.col(f"{n}_score") * 100 for n in ("season", "gap", "sr", "tech", "market")}
    comp: list[Column] = [c.alias(n) for n, c in parts.items()]
    comp += [F.col("month_end_bonus").alias("bonus"), (F.col("consensus") * 100).alias("consensus")]
    return signal.select("symbol", "label", "display_label", "tone", "score", "score_pct",
                         "confidence_pct", "regime", "target_direction", "target_gap",
                         F.struct(*comp).alias("components"), F.col("plan").alias("execution_plan"))
