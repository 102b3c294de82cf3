"""Composite signal (survey 2.8, #53)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd, rr_tone
from tickforge.operators import signal as X
from tickforge.operators import zones as Z
from tickforge.plans.data import AS_OF, AS_OF_SQL, SUPPLIER_SQL, stored_supplier_bars, supplier_bars
from tickforge.plans.gap_queries import STATUS_SQL, gap_sql
from tickforge.plans.indicator_queries import SUPPLIER_ROWS_SQL, VOTES_SQL
from tickforge.plans.registry import query
from tickforge.plans.season_queries import CLIENT_SQL
from tickforge.plans.zone_queries import _SLOT, zone_sql

TF = "1d"


def _strip(sql):
    return sql.split(SUPPLIER_SQL, 1)[1].lstrip(", \n")


# Monthly signal: month zones, five years of daily gaps, month indicators, season medians.
_AGGREGATES = """arg_min(open, bars.ts) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, bars.ts) AS close, sum(volume) AS volume"""
_SLOT_BARS = {tf: f"(SELECT symbol, {slot} AS ts, {_AGGREGATES} FROM bars GROUP BY 1, 2)" for tf, slot in _SLOT.items()}

def _rows_sql(tf):
    if tf == "1d":
        return _strip(SUPPLIER_ROWS_SQL)
    days = f"FROM bars WHERE ts >= {AS_OF_SQL} - INTERVAL 24 MONTH"
    months = {"1w": 60, "1mo": 240}[tf]
    out = _strip(SUPPLIER_ROWS_SQL).replace(days, f"FROM {_SLOT_BARS[tf]} WHERE ts >= {AS_OF_SQL} - INTERVAL {months} MONTH")
    assert days not in out
    return out


# Weekly gaps come from the shown history: five years, newest 120 weeks, prices to the cent.
_WEEKS = f"""(SELECT symbol, ts, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close
 FROM {_SLOT_BARS['1w']} WHERE ts >= {AS_OF_SQL} - INTERVAL 60 MONTH QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120)"""
_DAYS = f"""(SELECT symbol, ts, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close
 FROM bars WHERE ts >= {AS_OF_SQL} - INTERVAL 6 MONTH QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120)"""
_GAPS = {"1d": gap_sql(source=_DAYS), "1mo": gap_sql(f"WHERE ts >= {AS_OF_SQL} - INTERVAL 60 MONTH"), "1w": gap_sql(source=_WEEKS)}
_MEDIANS = {"1mo": "SELECT symbol, max(median) FILTER (month = 11) AS cur, max(median) FILTER (month = 12) AS nxt FROM cpct GROUP BY 1",
            **dict.fromkeys(("1d", "1w"), "SELECT symbol, NULL::DOUBLE AS cur, NULL::DOUBLE AS nxt FROM cpct GROUP BY 1")}


def input_sql(tf):
    return f"""{SUPPLIER_SQL}, {_strip(CLIENT_SQL)}, {zone_sql(tf, 'z_')},
 {_GAPS[tf]}, {STATUS_SQL}, {_rows_sql(tf)}{VOTES_SQL},
 og AS (SELECT st.symbol, st.pos, st.ord, a AS gs, b AS ge, (a + b) / 2 AS center, abs((a + b) / 2 - price) AS dist, price FROM st JOIN z_st ON z_st.symbol = st.symbol WHERE NOT closed),
 near_gap AS (SELECT symbol,
  arg_min({{'s': gs, 'e': ge, 'c': center, 'd': dist}}, (dist, ord, pos)) FILTER (center >= price) AS up,
  arg_min({{'s': gs, 'e': ge, 'c': center, 'd': dist}}, (dist, ord, pos)) FILTER (center < price) AS dn FROM og GROUP BY 1),
 prob AS (SELECT symbol, avg(CASE WHEN fill_ahead >= 50 THEN 100.0::DOUBLE ELSE 0 END) AS close_prob FROM la GROUP BY 1),
 med AS ({_MEDIANS[tf]}),
 inp AS (SELECT z_st.symbol, price, list_reverse_sort(list_filter(list_transform(s, lambda z: z.price), lambda q: q <= price)) AS sup,
  list_sort(list_filter(list_transform(r, lambda z: z.price), lambda q: q >= price)) AS res, state, state_strength, up, dn, close_prob, cur, nxt,
  general, strength, buy, sell, neutral FROM z_st LEFT JOIN near_gap USING (symbol) LEFT JOIN prob USING (symbol)
  LEFT JOIN summary USING (symbol) LEFT JOIN med USING (symbol) WHERE price > 0)"""


INPUT_SQL = input_sql("1mo")


def _cl(x, lo, hi):
    return f"least(greatest({x}, {lo}), {hi})"


def signal_sql(tf):
    return f"""{input_sql(tf)},
 k1 AS (SELECT *, CASE WHEN cur IS NULL OR nxt IS NULL THEN 0.0::DOUBLE ELSE {_cl('(nxt - cur) / 10', -1, 1)} END AS season,
  CASE WHEN nxt - cur > 0.15 THEN 'up' WHEN nxt - cur < -0.15 THEN 'down' ELSE 'neutral' END AS season_dir,
  CASE WHEN sup[1] IS NOT NULL AND res[1] IS NOT NULL THEN coalesce({_cl('((res[1] - price) - (price - sup[1])) / nullif((res[1] - price) + (price - sup[1]), 0)', -1, 1)}, 0)
   WHEN sup[1] IS NOT NULL THEN 0.35::DOUBLE WHEN res[1] IS NOT NULL THEN -0.35::DOUBLE ELSE 0 END AS sr FROM inp),
 k2 AS (SELECT *, CASE WHEN sr > 0.08 THEN 'up' WHEN sr < -0.08 THEN 'down' ELSE 'neutral' END AS trend FROM k1),
 k3 AS (SELECT *, CASE WHEN trend = 'up' THEN up WHEN trend = 'down' THEN dn WHEN up IS NULL OR dn.d < up.d THEN coalesce(dn, up) ELSE up END AS tg FROM k2),
 k4 AS (SELECT *, CASE WHEN tg IS NULL THEN 'none' WHEN tg.c >= price THEN 'up' ELSE 'down' END AS tdir, CASE WHEN tg.c >= price THEN 1 ELSE -1 END AS sg FROM k3),
 k5 AS (SELECT *, CASE WHEN tg IS NULL THEN 0 WHEN close_prob IS NULL THEN sg * {_cl('1 - abs(tg.c - price) / price * 100 / 9', 0.15, 1)}
   ELSE {_cl(f"sg * {_cl('1 - abs(tg.c - price) / price * 100 / 9', 0.15, 1)} * 0.8 + sg * {_cl('(close_prob - 50) / 50', -1, 1)} * 0.25", -1, 1)} END AS gap,
  {_cl('strength * 100', 0, 100)} AS tsp, CASE general WHEN 'Buy' THEN 'up' WHEN 'Sell' THEN 'down' ELSE 'neutral' END AS tech_dir,
  (buy - sell)::DOUBLE / (buy + sell + neutral) AS cd FROM k4),
 k6 AS (SELECT *, {_cl(f"{_cl('(tsp - 50) / 45', -1, 1)} * 0.65 + cd * 0.35", -1, 1)} AS traw, 0.0::DOUBLE AS market FROM k5),
 k7 AS (SELECT *, CASE tech_dir WHEN 'up' THEN greatest(traw, 0.15) WHEN 'down' THEN least(traw, -0.15) ELSE traw END AS tech,
  trend <> 'neutral' AND season_dir <> 'neutral' AND season_dir <> trend AS sden, trend <> 'neutral' AND tech_dir <> 'neutral' AND tech_dir <> trend AS tden,
  trend = 'up' AND tdir = 'up' AS lsetup, trend = 'down' AND tdir = 'down' AS ssetup, season_dir <> 'down' AS slok, season_dir <> 'up' AS ssok,
  coalesce(cur < 0 AND nxt > 0, false) AS mbuy, coalesce(cur > 0 AND nxt < 0, false) AS msell FROM k6),
 k8 AS (SELECT *, lsetup AND slok AND tech_dir <> 'down' AND tsp >= 55 AS cbuy, ssetup AND ssok AND tech_dir <> 'up' AND tsp >= 55 AS csell,
  {_cl("(sr * 0.32 + gap * 0.23 + season * 0.2 + tech * 0.17 + market * 0.1) * CASE WHEN sden THEN 0.72 ELSE 1 END * CASE WHEN tden THEN 0.68 ELSE 1 END", -1, 1)} AS score,
  list_transform([sr, gap, season, market, tech], lambda v: CASE WHEN abs(v) >= 0.5 THEN 2 WHEN abs(v) >= 0.16 THEN 1 ELSE 0 END * sign(v)) AS vs FROM k7),
 k9 AS (SELECT *, CAST(list_sum(list_filter(vs, lambda v: v > 0)) AS INTEGER) AS b0, CAST(-list_sum(list_filter(vs, lambda v: v < 0)) AS INTEGER) AS s0 FROM k8),
 k10 AS (SELECT *, coalesce(b0, 0) AS bull, coalesce(s0, 0) AS bear FROM k9),
 k11 AS (SELECT *, coalesce((bull - bear)::DOUBLE / nullif(bull + bear, 0), 0) AS consensus, coalesce(greatest(bull, bear)::DOUBLE / nullif(bull + bear, 0), 0) AS alignment FROM k10),
 k12 AS (SELECT *, {_cl(f"{_cl('abs(score) * 55 + alignment * 25 + CASE WHEN bull + bear > 0 THEN 12 ELSE 0 END', 0, 100)} + (tsp - 50) * 0.15", 0, 100)} AS c0 FROM k11),
 k13 AS (SELECT *, CASE WHEN tg IS NULL THEN {_cl('c0 - 8', 0, 100)} ELSE c0 END AS conf FROM k12),
 k14 AS (SELECT *, {_cl('50 + score * 40 + consensus * 12 + (conf - 50) * 0.15', 0, 100)} AS bs0 FROM k13),
 k15 AS (SELECT *, CASE WHEN cbuy THEN {_cl('bs0 + 5', 0, 100)} WHEN csell THEN {_cl('bs0 - 5', 0, 100)} ELSE bs0 END AS bs FROM k14),
 k16 AS (SELECT *, CASE WHEN abs(score) >= 0.5 THEN 'Trend forte' WHEN abs(score) >= 0.25 THEN 'Trend moderato' ELSE 'Range' END AS regime,
  CASE WHEN bs >= 76 AND conf >= 70 AND bull >= 3 AND cbuy THEN 'Compra forte' WHEN bs >= 60 AND conf >= 56 AND bull >= 2 AND (lsetup OR slok OR consensus > 0.2) THEN 'Compra'
   WHEN bs <= 24 AND conf >= 70 AND bear >= 3 AND csell THEN 'Vendi forte' WHEN bs <= 40 AND conf >= 56 AND bear >= 2 AND (ssetup OR ssok OR consensus < -0.2) THEN 'Vendi' ELSE 'Neutro' END AS label FROM k15),
 k17 AS (SELECT *, CASE WHEN label LIKE 'Compra%' THEN 'buy' WHEN label LIKE 'Vendi%' THEN 'sell' ELSE 'neutral' END AS tone FROM k16),
 sg AS (SELECT *, CASE WHEN tone = 'buy' AND mbuy AND bs >= 62 THEN CASE WHEN label = 'Compra forte' THEN 'Compra forte fine mese' ELSE 'Compra a fine mese' END
  WHEN tone = 'sell' AND msell AND bs <= 38 THEN CASE WHEN label = 'Vendi forte' THEN 'Vendi forte fine mese' ELSE 'Vendi fine mese' END ELSE label END AS shown FROM k17)"""


SIGNAL_SQL = signal_sql("1mo")
_PLAN_SQL = """, p0 AS (SELECT *, greatest(tg.s, tg.e) AS top, least(tg.s, tg.e) AS bot FROM sg WHERE tone <> 'neutral'),
 p1 AS (SELECT *, tone = 'buy' AS b, CASE WHEN tone = 'buy' THEN least(price, coalesce(sup[1] * 1.006, price * 0.996)) ELSE least(price, coalesce(res[1] * 0.985, price * 0.996)) END AS mn,
  CASE WHEN tone = 'buy' THEN greatest(price, coalesce(sup[1] * 1.015, price * 1.004)) ELSE greatest(price, coalesce(res[1] * 0.994, price * 1.004)) END AS mx,
  CASE WHEN tone = 'buy' THEN coalesce(sup[1] * 0.992, price * 0.972) ELSE coalesce(res[1] * 1.008, price * 1.028) END AS stop FROM p0),
 p2 AS (SELECT *, CASE WHEN b THEN coalesce(list_min(list_filter([res[1], top], lambda q: q > mx)), price + (mx - stop) * 1.6)
  ELSE coalesce(list_max(list_filter([sup[1], bot], lambda q: q < mn)), price - (stop - mn) * 1.6) END AS t1 FROM p1),
 p3 AS (SELECT *, CASE WHEN b THEN coalesce(list_min(list_filter([res[2], top], lambda q: q > t1)), t1 + (t1 - mx) * 0.9)
  ELSE coalesce(list_max(list_filter([sup[2], bot], lambda q: q < t1)), t1 - (mn - t1) * 0.9) END AS t2,
  CASE WHEN b THEN greatest(mx - stop, 1e-9) ELSE greatest(stop - mn, 1e-9) END AS risk FROM p2)
 SELECT symbol, CASE WHEN b THEN 'long' ELSE 'short' END AS side, round(mn, 4) AS entry_min, round(mx, 4) AS entry_max, round(stop, 4) AS stop,
  round(t1, 4) AS target1, round(t2, 4) AS target2, round(CASE WHEN b THEN (t1 - mx) / risk ELSE (mn - t1) / risk END, 2) AS risk_reward1,
  round(CASE WHEN b THEN (t2 - mx) / risk ELSE (mn - t2) / risk END, 2) AS risk_reward2 FROM p3"""


def _signal(spark, sf, tf="1mo"):
    daily = stored_supplier_bars(spark, sf)
    return X.portfolio_signal(daily, AS_OF, tf, slots=X.stored_slots(daily, tf, AS_OF))


@query("signal_fan_in", f"""WITH {INPUT_SQL} SELECT symbol, price, len(sup) AS n_support, len(res) AS n_resistance, state, round(up.c, 4) AS gap_up_center,
 round(dn.c, 4) AS gap_down_center, round(close_prob, 4) AS close_prob, round(cur, 2) AS current_median, round(nxt, 2) AS next_median, general, buy, sell, neutral FROM inp""")
def _(spark, sf):
    daily = stored_supplier_bars(spark, sf)
    s = X.signal_inputs(daily, "1mo", AS_OF, X.stored_slots(daily, "1mo", AS_OF))
    return s.select(
        "symbol", "price", F.size(Z.nearest_levels(F.col("support"), F.col("price"), True)).alias("n_support"),
        F.size(Z.nearest_levels(F.col("resistance"), F.col("price"), False)).alias("n_resistance"), "state",
        rnd("gap_up.center", 4).alias("gap_up_center"), rnd("gap_down.center", 4).alias("gap_down_center"),
        rnd("close_prob", 4).alias("close_prob"), rnd("current_median", 2).alias("current_median"),
        rnd("next_median", 2).alias("next_median"), "general", "buy", "sell", "neutral")


def _stage(name, spark_cols, sql_cols):
    @query(name, f"WITH {SIGNAL_SQL} SELECT symbol, {', '.join(sql_cols)} FROM sg")
    def _(spark, sf):
        return _signal(spark, sf).select("symbol", *spark_cols())


def _r(col, name=None, digits=6):
    return rnd(col, digits).alias(name or col)


_stage("season_score", lambda: [_r("season_score"), "season_direction"],
       ["round(season, 6) AS season_score", "season_dir AS season_direction"])
_stage("sr_score", lambda: [_r("sr_score"), "trend"], ["round(sr, 6) AS sr_score", "trend"])
_stage("gap_score", lambda: [_r("gap_score"), "target_direction", _r("target_gap.center", "target_center", 4)],
       ["round(gap, 6) AS gap_score", "tdir AS target_direction", "round(tg.c, 4) AS target_center"])
_stage("tech_score", lambda: [_r("tech_score"), "tech_direction", _r("tech_strength_pct", digits=4)],
       ["round(tech, 6) AS tech_score", "tech_dir AS tech_direction", "round(tsp, 4) AS tech_strength_pct"])
_stage("denial_and_setup", lambda: ["season_denies", "tech_denies", "market_denies", "long_setup", "short_setup",
                                    "confirmed_buy", "confirmed_sell"],
       ["sden AS season_denies", "tden AS tech_denies", "false AS market_denies", "lsetup AS long_setup",
        "ssetup AS short_setup", "cbuy AS confirmed_buy", "csell AS confirmed_sell"])
_stage("directional_score", lambda: [_r("score")], ["round(score, 6) AS score"])
_stage("votes", lambda: ["bullish", "bearish", _r("consensus"), _r("alignment")],
       ["bull AS bullish", "bear AS bearish", "round(consensus, 6) AS consensus", "round(alignment, 6) AS alignment"])
_stage("confidence", lambda: [_r("confidence_pct", digits=4)], ["round(conf, 4) AS confidence_pct"])
_stage("signal_label", lambda: [_r("score_pct", digits=4), "regime", "label", "tone", "display_label"],
       ["round(bs, 4) AS score_pct", "regime", "label", "tone", "shown AS display_label"])
_stage("portfolio_signal", lambda: [_r("score", digits=4), _r("score_pct", digits=4), _r("confidence_pct", digits=4), "label",
                                    "display_label", "tone", "has_data"],
       ["round(score, 4) AS score", "round(bs, 4) AS score_pct", "round(conf, 4) AS confidence_pct", "label",
        "shown AS display_label", "tone", "cur IS NOT NULL AS has_data"])


@query("market_score", f"""WITH {SUPPLIER_SQL}, {zone_sql('1d')} SELECT symbol, state,
 CASE state WHEN 'IN_DEMAND' THEN 1 WHEN 'IN_SUPPLY' THEN -1 ELSE 0 END AS market_direction,
 round(CASE state WHEN 'IN_DEMAND' THEN 1 WHEN 'IN_SUPPLY' THEN -1 ELSE 0 END * (0.35 + state_strength / 100 * 0.65), 6) AS market_score FROM st""")
def _(spark, sf):
    z = Z.supply_demand(supplier_bars(spark, sf), TF, AS_OF)
    return X.market_score(z, X.ZONE_STATES).select("symbol", "state", "market_direction", rnd("market_score", 6).alias("market_score"))


@query("month_end_bonus", f"""WITH {CLIENT_SQL}, med AS (SELECT symbol, max(median) FILTER (month = 11) AS cur, max(median) FILTER (month = 12) AS nxt FROM cpct GROUP BY 1)
SELECT symbol, CASE WHEN cur < 0 AND nxt > 0 THEN 8 WHEN cur > 0 AND nxt < 0 THEN -8 ELSE 0 END AS bonus FROM med""")
def _(spark, sf):
    # as if asked on the 28th, inside the last five days
    m = X.season_medians(supplier_bars(spark, sf), AS_OF)
    return X.month_end_bonus(m, AS_OF.replace(day=28)).select("symbol", F.col("month_end_bonus").alias("bonus"))


@query("execution_plan", f"WITH {SIGNAL_SQL}{_PLAN_SQL}")
def _(spark, sf):
    return _signal(spark, sf).where(F.col("plan").isNotNull()).select("symbol", "plan.*")


# Day zones with a tone and without some of their levels, by rules on the supplier: every fallback is reached.
_HOLES = {"tone": "CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END", "sup": "k % 3 = 0", "res": "k % 5 < 2"}


@query("execution_plan_fallbacks", f"""WITH {SUPPLIER_SQL}, {zone_sql('1d')}, k AS (SELECT *, CAST(symbol AS BIGINT) AS k FROM st WHERE price > 0),
 sg AS (SELECT symbol, price, {_HOLES['tone']} AS tone, CASE WHEN {_HOLES['sup']} THEN [] ELSE list_reverse_sort(list_filter(list_transform(s, lambda z: z.price), lambda q: q <= price)) END AS sup,
  CASE WHEN {_HOLES['res']} THEN [] ELSE list_sort(list_filter(list_transform(r, lambda z: z.price), lambda q: q >= price)) END AS res,
  CASE WHEN k % 7 = 0 THEN {{'s': price * 1.1, 'e': price * 1.2}} END AS tg FROM k){_PLAN_SQL}""")
def _(spark, sf):
    z = Z.supply_demand(supplier_bars(spark, sf), TF, AS_OF).withColumn("k", F.col("symbol").cast("long")).where("price > 0")

    def level(prices, below, hole):
        return F.when(F.expr(hole), F.array().cast("array<double>")).otherwise(Z.nearest_levels(F.col(prices), F.col("price"), below))

    gap = F.struct((F.col("price") * 1.1).alias("start"), (F.col("price") * 1.2).alias("end"))
    rows = z.select("symbol", "price", F.expr(_HOLES["tone"]).alias("tone"), level("support.price", True, _HOLES["sup"]).alias("supports"),
                    level("resistance.price", False, _HOLES["res"]).alias("resistances"), F.when(F.col("k") % 7 == 0, gap).alias("target_gap"))
    return X.execution_plan(rows).select("symbol", "plan.*")


@query("rr_tone", f"""WITH {SIGNAL_SQL}, pl AS (SELECT * FROM ({_PLAN_SQL.replace(', p0 AS', 'WITH p0 AS', 1)}))
SELECT symbol, CASE WHEN risk_reward1 IS NULL THEN 'neutral' WHEN risk_reward1 >= 1.5 THEN 'strong' WHEN risk_reward1 >= 1 THEN 'ok' ELSE 'weak' END AS tone1,
 CASE WHEN risk_reward2 IS NULL THEN 'neutral' WHEN risk_reward2 >= 1.5 THEN 'strong' WHEN risk_reward2 >= 1 THEN 'ok' ELSE 'weak' END AS tone2 FROM sg LEFT JOIN pl USING (symbol)""")
def _(spark, sf):
    return _signal(spark, sf).select("symbol", rr_tone(F.col("plan.risk_reward1")).alias("tone1"),
                                     rr_tone(F.col("plan.risk_reward2")).alias("tone2"))


# The query date is a Sunday, so unsure weekly labels wait for the end of the week.
_WEEK_LABEL = "CASE tone WHEN 'buy' THEN 'Compra' WHEN 'sell' THEN 'Vendi' ELSE 'Neutro' END"


@query("label_for_timeframe", f"""WITH {signal_sql('1w')} SELECT symbol, {_WEEK_LABEL} AS label, CASE WHEN tone = 'neutral' OR conf >= 72 THEN {_WEEK_LABEL}
 WHEN tone = 'buy' THEN 'Compra a fine settimana' ELSE 'Vendi a fine settimana' END AS display_label, tone, round(conf, 4) AS confidence_pct FROM sg""")
def _(spark, sf):
    return _signal(spark, sf, "1w").select("symbol", "label", "display_label", "tone", rnd("confidence_pct", 4).alias("confidence_pct"))


def _timeframe_sql(tf):
    """Labels of one timeframe; symbols without bars in its period are neutral."""
    shown = {"1d": _WEEK_LABEL, "1mo": "shown", "1w": f"""CASE WHEN tone = 'neutral' OR conf >= 72 THEN {_WEEK_LABEL}
 WHEN tone = 'buy' THEN 'Compra a fine settimana' ELSE 'Vendi a fine settimana' END"""}[tf]
    return f"""SELECT * FROM (WITH {signal_sql(tf)}, x AS (SELECT '{tf}' AS timeframe, symbol, {'label' if tf == '1mo' else _WEEK_LABEL} AS label, {shown} AS display_label, tone,
 round(bs, 4) AS score_pct, round(conf, 4) AS confidence_pct FROM sg)
 SELECT * FROM x UNION ALL SELECT '{tf}', symbol, 'Neutro', 'Neutro', 'neutral', 50.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol NOT IN (SELECT symbol FROM x))"""


@query("timeframe_signal", " UNION ALL ".join(_timeframe_sql(tf) for tf in ("1d", "1w", "1mo")))
def _(spark, sf):
    daily = stored_supplier_bars(spark, sf)
    out = None
    for tf in ("1d", "1w", "1mo"):
        s = X.timeframe_signal(daily, tf, AS_OF, X.stored_slots(daily, tf, AS_OF)).select(
            F.lit(tf).alias("timeframe"), "symbol", "label", "display_label", "tone",
            rnd("score_pct", 4).alias("score_pct"), rnd("confidence_pct", 4).alias("confidence_pct"))
        out = s if out is None else out.unionByName(s)
    return out


def _sr_sql(tf, prefix):
    return f"""SELECT '{tf}' AS timeframe, symbol, d_st.price AS price, list_max(list_filter(list_transform({prefix}st.s, lambda z: z.price), lambda q: q <= d_st.price)) AS s,
 list_min(list_filter(list_transform({prefix}st.r, lambda z: z.price), lambda q: q >= d_st.price)) AS r FROM {prefix}st JOIN d_st USING (symbol)"""


@query("sr_only_signal", f"""WITH {SUPPLIER_SQL}, {zone_sql('1d', 'd_')}, {zone_sql('1w', 'w_')}, {zone_sql('1mo', 'm_')},
 lv AS ({_sr_sql('1d', 'd_').replace('FROM d_st JOIN d_st USING (symbol)', 'FROM d_st')} UNION ALL {_sr_sql('1w', 'w_')} UNION ALL {_sr_sql('1mo', 'm_')}),
 sc AS (SELECT *, CASE WHEN r > s THEN coalesce((0.5 - (price - s) / (r - s)) * 2 * 0.6 + ((r - price) - (price - s)) / nullif((r - price) + (price - s), 0) * 0.4, (0.5 - (price - s) / (r - s)) * 2)
  WHEN s IS NOT NULL AND r IS NULL THEN 0.2::DOUBLE WHEN s IS NULL AND r IS NOT NULL THEN -0.2::DOUBLE ELSE 0 END * 100 AS score_pct FROM lv)
SELECT timeframe, symbol, s AS support, r AS resistance, round(score_pct, 4) AS score_pct,
 CASE WHEN score_pct >= 20 THEN 'Compra' WHEN score_pct <= -20 THEN 'Vendi' ELSE 'Neutrale' END AS action FROM sc""")
def _(spark, sf):
    return X.sr_horizons(stored_supplier_bars(spark, sf), AS_OF).select(
        "timeframe", "symbol", F.col("s").alias("support"), F.col("r").alias("resistance"),
        rnd("score_pct", 4).alias("score_pct"), "action")


@query("sink_json")
def _(spark, sf):
    """The nested response as one JSON document per symbol."""
    s = X.structured(_signal(spark, sf))
    return s.select("symbol", F.to_json(F.struct(*s.columns)).alias("document"))
