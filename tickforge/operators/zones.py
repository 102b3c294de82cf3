"""Supply and demand zones: pivots weighted by accumulated money flow, binned by price.

The analysis looks at the newest 60 to 120 bars of a symbol, so every group is small; windows,
bin sums and the final fold all run on one hash partitioning by symbol.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import by_time, tail_rows
from tickforge.operators.risk import ffill
from tickforge.sources.bars import clean_bars, in_period, resample, slots_inside

BINS, REACH = 50, 2
ZONES = "array<struct<price:double,min:double,max:double>>"


@dataclass(frozen=True)
class ZoneParams:
    strength: float
    min_pct: float
    gap_pct: float
    tail: int
    hilo: bool


# Percentile, distance %, merge gap %, bars and pivot source by timeframe.
PARAMS = {"1d": ZoneParams(70, 1.0, 0.6, 120, False),
          "1w": ZoneParams(80, 2.0, 1.2, 100, True),
          "1mo": ZoneParams(90, 4.0, 2.5, 60, True)}
DEFAULT_PARAMS = ZoneParams(75, 1.0, 0.6, 120, False)
PROXIMITY = 1.5


def zone_params(timeframe: str, **override: float) -> ZoneParams:
    base = PARAMS.get(timeframe, DEFAULT_PARAMS)
    return ZoneParams(**{**base.__dict__, **{k: v for k, v in override.items() if v is not None}})


def zone_bars(bars: DataFrame, timeframe: str, as_of: dt.date, slots: DataFrame | None = None) -> DataFrame:
    """Clean bars of the timeframe from daily bars: the newest rows inside the period. ``slots`` are the weeks or months
    of ``bars`` if they are at hand, split at the start of the period."""
    if slots is not None:
        rows = slots_inside(slots)
    else:
        rows = in_period(bars, "zones", timeframe, as_of)
        rule = {"1w": "W-FRI", "1mo": "ME"}.get(timeframe)
        if rule:
            rows = resample(rows, rule)
    return tail_rows(clean_bars(rows), zone_params(timeframe).tail)


def zone_price(bars: DataFrame, timeframe: str, as_of: dt.date) -> DataFrame:
    """``(symbol, price)`` as ``supply_demand`` gives it, without the zones: the newest close, which cleaning keeps from being null."""
    rows = in_period(bars, "zones", timeframe, as_of)
    rule = {"1w": "W-FRI", "1mo": "ME"}.get(timeframe)
    rows = clean_bars(resample(rows, rule) if rule else rows)
    return rows.groupBy("symbol").agg(rnd(F.max_by("close", "ts"), 2).alias("price"))


def adl_cumsum(bars: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    span = F.when(span == 0, F.lit(1e-9)).otherwise(span)
    flow = (F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))
    past = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("adl", F.sum(F.try_divide(flow, span) * F.col("volume")).over(past))


def pivots(bars: DataFrame, hilo: bool) -> DataFrame:
    """Turning points of a centred five-bar window with both sides complete.

    Close mode: a minimum is support, otherwise a maximum is resistance; hilo mode compares
    lows and highs, and a bar can be both.
    """
    around = by_time().rowsBetween(-REACH, REACH)
    full = F.count(F.lit(1)).over(around) == 2 * REACH + 1
    if hilo:
        is_low = F.col("low") == F.min("low").over(around)
        is_high = F.col("high") == F.max("high").over(around)
    else:
        is_low = F.col("close") == F.min("close").over(around)
        is_high = F.col("close") == F.max("close").over(around)
    out = bars.withColumns({"_full": full, "_lo": is_low, "_hi": is_high})
    sup = F.col("_full") & F.col("_lo")
    res = F.col("_full") & F.col("_hi")
    if not hilo:
        res = res & ~F.col("_lo")
    return out.withColumns({"is_support": sup, "is_resistance": res}).drop("_full", "_lo", "_hi")


def _edge(i: Column) -> Column:
    """Bin edge i of the symbol's price range; the last edge is the maximum itself."""
    step = (F.col("pmax") - F.col("pmin")) / F.lit(float(BINS))
    return F.when(i >= BINS, F.col("pmax")).otherwise(i * step + F.col("pmin"))


def price_bin(price: Column) -> Column:
    """Number of edges at or below the price, less one, inside 0..49; a flat range is bin 49."""
    step = (F.col("pmax") - F.col("pmin")) / F.lit(float(BINS))
    guess = F.coalesce(F.floor(F.try_divide(price - F.col("pmin"), step)), F.lit(BINS)).cast("int")
    # floating edges may sit on either side of the quotient
    fixed = (F.when(_edge(guess) > price, guess - 1)
             .when((guess < BINS) & (_edge(guess + 1) <= price), guess + 1).otherwise(guess))
    return F.least(F.greatest(fixed, F.lit(0)), F.lit(BINS - 1))


def zone_pivots(bars: DataFrame, hilo: bool) -> DataFrame:
    """Bars with flow, pivots, price range and bin; all windows share one exchange."""
    whole = Window.partitionBy("symbol")
    s = pivots(adl_cumsum(ffill(bars, ("open", "high", "low", "close", "volume"))), hilo)
    newest = F.max_by("close", "ts").over(whole)
    s = s.withColumns({"pmin": F.min("low").over(whole), "pmax": F.max("high").over(whole),
                       "price": rnd(newest, 2)})
    return s.withColumn("bin", price_bin(F.col("close")))


def zone_histogram(bars: DataFrame, hilo: bool) -> DataFrame:
    """Per symbol two lists of 50 sums: flow of the support and resistance pivots by bin."""
    s = zone_pivots(bars, hilo)
    cell = s.groupBy("symbol", "bin").agg(
        F.sum(F.when(F.col("is_support"), F.col("adl"))).alias("sup"),
        F.sum(F.when(F.col("is_resistance"), F.col("adl"))).alias("res"),
        F.max("pmin").alias("pmin"), F.max("pmax").alias("pmax"), F.max("price").alias("price"))
    g = cell.groupBy("symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "sup"))).alias("_s"),
        F.map_from_entries(F.collect_list(F.struct("bin", "res"))).alias("_r"),
        F.max("pmin").alias("pmin"), F.max("pmax").alias("pmax"), F.max("price").alias("price"))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))

    def dense(m):
        return F.transform(bins, lambda b: F.coalesce(F.try_element_at(F.col(m), b), F.lit(0.0)))

    return g.select("symbol", "price", "pmin", "pmax", dense("_s").alias("support_sums"),
                    dense("_r").alias("resistance_sums"))


def zone_threshold(sums: Column, strength: float) -> Column:
    """Linear percentile over all 50 bins, empty ones included."""
    at = (BINS - 1) * strength / 100.0
    i, part = int(at), at - int(at)
    ordered = F.sort_array(sums)
    lo, hi = F.get(ordered, F.lit(i)), F.get(ordered, F.lit(min(i + 1, BINS - 1)))
    return lo + (hi - lo) * F.lit(part)


def _zone_list(sums: str, limit: str) -> Column:
    kept = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)),
                    lambda b: F.get(F.col(sums), b) >= F.col(limit))
    return F.transform(kept, lambda b: F.struct(
        rnd((_edge(b) + _edge(b + 1)) / 2, 2).alias("price"),
        rnd(_edge(b), 2).alias("min"), rnd(_edge(b + 1), 2).alias("max")))


def raw_zones(bars: DataFrame, strength: float, hilo: bool) -> DataFrame:
    h = zone_histogram(bars, hilo).withColumns({
        "_sl": zone_threshold(F.col("support_sums"), strength),
        "_rl": zone_threshold(F.col("resistance_sums"), strength)})
    # the limits are fixed behind a generator of one row, or every bin would sort the sums again
    h = h.select("symbol", F.inline(F.array(F.struct(*[c for c in h.columns if c != "symbol"]))))
    return h.select("symbol", "price", _zone_list("support_sums", "_sl").alias("support"),
                    _zone_list("resistance_sums", "_rl").alias("resistance"))


def zone_distance_filter(zones: DataFrame, min_pct: float) -> DataFrame:
    """Zones at least ``min_pct`` away; a side that would be emptied stays as it is."""
    if min_pct <= 0:
        return zones
    away = F.col("price") * F.lit(min_pct / 100.0)
    sup = F.filter("support", lambda z: F.col("price") - z["price"] >= away)
    res = F.filter("resistance", lambda z: z["price"] - F.col("price") >= away)
    usable = F.col("price") > 0
    return zones.withColumns({
        "support": F.when(usable & (F.size(sup) > 0), sup).otherwise(F.col("support")),
        "resistance": F.when(usable & (F.size(res) > 0), res).otherwise(F.col("resistance"))})


def _merged(zones: Column, gap_pct: float) -> Column:
    def step(done, z):
        last = F.try_element_at(done, F.lit(-1))
        close_by = F.abs(z["price"] - last["price"]) <= last["price"] * F.lit(gap_pct / 100.0)
        joined = F.struct(rnd((last["price"] + z["price"]) / 2, 2).alias("price"),
                          rnd(F.least(last["min"], z["min"]), 2).alias("min"),
                          rnd(F.greatest(last["max"], z["max"]), 2).alias("max"))
        return F.when(close_by, F.concat(F.slice(done, F.lit(1), F.size(done) - 1),
                                         F.array(joined))).otherwise(F.concat(done, F.array(z)))

    return F.aggregate(F.array_sort(zones), F.array().cast(ZONES), step)


def zone_merge(zones: DataFrame, gap_pct: float) -> DataFrame:
    """Left fold over at most 50 price-ordered zones: near neighbours become one."""
    if gap_pct <= 0:
        return zones
    return zones.withColumns({"support": _merged(F.col("support"), gap_pct),
                              "resistance": _merged(F.col("resistance"), gap_pct)})


def nearest_levels(prices: Column, price: Column, below: bool, k: int | None = None) -> Column:
    """Level prices on one side of ``price``, nearest first."""
    if below:
        out = F.sort_array(F.filter(prices, lambda p: p <= price), asc=False)
    else:
        out = F.sort_array(F.filter(prices, lambda p: p >= price))
    return out if k is None else F.slice(out, 1, k)


def market_state(zones: DataFrame, proximity: float = PROXIMITY) -> DataFrame:
    price = F.col("price")
    s = F.array_max(F.filter(F.col("support.price"), lambda p: p <= price))
    r = F.array_min(F.filter(F.col("resistance.price"), lambda p: p >= price))
    out = zones.withColumns({"_s": s, "_r": r})
    ds = F.try_divide(price - F.col("_s"), F.col("_s")) * 100
    dr = F.try_divide(F.col("_r") - price, F.col("_r")) * 100
    both = F.col("_s").isNotNull() & F.col("_r").isNotNull()
    state = (F.when(both & (ds < dr) & (ds < proximity), "IN_DEMAND")
             .when(both & (dr < ds) & (dr < proximity), "IN_SUPPLY").otherwise("IN_NONE"))
    strength = F.when(both, rnd(100 - F.least(ds, dr), 2)).otherwise(F.lit(0.0))
    return out.withColumns({"state": state, "state_strength": strength}).drop("_s", "_r")


def supply_demand(bars: DataFrame, timeframe: str, as_of: dt.date, strength: float | None = None,
                  min_pct: float | None = None, gap_pct: float | None = None, slots: DataFrame | None = None) -> DataFrame:
    """``(symbol, price, support, resistance, state, state_strength)`` from daily bars; ``slots`` as in ``zone_bars``."""
    p = zone_params(timeframe, strength=strength, min_pct=min_pct, gap_pct=gap_pct)
    z = raw_zones(zone_bars(bars, timeframe, as_of, slots), p.strength, p.hilo)
    return market_state(zone_merge(zone_distance_filter(z, p.min_pct), p.gap_pct))


def zones_long(zones: DataFrame) -> DataFrame:
    """One row per zone."""
    def side(name):
        return F.transform(F.col(name), lambda z: F.struct(
            F.lit(name).alias("side"), z["price"].alias("zone_price"), z["min"].alias("zone_min"),
            z["max"].alias("zone_max")))
    return zones.select("symbol", F.inline(F.concat(side("support"), side("resistance"))))
