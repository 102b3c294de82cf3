"""Supply/demand zones (survey 2.4 #83-89, 2.6 #116, 2.5 #104)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.operators import zones as Z
from tickforge.plans.data import AS_OF, AS_OF_SQL, DAY_SQL, SUPPLIER_SQL, day, supplier_bars
from tickforge.plans.registry import query

_SLOT = {"1w": "CAST(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS TIMESTAMP)",
         "1mo": "CAST(last_day(ts) AS TIMESTAMP)"}
_PERIOD = {"4h": 3, "1d": 6, "1w": 60, "1mo": 240}


def zone_sql(tf: str, prefix: str = "", as_of: str = AS_OF_SQL, **override: float) -> str:
    """CTE chain up to ``{prefix}zl`` (zones as lists), ``{prefix}st`` (market state)."""
    p = Z.zone_params(tf, **override)
    x = prefix
    if tf in ("4h", "1d"):
        rows = f"SELECT symbol, ts, high, low, close, volume FROM bars WHERE ts >= {as_of} - INTERVAL {_PERIOD[tf]} MONTH"
    else:
        rows = (f"SELECT symbol, {_SLOT[tf]} AS ts, max(high) AS high, min(low) AS low, arg_max(close, bars.ts) AS close, "
                f"sum(volume) AS volume FROM bars WHERE bars.ts >= {AS_OF_SQL} - INTERVAL {_PERIOD[tf]} MONTH GROUP BY 1, 2")
    if p.hilo:
        sup, res = "low = min(low) OVER w5", "high = max(high) OVER w5"
    else:
        sup = "close = min(close) OVER w5"
        res = "close = max(close) OVER w5 AND NOT close = min(close) OVER w5"
    at = 49 * p.strength / 100.0
    i, frac = int(at), at - int(at)
    edge = lambda e: f"(CASE WHEN ({e}) >= 50 THEN pmax ELSE ({e}) * ((pmax - pmin) / 50.0::DOUBLE) + pmin END)"
    away = f"price * ({p.min_pct} / 100.0::DOUBLE)"

    def merged(side):
        return (f"list_reduce(list_transform(list_sort({side}), lambda z: [z]), lambda a, b: CASE WHEN "
                f"abs(b[1].price - a[-1].price) <= a[-1].price * {p.gap_pct / 100.0!r}::DOUBLE THEN "
                "list_concat(a[1:len(a) - 1], [{'price': round((a[-1].price + b[1].price) / 2, 2), "
                "'min': round(least(a[-1].min, b[1].min), 2), 'max': round(greatest(a[-1].max, b[1].max), 2)}]) "
                "ELSE list_concat(a, b) END)")

    return f"""{x}tail AS (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {p.tail}),
 {x}pv AS (SELECT *, count(*) OVER w5 = 5 AND {sup} AS sup, count(*) OVER w5 = 5 AND {res} AS res,
  sum(((close - low) - (high - close)) / CASE WHEN high - low = 0 THEN 1e-9 ELSE high - low END * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS adl,
  min(low) OVER wa AS pmin, max(high) OVER wa AS pmax FROM {x}tail
  WINDOW w5 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), wa AS (PARTITION BY symbol)),
 {x}st0 AS (SELECT symbol, max(pmin) AS pmin, max(pmax) AS pmax, round(arg_max(close, ts), 2) AS price FROM {x}pv GROUP BY 1),
 {x}bins AS (SELECT symbol, pmin, pmax, price, CAST(unnest(range(50)) AS INTEGER) AS bin FROM {x}st0),
 {x}binned AS (SELECT symbol, sup, res, adl, least(greatest(len(list_filter(range(51), lambda e: {edge('e')} <= close)) - 1, 0), 49) AS bin FROM {x}pv),
 {x}hist AS (SELECT b.symbol, b.pmin, b.pmax, b.price, b.bin, coalesce(s, 0) AS sup_sum, coalesce(r, 0) AS res_sum FROM {x}bins b LEFT JOIN
  (SELECT symbol, bin, sum(adl) FILTER (sup) AS s, sum(adl) FILTER (res) AS r FROM {x}binned GROUP BY 1, 2) c ON b.symbol = c.symbol AND b.bin = c.bin),
 {x}lim AS (SELECT symbol, ls[{i + 1}] + (ls[{i + 2}] - ls[{i + 1}]) * {frac!r}::DOUBLE AS sl, lr[{i + 1}] + (lr[{i + 2}] - lr[{i + 1}]) * {frac!r}::DOUBLE AS rl FROM
  (SELECT symbol, list_sort(list(sup_sum)) AS ls, list_sort(list(res_sum)) AS lr FROM {x}hist GROUP BY 1)),
 {x}zc AS (SELECT symbol, bin, price, sup_sum >= sl AS is_s, res_sum >= rl AS is_r,
  {{'price': round(({edge('bin')} + {edge('bin + 1')}) / 2, 2), 'min': round({edge('bin')}, 2), 'max': round({edge('bin + 1')}, 2)}} AS z FROM {x}hist JOIN {x}lim USING (symbol)),
 {x}z0 AS (SELECT symbol, max(price) AS price, coalesce(list(z ORDER BY bin) FILTER (is_s), []) AS s, coalesce(list(z ORDER BY bin) FILTER (is_r), []) AS r FROM {x}zc GROUP BY 1),
 {x}z1 AS (SELECT symbol, price, CASE WHEN len(list_filter(s, lambda z: price - z.price >= {away})) > 0 THEN list_filter(s, lambda z: price - z.price >= {away}) ELSE s END AS s,
  CASE WHEN len(list_filter(r, lambda z: z.price - price >= {away})) > 0 THEN list_filter(r, lambda z: z.price - price >= {away}) ELSE r END AS r FROM {x}z0),
 {x}zl AS (SELECT symbol, price, {merged('s')} AS s, {merged('r')} AS r FROM {x}z1),
 {x}near AS (SELECT *, list_max(list_filter(list_transform(s, lambda z: z.price), lambda q: q <= price)) AS ns,
  list_min(list_filter(list_transform(r, lambda z: z.price), lambda q: q >= price)) AS nr FROM {x}zl),
 {x}st AS (SELECT symbol, price, s, r, CASE WHEN ns IS NULL OR nr IS NULL THEN 'IN_NONE'
   WHEN (price - ns) / ns < (nr - price) / nr AND (price - ns) / ns * 100 < 1.5 THEN 'IN_DEMAND'
   WHEN (nr - price) / nr < (price - ns) / ns AND (nr - price) / nr * 100 < 1.5 THEN 'IN_SUPPLY' ELSE 'IN_NONE' END AS state,
  CASE WHEN ns IS NULL OR nr IS NULL THEN 0 ELSE round(100 - least((price - ns) / ns * 100, (nr - price) / nr * 100), 2) END AS state_strength FROM {x}near)"""


def _long(name, lists, tf):
    return f"""WITH {SUPPLIER_SQL}, {zone_sql(tf)}, sides AS (
 SELECT symbol, 'support' AS side, unnest({lists[0]}) AS z FROM {name} UNION ALL
 SELECT symbol, 'resistance', unnest({lists[1]}) FROM {name})
SELECT symbol, side, z.price AS zone_price, z.min AS zone_min, z.max AS zone_max FROM sides"""


def _bars(spark, sf, tf="1d"):
    return Z.zone_bars(supplier_bars(spark, sf), tf, AS_OF)


def _raw(spark, sf, tf="1d"):
    p = Z.zone_params(tf)
    return Z.raw_zones(_bars(spark, sf, tf), p.strength, p.hilo)


@query("adl_cumsum", f"""WITH {SUPPLIER_SQL} SELECT symbol, {DAY_SQL} AS day, round(sum(((close - low) - (high - close)) /
 CASE WHEN high - low = 0 THEN 1e-9 ELSE high - low END * volume) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS adl FROM bars""")
def _(spark, sf):
    return Z.adl_cumsum(supplier_bars(spark, sf)).select("symbol", day().alias("day"), rnd("adl", 4).alias("adl"))


@query("pivots", f"""WITH {SUPPLIER_SQL}, {zone_sql('1d')} SELECT symbol, {DAY_SQL} AS day, sup AS is_support, res AS is_resistance FROM pv""")
def _(spark, sf):
    return Z.pivots(_bars(spark, sf), False).select("symbol", day().alias("day"), "is_support", "is_resistance")


@query("pivots_hilo", f"""WITH {SUPPLIER_SQL}, {zone_sql('1w')} SELECT symbol, {DAY_SQL} AS day, sup AS is_support, res AS is_resistance FROM pv""")
def _(spark, sf):
    return Z.pivots(_bars(spark, sf, "1w"), True).select("symbol", day().alias("day"), "is_support", "is_resistance")


@query("zone_params", f"""WITH {SUPPLIER_SQL}, {zone_sql('1d', 'd_')}, {zone_sql('1w', 'w_')}, {zone_sql('1mo', 'm_')}
SELECT symbol, '1d' AS timeframe, count(*) AS bars, 70.0 AS strength, 1.0 AS min_pct, 0.6 AS gap_pct FROM d_tail GROUP BY 1 UNION ALL
SELECT symbol, '1w', count(*), 80.0, 2.0, 1.2 FROM w_tail GROUP BY 1 UNION ALL
SELECT symbol, '1mo', count(*), 90.0, 4.0, 2.5 FROM m_tail GROUP BY 1""")
def _(spark, sf):
    daily = supplier_bars(spark, sf)
    out = None
    for tf in Z.PARAMS:
        p = Z.zone_params(tf)
        part = Z.zone_bars(daily, tf, AS_OF).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).select(
            "symbol", F.lit(tf).alias("timeframe"), "bars", F.lit(float(p.strength)).alias("strength"),
            F.lit(p.min_pct).alias("min_pct"), F.lit(p.gap_pct).alias("gap_pct"))
        out = part if out is None else out.unionByName(part)
    return out


@query("zone_histogram", f"""WITH {SUPPLIER_SQL}, {zone_sql('1d')} SELECT symbol, bin, round(sup_sum, 4) AS support_sum, round(res_sum, 4) AS resistance_sum FROM hist""")
def _(spark, sf):
    h = Z.zone_histogram(_bars(spark, sf), False)
    both = F.arrays_zip("support_sums", "resistance_sums")
    return h.select("symbol", F.posexplode(both).alias("bin", "x")).select(
        "symbol", "bin", rnd("x.support_sums", 4).alias("support_sum"), rnd("x.resistance_sums", 4).alias("resistance_sum"))


@query("zone_threshold", _long("z0", ("s", "r"), "1d"))
def _(spark, sf):
    return Z.zones_long(_raw(spark, sf))


@query("zone_distance_filter", _long("z1", ("s", "r"), "1d"))
def _(spark, sf):
    return Z.zones_long(Z.zone_distance_filter(_raw(spark, sf), Z.zone_params("1d").min_pct))


@query("zone_merge", _long("zl", ("s", "r"), "1d"))
def _(spark, sf):
    p = Z.zone_params("1d")
    return Z.zones_long(Z.zone_merge(Z.zone_distance_filter(_raw(spark, sf), p.min_pct), p.gap_pct))


for _tf in ("1d", "1w", "1mo"):
    @query("zones" if _tf == "1d" else f"zones_{_tf}", _long("st", ("s", "r"), _tf))
    def _(spark, sf, _tf=_tf):
        return Z.zones_long(Z.supply_demand(supplier_bars(spark, sf), _tf, AS_OF))


@query("market_state", f"WITH {SUPPLIER_SQL}, {zone_sql('1d')} SELECT symbol, price, state, state_strength FROM st")
def _(spark, sf):
    return Z.supply_demand(supplier_bars(spark, sf), "1d", AS_OF).select("symbol", "price", "state", "state_strength")


@query("nearest_levels", f"""WITH {SUPPLIER_SQL}, {zone_sql('1d')}
SELECT symbol, array_to_string(list_transform(list_reverse_sort(list_filter(list_transform(s, lambda z: z.price), lambda q: q <= price))[1:3], lambda q: printf('%.2f', q)), ' ') AS supports,
 array_to_string(list_transform(list_sort(list_filter(list_transform(r, lambda z: z.price), lambda q: q >= price))[1:3], lambda q: printf('%.2f', q)), ' ') AS resistances FROM st""")
def _(spark, sf):
    z = Z.supply_demand(supplier_bars(spark, sf), "1d", AS_OF)

    def text(levels):
        return F.array_join(F.transform(levels, lambda q: F.format_string("%.2f", q)), " ")

    return z.select("symbol",
                    text(Z.nearest_levels(F.col("support.price"), F.col("price"), True, 3)).alias("supports"),
                    text(Z.nearest_levels(F.col("resistance.price"), F.col("price"), False, 3)).alias("resistances"))
