"""The analyses on four-hour bars of the ticks (gaps: one hour), and zones with other parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import positioned
from tickforge.operators import gaps as G
from tickforge.operators import indicators as I
from tickforge.operators import zones as Z
from tickforge.plans.data import AS_OF, SUPPLIER_SQL, supplier_bars, ticks
from tickforge.plans.gap_queries import gap_sql
from tickforge.plans.indicator_queries import _rows_sql
from tickforge.plans.registry import query
from tickforge.plans.zone_queries import zone_sql
from tickforge.sources import bars as B

NOW, NOW_SQL = dt.date(2024, 1, 31), "DATE '2024-01-31'"
TICK_SQL = """bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, events.ts) AS ts, arg_min(value, events.ts) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, events.ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
AT_SQL = "strftime(ts, '%Y-%m-%d %H:%M')"
OVERRIDES = {"strength": 60.0, "min_pct": 3.0, "gap_pct": 2.0}


def tick_bars(spark, sf, width="4 hours"):
    return B.bars_from_trades(ticks(spark, sf), F.window("ts", width)["start"])


def at():
    return F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at")


def _zones_sql(bars_sql, *args, **kw):
    return f"""WITH {bars_sql}, {zone_sql(*args, **kw)}, sides AS (SELECT symbol, 'support' AS side, unnest(s) AS z FROM zl UNION ALL SELECT symbol, 'resistance', unnest(r) FROM zl)
SELECT symbol, side, z.price AS zone_price, z.min AS zone_min, z.max AS zone_max FROM sides"""


@query("technicals_rows_4h", f"WITH {_rows_sql(TICK_SQL, f'WHERE ts >= {NOW_SQL} - INTERVAL 60 DAY')} SELECT * FROM tr")
def _(spark, sf):
    return I.technicals_rows(tick_bars(spark, sf), "4h", NOW)


@query("zones_4h", _zones_sql(TICK_SQL, "4h", as_of=NOW_SQL))
def _(spark, sf):
    return Z.zones_long(Z.supply_demand(tick_bars(spark, sf), "4h", NOW))


@query("zones_overrides", _zones_sql(SUPPLIER_SQL, "1d", **OVERRIDES))
def _(spark, sf):
    return Z.zones_long(Z.supply_demand(supplier_bars(spark, sf), "1d", AS_OF, **OVERRIDES))


@query("history_4h", f"""WITH {TICK_SQL} SELECT symbol, {AT_SQL} AS at, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close
FROM bars WHERE ts >= {NOW_SQL} - INTERVAL 3 MONTH QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 120""")
def _(spark, sf):
    return B.history(tick_bars(spark, sf), "4h", NOW).select("symbol", at(), "open", "high", "low", "close")


# four hours of ticks overlap too much for a gap
@query("gaps_1h", f"WITH {TICK_SQL.replace('INTERVAL 4 HOUR', 'INTERVAL 1 HOUR')}, {gap_sql()} SELECT symbol, pos, {AT_SQL} AS at, kind, round(a, 4) AS gap_start, round(b, 4) AS gap_end, dir AS direction FROM g")
def _(spark, sf):
    g = G.gaps_all(positioned(tick_bars(spark, sf, "1 hour")).drop("seg"))
    return g.select("symbol", "pos", at(), "kind", rnd("start", 4).alias("gap_start"), rnd("end", 4).alias("gap_end"), "direction")
