"""Price gaps (survey 2.7, 2.4 #90-92)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd, swap_gap_label
from tickforge.functions.windows import positioned
from tickforge.operators import gaps as G
from tickforge.plans.data import AS_OF, AS_OF_SQL, DAY_SQL, SUPPLIER_SQL, day, supplier_bars
from tickforge.plans.registry import query


def gap_sql(where: str = "", source: str = "bars") -> str:
    """CTE chain: g (all gaps), la (look-ahead), st (status by self-join)."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM {source} {where}),
 n AS (SELECT *, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2,
  lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2,
  min(low) OVER nx AS al, max(high) OVER nx AS ah FROM r
  WINDOW w AS (PARTITION BY symbol ORDER BY pos), nx AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
 g2 AS (SELECT symbol, pos, ts, al, ah, 0 AS ord, CASE WHEN low > h1 * 1.01::DOUBLE THEN 'Gap Up' ELSE 'Gap Down' END AS kind,
  CASE WHEN low > h1 * 1.01::DOUBLE THEN h1 ELSE high END AS a, CASE WHEN low > h1 * 1.01::DOUBLE THEN low ELSE l1 END AS b
  FROM n WHERE low > h1 * 1.01::DOUBLE OR high < l1 * 0.99::DOUBLE),
 g3 AS (SELECT symbol, pos, ts, al, ah, 1 AS ord, CASE WHEN close > open THEN 'Gap Up 3 candele' ELSE 'Gap Down 3 candele' END AS kind,
  CASE WHEN close > open THEN h2 ELSE high END AS a, CASE WHEN close > open THEN low ELSE l2 END AS b
  FROM n WHERE (close > open AND c1 > o1 AND c2 > o2 AND low >= h2) OR (close < open AND c1 < o1 AND c2 < o2 AND high <= l2)),
 g AS (SELECT *, CASE WHEN kind LIKE 'Gap Up%' THEN 'up' ELSE 'down' END AS dir FROM (FROM g2 UNION ALL FROM g3))"""


def _fill(lo, hi):
    return (f"CASE WHEN {lo} IS NULL THEN NULL WHEN greatest(a, b) - least(a, b) <= 0 THEN 0 ELSE greatest(0, least(100, CASE WHEN dir = 'up' "
            f"THEN (greatest(a, b) - greatest({lo}, least(a, b))) ELSE (least({hi}, greatest(a, b)) - least(a, b)) END "
            "/ (greatest(a, b) - least(a, b)) * 100)) END")


# the pairing of gaps and later bars is only the check, the Spark side never pairs them
STATUS_SQL = f"""la AS (SELECT *, {_fill('al', 'ah')} AS fill_ahead FROM g),
 pairs AS (SELECT g.symbol, g.pos, g.ord, r.pos AS rp, {_fill('r.low', 'r.high')} AS f FROM g JOIN r ON r.symbol = g.symbol AND r.pos > g.pos),
 hits AS (SELECT symbol, pos, ord, arg_min(f, rp) FILTER (f >= 50) AS hit_fill, max(f) AS most FROM pairs GROUP BY 1, 2, 3),
 st AS (SELECT la.*, hit_fill IS NOT NULL AS closed, coalesce(hit_fill, most, 0) AS fill_pct FROM la LEFT JOIN hits USING (symbol, pos, ord))"""


def _rows(spark, sf):
    return positioned(supplier_bars(spark, sf)).drop("seg")


_COLS = f"symbol, pos, {DAY_SQL} AS day, kind, round(a, 4) AS gap_start, round(b, 4) AS gap_end, dir AS direction"


def _out(g, *extra):
    return g.select("symbol", "pos", day().alias("day"), "kind", rnd("start", 4).alias("gap_start"),
                    rnd("end", 4).alias("gap_end"), "direction", *extra)


@query("gaps_two_candle", f"WITH {SUPPLIER_SQL}, {gap_sql()} SELECT {_COLS} FROM g WHERE ord = 0")
def _(spark, sf):
    return _out(G.gaps_two_candle(_rows(spark, sf)))


@query("gaps_three_candle", f"WITH {SUPPLIER_SQL}, {gap_sql()} SELECT {_COLS} FROM g WHERE ord = 1")
def _(spark, sf):
    return _out(G.gaps_three_candle(_rows(spark, sf)))


@query("gaps_all", f"WITH {SUPPLIER_SQL}, {gap_sql()} SELECT {_COLS} FROM g")
def _(spark, sf):
    return _out(G.gaps_all(_rows(spark, sf)))


@query("gap_fill_pct", f"""WITH {SUPPLIER_SQL}, {gap_sql()}, nxt AS (SELECT g.*, r.low AS nl, r.high AS nh FROM g LEFT JOIN r ON r.symbol = g.symbol AND r.pos = g.pos + 1)
SELECT symbol, pos, kind, round({_fill('nl', 'nh')}, 4) AS next_fill FROM nxt""")
def _(spark, sf):
    # fill by the bar right after the gap
    rows = _rows(spark, sf).withColumns({"nl": F.lead("low").over(G.place()), "nh": F.lead("high").over(G.place())})
    g = G.gaps_all(rows)
    return g.select("symbol", "pos", "kind", rnd(G.gap_fill_pct(F.col("nl"), F.col("nh")), 4).alias("next_fill"))


@query("gap_lookahead", f"WITH {SUPPLIER_SQL}, {gap_sql()}, {STATUS_SQL} SELECT symbol, pos, kind, round(fill_ahead, 4) AS fill_ahead FROM la")
def _(spark, sf):
    return G.gap_lookahead(_rows(spark, sf)).select("symbol", "pos", "kind", rnd("fill_ahead", 4).alias("fill_ahead"))


@query("gap_status", f"WITH {SUPPLIER_SQL}, {gap_sql()}, {STATUS_SQL} SELECT symbol, pos, kind, closed, round(fill_pct, 4) AS fill_pct FROM st")
def _(spark, sf):
    return G.gap_status(_rows(spark, sf)).select("symbol", "pos", "kind", "closed", rnd("fill_pct", 4).alias("fill_pct"))


@query("gap_size", f"""WITH {SUPPLIER_SQL}, {gap_sql()} SELECT symbol, pos, kind, round(abs(b - a), 4) AS abs_size,
 round(CASE WHEN dir = 'up' THEN 1 ELSE -1 END * abs(b - a) / greatest(abs(a), 1e-9) * 100, 4) AS signed_pct FROM g""")
def _(spark, sf):
    return G.gap_size(G.gaps_all(_rows(spark, sf))).select(
        "symbol", "pos", "kind", rnd("abs_size", 4).alias("abs_size"), rnd("signed_pct", 4).alias("signed_pct"))


_FIVE = f"WHERE ts >= {AS_OF_SQL} - INTERVAL 60 MONTH"


@query("gap_history_5y", f"WITH {SUPPLIER_SQL}, {gap_sql(_FIVE)} SELECT {_COLS} FROM g")
def _(spark, sf):
    return _out(G.gaps_all(positioned(G.gap_history(supplier_bars(spark, sf), AS_OF))))


@query("gap_close_probability", f"""WITH {SUPPLIER_SQL}, {gap_sql()}, {STATUS_SQL}
SELECT symbol, round(avg(CASE WHEN fill_ahead >= 50 THEN 100.0::DOUBLE ELSE 0 END), 4) AS close_prob FROM la GROUP BY 1""")
def _(spark, sf):
    p = G.gap_close_probability(G.gap_lookahead(_rows(spark, sf)))
    return p.select("symbol", rnd("close_prob", 4).alias("close_prob"))


@query("gap_close_probability_by_type", f"""WITH {SUPPLIER_SQL}, {gap_sql()}, {STATUS_SQL}
SELECT symbol, kind, round(avg(CASE WHEN fill_ahead >= 50 THEN 100.0::DOUBLE ELSE 0 END), 4) AS close_prob FROM la GROUP BY 1, 2""")
def _(spark, sf):
    p = G.gap_close_probability_by_type(G.gap_lookahead(_rows(spark, sf)))
    return p.select("symbol", "kind", rnd("close_prob", 4).alias("close_prob"))


@query("latest_open_gap", f"""WITH {SUPPLIER_SQL}, {gap_sql()}, {STATUS_SQL}
SELECT {DAY_SQL} AS day, symbol, kind, round(a, 4) AS gap_start, round(b, 4) AS gap_end, round(fill_pct, 4) AS fill_pct FROM st
WHERE NOT closed QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, ord) = 1""")
def _(spark, sf):
    o = G.latest_open_gap(G.gap_status(_rows(spark, sf)))
    return o.select("symbol", day().alias("day"), "kind", rnd("start", 4).alias("gap_start"),
                    rnd("end", 4).alias("gap_end"), rnd("fill_pct", 4).alias("fill_pct"))


@query("swap_gap_label", f"""WITH {SUPPLIER_SQL}, {gap_sql()} SELECT symbol, pos, kind, CASE kind WHEN 'Gap Up' THEN 'Gap Down' WHEN 'Gap Down' THEN 'Gap Up'
 WHEN 'Gap Up 3 candele' THEN 'Gap Down 3 candele' ELSE 'Gap Up 3 candele' END AS shown FROM g""")
def _(spark, sf):
    return G.gaps_all(_rows(spark, sf)).select("symbol", "pos", "kind", swap_gap_label(F.col("kind")).alias("shown"))
