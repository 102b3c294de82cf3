import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.util import bars, walk
from tickforge.functions.windows import positioned
from tickforge.operators import gaps as G
from tickforge.operators import seasonality as S
from tickforge.operators import zones as Z

AS_OF = dt.date(2003, 6, 10)


def brute_fill(g, low, high):
    lower, upper = min(g["start"], g["end"]), max(g["start"], g["end"])
    if upper <= lower:
        return 0.0
    amount = upper - max(low, lower) if g["direction"] == "up" else min(high, upper) - lower
    return max(0.0, min(100.0, amount / (upper - lower) * 100))


def test_gap_status_against_the_plain_loop(spark):
    frames = [walk(s, n, seed) for s, n, seed in (("A", 300, 1), ("B", 31, 2), ("C", 33, 3))]
    for f in frames:  # make gaps frequent and large, some far from being filled
        jump = np.cumsum(np.random.default_rng(9).choice([0, 8, -7], len(f)))
        for c in ("open", "high", "low", "close"):
            f[c] = f[c] + jump
    rows = positioned(bars(spark, *frames)).drop("seg")
    by = {f.symbol[0]: f for f in frames}
    got = G.gap_status(rows).collect()
    assert len(got) > 60 and len({r["closed"] for r in got}) == 2
    key = ("symbol", "pos", "ord", "closed", "fill_ahead")
    light = {tuple(r) for r in G.gap_closed(rows).select(*key).collect()}
    assert light == {tuple(r[k] for k in key) for r in got}
    for r in got:
        f = by[r["symbol"]]
        most, closed = 0.0, False
        for i in range(r["pos"] + 1, len(f)):
            most = max(most, brute_fill(r, f.low[i], f.high[i]))
            if most >= 50:
                closed = True
                break
        assert closed == r["closed"] and most == pytest.approx(r["fill_pct"], abs=1e-9)
        ahead = [brute_fill(r, f.low[i], f.high[i]) for i in range(r["pos"] + 1, min(len(f), r["pos"] + 11))]
        assert (r["fill_ahead"] is None) == (not ahead)
        if ahead:
            assert max(ahead) == pytest.approx(r["fill_ahead"], abs=1e-9)


def test_gap_status_climbs_a_tower_of_four_levels(spark):
    """More than 32 ** 3 bars: every closing bar by a plain search from the gap on, and no list longer than a block."""
    n, rng = 33_500, np.random.default_rng(3)
    f = walk("L", n, 7)
    level = 1000 + np.cumsum(rng.normal(0, 1, n)) + np.where(np.arange(n) % 5000 < 40, 60, 0)
    f["open"], f["close"] = level, level + rng.normal(0, 0.5, n)
    f["high"], f["low"] = np.maximum(f.open, f.close) + 0.1, np.minimum(f.open, f.close) - 0.1
    f.loc[np.arange(0, n, 777), ["low"]] = np.nan
    rows = positioned(bars(spark, f)).drop("seg").withColumn("low", F.nanvl("low", F.lit(None)))
    status = G.gap_status(rows)
    plan = status._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in "".join(x for x in plan.splitlines() if "Window" in x) and plan.count("Join") >= 7
    rows = rows.orderBy("pos").collect()
    low, high = [np.array([np.nan if r[c] is None else r[c] for r in rows]) for c in ("low", "high")]
    found = far = 0
    for r in status.collect():
        lower, upper = min(r["start"], r["end"]), max(r["start"], r["end"])
        x = low[r["pos"] + 1:] if r["direction"] == "up" else -high[r["pos"] + 1:]
        l, u = (lower, upper) if r["direction"] == "up" else (-upper, -lower)
        fills = (u - np.maximum(x, l)) / (u - l) * 100 if u > l else np.zeros(len(x))
        at = np.flatnonzero(fills >= 50)
        assert r["closed"] == bool(len(at))
        want = fills[at[0]] if len(at) else np.nanmax(fills, initial=0)
        assert r["fill_pct"] == pytest.approx(max(0, want), abs=1e-7)
        found, far = found + 1, far + bool(len(at) and at[0] > 1024)
    assert found > 300 and far > 5


def test_open_gaps_are_not_searched_for(spark):
    """A reader of open gaps alone has no join and no blocks in its plan, and the gaps that the full status gives."""
    rows = positioned(bars(spark, walk("A", 300, 1), walk("B", 31, 2))).drop("seg")
    status = G.gap_status(rows)
    newest = G.latest_open_gap(status)
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
    want = {}
    for r in sorted(status.where("NOT closed").collect(), key=lambda r: (r["ts"], -r["ord"])):
        want[r["symbol"]] = (r["ts"], r["kind"], r["fill_pct"])
    assert want and {r["symbol"]: (r["ts"], r["kind"], r["fill_pct"]) for r in newest.collect()} == want


def test_gaps_without_a_symbol_stay_open(spark):
    rows = positioned(bars(spark, walk("A", 300, 1))).drop("seg").withColumn("symbol", F.lit(None).cast("string"))
    got = G.gap_status(rows).collect()
    assert got and {(r["closed"], r["fill_pct"]) for r in got} == {(False, 0.0)}


def test_tower_has_few_cells(spark):
    rows = positioned(bars(spark, walk("A", 2100, 1), walk("B", 40, 2))).drop("seg")
    tower = G.block_tower(rows, 3)
    assert [x.agg(F.sum(F.size("cells_low"))).first()[0] for x in tower] == [2140, 66 + 2, 3 + 1]
    assert tower[0].agg(F.max(F.size("cells_low"))).first()[0] == 32


def test_three_candles_with_a_gap_of_no_size(spark):
    f = walk("A", 3, 1)
    f["open"], f["close"] = [10, 11, 12.0], [10.5, 11.5, 12.5]
    f["high"], f["low"] = [10.8, 11.8, 12.8], [9.9, 10.9, 10.8]
    rows = positioned(bars(spark, f)).drop("seg")
    g = G.gap_status(rows).where("ord = 1").collect()
    assert len(g) == 1 and g[0]["kind"] == "Gap Up 3 candele" and not g[0]["closed"] and g[0]["fill_pct"] == 0
    # last bar: nothing follows, but the gap still counts in the denominator
    assert g[0]["fill_ahead"] is None
    assert G.gap_close_probability(G.gap_lookahead(rows).where("ord = 1")).first()["close_prob"] == 0


def test_flat_prices_fall_into_the_last_bin(spark):
    f = walk("F", 30, 1)
    for c in ("open", "high", "low", "close"):
        f[c] = 20.0
    b = Z.zone_pivots(bars(spark, f), False)
    assert {r["bin"] for r in b.select("bin").collect()} == {49}


@pytest.mark.parametrize("hilo", [False, True])
def test_zone_histogram_against_numpy(spark, hilo):
    f = walk("A", 120, 4)
    h = Z.zone_histogram(bars(spark, f), hilo).first()
    edges = np.linspace(f.low.min(), f.high.max(), 51)
    rng = (f.high - f.low).replace(0, 1e-9)
    adl = (((f.close - f.low) - (f.high - f.close)) / rng * f.volume).cumsum()
    sup, res = np.zeros(50), np.zeros(50)
    for i in range(2, 118):
        b = max(0, min(49, np.digitize(f.close[i], edges) - 1))
        lo, hi = (f.low, f.high) if hilo else (f.close, f.close)
        is_lo, is_hi = lo[i] == lo[i - 2:i + 3].min(), hi[i] == hi[i - 2:i + 3].max()
        if is_lo:
            sup[b] += adl[i]
        if is_hi and (hilo or not is_lo):
            res[b] += adl[i]
    np.testing.assert_allclose(h["support_sums"], sup, atol=1e-6)
    np.testing.assert_allclose(h["resistance_sums"], res, atol=1e-6)
    limit = h and spark.range(1).select(Z.zone_threshold(F.lit(list(map(float, sup))), 70)).first()[0]
    assert limit == pytest.approx(np.percentile(sup, 70))


def zone_row(spark, price, support, resistance):
    z = "array<struct<price:double,min:double,max:double>>"
    mk = lambda ps: [(p, p - 1, p + 1) for p in ps]
    return spark.createDataFrame([("A", price, mk(support), mk(resistance))],
                                 f"symbol string, price double, support {z}, resistance {z}")


def test_distance_filter_keeps_a_side_it_would_empty(spark):
    r = Z.zone_distance_filter(zone_row(spark, 100.0, [99.9, 99.8], [100.5, 102.0]), 1.0).first()
    assert len(r["support"]) == 2 and [z["price"] for z in r["resistance"]] == [102.0]


def test_merge_folds_from_the_lowest_price(spark):
    r = Z.zone_merge(zone_row(spark, 100.0, [90.0, 100.0, 100.5, 100.9], []), 0.6).first()
    # 100 and 100.5 merge into 100.25; 100.9 is further than 0.6 % from that
    assert [z["price"] for z in r["support"]] == [90.0, 100.25, 100.9]
    assert r["resistance"] == []


def test_market_state(spark):
    assert Z.market_state(zone_row(spark, 100.0, [99.0], [110.0])).first()["state"] == "IN_DEMAND"
    s = Z.market_state(zone_row(spark, 100.0, [], [101.0])).first()
    assert s["state"] == "IN_NONE" and s["state_strength"] == 0


def curve(spark, values):
    rows = [("A", 2000 + i, 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, year int, month int, ret_pct double")


def test_two_percentile_rules(spark):
    eleven = [float(x) for x in range(11)]
    a = S.month_percentiles(curve(spark, eleven)).where("month = 1").first()
    b = S.client_cumulative_percentiles(curve(spark, eleven)).where("month = 1").first()
    assert (a["p10"], a["median"], a["p90"]) == (1, 5, 9)
    assert (b["p10"], b["median"], b["p90"]) == (1, 5, 9)
    ten = eleven[:10]
    a = S.month_percentiles(curve(spark, ten)).where("month = 1").first()
    b = S.client_cumulative_percentiles(curve(spark, ten)).where("month = 1").first()
    assert (a["p10"], a["median"], a["p90"]) == (0, 4, 8) and (b["p10"], b["median"], b["p90"]) == (1, 5, 9)
    assert S.month_percentiles(curve(spark, [3])).where("month = 2").first()["median"] == 0


def test_years_with_few_months(spark):
    rows = [("A", y, m, 1.0) for y, ms in ((2001, 5), (2002, 6), (2003, 1)) for m in range(1, ms + 1)]
    df = spark.createDataFrame(rows, "symbol string, year int, month int, ret_pct double")
    kept = {r["year"] for r in S.seasonal_curve(df, AS_OF).collect()}
    assert kept == {2002, 2003}


def test_winsorized_array_keeps_places(spark):
    v = [1.0, 2.0, 3.0, 4.0, 100.0, float("nan")]
    r = spark.range(1).select(S.winsorize_array(F.lit(v)).alias("v")).first()["v"]
    lo, hi = np.quantile(v[:5], [0.05, 0.95])
    assert r[:5] == pytest.approx(np.clip(v[:5], lo, hi)) and np.isnan(r[5])


def test_client_winsorize_by_rank_without_lists(spark):
    rng = np.random.default_rng(8)
    rows = [(s, int(y), 1, float(v)) for s, n in (("A", 1), ("B", 2), ("C", 21), ("D", 240)) for y, v in enumerate(np.round(rng.normal(0, 5, n), 1))]
    curve = spark.createDataFrame(rows, "symbol string, year int, month int, ret_pct double")
    out = S.client_winsorize(curve)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.symbol, r.year): r.ret_pct for r in out.collect()}
    for symbol in "ABCD":
        pool = sorted(v for s, _, _, v in rows if s == symbol)
        lo, hi = pool[int(0.05 * (len(pool) - 1))], pool[int(0.95 * (len(pool) - 1))]
        assert all(got[s, y] == min(max(v, lo), hi) for s, y, _, v in rows if s == symbol)
