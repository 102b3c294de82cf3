import datetime as dt
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, rows_of
from tests.util import bars, walk
from tickforge.operators import correlation as C
from tickforge.operators import gaps as G
from tickforge.operators import signal as X
from tickforge.operators import zones as Z
from tickforge.plans.data import AS_OF, stored_supplier_bars, supplier_bars
from tickforge.sources import bars as B
from tickforge.sources.stored import stored
from tickforge.streaming import live as L

GAP = "struct<start:double,end:double,center:double,dist:double>"
SCHEMA = (f"symbol string, price double, support array<double>, resistance array<double>, gap_up {GAP}, gap_down {GAP}, "
          "current_median double, next_median double, general string, strength double, buy int, sell int, neutral int, "
          "state string, state_strength double, close_prob double")


def signal(spark, **kw):
    base = dict(symbol="A", price=100.0, support=[99.0, 95.0], resistance=[120.0, 130.0], gap_up=(104.0, 106.0, 105.0, 5.0),
                gap_down=None, current_median=-1.0, next_median=8.0, general="Buy", strength=0.8, buy=40, sell=5, neutral=1,
                state="IN_DEMAND", state_strength=99.0, close_prob=80.0)
    base.update(kw)
    return spark.createDataFrame([tuple(base.values())], SCHEMA)


def test_strong_buy_with_plan(spark):
    r = X.unified_signal(signal(spark), dt.date(2001, 11, 4), states=X.ZONE_STATES).first()
    sr = (20 - 1) / 21
    gap = min(1, (1 - 5 / 9) * 0.8 + 0.6 * 0.25)
    tech = min(1, (30 / 45) * 0.65 + 35 / 46 * 0.35)
    market = 0.35 + 0.99 * 0.65
    score = sr * .32 + gap * .23 + 0.9 * .2 + tech * .17 + market * .1
    assert r["score"] == pytest.approx(score)
    assert r["label"] == "Compra forte" and r["tone"] == "buy" and r["display_label"] == "Compra forte fine mese"
    plan = r["plan"]
    assert plan["side"] == "long" and plan["stop"] == round(99 * .992, 4) and plan["target1"] == 106.0
    assert plan["entry_max"] == round(99 * 1.015, 4) and plan["target2"] == 130.0


def test_zone_states_have_no_direction_unless_mapped(spark):
    s = X.market_score(signal(spark)).first()
    assert s["market_direction"] == 0 and s["market_score"] == 0


def test_sell_side_mirrors(spark):
    r = X.unified_signal(signal(spark, support=[80.0, 70.0], resistance=[101.0, 110.0], gap_up=None, gap_down=(94.0, 96.0, 95.0, 5.0),
                                current_median=1.0, next_median=-8.0, general="Sell", buy=5, sell=40, state="SELL"), dt.date(2001, 11, 28)).first()
    assert r["tone"] == "sell" and r["month_end_bonus"] == -8 and r["plan"]["side"] == "short"
    assert r["plan"]["target1"] == 94.0 and r["plan"]["stop"] == round(101 * 1.008, 4)


def test_weekly_label_waits_for_the_week_end(spark):
    s = spark.createDataFrame([("A", "buy", 60.0, "x", "x"), ("B", "sell", 80.0, "x", "x"), ("C", "neutral", 10.0, "x", "x")],
                              "symbol string, tone string, confidence_pct double, label string, display_label string")
    monday = {r["symbol"]: r["display_label"] for r in X.label_for_timeframe(s, "1w", dt.date(2001, 11, 5)).collect()}
    friday = {r["symbol"]: r["display_label"] for r in X.label_for_timeframe(s, "1w", dt.date(2001, 11, 9)).collect()}
    assert monday == {"A": "Compra a fine settimana", "B": "Vendi", "C": "Neutro"}
    assert friday == {"A": "Compra", "B": "Vendi", "C": "Neutro"}


def test_no_price_gives_the_default(spark):
    for price in (None, 0.0, -1.0):
        (r,) = X.unified_signal(signal(spark, price=price), dt.date(2001, 11, 4)).collect()
        assert {c: r[c] for c in X.NEUTRAL if c in r} == X.NEUTRAL


@pytest.mark.parametrize("tone, support, target1", [("buy", [], 105.12), ("buy", [99.5], 103.66), ("sell", [], 94.88)])
def test_first_target_without_a_level_starts_at_the_price(spark, tone, support, target1):
    row = spark.createDataFrame([("A", 100.0, tone, support, [], None)], "symbol string, price double, tone string, supports array<double>, "
                                "resistances array<double>, target_gap struct<start: double, end: double>")
    assert X.execution_plan(row).first()["plan"]["target1"] == pytest.approx(target1, abs=0.006)


def test_moments_combine_over_tasks(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + 50
    t0 = dt.datetime(2000, 1, 1)
    rows = [("A", t0 + dt.timedelta(days=i), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, a double, b double, c double").repartition(7)
    m = C.correlation_matrices(df, ("a", "b", "c"), alpha=0.0).toPandas().sort_values(["i", "j"])
    r = np.corrcoef(x.T)
    p = np.linalg.inv(r)
    part = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
    np.fill_diagonal(part, 1)
    np.testing.assert_allclose(m["normal"].to_numpy().reshape(3, 3), r, atol=1e-9)
    np.testing.assert_allclose(m["partial"].to_numpy().reshape(3, 3), part, atol=1e-9)


def test_stream_over_several_files_equals_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    ev.orderBy("ts").repartitionByRange(4, "ts").write.parquet(str(tmp_path / "ticks"))
    # files arrive in time order: what comes later than the watermark is dropped by design
    for i, f in enumerate(sorted((tmp_path / "ticks").glob("part-*.parquet"))):
        os.utime(f, (1_700_000_000 + 60 * i,) * 2)
    schema = "symbol string, ts timestamp_ntz, price double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks")) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = L.settle(L.live_bars(stream, "4h"), ["symbol", "ts"])
    exp = L.live_bars(ev.withColumn("ts", F.col("ts").cast("timestamp")), "4h")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got.select(*exp.columns)).count() == 0


SAMPLE = ["bars_from_trades", "resample_weekly", "risk_index", "technicals_rows", "seasonality_percentiles", "zones",
          "gap_status", "signal_label", "feed_join", "realized_trend", "quote_summary_to_fundamentals", "stream_live_price"]


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_signal_reads_bucketed_bars_without_an_exchange(spark, sf):
    """All branches, and the joins of their parts, work on the buckets as they were written."""
    daily = stored_supplier_bars(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for timeframe in ("1d", "1w", "1mo"):
            plan = X.portfolio_signal(daily, AS_OF, timeframe)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("Bucketed: true") >= 5
        assert X.timeframe_signal(stored(supplier_bars(spark, sf)), "1mo", AS_OF)._jdf.queryExecution().executedPlan().toString().count("Exchange hash") > 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gap_odds_and_nearest_gaps_come_from_one_pass(spark):
    gap = "symbol string, pos int, ord int, start double, end double, closed boolean, fill_ahead double"
    status = spark.createDataFrame([("A", 1, 0, 10.0, 12.0, False, 0.0), ("A", 2, 0, 4.0, 6.0, False, 60.0), ("A", 3, 0, 8.0, 8.5, True, None), ("B", 1, 0, 1.0, 2.0, False, 90.0)], gap)
    prices = spark.createDataFrame([("A", 8.0)], "symbol string, price double")
    got = {r.symbol: r for r in X.nearest_open_gaps(status, prices).collect()}
    assert (got["A"].gap_up.center, got["A"].gap_down.center, round(got["A"].close_prob, 3)) == (11.0, 5.0, 33.333)
    assert (got["B"].gap_up, got["B"].gap_down, got["B"].close_prob) == (None, None, 100.0)


def test_slots_give_whole_and_inside_bars(spark):
    """One table of months, split at the start of a period, gives what resampling all days and the days since then gives."""
    walks = bars(spark, walk("A", 400, 1), walk("B", 90, 2, dt.datetime(2000, 6, 20)))
    day = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    odd = spark.createDataFrame([("C", dt.datetime(2000, 8, 5), None, 2.0, 1.0, 1.5, None), ("C", dt.datetime(2000, 8, 25), 3.0, None, None, None, 7.0),
                                 ("D", dt.datetime(2000, 8, 5), 1.0, 1.0, 1.0, None, 1.0), ("E", None, 1.0, 1.0, 1.0, 1.0, 1.0),
                                 (None, dt.datetime(2000, 9, 1), 1.0, 2.0, 1.0, 2.0, 3.0)], day)
    daily, start = walks.union(odd), F.lit(dt.date(2000, 8, 16))
    for rule in ("ME", "W-FRI"):
        rows = stored(B.slots(daily, rule, start))
        inside = daily.where(F.col("ts") >= start.cast("timestamp_ntz"))
        for got, want in ((B.whole_slots(rows), B.resample(daily, rule)), (B.slots_inside(rows, "n"), B.resample(inside, rule, "n"))):
            assert got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert {r.symbol for r in rows.collect()} == {"A", "B", "C", "D", "E", None}


def test_parts_of_a_signal_share_the_slots(spark, sf):
    """Months are made of days once: days are read by the gaps alone. The rows are those of parts that each make their own."""
    daily = stored_supplier_bars(spark, sf)
    name = re.search(r"tickforge_\w+", daily._jdf.queryExecution().analyzed().toString())[0]
    for timeframe in ("1w", "1mo"):
        slots = X.stored_slots(daily, timeframe, AS_OF)
        shared = X.signal_inputs(daily, timeframe, AS_OF, slots)
        assert shared._jdf.queryExecution().optimizedPlan().toString().count(f"{name}[") == (timeframe == "1mo")
        assert sorted(map(repr, shared.collect())) == sorted(map(repr, X.signal_inputs(daily, timeframe, AS_OF).collect()))


def test_limits_of_zones_are_sorted_once(spark):
    z = Z.raw_zones(bars(spark, walk("A", 60, 3)), 70, False)
    plan = z._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and not any("sort_array" in line for line in plan.split("\n") if "filter(" in line)


def test_gap_rules_stand_outside_the_generator(spark):
    rows = X.positioned(bars(spark, walk("A", 60, 3)))
    plan = G.gaps_all(rows)._jdf.queryExecution().optimizedPlan().toString()
    (generator,) = [line for line in plan.split("\n") if "Generate" in line]
    assert "CASE" not in generator and "lambda" not in generator
