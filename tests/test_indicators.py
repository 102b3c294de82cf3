"""Indicator columns against pandas, and the one-pass summary against the columns."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.util import BARS, bars, walk
from tickforge.functions.windows import positioned
from tickforge.operators import indicators as I


def series(spark, build, *frames):
    return build(positioned(bars(spark, *frames))).orderBy("symbol", "pos").toPandas()


def same(a, b, tol=1e-9):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    ok = ~np.isnan(a)
    np.testing.assert_allclose(a[ok], b[ok], rtol=tol, atol=1e-9)


def test_ema_over_several_segments_equals_recursion(spark):
    f = walk("A", 7000, 1)
    got = series(spark, lambda s: I.with_tema(I.with_ma_ema(s), (10, 200)), f)
    for p in I.MA_PERIODS:
        same(got[f"ema{p}"], f.close.ewm(span=p, adjust=False).mean(), 1e-10)
    for p in (10, 200):
        e1 = f.close.ewm(span=p, adjust=False).mean()
        e2 = e1.ewm(span=p, adjust=False).mean()
        same(got[f"tema{p}"], 3 * e1 - 3 * e2 + e2.ewm(span=p, adjust=False).mean(), 1e-9)


def test_averages_and_oscillators(spark):
    f = walk("A", 400, 2)
    got = series(spark, lambda s: I.with_adx(I.with_cci(I.with_rsi(I.with_hma(I.with_sma(s))))), f)
    c, h, lo = f.close, f.high, f.low

    def wma(x, n):
        w = np.arange(1, n + 1)
        return x.rolling(n).apply(lambda v: np.dot(v, w) / w.sum(), raw=True)

    for p in I.MA_PERIODS:
        same(got[f"sma{p}"], c.rolling(p).mean())
        same(got[f"hma{p}"], (2 * wma(c, p // 2) - wma(c, p)).rolling(math.isqrt(p)).mean(), 1e-8)
    d = c.diff()
    for p in (14, 7, 21):
        up, down = d.clip(lower=0).rolling(p).mean(), (-d.clip(upper=0)).rolling(p).mean()
        same(got[f"rsi{p}"], 100 - 100 / (1 + up / down))
    tp = (h + lo + c) / 3
    for p in (20, 50):
        dev = tp.rolling(p).apply(lambda v: np.mean(np.abs(v - v.mean())), raw=True)
        same(got[f"cci{p}"], (tp - tp.rolling(p).mean()) / (0.015 * dev), 1e-7)
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    trs = tr.rolling(14).sum()
    pdi = 100 * h.diff().clip(lower=0).rolling(14).sum() / trs
    mdi = 100 * (-lo.diff()).clip(lower=0).rolling(14).sum() / trs
    same(got["adx14"], ((pdi - mdi).abs() / (pdi + mdi) * 100).rolling(14).mean())


def test_flat_series_is_neutral(spark):
    f = walk("F", 30, 3)
    for c in ("open", "high", "low", "close"):
        f[c] = 50.0
    rows = {r["name"]: r for r in I.technicals_rows(bars(spark, f)).collect()}
    for name in ("RSI14", "Stochastic14", "CCI20", "CMF20", "WilliamsR14", "UltimateOsc"):
        assert rows[name]["value"] is None and rows[name]["action"] == "Neutral"
    assert rows["SMA10"]["action"] == "Neutral" and "SMA50" not in rows


def test_short_and_rising_histories(spark):
    short = {r["name"] for r in I.technicals_rows(bars(spark, walk("S", 9, 4))).collect()}
    assert not any(n.startswith(("SMA", "EMA", "WMA", "HMA", "TEMA")) for n in short)
    up = walk("U", 15, 5)
    up["close"] = np.arange(15) + 10.0
    up["high"], up["low"] = up["close"] + 1, up["close"] - 1
    rows = {r["name"]: r["value"] for r in I.technicals_rows(bars(spark, up)).collect()}
    assert rows["RSI14"] == 100.0


@pytest.mark.parametrize("n", [13, 27, 28, 64, 213, 500])
def test_summary_equals_the_series_columns(spark, n):
    f = walk("A", n, n)
    s = positioned(bars(spark, f))
    for step in (I.with_sma, lambda x: I.with_wma(x, I.MA_PERIODS), I.with_rsi, I.with_atr, I.with_adx,
                 lambda x: I.with_stochastic(x, (14, 50)), I.with_change, I.with_ultimate, I.with_cmf):
        s = step(s)
    last = s.orderBy(F.col("pos").desc()).first().asDict()
    got = I.latest_indicators(bars(spark, f)).first().asDict()
    names = [k for k in last if k in got and k not in ("symbol",)]
    assert len(names) > 20
    for k in names:
        if k[:3] in ("sma", "wma") and int(k[3:]) > n:
            continue
        same([last[k]], [got[k]], 1e-8)


def test_votes_need_both_lists(spark):
    rows = spark.createDataFrame(
        [("A", "ma", "x", 1.0, "Buy"), ("A", "osc", "y", 1.0, "Sell"), ("A", "osc", "z", 1.0, "Tendenza Forte"),
         ("B", "ma", "x", 1.0, "Buy"), ("B", "osc", "y", 1.0, "Buy")],
        "symbol string, grp string, name string, value double, action string")
    v = {r["symbol"]: r for r in I.tech_summary(I.vote_counts(rows)).collect()}
    assert v["A"]["overall"] == "Neutral" and v["B"]["overall"] == "Buy"
    assert v["B"]["strength_label"] == "Strong" and v["A"]["strength"] == 0.5


def test_cleaning_keeps_no_nan(spark):
    from tickforge.sources.bars import clean_bars
    t = dt.datetime(2001, 1, 1)
    raw = spark.createDataFrame([("A", t, "1", "NaN", None, "2", None), ("A", t, "1", "1", "1", "x", "1")],
                                BARS.replace("double", "string"))
    r = clean_bars(raw.drop("volume")).collect()
    assert [tuple(x)[3:] for x in r] == [(2.0, 2.0, 2.0, 0.0)]


def test_numeric_bars_are_not_read_as_texts(spark):
    from tickforge.sources.bars import clean_bars

    rows = [("A", 1, 1.0, None, float("nan"), 1e10, 3), ("A", 2, float("inf"), 2.0, 1.0, float("nan"), 4), ("A", 3, None, 5.0, 1.0, 1e-7, None)]
    bars = spark.createDataFrame(rows, "symbol string, ts int, open double, high float, low double, close double, volume int")
    out = clean_bars(bars)
    assert [tuple(r)[2:] for r in out.orderBy("ts").collect()] == [(1.0, 1e10, 1e10, 1e10, 3.0), (None, 5.0, 1.0, 1e-7, 0.0)]
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString().upper()


def test_rolling_frames_hold_one_aggregate(spark):
    from tickforge.functions.windows import along, positioned, roll

    values = [1.0, None, 2.0, 4.0, float("nan"), 8.0, 16.0, 32.0, None, 1.0]
    s = positioned(spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "symbol string, ts int, x double"))
    got = s.select("pos", roll(F.avg, F.col("x"), 2, along()).alias("mean"), roll(F.max, F.col("x"), 3, along()).alias("top"))
    rows = got.orderBy("pos").collect()
    assert [str(r.mean) for r in rows] == ["None", "None", "None", "3.0", "nan", "nan", "12.0", "24.0", "None", "None"]
    assert [str(r.top) for r in rows] == ["None"] * 4 + ["nan"] * 3 + ["32.0", "None", "None"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "count(" not in plan and "avg(" not in plan
