"""Quote figures, returns and risk statistics per symbol."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.scalars import clamp01, rnd
from tickforge.functions.windows import by_time, tail_rows

TRADING_DAYS = 252
RISK_FREE = 0.01




def ffill(bars: DataFrame, cols: Iterable[str]) -> DataFrame:
    past = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in cols})


def _change() -> Column:
    prev = F.lag("close").over(by_time())
    return F.try_divide(F.col("close") - prev, prev)


def daily_change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("daily_change", rnd(_change() * 100, 2))


def daily_returns(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(by_time())
    out = bars.withColumn("ret", F.try_divide(F.col("close"), prev) - 1)
    return out.where(F.col("ret").isNotNull())


def cummax(bars: DataFrame) -> DataFrame:
    past = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("peak", F.max("close").over(past))


def price_only(bars: DataFrame) -> DataFrame:
    """Price, change, low and high of the newest bar: two newest rows per symbol, one group."""
    two = tail_rows(bars, 2)
    newest = F.max_by(F.struct("close", "low", "high"), "ts")
    out = two.groupBy("symbol").agg(newest.alias("b"), F.min_by("close", "ts").alias("_prev"),
                                    F.count(F.lit(1)).alias("_n"))
    prev = F.when(F.col("_n") == 2, F.col("_prev"))
    return out.select("symbol", F.col("b.close").alias("current_price"),
                      rnd(F.try_divide(F.col("b.close") - prev, prev) * 100, 2)
                      .alias("daily_change"),
                      F.col("b.low").alias("daily_low"), F.col("b.high").alias("daily_high"))


def avg_volume(bars: DataFrame, n: int = 30) -> DataFrame:
    return tail_rows(bars, n).groupBy("symbol").agg(F.avg("volume").alias("avg_volume"))


def year_high_low(bars: DataFrame, as_of: dt.date) -> DataFrame:
    year = bars.where(F.col("ts") >= F.add_months(F.lit(as_of), -12).cast("timestamp_ntz"))
    return year.groupBy("symbol").agg(F.min("low").alias("year_low"),
                                      F.max("high").alias("year_high"))


def trailing_dividend(dividends: DataFrame, as_of: dt.date) -> DataFrame:
    cutoff = F.date_sub(F.lit(as_of), 365).cast("timestamp_ntz")
    return (dividends.where(F.col("ts") >= cutoff).groupBy("symbol")
            .agg(F.sum("amount").alias("dividend_rate")))


# Bars back for each performance figure.
PERFORMANCE_STEPS = {"momentum_1m": 21, "momentum_3m": 63, "return_1y": 252,
                     "return_3y": 756, "return_5y": 1260}


def performance(bars: DataFrame) -> DataFrame:
    """Returns, volatilities, drawdown, Sharpe and Sortino; one row per symbol.

    Windows on one sort give each bar its return and its distance from the newest bar; the
    statistics are then conditional aggregates of a single group-by on the same partitioning.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    s = bars.select("symbol", "ts", "close").withColumns({
        "_pos": F.row_number().over(by_time()), "_n": size,
        "ret": F.try_divide(F.col("close"), F.lag("close").over(by_time())) - 1,
        **{f"_c{n}": F.lag("close", n).over(by_time()) for n in PERFORMANCE_STEPS.values()}})
    s = s.withColumn("_rn", F.col("_n") - F.col("_pos") + 1)
    in_year = F.col("_rn") <= TRADING_DAYS
    peak = F.max(F.when(in_year, F.col("close"))).over(
        by_time().rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_dd", F.when(in_year, F.try_divide(F.col("close"), peak) - 1))

    root = F.sqrt(F.lit(float(TRADING_DAYS)))
    newest = F.col("_rn") == 1

    def vol(cond=None):
        r = F.col("ret") if cond is None else F.when(cond, F.col("ret"))
        return rnd(F.stddev_samp(r) * root * 100, 2)

    losses = F.when(in_year & (F.col("ret") < 0), F.col("ret"))
    agg = s.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.count("ret").alias("_nr"),
        *[F.max(F.when(newest, rnd(F.try_divide(F.col("close") - F.col(f"_c{n}"),
                                                    F.col(f"_c{n}")) * 100, 2))).alias(k)
          for k, n in PERFORMANCE_STEPS.items()],
        vol().alias("volatility"), vol(F.col("_rn") <= 30).alias("_v30"),
        vol(in_year).alias("_v1"), F.min("_dd").alias("_mdd"),
        F.avg(F.when(in_year, F.col("ret"))).alias("_mean"),
        F.count(losses).alias("_nl"), F.stddev_samp(losses).alias("_sl"))
    out = agg.withColumns({
        "volatility_30d": F.when(F.col("_nr") >= 30, F.col("_v30")),
        "volatility_1y": F.when(F.col("_nr") >= TRADING_DAYS, F.col("_v1")),
        "max_drawdown_1y": F.when(F.col("_n") >= TRADING_DAYS, rnd(F.col("_mdd") * 100, 2)),
        "_ann": F.pow(1 + F.col("_mean"), F.lit(float(TRADING_DAYS))) - 1,
        "_down": F.when(F.col("_nl") > 1, F.col("_sl") * root)})
    excess = F.col("_ann") - RISK_FREE
    out = out.withColumns({
        "sharpe_ratio": F.when(F.col("volatility_1y") > 0,
                               rnd(F.try_divide(excess, F.col("volatility_1y") / 100), 2)),
        "sortino_ratio": F.when(F.col("_down") > 0,
                                rnd(F.try_divide(excess, F.col("_down")), 2))})
    return out.select("symbol", *PERFORMANCE_STEPS, "volatility", "volatility_30d",
                      "volatility_1y", "max_drawdown_1y", "sharpe_ratio", "sortino_ratio")


def beta_join(bars: DataFrame, market: DataFrame, as_of: dt.date) -> DataFrame:
    """Returns of each symbol's newest 252 bars next to the market's returns of the last year.

    The market series is joined by date without a hint: Spark broadcasts it when its measured
    size allows, and otherwise shuffles by date, which spreads any single hot symbol.
    """
    year_start = F.add_months(F.lit(as_of), -12).cast("timestamp_ntz")
    m = market.where(F.col("ts") >= year_start)
    # one global series of at most a year of days: bounded, so one ordered window is fine
    whole = Window.partitionBy(F.lit(1)).orderBy("ts")
    mret = m.select("ts", (F.try_divide(F.col("close"), F.lag("close").over(whole)) - 1)
                    .alias("mret")).where(F.col("mret").isNotNull())
    ret = daily_returns(tail_rows(bars.select("symbol", "ts", "close"), TRADING_DAYS))
    return ret.select("symbol", "ts", "ret").join(mret, "ts")


def beta(bars: DataFrame, market: DataFrame, as_of: dt.date) -> DataFrame:
    both = beta_join(bars, market, as_of)
    var = F.var_samp("mret")
    enough = (F.count(F.lit(1)) > 10) & (var > 0)
    return both.groupBy("symbol").agg(
        F.when(enough, rnd(F.try_divide(F.covar_samp("ret", "mret"), var), 2)).alias("beta"))


# Weight of each risk score.
RISK_WEIGHTS = (0.20, 0.10, 0.20, 0.10, 0.10, 0.10, 0.10, 0.05, 0.05)


def _log10(x: Column) -> Column:
    return F.log10(F.when(x > 0, x))


def risk_index(perf: DataFrame) -> DataFrame:
    """Composite 0-100 index over the available scores, weights renormalised.

    Needs the columns of ``performance`` plus beta, current_price, avg_volume, market_cap. Where the average
    volume is missing or 0, a column ``volume`` stands in.
    """
    c = F.col
    if "volume" in perf.columns:
        perf = perf.withColumn("avg_volume", F.coalesce(F.nullif(c("avg_volume"), F.lit(0.0)), c("volume")))
    dollar = c("avg_volume") * c("current_price")
    liquidity = F.when(dollar.isNotNull(), clamp01((7.3 - _log10(dollar)) / F.lit(7.3 - 6.3))) \
        .otherwise(clamp01((6.5 - _log10(c("avg_volume"))) / F.lit(6.5 - 5.5)))
    regime = F.when(c("volatility") > 0, F.try_divide(c("volatility_30d"), c("volatility")))
    scores = (
        clamp01((c("volatility") - 15) / 25), clamp01((c("volatility_30d") - 15) / 25),
        clamp01((F.abs("max_drawdown_1y") - 10) / 25), clamp01((c("beta") - 0.9) / F.lit(0.6)),
        clamp01((1.2 - c("sharpe_ratio")) / F.lit(1.2)),
        clamp01((1.4 - c("sortino_ratio")) / F.lit(1.4)),
        liquidity, clamp01((10.0 - _log10(c("market_cap"))) / F.lit(0.7)),
        clamp01((regime - 1) / F.lit(0.6)))
    zero = F.lit(0.0)
    total = weight = zero
    for score, w in zip(scores, RISK_WEIGHTS):
        total = total + F.coalesce(score * F.lit(w), zero)
        weight = weight + F.when(score.isNotNull(), F.lit(w)).otherwise(zero)
    index = F.round(F.try_divide(total, F.when(weight > 0, weight)) * 100).cast("int")
    out = perf.withColumns({"vol_regime": regime, "avg_dollar_volume": dollar,
                            "risk_index": index})
    return out.withColumn("risk_level", F.when(c("risk_index").isNull(), "N/D")
                          .when(c("risk_index") >= 67, "Alto")
                          .when(c("risk_index") >= 34, "Medio").otherwise("Basso"))


def custom_performance(bars: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Return and annual growth between two dates, for symbols with two bars in the range."""
    rows = bars.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
                      & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
    years = (end - start).days / 365.25
    out = rows.groupBy("symbol").agg(
        F.min_by("close", "ts").alias("initial_price"),
        F.max_by("close", "ts").alias("final_price"), F.count(F.lit(1)).alias("_n"))
    i, f = F.col("initial_price"), F.col("final_price")
    out = out.where(F.col("_n") >= 2).withColumn("return_pct", F.try_divide(f - i, i) * 100)
    growth = F.pow(F.try_divide(f, i), F.lit(1.0 / years)) if years else F.lit(None).cast("double")
    return out.withColumn("cagr", (growth - 1) * 100).drop("_n")
