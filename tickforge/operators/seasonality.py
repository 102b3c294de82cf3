"""Month-of-year seasonality. Groups are (symbol, month of history): bounded by the calendar.

Three percentile rules coexist in the analysis and are kept apart by name: linear quantiles
(``winsorize_returns``), element ``int(q*(n-1))`` (``month_percentiles``) and element
``floor(q*n)`` (``client_cumulative_percentiles``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.functions.windows import by_time
from tickforge.sources.bars import in_period, resample, slots_inside

LEAST_DAYS, LEAST_MONTHS, LEAST_MONTHS_OF_YEAR = 120, 6, 6
QUANTILES = {"p10": 0.10, "median": 0.50, "p90": 0.90}


def _whole() -> Window:
    return Window.partitionBy("symbol")


def monthly_returns(bars: DataFrame, as_of: dt.date | None = None, months: DataFrame | None = None) -> DataFrame:
    """Close against the previous kept month's close, for symbols with enough history. ``months`` are those of ``bars``
    if they are at hand (``slots``), split at the start of the period."""
    if months is not None:
        m = slots_inside(months, count="_days")
    else:
        if as_of is not None:
            bars = in_period(bars, "seasonality", "1d", as_of)
        m = resample(bars, "ME", count="_days")
    m = m.withColumns({"_all_days": F.sum("_days").over(_whole()),
                       "_months": F.count(F.lit(1)).over(_whole())})
    m = m.where((F.col("_all_days") >= LEAST_DAYS) & (F.col("_months") >= LEAST_MONTHS)
                & F.col("open").isNotNull() & (F.col("open") > 0))
    prev = F.lag("close").over(by_time())
    return m.select("symbol", "ts", F.year("ts").alias("year"), F.month("ts").alias("month"),
                    (F.try_divide(F.col("close"), prev) - 1).alias("_r")) \
        .withColumn("ret_pct", F.col("_r") * 100).drop("_r")


def winsorize_returns(returns: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Clip to the symbol's linear quantiles; months without a return stay null."""
    q = F.percentile("ret_pct", F.array(F.lit(low), F.lit(high))).over(_whole())
    out = returns.withColumn("_q", q)
    clipped = F.least(F.greatest(F.col("ret_pct"), F.col("_q")[0]), F.col("_q")[1])
    return out.withColumn("ret_pct", F.when(F.col("ret_pct").isNotNull(), clipped)).drop("_q")


def winsorize_array(values: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """Array form: non-finite entries keep their place, finite ones are clipped."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    clean = F.sort_array(F.filter(values, finite))
    n = F.size(clean)

    def quantile(p):
        at = (n - 1) * F.lit(p)
        lo = F.get(clean, F.floor(at).cast("int"))
        hi = F.get(clean, F.ceil(at).cast("int"))
        return lo + (hi - lo) * (at - F.floor(at))

    lo, hi = quantile(low), quantile(high)
    return F.when(n == 0, values).otherwise(F.transform(
        values, lambda x: F.when(finite(x), F.least(F.greatest(x, lo), hi)).otherwise(x)))


def seasonal_curve(returns: DataFrame, as_of: dt.date) -> DataFrame:
    """Rounded month returns; years with too few months go, except the running year."""
    valid = F.count("ret_pct").over(Window.partitionBy("symbol", "year"))
    out = returns.withColumn("_valid", valid)
    keep = (F.col("_valid") >= LEAST_MONTHS_OF_YEAR) | (F.col("year") == as_of.year)
    return (out.where(keep & F.col("ret_pct").isNotNull())
            .select("symbol", "year", "month", rnd("ret_pct", 2).alias("ret_pct")))


def cumulative_curve(curve: DataFrame) -> DataFrame:
    """Compounded within the year on the rounded months (at most twelve per group)."""
    so_far = (Window.partitionBy("symbol", "year").orderBy("month")
              .rowsBetween(Window.unboundedPreceding, 0))
    out = curve.withColumn("_v", F.collect_list("ret_pct").over(so_far))
    growth = F.aggregate("_v", F.lit(0.0), lambda a, v: (1 + a) * (1 + v / 100.0) - 1)
    return out.withColumn("cum_pct", rnd(growth * 100, 2)).drop("_v")


def curve_table(curve: DataFrame) -> DataFrame:
    """Wide form: year -> twelve month slots."""
    return curve.groupBy("symbol", "year").pivot("month", list(range(1, 13))) \
        .agg(F.first("ret_pct"))


def _twelve(df: DataFrame, value: str, position) -> DataFrame:
    """Percentile records of all twelve months, zeros where a month has no values.

    One group per symbol, a sorted list per month (one entry per year of history).
    """
    lists = [F.sort_array(F.collect_list(F.when(F.col("month") == m, F.col(value))))
             .alias(f"_m{m}") for m in range(1, 13)]
    g = df.groupBy("symbol").agg(*lists)

    def record(m):
        v = F.col(f"_m{m}")
        cells = [F.coalesce(F.get(v, position(q, F.size(v)).cast("int")), F.lit(0.0)).alias(n)
                 for n, q in QUANTILES.items()]
        return F.struct(F.lit(m).alias("month"), *cells)

    return g.select("symbol", F.inline(F.array(*[record(m) for m in range(1, 13)])))


def month_percentiles(curve: DataFrame, value: str = "ret_pct") -> DataFrame:
    out = _twelve(curve, value, lambda q, n: F.floor(F.lit(q) * (n - 1)))
    return out.select("symbol", "month", *[rnd(c, 2).alias(c) for c in QUANTILES])


def client_winsorize(curve: DataFrame) -> DataFrame:
    """Clip every cell to elements floor(.05(n-1)) and floor(.95(n-1)) of the symbol's values in order.

    The two elements are found by rank; no list of values is made."""
    place = F.row_number().over(_whole().orderBy(F.col("ret_pct").asc_nulls_last())) - 1
    out = curve.withColumns({"_i": place, "_n": F.count("ret_pct").over(_whole())})

    def element(q):
        return F.max(F.when(F.col("_i") == F.floor(F.lit(q) * (F.col("_n") - 1)), F.col("ret_pct"))).over(_whole())

    out = out.withColumns({"_lo": element(0.05), "_hi": element(0.95)})
    return out.withColumn("ret_pct", F.least(F.greatest("ret_pct", "_lo"), F.col("_hi"))).drop("_i", "_n", "_lo", "_hi")


def client_cumulative_percentiles(curve: DataFrame) -> DataFrame:
    """Additive running sum within the year; elements floor(q*n) per month."""
    so_far = (Window.partitionBy("symbol", "year").orderBy("month")
              .rowsBetween(Window.unboundedPreceding, 0))
    sums = curve.withColumn("cum", F.sum("ret_pct").over(so_far))
    return _twelve(sums, "cum", lambda q, n: F.floor(F.lit(q) * n))


def year_range_select(curve: DataFrame, first: int, last: int) -> DataFrame:
    return curve.where(F.col("year").between(first, last))


def month_stats(curve: DataFrame, month: int) -> DataFrame:
    wins = F.when(F.col("ret_pct") > 0, 100.0).otherwise(0.0)
    return (curve.where(F.col("month") == month).groupBy("symbol")
            .agg(F.avg("ret_pct").alias("avg_pct"), F.avg(wins).alias("win_rate")))


def trade_months(percentiles: DataFrame) -> DataFrame:
    """Buy in the first month with the lowest cumulative median, sell at the first peak after."""
    g = percentiles.groupBy("symbol").agg(
        F.min_by("month", F.struct("median", "month")).alias("buy_month"),
        F.collect_list(F.struct(F.col("median").alias("v"), (-F.col("month")).alias("m")))
        .alias("_all"))
    later = F.filter("_all", lambda x: -x["m"] >= F.col("buy_month"))
    return g.select("symbol", "buy_month", (-F.array_max(later)["m"]).alias("sell_month"))


def month_pair_percentiles(percentiles: DataFrame, month: int) -> DataFrame:
    """Rounded records of a month and the one after it."""
    return (percentiles.where(F.col("month").isin(month, month % 12 + 1))
            .select("symbol", "month", *[rnd(c, 2).alias(c) for c in QUANTILES]))
