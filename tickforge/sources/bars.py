"""Bars: construction from trades or ticks, period scans, cleaning."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from tickforge.functions.scalars import rnd, strip
from tickforge.functions.windows import by_time, tail_rows

OHLCV = ("open", "high", "low", "close", "volume")

# Timeframe of the user -> interval code.
INTERVAL_OF_TIMEFRAME = {"1h": "60m", "4h": "240m", "1d": "1d", "1w": "1wk", "1mo": "1mo"}

# Months (or days) of history each analysis looks at, by interval code.
LOOKBACK = {
    "quote": {"60m": ("days", 60), "240m": ("days", 60), "1d": ("months", 72),
              "1wk": ("months", 120), "1mo": ("months", 240)},
    "technicals": {"60m": ("days", 60), "240m": ("days", 60), "1d": ("months", 24),
                   "1wk": ("months", 60), "1mo": ("months", 240)},
    "zones": {"60m": ("months", 3), "240m": ("months", 3), "1d": ("months", 6),
              "1wk": ("months", 60), "1mo": ("months", 240)},
    "history": {"60m": ("months", 3), "240m": ("months", 3), "1d": ("months", 6),
                "1wk": ("months", 60), "1mo": ("months", 240)},
    "correlation": {"1d": ("months", 120)},
    "seasonality": {"1d": ("months", 240)},
}


def sequence_key(*cols: tuple[Column, int]) -> Column:
    """One decimal that sorts like the given (column, digits) pairs.

    A fixed-width sort key keeps first/last-by aggregates in the hash aggregate; a struct key
    would make Spark sort every scan partition first.
    """
    total = 0
    out = None
    for col, digits in reversed(cols):
        term = col.cast("decimal(19,0)") * F.lit(10 ** total).cast(f"decimal({total + 1},0)")
        out = term if out is None else term + out
        total += digits
    return out.cast("decimal(38,0)")


def bars_from_trades(trades: DataFrame, slot: Column | None = None) -> DataFrame:
    """OHLCV bars of ``trades(symbol, ts, price, volume, seq)``, one per symbol and slot.

    Partial aggregates run before the shuffle, so a symbol with a third of all trades ships at
    most one row per slot and scan task.
    """
    at = F.col("ts") if slot is None else slot
    return trades.groupBy("symbol", at.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
    )


BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def write_bars(bars: DataFrame, table: str, path: str | None = None, buckets: int = 64) -> None:
    """Bars as a table of the session's catalog: a folder per year, in it a file per bucket of symbols, sorted by time.

    A year of a bucket is written by one task, so the number of files is years * buckets however many tasks there
    were. ``path`` makes it an external table."""
    year = F.coalesce(F.year("ts"), F.lit(0))
    rows = bars.withColumn("year", year)
    out = rows.repartition(buckets, "symbol").write.partitionBy("year").bucketBy(buckets, "symbol").sortBy("symbol", "ts").format("parquet")
    (out if path is None else out.option("path", path)).mode("errorifexists").saveAsTable(table)


def scan_bars(spark: SparkSession, table: str, symbols: list[str] | None = None,
              since: Column | dt.date | None = None) -> DataFrame:
    """Bars of a table of ``write_bars``; a table that is not there gives an empty frame.

    ``since`` prunes the folders of earlier years and ``symbols`` the files of other buckets before anything is read; both
    reach the Parquet scan as well."""
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], BARS)
    out = spark.table(table)
    if symbols is not None:
        out = out.where(F.col("symbol").isin(symbols))
    if since is not None:
        start = since if isinstance(since, Column) else F.lit(since)
        out = out.where((F.col("year") >= F.year(start)) & (F.col("ts") >= start.cast("timestamp_ntz")))
    return out.drop("year")


def period_start(analysis: str, timeframe: str, as_of: dt.date) -> Column:
    unit, n = LOOKBACK[analysis][INTERVAL_OF_TIMEFRAME.get(timeframe, "1d")]
    today = F.lit(as_of)
    return F.date_sub(today, n) if unit == "days" else F.add_months(today, -n)


def in_period(bars: DataFrame, analysis: str, timeframe: str, as_of: dt.date) -> DataFrame:
    """Bars inside the history an analysis looks at; ``as_of`` stands for today."""
    start = period_start(analysis, timeframe, as_of)
    return bars.where(F.col("ts") >= start.cast("timestamp_ntz"))


# numbers as texts, also infinities, which cleaning keeps
NUMERIC = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
DATED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def _number(name: str, types: Mapping[str, DataType]) -> Column:
    if name not in types:
        return F.lit(None).cast("double")
    text = F.col(name)
    value = text.try_cast("double")
    if isinstance(types[name], NumericType):  # a number always reads as one
        return F.when(~F.isnan(value), value)
    # a text must be a plain number: the cast alone takes suffixes like 3d
    return F.when(~F.isnan(value) & strip(text.cast("string")).rlike(NUMERIC), value)


def _types(bars: DataFrame) -> dict[str, DataType]:
    return {f.name: f.dataType for f in bars.schema}


def clean_bars(bars: DataFrame, fill_volume: bool = True) -> DataFrame:
    """Missing columns added, numbers coerced, high/low default to close, no close -> dropped."""
    types = _types(bars)
    num = {c: _number(c, types) for c in OHLCV}
    volume = F.coalesce(num["volume"], F.lit(0.0)) if fill_volume else num["volume"]
    out = bars.select("symbol", "ts", num["open"].alias("open"),
                      F.coalesce(num["high"], num["close"]).alias("high"),
                      F.coalesce(num["low"], num["close"]).alias("low"),
                      num["close"].alias("close"), volume.alias("volume"))
    return out.where(F.col("close").isNotNull())


def clean_bars_strict(bars: DataFrame, digits: int = 2) -> DataFrame:
    """History form: every price must be present, prices rounded."""
    types = _types(bars)
    prices = ("open", "high", "low", "close")
    out = bars.select("symbol", "ts", *[_number(c, types).alias(c) for c in prices])
    return (out.na.drop(subset=list(prices))
            .select("symbol", "ts", *[rnd(c, digits).alias(c) for c in prices]))


def history(bars: DataFrame, timeframe: str, as_of: dt.date, keep: int = 120) -> DataFrame:
    """History endpoint: period, newest ``keep`` rows, strict cleaning, formatted date."""
    rows = clean_bars_strict(tail_rows(in_period(bars, "history", timeframe, as_of), keep))
    pattern = "yyyy-MM" if timeframe == "1mo" else "yyyy-MM-dd"
    return rows.withColumn("date", F.date_format("ts", pattern))


def bar_date(interval: str, ts: Column) -> Column:
    """Bar label: any interval code with an "m" (also ``1mo``) shows the minute."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm" if "m" in interval else "yyyy-MM-dd")


def valid_gap_rows(rows: DataFrame) -> DataFrame:
    """Rows ``(symbol, idx, date, open..close)`` with a readable date and finite prices.

    ``date`` may be ``yyyy-MM`` (day 1) or carry a time. ``idx`` is the place before the filter and is kept;
    ``pos`` is the place after it, which all gap rules use.
    """
    day = F.coalesce(F.try_to_date("date", "yyyy-MM-dd").cast("timestamp_ntz"),
                     F.try_to_date(F.concat("date", F.lit("-01")), "yyyy-MM-dd").cast("timestamp_ntz"),
                     F.when(F.col("date").rlike(DATED), F.col("date").try_cast("timestamp_ntz")))
    num = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close")}
    out = rows.select("symbol", "idx", "date", day.alias("ts"),
                      *[c.alias(n) for n, c in num.items()])
    keep = F.col("ts").isNotNull()
    for c in num:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    place = Window.partitionBy("symbol").orderBy("idx")
    return out.where(keep).withColumn("pos", F.row_number().over(place) - 1)


def naive_sorted(bars: DataFrame) -> DataFrame:
    """Time zone dropped (wall clock kept), place in time order as ``pos``."""
    out = bars.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return out.withColumn("pos", F.row_number().over(by_time()) - 1)


def _slot(rule: str) -> Column:
    if rule == "W-FRI":
        slot = F.next_day(F.date_sub(F.col("ts").cast("date"), 1), "FRI")
    elif rule == "ME":
        slot = F.last_day(F.col("ts").cast("date"))
    else:
        raise ValueError(f"unknown rule {rule}")
    return slot.cast("timestamp_ntz").alias("ts")


def _grouped(bars: DataFrame, order: str, *keys: Column | str) -> DataFrame:
    """One bar per group: the first open and the last close that are there, by ``order``."""
    def has(c):
        return F.when(F.col(c).isNotNull(), F.col(order))

    counts = [c for c in bars.columns if c == "days"]
    return bars.groupBy(*keys).agg(
        F.min_by("open", has("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", has("close")).alias("close"),
        F.sum("volume").alias("volume"),
        *([F.sum("days").alias("days")] if counts else [F.count(F.lit(1)).alias("days")]),
    )


def resample(bars: DataFrame, rule: str, count: str | None = None) -> DataFrame:
    """Weekly bars ending Friday (``W-FRI``) or month-end bars (``ME``) of daily bars.

    ``count`` names an extra column with the number of source bars.
    """
    out = _grouped(bars.drop("days"), "ts", "symbol", _slot(rule))
    out = out.withColumnRenamed("days", count) if count else out.drop("days")
    return out.where(F.col("close").isNotNull())


def slots(daily: DataFrame, rule: str, start: Column) -> DataFrame:
    """Weeks or months of daily bars for several readers, some of whole slots and some of the days from ``start`` on only.

    ``(symbol, ts, open, high, low, close, volume, days, inside)``: the slot of ``start`` is two rows, the days before it
    and those from it on (``inside``). Slots without a close are kept, so every symbol has a row."""
    inside = F.coalesce(F.col("ts") >= start.cast("timestamp_ntz"), F.lit(False)).alias("inside")
    return _grouped(daily.drop("days"), "ts", "symbol", _slot(rule), inside)


def whole_slots(rows: DataFrame) -> DataFrame:
    """``resample`` of all days, from ``slots``."""
    return _grouped(rows, "inside", "symbol", "ts").where(F.col("close").isNotNull()).drop("days")


def slots_inside(rows: DataFrame, count: str | None = None) -> DataFrame:
    """``resample`` of the days from the start on, from ``slots``."""
    out = rows.where(F.col("inside") & F.col("close").isNotNull()).drop("inside")
    return out.withColumnRenamed("days", count) if count else out.drop("days")


def downsample(rows: DataFrame, most: int) -> DataFrame:
    """Every ceil(n/most)-th bar of a symbol plus its last one; short series unchanged."""
    place = F.row_number().over(by_time()) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    out = rows.withColumn("_p", place).withColumn("_n", size)
    step = F.ceil(F.col("_n") / F.lit(float(most)))
    return (out.where((F.col("_n") <= most) | (F.col("_p") % step == 0)
                      | (F.col("_p") == F.col("_n") - 1)).drop("_p", "_n"))
