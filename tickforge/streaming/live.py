"""Live prices, candles and portfolio events as Structured Streaming jobs.

Every function takes a streaming (or batch) DataFrame and returns one; ``settle`` runs a stream
over the data that is there and returns the final state per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.operators.portfolio import social_tickers
from tickforge.sources.stored import clear_scratch, scratch_folder

WATERMARK = "1 day"
SLOTS = {"1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def ticks_from_events(spark: SparkSession, folder: str, schema: str, name: str = "events.parquet") -> DataFrame:
    """File stream of one table of a folder; naive times become instants for the watermark."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def live_price(ticks: DataFrame) -> DataFrame:
    """Latest price per symbol, of ``(symbol, ts, price)``."""
    return ticks.groupBy("symbol").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("last_update"))


def live_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """OHLCV per tumbling slot. The state per slot is five numbers; late ticks inside the
    watermark correct their slot, later ones are dropped."""
    slot = F.window("ts", SLOTS[timeframe])
    return ticks.withWatermark("ts", WATERMARK).groupBy("symbol", slot.alias("slot")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    ).select("symbol", F.col("slot.start").alias("ts"), "open", "high", "low", "close", "volume")


def live_candles(ticks: DataFrame, newest: DataFrame, timeframe: str = "1d") -> DataFrame:
    """``(symbol, slot, last_tick, ts, open, high, low, close)`` in update mode: the ticks of a slot merged into the newest candle of
    their symbol, ``newest(symbol, ts, open, high, low)``.

    The merge is part of the stream: a windowed aggregate of the ticks, then a join with the table of candles. Ticks that come
    later than the watermark are dropped, so a slot's state ends; symbols without a candle or ticks have no row."""
    slot = F.window("ts", SLOTS[timeframe])
    live = ticks.where("price > 0").withWatermark("ts", WATERMARK).groupBy("symbol", slot.alias("slot")).agg(
        F.max_by("price", "ts").alias("close"), F.max("price").alias("_high"), F.min("price").alias("_low"), F.max("ts").alias("last_tick"))
    return live.join(newest.select("symbol", "ts", "open", "high", "low"), "symbol").select(
        "symbol", F.col("slot.start").alias("slot"), "last_tick", "ts", "open", F.greatest("high", "_high").alias("high"),
        F.least("low", "_low").alias("low"), "close")


def newest_candles(settled: DataFrame, newest: DataFrame) -> DataFrame:
    """One candle per symbol of ``newest``: the merged one of its newest slot, else the candle as it is."""
    last = Window.partitionBy("symbol").orderBy(F.col("slot").desc())
    merged = settled.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("symbol", "ts", "open", "high", "low", "close")
    return merged.unionByName(newest.select(merged.columns).join(merged.select("symbol"), "symbol", "left_anti"))


def reaction_states(reactions: DataFrame) -> DataFrame:
    """``(portfolio_id, user_id, active)`` in update mode from ``(portfolio_id, user_id, seq, active)``: the last word of every user.

    The highest ``seq`` decides, so repeated and late rows change nothing; a null ``active`` is a reaction. The state
    is one row per portfolio and user, as many as the table of reactions has, and no portfolio is one task."""
    rows = reactions.where("portfolio_id IS NOT NULL AND user_id IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("portfolio_id", "user_id").agg(F.max_by(F.coalesce("active", F.lit(True)), "seq").alias("active"))


def reaction_counts(states: DataFrame) -> DataFrame:
    """``(portfolio_id, n)``: users whose last word stands; a reaction taken back lowers the count, down to 0."""
    return states.groupBy("portfolio_id").agg(F.count_if("active").alias("n"))


def ticker_events(snapshots: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """buy/sell events of the ``(portfolio_id, seq, tickers)`` snapshots of one micro-batch, and the newest list of every
    portfolio, ``(portfolio_id, tickers)``, which the next batch gets as ``before``. It is a step for ``settle``.

    A portfolio's first snapshot gives no events; a missing list is an empty one."""
    none = F.array().cast("array<string>")
    rows = snapshots.select("portfolio_id", "seq", F.coalesce(social_tickers(F.col("tickers")), none).alias("tickers"), F.lit(1).alias("_new"))
    if before is not None:
        seq = F.lit(None).cast(snapshots.schema["seq"].dataType)
        rows = rows.unionByName(before.select("portfolio_id", seq.alias("seq"), "tickers", F.lit(0).alias("_new")))
    along = Window.partitionBy("portfolio_id").orderBy("_new", F.col("seq").asc_nulls_last())
    rows = rows.withColumns({"_old": F.lag("tickers").over(along), "_last": F.lead("_new").over(along).isNull()})

    def moves(action: str, here: str, there: str) -> Column:
        gone = F.filter(here, lambda x: ~F.array_contains(F.col(there), x))
        return F.transform(gone, lambda x: F.struct(F.lit(action).alias("action"), x.alias("ticker")))

    events = rows.where("_new = 1 AND _old IS NOT NULL").select(
        "portfolio_id", "seq", F.inline(F.concat(moves("buy", "tickers", "_old"), moves("sell", "_old", "tickers"))))
    return events, rows.where("_last").select("portfolio_id", "tickers")


# --- running a stream to the end of the available data -----------------------------------------

def settle(stream: DataFrame, keys: Sequence[str], mode: str = "update", folder: str | None = None,
           step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """Process what is available and return the last version of each key. With the ``folder`` of an earlier call the
    stream goes on where that call ended, with its state.

    A ``step`` makes the rows of a micro-batch from the batch and from the table that the step left behind for it after the
    batch before; that table is the state, and joins and windows of Spark work on it without a call per key.

    Each micro-batch is written under its own number and a repeated batch overwrites itself, so
    a restart after a lost executor neither loses nor doubles rows. Nothing goes through the driver.
    """
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        if step is not None:
            before = batch.sparkSession.read.parquet(f"{folder}/left/b{number - 1}") if number else None
            batch, left = step(batch, before)
            left.write.mode("overwrite").parquet(f"{folder}/left/b{number}")
            clear_scratch(spark, f"{folder}/left/b{number - 2}")  # a repeated batch needs the table before it only
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/b{number}")

    (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).foreachBatch(write).start().awaitTermination())
    made = stream if step is None else step(spark.createDataFrame([], stream.schema), None)[0]
    rows = spark.read.option("recursiveFileLookup", "true").schema(
        made.withColumn("_batch", F.lit(0)).schema).parquet(f"{folder}/rows")
    if mode == "append":
        return rows.drop("_batch")
    cols = [c for c in made.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_r")).select(*keys, "_r.*")
