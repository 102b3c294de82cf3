"""Price gaps, how far later bars fill them, and closing probabilities.

Input is a positioned series ``(symbol, pos, ts, open, high, low, close)``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.sources.stored import stored

THRESHOLD = 0.01
CLOSE_AT = 50.0
LOOKAHEAD = 10
BLOCK = 32  # parts of a block in the closing search


def place() -> Window:
    return Window.partitionBy("symbol").orderBy("pos")


def _lag(col: str, n: int = 1) -> Column:
    return F.lag(col, n).over(place())


def _gap(ord_: int, kind: str, start: Column, end: Column, direction: str) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), start.alias("start"),
                    end.alias("end"), F.lit(direction).alias("direction"))


def _with_neighbours(rows: DataFrame) -> DataFrame:
    cols = {f"_{c}{n}": _lag(c, n) for c in ("open", "high", "low", "close") for n in (1, 2)}
    return rows.withColumns(cols)


def _two_candle() -> Column:
    up = F.col("low") > F.col("_high1") * (1 + THRESHOLD)
    down = F.col("high") < F.col("_low1") * (1 - THRESHOLD)
    return (F.when(up, _gap(0, "Gap Up", F.col("_high1"), F.col("low"), "up"))
            .when(down, _gap(0, "Gap Down", F.col("high"), F.col("_low1"), "down")))


def _three_candle() -> Column:
    c = F.col
    green = (c("close") > c("open")) & (c("_close1") > c("_open1")) & (c("_close2") > c("_open2"))
    red = (c("close") < c("open")) & (c("_close1") < c("_open1")) & (c("_close2") < c("_open2"))
    up = green & (c("low") >= c("_high2"))
    down = red & (c("high") <= c("_low2"))
    return (F.when(up, _gap(1, "Gap Up 3 candele", c("_high2"), c("low"), "up"))
            .when(down, _gap(1, "Gap Down 3 candele", c("high"), c("_low2"), "down")))


def _found(rows: DataFrame, *gaps: Column) -> DataFrame:
    keep = [c for c in rows.columns if not c.startswith("_")]
    kinds = [f"_kind{i}" for i in range(len(gaps))]
    # the kinds are columns first: they are compiled, where what stands inside a generator is interpreted for every bar
    found = _with_neighbours(rows).select(*keep, *[gap.alias(n) for n, gap in zip(kinds, gaps)])
    found = found.select(*keep, F.explode(F.array(*kinds)).alias("_g"))
    return found.where(F.col("_g").isNotNull()).select(*keep, "_g.*")


def gaps_two_candle(rows: DataFrame) -> DataFrame:
    return _found(rows, _two_candle())


def gaps_three_candle(rows: DataFrame) -> DataFrame:
    return _found(rows, _three_candle())


def gaps_all(rows: DataFrame) -> DataFrame:
    """Both kinds in one pass over the bars; a bar may yield two gaps."""
    return _found(rows, _two_candle(), _three_candle())


def gap_fill_pct(low: Column, high: Column) -> Column:
    """Share of the gap a bar with this low and high covers, 0-100; a gap of no size gives 0."""
    lower, upper = F.least("start", "end"), F.greatest("start", "end")
    size = F.when(upper - lower > 0, upper - lower)
    amount = F.when(F.col("direction") == "up", upper - F.greatest(low, lower)) \
        .otherwise(F.least(high, upper) - lower)
    pct = F.try_divide(amount, size) * 100
    return F.when(low.isNotNull() & high.isNotNull(),
                  F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct)), F.lit(0.0)))


def gap_size(gaps: DataFrame) -> DataFrame:
    size = F.abs(F.col("end") - F.col("start"))
    signed = F.when(F.col("direction") == "up", size).otherwise(-size)
    base = F.greatest(F.abs("start"), F.lit(1e-9))
    return gaps.withColumns({"abs_size": size, "signed_pct": signed / base * 100})


def gap_lookahead(rows: DataFrame, n: int = LOOKAHEAD) -> DataFrame:
    """Largest fill within the next ``n`` bars; null when no bar follows.

    The fill only depends on the lowest low (up) or the highest high (down) of the frame.
    """
    ahead = place().rowsBetween(1, n)
    ext = rows.withColumns({"ahead_low": F.min("low").over(ahead),
                            "ahead_high": F.max("high").over(ahead)})
    g = gaps_all(ext)
    return (g.withColumn("fill_ahead", gap_fill_pct(F.col("ahead_low"), F.col("ahead_high")))
            .drop("ahead_low", "ahead_high"))


def _with_later(rows: DataFrame) -> DataFrame:
    """The lowest low and the highest high of all later bars."""
    later = (Window.partitionBy("symbol").orderBy(F.col("pos").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"later_low": F.min("low").over(later),
                             "later_high": F.max("high").over(later)})


def gap_closed(rows: DataFrame) -> DataFrame:
    """All gaps with ``closed`` and ``fill_ahead`` only, where the fill at closing is not needed.

    The largest fill of all later bars follows from their lowest low and highest high, so
    running extremes from the newest bar backwards are enough: no search and no join.
    """
    most = gap_fill_pct(F.col("later_low"), F.col("later_high"))
    return (gap_lookahead(_with_later(rows)).withColumn("closed", F.coalesce(most >= CLOSE_AT, F.lit(False)))
            .drop("later_low", "later_high"))


def block_tower(rows: DataFrame, height: int) -> list[DataFrame]:
    """``tower[k - 1]``: blocks of ``BLOCK ** k`` bars as ``(symbol, blk, low, nhigh, cells_low, cells_nhigh)``, the extremes
    of a block and those of its at most ``BLOCK`` parts in order. All levels together have n * 32 / 31 cells."""
    level = rows.select("symbol", F.col("pos").alias("blk"), "low", (-F.col("high")).alias("nhigh"))
    tower = []
    for _ in range(height):
        parts = F.sort_array(F.collect_list(F.struct("blk", "low", "nhigh")))
        level = level.groupBy("symbol", F.floor(F.col("blk") / F.lit(BLOCK)).cast("int").alias("_up")).agg(
            F.min("low").alias("low"), F.min("nhigh").alias("nhigh"), parts.alias("_parts"))
        level = level.select("symbol", F.col("_up").alias("blk"), "low", "nhigh", F.col("_parts.low").alias("cells_low"),
                             F.col("_parts.nhigh").alias("cells_nhigh"))
        tower.append(level)
    return tower


def gap_status(rows: DataFrame) -> DataFrame:
    """All gaps with ``closed`` and ``fill_pct`` (fill at the first bar that closes the gap, or
    the largest fill if none does) and ``fill_ahead``.

    The first closing bar is found in a tower of block extremes, not by pairing bars. A gap climbs: it
    looks at the later parts of its own block of 32 bars, then of 32 * 32 and so on, until a part's
    extreme closes it; then it goes down into that part to the bar. Every step is an equi-join on
    (symbol, block), so the search has no hot symbol, and a gap never meets more than 32 cells
    a step, however long the history is. Down gaps are looked at upside down (``-high`` for
    ``low``), so one rule serves both directions. The rows are written once, because the height of the
    tower comes from the longest history.

    Only gaps that some later bar closes are searched for. That none does, and how far an open gap is filled, is known
    from the extreme of all later bars, a running one; so a reader of open gaps alone has no search and no join. Gaps without a symbol
    meet no bar: they stay open and unfilled.
    """
    rows = stored(rows, "positioned")
    longest, height = rows.agg(F.max("pos")).first()[0] or 0, 1
    while BLOCK ** height <= longest:
        height += 1
    tower = block_tower(rows, height)
    up = F.col("direction") == "up"
    lower, upper = F.least("start", "end"), F.greatest("start", "end")
    g = gap_lookahead(_with_later(rows)).withColumns({
        "_l": F.when(up, lower).otherwise(-upper), "_u": F.when(up, upper).otherwise(-lower),
        "_most": F.when(F.col("symbol").isNotNull(), F.when(up, F.col("later_low")).otherwise(-F.col("later_high")))}).drop("later_low", "later_high")
    g = g.withColumn("_s", F.when(F.col("_u") > F.col("_l"), F.col("_u") - F.col("_l")))

    def fill(x: Column) -> Column:
        return (F.col("_u") - F.greatest(x, F.col("_l"))) / F.col("_s") * 100

    def first(cells: Column) -> Column:
        """Place of the first cell that closes the gap, from 1; 0 if none does. Missing prices close nothing."""
        return F.coalesce(F.array_position(F.transform(cells, lambda x: x.isNotNull() & F.coalesce(fill(x) >= CLOSE_AT, F.lit(False))), F.lit(True)), F.lit(0)).cast("int")

    def step(g: DataFrame, level: int, looking: Column, block: Column, own: Column) -> DataFrame:
        """Gaps that are ``looking`` meet their block of a level; the others pass by under keys that no block has."""
        key = F.when(looking, block).otherwise(-1 - F.col("pos"))
        blocks = tower[level - 1].select(F.col("symbol").alias("_symbol"), F.col("blk").alias("_blk"), "cells_low", "cells_nhigh")
        g = g.withColumn("_key", key).join(blocks, (F.col("symbol") == F.col("_symbol")) & (F.col("_key") == F.col("_blk")), "left")
        cells = F.when(up, F.col("cells_low")).otherwise(F.col("cells_nhigh"))
        g = g.withColumn("_rest", F.slice(cells, own + 1, BLOCK)).withColumn("_n", first(F.col("_rest")))
        found = looking & (F.col("_n") > 0)
        g = g.withColumns({
            "_hit": F.when(found, F.get("_rest", F.col("_n") - 1)).otherwise(F.col("_hit")),
            "_at": F.when(found, F.col("_key") * BLOCK + own + F.col("_n") - 1).otherwise(F.col("_at")),
            "_level": F.when(found, F.lit(level - 1)).otherwise(F.col("_level"))})
        return g.drop("_symbol", "_blk", "_key", "cells_low", "cells_nhigh", "_rest", "_n")

    def reached(seen: Column) -> Column:
        part = F.coalesce(F.when(seen.isNotNull(), fill(seen)), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), part))

    closes = F.col("_most").isNotNull() & F.coalesce(fill(F.col("_most")) >= CLOSE_AT, F.lit(False))
    still_open = g.where(~closes).withColumns({"closed": F.lit(False), "fill_pct": reached(F.col("_most"))}).drop("_l", "_u", "_s", "_most")
    none = F.lit(None)
    g = g.where(closes).drop("_most").withColumns({"_level": none.cast("int"), "_at": none.cast("int"), "_hit": none.cast("double")})
    for level in range(1, height + 1):
        part = F.floor(F.col("pos") / F.lit(BLOCK ** (level - 1))).cast("int")
        g = step(g, level, F.col("_level").isNull(), F.floor(F.col("pos") / F.lit(BLOCK ** level)).cast("int"), part % BLOCK + 1)
    for level in range(height - 1, 0, -1):
        g = step(g, level, F.coalesce(F.col("_level") == level, F.lit(False)), F.col("_at"), F.lit(0))
    g = g.withColumns({"closed": F.lit(True), "fill_pct": reached(F.col("_hit"))}).drop("_hit", "_at", "_level", "_l", "_u", "_s")
    return still_open.unionByName(g)


def close_probability() -> Column:
    return F.avg(F.when(F.col("fill_ahead") >= CLOSE_AT, 100.0).otherwise(0.0))


def gap_close_probability(gaps: DataFrame) -> DataFrame:
    """Share of all gaps that are half filled within the look-ahead."""
    return gaps.groupBy("symbol").agg(close_probability().alias("close_prob"))


def gap_close_probability_by_type(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("symbol", "kind").agg(close_probability().alias("close_prob"))


def latest_open_gap(status: DataFrame) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), "ord")
    return (status.where(~F.col("closed")).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1)
            .select("symbol", "ts", "kind", "start", "end", "fill_pct"))


def gap_history(bars: DataFrame, as_of: dt.date, years: int = 5) -> DataFrame:
    return bars.where(F.col("ts") >= F.add_months(F.lit(as_of), -12 * years).cast("timestamp_ntz"))
