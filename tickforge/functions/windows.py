"""Window building blocks for bar series and for unbounded ledgers.

Two kinds of groups occur, and they are treated differently:

* Bar series. A frame of bars holds at most one row per symbol and time slot, so a symbol's
  group is bounded by the calendar (36,525 daily rows in a century) however many trades the
  symbol has: trade skew ends in the partial aggregation of ``bars_from_trades``.
  A window by symbol is then a bounded task.
* Ledgers (positions, events, list rows). A single owner may hold any share of the rows, so
  these never get one window per owner: ``numbered`` and ``running_totals`` cut each group
  into buckets, work inside (group, bucket) and carry only per-bucket summaries.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickforge.sources.stored import stored

# Rows per EMA segment: the inverse decay of the shortest span (2) stays below 1e96, and the value at
# the end of a segment is carried in full, so every span and history length is exact.
SEGMENT = 200


def by_time(order: str = "ts") -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(order)


def back(n: int, order: str = "ts") -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return by_time(order).rowsBetween(-(n - 1), 0)


def roll(agg, col: Column, n: int, spec: WindowSpec) -> Column:
    """``agg`` over the last ``n`` rows of ``spec`` of a positioned series, null until ``n`` values are present.

    A frame is gone through again for every row, so it holds one aggregate: that all values are present is known from the
    place of the last missing one, a running maximum, and a mean is the sum of a full frame by ``n``."""
    frame = spec.rowsBetween(-(n - 1), 0)
    missing = F.max(F.when(col.isNull(), F.col("pos"))).over(spec.rowsBetween(Window.unboundedPreceding, 0))
    value = F.sum(col).over(frame) / F.lit(float(n)) if agg is F.avg else agg(col).over(frame)
    return F.when(F.col("pos") - F.coalesce(missing, F.lit(-1)) >= n, value)


# --- positioned series ----------------------------------------------------------------

# Every window of a positioned series sorts by (symbol, seg, pos): one sort serves them all.
def along() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("seg", "pos")


def in_segment() -> WindowSpec:
    return Window.partitionBy("symbol", "seg").orderBy("pos")


def positioned(bars: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Add ``pos`` (0-based place in the symbol's history) and ``seg`` (EMA segment)."""
    out = bars.withColumn("pos", F.row_number().over(by_time()) - 1)
    return out.withColumn("seg", F.floor(F.col("pos") / F.lit(segment)).cast("int"))


def with_ema(series: DataFrame, specs: Mapping[str, tuple[str, int]], segment: int = SEGMENT) -> DataFrame:
    """Add exponential means ``{name: (source column, span)}`` that start at the first value.

    ``y0 = x0; y = a*x + (1-a)*y_prev`` is, inside a segment, a prefix sum of inversely decayed
    terms. Each segment's last row folds the own parts of all segments up to it into the full value,
    which the next segment carries in with its remaining weight. ``segment`` is that of ``positioned``.
    """
    for _, span in specs.values():
        if span < 1 or segment * math.log((span + 1) / max(span - 1, 1e-9)) > 300 and span > 1:
            raise ValueError(f"span {span} does not fit segments of {segment} rows")
    k = F.col("pos") - F.col("seg") * F.lit(segment)
    running = in_segment().rowsBetween(Window.unboundedPreceding, 0)
    until = along().rowsBetween(Window.unboundedPreceding, 0)
    earlier = along().rowsBetween(Window.unboundedPreceding, -1)
    last = k == segment - 1
    plain = {name: F.col(source).cast("double") for name, (source, span) in specs.items() if span == 1}
    specs = {name: v for name, v in specs.items() if v[1] > 1}
    part = {}
    for name, (source, span) in specs.items():
        alpha = 2.0 / (span + 1.0)
        keep = F.lit(1.0 - alpha)
        weight = F.when(F.col("pos") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        part[f"_part_{name}"] = (F.sum(weight * F.col(source) * F.pow(keep, -k)).over(running)
                                 * F.pow(keep, k))
    out = series.withColumns(part)
    tails, full = {}, {}
    for name, (_, span) in specs.items():
        whole = F.lit((1.0 - 2.0 / (span + 1.0)) ** segment)
        ends = F.collect_list(F.when(last, F.col(f"_part_{name}"))).over(until)  # one value per segment
        tails[f"_tail_{name}"] = F.when(last, _folded(ends, whole))
    out = out.withColumns(tails)
    for name, (_, span) in specs.items():
        keep = F.lit(1.0 - 2.0 / (span + 1.0))
        carry = F.coalesce(F.last(f"_tail_{name}", ignorenulls=True).over(earlier), F.lit(0.0))
        full[name] = F.col(f"_part_{name}") + carry * F.pow(keep, k + 1)
    return out.withColumns(full | plain).drop(*part, *tails)


def _folded(ends: Column, whole: Column) -> Column:
    return F.aggregate(ends, F.lit(0.0), lambda y, t: y * whole + t)


def tail_rows(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of each symbol (Spark prunes to ``n`` before the shuffle)."""
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return (bars.withColumn("_rn", F.row_number().over(newest))
            .where(F.col("_rn") <= n).drop("_rn"))


# --- ledgers: groups of any size --------------------------------------------------------

def _carried(df: DataFrame, keys: Sequence[str], bucket: Column,
             sums: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` with its bucket, and per (group, bucket) the totals of all earlier buckets."""
    cut = df.withColumn("_bucket", bucket)
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])
    return cut, offsets


def _attach(cut: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = cut["_bucket"].eqNullSafe(offsets["_k_bucket"])
    for k in keys:
        on = on & cut[k].eqNullSafe(offsets[f"_k_{k}"])
    return cut.join(offsets, on).drop("_k_bucket", *[f"_k_{k}" for k in keys])


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "range") -> DataFrame:
    """``df`` as a table cut into ranges of (group, order) between sampled splitters, with the number of the range.

    A range is a bucket for ``running_totals`` and ``numbered`` that holds about as many rows as any other, whatever share of
    the rows falls on one group and one day. ``order`` should tell the rows of a group apart."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(name, F.spark_partition_id())
    return stored(ranged, "ranges")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   bucket: Column, sums: Mapping[str, Column]) -> DataFrame:
    """Running sums per group in ``order``, without putting a whole group into one task.

    ``bucket`` must not decrease along ``order``. Bucket totals are aggregated map-side, their
    prefix is taken over the few bucket rows of a group, and only rows of one
    (group, bucket) are sorted together.
    """
    cut, offsets = _carried(df, keys, bucket, sums)
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    joined = _attach(cut, offsets, keys)
    out = joined.withColumns({n: F.sum(c).over(inside) + F.col(f"_off_{n}")
                              for n, c in sums.items()})
    return out.drop("_bucket", *[f"_off_{n}" for n in sums])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
             bucket: Column, name: str) -> DataFrame:
    """1-based row number per group in ``order``, bucket-wise like ``running_totals``."""
    cut, offsets = _carried(df, keys, bucket, {"_n": F.lit(1)})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = _attach(cut, offsets, keys)
    return (joined.withColumn(name, F.row_number().over(inside) + F.col("_off__n"))
            .drop("_bucket", "_off__n"))
