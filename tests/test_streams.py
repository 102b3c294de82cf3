"""Streams of several batches, with late, repeated and withdrawn rows and restarts, against their batch versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickforge.sources.stored import scratch_folder
from tickforge.streaming import live as L


def feed(spark, folder, schema, batch, number):
    """One more file; files are read in the order of their times, one a batch."""
    spark.createDataFrame(batch, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/n{number:03d}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_reactions_are_taken_back_over_batches_and_restarts(spark):
    schema = "portfolio_id long, user_id long, seq long, active boolean"
    rng = random.Random(3)
    folder, state = scratch_folder(spark, "input"), scratch_folder(spark, "stream")
    rows = [(1 if k % 3 else rng.randrange(2, 6), rng.randrange(40), rng.randrange(3000), rng.random() < 0.6) for k in range(300)]
    rows = list({r[:3]: r for r in rows}.values())
    batches = [rows[:100], rows[100:200] + rows[:20], rows[200:] + rows[50:90]]  # repeats; seq is not in order, so many rows are late
    batches.append([(9, 1, 5, True), (9, 1, 7, False), (9, 2, 6, None), (9, 3, 4, False), (None, 1, 1, True), (9, None, 1, True), (9, 4, None, True)])
    for n, batch in enumerate(batches):
        feed(spark, folder, schema, batch, n)
        if n != 1:  # the second start finds two files
            got = L.reaction_counts(L.settle(L.reaction_states(stream(spark, folder, schema)), ["portfolio_id", "user_id"], folder=state))
    last = {}
    for p, u, seq, active in [r for b in batches for r in b]:
        if None not in (p, u, seq) and (p, u) not in last or None not in (p, u, seq) and seq > last[p, u][0]:
            last[p, u] = seq, active is not False
    want = {p: sum(a for (q, _), (_, a) in last.items() if q == p) for p in {k[0] for k in last}}
    assert {r.portfolio_id: r.n for r in got.collect()} == want and want[9] == 1
    assert any(not a for _, a in last.values())


def test_candles_merge_ticks_and_drop_late_ones(spark):
    schema = "symbol string, ts timestamp, price double"
    folder, state = scratch_folder(spark, "input"), scratch_folder(spark, "stream")
    day = dt.datetime(2024, 3, 1)
    newest = spark.createDataFrame([("A", day, 10.0, 12.0, 9.0, 11.0), ("B", day, 1.0, 2.0, 0.5, 1.5), ("C", day, 5.0, 5.0, 5.0, 5.0)],
                                   "symbol string, ts timestamp, open double, high double, low double, close double")
    hour = dt.timedelta(hours=1)
    batches = [[("A", day + 9 * hour, 11.5), ("A", day + 8 * hour, 13.0), ("B", day + 9 * hour, -1.0), ("unknown", day, 3.0)],
               [("A", day + 10 * hour, 8.0), ("C", day + 72 * hour, 6.0)],  # the watermark passes the first day
               [("A", day + 11 * hour, 99.0), ("C", day + 71 * hour, 7.0)]]  # A's tick is too late; C's belongs to an earlier slot than the newest
    for n, batch in enumerate(batches):
        feed(spark, folder, schema, batch, n)
        settled = L.settle(L.live_candles(stream(spark, folder, schema), newest), ["symbol", "slot"], folder=state)
        got = {r.symbol: (r.open, r.high, r.low, r.close) for r in L.newest_candles(settled, newest).collect()}
        if n == 0:
            assert got == {"A": (10, 13, 9, 11.5), "B": (1, 2, 0.5, 1.5), "C": (5, 5, 5, 5)}
    assert got["A"] == (10, 13, 8, 8) and got["B"] == (1, 2, 0.5, 1.5) and got["C"] == (5, 6, 5, 6)


def test_ticker_events_go_on_over_batches_and_restarts(spark):
    schema = "portfolio_id long, seq long, tickers array<string>"
    rng = random.Random(8)
    folder, state = scratch_folder(spark, "input"), scratch_folder(spark, "stream")
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), seq, [rng.choice("abcde") for _ in range(rng.randrange(4))]) for seq in range(90)]
    for n in range(3):
        feed(spark, folder, schema, rng.sample(rows[30 * n:30 * n + 30], 30), n)
        if n != 1:  # the second start finds two files
            got = L.settle(stream(spark, folder, schema), ["portfolio_id"], mode="append", folder=state, step=L.ticker_events)
    last, want = {}, []
    for p, seq, tickers in rows:
        now = {t.upper() for t in tickers}
        if p in last:
            want += [(p, seq, "buy", t) for t in now - last[p]] + [(p, seq, "sell", t) for t in last[p] - now]
        last[p] = now
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 50
