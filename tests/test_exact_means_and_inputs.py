"""Means over several segments, inputs with odd texts, empty tasks, shared folders."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.util import bars, walk
from tickforge.functions import scalars as S
from tickforge.functions.windows import in_ranges, positioned, running_totals, with_ema
from tickforge.operators import correlation as C
from tickforge.operators import indicators as I
from tickforge.operators import portfolio as O
from tickforge.sources import bars as B
from tickforge.sources import stored as D

SPANS = (1, 2, 3, 5, 9, 200, 1000)


@pytest.mark.parametrize("segment", [50, 200])
def test_ema_of_every_span_over_many_segments(spark, segment):
    f = walk("A", 900, 5)
    rows = with_ema(positioned(bars(spark, f), segment), {f"e{p}": ("close", p) for p in SPANS}, segment).orderBy("pos").toPandas()
    for p in SPANS:
        np.testing.assert_allclose(rows[f"e{p}"], f.close.ewm(span=p, adjust=False).mean(), rtol=1e-11)


def test_spans_that_do_not_fit_are_refused(spark):
    rows = positioned(bars(spark, walk("A", 5, 1)))
    with pytest.raises(ValueError):
        with_ema(rows, {"e": ("close", 0)})


def test_small_prices_after_large_ones_keep_their_digits(spark):
    f = walk("A", 1200, 6)
    f.loc[:599, "close"] *= 1e7
    rows = I.with_wma(I.with_sma(positioned(bars(spark, f))), I.MA_PERIODS).orderBy("pos").toPandas().iloc[900:]
    for p in I.MA_PERIODS:
        w = np.arange(1, p + 1)
        np.testing.assert_allclose(rows[f"sma{p}"], f.close.rolling(p).mean()[900:] if p < 200 else [f.close[i - p + 1:i + 1].mean() for i in range(900, 1200)], rtol=1e-9)
        np.testing.assert_allclose(rows[f"wma{p}"], [np.dot(f.close[i - p + 1:i + 1], w) / w.sum() for i in range(900, 1200)], rtol=1e-9)


def test_moments_of_empty_tasks_and_many_keys(spark, monkeypatch):
    rows = spark.createDataFrame(pd.DataFrame({"symbol": ["A", "B", "A", "B"], "fold": [0, 0, 1, 0], "x": [1.0, 2.0, 3.0, 4.0], "y": [0.0, 1.0, 1.0, 5.0]}))
    want = sorted((r.symbol, r.fold, r.n) for r in C.moments(rows.coalesce(1), ("x", "y")).collect())
    assert C.moments(rows.repartition(9).where("x > 100"), ("x", "y")).count() == 0
    monkeypatch.setattr(C, "HELD_KEYS", 1)
    parts = C.moments(rows.repartition(7), ("x", "y")).groupBy("symbol", "fold").agg(F.sum("n").alias("n"))
    assert sorted(tuple(r) for r in parts.collect()) == want


def test_white_space_counts_and_number_texts(spark):
    row = spark.createDataFrame([("\tAAPL\n", "12\t", "4000000000", "3d", " 5 ")], "t string, n string, i string, j string, k string").select(
        S.normalize_ticker(F.col("t")), S.parse_number(F.col("n")), S.coerce_non_negative_int(F.col("i")), S.coerce_float(F.col("j")),
        S.coerce_float(F.col("k")), S.coerce_non_negative_int(F.col("j")), S.to_text(F.col("t"))).first()
    assert tuple(row) == ("AAPL", 12.0, 4_000_000_000, 0.0, 5.0, 0, "AAPL")


def test_gap_rows_with_times_and_bars_with_suffixes(spark):
    rows = spark.createDataFrame([("A", i, d, 1.0, 1.0, 1.0, 1.0) for i, d in enumerate(("2024-01-02 10:00", "2024-01", "2024-01-03", "soon", None))],
                                 "symbol string, idx int, date string, open double, high double, low double, close double")
    assert [r.idx for r in B.valid_gap_rows(rows).orderBy("pos").collect()] == [0, 1, 2]
    texts = spark.createDataFrame([("A", "2024-01-01", "1", "2", "1", "3d", "5"), ("A", "2024-01-02", "1", "2", "1", "1.5", "5f")],
                                  "symbol string, ts string, open string, high string, low string, close string, volume string")
    (r,) = B.clean_bars(texts).collect()
    assert (r.close, r.volume) == (1.5, 0.0)


def test_every_portfolio_has_three_scopes(spark):
    rows = spark.createDataFrame([(1, 1, "open", None, 2.0, None)], "owner_id int, portfolio_id int, status string, initial_price double, current_value double, value_return_pct double")
    got = {r.scope: (r.invested, r.current, r.return_pct, r.n) for r in O.portfolio_summary(rows).collect()}
    assert got == {"total": (0.0, 2.0, 0.0, 1), "open": (0.0, 2.0, 0.0, 1), "closed": (0.0, 0.0, 0.0, 0)}


def test_an_owner_who_saves_an_empty_list_loses_all(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, 11, "c")], "id long, owner_id long, client_id string")
    new = spark.createDataFrame([(11, "b")], "owner_id long, client_id string")
    saved = spark.createDataFrame([(10,), (11,)], "owner_id long")
    assert sorted(r.id for r in O.replace_missing(old, new, saved).collect()) == [1, 3]
    assert sorted(r.id for r in O.replace_missing(old, new).collect()) == [3]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": self.folder}.get(key, default)

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    Session.conf.folder = None
    with pytest.raises(RuntimeError):
        D.shared_base(Session())
    Session.conf.folder = "hdfs://shared/"
    assert D.shared_base(Session()) == "hdfs://shared"
    Session.conf.folder, Session.sparkContext.master = None, "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        D.shared_base(Session())


def test_scratch_folders_can_be_cleared(spark):
    folder = D.scratch_folder(spark, "x")
    spark.range(3).write.parquet(folder)
    D.clear_scratch(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_bars_table_is_pruned_by_year_and_bucket(spark):
    frames = [walk(f"S{k}", 900, k) for k in range(12)]
    rows = bars(spark, *frames)
    name, folder = D.scratch_table(spark, "history")
    B.write_bars(rows, name, folder, buckets=4)
    every = B.scan_bars(spark, name)
    assert every.columns == rows.columns and every.count() == 12 * 900
    since = dt.date(2002, 3, 1)
    some = B.scan_bars(spark, name, ["S3"], since)
    plan = some.groupBy("symbol").count()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "SelectedBucketsCount: 1 out of 4" in plan and "Exchange" not in plan
    want = [(r.symbol, r.ts.to_pydatetime(), r.close) for r in frames[3].itertuples() if r.ts.date() >= since]
    assert sorted((r.symbol, r.ts, r.close) for r in some.collect()) == want and len(want) > 90
    read = {r.f for r in some.select(F.input_file_name().alias("f")).collect()}
    assert len(read) == 1 < len(every.inputFiles())
    assert len(every.inputFiles()) <= 3 * 4  # years and buckets, however many tasks wrote them
    D.clear_scratch(spark, folder)
    assert not spark.catalog.tableExists(name)
    gone = B.scan_bars(spark, name, ["S3"], since)
    assert gone.count() == 0 and gone.columns == rows.columns and gone.dtypes == rows.dtypes


def test_ranges_split_a_hot_group_and_a_hot_day(spark):
    rows = spark.range(4000).selectExpr("IF(id % 3 = 0, 'hot', concat('p', id % 50)) AS p", "IF(id % 2 = 0, 7, id % 30) AS day", "id")
    for setting, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(setting, value)
    try:
        ranged = in_ranges(rows, ["p"], [F.col("day"), F.col("id")])
        sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
        of_hot = ranged.where("p = 'hot'").select("range").distinct().count()
        got = running_totals(ranged, ["p"], [F.col("day"), F.col("id")], F.col("range"), {"total": F.col("id")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert of_hot >= 4 and max(sizes) < 4 * 4000 / 16
    totals, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.p, r.day, r.id)):
        totals[r.p] = totals.get(r.p, 0) + r.id
        want[r.id] = totals[r.p]
    assert {r.id: r.total for r in got} == want


def test_lists_of_number_texts_read_as_single_texts_do(spark):
    texts = [None, "", "  ", "N/A", "nd", "—", "%", "5%", "5 %", "5%%", "1.2B", "1.2 b", "1,2,3K%", "3d", "inf", "1e400", "+.5M", "K", "N/A%", "5%K", "5%3", "- %", "1E-3%", "\t7\n", "B%"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert rows.select(S.parse_number(F.col("x")).alias("one"), S.parse_numbers(F.array("x"))[0].alias("listed")).where("NOT one <=> listed").count() == 0
    # a step is not written again for each of its uses
    plans = [rows.select(c)._jdf.queryExecution().optimizedPlan().toString() for c in (S.parse_numbers(F.array("x")), F.transform(F.array("x"), S.parse_number))]
    assert plans[0].count("regexp_replace") * 5 < plans[1].count("regexp_replace")
