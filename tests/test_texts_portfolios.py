import random

import pytest
from pyspark.sql import functions as F

from tickforge.functions import scalars as T
from tickforge.functions.windows import numbered
from tickforge.operators import portfolio as O
from tickforge.operators import risk


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tickers(spark):
    raw = ["1INTC", "1intc.mi", " ab c ", "", None, "123"]
    assert apply(spark, T.normalize_ticker, raw) == ["INTC", "INTC.MI", "ABC", "", None, "123"]
    assert apply(spark, T.ticker_candidates, raw) == [
        ["1INTC.MI", "1INTC", "INTC"], ["1INTC.MI", "INTC.MI"], ["ABC"], [], [], ["123"]]
    assert apply(spark, T.fundamentals_candidates, raw)[1] == ["1INTC.MI", "INTC.MI", "INTC"]
    assert apply(spark, T.news_symbol, ["7eni.mi", "X.TO", "Y.T"]) == ["ENI", "X", "Y"]


def test_number_texts(spark):
    raw = ["1.2B", "-3,5", "12%", "—", "K", None, " 1,234 ", "n/a", "5e3", "1..2", "inf", "-2.5m"]
    got = apply(spark, T.parse_number, raw)
    assert got == [1.2e9, -35.0, 0.12, None, None, None, 1234.0, None, 5000.0, None, None, -2.5e6]


def test_rounding_scales(spark):
    r = spark.createDataFrame([(10083.845,), (2.675,), (0.125,), (-0.125,)], "x double")
    assert [x[0] for x in r.select(T.rnd("x", 2)).collect()] == [10083.84, 2.68, 0.13, -0.13]


def test_portfolio_list(spark):
    rows = [(1, 0, "a", " ", "1.5", "-1", "2", None, [f"t{i}" for i in range(13)]),
            (1, 1, "a", "dup", "9", "1", "1", "1", []),
            (1, 2, "", "N" * 81, "nan", "x", "1", "1", ["T1 ", "t1"])]
    df = spark.createDataFrame(rows, "owner_id int, position int, client_id string, name string, return_pct string, "
                               "entries_count string, open_count string, closed_count string, tickers array<string>")
    out = {r["client_id"]: r for r in O.portfolio_normalize(df).collect()}
    assert set(out) == {"a", "portfolio-3"}
    a, b = out["a"], out["portfolio-3"]
    assert a["name"] == "Portafoglio" and a["entries_count"] == 12 and len(a["tickers"]) == 12
    assert len(b["name"]) == 80 and b["return_pct"] == 0 and b["tickers"] == ["T1"] and b["entries_count"] == 1


def test_clashing_collection_ids(spark):
    item = "struct<id:string,name:string,visibility:string>"
    doc = [(1, "x-3", [("x", "a", "private"), ("x-2", None, None), ("x", None, "odd"), ("x-2", None, None), (" ", None, None)])]
    df = spark.createDataFrame(doc, f"owner_id int, active_id string, items array<{item}>")
    rows = O.collection_normalize(df).orderBy("position").collect()
    assert [r["id"] for r in rows] == ["x", "x-2", "x-3", "x-2-2", "portfolio-5"]
    assert [r["active"] for r in rows] == [False, False, True, False, False]
    assert rows[0]["visibility"] == "private" and rows[2]["visibility"] == "public" and rows[1]["name"] == "Portafoglio 2"


def plain_ids(ids):
    used = []
    for i, wanted in enumerate(ids):
        name = wanted.strip() or f"portfolio-{i + 1}"
        if name in used:
            k = 2
            while f"{name}-{k}" in used:
                k += 1
            name = f"{name}-{k}"
        used.append(name)
    return used


def test_many_clashing_ids_in_one_list(spark):
    rng = random.Random(3)
    lists = {1: ["x"] * 3000, 2: ["x-7", "x", "x-2"] * 60 + ["x", " "] * 50,
             **{i: [rng.choice(("a", "a-2", "a-3", "a-2-2", "b", " ", "portfolio-3")) for _ in range(40)] for i in range(3, 30)}}
    df = spark.createDataFrame([(i, None, [(x, None, None) for x in ids]) for i, ids in lists.items()],
                               "owner_id int, active_id string, items array<struct<id:string,name:string,visibility:string>>")
    got = {}
    for r in O.collection_normalize(df).orderBy("position").collect():
        got.setdefault(r["owner_id"], []).append(r["id"])
    assert got == {i: plain_ids(ids) for i, ids in lists.items()}


def test_default_collections(spark):
    item = ("x", "n", "private")
    rows = [(1, "q", None, None), (2, "q", [], None), (3, "q", [item], ["eni", " "]), (4, "q", [item], [" ", None]), (5, "x", [item], None), (6, None, None, [])]
    df = spark.createDataFrame(rows, "owner_id int, active_id string, items array<struct<id:string,name:string,visibility:string>>, entries array<string>")
    got = {r["owner_id"]: (r["id"], r["name"], r["visibility"], r["active"]) for r in O.collection_normalize(df).collect()}
    private = ("portfolio-1", "Portafoglio 1", "private", True)
    assert got == {1: private, 2: private, 3: ("portfolio-1", "Portafoglio 1", "public", True), 4: private, 5: ("x", "n", "private", True), 6: private}


def test_risk_index_takes_the_plain_volume(spark):
    none = ("volatility", "volatility_30d", "max_drawdown_1y", "beta", "sharpe_ratio", "sortino_ratio", "market_cap")
    rows = spark.createDataFrame([("a", 0.0, 1e6, 2.0), ("b", None, 1e6, 2.0), ("c", 1e6, 5.0, 2.0), ("d", 0.0, None, 2.0)],
                                 "symbol string, avg_volume double, volume double, current_price double").withColumns(
        {c: F.lit(None).cast("double") for c in none})
    got = {r["symbol"]: (r["avg_dollar_volume"], r["risk_index"]) for r in risk.risk_index(rows).collect()}
    assert got["a"] == got["b"] == got["c"] and got["a"][0] == 2e6 and got["a"][1] is not None and got["d"] == (None, None)


def test_bucketed_numbering_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    got = numbered(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100), "n").toPandas().sort_values("id")
    assert (got["n"] == got.groupby("k").cumcount() + 1).all()


def test_realized_trend_of_a_hot_portfolio(spark):
    day = 86_400_000
    rows = [(1, "p" if i % 3 else "q", i, "sold", 100.0 + i, 90.0 + 2 * i, (i * 37 % 400 + 1) * day, 5.0) for i in range(300)]
    rows += [(2, "r", 0, "bought", 50.0, 60.0, None, 20.0), (3, "s", 0, "bought", None, None, None, None)]
    df = spark.createDataFrame(rows, "owner_id int, portfolio_id string, position bigint, status string, initial_price double, "
                               "current_value double, closed_at bigint, value_return_pct double").withColumn("added_at", F.lit(0).cast("bigint"))
    got = O.realized_trend(df, 500 * day).toPandas()
    p = got[(got.portfolio_id == "p") & (got.part == 1)].sort_values(["ts", "position"])
    inv = val = 0.0
    exp = []
    for r in sorted((r for r in rows if r[1] == "p"), key=lambda r: (r[6], r[2])):
        inv, val = inv + r[4], val + r[5]
        exp.append((val - inv) / inv * 100)
    assert list(p.pct) == pytest.approx(exp, abs=0.006)
    end = {r.portfolio_id: r.pct for r in got[got.part == 2].itertuples()}
    assert end == {"p": 1000.0, "q": 500.0, "r": 20.0, "s": 0.0}


def test_toggle_by_last_set_and_parity(spark):
    log = [(1, 1, None, 1), (1, 1, None, 2), (1, 2, True, 1), (1, 2, None, 2), (1, 2, None, 3), (2, 1, False, 5), (2, 2, None, 1)]
    df = spark.createDataFrame(log, "portfolio_id int, user_id int, desired boolean, seq int")
    assert {tuple(r) for r in O.reaction_toggle(df).collect()} == {(1, 2), (2, 2)}
