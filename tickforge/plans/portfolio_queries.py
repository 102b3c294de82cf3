"""Portfolios and the social feed (survey 2.3-2.5, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.operators import portfolio as O
from tickforge.operators import signal as X
from tickforge.plans.data import AS_OF, stored_supplier_bars, table
from tickforge.plans.registry import query
from tickforge.plans.signal_queries import SIGNAL_SQL

VIEWER = 7
NOW_MS = 1_004_832_000_000  # 2001-11-04

# Column expressions both engines read the same way.
_PID = "o_custkey * 5 + CAST(substr(o_orderpriority, 1, 1) AS INT)"
_TICKER = "concat('T', o_orderkey % 97)"
_INITIAL = "CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END"
_SOLD = "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN o_totalprice * (0.75D + (o_orderkey % 50) / 100D) END"
_LOCKED = "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN (o_orderkey % 40) - 15D END"
_POS = {"owner_id": "o_custkey", "portfolio_id": "o_orderpriority", "position": "o_orderkey", "ticker": _TICKER,
        "status": "CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'bought' END", "initial_price": _INITIAL,
        "sold_price": _SOLD, "locked_return_pct": _LOCKED,
        "short_name": "CASE WHEN o_orderkey % 5 = 0 THEN concat('Entry ', o_orderkey) END",
        "visibility": "CASE WHEN o_custkey % 3 = 0 THEN 'private' ELSE 'public' END"}


def _duck(e):
    return e.replace("0.75D", "0.75::DOUBLE").replace("100D", "100.0::DOUBLE").replace("15D", "15.0::DOUBLE")


_POS_SQL = f"""pos AS (SELECT {', '.join(f'{_duck(e)} AS {n}' for n, e in _POS.items())}, epoch_ms(o_orderdate) AS added_at,
 CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + 2592000000 END AS sold_at FROM orders),
 quotes AS (SELECT concat('T', p_partkey % 89) AS ticker, round(avg(p_retailprice), 2) AS quote_price, min(p_name) AS quote_name, max(p_type) AS quote_category FROM part GROUP BY 1),
 pq AS (SELECT pos.*, quote_price, quote_name, quote_category FROM pos LEFT JOIN quotes USING (ticker)),
 pv0 AS (SELECT *, CASE WHEN initial_price > 0 THEN initial_price END AS ip FROM pq),
 val AS (SELECT *, CASE WHEN status = 'sold' THEN coalesce(CASE WHEN sold_price > 0 THEN sold_price END, ip * (1 + locked_return_pct / 100), ip) ELSE coalesce(quote_price, ip) END AS current_value,
  coalesce(quote_category, short_name, 'Altro') AS category, CASE WHEN status = 'sold' THEN coalesce(sold_at, added_at) END AS closed_at FROM pv0),
 valued AS (SELECT *, (current_value - ip) / ip * 100 AS ret FROM val)"""


def positions(spark, sf):
    o = table(spark, sf, "orders")
    day_ms = "unix_date(CAST(o_orderdate AS DATE)) * 86400000L"
    return o.selectExpr(*[f"{e} AS {n}" for n, e in _POS.items()], f"{day_ms} AS added_at",
                        f"CASE WHEN o_orderstatus = 'F' THEN {day_ms} + 2592000000L END AS sold_at")


def quotes(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy(F.expr("concat('T', p_partkey % 89)").alias("ticker")).agg(
        rnd(F.avg("p_retailprice"), 2).alias("current_price"), F.min("p_name").alias("short_name"),
        F.max("p_type").alias("category"))


def quoted(spark, sf):
    return O.with_quotes(positions(spark, sf), quotes(spark, sf))


def valued(spark, sf):
    return O.position_valuation(quoted(spark, sf))


_KEY = ("owner_id", "portfolio_id", "position")


@query("position_quote_join", f"WITH {_POS_SQL} SELECT owner_id, portfolio_id, position, ticker, quote_price, quote_name FROM pq")
def _(spark, sf):
    return quoted(spark, sf).select(*_KEY, "ticker", "quote_price", "quote_name")


@query("position_valuation", f"""WITH {_POS_SQL} SELECT owner_id, portfolio_id, position, ip AS initial_price, round(current_value, 4) AS current_value,
 round(ret, 4) AS return_pct, category, closed_at FROM valued""")
def _(spark, sf):
    return valued(spark, sf).select(*_KEY, "initial_price", rnd("current_value", 4).alias("current_value"),
                                    rnd("value_return_pct", 4).alias("return_pct"), "category", "closed_at")


@query("closed_return", f"""WITH {_POS_SQL} SELECT owner_id, portfolio_id, position, round(CASE WHEN status = 'sold' THEN
 coalesce(locked_return_pct, CASE WHEN initial_price > 0 THEN (sold_price - initial_price) / initial_price * 100 END, 0) ELSE 0 END, 4) AS closed_return_pct FROM pos""")
def _(spark, sf):
    return O.closed_return(positions(spark, sf)).select(*_KEY, rnd("closed_return_pct", 4).alias("closed_return_pct"))


@query("position_rows", f"""WITH {_POS_SQL}, r AS (SELECT *, 'sold' AS view, locked_return_pct AS r, coalesce(short_name, quote_name, 'Posizione portafoglio') AS row_name FROM pv0 WHERE status = 'sold'
 UNION ALL SELECT *, 'open', (quote_price - ip) / ip * 100, coalesce(quote_name, short_name, 'Posizione portafoglio') FROM pv0 WHERE status <> 'sold')
SELECT view, owner_id, portfolio_id, position, round(r, 4) AS return_pct, row_name, CASE WHEN r > 0 THEN 'buy' WHEN r < 0 THEN 'sell' ELSE 'neutral' END AS tone FROM r""")
def _(spark, sf):
    q = quoted(spark, sf)
    out = None
    for view in ("sold", "open"):
        v = O.position_rows(q, view).select(F.lit(view).alias("view"), *_KEY, rnd("row_return_pct", 4).alias("return_pct"),
                                            "row_name", "tone")
        out = v if out is None else out.unionByName(v)
    return out


@query("sell_position", f"""WITH {_POS_SQL} SELECT owner_id, portfolio_id, position, 'sold' AS status,
 round(CASE WHEN status <> 'sold' THEN coalesce(quote_price, ip) ELSE sold_price END, 4) AS sold_price,
 round(CASE WHEN status <> 'sold' THEN (coalesce(quote_price, ip) - ip) / ip * 100 ELSE locked_return_pct END, 4) AS locked_return_pct,
 CASE WHEN status <> 'sold' THEN {NOW_MS} ELSE sold_at END AS sold_at, CASE WHEN status <> 'sold' THEN coalesce(quote_name, short_name) ELSE short_name END AS short_name FROM pv0""")
def _(spark, sf):
    s = O.sell_position(quoted(spark, sf), F.lit(NOW_MS).cast("bigint"))
    return s.select(*_KEY, "status", rnd("sold_price", 4).alias("sold_price"),
                    rnd("locked_return_pct", 4).alias("locked_return_pct"), "sold_at", "short_name")


@query("backfill_initial_price", f"""WITH {_POS_SQL} SELECT owner_id, portfolio_id, position, round(coalesce(ip, quote_price, initial_price), 4) AS initial_price,
 coalesce(quote_name, short_name) AS short_name FROM pv0""")
def _(spark, sf):
    return O.backfill_initial_price(quoted(spark, sf)).select(*_KEY, rnd("initial_price", 4).alias("initial_price"), "short_name")


@query("quote_refresh_merge", """WITH old AS (SELECT concat('T', p_partkey % 89) AS ticker, max(p_retailprice) AS price FROM part GROUP BY 1),
 new AS (SELECT concat('T', p_partkey % 89) AS ticker, min(p_retailprice) AS price FROM part WHERE p_size > 30 GROUP BY 1)
SELECT ticker, coalesce(new.price, old.price) AS current_price FROM old FULL JOIN new USING (ticker)""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("ticker", F.expr("concat('T', p_partkey % 89)"))
    old = p.groupBy("ticker").agg(F.max("p_retailprice").alias("current_price"))
    new = p.where("p_size > 30").groupBy("ticker").agg(F.min("p_retailprice").alias("current_price"))
    return O.quote_refresh_merge(old, new)


@query("portfolio_summary", f"""WITH {_POS_SQL}, u AS (SELECT *, unnest(['total', 'open', 'closed']) AS scope FROM valued), k AS (SELECT *, scope = 'total' OR (scope = 'closed') = (status = 'sold') AS has FROM u)
SELECT owner_id, portfolio_id, scope, round(coalesce(sum(ip) FILTER (has), 0), 2) AS invested, round(coalesce(sum(current_value) FILTER (has), 0), 2) AS current,
 round(coalesce(sum(ret) FILTER (has), 0), 2) AS return_pct, count(*) FILTER (has) AS n FROM k GROUP BY 1, 2, 3""")
def _(spark, sf):
    s = O.portfolio_summary(valued(spark, sf))
    return s.select("owner_id", "portfolio_id", "scope", rnd("invested", 2).alias("invested"),
                    rnd("current", 2).alias("current"), rnd("return_pct", 2).alias("return_pct"), "n")


@query("category_counts", f"WITH {_POS_SQL} SELECT owner_id, portfolio_id, category, count(*) AS n FROM valued WHERE status <> 'sold' GROUP BY 1, 2, 3")
def _(spark, sf):
    return O.category_counts(valued(spark, sf))


@query("public_portfolio_rollup", f"""WITH {_POS_SQL}, f AS (SELECT owner_id, portfolio_id, ticker, min(position) AS p FROM pos GROUP BY 1, 2, 3),
 tk AS (SELECT owner_id, portfolio_id, string_agg(ticker, ' ' ORDER BY p) AS tickers FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY owner_id, portfolio_id ORDER BY p) <= 12) GROUP BY 1, 2)
SELECT owner_id, portfolio_id, count(*) AS entries_count, count(*) FILTER (status <> 'sold') AS open_count, count(*) FILTER (status = 'sold') AS closed_count,
 round(sum(CASE WHEN status = 'sold' THEN coalesce(locked_return_pct, (sold_price - initial_price) / initial_price * 100, 0) ELSE 0 END), 2) AS return_pct, max(tickers) AS tickers
FROM pos JOIN tk USING (owner_id, portfolio_id) WHERE visibility = 'public' GROUP BY 1, 2""")
def _(spark, sf):
    r = O.public_portfolio_rollup(positions(spark, sf))
    return r.withColumn("tickers", F.array_join("tickers", " "))


@query("realized_trend", f"""WITH {_POS_SQL}, c AS (SELECT * FROM valued WHERE status = 'sold' AND ip IS NOT NULL AND current_value IS NOT NULL AND closed_at > 0),
 run AS (SELECT owner_id, portfolio_id, position, closed_at AS ts, sum(ip) OVER w AS i, sum(current_value) OVER w AS v FROM c
  WINDOW w AS (PARTITION BY owner_id, portfolio_id ORDER BY closed_at, position ROWS UNBOUNDED PRECEDING)),
 e AS (SELECT owner_id, portfolio_id, min(added_at) AS start, coalesce(sum(ret), 0) AS total, coalesce(sum(ret) FILTER (status <> 'sold'), 0) AS op,
  count(*) FILTER (status = 'sold' AND ip IS NOT NULL AND current_value IS NOT NULL) AS nc FROM valued GROUP BY 1, 2)
SELECT owner_id, portfolio_id, 1 AS part, ts, position, round((v - i) / i * 100, 2) AS pct FROM run UNION ALL
SELECT owner_id, portfolio_id, 0, start, NULL, 0 FROM e UNION ALL
SELECT owner_id, portfolio_id, 2, {NOW_MS}, NULL, round(CASE WHEN nc > 0 THEN total ELSE op END, 2) FROM e""")
def _(spark, sf):
    return O.realized_trend(valued(spark, sf), NOW_MS)


# --- social tables -------------------------------------------------------------------------------

def users(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS username")


def portfolios(spark, sf):
    o = table(spark, sf, "orders").selectExpr(
        f"{_PID} AS id", "o_custkey AS owner_id", "o_orderpriority AS client_id", f"{_TICKER} AS ticker",
        "o_orderkey AS position", "o_totalprice", "o_orderstatus", "o_orderdate")
    keys = ["id", "owner_id", "client_id"]
    p = o.groupBy(*keys).agg(
        rnd(F.avg("o_totalprice") / 1000, 2).alias("return_pct"), F.count(F.lit(1)).alias("entries_count"),
        F.count_if(F.col("o_orderstatus") != "F").alias("open_count"),
        F.count_if(F.col("o_orderstatus") == "F").alias("closed_count"),
        F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
    return p.join(O.first_tickers(o, keys), keys).withColumn("name", F.concat(F.lit("P "), F.col("client_id")))


def reactions(spark, sf, status):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    return o.groupBy(F.expr(_PID).alias("portfolio_id"), F.expr("o_orderkey % 20").alias("user_id")).agg(
        F.min("o_orderdate").alias("created_at"))


def social_events(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", f"{_PID} AS portfolio_id", "CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'buy' END AS action",
        f"lower({_TICKER}) AS ticker", "o_orderdate AS created_at")


_SOCIAL = f"""so AS (SELECT {_PID} AS id, o_custkey AS owner_id, o_orderpriority AS client_id, {_TICKER} AS ticker, * FROM orders),
 sp AS (SELECT id, owner_id, client_id, round(avg(o_totalprice) / 1000, 2) AS return_pct, count(*) AS entries_count, count(*) FILTER (o_orderstatus <> 'F') AS open_count,
  count(*) FILTER (o_orderstatus = 'F') AS closed_count, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at, concat('P ', client_id) AS name FROM so GROUP BY 1, 2, 3),
 likes AS (SELECT id AS portfolio_id, o_orderkey % 20 AS user_id, min(o_orderdate) AS created_at FROM so WHERE o_orderstatus = 'F' GROUP BY 1, 2),
 saves AS (SELECT id AS portfolio_id, o_orderkey % 20 AS user_id, min(o_orderdate) AS created_at FROM so WHERE o_orderstatus = 'O' GROUP BY 1, 2),
 lc AS (SELECT portfolio_id AS id, count(*) AS n FROM likes GROUP BY 1), sc AS (SELECT portfolio_id AS id, count(*) AS n FROM saves GROUP BY 1),
 ev AS (SELECT o_orderkey AS id, id AS portfolio_id, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS action, ticker, o_orderdate AS created_at FROM so)"""
_FEED = f"""{_SOCIAL}, feed AS (SELECT sp.*, c_name AS owner_username, coalesce(lc.n, 0) AS likes_count, coalesce(sc.n, 0) AS saves_count,
 EXISTS (SELECT 1 FROM likes l WHERE l.portfolio_id = sp.id AND l.user_id = {VIEWER}) AS viewer_liked, EXISTS (SELECT 1 FROM saves l WHERE l.portfolio_id = sp.id AND l.user_id = {VIEWER}) AS viewer_saved
 FROM sp JOIN customer ON c_custkey = owner_id LEFT JOIN lc USING (id) LEFT JOIN sc USING (id))"""


def _feed(spark, sf):
    return O.feed_join(portfolios(spark, sf), users(spark, sf), reactions(spark, sf, "F"), reactions(spark, sf, "O"), VIEWER)


@query("feed_join", f"WITH {_FEED} SELECT id, owner_username, return_pct, likes_count, saves_count, viewer_liked, viewer_saved FROM feed")
def _(spark, sf):
    return _feed(spark, sf).select("id", "owner_username", "return_pct", "likes_count", "saves_count", "viewer_liked", "viewer_saved")


@query("feed_order", f"WITH {_FEED} SELECT id, owner_username, strftime(updated_at, '%Y-%m-%d') AS updated FROM feed ORDER BY updated_at DESC, id DESC")
def _(spark, sf):
    return O.feed_order(_feed(spark, sf)).select("id", "owner_username", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("saved_join", f"""WITH {_FEED} SELECT feed.id, owner_username, likes_count, saves_count, strftime(s.created_at, '%Y-%m-%d') AS saved FROM feed JOIN saves s ON s.portfolio_id = feed.id AND s.user_id = {VIEWER}""")
def _(spark, sf):
    s = O.saved_join(portfolios(spark, sf), users(spark, sf), reactions(spark, sf, "F"), reactions(spark, sf, "O"), VIEWER)
    return s.select("id", "owner_username", "likes_count", "saves_count", F.date_format("saved_at", "yyyy-MM-dd").alias("saved"))


@query("reaction_snapshot", f"WITH {_FEED} SELECT id, likes_count, saves_count, viewer_liked, viewer_saved FROM feed")
def _(spark, sf):
    return O.reaction_snapshot(portfolios(spark, sf), reactions(spark, sf, "F"), reactions(spark, sf, "O"), VIEWER)


@query("like_counts", f"WITH {_SOCIAL} SELECT sp.id, coalesce(n, 0) AS likes_count FROM sp LEFT JOIN lc USING (id)")
def _(spark, sf):
    p = portfolios(spark, sf).select("id")
    return p.join(O.reaction_counts(reactions(spark, sf, "F"), "likes_count"), "id", "left").fillna(0, ["likes_count"])


@query("save_counts", f"WITH {_SOCIAL} SELECT sp.id, coalesce(n, 0) AS saves_count FROM sp LEFT JOIN sc USING (id)")
def _(spark, sf):
    p = portfolios(spark, sf).select("id")
    return p.join(O.reaction_counts(reactions(spark, sf, "O"), "saves_count"), "id", "left").fillna(0, ["saves_count"])


for _name, _k in (("recent_events_top_k", 6), ("saved_events_top_k", 8)):
    @query(_name, f"""WITH {_SOCIAL} SELECT portfolio_id, id, action, ticker, row_number() OVER (PARTITION BY portfolio_id ORDER BY created_at DESC, id DESC) AS rank FROM ev
QUALIFY rank <= {_k}""")
    def _(spark, sf, _k=_k):
        return O.recent_events_top_k(social_events(spark, sf), _k).select("portfolio_id", "id", "action", "ticker", "rank")


@query("retain_last_120", "SELECT p AS portfolio_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM (SELECT o_orderkey % 40 + 1 AS p, * FROM orders QUALIFY row_number() OVER (PARTITION BY p ORDER BY o_orderdate DESC, o_orderkey DESC) <= 120) GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "orders").selectExpr("o_orderkey % 40 + 1 AS portfolio_id", "o_orderkey AS id", "o_orderdate AS created_at")
    kept = O.retain_last_120(e)
    return kept.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("leaderboard_top12", f"WITH {_FEED} SELECT id, owner_username, return_pct FROM feed ORDER BY return_pct DESC, owner_username, id LIMIT 12")
def _(spark, sf):
    return O.leaderboard_top12(_feed(spark, sf)).select("id", "owner_username", "return_pct")


@query("store_scan", f"""WITH {_SOCIAL} SELECT 'users' AS tbl, count(*) AS n FROM customer UNION ALL SELECT 'portfolios', count(*) FROM sp UNION ALL SELECT 'likes', count(*) FROM likes
UNION ALL SELECT 'saves', count(*) FROM saves UNION ALL SELECT 'events', count(*) FROM ev""")
def _(spark, sf):
    tables = {"users": users(spark, sf), "portfolios": portfolios(spark, sf), "likes": reactions(spark, sf, "F"),
              "saves": reactions(spark, sf, "O"), "events": social_events(spark, sf)}
    out = None
    for name, t in tables.items():
        n = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# --- lists ------------------------------------------------------------------------------------------

_LIST = ["concat(' t', o_orderkey % 7, ' ')", "concat('T', o_orderkey % 7)", "''", "concat('a b', o_orderkey % 3)", "upper(o_orderstatus)",
         *[f"concat('X', (o_orderkey + {i}) % 15)" for i in range(12)]]
_NORM_SQL = f"""ls AS (SELECT o_orderkey, list_filter(list_transform([{', '.join(_LIST)}], lambda x: replace(upper(trim(x)), ' ', '')), lambda x: x <> '') AS a FROM orders),
 nl AS (SELECT o_orderkey, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS d FROM ls)"""


def _lists(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"array({', '.join(_LIST)}) AS tickers")


@query("watchlist_normalize", f"WITH {_NORM_SQL} SELECT o_orderkey, array_to_string(d, ' ') AS tickers FROM nl")
def _(spark, sf):
    return _lists(spark, sf).select("o_orderkey", F.array_join(O.watchlist_normalize(F.col("tickers")), " ").alias("tickers"))


@query("social_tickers", f"WITH {_NORM_SQL} SELECT o_orderkey, array_to_string(d[1:12], ' ') AS tickers FROM nl")
def _(spark, sf):
    return _lists(spark, sf).select("o_orderkey", F.array_join(O.social_tickers(F.col("tickers")), " ").alias("tickers"))


@query("watchlist_positions", f"WITH {_NORM_SQL} SELECT o_orderkey AS user_id, unnest(range(len(d))) AS position, unnest(d) AS ticker FROM nl")
def _(spark, sf):
    return O.watchlist_positions(_lists(spark, sf).withColumnRenamed("o_orderkey", "user_id"))


@query("parse_tickers_json", f"WITH {_NORM_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE array_to_string(d[1:12], ' ') END AS tickers FROM nl")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 8 == 0, F.lit("[oops")).when(F.col("o_orderkey") % 4 == 0, F.lit(None)) \
        .otherwise(F.to_json("tickers"))
    t = _lists(spark, sf).select("o_orderkey", text.alias("j"))
    return t.select("o_orderkey", F.array_join(O.parse_tickers_json(F.col("j")), " ").alias("tickers"))


@query("portfolio_normalize", """WITH r AS (SELECT o_custkey AS owner_id, o_orderkey AS position, CASE WHEN o_orderkey % 6 = 0 THEN 'portfolio-' || (o_orderkey + 1) ELSE o_orderpriority END AS client_id, * FROM orders)
SELECT owner_id, client_id, position, CASE WHEN position % 5 = 0 THEN 'Portafoglio' ELSE left(repeat(o_orderpriority, 12), 80) END AS name,
 CASE WHEN position % 7 = 0 THEN 0 ELSE round(o_totalprice / 1000, 4) END AS return_pct, CASE WHEN position % 3 = 0 THEN 1 ELSE o_custkey END AS entries_count,
 CASE WHEN position % 2 = 0 THEN 0 ELSE 4 END AS open_count, 0 AS closed_count, upper(o_orderstatus) AS tickers FROM r
QUALIFY row_number() OVER (PARTITION BY owner_id, client_id ORDER BY position) = 1""")
def _(spark, sf):
    raw = table(spark, sf, "orders").selectExpr(
        "o_custkey AS owner_id", "o_orderkey AS position", "CASE WHEN o_orderkey % 6 = 0 THEN '  ' ELSE o_orderpriority END AS client_id",
        "CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE repeat(o_orderpriority, 12) END AS name",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'inf' ELSE CAST(o_totalprice / 1000D AS STRING) END AS return_pct",
        "CASE WHEN o_orderkey % 3 = 0 THEN '-2' ELSE CAST(o_custkey AS STRING) END AS entries_count",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '4' END AS open_count", "CAST(NULL AS STRING) AS closed_count",
        "array(o_orderstatus, lower(o_orderstatus)) AS tickers")
    return O.portfolio_normalize(raw).withColumn("tickers", F.array_join("tickers", " "))


@query("collection_normalize", """WITH d AS (SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS s FROM orders),
 x AS (SELECT o_orderkey AS owner_id, a, unnest([0, 1, 2, 3, 4, 5, 6]) AS position, unnest([a, s, a || '-2', s || '-2', a || '-3', 'portfolio-6', s || '-3']) AS id, s FROM d)
SELECT owner_id, position, id, CASE WHEN position = 5 THEN 'Portafoglio 6' ELSE 'N' || position END AS name, CASE WHEN position = 1 THEN 'private' ELSE 'public' END AS visibility,
 CASE WHEN s = 'F' THEN id = 'F-3' ELSE id = a END AS active FROM x""")
def _(spark, sf):
    ids = ["o_orderpriority", "o_orderstatus", "o_orderpriority", "concat(' ', o_orderstatus, '-2')", "o_orderpriority", "' '", "o_orderstatus"]
    items = ", ".join(f"struct({e} AS id, {repr('N' + str(i)) if i != 5 else 'CAST(NULL AS STRING)'} AS name, "
                      f"'{'private' if i == 1 else 'public'}' AS visibility)" for i, e in enumerate(ids))
    docs = table(spark, sf, "orders").selectExpr("o_orderkey AS owner_id", "concat(o_orderstatus, '-', IF(o_orderstatus = 'F', '3', 'none')) AS active_id",
                                                 f"array({items}) AS items")
    return O.collection_normalize(docs)


@query("collection_defaults", """SELECT o_orderkey AS owner_id, 0 AS position, 'portfolio-1' AS id, 'Portafoglio 1' AS name, CASE WHEN o_orderkey % 5 = 2 THEN 'public' ELSE 'private' END AS visibility,
 true AS active FROM orders WHERE o_orderkey % 5 <> 4
UNION ALL SELECT o_orderkey, p, o_orderstatus || CASE WHEN p = 0 THEN '' ELSE '-' || (p + 1) END, 'Portafoglio ' || (p + 1), 'public', p = 0
FROM (SELECT *, unnest([0, 1, 2]) AS p FROM orders WHERE o_orderkey % 5 = 4)""")
def _(spark, sf):
    item = "struct(o_orderstatus AS id, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS visibility)"
    docs = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS owner_id", "'x' AS active_id",
        f"CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN filter(array({item}), i -> false) ELSE array({item}, {item}, {item}) END AS items",
        "CASE o_orderkey % 5 WHEN 2 THEN array(' ', lower(o_orderpriority)) WHEN 3 THEN array(' ', CAST(NULL AS STRING)) END AS entries")
    return O.collection_normalize(docs)


@query("normalize_entries", f"""WITH e AS (SELECT *, {_duck(_INITIAL)} AS ip, {_TICKER} AS t FROM orders WHERE o_orderkey % 8 <> 0)
SELECT o_custkey AS portfolio, CASE WHEN o_orderkey % 3 = 0 THEN 'id' || o_orderkey ELSE t || '-' || CASE WHEN o_orderkey % 2 = 0 THEN {NOW_MS} ELSE o_orderkey + 1 END || '-' || o_orderkey END AS id,
 t AS ticker, CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'bought' END AS status, ip AS initial_price, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS sold_price FROM e""")
def _(spark, sf):
    raw = table(spark, sf, "orders").selectExpr(
        "o_custkey AS portfolio", "o_orderkey AS index", "CASE WHEN o_orderkey % 3 = 0 THEN concat(' id', o_orderkey) ELSE '' END AS id",
        f"CASE WHEN o_orderkey % 8 <> 0 THEN concat(' ', lower({_TICKER})) ELSE ' ' END AS ticker",
        "CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE o_orderstatus END AS status",
        f"coalesce(CAST({_INITIAL} AS STRING), '-1') AS initial_price",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'never' ELSE CAST(o_orderkey + 1 AS STRING) END AS added_at", "'12.4' AS sold_at",
        "CAST(o_totalprice AS STRING) AS sold_price", "'NaN' AS locked_return_pct", "' ' AS short_name")
    return O.normalize_entries(raw, NOW_MS).select("portfolio", "id", "ticker", "status", "initial_price", "sold_price")


# --- snapshots: the stored table is the portfolios, the saved lists come from two thirds of the owners ---

def _snapshots(spark, sf):
    cols = ["id", "owner_id", "client_id", "name", "return_pct", "tickers", "created_at", "updated_at"]
    old = portfolios(spark, sf).where("client_id <> '5-LOW'").select(*cols)
    new = portfolios(spark, sf).where("owner_id % 3 <> 0 AND client_id <> '1-URGENT'")
    changed = F.transform("tickers", lambda t: F.when(F.endswith(t, F.lit("5")), F.concat(t, F.lit("N"))).otherwise(t))
    new = new.select("owner_id", "client_id", F.concat("name", F.lit(" v2")).alias("name"),
                     (F.col("return_pct") + 1).alias("return_pct"), changed.alias("tickers"))
    return old, new


def _saved(spark, sf):
    """Owners who saved: those of the new lists, and every ninth with an empty list."""
    return portfolios(spark, sf).where("owner_id % 3 <> 0 OR owner_id % 9 = 0").select("owner_id").distinct()


@query("portfolio_upsert", f"""WITH {_SOCIAL}, old AS (SELECT * FROM sp WHERE client_id <> '5-LOW'), new AS (SELECT * FROM sp WHERE owner_id % 3 <> 0 AND client_id <> '1-URGENT'),
 fresh AS (SELECT owner_id, client_id, row_number() OVER (ORDER BY owner_id, client_id) + (SELECT max(id) FROM old) AS nid FROM new ANTI JOIN old USING (owner_id, client_id))
SELECT owner_id, client_id, coalesce(old.id, nid) AS id, round(new.return_pct + 1, 2) AS return_pct, new.name || ' v2' AS name, strftime(coalesce(old.created_at, TIMESTAMP '2001-11-04'), '%Y-%m-%d') AS created FROM new LEFT JOIN old USING (owner_id, client_id) LEFT JOIN fresh USING (owner_id, client_id)
UNION ALL SELECT owner_id, client_id, id, return_pct, name, strftime(created_at, '%Y-%m-%d') FROM old WHERE owner_id % 3 = 0 AND owner_id % 9 <> 0""")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    u = O.portfolio_upsert(old, new, F.lit(AS_OF).cast("timestamp_ntz"), _saved(spark, sf))
    return u.select("owner_id", "client_id", "id", rnd("return_pct", 2).alias("return_pct"), "name",
                    F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("replace_missing", f"""WITH {_SOCIAL}, old AS (SELECT * FROM sp WHERE client_id <> '5-LOW'), new AS (SELECT * FROM sp WHERE owner_id % 3 <> 0 AND client_id <> '1-URGENT')
SELECT id, owner_id, client_id FROM old WHERE (owner_id % 9 = 0 OR owner_id % 3 <> 0) AND (owner_id, client_id) NOT IN (SELECT (owner_id, client_id) FROM new)""")
def _(spark, sf):
    old, new = _snapshots(spark, sf)
    return O.replace_missing(old, new, _saved(spark, sf)).select("id", "owner_id", "client_id")


@query("ticker_diff_events", f"""WITH {_SOCIAL}, tk AS (SELECT id, owner_id, client_id, ticker FROM (SELECT id, owner_id, client_id, ticker, min(o_orderkey) AS p FROM so GROUP BY 1, 2, 3, 4)
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) <= 12)
SELECT id AS portfolio_id, unnest(['buy', 'sell']) AS action, unnest([ticker || 'N', ticker]) AS ticker FROM tk
WHERE owner_id % 3 <> 0 AND client_id NOT IN ('1-URGENT', '5-LOW') AND ticker LIKE '%5'""")
def _(spark, sf):
    return O.ticker_diff_events(*_snapshots(spark, sf))


@query("reaction_toggle", f"""WITH a AS (SELECT {_PID} AS portfolio_id, o_orderkey % 3 AS user_id, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS d, o_orderkey AS seq FROM orders),
 l AS (SELECT portfolio_id, user_id, max(seq) FILTER (d IS NOT NULL) AS set_at, arg_max(d, seq) FILTER (d IS NOT NULL) AS s FROM a GROUP BY 1, 2)
SELECT portfolio_id, user_id FROM l JOIN a USING (portfolio_id, user_id) GROUP BY 1, 2, s, set_at HAVING coalesce(s, false) <> (count(*) FILTER (d IS NULL AND (set_at IS NULL OR seq > set_at)) % 2 = 1)""")
def _(spark, sf):
    a = table(spark, sf, "orders").selectExpr(
        f"{_PID} AS portfolio_id", "o_orderkey % 3 AS user_id",
        "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS desired", "o_orderkey AS seq")
    return O.reaction_toggle(a)


@query("watchlist_signals", f"""WITH {SIGNAL_SQL}, w AS (SELECT s_nationkey AS user_id, unnest([CAST(s_suppkey AS VARCHAR), 'Z' || s_suppkey]) AS ticker FROM supplier)
SELECT user_id, ticker, coalesce(shown, 'Neutro') AS display_label, coalesce(tone, 'neutral') AS tone, round(bs, 4) AS score_pct, coalesce(cur IS NOT NULL, false) AS has_data
FROM w LEFT JOIN (SELECT symbol AS ticker, shown, tone, bs, cur FROM sg) USING (ticker)""".replace("coalesce(cur IS NOT NULL, false)", "cur IS NOT NULL"))
def _(spark, sf):
    w = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("user_id"), F.explode(F.array(
        F.col("s_suppkey").cast("string"), F.concat(F.lit("Z"), F.col("s_suppkey").cast("string")))).alias("ticker"))
    s = X.portfolio_signal(stored_supplier_bars(spark, sf), AS_OF).select("symbol", "display_label", "tone", rnd("score_pct", 4).alias("score_pct"), "has_data")
    return O.watchlist_signals(w, s).select("user_id", "ticker", "display_label", "tone", "score_pct", "has_data")
