"""Portfolios: positions, valuation, list normalisation, snapshots and the social feed.

An owner, portfolio or symbol may hold any share of these rows, so nothing here windows over a
whole owner: top-k windows prune before the shuffle, running sums go bucket by bucket, and lists
are cut to their fixed length before they are collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.scalars import (coerce_float, coerce_non_negative_int, compact_upper,
                                         pick_best_label, rnd, strip)
from tickforge.functions.windows import in_ranges, numbered, running_totals

SOCIAL_TICKERS, NAME_LENGTH, CLIENT_NAME_LENGTH = 12, 80, 40
FEED_EVENTS, SAVED_EVENTS, KEPT_EVENTS = 6, 8, 120
DEFAULT_ID = "portfolio-1"
ID_BUCKET = 1000  # owners numbered in one task
DEFAULT_NAME, DEFAULT_CATEGORY, NO_NAME = "Portafoglio", "Altro", "Posizione portafoglio"


# --- ticker lists -----------------------------------------------------------------------------

def watchlist_normalize(items: Column) -> Column:
    upper = F.transform(items, lambda x: compact_upper(F.coalesce(x, F.lit(""))))
    return F.array_distinct(F.filter(upper, lambda x: x != ""))


def social_tickers(items: Column) -> Column:
    return F.slice(watchlist_normalize(items), 1, SOCIAL_TICKERS)


def parse_tickers_json(text: Column) -> Column:
    """JSON text -> normalised list; invalid or empty text -> empty list."""
    return social_tickers(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")))


def watchlist_positions(lists: DataFrame) -> DataFrame:
    """``(user_id, tickers)`` -> one row per kept ticker with its place."""
    return lists.select("user_id", F.posexplode(watchlist_normalize(F.col("tickers")))
                        .alias("position", "ticker"))


# --- portfolio lists -----------------------------------------------------------------------------

def _filled(x: Column) -> Column:
    t = strip(x)
    return F.when(t != "", t)


def portfolio_normalize(raw: DataFrame) -> DataFrame:
    """First entry per (owner, client id) with defaults, limits and coerced numbers.

    Input ``(owner_id, position, client_id, name, return_pct, entries_count, open_count,
    closed_count, tickers)``, numbers as text. The first entry is an aggregate, not a window, so
    a client id repeated a million times is reduced map-side.
    """
    client = F.coalesce(_filled(F.col("client_id")),
                        F.concat(F.lit("portfolio-"), (F.col("position") + 1).cast("string")))
    keep = [c for c in raw.columns if c not in ("owner_id", "client_id", "position")]
    first = raw.groupBy("owner_id", client.alias("client_id")).agg(
        F.min("position").alias("position"),
        F.min_by(F.struct(*keep), "position").alias("_r")).select("owner_id", "client_id", "position", "_r.*")
    first = first.withColumn("tickers", social_tickers(F.col("tickers")))
    return first.withColumns({
        "name": F.left(F.coalesce(_filled(F.col("name")), F.lit(DEFAULT_NAME)), F.lit(NAME_LENGTH)),
        "entries_count": coerce_non_negative_int(F.col("entries_count"), F.size("tickers")),
        "open_count": coerce_non_negative_int(F.col("open_count")),
        "closed_count": coerce_non_negative_int(F.col("closed_count")),
        "return_pct": rnd(coerce_float(F.col("return_pct")), 4)})


def normalize_entries(raw: DataFrame, now_ms: int) -> DataFrame:
    """Client entries: coerced fields, sold-only fields, default ids; entries without ticker go.

    Input ``(portfolio, index, id, ticker, status, initial_price, added_at, sold_at, sold_price,
    locked_return_pct, short_name)`` with texts.
    """
    def number(c):
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)

    def positive(c):
        return F.when(number(c) > 0, number(c))

    sold = F.col("status") == "sold"
    ticker = compact_upper(F.coalesce("ticker", F.lit("")))
    e = raw.withColumns({
        "ticker": ticker, "status": F.when(sold, "sold").otherwise("bought"),
        "added_at": F.coalesce(F.round(positive("added_at")).cast("bigint"), F.lit(now_ms)),
        "initial_price": positive("initial_price"),
        "sold_at": F.when(sold, F.round(positive("sold_at")).cast("bigint")),
        "sold_price": F.when(sold, positive("sold_price")),
        "locked_return_pct": F.when(sold, number("locked_return_pct")),
        "short_name": _filled(F.col("short_name"))}).where(F.col("ticker") != "")
    default = F.concat_ws("-", "ticker", F.col("added_at").cast("string"), F.col("index").cast("string"))
    return e.withColumn("id", F.coalesce(_filled(F.col("id")), default))


def _unique_ids(wanted: Sequence[str]) -> list[str]:
    used, following, out = set(), {}, []
    for name in wanted:
        fresh, k = name, following.get(name, 2)
        while fresh in used:
            fresh, k = f"{name}-{k}", k + 1
        if fresh != name:
            following[name] = k
        used.add(fresh)
        out.append(fresh)
    return out


def collection_normalize(docs: DataFrame) -> DataFrame:
    """Portfolio documents ``(owner_id, active_id, items)`` -> one row per portfolio.

    A document without items (null or empty list) is the default collection: one private portfolio. With a
    column ``entries`` (tickers), rows where it is not null are documents of the older form, a plain list of
    entries: one public portfolio, or the default collection if no entry names a ticker.

    Ids are unique in list order: a used ``x`` becomes the first free of ``x-2``, ``x-3``, ... The rule depends
    on everything before it in the same document, so it is a fold over the document's own list. The fold
    carries the next suffix to try for each id that came twice, so a suffix is tried once and not once per item;
    it runs in Arrow batches, as a fold of SQL functions would search its list of used ids for every item.
    """
    kind = docs.schema["items"].dataType.simpleString()

    def only(visibility):
        return F.from_json(F.lit(f'[{{"id": "{DEFAULT_ID}", "visibility": "{visibility}"}}]'), kind)

    older = F.col("entries").isNotNull() if "entries" in docs.columns else F.lit(False)
    named = F.size(watchlist_normalize(F.col("entries"))) > 0 if "entries" in docs.columns else F.lit(False)
    docs = docs.withColumns({
        "active_id": F.when(~older, F.col("active_id")),
        "items": F.when(older & named, only("public")).when(older | F.col("items").isNull() | (F.size("items") == 0), only("private"))
        .otherwise(F.col("items"))})

    @F.pandas_udf("array<string>")
    def unique(lists: pd.Series) -> pd.Series:
        return lists.map(_unique_ids)

    wanted = F.transform("items", lambda item, i: F.coalesce(_filled(item["id"]), F.concat(F.lit("portfolio-"), (i + 1).cast("string"))))
    ids = unique(wanted)
    d = docs.withColumn("_ids", ids)
    asked = _filled(F.col("active_id"))
    active = F.when(F.array_contains("_ids", asked), asked).otherwise(F.get("_ids", F.lit(0)))
    rows = d.select("owner_id", active.alias("active_id"),
                    F.posexplode(F.arrays_zip("_ids", "items")).alias("position", "x"))
    place = F.concat(F.lit("Portafoglio "), (F.col("position") + 1).cast("string"))
    return rows.select(
        "owner_id", "position", F.col("x._ids").alias("id"),
        F.left(F.coalesce(_filled(F.col("x.items.name")), place), F.lit(CLIENT_NAME_LENGTH)).alias("name"),
        F.when(F.col("x.items.visibility") == "private", "private").otherwise("public").alias("visibility"),
        (F.col("x._ids") == F.col("active_id")).alias("active"))


# --- snapshots -------------------------------------------------------------------------------------

def portfolio_upsert(old: DataFrame, new: DataFrame, now: Column, saved: DataFrame | None = None) -> DataFrame:
    """Stored table after an owner's list is saved: matched rows updated with ``created_at``
    and ``id`` kept, new ones added, missing ones of that owner removed.

    ``saved(owner_id)`` are the owners who saved, those of ``new`` if not given; an owner who saved an
    empty list has no row in ``new`` and loses all. Other owners stay. New rows take the ids after the
    largest one by owner and client id. One join on (owner, client id), which no single owner can
    skew because the client id is part of the key.
    """
    owners = (new if saved is None else saved).select("owner_id").distinct()
    touched = old.join(owners, "owner_id", "left_semi")
    untouched = old.join(owners, "owner_id", "left_anti")
    o = touched.select("owner_id", "client_id", "id", F.col("created_at").alias("_created"))
    given = new.drop("id").join(o, ["owner_id", "client_id"], "left").withColumns({
        "created_at": F.coalesce("_created", now), "updated_at": now}).drop("_created")
    largest = old.agg(F.max("id")).first()[0] or 0
    fresh = numbered(given.where(F.col("id").isNull()), [], [F.col("owner_id"), F.col("client_id")],
                     F.floor(F.col("owner_id") / ID_BUCKET), "_no")
    fresh = fresh.withColumn("id", (F.col("_no") + largest).cast(dict(old.dtypes)["id"]))
    known = given.where(F.col("id").isNotNull())
    return untouched.unionByName(known.select(*untouched.columns)).unionByName(fresh.select(*untouched.columns))


def replace_missing(old: DataFrame, new: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Stored rows that saving ``new`` deletes: the owner saved (``saved(owner_id)``; those of ``new`` if not
    given), the client id is not in the list."""
    owners = (new if saved is None else saved).select("owner_id").distinct()
    return (old.join(owners, "owner_id", "left_semi")
            .join(new.select("owner_id", "client_id"), ["owner_id", "client_id"], "left_anti"))


def ticker_diff_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """buy for added and sell for removed tickers, for portfolios that existed before."""
    both = new.select("owner_id", "client_id", F.col("tickers").alias("_new")).join(
        old.select("id", "owner_id", "client_id", F.col("tickers").alias("_old")),
        ["owner_id", "client_id"])
    a, b = social_tickers(F.col("_new")), social_tickers(F.col("_old"))

    def tagged(items, action):
        return F.transform(items, lambda t: F.struct(F.lit(action).alias("action"), t.alias("ticker")))

    events = F.concat(tagged(F.array_except(a, b), "buy"), tagged(F.array_except(b, a), "sell"))
    return both.select(F.col("id").alias("portfolio_id"), F.inline(events))


def reaction_toggle(actions: DataFrame) -> DataFrame:
    """Active reactions after a log of ``(portfolio_id, user_id, desired, seq)``.

    ``desired`` true or false sets the state; null flips it. So the state is the last set value,
    flipped by the parity of the nulls after it: two aggregates, no sequential pass.
    """
    keys = ["portfolio_id", "user_id"]
    last = actions.groupBy(*keys).agg(
        F.max(F.when(F.col("desired").isNotNull(), F.col("seq"))).alias("_at"),
        F.max_by("desired", F.when(F.col("desired").isNotNull(), F.col("seq"))).alias("_set"))
    flips = actions.where(F.col("desired").isNull()).join(last, keys) \
        .where(F.col("_at").isNull() | (F.col("seq") > F.col("_at"))) \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_flips"))
    odd = F.coalesce(F.col("_flips"), F.lit(0)) % 2 == 1
    state = F.coalesce(F.col("_set"), F.lit(False)) != odd
    return last.join(flips, keys, "left").where(state).select(*keys)


# --- positions -------------------------------------------------------------------------------------

def closed_return(p: DataFrame) -> DataFrame:
    """Locked percent, else from the prices, else 0; open positions give 0."""
    by_price = F.when(F.col("initial_price") > 0, F.try_divide(
        F.col("sold_price") - F.col("initial_price"), F.col("initial_price")) * 100)
    sold = F.coalesce(F.col("locked_return_pct"), by_price, F.lit(0.0))
    return p.withColumn("closed_return_pct", F.when(F.col("status") == "sold", sold).otherwise(F.lit(0.0)))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def with_quotes(p: DataFrame, quotes: DataFrame) -> DataFrame:
    """Left join by ticker; the quote side is one row per ticker and joins by measured size
    (skewed tickers are split by adaptive execution)."""
    q = quotes.select("ticker", F.col("current_price").alias("quote_price"),
                      F.col("short_name").alias("quote_name"), F.col("category").alias("quote_category"))
    return p.join(q, "ticker", "left")


def position_valuation(p: DataFrame) -> DataFrame:
    """Current value, return and category of quoted positions, open and sold."""
    initial, live = _positive(F.col("initial_price")), _positive(F.col("quote_price"))
    sold_price, locked = _positive(F.col("sold_price")), F.col("locked_return_pct")
    sold_value = F.coalesce(sold_price, initial * (1 + locked / 100), initial)
    value = F.when(F.col("status") == "sold", sold_value).otherwise(F.coalesce(live, initial))
    out = p.withColumns({"initial_price": initial, "current_value": value})
    return out.withColumns({
        "value_return_pct": (F.col("current_value") - F.col("initial_price")) / F.col("initial_price") * 100,
        "category": F.coalesce(pick_best_label(F.col("quote_category"), F.col("short_name")),
                               F.lit(DEFAULT_CATEGORY)),
        "closed_at": F.when(F.col("status") == "sold", F.coalesce(_positive(F.col("sold_at")), F.col("added_at")))})


def position_rows(p: DataFrame, view: str) -> DataFrame:
    """Display rows of the ``sold`` or ``open`` view of quoted positions."""
    sold = F.col("status") == "sold"
    initial = _positive(F.col("initial_price"))
    ret = F.when(sold, F.col("locked_return_pct")).otherwise((F.col("quote_price") - initial) / initial * 100)
    names = [_filled(F.col("short_name")), _filled(F.col("quote_name"))]
    name = F.when(sold, F.coalesce(*names)).otherwise(F.coalesce(*reversed(names)))
    out = p.where(sold if view == "sold" else ~sold).withColumns({
        "row_return_pct": ret, "row_name": F.coalesce(name, F.lit(NO_NAME))})
    tone = F.when(F.col("row_return_pct") > 0, "buy").when(F.col("row_return_pct") < 0, "sell") \
        .otherwise("neutral")
    return out.withColumn("tone", tone)


def sell_position(p: DataFrame, sold_at: Column) -> DataFrame:
    """Quoted open positions sold at the current, else the initial price, return locked."""
    initial = _positive(F.col("initial_price"))
    price = F.coalesce(_positive(F.col("quote_price")), initial)
    open_ = F.col("status") != "sold"
    return p.withColumns({
        "sold_price": F.when(open_, price).otherwise(F.col("sold_price")),
        "locked_return_pct": F.when(open_, (price - initial) / initial * 100)
        .otherwise(F.col("locked_return_pct")),
        "sold_at": F.when(open_, sold_at).otherwise(F.col("sold_at")),
        "short_name": F.when(open_, F.coalesce(_filled(F.col("quote_name")), F.col("short_name")))
        .otherwise(F.col("short_name")),
        "status": F.lit("sold")})


def backfill_initial_price(p: DataFrame) -> DataFrame:
    """Quoted positions without a positive initial price take the live one; names refreshed."""
    keep = _positive(F.col("initial_price"))
    return p.withColumns({
        "initial_price": F.coalesce(keep, _positive(F.col("quote_price")), F.col("initial_price")),
        "short_name": F.coalesce(_filled(F.col("quote_name")), _filled(F.col("short_name")))})


def quote_refresh_merge(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per ticker the fresh quote, else the previous one."""
    cols = [c for c in previous.columns if c != "ticker"]
    both = previous.withColumn("_rank", F.lit(0)).unionByName(fresh.withColumn("_rank", F.lit(1)))
    return both.groupBy("ticker").agg(F.max_by(F.struct(*cols), "_rank").alias("_q")).select("ticker", "_q.*")


def portfolio_summary(valued: DataFrame) -> DataFrame:
    """Invested, current value, summed return and count per portfolio: total, open, closed.

    The return of a portfolio is the plain sum of its entries' percentages. Every portfolio has all three
    scopes; sums without a number are 0.
    """
    closed = F.col("status") == "sold"
    scopes = {"total": F.lit(True), "open": ~closed, "closed": closed}
    sums = {"invested": "initial_price", "current": "current_value", "return_pct": "value_return_pct"}
    made = {f"_{s}_{n}": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0)) for s, cond in scopes.items() for n, c in sums.items()}
    made |= {f"_{s}_n": F.count_if(cond) for s, cond in scopes.items()}
    out = valued.groupBy("owner_id", "portfolio_id").agg(*[v.alias(k) for k, v in made.items()])
    rows = [F.struct(F.lit(s).alias("scope"), *[F.col(f"_{s}_{n}").alias(n) for n in (*sums, "n")]) for s in scopes]
    return out.select("owner_id", "portfolio_id", F.inline(F.array(*rows)))


def category_counts(valued: DataFrame) -> DataFrame:
    return (valued.where(F.col("status") != "sold").groupBy("owner_id", "portfolio_id", "category")
            .agg(F.count(F.lit(1)).alias("n")))


def first_tickers(entries: DataFrame, keys: Sequence[str], most: int = SOCIAL_TICKERS) -> DataFrame:
    """First ``most`` distinct tickers of each group in entry order.

    Distinct tickers and the top-k cut come before the collect, so a list never exceeds ``most``.
    """
    t = entries.withColumn("_t", compact_upper(F.coalesce("ticker", F.lit("")))).where(F.col("_t") != "")
    firsts = t.groupBy(*keys, "_t").agg(F.min("position").alias("_p"))
    order = Window.partitionBy(*keys).orderBy("_p")
    top = firsts.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_t")))["_t"].alias("tickers"))


def public_portfolio_rollup(entries: DataFrame) -> DataFrame:
    """Published form of public portfolios: counts, summed closed return, first twelve tickers."""
    keys = ["owner_id", "portfolio_id"]
    pub = closed_return(entries.where(F.col("visibility") == "public"))
    sold = F.col("status") == "sold"
    counts = pub.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries_count"), F.count_if(~sold).alias("open_count"),
        F.count_if(sold).alias("closed_count"), rnd(F.sum("closed_return_pct"), 2).alias("return_pct"))
    return counts.join(first_tickers(pub, keys), keys, "left").withColumn(
        "tickers", F.coalesce("tickers", F.array().cast("array<string>")))


def realized_trend(valued: DataFrame, now_ms: int) -> DataFrame:
    """Value-weighted return of the closed positions as they were sold, between a start point at
    zero and an end point with the summed return.

    The running sums go by ranges of (portfolio, time of sale) of about the same size: sums per range, carried into the
    next, so neither a portfolio nor a busy day is one task.
    """
    keys = ["owner_id", "portfolio_id"]
    closed = valued.where((F.col("status") == "sold") & F.col("initial_price").isNotNull()
                          & F.col("current_value").isNotNull() & (F.col("closed_at") > 0))
    order = [F.col("closed_at"), F.col("position")]
    run = running_totals(in_ranges(closed, keys, order), keys, order, F.col("range"),
                         {"_inv": F.col("initial_price"), "_val": F.col("current_value")})
    pct = F.coalesce(F.try_divide(F.col("_val") - F.col("_inv"), _positive(F.col("_inv"))) * 100, F.lit(0.0))
    points = run.select(*keys, F.lit(1).alias("part"), F.col("closed_at").alias("ts"), "position",
                        rnd(pct, 2).alias("pct"))
    ends = valued.groupBy(*keys).agg(
        F.min("added_at").alias("start"), F.coalesce(F.sum("value_return_pct"), F.lit(0.0)).alias("all"),
        F.coalesce(F.sum(F.when(F.col("status") != "sold", F.col("value_return_pct"))), F.lit(0.0)).alias("open"),
        F.count_if((F.col("status") == "sold") & F.col("initial_price").isNotNull()
                   & F.col("current_value").isNotNull() & (F.col("closed_at") > 0)).alias("nc"))
    last = F.when(F.col("nc") > 0, F.col("all")).otherwise(F.col("open"))
    none = F.lit(None).cast("bigint")
    edge = ends.select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("part"), F.col("start").alias("ts"), none.alias("position"), F.lit(0.0).alias("pct")),
        F.struct(F.lit(2).alias("part"), F.lit(now_ms).cast("bigint").alias("ts"), none.alias("position"),
                 rnd(last, 2).alias("pct")))))
    return points.unionByName(edge)


# --- social feed ---------------------------------------------------------------------------------

def reaction_counts(reactions: DataFrame, name: str) -> DataFrame:
    return reactions.groupBy(F.col("portfolio_id").alias("id")).agg(F.count(F.lit(1)).alias(name))


def _with_counts(portfolios: DataFrame, likes: DataFrame, saves: DataFrame) -> DataFrame:
    out = (portfolios.join(reaction_counts(likes, "likes_count"), "id", "left")
           .join(reaction_counts(saves, "saves_count"), "id", "left"))
    return out.fillna(0, ["likes_count", "saves_count"])


def feed_join(portfolios: DataFrame, users: DataFrame, likes: DataFrame, saves: DataFrame,
              viewer: int) -> DataFrame:
    """Portfolios with owner name, counts and the viewer's own flags.

    Counts and the viewer's flag are one aggregate per reaction table before the join, so every join
    keeps one row per portfolio.
    """
    u = users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_username"))
    return _with_reactions(portfolios.join(u, "owner_id"), likes, saves, viewer) \
        .withColumn("return_pct", rnd(coerce_float(F.col("return_pct")), 2))


def feed_order(feed: DataFrame) -> DataFrame:
    return feed.orderBy(F.col("updated_at").desc(), F.col("id").desc())


def saved_join(portfolios: DataFrame, users: DataFrame, likes: DataFrame, saves: DataFrame,
               user: int) -> DataFrame:
    """Portfolios the user saved, newest save first."""
    mine = saves.where(F.col("user_id") == user).select(
        F.col("portfolio_id").alias("id"), F.col("created_at").alias("saved_at"))
    u = users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_username"))
    out = _with_counts(portfolios.join(mine, "id").join(u, "owner_id"), likes, saves)
    return out.orderBy(F.col("saved_at").desc(), F.col("id").desc())


def reaction_snapshot(portfolios: DataFrame, likes: DataFrame, saves: DataFrame, viewer: int) -> DataFrame:
    """Counts and the viewer's flags in one aggregate per reaction table."""
    return _with_reactions(portfolios.select("id"), likes, saves, viewer)


def _with_reactions(portfolios: DataFrame, likes: DataFrame, saves: DataFrame, viewer: int) -> DataFrame:
    def one(reactions, count, flag):
        return reactions.groupBy(F.col("portfolio_id").alias("id")).agg(
            F.count(F.lit(1)).alias(count), F.bool_or(F.col("user_id") == viewer).alias(flag))

    out = portfolios.join(one(likes, "likes_count", "viewer_liked"), "id", "left") \
        .join(one(saves, "saves_count", "viewer_saved"), "id", "left")
    return out.fillna(0, ["likes_count", "saves_count"]).fillna(False, ["viewer_liked", "viewer_saved"])


def newest_events(events: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` events of each portfolio; Spark prunes to k per task before the shuffle."""
    order = Window.partitionBy("portfolio_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (events.where(F.col("portfolio_id") > 0).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k))


def recent_events_top_k(events: DataFrame, k: int = FEED_EVENTS) -> DataFrame:
    return newest_events(events, k).withColumns({"action": F.lower("action"), "ticker": F.upper("ticker")})


def retain_last_120(events: DataFrame) -> DataFrame:
    return newest_events(events, KEPT_EVENTS).drop("rank")


def leaderboard_top12(feed: DataFrame) -> DataFrame:
    """Best returns first (no number counts as 0), then name; Spark keeps 12 rows per task."""
    score = coerce_float(F.col("return_pct"))
    return feed.withColumn("score", score).orderBy(
        F.col("score").desc(), F.coalesce("owner_username", F.lit("")), "id").limit(12)


def watchlist_signals(watchlist: DataFrame, signals: DataFrame) -> DataFrame:
    """Signal of each watched ticker; neutral without data where there is none."""
    s = signals.withColumnRenamed("symbol", "ticker")
    out = watchlist.join(s, "ticker", "left")
    return out.withColumns({
        "display_label": F.coalesce("display_label", F.lit("Neutro")),
        "tone": F.coalesce("tone", F.lit("neutral")), "has_data": F.coalesce("has_data", F.lit(False))})
