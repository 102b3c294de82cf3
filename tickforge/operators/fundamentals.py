"""Symbol resolution, source fallback, field merging and derived valuation figures."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.sources.payloads import news_scan
from tickforge.functions.scalars import news_symbol, rnd, ticker_candidates


def resolve_symbol(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """First candidate of each requested text that has data.

    Candidates (at most three per request) are equi-joined to the known symbols; no hint, so a
    large symbol table is shuffled and a small one broadcast by measured size.
    """
    c = requests.select("raw", F.posexplode(ticker_candidates(F.col("raw"))).alias("_p", "symbol"))
    hit = c.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    return hit.groupBy("raw").agg(F.min_by("symbol", "_p").alias("symbol"))


def fallback_source(sources: DataFrame) -> DataFrame:
    """Rows of the first non-empty source of each symbol, from ``(symbol, priority, ...)``.

    The best source is a pre-aggregated table joined back, not a window over all rows, so no
    symbol is gathered in one task.
    """
    best = sources.groupBy("symbol").agg(F.min("priority").alias("_best"))
    return (sources.join(best, "symbol").where(F.col("priority") == F.col("_best")).drop("_best"))


def merge_missing_info(sources: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field the value of the first source that has one; a single group-by.

    Values that did not parse are null already (number and text rules of the payload readers).
    """
    return sources.groupBy("symbol").agg(*[
        F.min_by(f, F.when(F.col(f).isNotNull(), F.col("priority"))).alias(f) for f in fields])


def news_with_fallback(wanted: DataFrame, news: DataFrame) -> DataFrame:
    """Items under the symbol itself, else under its form without digits and exchange suffix. A symbol has
    at most 100 items, cut before the join, so a ticker never meets a whole feed."""
    news = news_scan(news)
    c = wanted.select("ticker", F.posexplode(F.array(F.col("ticker"), news_symbol(F.col("ticker"))))
                      .alias("priority", "symbol"))
    found = c.join(news, "symbol")
    best = found.groupBy("ticker").agg(F.min("priority").alias("_best"))
    return (found.join(best, "ticker").where(F.col("priority") == F.col("_best"))
            .withColumnRenamed("symbol", "source_ticker").drop("priority", "_best"))


def _ratio(price: Column, per: Column) -> Column:
    return rnd(F.try_divide(price, per), 2)


def _nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def derive_valuation(f: DataFrame) -> DataFrame:
    """Fallback formulas for the figures a source left out.

    Expects current_price and the nullable source fields; ``net_income``, ``total_equity``,
    ``total_revenue`` and ``dividends_1y`` may come from statements and dividends. The trailing annual
    dividend rate of a source, where the column exists, stands in for a missing rate.
    """
    c = F.col
    if "trailing_annual_dividend_rate" in f.columns:
        f = f.withColumn("dividend_rate", F.coalesce(c("dividend_rate"), c("trailing_annual_dividend_rate")))
    price, shares = c("current_price"), c("shares_outstanding")
    f = f.withColumns({
        "market_cap": F.coalesce(c("market_cap"), _nonzero(shares) * _nonzero(price)),
        "eps": F.coalesce(c("trailing_eps"), F.try_divide(_nonzero(c("net_income")), _nonzero(shares))),
        "dividend": F.coalesce(c("dividend_rate"), c("dividends_1y"))})
    f = f.withColumn("eps_forward", F.coalesce(
        c("eps_forward"), c("eps") * (1 + _nonzero(c("earnings_growth"))), c("eps")))

    def positive(x):
        return F.when(x > 0, x)

    pe = F.coalesce(c("trailing_pe"), _ratio(price, positive(c("eps"))),
                    _ratio(price, positive(c("eps_forward"))))
    forward = F.coalesce(c("forward_pe"), _ratio(price, positive(c("eps_forward"))))
    book = F.coalesce(c("book_value"), F.try_divide(c("total_equity"), _nonzero(shares)))
    per_share = F.try_divide(c("total_revenue"), _nonzero(shares))
    return f.withColumns({
        "pe_ratio": positive(pe), "forward_pe": positive(forward),
        "dividend_yield": F.coalesce(c("dividend_yield"), F.try_divide(_nonzero(c("dividend")), _nonzero(price))),
        "price_to_book": F.coalesce(c("price_to_book"), _ratio(price, _nonzero(book))),
        "price_to_sales": F.coalesce(
            c("price_to_sales"), _ratio(_nonzero(c("market_cap")), _nonzero(c("total_revenue"))),
            _ratio(price, _nonzero(per_share)))})


def overview_fallbacks(info: DataFrame) -> DataFrame:
    """Second layer: figures from each other where one side is missing."""
    c = F.col
    price = c("current_price")
    eps_from_pe = F.try_divide(price, c("pe_ratio"))
    pe_from_eps = F.try_divide(price, c("eps"))
    yield_ = F.when(price > 0, c("dividend") / price)
    return info.select(
        "symbol", c("market_cap"),
        F.coalesce(c("pe_ratio"), pe_from_eps, c("forward_pe")).alias("pe_ratio"),
        F.coalesce(c("eps"), eps_from_pe).alias("eps"),
        F.coalesce(c("dividend"), c("dividend_yield") * price).alias("dividend"),
        F.coalesce(c("forward_pe"), c("pe_ratio"), pe_from_eps).alias("forward_pe"),
        F.coalesce(c("dividend_yield"), yield_).alias("dividend_yield"),
        F.coalesce(c("eps_forward"), c("eps"), eps_from_pe).alias("eps_forward"))


def quote_volumes(info: DataFrame, fast: DataFrame, bars: DataFrame, as_of: dt.date) -> DataFrame:
    """``(symbol, avg_volume, volume, low_52w, high_52w)`` of every symbol with bars: the info object's figure,
    else the fast object's (three months before ten days), else the one of the bars.

    The bars are read once: average of the newest 30, the newest volume and the year's range are one group-by."""
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    in_year = F.col("ts") >= F.add_months(F.lit(as_of), -12).cast("timestamp_ntz")
    own = (bars.withColumns({"_rn": F.row_number().over(newest), "_year": in_year}).where((F.col("_rn") <= 30) | F.col("_year"))
           .groupBy("symbol").agg(F.avg(F.when(F.col("_rn") <= 30, F.col("volume"))).alias("avg_volume"),
                                  F.max(F.when(F.col("_rn") == 1, F.col("volume"))).alias("volume"),
                                  F.min(F.when(F.col("_year"), F.col("low"))).alias("low_52w"),
                                  F.max(F.when(F.col("_year"), F.col("high"))).alias("high_52w")))
    both = own.alias("b").join(info.alias("i"), "symbol", "left").join(fast.alias("f"), "symbol", "left")
    return both.select(
        "symbol", F.coalesce("i.average_volume", "f.three_month_volume", "f.ten_day_volume", "b.avg_volume").alias("avg_volume"),
        *[F.coalesce(f"i.{c}", f"f.{c}", f"b.{c}").alias(c) for c in ("volume", "low_52w", "high_52w")])
