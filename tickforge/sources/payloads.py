"""Decoding of provider payloads: chart, quote and summary JSON, page HTML, statements, news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.scalars import normalize_row_key, parse_number, parse_numbers, to_text

CHART = ("chart struct<result:array<struct<meta:struct<shortName:string,symbol:string,"
         "marketCap:double,fiftyTwoWeekLow:double,fiftyTwoWeekHigh:double,regularMarketVolume:double>,"
         "timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,"
         "high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>")

# Fields of the flat quote object -> our names.
QUOTE_NUMBERS = {
    "marketCap": "market_cap", "trailingPE": "trailing_pe", "forwardPE": "forward_pe",
    "epsTrailingTwelveMonths": "trailing_eps", "epsForward": "eps_forward",
    "sharesOutstanding": "shares_outstanding", "dividendRate": "dividend_rate",
    "dividendYield": "dividend_yield", "beta": "beta", "priceToBook": "price_to_book",
    "priceToSalesTrailing12Months": "price_to_sales", "bookValue": "book_value",
    "totalRevenue": "total_revenue",
    "trailingAnnualDividendRate": "trailing_annual_dividend_rate",
    "trailingAnnualDividendYield": "trailing_annual_dividend_yield"}

# Numbers found in page text (escaped JSON key -> our name).
PAGE_NUMBERS = {
    "marketCap": "market_cap", "trailingPE": "trailing_pe", "forwardPE": "forward_pe",
    "trailingEps": "trailing_eps", "forwardEps": "eps_forward",
    "sharesOutstanding": "shares_outstanding", "dividendRate": "dividend_rate",
    "dividendYield": "dividend_yield", "beta": "beta", "priceToBook": "price_to_book",
    "priceToSalesTrailing12Months": "price_to_sales", "bookValue": "book_value",
    "totalRevenue": "total_revenue", "netIncomeToCommon": "net_income",
    "earningsGrowth": "earnings_growth"}

# Places of each summary field as (module, key), in order of preference.
SUMMARY_FIELDS = {
    "market_cap": (("summaryDetail", "marketCap"), ("defaultKeyStatistics", "marketCap")),
    "trailing_pe": (("summaryDetail", "trailingPE"),),
    "forward_pe": (("summaryDetail", "forwardPE"), ("financialData", "forwardPE")),
    "trailing_eps": (("defaultKeyStatistics", "trailingEps"),),
    "eps_forward": (("defaultKeyStatistics", "forwardEps"), ("financialData", "forwardEps")),
    "shares_outstanding": (("defaultKeyStatistics", "sharesOutstanding"),),
    "dividend_rate": (("summaryDetail", "dividendRate"), ("summaryDetail", "trailingAnnualDividendRate")),
    "dividend_yield": (("summaryDetail", "dividendYield"), ("summaryDetail", "trailingAnnualDividendYield")),
    "beta": (("summaryDetail", "beta"), ("defaultKeyStatistics", "beta")),
    "price_to_sales": (("summaryDetail", "priceToSalesTrailing12Months"),),
    "price_to_book": (("defaultKeyStatistics", "priceToBook"),),
    "book_value": (("defaultKeyStatistics", "bookValue"),),
    "total_revenue": (("financialData", "totalRevenue"),),
    "net_income": (("financialData", "netIncomeToCommon"), ("financialData", "netIncome"))}

# Alternative keys of the fast quote object.
FAST_FIELDS = {
    "market_cap": ("marketCap", "market_cap"), "shares_outstanding": ("sharesOutstanding", "shares"),
    "low_52w": ("yearLow", "year_low"), "high_52w": ("yearHigh", "year_high"),
    "volume": ("lastVolume", "volume", "regularMarketVolume"),
    "ten_day_volume": ("tenDayAverageVolume", "ten_day_average_volume"),
    "three_month_volume": ("threeMonthAverageVolume", "three_month_average_volume"),
    "last_price": ("lastPrice", "last_price", "regularMarketPrice", "regular_market_price")}

# Alternative keys of the info object.
INFO_FIELDS = {
    "market_cap": ("marketCap", "market_cap"), "trailing_pe": ("trailingPE", "trailingPe"),
    "forward_pe": ("forwardPE", "forwardPe"),
    "trailing_eps": ("trailingEps", "epsTrailingTwelveMonths", "eps"),
    "eps_forward": ("forwardEps", "epsForward", "epsNext5Y"),
    "shares_outstanding": ("sharesOutstanding", "shareOutstanding", "shares"),
    "dividend_rate": ("dividendRate", "trailingAnnualDividendRate"),
    "dividend_yield": ("dividendYield", "trailingAnnualDividendYield"),
    "beta": ("beta", "beta3Year"), "price_to_book": ("priceToBook",),
    "price_to_sales": ("priceToSalesTrailing12Months", "priceToSales"),
    "book_value": ("bookValue",), "total_revenue": ("totalRevenue", "revenue"),
    "net_income": ("netIncomeToCommon", "netIncome"),
    "average_volume": ("averageVolume", "averageVolume10days", "averageDailyVolume10Day",
                       "averageDailyVolume3Month", "threeMonthAverageVolume", "tenDayAverageVolume"),
    "volume": ("volume", "regularMarketVolume"), "low_52w": ("fiftyTwoWeekLow", "yearLow"),
    "high_52w": ("fiftyTwoWeekHigh", "yearHigh"),
    "earnings_growth": ("earningsGrowth", "earningsQuarterlyGrowth"),
    "short_name": ("shortName", "longName"), "sector": ("sector", "industry", "category")}
TEXT_FIELDS = ("short_name", "sector")

# Statement lines that name revenue and equity.
REVENUE_LABELS = ("Total Revenue", "Revenue", "Operating Revenue")
EQUITY_LABELS = ("Total Stockholder Equity", "Stockholders Equity",
                 "Total Equity Gross Minority Interest", "Common Stock Equity")


def chart_json_to_bars(payloads: DataFrame) -> DataFrame:
    """``(symbol, payload)`` -> bars; parallel lists zipped, bars without a close dropped."""
    r = F.col("p.chart.result")[0]
    q = r["indicators"]["quote"][0]
    parsed = payloads.withColumn("p", F.from_json("payload", CHART))
    cells = F.arrays_zip(r["timestamp"].alias("at"), *[q[c].alias(c) for c in
                                                       ("open", "high", "low", "close", "volume")])
    rows = parsed.select("symbol", F.inline(cells).alias("at", "open", "high", "low", "close", "volume"))
    out = rows.withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz"))
    return (out.where(F.col("close").isNotNull())
            .select("symbol", "ts", "open", "high", "low", "close", "volume"))


def chart_json_meta(payloads: DataFrame) -> DataFrame:
    parsed = payloads.withColumn("p", F.from_json("payload", CHART))
    return parsed.select("symbol", F.col("p.chart.result")[0]["meta"].alias("m")).select(
        "symbol", F.coalesce("m.shortName", "m.symbol").alias("short_name"),
        F.col("m.marketCap").alias("market_cap"), F.col("m.fiftyTwoWeekLow").alias("low_52w"),
        F.col("m.fiftyTwoWeekHigh").alias("high_52w"), F.col("m.regularMarketVolume").alias("volume"))


def quote_json_to_fundamentals(payloads: DataFrame) -> DataFrame:
    """Flat quote JSON -> fundamentals; empty names fall back to the longer form. A number may be a JSON number,
    a text such as "1.2B", or an object with ``raw`` and ``fmt``."""
    names = ("shortName", "longName", "sector", "industry")
    fields = ",".join(f"{k}:string" for k in (*QUOTE_NUMBERS, *names))
    schema = f"quoteResponse struct<result:array<struct<{fields}>>>"
    q = payloads.select("symbol", F.from_json("payload", schema)["quoteResponse"]["result"].alias("r"))
    q = q.where(F.size("r") > 0).select("symbol", F.col("r")[0].alias("q"))

    def leaf(key):
        text = F.col(f"q.{key}")
        parts = F.coalesce(F.get_json_object(text, "$.raw"), F.get_json_object(text, "$.fmt"))
        return F.when(text.startswith("{"), parts).otherwise(text)

    def name(key):
        return F.nullif(F.col(f"q.{key}"), F.lit(""))

    numbers = parse_numbers(F.array(*[leaf(k) for k in QUOTE_NUMBERS]))
    found = q.select("symbol", numbers.alias("x"), F.coalesce(name("shortName"), F.col("q.longName")).alias("short_name"),
                     F.coalesce(name("sector"), F.col("q.industry")).alias("sector"))
    return found.select("symbol", *[F.col("x")[i].alias(n) for i, n in enumerate(QUOTE_NUMBERS.values())], "short_name", "sector")


def quote_summary_to_fundamentals(payloads: DataFrame) -> DataFrame:
    """Nested modules whose leaves are numbers or ``{raw, fmt}``; a zero falls through too."""
    modules = {}
    for places in SUMMARY_FIELDS.values():
        for module, key in places:
            modules.setdefault(module, set()).add(key)
    struct = ",".join(f"{m}:struct<{','.join(f'{k}:string' for k in sorted(keys))}>"
                      for m, keys in modules.items())
    schema = f"quoteSummary struct<result:array<struct<{struct}>>>"
    s = payloads.select("symbol", F.from_json("payload", schema)["quoteSummary"]["result"].alias("r"))
    s = s.where(F.size("r") > 0).select("symbol", F.col("r")[0].alias("m"))

    def leaf(module, key):
        text = F.col(f"m.{module}.{key}")
        return F.when(text.startswith("{"), F.get_json_object(text, "$.raw")).otherwise(text) \
            .try_cast("double")

    def first(places):
        *early, last = [leaf(*p) for p in places]
        return F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in early], last)

    return s.select("symbol", *[first(p).alias(n) for n, p in SUMMARY_FIELDS.items()])


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


# The next two functions hold the patterns of numbers in provider pages.
def page_json_text(html: Column, key: str) -> Column:
    """Number text behind ``\\"key\\":{\\"raw\\":`` in JSON that is escaped inside a page."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    return _found(html, r'\\"' + key + r'\\":\{\\"raw\\":' + number)


def page_tag_text(html: Column, key: str) -> Column:
    """Number text in the tag attributes, whichever of the two attributes comes first."""
    field = f'data-field="{key}"'
    value = 'data-value="([^"]+)"'
    return F.coalesce(_found(html, f"<fin-streamer[^>]*{field}[^>]*{value}"),
                      _found(html, f"<fin-streamer[^>]*{value}[^>]*{field}"))


def page_metrics(pages: DataFrame, find, fields: dict[str, str]) -> DataFrame:
    """Numbers of the pages by one of the finders above.

    The texts are extracted in a step of their own: ``parse_number`` uses its argument many
    times, and every use would search the whole page again.
    """
    found = pages.select("symbol", *[find(F.col("html"), k).alias(n) for k, n in fields.items()])
    return found.select("symbol", *[parse_number(F.col(n)).alias(n) for n in fields.values()])


def page_fundamentals(pages: DataFrame) -> DataFrame:
    """All page numbers, JSON text first and tags second.

    A JSON match is always a number, so the tag is only searched where the JSON is missing.
    """
    return page_metrics(pages, lambda html, key: F.coalesce(page_json_text(html, key),
                                                            page_tag_text(html, key)), PAGE_NUMBERS)


def page_text(html: Column, key: str) -> Column:
    """Text behind ``\\"key\\":\\"``, unicode escapes decoded."""
    raw = _found(html, r'\\"' + key + r'\\":\\"([^\\"]+)\\"')
    quoted = F.concat(F.lit('{"t":"'), raw, F.lit('"}'))
    return to_text(F.coalesce(F.get_json_object(quoted, "$.t"), raw))


def page_text_fields(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    return pages.select("symbol", F.coalesce(page_text(html, "shortName"), page_text(html, "longName"))
                        .alias("short_name"), page_text(html, "sector").alias("sector"))


def pick_fields(payloads: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """First present of the alternative keys of a flat JSON object, per target field."""
    keys = sorted({k for alts in fields.values() for k in alts})
    obj = payloads.select("symbol", F.json_tuple("payload", *keys).alias(*[f"k{i}" for i in range(len(keys))]))
    at = {k: F.col(f"k{i}") for i, k in enumerate(keys)}
    raw = obj.select("symbol", *[F.coalesce(*[at[k] for k in alts]).alias(name)
                                 for name, alts in fields.items()])
    return raw.select("symbol", *[
        (to_text(F.col(n)) if n in TEXT_FIELDS else parse_number(F.col(n))).alias(n) for n in fields])


def statement_value(statements: DataFrame, labels: tuple[str, ...], name: str) -> DataFrame:
    """Newest value of the first row (in statement order) with one of the labels and a value."""
    wanted = [x.lower() for x in labels]
    keys = ["".join(ch for ch in x if ch.isascii() and ch.isalnum()) for x in wanted]
    rows = statements.where(normalize_row_key(F.col("line_item")).isin(keys) & F.col("value").isNotNull())
    return rows.groupBy("symbol").agg(_first_row().alias(name))


def net_income_value(statements: DataFrame) -> DataFrame:
    rows = statements.where(F.lower("line_item").contains("net income") & F.col("value").isNotNull())
    return rows.groupBy("symbol").agg(_first_row().alias("net_income"))


def _first_row() -> Column:
    return F.min_by("value", F.struct("row_pos", -F.unix_date("period_end")))


def latest_numeric(series: DataFrame) -> DataFrame:
    """Last value that reads as a number, per symbol of ``(symbol, ts, value)``."""
    v = F.col("value").try_cast("double")
    v = F.when(~F.isnan(v), v)
    return series.groupBy("symbol").agg(
        F.max_by(v, F.when(v.isNotNull(), F.col("ts"))).alias("latest"))


def news_scan(news: DataFrame, most: int = 100) -> DataFrame:
    """First ``most`` items of each symbol in feed order, publishing time as ISO text."""
    from pyspark.sql import Window
    feed = Window.partitionBy("symbol").orderBy("position")
    return (news.withColumn("_rn", F.row_number().over(feed)).where(F.col("_rn") <= most)
            .select("symbol", "position", "title", "link",
                    F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss").alias("published")))


