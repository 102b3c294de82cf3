"""Payloads, symbols, numbers and texts (survey 2.1, 2.2, 2.3).

The payload texts are built by Spark from the given tables, row by row, and then decoded; the
SQL twins compute the expected values from the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions import scalars as T
from tickforge.functions.scalars import rnd
from tickforge.operators import fundamentals as U
from tickforge.plans.data import AS_OF, AS_OF_SQL, DAY_SQL, SUPPLIER_SQL, day, supplier_bars, table, ticks
from tickforge.plans.registry import query
from tickforge.sources import bars as B
from tickforge.sources import payloads as P


# --- chart JSON -----------------------------------------------------------------------------

def _charts(spark, sf):
    b = supplier_bars(spark, sf)
    d = F.unix_date(F.col("ts").cast("date"))
    cell = F.struct((d.cast("bigint") * 86400).alias("t"), "open", "high", "low",
                    F.when(d % 11 != 0, F.col("close")).alias("close"), "volume")
    g = b.groupBy("symbol").agg(F.sort_array(F.collect_list(cell)).alias("b"), F.max("high").alias("hi"))
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    meta = F.struct(F.col("symbol").alias("symbol"), F.col("hi").alias("fiftyTwoWeekHigh"))
    result = F.struct(meta.alias("meta"), F.col("b.t").alias("timestamp"),
                      F.struct(F.array(quote).alias("quote")).alias("indicators"))
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return g.select("symbol", F.to_json(chart).alias("payload"))


@query("chart_json_to_bars", f"""WITH {SUPPLIER_SQL} SELECT symbol, {DAY_SQL} AS day, round(open, 4) AS open, round(high, 4) AS high,
 round(low, 4) AS low, round(close, 4) AS close, volume FROM bars WHERE date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 11 <> 0""")
def _(spark, sf):
    return P.chart_json_to_bars(_charts(spark, sf)).select(
        "symbol", day().alias("day"), *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("chart_json_meta", f"WITH {SUPPLIER_SQL} SELECT symbol, symbol AS short_name, round(max(high), 4) AS high_52w FROM bars GROUP BY 1")
def _(spark, sf):
    return P.chart_json_meta(_charts(spark, sf)).select("symbol", "short_name", rnd("high_52w", 4).alias("high_52w"))


# --- quote JSON -------------------------------------------------------------------------------

def _quotes(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    q = F.struct(
        (F.col("p_retailprice") * F.col("p_size")).alias("marketCap"),
        F.when(k % 3 != 0, F.col("p_size").cast("double")).alias("trailingPE"),
        F.when(k % 4 != 0, F.col("p_retailprice") / 10).alias("epsTrailingTwelveMonths"),
        F.lit(1000.0).alias("sharesOutstanding"),
        F.when(k % 2 == 0, F.col("p_name")).otherwise(F.lit("")).alias("shortName"),
        F.col("p_brand").alias("longName"), F.col("p_type").alias("industry"))
    result = F.when(k % 10 != 9, F.array(q)).otherwise(F.filter(F.array(q), lambda x: F.lit(False)))
    doc = F.struct(F.struct(result.alias("result")).alias("quoteResponse"))
    return p.select(k.cast("string").alias("symbol"), F.to_json(doc).alias("payload"))


@query("quote_json_to_fundamentals", """SELECT CAST(p_partkey AS VARCHAR) AS symbol, round(p_retailprice * p_size, 4) AS market_cap,
 CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS trailing_pe, CASE WHEN p_partkey % 4 <> 0 THEN round(p_retailprice / 10, 4) END AS trailing_eps,
 CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS short_name, p_type AS sector FROM part WHERE p_partkey % 10 <> 9""")
def _(spark, sf):
    return P.quote_json_to_fundamentals(_quotes(spark, sf)).select(
        "symbol", rnd("market_cap", 4).alias("market_cap"), "trailing_pe",
        rnd("trailing_eps", 4).alias("trailing_eps"), "short_name", "sector")


@query("quote_json_leaves", """SELECT CAST(p_partkey AS VARCHAR) AS symbol, round(p_retailprice, 4) AS market_cap, p_size * 1000.0::DOUBLE AS trailing_pe, round(p_size / 100.0::DOUBLE, 6) AS forward_pe,
 CASE WHEN p_partkey % 2 = 1 THEN p_size::DOUBLE END AS beta, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS book_value FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    q = F.struct(F.struct(F.col("p_retailprice").alias("raw"), F.lit("much").alias("fmt")).alias("marketCap"),
                 F.concat(size.cast("string"), F.lit("K")).alias("trailingPE"),
                 F.struct(F.lit(None).cast("double").alias("raw"), F.concat(size.cast("string"), F.lit("%")).alias("fmt")).alias("forwardPE"),
                 F.when(k % 2 == 1, size.cast("string")).otherwise(F.lit("N/A")).alias("beta"),
                 F.when(k % 3 != 0, size).alias("bookValue"))
    doc = F.struct(F.struct(F.array(q).alias("result")).alias("quoteResponse"))
    f = P.quote_json_to_fundamentals(p.select(k.cast("string").alias("symbol"), F.to_json(doc).alias("payload")))
    return f.select("symbol", rnd("market_cap", 4).alias("market_cap"), "trailing_pe", rnd("forward_pe", 6).alias("forward_pe"), "beta", "book_value")


def _summaries(spark, sf):
    p = table(spark, sf, "part")
    k, price, size = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size").cast("double")

    def leaf(x):
        return F.struct(x.alias("raw"), F.format_string("%.2f", x).alias("fmt"))

    summary = F.struct(leaf(F.when(k % 3 == 0, F.lit(0.0)).otherwise(price)).alias("marketCap"),
                       size.alias("trailingPE"), F.when(k % 5 == 0, F.lit(0.0)).otherwise(size).alias("forwardPE"),
                       leaf(F.when(k % 7 == 0, F.lit(0.0)).otherwise(price / 100)).alias("dividendRate"),
                       leaf(price / 200).alias("trailingAnnualDividendRate"))
    stats = F.struct((price * 2).alias("marketCap"), leaf(price / 10).alias("trailingEps"))
    fin = F.struct(leaf(size * 3).alias("forwardPE"), leaf(price * 50).alias("netIncome"))
    r = F.struct(summary.alias("summaryDetail"), stats.alias("defaultKeyStatistics"), fin.alias("financialData"))
    doc = F.struct(F.struct(F.array(r).alias("result")).alias("quoteSummary"))
    return p.select(k.cast("string").alias("symbol"), F.to_json(doc).alias("payload"))


@query("quote_summary_to_fundamentals", """SELECT CAST(p_partkey AS VARCHAR) AS symbol,
 round(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END, 4) AS market_cap, p_size::DOUBLE AS trailing_pe,
 CASE WHEN p_partkey % 5 = 0 THEN p_size * 3 ELSE p_size END::DOUBLE AS forward_pe, round(p_retailprice / 10, 4) AS trailing_eps,
 round(CASE WHEN p_partkey % 7 = 0 THEN p_retailprice / 200 ELSE p_retailprice / 100 END, 4) AS dividend_rate, round(p_retailprice * 50, 4) AS net_income FROM part""")
def _(spark, sf):
    s = P.quote_summary_to_fundamentals(_summaries(spark, sf))
    return s.select("symbol", rnd("market_cap", 4).alias("market_cap"), "trailing_pe", "forward_pe",
                    rnd("trailing_eps", 4).alias("trailing_eps"), rnd("dividend_rate", 4).alias("dividend_rate"),
                    rnd("net_income", 4).alias("net_income"))


# --- pages: the given HTML with provider fragments written behind it --------------------------

def _pages(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id").cast("string")
    js = F.concat(F.lit(r'<script>\"marketCap\":{\"raw\":'), k, F.lit(r'.5e3,\"fmt\":\"x\"},\"beta\":{\"raw\":-'), k,
                  F.lit(r'.25},\"longName\":\"Pagina è '), k, F.lit(r'\",\"sector\":\"S'), k, F.lit(r'\"</script>'))
    tag = F.concat(F.lit('<fin-streamer class="a" data-field="trailingPE" x="1" data-value="'), k,
                   F.lit('.5">'), F.lit('<fin-streamer data-value="1,2'), k, F.lit('K" data-field="priceToBook">'))
    return p.select(k.alias("symbol"), F.concat("html", js, tag).alias("html"))


@query("page_metrics_json", """SELECT CAST(page_id AS VARCHAR) AS symbol, (page_id + 0.5::DOUBLE) * 1000 AS market_cap, -(page_id + 0.25::DOUBLE) AS beta,
 CAST(NULL AS DOUBLE) AS trailing_pe FROM pages""")
def _(spark, sf):
    fields = {"marketCap": "market_cap", "beta": "beta", "trailingPE": "trailing_pe"}
    return P.page_metrics(_pages(spark, sf), P.page_json_text, fields)


@query("page_metrics_tag", """SELECT CAST(page_id AS VARCHAR) AS symbol, page_id + 0.5::DOUBLE AS trailing_pe, CAST('12' || page_id AS DOUBLE) * 1000 AS price_to_book FROM pages""")
def _(spark, sf):
    fields = {"trailingPE": "trailing_pe", "priceToBook": "price_to_book"}
    return P.page_metrics(_pages(spark, sf), P.page_tag_text, fields)


@query("page_fundamentals", """SELECT CAST(page_id AS VARCHAR) AS symbol, (page_id + 0.5::DOUBLE) * 1000 AS market_cap, -(page_id + 0.25::DOUBLE) AS beta,
 page_id + 0.5::DOUBLE AS trailing_pe, CAST('12' || page_id AS DOUBLE) * 1000 AS price_to_book FROM pages""")
def _(spark, sf):
    return P.page_fundamentals(_pages(spark, sf)).select("symbol", "market_cap", "beta", "trailing_pe", "price_to_book")


@query("page_text_fields", """SELECT CAST(page_id AS VARCHAR) AS symbol, 'Pagina è ' || page_id AS short_name, 'S' || page_id AS sector FROM pages""")
def _(spark, sf):
    return P.page_text_fields(_pages(spark, sf))


# --- statements -------------------------------------------------------------------------------

_LABEL_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Operating Revenue' WHEN '2-HIGH' THEN 'Total Revenue' WHEN '3-MEDIUM' THEN 'Net Income'
 WHEN '4-NOT SPECIFIED' THEN 'Normalized Net Income' ELSE 'Common Stock Equity' END"""
_ST_SQL = f"""st AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, {_LABEL_SQL} AS line_item, CAST(left(o_orderpriority, 1) AS INTEGER) AS row_pos,
 make_date(year(o_orderdate), 12, 31) AS period_end, sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS value FROM orders GROUP BY 1, 2, 3, 4)"""


def _statements(spark, sf):
    o = table(spark, sf, "orders")
    label = F.col("o_orderpriority")
    names = {"1-URGENT": "Operating Revenue", "2-HIGH": "Total Revenue", "3-MEDIUM": "Net Income",
             "4-NOT SPECIFIED": "Normalized Net Income"}
    item = F.lit("Common Stock Equity")
    for k, v in names.items():
        item = F.when(label == k, F.lit(v)).otherwise(item)
    return o.groupBy(F.col("o_custkey").cast("string").alias("symbol"), item.alias("line_item"),
                     F.left(label, F.lit(1)).cast("int").alias("row_pos"),
                     F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period_end")).agg(
        F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("value"))


@query("statement_value", f"""WITH {_ST_SQL} SELECT symbol,
 round(arg_min(value, (row_pos, -year(period_end))) FILTER (line_item IN ('Operating Revenue', 'Total Revenue')), 2) AS revenue,
 round(arg_min(value, (row_pos, -year(period_end))) FILTER (line_item = 'Common Stock Equity'), 2) AS equity
FROM st WHERE value IS NOT NULL GROUP BY 1 HAVING revenue IS NOT NULL OR equity IS NOT NULL""")
def _(spark, sf):
    st = _statements(spark, sf)
    r = P.statement_value(st, P.REVENUE_LABELS, "revenue")
    e = P.statement_value(st, P.EQUITY_LABELS, "equity")
    return r.join(e, "symbol", "full").select("symbol", rnd("revenue", 2).alias("revenue"), rnd("equity", 2).alias("equity"))


@query("net_income_value", f"""WITH {_ST_SQL} SELECT symbol, round(arg_min(value, (row_pos, -year(period_end))), 2) AS net_income
FROM st WHERE value IS NOT NULL AND line_item LIKE '%Net Income%' GROUP BY 1""")
def _(spark, sf):
    return P.net_income_value(_statements(spark, sf)).select("symbol", rnd("net_income", 2).alias("net_income"))


@query("latest_numeric", """WITH s AS (SELECT event_type AS symbol, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
SELECT symbol, arg_max(v, ts) AS latest FROM s WHERE v IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise("n.d.")
    return P.latest_numeric(e.select(F.col("event_type").alias("symbol"), "ts", text.alias("value")))


@query("fast_info_fields", """SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_acctbal AS market_cap, c_acctbal / 2 AS low_52w,
 CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::DOUBLE ELSE c_nationkey + 1.0::DOUBLE END AS volume, c_acctbal + 1 AS last_price FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k, bal, nat = F.col("c_custkey"), F.col("c_acctbal"), F.col("c_nationkey")
    doc = F.struct(F.when(k % 2 == 0, bal).alias("marketCap"), F.when(k % 2 == 1, bal).alias("market_cap"),
                   (bal / 2).alias("year_low"), F.when(k % 3 == 0, nat).alias("lastVolume"), (nat + 1).alias("volume"),
                   (bal + 1).alias("regularMarketPrice"))
    f = P.pick_fields(c.select(k.cast("string").alias("symbol"), F.to_json(doc).alias("payload")), P.FAST_FIELDS)
    return f.select("symbol", "market_cap", "low_52w", "volume", "last_price")


@query("pick_keys", """SELECT CAST(c_custkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal * 2 END AS trailing_eps,
 c_nationkey::DOUBLE AS average_volume, c_name AS short_name, c_mktsegment AS sector, CAST(NULL AS DOUBLE) AS beta FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    doc = F.struct(F.when(k % 2 == 0, bal).alias("trailingEps"), (bal * 2).alias("eps"),
                   F.col("c_nationkey").alias("threeMonthAverageVolume"), F.lit(7).alias("tenDayAverageVolume"),
                   F.col("c_name").alias("longName"), F.col("c_mktsegment").alias("category"))
    f = P.pick_fields(c.select(k.cast("string").alias("symbol"), F.to_json(doc).alias("payload")), P.INFO_FIELDS)
    return f.select("symbol", "trailing_eps", "average_volume", "short_name", "sector", "beta")


@query("news_scan", """SELECT event_type AS symbol, event_id AS position, 'Item ' || event_id AS title, props AS link,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') AS published FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 100""")
def _(spark, sf):
    return P.news_scan(_news(spark, sf))


def _news(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("position"),
                    F.concat(F.lit("Item "), F.col("event_id").cast("string")).alias("title"),
                    F.col("props").alias("link"), F.col("ts").alias("published"))


# --- tickers ------------------------------------------------------------------------------------

def _tickers(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.expr(
        "CASE p_size % 6 WHEN 0 THEN p_size || p_name WHEN 1 THEN p_size || left(p_name, 3) || '.mi' "
        "WHEN 2 THEN ' ' || left(p_name, 4) || ' ' WHEN 3 THEN left(p_name, 3) || '.L' "
        "WHEN 4 THEN p_partkey || left(p_name, 2) END").alias("raw"))


_RAW = """tk AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size || p_name WHEN 1 THEN p_size || left(p_name, 3) || '.mi'
 WHEN 2 THEN ' ' || left(p_name, 4) || ' ' WHEN 3 THEN left(p_name, 3) || '.L' WHEN 4 THEN p_partkey || left(p_name, 2) END AS raw FROM part),
 up AS (SELECT *, replace(upper(trim(coalesce(raw, ''))), ' ', '') AS u FROM tk),
 nm AS (SELECT *, CASE WHEN regexp_matches(u, '^\\d+[A-Z]{1,6}(\\.[A-Z]{1,3})?$') THEN regexp_replace(u, '^\\d+', '') ELSE u END AS norm FROM up)"""
_DISTINCT = "array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> '' AND list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL), ' ')"


@query("normalize_ticker", f"WITH {_RAW} SELECT p_partkey, CASE WHEN raw IS NULL THEN NULL ELSE norm END AS ticker FROM nm")
def _(spark, sf):
    return _tickers(spark, sf).select("p_partkey", T.normalize_ticker(F.col("raw")).alias("ticker"))


@query("ticker_candidates", f"""WITH {_RAW}, c AS (SELECT p_partkey, [CASE WHEN regexp_matches(u, '^\\d+[A-Z]{{1,6}}$') THEN u || '.MI' ELSE '' END, u, norm] AS a FROM nm)
SELECT p_partkey, {_DISTINCT} AS candidates FROM c""")
def _(spark, sf):
    return _tickers(spark, sf).select("p_partkey", F.array_join(T.ticker_candidates(F.col("raw")), " ").alias("candidates"))


@query("fundamentals_candidates", f"""WITH {_RAW}, c AS (SELECT p_partkey, [u, norm, CASE WHEN contains(norm, '.') THEN split_part(norm, '.', 1) ELSE '' END,
 regexp_replace(u, '^\\d+', ''), CASE WHEN contains(u, '.') THEN split_part(regexp_replace(u, '^\\d+', ''), '.', 1) ELSE '' END] AS a FROM nm)
SELECT p_partkey, {_DISTINCT} AS candidates FROM c""")
def _(spark, sf):
    return _tickers(spark, sf).select("p_partkey", F.array_join(T.fundamentals_candidates(F.col("raw")), " ").alias("candidates"))


@query("news_symbol", f"""WITH {_RAW} SELECT p_partkey, regexp_replace(regexp_replace(trim(upper(raw)), '^[0-9]+', ''), '\\.(MI|L|DE|PA|TO|V|SW|AS|MC|SA|HK|SS|SZ|AX|KS|KQ|TW|T|SI)$', '') AS ticker FROM tk""")
def _(spark, sf):
    return _tickers(spark, sf).select("p_partkey", T.news_symbol(F.col("raw")).alias("ticker"))


@query("news_locale", f"""WITH {_RAW} SELECT p_partkey, CASE WHEN upper(raw) LIKE '%.MI' THEN 'IT' WHEN upper(raw) LIKE '%.L' THEN 'GB' ELSE 'US' END AS region,
 CASE WHEN upper(raw) LIKE '%.MI' THEN 'it-IT' WHEN upper(raw) LIKE '%.L' THEN 'en-GB' ELSE 'en-US' END AS lang FROM tk""")
def _(spark, sf):
    return _tickers(spark, sf).select("p_partkey", T.news_locale(F.col("raw")).alias("x")).select("p_partkey", "x.region", "x.lang")


@query("resolve_symbol", f"""WITH {_RAW}, known AS (SELECT DISTINCT norm AS symbol FROM nm WHERE p_partkey % 2 = 0 AND norm <> ''),
 c AS (SELECT DISTINCT raw, unnest([1, 2, 3]) AS p, unnest([CASE WHEN regexp_matches(u, '^\\d+[A-Z]{{1,6}}$') THEN u || '.MI' ELSE '' END, u, norm]) AS symbol FROM nm WHERE raw IS NOT NULL)
SELECT raw, arg_min(symbol, p) AS symbol FROM c JOIN known USING (symbol) GROUP BY 1""")
def _(spark, sf):
    t = _tickers(spark, sf)
    known = t.where(F.col("p_partkey") % 2 == 0).select(T.normalize_ticker(F.col("raw")).alias("symbol")).where("symbol <> ''")
    return U.resolve_symbol(t.select("raw").where("raw IS NOT NULL").distinct(), known)


# --- numbers and labels ---------------------------------------------------------------------------

_NUM = """CASE c_custkey % 9 WHEN 0 THEN printf('%.2f', c_acctbal) || 'K' WHEN 1 THEN printf('%.2f', c_acctbal) || '%' WHEN 2 THEN 'N/A'
 WHEN 3 THEN ' ' || printf('%.2f', c_acctbal) || 'm ' WHEN 4 THEN '1,' || c_nationkey WHEN 5 THEN '—' WHEN 6 THEN c_nationkey || 'B' WHEN 7 THEN 'K' END"""


def _numbers(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.expr(_NUM).alias("txt"))


@query("parse_number", f"""WITH n AS (SELECT c_custkey, c_acctbal, c_nationkey, {_NUM} AS txt FROM customer)
SELECT c_custkey, txt, round(CASE c_custkey % 9 WHEN 0 THEN CAST(printf('%.2f', c_acctbal) AS DOUBLE) * 1e3 WHEN 1 THEN CAST(printf('%.2f', c_acctbal) AS DOUBLE) / 100
 WHEN 3 THEN CAST(printf('%.2f', c_acctbal) AS DOUBLE) * 1e6 WHEN 4 THEN CAST('1' || c_nationkey AS DOUBLE) WHEN 6 THEN c_nationkey * 1e9 END, 6) AS value FROM n""")
def _(spark, sf):
    return _numbers(spark, sf).select("c_custkey", "txt", rnd(T.parse_number(F.col("txt")), 6).alias("value"))


@query("to_text", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_name ELSE c_mktsegment END AS txt FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    fmt = F.when(k % 3 == 1, F.concat(F.lit(" "), "c_name", F.lit(" "))).when(k % 3 == 2, F.lit(""))
    raw = F.when(k % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", T.to_text(raw, fmt).alias("txt"))


@query("normalize_row_key", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.normalize_row_key(F.col("c_name")).alias("key"))


@query("pick_best_label", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS label FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    first = F.when(F.col("c_custkey") % 4 == 1, F.lit(" n/a ")).when(F.col("c_custkey") % 4 == 3, F.lit("--"))
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(F.lit("Unknown"))
    return c.select("c_custkey", T.pick_best_label(first, second, F.col("c_name")).alias("label"))


@query("coerce_non_negative_int", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 5 END AS n FROM customer")
def _(spark, sf):
    k, nat = F.col("c_custkey"), F.col("c_nationkey")
    n = F.when(k % 3 == 0, nat.cast("string")).when(k % 3 == 1, (-nat - 1).cast("string")).otherwise(F.lit("many"))
    return table(spark, sf, "customer").select("c_custkey", T.coerce_non_negative_int(n, 5).alias("n"))


@query("coerce_float", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS x FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    x = F.when(k % 2 == 0, F.col("c_acctbal").cast("string")).when(k % 4 == 1, F.lit("NaN")).otherwise(F.lit("-"))
    return table(spark, sf, "customer").select("c_custkey", T.coerce_float(x).alias("x"))


@query("timeframe_map", """SELECT event_id, CASE event_type WHEN 'click' THEN '60m' WHEN 'view' THEN '240m' WHEN 'error' THEN '1wk' WHEN 'signup' THEN '1mo' ELSE '1d' END AS code FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    tf = F.lit("2d")
    for kind, t in {"click": "1h", "view": "4h", "error": "1w", "signup": "1mo"}.items():
        tf = F.when(F.col("event_type") == kind, F.lit(t)).otherwise(tf)
    return e.select("event_id", T.interval_of_timeframe(tf).alias("code"))


@query("lookback_rule", f"""WITH {SUPPLIER_SQL} SELECT symbol, count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 72 MONTH) AS quote_rows,
 count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 24 MONTH) AS technicals_rows, count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 6 MONTH) AS zones_rows,
 count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 60 DAY) AS hour_rows FROM bars GROUP BY 1""")
def _(spark, sf):
    ts = F.col("ts")

    def n(analysis, tf):
        return F.count_if(ts >= B.period_start(analysis, tf, AS_OF).cast("timestamp_ntz"))

    return supplier_bars(spark, sf).groupBy("symbol").agg(
        n("quote", "1d").alias("quote_rows"), n("technicals", "1d").alias("technicals_rows"),
        n("zones", "1d").alias("zones_rows"), n("technicals", "1h").alias("hour_rows"))


@query("fmt_large", """SELECT c_custkey, CASE WHEN v IS NULL THEN '-' WHEN abs(v) >= 1e12 THEN printf('%.2f', v / 1e12) || 'T' WHEN abs(v) >= 1e9 THEN printf('%.2f', v / 1e9) || 'B'
 WHEN abs(v) >= 1e6 THEN printf('%.2f', v / 1e6) || 'M' WHEN abs(v) >= 1e3 THEN printf('%.0f', v / 1e3) || 'k' ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS txt
FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_acctbal * 1e9 + 1e12 WHEN 1 THEN c_acctbal * 1e6 + 1e9 WHEN 2 THEN c_acctbal * 1e3 + 1.0003e6 WHEN 3 THEN abs(c_acctbal) + 1000.3 WHEN 4 THEN c_nationkey END AS v FROM customer)""")
def _(spark, sf):
    v = F.expr("CASE c_custkey % 6 WHEN 0 THEN c_acctbal * 1e9 + 1e12 WHEN 1 THEN c_acctbal * 1e6 + 1e9 WHEN 2 THEN c_acctbal * 1e3 + 1.0003e6D "
               "WHEN 3 THEN abs(c_acctbal) + 1000.3D WHEN 4 THEN CAST(c_nationkey AS DOUBLE) END")
    return table(spark, sf, "customer").select("c_custkey", T.fmt_large(v).alias("txt"))


@query("percent_in_range", """WITH r AS (SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1)
SELECT c_custkey, CASE WHEN hi > lo THEN round(least(greatest((c_acctbal * 1.1 - lo) / (hi - lo) * 100, 0), 100), 4) ELSE 0 END AS pct FROM customer JOIN r USING (c_nationkey)""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    r = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    pct = T.percent_in_range(F.col("lo"), F.col("hi"), F.col("c_acctbal") * 1.1)
    return c.join(r, "c_nationkey").select("c_custkey", rnd(pct, 4).alias("pct"))


@query("clamp", "SELECT c_custkey, least(greatest(c_acctbal, 0), 100) AS pct, least(greatest(c_acctbal / 1000, 0), 1) AS unit FROM customer")
def _(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", T.clamp_pct(b).alias("pct"), T.clamp01(b / 1000).alias("unit"))


# --- sources and valuation ----------------------------------------------------------------------

@query("fallback_source", """WITH s AS (SELECT l_suppkey AS symbol, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority, l_orderkey, l_linenumber, l_quantity FROM lineitem
 WHERE NOT (l_returnflag = 'R' AND l_suppkey % 3 = 0) AND NOT (l_returnflag = 'A' AND l_suppkey % 2 = 0))
SELECT CAST(symbol AS VARCHAR) AS symbol, priority, count(*) AS n, sum(l_quantity) AS volume FROM s QUALIFY priority = min(priority) OVER (PARTITION BY symbol) GROUP BY ALL""".replace(
    "SELECT CAST(symbol AS VARCHAR) AS symbol, priority, count(*) AS n, sum(l_quantity) AS volume FROM s QUALIFY priority = min(priority) OVER (PARTITION BY symbol) GROUP BY ALL",
    "SELECT CAST(symbol AS VARCHAR) AS symbol, priority, count(*) AS n, sum(l_quantity) AS volume FROM s JOIN (SELECT symbol, min(priority) AS priority FROM s GROUP BY 1) USING (symbol, priority) GROUP BY ALL"))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    flag, k = F.col("l_returnflag"), F.col("l_suppkey")
    rows = li.select(k.cast("string").alias("symbol"),
                     F.when(flag == "R", 1).when(flag == "A", 2).otherwise(3).alias("priority"), "l_quantity",
                     ((flag == "R") & (k % 3 == 0)).alias("gone1"), ((flag == "A") & (k % 2 == 0)).alias("gone2"))
    best = U.fallback_source(rows.where("NOT gone1 AND NOT gone2"))
    return best.groupBy("symbol", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("volume"))


@query("merge_missing_info", """SELECT CAST(p_partkey AS VARCHAR) AS symbol, round(p_retailprice * p_size, 4) AS market_cap,
 p_size::DOUBLE AS trailing_pe, round(p_retailprice / 10, 4) AS trailing_eps, round(CASE WHEN p_partkey % 7 = 0 THEN p_retailprice / 200 ELSE p_retailprice / 100 END, 4) AS dividend_rate
FROM part WHERE p_partkey % 10 <> 9 UNION ALL SELECT CAST(p_partkey AS VARCHAR), round(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE p_retailprice END, 4), p_size::DOUBLE,
 round(p_retailprice / 10, 4), round(CASE WHEN p_partkey % 7 = 0 THEN p_retailprice / 200 ELSE p_retailprice / 100 END, 4) FROM part WHERE p_partkey % 10 = 9""")
def _(spark, sf):
    fields = ["market_cap", "trailing_pe", "trailing_eps", "dividend_rate"]
    a = P.quote_json_to_fundamentals(_quotes(spark, sf)).select("symbol", F.lit(1).alias("priority"), *fields)
    b = P.quote_summary_to_fundamentals(_summaries(spark, sf)).select("symbol", F.lit(2).alias("priority"), *fields)
    m = U.merge_missing_info(a.unionByName(b), fields)
    return m.select("symbol", *[rnd(f, 4).alias(f) for f in fields])


def _valuation_inputs(spark, sf):
    p = table(spark, sf, "part")
    return p.selectExpr(
        "CAST(p_partkey AS STRING) AS symbol", "p_retailprice AS current_price",
        "CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 1e6D END AS market_cap",
        "CASE WHEN p_partkey % 3 <> 0 THEN 1000D * p_size END AS shares_outstanding",
        "CASE WHEN p_partkey % 4 = 0 THEN p_size / 10D END AS trailing_eps",
        "CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2000D - 30000D END AS net_income",
        "CAST(NULL AS DOUBLE) AS eps_forward", "CASE WHEN p_partkey % 6 = 0 THEN 0.1D END AS earnings_growth",
        "CASE WHEN p_partkey % 7 = 0 THEN -5D END AS trailing_pe", "CAST(NULL AS DOUBLE) AS forward_pe",
        "CASE WHEN p_partkey % 8 = 0 THEN 2D END AS dividend_rate", "CASE WHEN p_partkey % 9 <> 0 THEN 1.5D END AS dividends_1y",
        "CAST(NULL AS DOUBLE) AS dividend_yield", "CAST(NULL AS DOUBLE) AS price_to_book", "CAST(NULL AS DOUBLE) AS book_value",
        "p_size * 5000D AS total_equity", "CAST(NULL AS DOUBLE) AS price_to_sales",
        "CASE WHEN p_partkey % 11 <> 0 THEN p_size * 9000D END AS total_revenue")


_VAL_SQL = """i AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 1e6 END AS mc,
 CASE WHEN p_partkey % 3 <> 0 THEN 1000.0::DOUBLE * p_size END AS sh, CASE WHEN p_partkey % 4 = 0 THEN p_size / 10.0::DOUBLE END AS te,
 CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2000.0::DOUBLE - 30000 END AS ni, CASE WHEN p_partkey % 6 = 0 THEN 0.1::DOUBLE END AS gr,
 CASE WHEN p_partkey % 7 = 0 THEN -5.0::DOUBLE END AS tpe, CASE WHEN p_partkey % 8 = 0 THEN 2.0::DOUBLE WHEN p_partkey % 9 <> 0 THEN 1.5::DOUBLE END AS dividend,
 p_size * 5000.0::DOUBLE AS eq, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 9000.0::DOUBLE END AS rev FROM part),
 v1 AS (SELECT *, coalesce(mc, sh * price) AS market_cap, coalesce(te, nullif(ni, 0) / sh) AS eps FROM i),
 v2 AS (SELECT *, coalesce(eps * (1 + gr), eps) AS eps_forward FROM v1),
 v3 AS (SELECT *, coalesce(tpe, CASE WHEN eps > 0 THEN round(price / eps, 2) END, CASE WHEN eps_forward > 0 THEN round(price / eps_forward, 2) END) AS pe0 FROM v2),
 val AS (SELECT symbol, price AS current_price, market_cap, eps, eps_forward, CASE WHEN pe0 > 0 THEN pe0 END AS pe_ratio, CASE WHEN eps_forward > 0 THEN nullif(round(price / eps_forward, 2), 0) END AS forward_pe,
 dividend, dividend / price AS dividend_yield, round(price / (eq / sh), 2) AS price_to_book, coalesce(round(market_cap / rev, 2), round(price / (rev / sh), 2)) AS price_to_sales FROM v3)"""


@query("derive_valuation", f"""WITH {_VAL_SQL} SELECT symbol, market_cap, round(eps, 6) AS eps, round(eps_forward, 6) AS eps_forward, pe_ratio, forward_pe, dividend,
 round(dividend_yield, 6) AS dividend_yield, price_to_book, price_to_sales FROM val""")
def _(spark, sf):
    v = U.derive_valuation(_valuation_inputs(spark, sf))
    return v.select("symbol", "market_cap", rnd("eps", 6).alias("eps"), rnd("eps_forward", 6).alias("eps_forward"), "pe_ratio",
                    "forward_pe", "dividend", rnd("dividend_yield", 6).alias("dividend_yield"), "price_to_book", "price_to_sales")


@query("valuation_trailing", """WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price,
 CASE WHEN p_partkey % 8 = 0 THEN 2.0::DOUBLE WHEN p_partkey % 4 = 0 THEN 3.0::DOUBLE WHEN p_partkey % 9 <> 0 THEN 1.5::DOUBLE END AS dividend FROM part)
SELECT symbol, dividend, round(dividend / price, 6) AS dividend_yield FROM d""")
def _(spark, sf):
    trailing = F.when(F.col("symbol").cast("int") % 4 == 0, F.lit(3.0))
    v = U.derive_valuation(_valuation_inputs(spark, sf).withColumn("trailing_annual_dividend_rate", trailing))
    return v.select("symbol", "dividend", rnd("dividend_yield", 6).alias("dividend_yield"))


@query("quote_volumes", f"""WITH {SUPPLIER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn, ts >= {AS_OF_SQL} - INTERVAL 12 MONTH AS y FROM bars),
 o AS (SELECT symbol, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) AS k, avg(volume) FILTER (rn <= 30) AS av, max(volume) FILTER (rn = 1) AS v, min(low) FILTER (y) AS lo, max(high) FILTER (y) AS hi FROM r GROUP BY 1)
SELECT symbol, round(CASE WHEN k % 3 = 0 THEN 7 WHEN k % 2 = 0 THEN 11 WHEN k % 5 = 0 THEN 13 ELSE av END, 4) AS avg_volume, round(CASE WHEN k % 4 = 0 THEN 9 WHEN k % 3 = 1 THEN 17 ELSE v END, 4) AS volume,
 round(CASE WHEN k % 5 = 0 THEN 0.5 ELSE lo END, 4) AS low_52w, round(CASE WHEN k % 7 = 0 THEN 0.75 ELSE hi END, 4) AS high_52w FROM o""")
def _(spark, sf):
    bars = supplier_bars(spark, sf)
    known = bars.select("symbol").distinct().withColumn("k", F.regexp_extract("symbol", "[0-9]+", 0).cast("int"))

    def some(every, rest, value):
        return F.when(F.col("k") % every == rest, F.lit(value))

    info = known.select("symbol", some(3, 0, 7.0).alias("average_volume"), some(4, 0, 9.0).alias("volume"), some(5, 0, 0.5).alias("low_52w"),
                        F.lit(None).cast("double").alias("high_52w"))
    fast = known.select("symbol", some(2, 0, 11.0).alias("three_month_volume"), some(5, 0, 13.0).alias("ten_day_volume"), some(3, 1, 17.0).alias("volume"),
                        some(5, 0, 0.25).alias("low_52w"), some(7, 0, 0.75).alias("high_52w"))
    q = U.quote_volumes(info, fast, bars, AS_OF)
    return q.select("symbol", *[rnd(c, 4).alias(c) for c in ("avg_volume", "volume", "low_52w", "high_52w")])


@query("overview_fallbacks", f"""WITH {_VAL_SQL} SELECT symbol, market_cap, round(coalesce(pe_ratio, current_price / nullif(eps, 0), forward_pe), 4) AS pe_ratio,
 round(coalesce(eps, current_price / nullif(pe_ratio, 0)), 4) AS eps, round(coalesce(dividend, dividend_yield * current_price), 4) AS dividend,
 round(coalesce(forward_pe, pe_ratio, current_price / nullif(eps, 0)), 4) AS forward_pe, round(coalesce(dividend_yield, dividend / current_price), 6) AS dividend_yield,
 round(coalesce(eps_forward, eps, current_price / nullif(pe_ratio, 0)), 4) AS eps_forward FROM val""")
def _(spark, sf):
    o = U.overview_fallbacks(U.derive_valuation(_valuation_inputs(spark, sf)))
    return o.select("symbol", "market_cap", *[rnd(c, 6 if c == "dividend_yield" else 4).alias(c) for c in
                                              ("pe_ratio", "eps", "dividend", "forward_pe", "dividend_yield", "eps_forward")])


@query("news_join_fallback", """WITH w AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN '7' || upper(event_type) || '.MI' ELSE upper(event_type) END AS ticker, upper(event_type) AS base FROM events)
SELECT ticker, base AS source_ticker, least(count(*), 100) AS n FROM w JOIN events ON upper(event_type) = base GROUP BY 1, 2""")
def _(spark, sf):
    e = table(spark, sf, "events")
    kind = F.upper("event_type")
    wanted = e.select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("7"), kind, F.lit(".MI"))).otherwise(kind).alias("ticker")).distinct()
    found = U.news_with_fallback(wanted, _news(spark, sf).withColumn("symbol", F.upper("symbol")))
    return found.groupBy("ticker", "source_ticker").agg(F.count(F.lit(1)).alias("n"))


@query("json_number", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("symbol"), F.col("props").alias("payload"))
    return P.pick_fields(e, {"k": ("k",)}).select(F.col("symbol").cast("bigint").alias("event_id"), "k")


@query("tick_bars", """SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 4 HOUR, ts), '%Y-%m-%d %H:%M') AS at, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2""")
def _(spark, sf):
    b = B.bars_from_trades(ticks(spark, sf), F.window("ts", "4 hours")["start"])
    return b.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), "open", "high", "low", "close", "volume")
