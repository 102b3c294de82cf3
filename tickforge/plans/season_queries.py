"""Seasonality (survey 2.4 #72-82b)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.operators import seasonality as S
from tickforge.plans.data import AS_OF, AS_OF_SQL, SUPPLIER_SQL, supplier_bars
from tickforge.plans.registry import query

MONTH = AS_OF.month

SEASON_SQL = f"""{SUPPLIER_SQL}, mo AS (
 SELECT symbol, last_day(ts) AS m, arg_min(open, ts) AS open, arg_max(close, ts) AS close, count(*) AS days
 FROM bars WHERE ts >= {AS_OF_SQL} - INTERVAL 240 MONTH GROUP BY 1, 2),
 ok AS (SELECT * FROM (SELECT *, sum(days) OVER (PARTITION BY symbol) AS d, count(*) OVER (PARTITION BY symbol) AS nm FROM mo)
  WHERE d >= 120 AND nm >= 6 AND open > 0),
 mr AS (SELECT symbol, m, year(m) AS year, month(m) AS month,
  (close / lag(close) OVER (PARTITION BY symbol ORDER BY m) - 1) * 100 AS ret FROM ok),
 curve AS (SELECT symbol, year, month, round(ret, 2) AS ret FROM
  (SELECT *, count(ret) OVER (PARTITION BY symbol, year) AS v FROM mr)
  WHERE (v >= 6 OR year = 2001) AND ret IS NOT NULL)"""
_MONTHS = "months AS (SELECT DISTINCT symbol, unnest(range(1, 13)) AS month FROM curve)"


def _curve(spark, sf):
    return S.seasonal_curve(S.monthly_returns(supplier_bars(spark, sf), AS_OF), AS_OF)


@query("monthly_returns", f"""WITH {SEASON_SQL} SELECT symbol, year, month, round(ret, 4) AS ret_pct FROM mr""")
def _(spark, sf):
    r = S.monthly_returns(supplier_bars(spark, sf), AS_OF)
    return r.select("symbol", "year", "month", rnd("ret_pct", 4).alias("ret_pct"))


@query("winsorize_returns", f"""WITH {SEASON_SQL}, q AS (SELECT symbol, quantile_cont(ret, 0.05::DOUBLE) AS a, quantile_cont(ret, 0.95::DOUBLE) AS b FROM mr GROUP BY 1)
SELECT symbol, year, month, CASE WHEN ret IS NOT NULL THEN round(least(greatest(ret, a), b), 4) END AS ret_pct FROM mr JOIN q USING (symbol)""")
def _(spark, sf):
    r = S.winsorize_returns(S.monthly_returns(supplier_bars(spark, sf), AS_OF))
    return r.select("symbol", "year", "month", rnd("ret_pct", 4).alias("ret_pct"))


@query("winsorize_array", f"""WITH {SEASON_SQL}, q AS (SELECT symbol, quantile_cont(ret, 0.05::DOUBLE) AS a, quantile_cont(ret, 0.95::DOUBLE) AS b FROM mr GROUP BY 1)
SELECT symbol, count(*) AS n, count(ret) AS n_finite, round(sum(least(greatest(ret, a), b)) FILTER (ret IS NOT NULL), 2) AS total
FROM mr JOIN q USING (symbol) GROUP BY 1""")
def _(spark, sf):
    r = S.monthly_returns(supplier_bars(spark, sf), AS_OF)
    # the missing first return stays in the list as NaN
    nan = F.lit(float("nan"))
    a = r.groupBy("symbol").agg(F.collect_list(F.coalesce("ret_pct", nan)).alias("v"))
    a = a.withColumn("w", S.winsorize_array(F.col("v")))
    finite = F.filter("w", lambda x: ~F.isnan(x))
    return a.select("symbol", F.size("w").alias("n"), F.size(finite).alias("n_finite"),
                    rnd(F.aggregate(finite, F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


@query("seasonal_curve", f"WITH {SEASON_SQL} SELECT symbol, year, month, ret AS ret_pct FROM curve")
def _(spark, sf):
    return _curve(spark, sf)


@query("seasonal_curve_table", f"""WITH {SEASON_SQL} SELECT symbol, year,
 {', '.join(f"max(ret) FILTER (month = {m}) AS m{m}" for m in range(1, 13))} FROM curve GROUP BY 1, 2""")
def _(spark, sf):
    t = S.curve_table(_curve(spark, sf))
    return t.select("symbol", "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


_CUM = """cum AS (SELECT symbol, year, month, ret, round(list_reduce(list_transform(l, lambda v: v),
  lambda a, v: (1 + a) * (1 + v / 100.0::DOUBLE) - 1, 0.0::DOUBLE) * 100, 2) AS cum_pct FROM
 (SELECT *, list(ret) OVER (PARTITION BY symbol, year ORDER BY month ROWS UNBOUNDED PRECEDING) AS l FROM curve))"""


@query("cumulative_curve", f"WITH {SEASON_SQL}, {_CUM} SELECT symbol, year, month, cum_pct FROM cum")
def _(spark, sf):
    return S.cumulative_curve(_curve(spark, sf)).select("symbol", "year", "month", "cum_pct")


def _pct_sql(source, value):
    def el(q):
        return f"coalesce(round(v[1 + CAST(floor({q}::DOUBLE * (len(v) - 1)) AS INTEGER)], 2), 0)"
    return f"""SELECT symbol, month, {el(0.1)} AS p10, {el(0.5)} AS median, {el(0.9)} AS p90
 FROM months LEFT JOIN (SELECT symbol, month, list_sort(list({value})) AS v FROM {source} GROUP BY 1, 2) USING (symbol, month)"""


@query("month_percentiles", f"WITH {SEASON_SQL}, {_MONTHS} {_pct_sql('curve', 'ret')}")
def _(spark, sf):
    return S.month_percentiles(_curve(spark, sf))


@query("cumulative_month_percentiles", f"WITH {SEASON_SQL}, {_CUM}, {_MONTHS} {_pct_sql('cum', 'cum_pct')}")
def _(spark, sf):
    return S.month_percentiles(S.cumulative_curve(_curve(spark, sf)), "cum_pct")


_WINS = """pool AS (SELECT symbol, list_sort(list(ret)) AS p FROM curve GROUP BY 1),
 wins AS (SELECT symbol, year, month, least(greatest(ret, p[1 + CAST(floor(0.05::DOUBLE * (len(p) - 1)) AS INTEGER)]),
  p[1 + CAST(floor(0.95::DOUBLE * (len(p) - 1)) AS INTEGER)]) AS ret FROM curve JOIN pool USING (symbol))"""
_CUMSUM = """adds AS (SELECT symbol, year, month, sum(ret) OVER (PARTITION BY symbol, year ORDER BY month ROWS UNBOUNDED PRECEDING) AS c FROM wins),
 lists AS (SELECT symbol, month, list_sort(list(c)) AS v FROM adds GROUP BY 1, 2)"""
CLIENT_SQL = f"""{SEASON_SQL}, {_WINS}, {_CUMSUM}, {_MONTHS}, cpct AS (SELECT symbol, month,
 {', '.join(f"coalesce(v[1 + CAST(floor({q}::DOUBLE * len(v)) AS INTEGER)], 0) AS {n}" for n, q in S.QUANTILES.items())}
 FROM months LEFT JOIN lists USING (symbol, month))"""


@query("client_winsorize", f"WITH {SEASON_SQL}, {_WINS} SELECT symbol, year, month, ret AS ret_pct FROM wins")
def _(spark, sf):
    return S.client_winsorize(_curve(spark, sf))


def client_percentiles(spark, sf):
    return S.client_cumulative_percentiles(S.client_winsorize(_curve(spark, sf)))


@query("client_cumulative_percentiles", f"WITH {CLIENT_SQL} SELECT symbol, month, round(p10, 2) AS p10, round(median, 2) AS median, round(p90, 2) AS p90 FROM cpct")
def _(spark, sf):
    return client_percentiles(spark, sf).select("symbol", "month", *[rnd(c, 2).alias(c) for c in S.QUANTILES])


@query("seasonality_percentiles", f"""WITH {SEASON_SQL}, q AS (SELECT symbol, quantile_cont(ret, 0.05::DOUBLE) AS a, quantile_cont(ret, 0.95::DOUBLE) AS b FROM mr GROUP BY 1),
 curve2 AS (SELECT symbol, year, month, round(least(greatest(ret, a), b), 2) AS ret FROM
  (SELECT *, count(ret) OVER (PARTITION BY symbol, year) AS v FROM mr JOIN q USING (symbol))
  WHERE (v >= 6 OR year = 2001) AND ret IS NOT NULL), {_MONTHS} {_pct_sql('curve2', 'ret')}""")
def _(spark, sf):
    r = S.winsorize_returns(S.monthly_returns(supplier_bars(spark, sf), AS_OF))
    return S.month_percentiles(S.seasonal_curve(r, AS_OF))


@query("month_stats", f"""WITH {SEASON_SQL} SELECT symbol, round(avg(ret), 4) AS avg_pct,
 round(avg(CASE WHEN ret > 0 THEN 100.0::DOUBLE ELSE 0.0 END), 4) AS win_rate FROM curve
WHERE month = {MONTH} AND year BETWEEN 1996 AND 2000 GROUP BY 1""")
def _(spark, sf):
    c = S.year_range_select(_curve(spark, sf), 1996, 2000)
    return S.month_stats(c, MONTH).select("symbol", rnd("avg_pct", 4).alias("avg_pct"),
                                          rnd("win_rate", 4).alias("win_rate"))


@query("year_range_select", f"""WITH {SEASON_SQL} SELECT symbol, year, month, ret AS ret_pct FROM curve WHERE year BETWEEN 1997 AND 1999""")
def _(spark, sf):
    return S.year_range_select(_curve(spark, sf), 1997, 1999)


@query("trade_months", f"""WITH {CLIENT_SQL}, b AS (SELECT symbol, arg_min(month, (median, month)) AS buy_month FROM cpct GROUP BY 1)
SELECT symbol, buy_month, arg_max(month, (median, -month)) AS sell_month FROM cpct JOIN b USING (symbol)
WHERE month >= buy_month GROUP BY 1, 2""")
def _(spark, sf):
    return S.trade_months(client_percentiles(spark, sf))


@query("month_pair_percentiles", f"""WITH {CLIENT_SQL} SELECT symbol, month, round(p10, 2) AS p10, round(median, 2) AS median,
 round(p90, 2) AS p90 FROM cpct WHERE month IN ({MONTH}, {MONTH % 12 + 1})""")
def _(spark, sf):
    return S.month_pair_percentiles(client_percentiles(spark, sf), MONTH)
