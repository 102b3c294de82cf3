"""Correlation (survey 2.4 #67-70)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions.scalars import rnd
from tickforge.operators import correlation as C
from tickforge.operators import indicators as I
from tickforge.operators import sparse_correlation as L
from tickforge.plans.data import AS_OF, FLAG_SQL, flag_bars
from tickforge.plans.indicator_queries import _series_sql
from tickforge.plans.registry import query

_FEATURES = f"""{_series_sql(FLAG_SQL)}, f0 AS (SELECT symbol, ts, {', '.join(I.FEATURES)} FROM s5
 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in I.FEATURES)}),
 f AS (SELECT * FROM f0 QUALIFY count(*) OVER (PARTITION BY symbol) >= 50)"""
_PAIRS = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'v': corr({a}, {b})}}"
                   for i, a in enumerate(I.FEATURES) for b in I.FEATURES[i + 1:])


def features(spark, sf):
    return I.feature_frame(flag_bars(spark, sf), as_of=AS_OF)


@query("normal_corr", f"""WITH {_FEATURES}, c AS (SELECT symbol, unnest([{_PAIRS}]) AS x FROM f GROUP BY symbol)
SELECT symbol, x.a AS var1, x.b AS var2, round(x.v, 5) AS normal FROM c""")
def _(spark, sf):
    m = C.correlation_matrices(features(spark, sf), alpha=0.1)
    return m.where("i < j").select("symbol", "var1", "var2", rnd("normal", 5).alias("normal"))


def _closed(a, b, c):
    return (f"(corr({a}, {b}) - corr({a}, {c}) * corr({b}, {c})) / "
            f"sqrt((1 - corr({a}, {c}) ^ 2) * (1 - corr({b}, {c}) ^ 2))")


# With three variables and no penalty the partial correlation has a closed form.
_THREE = ("rsi14", "roc12", "cmf20")


@query("partial_corr_closed_form", f"""WITH {_FEATURES} SELECT symbol, unnest(['rsi14', 'rsi14', 'roc12']) AS var1, unnest(['roc12', 'cmf20', 'cmf20']) AS var2,
 unnest([round({_closed(*_THREE)}, 5), round({_closed('rsi14', 'cmf20', 'roc12')}, 5), round({_closed('roc12', 'cmf20', 'rsi14')}, 5)]) AS partial FROM f GROUP BY symbol""")
def _(spark, sf):
    m = C.correlation_matrices(features(spark, sf), _THREE, alpha=0.0)
    return m.where("i < j").select("symbol", "var1", "var2", rnd("partial", 5).alias("partial"))


# A fixed ridge on the diagonal: the inverse by sweeping one variable after the other, -A^-1 after the last.
_RIDGE = 0.1
_N = len(I.FEATURES)
_CELLS = ", ".join("[" + ", ".join(f"{1 + _RIDGE}::DOUBLE" if a == b else f"coalesce(nullif(corr({min(a, b)}, {max(a, b)}), 'nan'::DOUBLE), 0)" for b in I.FEATURES) + "]"
                   for a in I.FEATURES)
_NAMES = "[" + ", ".join(f"'{x}'" for x in I.FEATURES) + "]"
_INVERSE = f"""{_FEATURES}, sweep AS (SELECT symbol, 1 AS k, [{_CELLS}] AS m FROM f GROUP BY symbol
 UNION ALL SELECT symbol, k + 1, list_transform(m, lambda row, i: list_transform(row, lambda x, j: CASE WHEN i = k AND j = k THEN -1 / x
  WHEN i = k OR j = k THEN x / m[k][k] ELSE x - row[k] * m[k][j] / m[k][k] END)) FROM sweep WHERE k <= {_N}),
 inv AS (SELECT symbol, m FROM sweep WHERE k = {_N + 1}),
 p AS (SELECT symbol, i.i, j.j, {_NAMES}[i.i] AS var1, {_NAMES}[j.j] AS var2, CASE WHEN i.i = j.j THEN 1 ELSE m[i.i][j.j] / sqrt(m[i.i][i.i] * m[j.j][j.j]) END AS v
  FROM inv, range(1, {_N + 1}) i(i), range(1, {_N + 1}) j(j))"""


def _ridge(spark, sf):
    return C.correlation_matrices(features(spark, sf), alpha=_RIDGE)


@query("partial_corr", f"""WITH RECURSIVE {_INVERSE} SELECT symbol, var1, var2, round(v, 5) + 0.0 AS partial FROM p""")
def _(spark, sf):
    return _ridge(spark, sf).select("symbol", "var1", "var2", (rnd("partial", 5) + 0.0).alias("partial"))


@query("partial_corr_table", f"""WITH RECURSIVE {_INVERSE} SELECT symbol, var1, var2, round(v, 3) AS partial FROM p WHERE i < j AND round(v, 3) <> 0""")
def _(spark, sf):
    return C.partial_corr_table(_ridge(spark, sf))


@query("max_partial_corr", f"""WITH RECURSIVE {_INVERSE} SELECT symbol, var1, var2, round(v, 3) + 0.0 AS value FROM p WHERE i <> j
QUALIFY row_number() OVER (PARTITION BY symbol, var1 ORDER BY abs(v) DESC, j) = 1""")
def _(spark, sf):
    best = C.max_partial_corr(_ridge(spark, sf))
    return best.withColumn("value", F.col("value") + 0.0)


# The penalty searched by held-out likelihood: of a ridge, and of the L1 fit that the service uses. Iterative, so without twins.
@query("partial_corr_ridge_search")
def _(spark, sf):
    return C.correlation_matrices(features(spark, sf))


@query("partial_corr_l1")
def _(spark, sf):
    return L.sparse_matrices(features(spark, sf))


@query("partial_corr_table_l1")
def _(spark, sf):
    return C.partial_corr_table(L.sparse_matrices(features(spark, sf)))


@query("max_partial_corr_l1")
def _(spark, sf):
    return C.max_partial_corr(L.sparse_matrices(features(spark, sf)))
