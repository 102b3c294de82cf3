"""Partial correlation from an L1-penalised precision matrix, penalty chosen by cross-validation.

The rows of all symbols are reduced to one covariance per (symbol, fold) (``correlation.moments``). Every candidate penalty of
every fold of every symbol is then a row of its own with two small matrices, so the fits are dealt to all tasks as a
grid of (symbol, fold, alpha). A search round scores the grid, and the next round's candidates follow from all scores
so far; rounds are written tables, and what a symbol carries from one to the next is its few scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.operators.correlation import FOLDS, _combine, _to_correlation, moments, with_folds
from tickforge.operators.indicators import FEATURES
from tickforge.sources.stored import stored

# Candidates a round, rounds, ratio of the smallest to the largest first candidate, gap at which a fit ends, sweeps.
CANDIDATES, ROUNDS, SPREAD, GAP, SWEEPS = 4, 4, 1e-2, 1e-4, 100
_GRID = "symbol string, fold int, train array<double>, test array<double>, alpha double"


def sparse_precision(cov: np.ndarray, alpha: float, gap: float = GAP, sweeps: int = SWEEPS) -> np.ndarray | None:
    """Minimiser of ``tr(cov T) - logdet T + alpha * sum of |T| off the diagonal``; None if the numbers overflow.

    Block coordinate descent: the column of the covariance W = 1/T that belongs to a variable solves a lasso over
    the others, itself by coordinate descent from its last solution. Ends when the duality gap is below ``gap``.
    Variables whose covariances all lie within ``alpha`` stay alone from the start; a constant variable does too."""
    p = len(cov)
    unit = np.max(np.diag(cov), initial=0.0)
    if not np.isfinite(cov).all() or unit <= 0:
        return None
    s, a = cov / unit, alpha / unit
    variance = np.diag(s).copy()
    variance[variance <= 0] = 1.0
    linked = np.abs(s - np.diag(np.diag(s))) > a
    active = np.flatnonzero(linked.any(axis=0))
    precision = np.diag(1 / variance)
    if len(active):
        sub = s[np.ix_(active, active)]
        w = 0.95 * sub
        np.fill_diagonal(w, np.diag(sub))
        m = len(active)
        others = [np.delete(np.arange(m), j) for j in range(m)]
        betas, theta = np.zeros((m, m - 1)), np.zeros((m, m))
        fine = min(GAP, gap) * 1e-2
        for _ in range(sweeps):
            for j, rest in enumerate(others):
                v, target, beta = w[np.ix_(rest, rest)], sub[rest, j], betas[j]
                _lasso(v, target, a, beta, fine)
                w[rest, j] = w[j, rest] = v @ beta
                left = sub[j, j] - w[rest, j] @ beta
                if not left > 0:
                    return None
                theta[j, j] = 1 / left
                theta[rest, j] = theta[j, rest] = -beta / left
            distance = np.sum(sub * theta) - m + a * (np.abs(theta).sum() - np.abs(np.diag(theta)).sum())
            if not np.isfinite(distance):
                return None
            if abs(distance) < gap:
                break
        precision[np.ix_(active, active)] = theta
    return precision / unit


def _lasso(v: np.ndarray, target: np.ndarray, alpha: float, beta: np.ndarray, tol: float, sweeps: int = 100) -> None:
    """Change ``beta`` into the minimiser of ``b'vb / 2 - target'b + alpha * |b|``, coordinate by coordinate."""
    slope = target - v @ beta
    diagonal, columns = np.diag(v).tolist(), list(v.T)
    for _ in range(sweeps):
        most = 0.0
        for i, d in enumerate(diagonal):
            old = beta[i]
            z = slope[i] + d * old
            new = (z - alpha if z > alpha else z + alpha if z < -alpha else 0.0) / d
            if new != old:
                slope -= (new - old) * columns[i]
                beta[i] = new
                most = max(most, abs(new - old) * d)
        if most <= tol:
            return


def held_out(precision: np.ndarray | None, test: np.ndarray) -> float:
    """Gaussian log-likelihood a row, up to a constant, of rows with covariance ``test``."""
    if precision is None:
        return -np.inf
    sign, logdet = np.linalg.slogdet(precision)
    value = (logdet - np.sum(test * precision)) / 2
    return float(value) if sign > 0 and np.isfinite(value) else -np.inf


def next_candidates(alphas: Sequence[float], scores: Sequence[float], count: int = CANDIDATES) -> list[float]:
    """Candidates around the best score so far, evenly spaced in the exponent: between its neighbours, or on from the end where
    the best one lies. Of equal scores the smallest alpha counts."""
    order = np.argsort(alphas)[::-1]
    a, v = np.asarray(alphas, float)[order], np.asarray(scores, float)[order]
    finite = np.flatnonzero(np.isfinite(v))
    best = finite[len(finite) - 1 - np.argmax(v[finite][::-1])] if len(finite) else 0
    high = a[0] if best == 0 else a[best] if len(finite) and best == finite[-1] else a[best - 1]
    low = a[best + 1] if best + 1 < len(a) else a[best] * SPREAD
    return np.logspace(np.log10(high), np.log10(low), count + 2)[1:-1].tolist()


def best_alpha(alphas: Sequence[float], scores: Sequence[float]) -> float:
    return max(zip(scores, (-x for x in alphas)))[1] * -1.0


def fold_covariances(features: DataFrame, names: list[str], folds: int = FOLDS) -> DataFrame:
    """``(symbol, fold, train, test)``, flat covariances of the rows outside and inside a fold, each around its own
    mean; fold -1 has the correlation matrix in ``test`` and the covariance of all rows in ``train``."""
    k = len(names)

    def pooled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts: dict[int, list] = {}
        for fold, n, mean, m in zip(pdf["fold"], pdf["n"], pdf["mean"], pdf["m"]):
            parts.setdefault(int(fold), []).append((n, np.asarray(mean), np.asarray(m).reshape(k, k)))
        by_fold = {f: _combine(v) for f, v in sorted(parts.items())}
        n, _, m = _combine(list(by_fold.values()))
        rows = [(key[0], -1, (m / n).ravel().tolist(), _to_correlation(m).ravel().tolist())]
        for f, (tn, _, tm) in by_fold.items():
            rest = [v for g, v in by_fold.items() if g != f]
            if rest:
                rn, _, rm = _combine(rest)
                rows.append((key[0], f, (rm / rn).ravel().tolist(), (tm / tn).ravel().tolist()))
        return pd.DataFrame(rows, columns=["symbol", "fold", "train", "test"])

    parts = moments(with_folds(features, folds), names)
    return parts.groupBy("symbol").applyInPandas(pooled, "symbol string, fold int, train array<double>, test array<double>")


def _first_candidates(covariances: DataFrame, k: int) -> DataFrame:
    """From the largest covariance off the diagonal, which leaves no link, down to a hundredth of it."""
    place = F.transform("train", lambda x, i: F.when(i % (k + 1) != 0, F.abs(x)))
    top = covariances.where("fold = -1").select("symbol", F.array_max(place).alias("top")).where("top > 0")
    steps = np.logspace(0, np.log10(SPREAD), CANDIDATES).tolist()
    return top.select("symbol", F.explode(F.transform(F.array(*map(F.lit, steps)), lambda x: x * F.col("top"))).alias("alpha"))


def searched(covariances: DataFrame, k: int) -> DataFrame:
    """``(symbol, alpha)``: the penalty with the best mean held-out likelihood."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [held_out(sparse_precision(np.reshape(train, (k, k)), alpha), np.reshape(test, (k, k)))
                      for train, test, alpha in zip(pdf["train"], pdf["test"], pdf["alpha"])]
            yield pdf[["symbol", "alpha"]].assign(score=values)

    def refined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": key[0], "alpha": next_candidates(pdf["alpha"], pdf["score"])})

    def chosen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [key[0]], "alpha": [best_alpha(pdf["alpha"], pdf["score"])]})

    folds, scores = covariances.where("fold >= 0"), None
    candidates = _first_candidates(covariances, k)
    for round_ in range(ROUNDS):
        grid = folds.join(candidates, "symbol").select("symbol", "fold", "train", "test", "alpha").repartition("symbol", "fold", "alpha")
        mean = grid.mapInPandas(score, "symbol string, alpha double, score double").groupBy("symbol", "alpha").agg(F.avg("score").alias("score"))
        scores = stored(mean if scores is None else scores.union(mean), "scores")
        if round_ + 1 < ROUNDS:
            candidates = scores.groupBy("symbol").applyInPandas(refined, "symbol string, alpha double")
    return scores.groupBy("symbol").applyInPandas(chosen, "symbol string, alpha double")


def sparse_matrices(features: DataFrame, variables: Sequence[str] = FEATURES, alpha: float | None = None, folds: int = FOLDS) -> DataFrame:
    """Long form ``(symbol, i, j, var1, var2, normal, partial, alpha)`` like ``correlation_matrices``, from the L1 fit.

    The fit is on the covariance as it is, so the penalty weighs on variables of small scale more than on others. Without ``alpha``
    it is searched per symbol. Symbols without any covariance have no row."""
    names = list(variables)
    k = len(names)
    covariances = stored(fold_covariances(features, names, folds), "covariances")
    whole = covariances.where("fold = -1").select("symbol", F.col("train").alias("cov"), F.col("test").alias("cor"))
    picked = whole.join(searched(covariances, k), "symbol") if alpha is None else whole.withColumn("alpha", F.lit(float(alpha)))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = np.indices((k, k))
        for pdf in batches:
            for symbol, cov, cor, a in zip(pdf["symbol"], pdf["cov"], pdf["cor"], pdf["alpha"]):
                precision = sparse_precision(np.reshape(cov, (k, k)), a)
                if precision is None:
                    continue
                d = 1 / np.sqrt(np.diag(precision))
                partial = -precision * np.outer(d, d)
                np.fill_diagonal(partial, 1.0)
                normal = np.asarray(cor, float)
                yield pd.DataFrame({"symbol": symbol, "i": i.ravel(), "j": j.ravel(), "var1": [names[x] for x in i.ravel()], "var2": [names[x] for x in j.ravel()],
                                    "normal": np.where(np.isfinite(normal), normal, None), "partial": partial.ravel() + 0.0, "alpha": a})

    return picked.repartition("symbol").mapInPandas(fitted, "symbol string, i int, j int, var1 string, var2 string, normal double, partial double, alpha double")
