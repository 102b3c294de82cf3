import numpy as np
import pytest

from tickforge.operators import correlation as C
from tickforge.operators import sparse_correlation as S
from tickforge.sources.stored import stored


def covariance(p, seed, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6 * p, p)) @ (np.eye(p) + 0.4 * rng.normal(size=(p, p)))
    if scale:
        x *= 10.0 ** rng.uniform(-2, 3, p)
    return np.cov(x.T, bias=True)


@pytest.mark.parametrize("p", [2, 3, 8, 25])
@pytest.mark.parametrize("share", [0.9, 0.3, 0.05, 0.005])
def test_conditions_of_the_optimum(p, share):
    """Where T is not zero, W - S is the penalty with T's sign; elsewhere it is within the penalty; the diagonals agree."""
    cov = covariance(p, p)
    d = np.sqrt(np.diag(cov))
    cov = cov / np.outer(d, d)
    alpha = share * np.abs(cov - np.eye(p)).max()
    t = S.sparse_precision(cov, alpha, gap=1e-9, sweeps=2000)
    w = np.linalg.inv(t)
    off = ~np.eye(p, dtype=bool)
    assert np.allclose(np.diag(w), np.diag(cov), atol=1e-6)
    active = off & (t != 0)
    assert np.allclose((w - cov)[active], alpha * np.sign(t[active]), atol=1e-6)
    assert np.all(np.abs(w - cov)[off & (t == 0)] <= alpha + 1e-6)
    assert np.allclose(t, t.T) and np.linalg.eigvalsh(t).min() > 0


def test_limits():
    cov = covariance(6, 1, scale=True)
    top = np.abs(cov - np.diag(np.diag(cov))).max()
    assert np.allclose(S.sparse_precision(cov, top), np.diag(1 / np.diag(cov)))  # the largest penalty leaves no link
    assert np.allclose(S.sparse_precision(cov, 0.0, gap=1e-12, sweeps=5000), np.linalg.inv(cov), rtol=1e-3, atol=1e-6 / np.diag(cov).min())
    assert np.allclose(S.sparse_precision(1e6 * cov, 1e6 * top / 3), 1e-6 * S.sparse_precision(cov, top / 3))
    constant = np.diag([2.0, 0.0, 1.0])
    constant[0, 2] = constant[2, 0] = 0.5
    t = S.sparse_precision(constant, 0.1)
    assert t[1, 0] == t[1, 2] == 0 and np.isfinite(t).all() and t[0, 2] < 0
    assert S.sparse_precision(np.zeros((3, 3)), 0.1) is None and S.sparse_precision(np.full((2, 2), np.nan), 0.1) is None


def test_next_candidates():
    def around(scores, alphas=(1.0, 0.1, 0.01)):
        return [round(float(np.log10(x)), 6) for x in S.next_candidates(alphas, scores)]

    assert around([1, 3, 2]) == [-0.4, -0.8, -1.2, -1.6]  # between both neighbours of the best
    assert around([3, 2, 1]) == [-0.2, -0.4, -0.6, -0.8]
    assert around([1, 2, 3]) == [-2.4, -2.8, -3.2, -3.6]  # on from the small end
    assert around([1, 2, -np.inf]) == [-1.2, -1.4, -1.6, -1.8]  # the next one fails: between the best and it
    assert around([2, 3, 3]) == [-2.4, -2.8, -3.2, -3.6]
    assert S.best_alpha([1.0, 0.1, 0.01], [1, 3, 3]) == 0.01


def plain_search(x):
    """The same search with whole rows: numpy's covariances, a loop over folds and rounds."""
    n, p = x.shape
    folds = [np.flatnonzero(np.arange(n) * 5 // n == f) for f in range(5)]
    top = np.cov(x.T, bias=True)
    top = np.abs(top - np.diag(np.diag(top))).max()
    todo, alphas, scores = np.logspace(0, -2, 4) * top, [], []
    for _ in range(4):
        for a in todo:
            alphas.append(a)
            scores.append(np.mean([S.held_out(S.sparse_precision(np.cov(np.delete(x, f, 0).T, bias=True), a), np.cov(x[f].T, bias=True)) for f in folds]))
        todo = S.next_candidates(alphas, scores)
    return S.best_alpha(alphas, scores)


def test_grid_job_equals_the_plain_search(spark):
    names = ["v0", "v1", "v2", "v3", "v4"]
    rows, wanted = [], {}
    for symbol, n, seed in (("A", 103, 1), ("B", 260, 2), ("C", 60, 3)):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(n, 5)) @ (np.eye(5) + rng.normal(size=(5, 5)) * (rng.random((5, 5)) < 0.3)) * [1, 10, 0.1, 3, 1] + [5, 0, 1000, 0, 0]
        rows += [(symbol, t, *map(float, r)) for t, r in enumerate(x)]
        alpha = plain_search(x)
        t = S.sparse_precision(np.cov(x.T, bias=True), alpha)
        d = 1 / np.sqrt(np.diag(t))
        wanted[symbol] = alpha, np.where(np.eye(5, dtype=bool), 1, -t * np.outer(d, d)), np.corrcoef(x.T)
    frame = spark.createDataFrame(rows + [("D", t, 1.0, 2.0, 3.0, 4.0, 5.0) for t in range(60)], "symbol string, ts long, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    got = stored(S.sparse_matrices(frame, names), "test")
    for symbol, (alpha, partial, normal) in wanted.items():
        mine = {(r.i, r.j): r for r in got.where(f"symbol = '{symbol}'").collect()}
        assert len(mine) == 25
        for (i, j), r in mine.items():
            assert r.alpha == pytest.approx(alpha, rel=1e-6)
            assert r.partial == pytest.approx(partial[i, j], abs=1e-4) and r.normal == pytest.approx(normal[i, j], abs=1e-9)
    assert got.where("symbol = 'D'").count() == 0  # nothing varies
    pairs = C.partial_corr_table(got).collect()
    assert pairs and all(r.partial != 0 and r.var1 < r.var2 for r in pairs)
    fixed = S.sparse_matrices(frame.where("symbol = 'A'"), names, alpha=0.3).first()
    assert fixed.alpha == 0.3
    assert S.sparse_matrices(frame.limit(0), names).count() == 0
