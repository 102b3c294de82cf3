import numpy as np

from tickforge.llm import vector_search as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(x, ids, k, every):
    out = {}
    for j, i in enumerate(ids):
        if i % every == 0:
            s = (x * x[j]).sum(1)
            order = [o for o in np.lexsort((ids, -s)) if o != j][:k]
            out[i] = [(int(ids[o]), s[o]) for o in order]
    return out


def rows_of(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x)], SCHEMA)


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 300)
    monkeypatch.setattr(V, "ASK", 8)
    monkeypatch.setattr(V, "SAMPLE_ROWS", 500)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(3000, 40)) * rng.uniform(0.5, 2, (3000, 1))).astype(np.float32).astype(float)
    x[1000:1400] = x[5]  # a vector with many copies
    ids = np.arange(3000)
    got, want = found(V.nearest(rows_of(spark, x, ids).selectExpr("*", "1 AS cluster", "2 AS code"), 20, 40)), plain(x, ids, 20, 40)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
    for q, rows in got.items():
        assert all(abs(s - (x[i] * x[q]).sum()) < 1e-12 for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [i for i, _ in got[1000]] == [i for i, _ in want[1000]]  # ties go to the smaller ids


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64))
    book = V.learn(x, 2000)
    cluster, codes, length, own = book.encode(x)
    estimate, bound = V.estimates(book, 0, codes, length, own, q)
    true = q @ x.T
    assert (cluster == 0).all() and (np.abs(estimate - true) <= bound).mean() > 0.97
    assert abs((estimate - true).mean()) < 0.1


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (20, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0), (3, None, 0), (40, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0),
            (7, [None, 1.0], 0), (None, [1.0, 1.0], 0), (2, [0.5, 0.5], 1), (60, [1.0, 2.0, 3.0], 0), (8, [], 0)]
    got = found(V.nearest(spark.createDataFrame(rows, SCHEMA)))
    assert got == {0: [(1, 1.0), (2, 0.5), (20, 0.0)], 20: [(2, 0.5), (0, 0.0), (1, 0.0)]}
    assert V.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert V.nearest(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0
