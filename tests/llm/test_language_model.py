import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.util import LOWER, WORD, clashing, docs, words
from tickforge.llm import language_model as L


def corpus():
    out = {i: " ".join(("the Quick fox runs over a lazy dog " * 3).split()[i % 5:] + words(i % 9, i)) for i in range(60)}
    return out | {100: "", 101: None, 102: "x" * 50, 103: " ".join(words(20_000, 3))}


def test_base_score_is_exact(spark, monkeypatch):
    texts = corpus()
    for hot in (L.HOT, 3):  # with 3 nearly all words take the join
        monkeypatch.setattr(L, "HOT", hot)
        got = L.score_all(clashing(docs(spark, texts))).collect()
        tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t in texts.items()}
        held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
        counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
        n, v = sum(counts.values()), len(counts)
        assert len(got) == len(texts)
        for r in got:
            ws = tokens[r.doc_id]
            base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
            assert r.base_score == pytest.approx(base, abs=1e-6)
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), n, held[r.doc_id])


def test_model_beats_counts_on_held_out_text(spark):
    texts = {i: " ".join((["red green blue", "one two three", "sun moon star"][k % 3] for k in range(i % 7, i % 7 + 30))) for i in range(200)}
    rows = [r for r in L.score_all(docs(spark, texts)).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows) + sum(r.n_tokens for r in rows) * 0.2


def test_probabilities_sum_to_one(spark):
    rows = docs(spark, corpus())
    table = L.count_words(rows)
    counts = L.hot_counts(table)
    model = L.train(rows, counts)
    reader = L.Reader()
    numbers, lengths = reader.read(pd.Series(["the quick fox", ""]))
    context = L.contexts(reader.hashes[numbers], lengths)
    p = L._chances(model.by_class, L._rows(context, None)).astype(float)
    np.testing.assert_allclose(p.sum(1), 1, rtol=1e-5)
    every = sum(p[:, c] * L._chances(model.by_member, L._rows(context, np.full(len(context), c))).sum(1) for c in range(L.CLASSES))
    np.testing.assert_allclose(every + p[:, L.CLASSES], 1, rtol=1e-5)
    # the rest shares the last class: known rare words and one unseen
    top = np.count_nonzero(counts.top)
    rare = sorted((r["count"] for r in table.collect()), reverse=True)[top:]
    assert sum(c + 0.5 for c in rare) + 0.5 == pytest.approx(model.other + 0.5 * (counts.distinct - top + 1))


def test_edges(spark):
    rows = docs(spark, [(1, None), (1, None), (None, "a b")])
    got = sorted(L.score_all(rows).collect(), key=lambda r: r.n_tokens)
    assert [r.n_tokens for r in got] == [1, 1, 3] and all(math.isfinite(r.score) for r in got)
    assert L.score_all(docs(spark, {})).count() == 0
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = L.score_all(docs(spark, {only_held: "a b"})).collect()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_every_feature_learns_from_every_batch(spark):
    rows = docs(spark, {i: "red green blue one two three" for i in range(6)})  # a single batch a round and task
    model = L.train(rows, L.hot_counts(L.count_words(rows)))
    for weights in (model.by_class, model.by_member):
        assert all(weights[k * L.BUCKETS:(k + 1) * L.BUCKETS].any() for k in range(3))


def test_reader_holds_few_texts_as_words():
    texts = pd.Series([" ".join(f"word{k % 50}" for k in range(500))] * 400)
    tracemalloc.start()
    try:
        numbers, lengths = L.Reader().read(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(numbers) == 400 * 501 and set(lengths) == {501} and peak < 7 << 20


def test_sums_of_runs_have_the_bits_of_reduceat():
    rng = np.random.default_rng(5)
    for rows, buckets in ((4096, 2048), (300, 7), (9, 9), (1, 1), (50, 1)):
        g = rng.normal(size=(rows, 33)).astype(np.float32)
        at = rng.integers(0, buckets, rows) ** 2 // buckets
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        want = np.add.reduceat(g[order], first, axis=0) if len(first) > 1 else g.sum(axis=0, keepdims=True)
        assert np.array_equal(L._sums(g, order, first), want)
