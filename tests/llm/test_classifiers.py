import random

import numpy as np
import pytest

from tests.llm.util import clashing, docs, words
from tickforge.llm import quality as Q
from tickforge.llm import toxicity as X
from tickforge.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def fixture(spark, n=500):
    """Good prose, junk of three kinds, and offending words in some sentences."""
    rng, texts, labels = random.Random(1), [], []
    for i in range(n):
        sentences = [" ".join(words(rng.randint(3, 12), i * 50 + k)) for k in range(rng.randint(1, 9))]
        junk, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(("zzidiot", "zzmoron", "qvilen", "qvilest", "qviler"))
        text = ". ".join(sentences)
        if junk:
            text = (text.replace(" ", " | "), text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "))[i % 3]
        texts.append((i, text))
        if i % 10 != 9:
            labels.append((i, int(not junk), int(toxic)))
    return docs(spark, texts), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module, label", [(Q, "quality"), (X, "toxic")])
def test_held_out_rows(spark, module, label):
    rows, labels = fixture(spark)
    got = {r.doc_id: r for r in module.classify(clashing(rows), labels).collect()}
    held = [(got[r.doc_id], r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == 500 and 60 < len(held) < 150
    assert np.mean([r.predicted == y for r, y in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_offending_sentences_are_located(spark):
    rows, labels = fixture(spark)
    model = X.train(rows, labels)
    text = "Quite nice words here. You zzmoron there! And more."
    (found,) = X.offending_sentences(docs(spark, {1: text, 2: None, 3: "fine"}), model).collect()
    assert text[found.start:found.end] == " You zzmoron there" == found.sentence
    assert model.score("")[0] == pytest.approx(model.leak) and model.score(None) == model.score("")


@pytest.mark.parametrize("module, label", [(Q, "quality"), (X, "toxic")])
def test_edges(spark, module, label):
    rows = docs(spark, [(1, None), (1, None), (None, "x"), (2, ""), (3, "word " * 60_000)])
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0), (3, 1, 1)], LABELS)
    for labels in (none, odd):
        got = module.classify(rows, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert module.classify(docs(spark, {}), labels).count() == 0
    assert [r.held_out for r in module.classify(rows, none).collect() if r.doc_id is None] == [False]


def test_quality_tables(spark, sf):
    """Lookup tables add up to the score, and rejected rows go without touching the others."""
    rows, labels = table(spark, sf.replace("0.001", "0.01"), "documents"), table(spark, sf.replace("0.001", "0.01"), "labels")
    model = Q.train(rows, labels)
    x = Q.feature_matrix(__import__("pandas").Series([r.text for r in rows.limit(50).collect()]))
    plain = [model.base + sum(t[np.searchsorted(c, v, "left")] for t, c, v in zip(model.tables, model.cuts, row))
             + sum(t[np.searchsorted(model.pair_cuts[a], row[a], "left"), np.searchsorted(model.pair_cuts[b], row[b], "left")]
                   for (a, b), t in zip(model.pairs, model.pair_tables)) for row in x]
    np.testing.assert_allclose(model.logits(x), plain)
    kept = Q.keep_good(clashing(rows), labels)
    good = {r.doc_id for r in Q.classify(rows, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == clashing(rows).columns


def test_features_of_nothing():
    assert Q.text_features(None) == Q.text_features("") == [0.0] * len(Q.FEATURES)
    assert all(np.isfinite(Q.text_features(t)).all() for t in (" ", "\n\n", "a", "!!!", "é🙂", "\ud800"))
