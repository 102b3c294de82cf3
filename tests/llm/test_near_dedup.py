import os
import random
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tests.llm.util import clashing, docs, linked_components, words
from tickforge.llm import near_dedup as N
from tickforge.llm.components import components
from tickforge.sources.stored import discard, stored


def corpus():
    """Copies, a large group of near copies at every distance, boilerplate, short and empty texts."""
    rng, out, common = random.Random(3), {}, words(12, 1)
    for i in range(60):
        out[i] = " ".join(common + words(rng.randint(1, 60), i + 10))
    base = words(90, 2)
    for i in range(100, 260):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice(([], [w[k], w[k]], words(1, i * 31 + k)))
        out[i] = " ".join(w)
    out |= {300: "", 301: None, 302: "One", 303: "one", 304: "two words", 305: "TWO\twords ", 306: out[5], 307: out[5], 308: "   ",
            400: " ".join(words(30_000, 5)), 401: " ".join(words(30_000, 5)[:-40])}
    return out


def test_equals_comparing_every_pair(spark):
    texts = corpus()
    for size in (2, 5):
        got = {r.doc_id: r for r in N.near_duplicates(clashing(docs(spark, texts)), size).collect()}
        component, n = linked_components(texts, size)
        assert {i: r.component_id for i, r in got.items()} == component
        assert {i: r.n_shingles for i, r in got.items()} == n
        assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_repeated_and_missing_ids_and_empty_tables(spark):
    rows = docs(spark, [(7, "a b c d"), (7, "a b c d"), (7, "z"), (7, ""), (7, None), (9, "a b c d"), (3, "a b c"), (3, "x y z w"), (4, "x y z w"),
                        (None, "a b c d"), (None, None)])
    got = sorted((r.doc_id or 0, r.n_shingles or 0, r.component_id, r.kept) for r in N.near_duplicates(rows).collect())
    assert got == [(0, 0, None, True)] * 2 + [(3, 2, 3, True), (3, 3, 3, True), (4, 3, 3, False), (7, 0, 7, True), (7, 0, 7, True), (7, 1, 7, True),
                                              (7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False)]
    kept = N.one_of_each(clashing(rows), 2)
    texts = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert texts == [(0, ""), (0, "a b c d"), (3, "a b c"), (3, "x y z w"), (7, ""), (7, "a b c d"), (7, "z")]
    assert kept.columns == clashing(rows).columns
    none = docs(spark, {})
    assert N.near_duplicates(none).count() == 0 and N.one_of_each(none).count() == 0


def test_every_text_of_a_repeated_id_is_linked_as_if_it_had_its_own(spark):
    texts = corpus()
    texts = {i: t for i, t in texts.items() if t and len(t) < 5000}
    shared = {i: i // 7 for i in texts}  # seven rows an id
    component, n = linked_components(texts, 2)
    least = {}
    for i, c in component.items():
        least[c] = min(least.get(c, shared[i]), shared[i])
    want = sorted((shared[i], n[i], least[component[i]]) for i in texts)
    rows = docs(spark, [(shared[i], t) for i, t in texts.items()])
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(rows).collect()) == want
    stay = N.one_of_each(rows, 2).collect()
    by_text = {t: component[i] for i, t in texts.items()}
    assert sorted(by_text[r.text] for r in stay) == sorted(set(component.values()))  # one of each component
    assert all(r.doc_id == least[by_text[r.text]] for r in stay)


def test_used_tables_go(spark):
    kept = stored(spark.range(5), "kept")
    gone = stored(spark.range(7), "gone")
    path = gone.inputFiles()[0]
    discard(gone)
    assert kept.count() == 5 and not os.path.exists(urlparse(path).path)


def test_one_of_each_keeps_the_smallest(spark):
    texts = corpus()
    component, _ = linked_components(texts, 5)
    got = {r.doc_id: r.text for r in N.one_of_each(docs(spark, texts)).collect()}
    assert got == {i: t for i, t in texts.items() if component[i] == i}


def test_components_of_a_long_path(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(
        spark.createDataFrame([(500, 501), (501, 502)], "a long, b long"))
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(300)} | {500: 500, 501: 500, 502: 500}
    assert components(links.limit(0)).count() == 0
