import numpy as np

from tests.llm.util import clashing, docs, words
from tickforge.llm import decontamination as D

ITEMS = "item_id long, text string"


def plain_tiling(d, i, size):
    """Greedy tiling by trying every pair of places."""
    free_d, free_i, out = [True] * len(d), [True] * len(i), []
    while True:
        best = None
        for p in range(len(i)):
            for q in range(len(d)):
                n = 0
                while p + n < len(i) and q + n < len(d) and i[p + n] == d[q + n] and free_i[p + n] and free_d[q + n]:
                    n += 1
                if n >= size and (best is None or (-n, p, q) < best):
                    best = (-n, p, q)
        if best is None:
            return out
        n, p, q = -best[0], best[1], best[2]
        for k in range(n):
            free_i[p + k] = free_d[q + k] = False
        out.append((q, p, n))


def test_tiles_equal_plain_tiling():
    rng = np.random.default_rng(4)
    for _ in range(150):
        d, i = rng.integers(0, 3, rng.integers(5, 40)), rng.integers(0, 3, rng.integers(5, 25))
        pairs = [(q, p) for q in range(len(d) - 2) for p in range(len(i) - 2) if (d[q:q + 3] == i[p:p + 3]).all()]
        got = D.tiles(np.array([x for x, _ in pairs], int), np.array([x for _, x in pairs], int), 3)
        assert got == plain_tiling(list(d), list(i), 3)


def test_finds_reordered_passages_and_leaves_clean_documents(spark):
    passage = words(40, 1)
    other = words(40, 2)
    shuffled = passage[27:] + ["x"] + passage[:13] + ["y"] + passage[13:27]
    texts = {1: " ".join(words(50, 3) + passage + words(9, 4)), 2: " ".join(words(30, 5) + shuffled).upper() + "!", 3: " ".join(words(300, 6)),
             4: " ".join(passage[:15]), 5: "", 6: None, 7: " ".join(words(50_000, 7) + passage), 8: ", ".join(other) + " " + " - ".join(passage)}
    items = spark.createDataFrame([(10, " ".join(passage)), (10, " ".join(passage)), (11, " ".join(other)), (12, "short one"), (13, None), (None, "x")], ITEMS)
    rows = docs(spark, [*texts.items(), (1, texts[1]), (1, "other text"), (None, texts[1])])
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(clashing(rows), items).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 10), (8, 10), (8, 11)}
    assert got[1, 10].covered == 40 and got[1, 10].coverage == 1.0 and got[1, 10].tiles == 1
    assert got[2, 10].covered == 40 and got[2, 10].tiles == 3
    kept = D.without_leaks(clashing(rows), items)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 4, 5, 6]
    assert kept.where("doc_id IS NULL").count() == 1 and kept.columns == clashing(rows).columns


def test_empty_tables(spark):
    none, items = docs(spark, {}), spark.createDataFrame([], ITEMS)
    some = docs(spark, {1: "a b c d e f"})
    assert D.contaminated(none, items).count() == 0 and D.contaminated(some, items).count() == 0
    assert D.without_leaks(some, items).count() == 1 and D.without_leaks(none, items).count() == 0


def test_a_worker_holds_packed_bits_and_few_rows(spark, monkeypatch):
    passage = words(30, 1)
    items = spark.createDataFrame([(10, " ".join(passage))], ITEMS)
    seeds = D.item_seeds(items)
    bits = D.seed_bitmap(spark, seeds)
    assert bits.dtype == np.uint8 and bits.nbytes == 1 << 21 and np.unpackbits(bits).sum() == seeds.select("seed").distinct().count()
    monkeypatch.setattr(D, "HITS", 7)
    monkeypatch.setattr(D, "WORDS", 3)
    rows = docs(spark, {1: " ".join(words(9, 2) + passage), 2: " ".join(passage + passage), 3: " ".join(words(40, 3)), 4: None})
    got = D.seed_hits(rows, seeds).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got}[1] == 26 and {r.doc_id: r["count"] for r in got}[2] >= 52
    assert [(r.doc_id, r.covered) for r in D.contaminated(rows, items).orderBy("doc_id").collect()] == [(1, 30), (2, 30)]
