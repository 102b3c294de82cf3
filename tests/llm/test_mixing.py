import hashlib

import numpy as np
import pytest

from tests.llm.util import DOCS, clashing, words
from tickforge.llm import mixing as M
from pyspark.sql import functions as F


def corpus(spark, n=600):
    rows = []
    for i in range(n):
        text = " ".join(words(20 + i % 90, i)) + (" Licensed" if i % 11 == 0 else " a@b" if i % 7 == 0 else " | " if i % 5 == 0 else "")
        rows.append((i, text, ("en", "de", "fr", None)[(i * i) % 4 if i % 3 else 0], f"src{0 if i % 3 == 0 else i % 6}", len(text)))
    return spark.createDataFrame(rows, DOCS)


def wanted(spark):
    return {"source": M.shares(spark, {f"src{k}": k + 1 for k in range(6)}), "lang": M.shares(spark, {"en": 1, "de": 1, "fr": 1}),
            "topic": M.shares(spark, {"legal": 0.2, "contact": 0.2, "table": 0.2, "note": 0.2, "prose": 0.2})}


def test_raking_equals_a_plain_loop(spark):
    cells = M.cells_of(corpus(spark))
    got = {(r.source, r.lang, r.topic): r.raked for r in M.rake(cells, wanted(spark)).collect()}
    keys = sorted(got)
    t = {(r.source, r.lang, r.topic): float(r.tokens) for r in cells.collect()}
    goals = []
    for pos, weights in enumerate(({f"src{k}": k + 1 for k in range(6)}, {"en": 1, "de": 1, "fr": 1}, dict.fromkeys(("legal", "contact", "table", "note", "prose"), 0.2))):
        own = sum(v for k, v in t.items() if k[pos] not in weights) / sum(t.values())
        named = {k[pos] for k in t} & set(weights)
        goals.append({v: weights[v] * (1 - own) / sum(weights[x] for x in named) if v in weights else sum(x for k, x in t.items() if k[pos] == v) / sum(t.values())
                      for v in {k[pos] for k in t}})
    w = dict(t)
    for _ in range(300):
        for pos, goal in enumerate(goals):
            sums = {v: sum(w[k] for k in keys if k[pos] == v) for v in goal}
            w = {k: w[k] * goal[k[pos]] / sums[k[pos]] for k in keys}
    assert all(got[k] == pytest.approx(w[k], rel=1e-6) for k in keys)


@pytest.mark.parametrize("few, jobs", [(M.FEW_CELLS, 120), (0, 400)])
def test_raking_keeps_plans_small(spark, monkeypatch, few, jobs):
    """What the driver has to hold: few jobs, or many with small plans; with six rounds in one plan jobs of 19 stages came one after the other."""
    cells, given, sc = M.cells_of(corpus(spark)), wanted(spark), spark.sparkContext
    plain = {(r.source, r.lang, r.topic): r.raked for r in M.rake(cells, given).collect()}
    monkeypatch.setattr(M, "FEW_CELLS", few)
    sc.setJobGroup(f"rake-{few}", "raking")
    try:
        raked = M.rake(cells, given)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    ran = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"rake-{few}")]
    assert 0 < len(ran) <= jobs and max(len(j.stageIds) for j in ran) <= 12, (len(ran), max(len(j.stageIds) for j in ran))
    got = {(r.source, r.lang, r.topic): r.raked for r in raked.collect()}
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in plain.items())


def test_probabilities_meet_the_budget(spark):
    raked = M.rake(M.cells_of(corpus(spark)), wanted(spark))
    for budget in (0.1, 0.5, 0.9):
        rows = M.probabilities(raked, budget).collect()
        total = sum(r.tokens for r in rows)
        assert sum(r.tokens * r.probability for r in rows) == pytest.approx(budget * total)
        level = max(r.probability * r.tokens / r.raked for r in rows)
        assert all(r.probability == pytest.approx(min(1.0, level * r.raked / r.tokens)) for r in rows)


def test_sampling_follows_the_hash(spark):
    rows = corpus(spark)
    got = M.mixed(clashing(rows)).collect()
    assert 100 < len(got) < 600
    for r in got:
        u = int(hashlib.md5(f"{M.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 16 ** 13
        assert u < r._probability and r._tokens == len(r.text.split())
    out = M.sample(clashing(rows).withColumn("_source_", F.lit(1)))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in got}
    assert out.columns == clashing(rows).columns + ["_source_"]


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, None, None, 0), (2, "", "en", "s", 0), (None, "a b", None, "s", 3), (3, "a", "en", None, 1), (3, "a", "en", None, 1)], DOCS)
    assert {r.doc_id for r in M.mixed(rows, budget=1.0).collect()} == {None, 3}
    assert M.mixed(rows.limit(0)).count() == 0 and M.mixed(rows.where("doc_id < 3")).count() == 0
    one = M.topic_of(F.col("t"))
    topics = spark.createDataFrame([("x Licensed @",), ("q@z",), ("a | b",), ("short",), ("word " * 200,), (None,)], "t string").select(one).collect()
    assert [r[0] for r in topics] == ["legal", "contact", "table", "note", "prose", "note"]
