"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import hashlib

import corpus_pipeline as P
from tests.llm.test_decontamination import plain_tiling
from tests.llm.test_secret_scan import base
from tests.llm.util import linked_components
from tickforge.llm import decontamination as D
from tickforge.llm import mixing as M
from tickforge.llm import quality as Q
from tickforge.llm import secret_scan as S
from tickforge.llm.common import table
from tickforge.sources.stored import stored


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in P.STAGES]
    kept = [docs]
    for _, stage in P.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf)))
        assert kept[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    good = {r.doc_id for r in Q.classify(docs, table(spark, sf, "labels")).collect() if r.predicted}
    assert rows[1] == {i: r for i, r in rows[0].items() if i in good} and 0 < len(good) < len(rows[0])
    component, _ = linked_components({i: r.text for i, r in rows[1].items()}, 5)
    assert rows[2] == {i: r for i, r in rows[1].items() if component[i] == i} and len(rows[2]) < len(rows[1])
    items = {r.item_id: D.plain_words(r.text) for r in table(spark, sf, "benchmark").collect()}
    leaks = set()
    for i, r in rows[2].items():
        words = D.plain_words(r.text)
        grams = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
        for item in items.values():
            if any(tuple(item[k:k + 5]) in grams for k in range(len(item) - 4)):
                if sum(n for _, _, n in plain_tiling(words, item, 5)) >= 0.5 * len(item):
                    leaks.add(i)
    assert rows[3] == {i: r for i, r in rows[2].items() if i not in leaks} and leaks
    assert rows[4].keys() == rows[3].keys()
    spans = {r.doc_id: r.spans for r in S.report(kept[3]).collect()}
    for i, r in rows[4].items():
        before = rows[3][i].text
        assert (r.text == before) == (not spans[i]) and ("[secret]" in r.text) >= bool(base(before))
    rates = {r.doc_id: r._probability for r in M.mixed(kept[4], budget=M.BUDGET).collect()}
    for i in rows[5]:
        assert int(hashlib.md5(f"{M.SEED}:{i}".encode()).hexdigest()[:13], 16) / 16 ** 13 < rates[i]
    assert rows[5].keys() == rates.keys() and names == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "mixing"]
    assert {r.doc_id: r for r in P.run(spark, sf).collect()} == rows[5]
