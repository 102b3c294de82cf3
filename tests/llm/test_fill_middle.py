import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.util import clashing, docs
from tickforge.llm import fill_middle as M
from tickforge.llm import queries as Q


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(texts):
    out = []
    for i, text in texts:
        text, n = text or "", len(text or "")
        digest = sha(f"1:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in range(0, 32, 8))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((i, n, "plain", None, None, sha(text), sha(text)))
        elif h4 % 100 < 20:
            out.append((i, n, "spm", a, b - a, sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(text)))
        else:
            out.append((i, n, "psm", a, b - a, sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)))
    return sorted(out, key=repr)


def texts_of():
    rng = random.Random(2)
    bits = ["<", "P", ">", "<S", "S>", "M", "a", "é", "🙂", "\n", " ", "word", "<|", "日"]
    texts = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    return texts + [(None, "no id"), (None, None), (2 ** 62 + 1, "large id"), (-4, ""), (5, "again"), (5, "again"), (5, "other"), (6, "x" * 100_003), (7, "a<P>b"), (8, "é" * 40_000)]


def test_equals_whole_texts_at_every_chunk_size(spark):
    texts = texts_of()
    want = plain(texts)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    frame = clashing(docs(spark, texts)).selectExpr("*", "1 AS at", "2 AS piece", "3 AS form", "'x' AS h1", "4 AS place").repartition(3)
    for chunk in (1, 2, 7, M.CHUNK):
        rows = texts if chunk > 2 else [t for t in texts if len(t[1] or "") < 1000]
        few = frame.where(F.coalesce(F.length("text"), F.lit(0)) < (1 << 30 if chunk > 2 else 1000))
        assert sorted(map(tuple, M.transformed(few, chunk).collect()), key=repr) == (want if chunk > 2 else plain(rows))
    assert M.transformed(docs(spark, {})).count() == 0


def test_chunks_are_bounded_and_marks_whole(spark):
    made = M.pieces(docs(spark, {k: "abc" * 1000 for k in range(30)}), 100).collect()
    assert max(len(r.piece) for r in made) <= 103
    for r in made:
        assert not any(m in r.piece[1:] for m in M.PLACES)
    whole = {}
    for r in sorted(made, key=lambda r: (r.uid, r.at)):
        assert r.at == len(whole.get(r.uid, ""))
        whole[r.uid] = whole.get(r.uid, "") + r.piece


def test_restoring_needs_one_exchange_and_notices_damage(spark):
    texts = [(k, "some words of text " * 20) for k in range(20)]
    outputs = M.assembled(M.pieces(docs(spark, texts), 50))
    plan = M.read_back(outputs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
    good = {r.doc_id: r for r in M.read_back(outputs).collect()}
    bad = {r.doc_id: r for r in M.read_back(outputs.withColumn("piece", F.when(F.col("doc_id") == "3", F.translate("piece", "w", "v")).otherwise(F.col("piece")))).collect()}
    assert all((good[k].output_sha256 == bad[k].output_sha256) == (k != "3") and (good[k].restored_sha256 == bad[k].restored_sha256) == (k != "3") for k in good)


def test_registered_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, Q.QUERIES["op13_fill_middle"](spark, sf).collect()), key=repr) == plain(texts)
