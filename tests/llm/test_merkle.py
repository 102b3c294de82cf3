import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tests.llm.util import DOCS, LOWER, clashing, docs
from tickforge.llm import merkle as M
from tickforge.llm import queries as Q


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes):
    """Levels of a tree, and for every leaf the (left, right) siblings on its way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(nodes)):
        steps = []
        for level in levels[:-1]:
            run = i // 8 * 8
            steps.append((level[run:i], level[i + 1:run + 8]))
            i //= 8
        paths.append(steps)
    return levels[-1][0], paths


def plain(rows):
    """What the contract says, tree by tree."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted([(r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows if r[2] == lang], key=lambda x: x[:3])
        trees[lang] = mine, *grown([x[2] for x in mine])
    root, tops = grown([trees[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, tops):
        mine, sub, paths = trees[lang]
        for (_, _, own, r), path in zip(mine, paths):
            steps = path + above
            touched = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, r[1].translate(LOWER)) if touched else own
            for left, right in steps:
                now = sha(*left, now, *right)
            out.append((r[0], own, sub, root, sha(*[x for a, b in steps for x in a + b]), now, now == root))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(map(tuple, M.verified(frame).collect()), key=repr)


def test_every_shape_of_tree(spark):
    rng = random.Random(1)
    rows = []
    for k, n in enumerate((1, 2, 7, 8, 9, 64, 65, 130, 1, 3, 8)):
        rows += [(rng.randrange(10 ** 6) - 10 ** 5, rng.choice(["A text", "no capitals", "É", "", None]), f"l{k}", rng.choice(["s", None, ""]), rng.choice([None, 3]))
                 for _ in range(n)]
    rows += [(5, "Null language", None, "s", 1), (None, "Null id", None, "s", 1), (6, "empty language", "", "s", 1), (7, "é", "zß", "s", 2)]
    rows += [(9, "The same", "l3", "s", 8)] * 12 + [(9, "another Text", "l3", "s", 8)] * 2
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, DOCS)
    want = plain(rows)
    assert rows_of(frame.repartition(3)) == want
    assert rows_of(clashing(frame).withColumns({c: F.lit("x") for c in ("tree", "lo", "hi", "kids", "path", "digest", "_at", "_part", "_row", "leaf", "root")})) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_one_row_and_empty_table(spark):
    assert rows_of(docs(spark, {3: "Only One"})) == plain([(3, "Only One", "en", "s", 8)])
    assert rows_of(docs(spark, {})) == []


def test_intervals_of_nodes_are_those_of_their_parents(spark):
    leaves = spark.range(700).select(F.lit("t").alias("tree"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    trees = M.forest(leaves, ["k"])
    assert [x.count() for x in trees.levels] == [700, 88, 11, 2, 1]
    for level, nodes in enumerate(trees.levels[1:], 1):
        for r in nodes.collect():
            assert r.lo % 8 ** level == 0 and r.hi == min(700, r.lo + 8 ** level)
            assert [k.lo for k in r.kids] == list(range(r.lo, r.hi, 8 ** (level - 1))) and r.kids[-1].hi == r.hi


def test_long_text_and_hot_language_over_many_tasks(spark, monkeypatch):
    rows = [(k, "Long " * 200_000 if k == 50 else f"T{k}", "en", "s", k) for k in range(300)] + [(1, "Same", "en", "s", 4)] * 100
    frame = spark.createDataFrame(rows, DOCS)
    assert rows_of(frame) == plain(rows)
    seen = []
    monkeypatch.setattr(M, "stored", lambda df, kind: seen.append(df) or original(df, kind))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        M.ranked(frame.select(F.col("lang").alias("tree"), "doc_id", M.leaf_of().alias("digest")), ["doc_id", "digest"])
        parts = seen[0].groupBy(F.shiftright("_at", M.ROW_BITS)).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 200  # one language, a quarter of it the same row


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, Q.QUERIES["op11_merkle_manifest"](spark, sf).collect()), key=repr) == plain(rows)


original = M.stored
