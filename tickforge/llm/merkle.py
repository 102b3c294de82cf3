"""Merkle manifest of a dataset: digests of rows, of runs of rows, and one root, with proofs.

Every node of a tree is labelled with the interval of leaf ranks that it covers. Ranks come from a range partitioned
table and a prefix sum over its partitions, so no tree is ever sorted in one task. A level of the tree is a grouping by
``rank div 8 ** level``. Going down again, the same quotient is the bucket of an equi-join in which a node
finds the one parent whose interval contains its own; the parent's other intervals are the node's siblings. What a path
needs from higher levels travels with the parent, which is shared by all leaves below it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.sources.stored import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value that can't run into its neighbours: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """Digest of a document row; ``text`` stands in for the column of that name."""
    return digest(*[field(text if name == "text" and text is not None else F.col(name)) for name in FIELDS])


@dataclass
class Forest:
    """``levels[k]`` holds the nodes of level k of all trees: ``(tree, n, lo, hi, digest)``, from level 1 on with ``kids``,
    the intervals and digests they were made of; ``n`` is the number of leaves of the tree. ``leaves`` is level 0
    with the columns that were handed in."""

    leaves: DataFrame
    levels: list[DataFrame]


def height() -> Column:
    """Level of the top node of a tree of ``n`` leaves: the number of digits of n - 1 to the base 8."""
    return F.when(F.col("n") > 1, F.length(F.conv((F.col("n") - 1).cast("string"), 10, FANOUT))).otherwise(0)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves(tree, ...)`` with ``lo``, ``hi`` (``lo + 1``) and ``n``: rank within the tree by ``order``, and leaves of the tree.

    Equal rows get neighbouring ranks and may lie in different partitions, so neither a hot tree nor a hot row meets
    in one task. The windows see one row per tree and partition."""
    salted = leaves.withColumn("_row", F.monotonically_increasing_id())
    keys = ["tree", *order, "_row"]
    placed = stored(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select("tree", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_tree).alias("n"))
    lo = F.col("_at") + F.col("_shift")
    return placed.join(parts, ["tree", "_part"]).withColumns({"lo": lo, "hi": lo + 1}).drop("_at", "_part", "_shift")


def forest(leaves: DataFrame, order: list[str]) -> Forest:
    """Trees over ``leaves(tree, digest, ...)``: while a tree has several nodes, every 8 consecutive ones (the last run may have
    fewer, even one) become their digest. ``order`` sorts the leaves of a tree. An empty table has no tree."""
    first = ranked(leaves, order)
    levels = [first.select("tree", "n", "lo", "hi", "digest")]
    top = levels[0].agg(F.max(height())).first()[0] or 0
    for level in range(1, top + 1):
        run = F.floor(F.col("lo") / F.lit(FANOUT ** level)).alias("_run")
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))
        made = (levels[-1].where(height() >= level).groupBy("tree", run)
                .agg(F.first("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
                .drop("_run").withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256)))
        levels.append(stored(made, "nodes"))
    return Forest(first, levels)


def tops(trees: Forest) -> DataFrame:
    """``(tree, digest)``: the top node of every tree, which is the leaf itself where there is only one."""
    found = None
    for level, nodes in enumerate(trees.levels):
        here = nodes.where(height() == level).select("tree", "digest")
        found = here if found is None else found.union(here)
    return found


def with_paths(trees: Forest, above: DataFrame) -> DataFrame:
    """``trees.leaves`` with ``path`` and the further columns of ``above``.

    ``path`` lists, from the leaf to the end, the digests left and right of the node on the way within its parent, as
    concatenated text. ``above(tree, path, ...)`` has one row per tree: what the path of its top node continues with."""
    rest = [c for c in above.columns if c not in ("tree", "path")]
    parents = None
    for level in range(len(trees.levels) - 1, -1, -1):
        nodes = trees.leaves if level == 0 else trees.levels[level]
        on_top = nodes.where(height() == level).join(above, "tree")
        if parents is not None:
            bucket = F.floor(F.col("lo") / F.lit(FANOUT ** (level + 1)))
            up = parents.select(F.col("tree").alias("_tree"), F.floor(F.col("lo") / F.lit(FANOUT ** (level + 1))).alias("_bucket"), F.col("lo").alias("_lo"),
                                F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), "path", *rest)
            inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            below = nodes.where(height() > level).join(up, (F.col("tree") == F.col("_tree")) & (bucket == F.col("_bucket")) & inside)
            left = F.array_join(F.filter("_kids", lambda k: k["hi"] <= F.col("lo"))["digest"], "")
            right = F.array_join(F.filter("_kids", lambda k: k["lo"] >= F.col("hi"))["digest"], "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            on_top = on_top.unionByName(below.withColumn("path", F.concat(step, F.col("path"))).select(on_top.columns))
        parents = on_top
    return parents


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def manifest(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """``(doc_id, lang, leaf, received, subroot, root, path)`` of every row of ``docs(doc_id, source, lang, n_chars, text)``.

    One tree per ``lang`` over its rows by ``doc_id`` (null first; equal ids by leaf digest), and one over the languages' top
    nodes (null first, bytewise). ``received`` is the leaf digest that somebody presents for the row, the row's
    own by default. Repeated rows are leaves of their own; null fields have their own mark, empty texts another;
    other columns are left out, so their names don't matter. An empty table has no rows."""
    own = leaf_of()
    # "" is the null language, so the order of trees is the order of languages
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), "lang", own.alias("digest"),
                         (own if received is None else received).alias("received"))
    by_lang = forest(leaves, ["doc_id", "digest"])
    whole = forest(tops(by_lang).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"])
    root = tops(whole).select("tree", F.array().cast(STEP).alias("path"), F.col("digest").alias("root"))
    above = with_paths(whole, root).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    return with_paths(by_lang, above).select("doc_id", "lang", F.col("digest").alias("leaf"), "received", "subroot", "root", "path")


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def verified(docs: DataFrame) -> DataFrame:
    """Proofs of all rows and the verdict on a copy in which the texts of some rows were lower-cased: those whose
    crc32 of the decimal id is divisible by 3 (a null id is never touched). A text without A-Z stays as it is and verifies."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(docs, F.when(touched, leaf_of(lowered(F.col("text")))).otherwise(leaf_of()))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return (rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("received"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
