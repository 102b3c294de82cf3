"""Near-duplicates by an inverted join of signature coordinates.

Every text gets ``COORDINATES`` minima of its shingle set under different permutations. Two sets of
similarity 0.8 agree in about 0.8 of the coordinates, and in at least ``MATCHES`` of them but for a
few in a million pairs. Equal sets are one class and go on as one representative. A representative
is posted under each of its coordinate-value pairs.

* Prefix: partners share one of any ``COORDINATES - MATCHES + 1`` coordinates. So half of the values tell who can
  have a partner at all, and only they go on. Values that occur once are useless, and whoever has fewer than
  ``MATCHES`` values that occur twice has no partner. Of the others only the rarest ``n - MATCHES + 1`` values are
  posted: two documents that agree in ``MATCHES`` values share one of those. Values of boilerplate are common, come
  last in that order, and are not posted by documents that have anything else.
* Skip: in a posting list everyone is compared with one hub, its smallest id, by signature. Pairs that
  agree join lists into clusters; confirmed pairs make components. What is in one component needs no
  further pair, so a list of n copies costs n pairs, not n * n.
* Within a cluster all sets are seen as differences from its smallest id: shingles missing (a) and extra
  (e). That confirms the links to the hub. Two other members that share no extra shingle are at most as
  similar as a and the sizes allow, so only members of fitting size meet; all others must share an extra
  shingle, and meet in a join on the first ``e - need + 1`` of them in hash order (``need``: how many they
  must share at least).
* Between clusters, members of a list meet if two bits of each coordinate agree often enough.
* All such pairs are confirmed on both full sets with integers, within a cluster as differences to its hub. Nothing is capped: the bounds only leave
  out what can't reach the similarity. Sets are made of the texts of clustered documents only, where the
  texts lie; a bitmap of a fixed size tells which (a full bitmap lets more through and changes no result).

A class has a number of its own (its doc_id if no id repeats), so rows that share a doc_id but not the set are linked each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.llm.common import bounded_batches, unused
from tickforge.llm.components import components
from tickforge.llm.words import WordHashes, mixed, shingle_set
from tickforge.sources.stored import discard, stored

COORDINATES, MATCHES = 48, 25
#: Agreements of two-bit coordinates: 40.8 of 48 at similarity 0.8, with a deviation of 2.5.
BIT_MATCHES = 28
SLOT_BITS = 24
PERCENT = 80
_ODD = (mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = mixed(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)).astype(np.uint32)


def signature(shingles: np.ndarray, odd: np.ndarray = _ODD, add: np.ndarray = _ADD) -> np.ndarray:
    """Smallest value of the set under each permutation of 32-bit numbers."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 8192):
        moved = low[None, i:i + 8192] * odd[:, None] + add[:, None]
        np.minimum(best, moved.min(axis=1), out=best)
    return best


def _bits(sig: np.ndarray, bit: int) -> int:
    return int(((sig >> np.uint32(bit)) & np.uint32(1)).astype(np.int64) @ (1 << np.arange(COORDINATES, dtype=np.int64)))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, n, s1, s2, sig, b0, b1)`` of every row with an id: set size, two sums that name the set, its signature,
    and the two lowest bits of every coordinate. Texts stay where they are."""
    bounded_batches(docs.sparkSession)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text, size, hashes)
                sig = signature(s)
                out.append((doc_id, len(s), int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0,
                            int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0,
                            sig.view(np.int32) if len(s) else None, _bits(sig, 0), _bits(sig, 1)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "s1", "s2", "sig", "b0", "b1"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInPandas(
        sketch, "doc_id bigint, n bigint, s1 bigint, s2 bigint, sig array<int>, b0 bigint, b1 bigint")


def _slot(number: Column) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(1 << SLOT_BITS))


def marker(numbers: DataFrame) -> Callable[[Column], Column]:
    """A test whether a number may be in the one column of ``numbers``: true for all that are, and for others that share
    a place with one. The bitmap is built by Spark in chunks of 4 KB; 2 MB reach the driver and every task."""
    spark = numbers.sparkSession
    slots = numbers.select(_slot(F.col(numbers.columns[0])).alias("slot"))
    chunks = (slots.select(F.shiftright("slot", 15).alias("chunk"), (F.col("slot") % 32768).alias("bit"))
              .groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    bits = np.zeros(1 << SLOT_BITS >> 3, np.uint8)
    for row in chunks:
        bits[row["chunk"] * 4096:(row["chunk"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def marked(slot: pd.Series) -> pd.Series:
        at = slot.to_numpy(np.int64)
        return pd.Series((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda number: marked(_slot(number))


def hopeful(reps: DataFrame) -> DataFrame:
    """The representatives that share a value with another one in the first ``COORDINATES - MATCHES + 1`` coordinates.
    Who shares none there agrees in fewer than ``MATCHES`` with everyone."""
    first = reps.select("id", F.posexplode(F.slice("sig", 1, COORDINATES - MATCHES + 1)).alias("coordinate", "value"))
    posts = first.select("id", (F.col("value").cast("long") * COORDINATES + F.col("coordinate")).alias("post"))
    common = posts.groupBy("post").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("post")
    ids = stored(posts.join(common, "post", "left_semi").select("id").distinct(), "hopeful")
    return reps.where(marker(ids)(F.col("id"))).join(ids, "id", "left_semi")


def prefix_postings(reps: DataFrame) -> DataFrame:
    """``(coordinate, value, id)`` of the posted prefix of each representative."""
    posts = reps.select("id", F.posexplode("sig").alias("coordinate", "value"))
    common = posts.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posts.join(common, ["coordinate", "value"])
    mine = Window.partitionBy("id")  # at most COORDINATES rows
    ranked = (shared.withColumn("m", F.count(F.lit(1)).over(mine)).where(F.col("m") >= MATCHES)
              .withColumn("r", F.row_number().over(mine.orderBy("df", "coordinate", "value"))))
    return ranked.where(F.col("r") <= F.col("m") - MATCHES + 1).select("coordinate", "value", "id")


def hub_pairs(posts: DataFrame) -> DataFrame:
    """Everyone with the smallest id of its list."""
    hubs = posts.groupBy("coordinate", "value").agg(F.min("id").alias("a"), F.max("id").alias("hi")).where("a < hi")
    pairs = posts.join(hubs.drop("hi"), ["coordinate", "value"]).where("a < id")
    return pairs.select("a", F.col("id").alias("b")).distinct()


def between_clusters(posts: DataFrame, placed: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of one list in different clusters whose sizes and bits allow the similarity."""
    rows = posts.join(placed.select("id", "cluster"), "id").join(signed.select("id", "n", "b0", "b1"), "id")
    several = (rows.groupBy("coordinate", "value").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
               .where("lo < hi").select("coordinate", "value"))
    left = rows.join(several, ["coordinate", "value"])
    right = left.select("coordinate", "value", *[F.col(c).alias(f"_{c}") for c in ("id", "cluster", "n", "b0", "b1")])
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("_b0")).bitwiseOR(F.col("b1").bitwiseXOR(F.col("_b1"))))
    fits = F.least("n", "_n") * 100 >= F.greatest("n", "_n") * PERCENT
    met = left.join(right, ["coordinate", "value"]).where((F.col("id") < F.col("_id")) & (F.col("cluster") != F.col("_cluster"))
                                                          & fits & (differ <= COORDINATES - BIT_MATCHES))
    return met.select(F.col("id").alias("a"), F.col("_id").alias("b")).distinct()


def star(sets: DataFrame) -> DataFrame:
    """``(hub, id, linked, n, a, e, hub_n, extra, lacks, adds)`` of every member but the hub: whether it is similar to the
    cluster's hub, the sizes of the differences, the extra shingles that are posted, and the differences themselves:
    places of the hub's shingles that it lacks, and all shingles that it adds, sorted."""
    percent = PERCENT

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for hub, i, x, h in zip(batch["hub"], batch["id"], batch["set_x"], batch["set_h"]):
                x, h = np.frombuffer(x, np.uint64), np.frombuffer(h, np.uint64)
                extra = np.setdiff1d(x, h, assume_unique=True)
                lacks = np.flatnonzero(~np.isin(h, x, assume_unique=True)).astype(np.uint32)
                e, n = len(extra), len(x)
                need = max(1, -(-(100 * e - (100 - percent) * n) // 100))
                linked = 100 * (n - e) >= percent * (len(h) + e)
                out.append((hub, i, linked, n, len(h) - (n - e), e, len(h), extra[:max(0, e - need + 1)].view(np.int64),
                            lacks.tobytes(), extra.tobytes()))
            yield pd.DataFrame(out, columns=["hub", "id", "linked", "n", "a", "e", "hub_n", "extra", "lacks", "adds"])

    members = sets.where("id <> cluster").select(F.col("cluster").alias("hub"), "id", F.col("shingles").alias("set_x"))
    hubs = sets.where("id = cluster").select(F.col("id").alias("hub"), F.col("shingles").alias("set_h"))
    return members.join(hubs, "hub").select("hub", "id", "set_x", "set_h").mapInPandas(
        compare, "hub bigint, id bigint, linked boolean, n bigint, a bigint, e bigint, hub_n bigint, extra array<bigint>, lacks binary, adds binary")


def within_clusters(rows: DataFrame) -> DataFrame:
    """Pairs of different components of one cluster that can be similar, from ``star`` with components."""
    other = rows.select("hub", *[F.col(c).alias(f"_{c}") for c in ("id", "component", "n", "a", "e", "extra")])
    apart = F.col("component") != F.col("_component")
    # with the shingles they may share beside the hub's: none of them extra, or at most the smaller e
    most = F.col("hub_n") - F.greatest("a", "_a")

    def reach(common: Column) -> Column:
        common = F.least(common, "n", "_n")
        return (100 + PERCENT) * common >= PERCENT * (F.col("n") + F.col("_n"))

    tokens = rows.withColumn("token", F.explode("extra")).drop("extra")
    theirs = other.withColumn("token", F.explode("_extra")).drop("_extra")
    sharing = tokens.join(theirs, ["hub", "token"]).where(
        apart & (F.col("id") < F.col("_id")) & reach(most + F.least("e", "_e"))).select("id", "_id")
    # without a common extra shingle: 180 * (hub_n - a) >= 80 * (n + _n) for either a
    room = F.floor(((100 + PERCENT) * (F.col("hub_n") - F.col("a")) - PERCENT * F.col("n")) / PERCENT)
    sizes = rows.groupBy("hub").agg(F.min("n").alias("least"), F.max("n").alias("largest"))
    loose = rows.where(F.col("component") != F.col("hub")).join(sizes, "hub")
    low, high = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100)), F.least("largest", room)
    asking = loose.where(low <= high).withColumn("_n", F.explode(F.sequence(low, high))).drop("extra", "least", "largest")
    plain = asking.join(other.drop("_extra"), ["hub", "_n"]).where(apart & reach(most)).select("id", "_id")
    return sharing.union(plain).select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree often enough."""
    a = reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    b = reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (pairs.join(b, "b").join(a, "a")
            .where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT) & (same >= MATCHES)).select("a", "b"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= PERCENT * union on the full sets."""
    percent = PERCENT

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    a, b = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInPandas(compare, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(id, cluster, shingles)``, the sorted set as bytes, of the classes in ``wanted(id, doc, s1, cluster)``, made of a
    text with that id and sum. Rows may give a set more than once if ids repeat."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc"], batch["text"]):
                s = shingle_set(text, size, hashes)
                out.append((doc_id, int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0, s.tobytes()))
            yield pd.DataFrame(out, columns=["doc", "s1", "shingles"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
    made = rows.where(marker(wanted.select("doc"))(F.col("doc"))).mapInPandas(build, "doc bigint, s1 bigint, shingles binary")
    return made.join(wanted, ["doc", "s1"]).select("id", "cluster", "shingles")


def confirmed_by_hub(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of pairs of one cluster those with 100 * intersection >= PERCENT * union. Both full sets are known from the differences
    to their hub (``star``), which are all that travels: hub_n less what either lacks, and what both add."""
    percent = PERCENT

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for hub_n, n_a, n_b, *parts in zip(batch["hub_n"], *(batch[f"{c}_{k}"] for c in ("n", "lacks", "adds") for k in "ab")):
                lack = [np.frombuffer(x, np.uint32) for x in parts[:2]]
                add = [np.frombuffer(x, np.uint64) for x in parts[2:]]
                both = hub_n - len(np.union1d(*lack)) + len(np.intersect1d(*add, assume_unique=True))
                keep.append(100 * both >= percent * (n_a + n_b - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    a, b = (rows.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "lacks", "adds")], *["hub_n"] * (k == "a")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").select(
        "a", "b", "hub_n", *[f"{c}_{k}" for c in ("n", "lacks", "adds") for k in "ab"]).mapInPandas(compare, "a bigint, b bigint")


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, repeated: bool) -> DataFrame:
    """``(id, component)`` of the classes ``(id, doc, n, s1, sig, b0, b1)`` that are similar to another one."""
    reps = stored(hopeful(classes.select("id", "doc", "n", "s1", "sig", "b0", "b1")), "reps")
    posts = stored(prefix_postings(reps), "postings")
    signed = stored(posts.select("id").distinct().join(reps, "id"), "signed")
    discard(reps)
    near = stored(agreeing(hub_pairs(posts), signed), "near")
    clusters = components(near).withColumnRenamed("component", "cluster")
    clustered = stored(signed.join(clusters, "id", "left").select("id", "doc", "s1", F.coalesce("cluster", "id").alias("cluster")), "clustered")
    apart = stored(agreeing(between_clusters(posts, clustered, signed), signed), "apart")
    discard(posts)
    several = near.select(F.explode(F.array("a", "b")).alias("id")).union(apart.select(F.explode(F.array("a", "b")))).distinct()
    sets = shingle_sets(docs, clustered.join(several, "id"), size)
    sets = stored(sets.dropDuplicates(["id"]) if repeated else sets, "sets")
    seen = stored(star(sets), "star")
    links = stored(seen.where("linked").select(F.col("hub").alias("a"), F.col("id").alias("b")), "similar")
    parts = components(links)
    placed = stored(seen.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    discard(seen)
    mixed_hubs = placed.groupBy("hub").agg(F.max(F.col("component") != F.col("hub")).alias("open")).where("open").select("hub")
    rest = within_clusters(placed.join(mixed_hubs, "hub").drop("linked", "lacks", "adds"))
    more = stored(confirmed(apart, sets).union(confirmed_by_hub(agreeing(rest, signed), placed)), "confirmed")
    discard(placed, sets, signed, near, apart, clustered)
    return parts if more.isEmpty() else components(links.union(more))


def _placed(docs: DataFrame, size: int) -> DataFrame:
    """``near_duplicates`` of the rows with an id, with the sum ``s1`` of the set and ``stays``: one row of each component,
    or several that repeat its id and text; all rows without words."""
    sketched = stored(sketches(docs, size), "sketches")
    known = stored(sketched.select("doc_id", "n", "s1", "s2"), "known")
    classes = sketched.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("b0").alias("b0"), F.first("b1").alias("b1"))
    # numbers in the order of the ids: an original mostly precedes its copies, and makes the better hub
    repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = stored(classes.orderBy("doc").withColumn("id", F.monotonically_increasing_id()) if repeated
                     else classes.withColumn("id", F.col("doc")), "classes")  # written once, so the numbers stay
    discard(sketched)
    parts = linked_classes(docs, classes, size, repeated)
    names = stored(classes.select("n", "s1", "s2", "doc", "id"), "names")
    discard(classes)
    parts = stored(parts.join(names.select("id", "doc"), "id"), "parts")
    least = parts.groupBy("component").agg(F.min("doc").alias("least"))
    heads = parts.join(least, "component").where("doc = least").groupBy("component", "least").agg(F.min("id").alias("head"))
    linked = parts.join(heads, "component").select("id", "least", "head")
    named = names.join(linked, "id", "left").select("n", "s1", "s2", "doc", F.coalesce("least", "doc").alias("least"),
                                                    F.coalesce(F.col("head") == F.col("id"), F.lit(True)).alias("head"))
    return known.join(named, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "s1",
        F.coalesce(F.col("head") & (F.col("doc_id") == F.col("doc")), F.lit(True)).alias("stays"))


def near_duplicates(docs: DataFrame, size: int = 2) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text)``.

    An empty or null text has size 0 and is its own component; a row without an id has nulls. Rows that repeat an id
    are documents of their own: each is linked by its own text, and ``component_id`` is the smallest id among the rows that
    its text reaches."""
    rows = _placed(docs, size).select("doc_id", "n_shingles", "component_id")
    nothing = F.lit(None).cast("long")
    nameless = docs.where(F.col("doc_id").isNull()).select(nothing.alias("doc_id"), nothing.alias("n_shingles"), nothing.alias("component_id"))
    return rows.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, all without words and all without an id. Of rows that
    repeat an id and a set one stays.

    Texts stay where they are, but for those whose id a bitmap marks: ids that go, and ids that several rows have."""
    own = unused(docs)
    doc_id = F.col("doc_id").cast("long")
    rows = stored(_placed(docs, size).select("doc_id", "s1", "stays"), "rows")
    marks = rows.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("repeated"), F.min("stays").alias("stays"))
    marks = stored(marks.where("repeated OR NOT stays").select(F.col("doc_id").alias(f"{own}id"), "repeated"), "marks")
    marked = marker(marks.select(f"{own}id"))(doc_id)
    moved = docs.where(doc_id.isNotNull() & marked)
    out = docs.where(doc_id.isNull() | ~marked).union(moved.join(marks, doc_id == F.col(f"{own}id"), "left_anti"))
    several = marks.where("repeated").select(f"{own}id")
    if several.isEmpty():
        return out

    @F.pandas_udf("bigint")
    def sums(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for batch in texts:
            yield pd.Series([int(shingle_set(t, size, hashes).sum(dtype=np.uint64).view(np.int64)) for t in batch], dtype="int64")

    stay = rows.where("stays").select(F.col("doc_id").alias(f"{own}id"), F.col("s1").alias(f"{own}s1")).distinct()
    again = moved.join(several, doc_id == F.col(f"{own}id"), "left_semi").withColumn(f"{own}s1", sums("text"))
    again = again.withColumn(f"{own}id", doc_id).join(stay, [f"{own}id", f"{own}s1"], "left_semi")
    return out.union(again.dropDuplicates([f"{own}id", f"{own}s1"]).select(*docs.columns))
