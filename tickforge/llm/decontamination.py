"""Benchmark decontamination by greedy string tiling.

A seed is a run of ``SEED_WORDS`` words. The seeds of the benchmark are marked in a bitmap of a fixed
size, which every task gets; a document's seeds that hit it are joined with the benchmark's seeds on
hash and words. So a text never moves, only its hits do, and the benchmark may be of any size: a fuller
bitmap lets more seeds into the join and changes no result.

Seeds on one diagonal (document place minus item place) chain to the longest common runs. Tiling takes
the longest run whose words are free on both sides, marks them, cuts what overlaps, and goes on until
no run of ``SEED_WORDS`` is left. The share of an item's words under tiles is its coverage; as tiles
may lie in any order, a passage with its sentences shuffled is covered like one in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import bounded_batches, unused
from tickforge.llm.words import WordHashes, rolled, word_numbers
from tickforge.sources.stored import stored

#: Half, as sentences of fewer words than a seed have no tile once a passage is shuffled.
SEED_WORDS, COVERAGE = 5, 0.5
#: The bitmap has 2 ** BITS places: 2 MB, whatever the benchmark.
BITS, CHUNK = 24, 32768
#: What a worker holds beside its batch: rows to hand on, and words whose hashes it remembers.
HITS, WORDS = 8192, 40_000
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation; [] for null."""
    return text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split() if text else []


def tiles(document: np.ndarray, item: np.ndarray, size: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """``(document place, item place, words)`` of the tiles, longest first (ties: smaller item place,
    then smaller document place), from the places of equal seeds."""
    order = np.lexsort((item, document - item))
    document, item = document[order], item[order]
    new = np.ones(len(item), bool)
    new[1:] = (np.diff(document) != 1) | (np.diff(item) != 1)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(item))) + size - 1
    heap = [(-int(n), int(item[s]), int(document[s])) for s, n in zip(starts, lengths)]
    heapq.heapify(heap)
    ends = (int(document.max()) + size, int(item.max()) + size) if len(item) else (0, 0)
    taken_d, taken_i = np.zeros(ends[0], bool), np.zeros(ends[1], bool)
    out = []
    while heap:
        n, i, d = heapq.heappop(heap)
        free = ~(taken_d[d:d - n] | taken_i[i:i - n])
        if free.all():
            taken_d[d:d - n] = taken_i[i:i - n] = True
            out.append((d, i, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for lo, hi in zip(edges[::2], edges[1::2]):
            if hi - lo >= size:
                heapq.heappush(heap, (-int(hi - lo), i + int(lo), d + int(lo)))
    return out


def item_seeds(items: DataFrame) -> DataFrame:
    """``(item_id, item_words, place, seed, words)``; an item of fewer words than a seed has none. Rows
    that repeat an item are one."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for item_id, text in zip(batch["item_id"], batch["text"]):
                words = plain_words(text)
                for k, seed in enumerate(rolled(word_numbers(words, hashes), SEED_WORDS).view(np.int64)):
                    out.append((item_id, len(words), k, int(seed), b" ".join(words[k:k + SEED_WORDS])))
            yield pd.DataFrame(out, columns=["item_id", "item_words", "place", "seed", "words"])

    rows = items.where(F.col("item_id").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    return rows.mapInPandas(cut, "item_id bigint, item_words int, place int, seed bigint, words binary")


def seed_bitmap(spark: SparkSession, seeds: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of a seed, lowest first, built by Spark in chunks of 4 KB: 2 MB reach the driver."""
    at = F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1))
    chunks = (seeds.select(F.shiftright(at, 15).alias("chunk"), at.bitwiseAND(F.lit(CHUNK - 1)).alias("bit"))
              .groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for row in chunks:
        out[row.chunk * CHUNK >> 3:(row.chunk + 1) * CHUNK >> 3] = np.frombuffer(row.bits, np.uint8)
    return out


def seed_hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, place, seed, words)`` of the document seeds that the bitmap lets through.

    A worker keeps the bits packed, as they came, and no more than ``HITS`` rows and ``WORDS`` words beside its batch."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(seed_bitmap(spark, seeds))
    names = ["doc_id", "text_hash", "place", "seed", "words"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, marked = WordHashes(), sent.value
        hashes.room = WORDS
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = plain_words(text)
                found = rolled(word_numbers(words, hashes), SEED_WORDS)
                at = (found & np.uint64((1 << BITS) - 1)).astype(np.int64)
                places = np.flatnonzero((marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                if len(places):
                    name = hashes[text.encode("utf-8", "replace")] >> 1
                    for k in places:
                        out.append((doc_id, name, int(k), int(found[k].view(np.int64)), b" ".join(words[k:k + SEED_WORDS])))
                        if len(out) == HITS:
                            yield pd.DataFrame(out, columns=names)
                            out = []
            yield pd.DataFrame(out, columns=names)

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInPandas(
        scan, "doc_id bigint, text_hash bigint, place int, seed bigint, words binary")


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, item_words, covered, coverage, tiles)`` of each document and benchmark item whose
    words are covered to ``coverage`` at least.

    Rows without an id take no part. Null and empty texts contain nothing. Of rows that repeat a doc_id
    each text is tiled by itself and the best one is reported.
    """
    seeds = stored(item_seeds(items), "seeds")
    hits = seed_hits(docs, seeds).distinct()
    pairs = hits.join(seeds.withColumnRenamed("place", "item_place"), ["seed", "words"]).groupBy(
        "doc_id", "text_hash", "item_id", "item_words").agg(F.collect_list(F.struct("place", "item_place")).alias("places"))
    # a pair of texts bounds its list; what can't reach the coverage is left out before tiling
    pairs = pairs.select("doc_id", "item_id", "item_words", F.col("places.place").alias("d"), F.col("places.item_place").alias("i")).where(
        (F.size(F.array_distinct("i")) * SEED_WORDS >= F.col("item_words") * coverage))

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                found = tiles(np.asarray(row.d, np.int64), np.asarray(row.i, np.int64))
                covered = sum(n for _, _, n in found)
                out.append((row.doc_id, row.item_id, row.item_words, covered, covered / row.item_words, len(found)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"])

    rows = pairs.mapInPandas(tile, "doc_id bigint, item_id bigint, item_words int, covered int, coverage double, tiles int")
    best = F.struct("covered", -F.col("tiles"))
    return (rows.where(F.col("coverage") >= coverage).groupBy("doc_id", "item_id", "item_words").agg(F.max(best).alias("b"))
            .select("doc_id", "item_id", "item_words", F.col("b.covered").alias("covered"),
                    (F.col("b.covered") / F.col("item_words")).alias("coverage"), (-F.col("b.col2")).alias("tiles")))


def without_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, columns unchanged; rows without an id stay."""
    own = unused(docs)
    bad = stored(contaminated(docs, items, coverage).select(F.col("doc_id").alias(own)).distinct(), "leaks")
    return docs.join(bad, F.col("doc_id").cast("long") == F.col(own), "left_anti")
