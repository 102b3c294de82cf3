"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Vectors belong to the centroid with the largest cosine (centroids come from a bounded sample; every
vector is indexed). The residual to the centroid is rotated by a random orthogonal matrix and kept as one
bit per dimension with two scalars: its length and its inner product with its own code. From these the
inner product with a query is estimated without bias, and the error is bounded by
``ERROR * sqrt((1 - s * s) / (s * s * (D - 1)))`` times both lengths (s: the second scalar) but for a few
in a thousand vectors. In a block of vectors the k-th largest lower bound is beaten only by vectors whose upper
bound exceeds it: those are scored exactly in double precision.

The k-th best score within the sample is a floor for a query's k-th best of all. It visits every cluster
that could hold more, by its centroid and its largest residual, so nothing is lost by visiting; in a block
only what can reach the floor is kept. Clusters are split into blocks of about ``BLOCK`` vectors and groups
of about ``ASK`` queries by hashed id, so neither a hot cluster nor a vector with many copies makes a large
task, and a task's answer is at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.llm.common import bounded_batches
from tickforge.sources.stored import stored

SAMPLE_ROWS, MOST_CLUSTERS = 20_000, 2048
BLOCK, ASK, ERROR, SEED = 2048, 512, 2.5, 7


@dataclass
class Codebook:
    """Centroids and the rotation; both depend on the dimension and ``MOST_CLUSTERS`` only."""

    centroids: np.ndarray
    rotation: np.ndarray

    @property
    def size(self) -> int:
        return self.rotation.shape[0]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, packed bits, residual length, and inner product of code and unit residual."""
        cluster = (x @ self.centroids.T).argmax(axis=1)
        rest = x - self.centroids[cluster]
        length = np.linalg.norm(rest, axis=1)
        turned = rest @ self.rotation / np.maximum(length, 1e-30)[:, None]
        return cluster, np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(self.size)


def estimates(book: Codebook, cluster: int, codes: np.ndarray, length: np.ndarray, own: np.ndarray,
              queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and error bounds, from codes and scalars alone."""
    d = book.size
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = (queries @ book.rotation).astype(np.float32)
    own = np.maximum(own, 1e-6)
    centre = queries @ book.centroids[cluster]
    estimate = centre[:, None] + (turned @ signs.T) / np.sqrt(d) / own * length
    bound = ERROR * np.sqrt(np.maximum(0, 1 - own * own) / (own * own * max(1, d - 1))) * length
    return estimate, bound[None, :] * np.linalg.norm(queries, axis=1)[:, None] + 1e-5


def learn(sample: np.ndarray, rows: int) -> Codebook:
    """Spherical k-means with a cluster per ``BLOCK`` rows, and a rotation."""
    rng = np.random.default_rng(SEED)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    k = int(min(MOST_CLUSTERS, max(1, len(sample) // 20), max(1, rows // BLOCK)))
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(12):
        at = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros((k, d))
        np.add.at(sums, at, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centroids)
    return Codebook(centroids, rotation)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding array<double>)`` of the rows that take part: an id, a vector that is not null,
    not zero, without null or non-finite components. Of rows that repeat an id the smallest vector counts.
    Vectors of another dimension than the most frequent one can't be compared and take no part."""
    x = F.col("embedding").cast("array<double>")
    good = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    good = stored(good.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the ``k`` rows found
    with the largest inner product, itself excluded, ties to the smaller id."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    sample = np.array([r["embedding"] for r in chosen])
    known = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in chosen], np.int64), sample))  # bounded by SAMPLE_ROWS
    book = spark.sparkContext.broadcast(learn(sample, n))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["embedding"].to_numpy())
                cluster, codes, length, own = book.value.encode(x)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": cluster, "code": [c.tobytes() for c in codes],
                                    "length": length, "own": own, "embedding": list(x)})

    index = stored(rows.mapInPandas(encode, "vec_id bigint, cluster int, code binary, length double, own double, embedding array<double>"), "index")
    radius = np.full(len(book.value.centroids), -np.inf)
    for r in index.groupBy("cluster").agg(F.max("length").alias("radius")).collect():  # at most MOST_CLUSTERS rows
        radius[r["cluster"]] = r["radius"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = known.value
        for batch in batches:
            out = []
            for i, q in zip(batch["vec_id"], batch["embedding"]):
                scores = (x @ q)[ids != i]
                floor = np.partition(scores, -k)[-k] - 1e-9 if len(scores) >= k else -np.inf
                most = book.value.centroids @ q + np.linalg.norm(q) * radius + 1e-9
                out += [(i, int(c), float(floor), q) for c in np.flatnonzero((most >= floor) & (radius > -np.inf))]
            yield pd.DataFrame(out, columns=["query_id", "cluster", "floor", "query"])

    asked = stored(index.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
                   .mapInPandas(probe, "query_id bigint, cluster int, floor double, query array<double>"), "probes")
    groups = asked.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / ASK).cast("int").alias("groups")).join(
        index.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cluster")

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """A row goes to its own part by hash, and there to every part of the other side."""
        return (df.join(groups, "cluster").withColumn(f"{own}_no", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
                .withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("groups", "blocks"))

    def answer(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(block):
            block = block.sort_values("vec_id")
            ids, x = block["vec_id"].to_numpy(), np.stack(block["embedding"].to_numpy())
            q = np.stack(queries["query"].to_numpy())
            codes = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1)
            estimate, bound = estimates(book.value, int(key[0]), codes, block["length"].to_numpy(), block["own"].to_numpy(), q)
            for row, (i, floor, vector) in enumerate(zip(queries["query_id"], queries["floor"], q)):
                lower, upper = estimate[row] - bound[row], estimate[row] + bound[row]
                lower[ids == i] = -np.inf
                least = max(floor, np.partition(lower, -k)[-k] if len(ids) > k else -np.inf)
                again = np.flatnonzero((upper >= least) & (ids != i))
                exact = (x[again] * vector).sum(axis=1)
                best = np.lexsort((ids[again], -exact))[:k]
                out += [(i, int(ids[again[b]]), float(exact[b])) for b in best if exact[b] >= floor]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["cluster", "blocks_no", "groups_no"]
    found = (spread(asked, "query_id", "groups", "blocks").groupBy(*keys)
             .cogroup(spread(index, "vec_id", "blocks", "groups").groupBy(*keys))
             .applyInPandas(answer, "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
