"""Language-model scoring with a hashed maximum-entropy model.

Counts of all training words are one aggregate over the corpus, keyed by a 64-bit hash of the word. The
``CLASSES * MEMBERS`` most frequent words (by rank, ``MEMBERS`` to a class) are predicted by two softmax
factors, class given context and word given class and context; all other words form one more class, in
which a word has its smoothed count. The features of a context are the word before, the word before that
(a skip), and both together; each is hashed to one of ``BUCKETS`` rows of weights, so the model has a
fixed size. The weights start at the unigram model.

Training goes in ``ROUNDS``: each takes a third of the training documents, every task makes gradient
steps over its documents from the common weights, and the changes are averaged by tokens. They meet in
two steps of grouping, in pieces of a fixed size; the driver gets one copy of the model.

Scores are computed in batches of tokens over rows of the weights. The counts of the ``HOT`` most
frequent words go to every task (a fixed size); tokens of all other words travel as hashes to a join
with the full counts, so nothing is dropped at any vocabulary size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import bounded_batches, fold_of
from tickforge.llm.words import mixed, split_words
from tickforge.sources.stored import stored

FOLDS, HELD_OUT = 5, 1
CLASSES, MEMBERS, BUCKETS, HOT = 32, 64, 2048, 131_072
ROUNDS, BATCH, RATE = 3, 4096, 0.15
PIECE = 16_384
AT_ONCE = 64  # texts held as words
SHORT = 8  # rows of a run that is summed row by row
_END, _START = b" end", b" start"  # no word holds a blank
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Counts:
    """Training tokens and distinct tokens; the most frequent words (hash, sorted) with count and rank."""

    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and rank of each word; -1 for words that are not hot."""
        if not len(self.hashes):
            return np.full(len(words), -1), np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        hit = self.hashes[at] == words
        return np.where(hit, self.counts[at], -1), np.where(hit, self.ranks[at], -1)

    @property
    def top(self) -> np.ndarray:
        """Counts of the predicted words by rank."""
        known = self.ranks < CLASSES * MEMBERS
        out = np.zeros(CLASSES * MEMBERS)
        out[self.ranks[known]] = self.counts[known]
        return out


class Reader(dict):
    """Texts as streams of tokens. A word is hashed and looked up once and then known by a small number,
    for up to ``room`` words; the arrays below go by that number."""

    room = 250_000

    def __init__(self, counts: Counts | None = None):
        super().__init__()
        self.known, self.fresh = counts, []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes, self.counts, self.ranks = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def read(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of all texts one after the other, an end after each, and their lengths."""
        if len(self) > self.room:
            self.forget()
        lengths, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
        for at in range(0, len(texts), AT_ONCE):  # words as objects take many times the room of their text
            words = [split_words(t) for t in texts.iloc[at:at + AT_ONCE]]
            for ws in words:
                ws.append(_END)
            sizes = lengths[at:at + AT_ONCE] = np.fromiter(map(len, words), np.int64, len(words))
            parts.append(np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum())))
        numbers = np.concatenate(parts)
        new = np.fromiter(map(xxhash.xxh3_64_intdigest, self.fresh), np.uint64, len(self.fresh))
        self.fresh = []
        self.hashes = np.concatenate((self.hashes, new))
        if self.known is not None:
            count, rank = self.known.find(new)
            self.counts = np.concatenate((self.counts, count))
            self.ranks = np.concatenate((self.ranks, np.where(rank < CLASSES * MEMBERS, rank, -1)))
        return numbers, lengths


def contexts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Three context hashes per token: the word before, the one before that, both."""
    start = mixed(np.array([len(_START)], np.uint64))[0]
    firsts = np.cumsum(lengths) - lengths
    out = np.empty((len(tokens), 3), np.uint64)
    one, two = np.roll(tokens, 1), np.roll(tokens, 2)
    one[firsts] = start
    two[firsts] = start
    two[firsts[lengths > 1] + 1] = start
    out[:, 0] = one
    out[:, 1] = mixed(two + np.uint64(1))
    out[:, 2] = mixed(one * _PRIME + two)
    return out


class MaxEnt:
    """Weights of the class factor and of the member factor: rows of buckets, then rows of biases."""

    def __init__(self, counts: Counts):
        top, self.other = counts.top, max(0.0, counts.tokens - counts.top.sum())
        self.by_class = np.zeros((3 * BUCKETS + 1, CLASSES + 1), np.float32)
        self.by_member = np.zeros((3 * BUCKETS + CLASSES, MEMBERS), np.float32)
        mass = np.append(top.reshape(CLASSES, MEMBERS).sum(1), self.other + 0.5)
        # an empty class or place keeps a weight that makes it impossible
        self.by_class[-1] = np.where(mass > 0, np.log(np.maximum(mass, 1) / mass.sum()), -60)
        cells = top.reshape(CLASSES, MEMBERS)
        self.by_member[3 * BUCKETS:] = np.where(cells > 0, np.log(np.maximum(cells, 1) / np.maximum(1, cells.sum(1))[:, None]), -60)

    def flat(self) -> np.ndarray:
        return np.concatenate((self.by_class.ravel(), self.by_member.ravel()))

    def take(self, flat: np.ndarray) -> None:
        n = self.by_class.size
        self.by_class = flat[:n].reshape(self.by_class.shape).astype(np.float32)
        self.by_member = flat[n:].reshape(self.by_member.shape).astype(np.float32)


def _rows(context: np.ndarray, classes: np.ndarray | None) -> np.ndarray:
    """Rows of the weights of each token: three buckets and the bias."""
    if classes is not None:
        context = mixed(context + (classes.astype(np.uint64) + np.uint64(1))[:, None] * _PRIME)
    buckets = (context % np.uint64(BUCKETS)).astype(np.int64) + np.arange(3) * BUCKETS
    bias = np.zeros(len(context), np.int64) if classes is None else classes
    return np.column_stack((buckets, 3 * BUCKETS + bias))


def _chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[:, 0], axis=0)
    for k in range(1, 4):
        z += weights.take(rows[:, k], axis=0)
    np.minimum(z, 60, out=z)  # keeps the exponentials finite
    np.exp(z, out=z)
    z *= 1 / np.maximum(z @ np.ones(z.shape[1], np.float32), np.float32(1e-30))[:, None]
    return z


def _sums(g: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``g[order]`` that begin at ``first``. Most runs are short; those up to ``SHORT`` rows are added row by
    row for all runs at once, in the order of ``reduceat`` (the first to the sum of the others), so the sums are the same."""
    if len(first) == 1:
        return g.sum(axis=0, keepdims=True)
    sizes = np.diff(first, append=len(order))
    out = np.empty((len(first), g.shape[1]), g.dtype)
    long = sizes > SHORT
    if long.any():
        rows, lengths = order[np.repeat(long, sizes)], sizes[long]
        out[long] = np.add.reduceat(g.take(rows, axis=0), np.cumsum(lengths) - lengths, axis=0)
    runs = np.flatnonzero(~long)
    runs = runs.take(np.argsort(-sizes.take(runs), kind="stable"))
    begins, sizes = first.take(runs), sizes.take(runs)
    n = int(np.count_nonzero(sizes > 1))
    others = g.take(order.take(begins[:n] + 1), axis=0)
    for k in range(2, SHORT):
        more = int(np.count_nonzero(sizes > k))
        others[:more] += g.take(order.take(begins[:more] + k), axis=0)
    short = g.take(order.take(begins), axis=0)
    short[:n] += others
    out[runs] = short
    return out


def _descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, right: np.ndarray) -> None:
    """One step on a batch, for the biases and all three features: adaptive rate per row, gradients of equal
    rows summed first."""
    g = _chances(weights, rows)
    g[np.arange(len(g)), right] -= 1
    share = np.full(g.shape[1], 1 / g.shape[1], np.float32)
    for k in range(4):
        low = int(rows[:, k].min())
        order = np.argsort((rows[:, k] - low).astype(np.uint16), kind="stable")  # a sort by digits
        at = rows[:, k].take(order)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        here = at.take(first)
        total = _sums(g, order, first)
        squares[here] += (total * total) @ share
        total *= (RATE / np.sqrt(squares.take(here) + 1))[:, None]
        weights[here] -= total


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, count)`` of the tokens of ``docs(text)``: tasks count before anything is shuffled."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, totals = Reader(), np.zeros(0, np.int64)
        for batch in batches:
            if len(reader) > reader.room:
                yield pd.DataFrame({"word": reader.hashes.view(np.int64), "n": totals})
                totals = np.zeros(0, np.int64)
            seen = np.bincount(reader.read(batch["text"])[0], minlength=len(reader))
            seen[:len(totals)] += totals
            totals = seen
        if len(totals):
            yield pd.DataFrame({"word": reader.hashes.view(np.int64), "n": totals})

    return docs.select("text").mapInPandas(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("count"))


def hot_counts(counts: DataFrame) -> Counts:
    """Totals, and the ``HOT`` most frequent words (2 MB at most)."""
    totals = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("count"), "word").limit(HOT).toPandas()
    word = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    return Counts(int(totals["n"] or 0), int(totals["v"] or 0), word[order], top["count"].to_numpy(np.int64)[order], order)


def _summed(changes: DataFrame, tasks: int) -> DataFrame:
    """Sum of the pieces ``(piece, task, tokens, values)``, first within about sqrt(tasks) groups."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["values"].iloc[0]) // 4, np.float32)
        for v in rows["values"]:
            total += np.frombuffer(v, np.float32)
        return pd.DataFrame({"piece": [key[0]], "task": [key[-1]], "tokens": [rows["tokens"].sum()], "values": [total.tobytes()]})

    schema = "piece int, task int, tokens double, values binary"
    groups = int(np.ceil(np.sqrt(max(1, tasks))))
    part = changes.withColumn("task", F.col("task") % groups).groupBy("piece", "task").applyInPandas(add, schema)
    return part.withColumn("task", F.lit(0)).groupBy("piece", "task").applyInPandas(add, schema)


def train(docs: DataFrame, counts: Counts) -> MaxEnt:
    """Fit on all of ``docs(doc_id, text)``. Without documents the model is the (empty) unigram model."""
    spark, model = docs.sparkSession, MaxEnt(counts)
    if not counts.tokens:
        return model
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(counts)
    for turn in range(ROUNDS):
        mine = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == turn).select("text")
        now = spark.sparkContext.broadcast(model)

        def descend(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            local, reader, seen = MaxEnt(known.value), Reader(known.value), 0
            before = now.value.flat()
            local.take(before)
            squares = [np.zeros(len(w), np.float32) for w in (local.by_class, local.by_member)]
            for batch in batches:
                tokens, lengths = reader.read(batch["text"])
                context = contexts(reader.hashes[tokens], lengths)
                rank = reader.ranks[tokens]
                for i in range(0, len(tokens), BATCH):
                    r, c = rank[i:i + BATCH], context[i:i + BATCH]
                    _descend(local.by_class, squares[0], _rows(c, None), np.where(r >= 0, r // MEMBERS, CLASSES))
                    if (inside := r >= 0).any():
                        _descend(local.by_member, squares[1], _rows(c[inside], r[inside] // MEMBERS), r[inside] % MEMBERS)
                seen += len(tokens)
            if seen:
                change = (local.flat() - before) * np.float32(seen)
                task = TaskContext.get().partitionId()
                yield pd.DataFrame([(p, task, float(seen), change[p * PIECE:(p + 1) * PIECE].tobytes()) for p in range(-(-len(change) // PIECE))],
                                   columns=["piece", "task", "tokens", "values"])

        changes = mine.mapInPandas(descend, "piece int, task int, tokens double, values binary")
        rows = sorted(_summed(changes, mine.rdd.getNumPartitions()).collect(), key=lambda r: r["piece"])
        if rows:
            change = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]) / np.float32(rows[0]["tokens"])
            model.take(model.flat() + change)
        now.unpersist()
    return model


def score(docs: DataFrame, counts: Counts, table: DataFrame, model: MaxEnt) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs``.

    A null text is empty and has one token, the end. Repeated rows and ids stay rows of their own."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known, sent = spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(model)
    smooth = float(counts.tokens + 0.5 * (counts.distinct + 1))
    top = int(np.count_nonzero(counts.top))
    log_other = float(np.log10(model.other + 0.5 * (counts.distinct - top + 1)))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, m = Reader(known.value), sent.value
        for batch in batches:
            numbers, lengths = reader.read(batch["text"])
            doc = np.repeat(np.arange(len(lengths)), lengths)
            tokens, count, rank = reader.hashes[numbers], reader.counts[numbers], reader.ranks[numbers]
            context = contexts(tokens, lengths)
            logs = np.zeros(len(tokens))
            for i in range(0, len(tokens), BATCH):
                r, c = rank[i:i + BATCH], context[i:i + BATCH]
                cls = np.where(r >= 0, r // MEMBERS, CLASSES)
                at = np.arange(len(r))
                p = _chances(m.by_class, _rows(c, None))[at, cls].astype(np.float64)
                if (inside := r >= 0).any():
                    q = _chances(m.by_member, _rows(c[inside], cls[inside]))
                    p[inside] *= q[np.arange(len(q)), r[inside] % MEMBERS]
                logs[i:i + BATCH] = np.log10(np.maximum(p, 1e-300))
            hot, n = count >= 0, len(lengths)
            base = np.where(hot, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            logs += np.where(rank < 0, base - log_other, 0.0)  # a word's share of the last class
            rare = tokens[~hot].view(np.int64)
            cuts = np.cumsum(np.bincount(doc[~hot], minlength=n))[:-1]
            yield pd.DataFrame({"uid": batch["uid"], "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n": lengths,
                                "known": np.bincount(doc[hot], minlength=n), "base": np.bincount(doc, base, n),
                                "score": np.bincount(doc, logs, n), "rare": np.split(rare, cuts)})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text",
                       (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    parts = stored(rows.mapInPandas(evaluate, "uid bigint, doc_id bigint, held_out boolean, n bigint, known bigint, base double, "
                                              "score double, rare array<bigint>"), "scored")
    far = parts.select("uid", F.explode("rare").alias("word")).join(table, "word", "left")
    of_far = far.select("uid", F.col("count").isNotNull().cast("long").alias("known"),
                        F.log10(F.coalesce("count", F.lit(0)) + 0.5).alias("base"))
    blank = {"doc_id": F.lit(None).cast("long"), "held_out": F.lit(None).cast("boolean"), "n": F.lit(None).cast("long")}
    every = parts.select("uid", "doc_id", "held_out", "n", "known", "base", "score").unionByName(
        of_far.groupBy("uid").agg(F.sum("known").alias("known"), F.sum("base").alias("base"))
        .withColumns(blank | {"score": F.col("base")}))
    return every.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("b"), F.sum("score").alias("score")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("b") - F.col("n_tokens") * float(np.log10(smooth))).alias("base_score"), "score")


def score_all(docs: DataFrame) -> DataFrame:
    """Count, train and score: every row of ``docs``, learned from those outside the held-out fold."""
    taught = docs.where(fold_of("doc_id", FOLDS) != HELD_OUT)
    table = stored(count_words(taught), "counts")
    counts = hot_counts(table)
    return score(docs, counts, table, train(taught.select("doc_id", "text"), counts))
