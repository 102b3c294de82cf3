"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence has the chance ``p = logistic(bias + weights of its features)`` of being toxic; a document is
toxic unless every sentence is clean and nothing leaks: ``1 - (1 - leak) * product(1 - p)`` (noisy-or).
Only documents carry labels, so the gradient of the document's likelihood decides which sentences take
the blame, and afterwards the sentence chances say where the offence is. The leak takes labels that no
sentence explains, so they don't lift the bias of all sentences.

Features are the distinct words of a sentence and the beginnings of four to seven letters of each
(inflected forms share a stem). Which of them count is screened on document frequencies by label with the likelihood-ratio statistic.
Labels are learned from a bounded sample (``sample_rows``: the labelled rows whose hashed id is
smallest); every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import bounded_batches, fold_of, one_label
from tickforge.sources.stored import stored

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT, THRESHOLD, OFFENDING = 4, 2, 0.3, 0.5
STEMS, MOST_FEATURES, LEAST_DOCS, LEAST_EVIDENCE = (4, 5, 6, 7), 4096, 4, 20.0
STEPS, STEP_SIZE, SHRINK = 400, 0.15, 0.002
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """The word and, marked by ``^``, its beginnings."""
    return [word] + ["^" + word[:n] for n in STEMS if n < len(word)]


class WordWeights(dict):
    """Sum of the weights of a word's features, remembered for up to ``room`` words."""

    room = 300_000

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= self.room:
            self.clear()
        total = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return total


@dataclass
class SentenceModel:
    """``weights`` by feature; ``leak`` and the sentence ``bias``."""

    weights: dict[str, float]
    bias: float
    leak: float

    def chances(self, text: str | None, known: WordWeights | None = None) -> Iterator[tuple[int, int, float]]:
        """``(start, end, chance)`` of each sentence."""
        known = WordWeights(self.weights) if known is None else known
        for m in _SENTENCE.finditer(text or ""):
            z = self.bias + sum(map(known.__getitem__, set(_WORD.findall(m[0].lower()))))
            yield m.start(), m.end(), 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))

    def score(self, text: str | None, known: WordWeights | None = None) -> tuple[float, int, int, int]:
        """Document score, number of offending sentences, and the place of the worst (-1 without one)."""
        clean, offending, worst, place = 1 - self.leak, 0, OFFENDING, (-1, -1)
        for start, end, p in self.chances(text, known):
            clean *= 1 - p
            offending += p >= OFFENDING
            if p >= worst and (p > worst or place[0] < 0):
                worst, place = p, (start, end)
        return 1 - clean, offending, *place


def fit(bags: list[tuple[int, int, list[list[int]]]], features: list[str]) -> SentenceModel:
    """Full-batch Adam on ``(label, sentences without a feature, feature numbers of the others)``. Without
    any row the score is 0 throughout."""
    if not bags:
        return SentenceModel({}, -30.0, 0.0)
    y = np.array([b[0] for b in bags], float)
    plain = np.array([b[1] for b in bags], float)
    doc_of, sentence_of, feature_of, s = [], [], [], 0
    for d, (_, _, sentences) in enumerate(bags):
        for ids in sentences:
            doc_of.append(d)
            sentence_of += [s] * len(ids)
            feature_of += ids
            s += 1
    doc_of, sentence_of, feature_of = (np.array(v, np.int64) for v in (doc_of, sentence_of, feature_of))
    n, k = len(y), len(features)
    theta = np.concatenate((np.full(k, 1.0), [-6.0, np.log((y.mean() + 0.01) / (1.02 - y.mean() - 0.01)) - 1]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, bias, leak = theta[:k], theta[k], 1 / (1 + np.exp(-theta[k + 1]))
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sentence_of, w[feature_of], s), -30, 30)))
        p0 = 1 / (1 + np.exp(-bias))
        log_clean = np.log(1 - leak) + np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + plain * np.log1p(-p0)
        clean = np.exp(log_clean)
        blame = np.where(y == 1, -clean / np.maximum(1e-12, 1 - clean), 1.0)  # derivative by -log_clean
        by_sentence = blame[doc_of] * p
        g = np.concatenate((np.bincount(feature_of, by_sentence[sentence_of], k), [by_sentence.sum() + (blame * plain).sum() * p0, blame.sum() * leak])) / n
        g[:k] += SHRINK / n * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - STEP_SIZE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        theta[:k] = np.maximum(theta[:k], 0.0)
    return SentenceModel({f: float(x) for f, x in zip(features, theta[:k]) if x > 1e-3}, float(theta[k]), float(1 / (1 + np.exp(-theta[k + 1]))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> SentenceModel:
    """Screen features, then fit. The driver gets at most ``MOST_FEATURES`` features and, of at most
    ``sample_rows`` texts, the numbers of those features; texts stay on the executors."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = (one_label(labels, label).where(fold_of("doc_id", FOLDS) != HELD_OUT)
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")  # bounded by sample_rows

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(batch["text"], batch["label"]):
                counts[y].update({f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"feature": names, "clean": [counts[0][f] for f in names], "toxic": [counts[1][f] for f in names]})

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"] or 0, totals["toxic"] or 0
    base = max(toxic / n, 1e-9) if n else 1.0
    seen = rows.mapInPandas(counted, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_DOCS)
    rate = F.col("toxic") / (F.col("clean") + F.col("toxic"))
    evidence = 2 * (F.col("toxic") * F.log(rate / base) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / max(1e-9, 1 - base))).otherwise(F.lit(0.0)))
    features = [r["feature"] for r in seen.where((rate > base) & (evidence >= LEAST_EVIDENCE))
                .orderBy(evidence.desc(), "feature").limit(MOST_FEATURES).select("feature").collect()]
    numbers = {f: i for i, f in enumerate(features)}

    def bagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, y in zip(batch["doc_id"], batch["text"], batch["label"]):
                plain, sentences = 0, []
                for m in _SENTENCE.finditer(text or ""):
                    ids = sorted(numbers[f] for w in set(_WORD.findall(m[0].lower())) for f in word_features(w) if f in numbers)
                    plain += not ids
                    sentences += [ids] if ids else []
                out.append((doc_id, int(y), plain, sentences))
            yield pd.DataFrame(out, columns=["doc_id", "label", "plain", "sentences"])

    bags = rows.mapInPandas(bagged, "doc_id bigint, label int, plain int, sentences array<array<int>>").orderBy("doc_id", "plain").toPandas()
    return fit([(int(y), int(p), [list(map(int, x)) for x in s]) for y, p, s in zip(bags["label"], bags["plain"], bags["sentences"])], features)


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """``docs`` with ``toxicity struct<score, offending, worst_start, worst_end>`` of each whole text; null
    counts as empty, an empty text has the leak alone. Row by row: repeated ids and extra columns do no harm."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    @F.pandas_udf("score double, offending int, worst_start int, worst_end int")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordWeights(sent.value.weights)
        for texts in parts:
            yield pd.DataFrame([sent.value.score(t, known) for t in texts], columns=["score", "offending", "worst_start", "worst_end"])

    return docs.withColumn("toxicity", scored(F.col("text")))


def offending_sentences(docs: DataFrame, model: SentenceModel, least: float = OFFENDING) -> DataFrame:
    """``(doc_id, start, end, chance, sentence)`` of every sentence with a chance of ``least`` or more."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordWeights(sent.value.weights)
        for batch in batches:
            yield pd.DataFrame([(i, a, b, p, t[a:b]) for i, t in zip(batch["doc_id"], batch["text"])
                                for a, b, p in sent.value.chances(t, known) if p >= least],
                               columns=["doc_id", "start", "end", "chance", "sentence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        locate, "doc_id bigint, start int, end int, chance double, sentence string")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted, offending, worst_start, worst_end)`` of every row of ``docs``."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels, label))
    return rows.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("toxicity.score").alias("score"),
                       (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"),
                       "toxicity.offending", "toxicity.worst_start", "toxicity.worst_end")
