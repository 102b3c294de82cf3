"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few numbers (shares of character kinds, word and line repetition). Each number is
cut into bins at its quantiles. Shallow trees are boosted in turn, one feature at a time, each on the
gradient that the others leave; a tree over the bins of one feature is a step in that feature's
lookup table, so the sum of all trees is one table per feature. The pairs of features that explain
most of the remaining gradient get a table over both their bins. A score is the logistic function of
the sum of the looked-up cells.

Labels are learned from a bounded sample (``sample_rows``: the rows whose hashed id is smallest);
every text is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import bounded_batches, fold_of, one_label, unused

SAMPLE_ROWS = 20_000
MAX_BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, PATIENCE, RATE = 240, 120, 25, 0.12
MIN_ROWS, SHRINK = 12, 2.0
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

FEATURES = ("log_length", "upper", "digits", "symbols", "stops", "blanks", "breaks", "wide", "word_length",
            "short_words", "distinct", "top_word", "next_same", "line_repeats", "line_words", "odd_ends", "pair_repeats")


def _kinds() -> np.ndarray:
    """Kind of each UTF-8 byte: 0 lower, 1 upper, 2 digit, 3 symbol, 4 stop, 5 blank, 6 break, 7 wide."""
    kinds = np.full(256, 3, np.uint8)
    kinds[ord("a"):ord("z") + 1], kinds[ord("A"):ord("Z") + 1], kinds[ord("0"):ord("9") + 1] = 0, 1, 2
    kinds[[ord(c) for c in ".,;:?'\"-"]] = 4
    kinds[[9, 11, 12, 13, 32]], kinds[10], kinds[128:] = 5, 6, 7
    return kinds


def text_features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES``; an empty or null text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_kinds()[raw], minlength=8) / len(raw)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    odd = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,;:?'\"-)"))
    return [float(np.log1p(len(text))), share[1] / max(1e-9, share[0] + share[1] + share[7]), share[2], share[3], share[4],
            share[5], share[6], share[7], float(lengths.mean()), float((lengths <= 3).mean()),
            len(counts) / n, max(counts.values(), default=0) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), odd / n,
            1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0]


def feature_matrix(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    """``base`` plus one table per feature and per pair; ``cuts`` are the upper edges of the bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cut, cells) in enumerate(zip(self.cuts, self.tables)):
            out += cells[np.searchsorted(cut, x[:, j], "left")]
        for (a, b), cells in zip(self.pairs, self.pair_tables):
            out += cells[np.searchsorted(self.pair_cuts[a], x[:, a], "left"), np.searchsorted(self.pair_cuts[b], x[:, b], "left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _step(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of two levels over ordered bins: the best cut, then the best cut of either side."""
    out = np.zeros(len(g))

    def grow(lo: int, hi: int, depth: int) -> None:
        gs, hs, ns = g[lo:hi].cumsum(), h[lo:hi].cumsum(), n[lo:hi].cumsum()
        if depth and hi - lo > 1:
            fit = (ns[:-1] >= MIN_ROWS) & (ns[-1] - ns[:-1] >= MIN_ROWS)
            gain = np.where(fit, _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]), -1)
            k = int(gain.argmax())
            if gain[k] > _gain(gs[-1], hs[-1]) + 1e-9:
                grow(lo, lo + k + 1, depth - 1)
                grow(lo + k + 1, hi, depth - 1)
                return
        out[lo:hi] = gs[-1] / (hs[-1] + SHRINK)

    grow(0, len(g), 2)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of one axis followed by a cut of the other on each side; gain and cells."""
    best, cells = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        ga, ha = a.cumsum(0), b.cumsum(0)
        for k in range(len(a) - 1):
            total, part = 0.0, np.zeros_like(a)
            for rows, gs, hs in ((slice(0, k + 1), ga[k], ha[k]), (slice(k + 1, None), ga[-1] - ga[k], ha[-1] - ha[k])):
                left_g, left_h = gs.cumsum()[:-1], hs.cumsum()[:-1]
                gain = _gain(left_g, left_h) + _gain(gs.sum() - left_g, hs.sum() - left_h)
                if not len(gain):
                    continue
                m = int(gain.argmax())
                total += gain[m]
                part[rows, : m + 1] = left_g[m] / (left_h[m] + SHRINK)
                part[rows, m + 1:] = (gs.sum() - left_g[m]) / (hs.sum() - left_h[m] + SHRINK)
            if total > best:
                best, cells = total, part.T if turned else part
    return best, cells


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost on four fifths of the rows and keep the round that is best on the last fifth.

    Without rows the model says 0.5; with one label only it says how often that label came (add-one)."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 5 * MIN_ROWS or y.min() == y.max():
        return AdditiveModel(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    inner = np.arange(len(y)) % 5 != 0
    cuts, coarse = [_cuts(c, MAX_BINS) for c in x.T], [_cuts(c, PAIR_BINS) for c in x.T]
    bins = [np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)]
    wide = [np.searchsorted(c, v, "left") for c, v in zip(coarse, x.T)]
    model = AdditiveModel(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [], coarse, [])
    at = np.full(len(y), base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-at))
        return np.where(inner, y - p, 0.0), np.where(inner, p * (1 - p), 0.0)

    def loss() -> float:
        p = 1 / (1 + np.exp(-at[~inner]))
        return float(-np.mean(np.log(np.where(y[~inner] == 1, p, 1 - p) + 1e-12)))

    def boosted(tables: list[np.ndarray], one_turn, rounds: int) -> None:
        nonlocal at
        best, since, kept, kept_at = loss(), 0, [t.copy() for t in tables], at.copy()
        for _ in range(rounds):
            one_turn()
            if (now := loss()) < best - 1e-6:
                best, since, kept, kept_at = now, 0, [t.copy() for t in tables], at.copy()
            elif (since := since + 1) >= PATIENCE:
                break
        tables[:], at = kept, kept_at

    def features_once() -> None:
        nonlocal at
        for j, b in enumerate(bins):
            g, h = residual()
            size = len(cuts[j]) + 1
            step = RATE * _step(np.bincount(b, g, size), np.bincount(b, h, size), np.bincount(b, inner, size))
            model.tables[j] += step
            at = at + step[b]

    boosted(model.tables, features_once, ROUNDS)

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = residual()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = wide[a] * shape[1] + wide[b]
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    every = [(a, b) for a in range(len(FEATURES)) for b in range(a + 1, len(FEATURES))]
    gains = [_pair_step(*grids(a, b)[1:])[0] for a, b in every]
    model.pairs = [every[i] for i in np.argsort(gains)[::-1][:PAIRS]]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]

    def pairs_once() -> None:
        nonlocal at
        for k, (a, b) in enumerate(model.pairs):
            cell, g, h = grids(a, b)
            step = RATE * _pair_step(g, h)[1]
            model.pair_tables[k] += step
            at = at + step.ravel()[cell]

    boosted(model.pair_tables, pairs_once, PAIR_ROUNDS)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold. Only their numbers, 17 a
    row, reach the driver."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = (one_label(labels, label).where(fold_of("doc_id", FOLDS) != HELD_OUT)
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by sample_rows

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": list(feature_matrix(batch["text"]))})

    got = rows.mapInPandas(numbers, "doc_id bigint, label int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    got = got.iloc[np.argsort(got["doc_id"].to_numpy() * 2654435761 % 4294967296, kind="stable")]
    x = np.array(list(got["x"]), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: AdditiveModel, into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a null text counts as empty. No shuffle, no join:
    repeated ids and extra columns do no harm."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers, whatever the corpus

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(feature_matrix(texts)))

    return docs.withColumn(into, scored(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels, label))
    return rows.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    at = unused(docs)
    return score(docs, train(docs, labels), at).where(F.col(at) >= THRESHOLD).select(*docs.columns)
