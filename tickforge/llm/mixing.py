"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

The corpus is reduced once to cells (source, language, topic) with their tokens; a task sends one row
per cell, so a source with a third of all documents costs no more than any other. Raking multiplies the
cells by target / current of one margin after the other until all margins hold. A document is then
taken with probability ``min(1, level * raked / tokens)`` of its cell; the level is the one at which the
expected tokens equal the budget, so cells that are exhausted hand their share to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.llm.common import unused
from tickforge.sources.stored import discard, stored

MARGINS = ("source", "lang", "topic")
BUDGET, TEMPERATURE, SEED = 0.5, 0.5, "mix-1"
TOLERANCE, ROUNDS, MOST_ROUNDS = 1e-9, 6, 60
#: So many cells fit one task; they are as many as sources, languages and topics make, not documents.
FEW_CELLS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
TOPICS = {"legal": 0.05, "contact": 0.1, "table": 0.1, "note": 0.15, "prose": 0.6}


def topic_of(text: Column) -> Column:
    """Topic by plain cues in the text, first that fits; null and empty texts are notes."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.contains("Licen") | text.contains("Copyright"), "legal")
            .when(text.contains("@"), "contact").when(text.contains(" | "), "table")
            .when(F.length(text) < 400, "note").otherwise("prose"))


def described(docs: DataFrame, own: str = "_") -> DataFrame:
    """``docs`` columns plus ``_source``, ``_lang``, ``_topic``, ``_tokens`` (beginning with ``own``); null values of a margin
    are one value, ''."""
    return docs.withColumns({f"{own}source": F.coalesce(F.col("source").cast("string"), F.lit("")),
                             f"{own}lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), f"{own}topic": topic_of(F.col("text")),
                             f"{own}tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")})


def cells_of(docs: DataFrame) -> DataFrame:
    """``(source, lang, topic, tokens)`` with ``share`` (of all tokens) of the cells that hold tokens."""
    rows = described(docs.select("source", "lang", "text")).groupBy(
        F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(
        F.sum("_tokens").alias("tokens")).where("tokens > 0")
    return stored(rows, "cells")


def shares(spark: SparkSession, given: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in given.items()], "value string, weight double")


def targets(cells: DataFrame, margin: str, given: DataFrame) -> DataFrame:
    """``cells`` with ``_goal_<margin>``, summing to 1 over the values that occur. A value that
    ``given(value, weight)`` does not name keeps its own share of the tokens; the named ones divide the rest
    by weight."""
    now = (cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).join(given, "value", "left"))
    every = Window.partitionBy()  # one row per value of a margin
    own = F.coalesce(F.sum(F.when(F.col("weight").isNull(), F.col("t"))).over(every), F.lit(0.0))
    total, weights = F.sum("t").over(every), F.sum("weight").over(every)
    goal = F.coalesce(F.col("weight") * (1 - own / total) / weights, F.col("t") / total)
    return cells.join(now.select(F.col("value").alias(margin), goal.alias(f"_goal_{margin}")), margin)


def tempered(cells: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Weights of sources by tokens to a power below 1: small sources count more than their size."""
    return cells.groupBy(F.col("source").alias("value")).agg(F.pow(F.sum("tokens"), F.lit(temperature)).alias("weight"))


def rake(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``raked``: shares that meet the targets ``wanted[margin](value, weight)``.

    Every round is a job of its own over a written table, so that plans stay at three windows: the driver plans each job anew
    and keeps a copy of its plan after each of its stages. Up to ``FEW_CELLS`` cells are raked in one task, whose windows need no
    exchange; more are dealt out by each margin in turn. After each ``ROUNDS`` rounds the loop stops if the last one moved no
    cell by more than ``TOLERANCE`` of itself. Targets that contradict each other (an empty cell where two margins need
    one) leave the last margin exact after ``MOST_ROUNDS``."""
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    for margin, given in wanted.items():
        now = targets(now, margin, given)
    now = stored(now, "goals")
    few = now.count() <= FEW_CELLS
    for k in range(1, MOST_ROUNDS + 1):
        before = now
        now = (now.coalesce(1) if few else now).withColumn("_before", F.col("raked"))
        for margin in wanted:
            held = F.sum("raked").over(Window.partitionBy(margin))
            now = now.withColumn("raked", F.col("raked") * F.col(f"_goal_{margin}") / held)
        now = stored(now, "raked")
        discard(before)
        if k % ROUNDS == 0:
            off = now.agg(F.max(F.abs(F.col("raked") / F.col("_before") - 1))).first()[0]
            if off is None or off < TOLERANCE:
                break
    return now.select(*cells.columns, "raked")


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with ``probability``: expected tokens are ``budget`` of all. Every step moves exhausted
    cells to probability 1 and divides what is left, until no more are exhausted."""
    want = budget * float(raked.agg(F.sum("tokens")).first()[0] or 0)
    level, full = 0.0, -1
    rate = F.col("raked") / F.col("tokens")
    while True:
        out = raked.agg(F.sum((rate * level >= 1).cast("long")).alias("full"), F.sum(F.when(rate * level >= 1, F.col("tokens"))).alias("used"),
                        F.sum(F.when(rate * level >= 1, 0.0).otherwise(F.col("raked"))).alias("left")).first()
        if not out["left"] or out["full"] == full:
            break
        full, level = out["full"], (want - float(out["used"] or 0)) / out["left"]
    return raked.withColumn("probability", F.least(F.lit(1.0), rate * level))


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id and ``SEED`` alone: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def mixed(docs: DataFrame, wanted: dict[str, DataFrame] | None = None, budget: float = BUDGET, own: str = "_") -> DataFrame:
    """The sampled rows of ``docs`` with ``_source``, ``_lang``, ``_topic``, ``_tokens``, ``_probability`` (beginning with ``own``).

    Without ``wanted`` sources are tempered and languages and topics take the shares above. Documents
    without a word belong to no cell and go. Repeated rows share their fate, as it depends on the id.
    """
    spark, cells = docs.sparkSession, cells_of(docs)
    if wanted is None:
        wanted = {"source": tempered(cells), "lang": shares(spark, LANGUAGES), "topic": shares(spark, TOPICS)}
    rates = stored(probabilities(rake(cells, wanted), budget).select(
        *[F.col(m).alias(f"{own}{m}") for m in MARGINS], F.col("probability").alias(f"{own}probability")), "rates")
    rows = described(docs, own).where(F.col(f"{own}tokens") > 0)
    return rows.join(rates, [f"{own}{m}" for m in MARGINS]).where(chance(F.col("doc_id")) < F.col(f"{own}probability"))


def sample(docs: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``, columns unchanged."""
    return mixed(docs, own=unused(docs)).select(*docs.columns)
