"""Chat formatting: conversations rendered by a compiled template, with the spans a model shall learn.

Turns are marked by control strings. Inside texts the first character of a control string is replaced by
a backslash and a letter, and a backslash by two; what is marked in the output is therefore always a mark
of the template, and ``read_back`` recovers roles, texts and learned spans exactly.

Rows are sorted by conversation and turn within a partition and stream through the template one by one; a
long conversation leaves in several parts, cut between turns. So a worker holds one part, however long a
conversation is. The digests of a conversation need its turns in order, which one task sees as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import bounded_batches
from tickforge.llm.templates import BEGIN, END, TURN, compiled

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
TEMPLATE = """
{%- for message in messages -%}
    {%- if message.role == 'assistant' -%}
        <s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>
    {%- elif message.role == 'user' -%}
        [INST] {{ message.text | escape }} [/INST]
    {%- elif message.role == 'system' -%}
        <<SYS>>{{ message.text | escape }}<</SYS>>
    {%- else -%}
        <<ROLE>>{{ message.role | escape }}<<TEXT>>{{ message.text | escape }}<</ROLE>>
    {%- endif -%}
{%- endfor -%}
"""
PART_CHARS = 1 << 20

_GUARDED = re.compile("|".join([r"\\"] + [re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROLS]))
_SAFE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {"\\": "\\", "l": "<", "b": "["}
_TURNS = re.compile(r"<s>(?P<assistant>.*?)</s>|\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>"
                    r"|<<ROLE>>(?P<role>.*?)<<TEXT>>(?P<text>.*?)<</ROLE>>", re.S)


def escape(text: str) -> str:
    return _GUARDED.sub(lambda m: _SAFE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN.get(m[1], m[1]), text)


FILTERS = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv_id, part, n_turns, formatted, loss array<struct<start, end>>)`` of ``rows(conv_id, turn, role, text)``.

    Turns go by number, null first; equal numbers go by role, then text; repeated rows are repeated turns.
    Null texts and roles are empty; rows without a conversation form one of their own. Spans count code
    points within their part. An empty table has no output."""
    bounded_batches(rows.sparkSession)
    compiled(template, FILTERS)  # a wrong template fails here, not in a task

    def one(messages: Iterator[dict], key: str | None, render) -> Iterator[tuple]:
        part, turns, chars, pieces, loss, start = 0, 0, 0, [], [], 0
        for event in render(messages):
            if event is BEGIN:
                start = chars
            elif event is END:
                loss.append((start, chars))
            elif event is TURN:
                turns += 1
                if chars >= part_chars:
                    yield key, part, turns, "".join(pieces), loss
                    part, turns, chars, pieces, loss = part + 1, 0, 0, [], []
            else:
                pieces.append(event)
                chars += len(event)
        if turns or chars or not part:
            yield key, part, turns, "".join(pieces), loss

    def render_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compiled(template, FILTERS)
        stream = (row for batch in batches for row in zip(batch["key"], batch["role"], batch["text"]))
        ahead = next(stream, None)

        def messages(key: str | None) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield {"role": ahead[1], "text": ahead[2]}
                ahead = next(stream, None)

        out, held = [], 0
        while ahead is not None:
            key = ahead[0]
            for row in one(messages(key), key, render):
                out.append(row)
                held += len(row[3])
                if held >= 4 * part_chars or len(out) >= 5000:
                    yield pd.DataFrame(out, columns=["key", "part", "n_turns", "formatted", "loss"])
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["key", "part", "n_turns", "formatted", "loss"])

    blank = F.lit("")
    plain = rows.select(F.col("conv_id").cast("string").alias("key"), "turn", F.coalesce("role", blank).alias("role"),
                        F.coalesce("text", blank).alias("text"))
    ordered = plain.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    made = ordered.mapInPandas(render_all, "key string, part int, n_turns int, formatted string, loss array<struct<start:int,end:int>>")
    return made.withColumnRenamed("key", "conv_id")


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of each marked turn, unescaped."""
    for m in _TURNS.finditer(formatted):
        if m.lastgroup == "text":
            yield unescape(m["role"]), unescape(m["text"])
        else:
            yield m.lastgroup, unescape(m[m.lastgroup])


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the output of
    ``format_conversations``, whose order of parts is kept: parts of a conversation are neighbours."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started, out = None, False, []
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            for key, part, text, spans in zip(batch["conv_id"], batch["part"], batch["formatted"], batch["loss"]):
                if started and part == 0:
                    out.append((now, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
                    turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                now, started = key, True
                for role, body in turns_of(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "replace"))
                for span in spans:
                    body = unescape(text[span["start"]:span["end"]])
                    learned += len(body)
                    loss.update(body.encode("utf-8", "replace"))
                chars += len(text)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if started:
            yield pd.DataFrame([(now, n, turns.hexdigest(), learned, loss.hexdigest(), chars)], columns=columns)

    return formatted.mapInPandas(read, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
                                 ).withColumn("conv_id", F.col("conv_id").cast("long"))


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
