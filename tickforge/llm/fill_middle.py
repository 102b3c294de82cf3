"""Fill-in-the-middle rewriting by secondary sort.

A text is cut into chunks of code points. Every chunk is a row keyed by its document and its place in the output; one
exchange by document and a sort by place inside the partitions bring the output together as a stream, from which digests
are taken chunk by chunk. The reader sees that stream and nothing else: it knows the part of a chunk from the
marks, gives it its place in the text, and a second sort inside the same partitions, without another exchange,
streams the restored text. So a task holds a few chunks, however long a document is, and no text is ever put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK, SEED, PLAIN_FROM, SPM_BELOW = 1 << 13, "1", 90, 20
#: Code points of the chunks that leave a worker at once.
FRAME_CHARS = 1 << 20
#: Parts in the order of the output, with their marks, and their places in the text.
ORDERS = {"psm": (("prefix", PREFIX), ("suffix", SUFFIX), ("middle", MIDDLE)), "spm": (("suffix", SUFFIX), ("prefix", PREFIX), ("middle", MIDDLE))}
PLACES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

_PIECES = "uid bigint, doc_id string, form string, n bigint, prefix_chars bigint, middle_chars bigint, at bigint, piece string"
_READ = "uid bigint, doc_id string, form string, n bigint, prefix_chars bigint, middle_chars bigint, place int, at bigint, piece string, output_sha256 string"
_DONE = "doc_id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def frames(rows: Iterator[tuple], columns: list[str], text: int) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded text."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[text] or "") + 64
        if held >= FRAME_CHARS:
            yield pd.DataFrame(out, columns=columns).astype(_nullable(columns))
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns).astype(_nullable(columns))


def _nullable(columns: list[str]) -> dict[str, str]:
    return {c: "Int64" for c in ("prefix_chars", "middle_chars") if c in columns}


def cut(text: str, form: str, first: int, second: int, chunk: int) -> Iterator[tuple[int, str]]:
    """``(place in the output, chunk)`` of a text in its form; a mark leads the first chunk of its part. The parts end after
    ``first`` and ``second`` code points. An empty part is its mark, an empty text one empty chunk."""
    bounds = {"prefix": (0, first), "middle": (first, second), "suffix": (second, len(text))}
    at = 0
    for part, mark in ORDERS.get(form, (("all", ""),)):
        begin, end = bounds.get(part, (0, len(text)))
        for k in range(begin, max(end, begin + 1), chunk):
            piece = (mark if k == begin else "") + text[k:min(k + chunk, end)]
            yield at, piece
            at += len(piece)


def pieces(docs: DataFrame, chunk: int = CHUNK, seed: str = SEED) -> DataFrame:
    """``(uid, doc_id, form, n, prefix_chars, middle_chars, at, piece)``: the chunks of all outputs, ``uid`` naming the row they are from.

    Ids travel as text, which has room for null. ``docs`` must give the same rows in the same partitions when a task is repeated, as tables do. Null texts are empty;
    repeated rows are documents of their own; other columns are left out."""
    bounded_batches(docs.sparkSession)
    h = draws(F.col("doc_id"), seed)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       *[x.alias(f"h{k}") for k, x in enumerate(h, 1)])

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> Iterator[tuple]:
            for batch in batches:
                for uid, doc_id, text, h1, h2, h3, h4 in zip(batch["uid"], batch["doc_id"], batch["text"], batch["h1"], batch["h2"], batch["h3"], batch["h4"]):
                    n = len(text)
                    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                    plain = not n or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in PLACES)
                    form = "plain" if plain else "spm" if h4 % 100 < SPM_BELOW else "psm"
                    sizes = (None, None) if plain else (first, second - first)
                    for at, piece in cut(text, form, first, second, chunk):
                        yield uid, doc_id, form, n, *sizes, at, piece

        yield from frames(made(), names(_PIECES), 7)

    return rows.mapInPandas(cut_all, _PIECES)


def assembled(made: DataFrame) -> DataFrame:
    """Chunks sorted by document and place in the output, all chunks of a document in one partition."""
    return made.repartition("uid").sortWithinPartitions("uid", "at")


def read_back(outputs: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` from what ``assembled`` gives.

    The first pass digests the outputs and, by marks alone, finds the place in the text of each chunk; the second one
    digests the chunks in the order of the text. The digest of an output rides on the last chunk of its document."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chunks() -> Iterator[tuple]:
            for batch in batches:
                prefix, middle = (batch[c].astype("Int64") for c in ("prefix_chars", "middle_chars"))
                yield from zip(batch["uid"], batch["doc_id"], batch["form"], batch["n"], prefix, middle, batch["at"], batch["piece"])

        def placed() -> Iterator[tuple]:
            stream = chunks()
            row = next(stream, None)
            now, digest, place = None, None, 0
            while row is not None:
                uid, doc_id, form, n, prefix, middle, at, piece = row
                if uid != now:
                    now, digest, place = uid, hashlib.sha256(), 0
                digest.update(piece.encode())
                if form != "plain" and piece[:3] in PLACES:
                    place, piece = PLACES[piece[:3]], piece[3:]
                row = next(stream, None)
                last = row is None or row[0] != now
                yield uid, doc_id, form, n, prefix, middle, place, at, piece, digest.hexdigest() if last else None

        yield from frames(placed(), names(_READ), 8)

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def documents() -> Iterator[tuple]:
            now, digest, output, kept = None, None, None, None
            for batch in batches:
                sizes = [batch[c].astype("Int64") for c in ("prefix_chars", "middle_chars")]
                for uid, doc_id, n, form, prefix, middle, piece, sha in zip(batch["uid"], batch["doc_id"], batch["n"], batch["form"], *sizes, batch["piece"],
                                                                            batch["output_sha256"]):
                    if uid != now:
                        if now is not None:
                            yield *kept, output, digest.hexdigest()
                        now, digest, output, kept = uid, hashlib.sha256(), None, (doc_id, n, form, prefix, middle)
                    digest.update(piece.encode())
                    output = sha if isinstance(sha, str) else output
            if now is not None:
                yield *kept, output, digest.hexdigest()

        yield from frames(documents(), names(_DONE), 6)

    return outputs.mapInPandas(read, _READ).sortWithinPartitions("uid", "place", "at").mapInPandas(restore, _DONE)


def transformed(docs: DataFrame, chunk: int = CHUNK, seed: str = SEED) -> DataFrame:
    """Digests of the rewritten and of the restored text of every row of ``docs(doc_id, text)``. An empty table gives none."""
    return read_back(assembled(pieces(docs, chunk, seed))).withColumn("doc_id", F.col("doc_id").cast("long"))
