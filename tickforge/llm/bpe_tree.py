"""Byte-pair encoding and decoding of long texts by tree concatenation.

A text is cut where the pre-tokenizer is known to cut it, whatever follows; such leaves encode independently. What the
pre-tokenizer leaves unsplit and is longer than a leaf is cut anywhere, its parts are encoded like
texts of their own, in parallel, and neighbours are put together pair by pair: a window of identifiers around the join is
encoded anew and grows to a side until it gives back the outermost identifier of that side.

That is exact. Merges go by rank, then from the left, and a symbol never has a lower rank than its parts
(``Codec`` refuses a vocabulary where it has). So if no merge crosses a border, the symbols on both sides
develop as in their own two tokens alone, and the first merge to cross it would cross it in the pair alone as well: a
sequence is the encoding of its text if and only if every two neighbours are the encoding of theirs. Inside the old
parts and inside the window this holds; at the window's ends the neighbours are those of the old parts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import bounded_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Code points of a leaf; texts above ``SPREAD`` have their leaves dealt to tasks; identifiers a side of the first window.
LEAF, SPREAD, WINDOW = 1 << 13, 1 << 16, 8
#: Pieces that a worker remembers, and the longest of them.
MEMORY, REMEMBERED = 300_000, 24
#: Code points that the pre-tokenizer's patterns look ahead beyond the end of a match.
AHEAD = 2
WHOLE, HEAD, PART = 0, 1, 2

_DONE = "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_LEAVES = "uid bigint, doc_id string, leaf int, kind int, text string"
_CODES = "uid bigint, doc_id string, leaf int, kind int, ids binary"


#: Identifiers joined by commas, and the bytes they stand for.
Printed = tuple[str, bytes]
# in front of a blank after something ``_solid``: \w is what isalnum accepts, and the underscore
_CUT = re.compile(r"(?<=[!-~\w])(?= )")


class Codec:
    """A byte-level vocabulary file of the tokenizers library, with what cutting and joining needs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            made_of = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splitter = self.tokenizer.pre_tokenizer
        self.raw = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        model, first = made_of["model"], made_of["pre_tokenizer"] or {}
        if (made_of["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
                or model.get("end_of_word_suffix") or first.get("type") != "ByteLevel" or first["add_prefix_space"] or not first["use_regex"]):
            raise ValueError("not a plain byte-level vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made_of["added_tokens"]):
            raise ValueError("added tokens that look at their neighbours")
        pairs = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        made_at = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        if len(made_at) < len(pairs) or any(max(made_at.get(a, -1), made_at.get(b, -1)) >= rank for rank, (a, b) in enumerate(pairs)):
            raise ValueError("a symbol ranks below its parts, or has two origins")
        self.symbols = {i: s for s, i in model["vocab"].items()}
        # the byte alphabet: printable bytes stand for themselves, the others are counted from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        self.bytes = {i: bytes(byte_of[c] for c in s) for i, s in self.symbols.items()} | {t["id"]: t["content"].encode() for t in made_of["added_tokens"]}
        self.known: dict[str, Printed] = {}
        self.sizes = {i: len(b) for i, b in self.bytes.items()}
        self.names = {i: str(i) for i in self.bytes}
        added = sorted((t["content"] for t in made_of["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def encode(self, text: str) -> list[int]:
        """What the library gives for a text, or for a leaf of kind ``WHOLE``."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The same for several texts."""
        return [list(map(int, names.split(","))) if names else [] for names, _ in self.print_all(texts)]

    def print_all(self, texts: list[str]) -> list[Printed]:
        """Encoded and decoded: identifiers joined by commas, and their bytes."""
        return [(",".join([names for names, _ in coded]), b"".join([data for _, data in coded])) for coded in self._coded(texts)]

    def printed(self, ids: list[int]) -> Printed:
        return ",".join(map(self.names.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def _coded(self, texts: list[str]) -> Iterator[list[Printed]]:
        """The pieces of each text. Texts are cut at every blank where any text is cut; short pieces are remembered, printed
        (pairs of texts cost the garbage collector nothing), and new ones are encoded together, as one text that is cut between them."""
        if len(self.known) > MEMORY:
            self.known = {}
        known, all_pieces = self.known, [None if self.added and self.added.search(t) else _pieces(t) for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(filter(None, all_pieces))) if p not in known]
        inner = [p for p in new if p[:1] == " " and _solid(p[-1])]
        outer = list(set(new).difference(inner))
        known.update(zip(outer, map(self.printed, self._library(outer))))
        if inner:
            ids = self._library(["".join(inner)])[0]
            names, data = list(map(self.names.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids))
            ends = np.cumsum(np.fromiter(map(self.sizes.__getitem__, ids), np.int64, len(ids)))
            stops = np.cumsum(np.fromiter((len(p.encode()) for p in inner), np.int64, len(inner)))
            at, begin = 0, 0
            for p, to, stop in zip(inner, (np.searchsorted(ends, stops) + 1).tolist(), stops.tolist()):
                known[p] = ",".join(names[at:to]), data[begin:stop]
                at, begin = to, stop
        for text, pieces in zip(texts, all_pieces):
            yield [self.printed(self._library([text])[0])] if pieces is None else list(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > REMEMBERED:
                del known[p]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """The library's text, by a table of each identifier's bytes."""
        return self.printed(ids)[1].decode(errors="replace")

    def merged(self, symbols: str) -> list[int]:
        """Merges alone, over symbols of the byte alphabet, without pre-tokenizer."""
        return [t.id for t in self.tokenizer.model.tokenize(symbols)]

    def encode_part(self, text: str) -> list[int]:
        """A part of something unsplit, as if it were all."""
        return self.merged("".join(piece for piece, _ in self.raw.pre_tokenize_str(text)))

    def leaves(self, text: str, size: int = LEAF) -> Iterator[tuple[int, str]]:
        """``(kind, piece)``: pieces that encode independently, and parts of unsplit ones, the first of which is a ``HEAD``.

        An empty text has one empty leaf."""
        if len(text) <= size:
            yield WHOLE, text
            return
        for k, section in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                yield WHOLE, section  # an added token
            elif section:
                yield from self._section(section, size)

    def _section(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        at, n = 0, len(text)
        while n - at > size:
            end = _white(text, at, at + size)
            if end:
                yield WHOLE, text[at:end]
            else:
                unsplit, end = self._border(text, at, size)
                if unsplit:
                    for k in range(at, end, size):
                        yield HEAD if k == at else PART, text[k:min(k + size, end)]
                else:
                    yield WHOLE, text[at:end]
            at = end
        if at < n:
            yield WHOLE, text[at:]

    def _border(self, text: str, at: int, size: int) -> tuple[bool, int]:
        """The last end of a pre-token within ``size`` that is no white space, so that the piece is split alone as it is here; else
        the end of the first pre-token, which is unsplit by itself."""
        width = size
        while True:
            window = text[at:at + width]
            known = len(window) if at + width >= len(text) else len(window) - AHEAD
            ends = [e for _, (_, e) in self.splitter.pre_tokenize_str(window) if e <= known]
            if ends:
                solid = [e for e in ends if e <= size and _solid(window[e - 1])]
                return (False, at + solid[-1]) if solid else (True, at + ends[0])
            width *= 2

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbouring parts from their own encodings."""
        if not a or not b:
            return a + b
        left, right = min(WINDOW, len(a)), min(WINDOW, len(b))
        while True:
            i, j = len(a) - left, right
            window = self.merged("".join(map(self.symbols.__getitem__, a[i:] + b[:j])))
            agree_left, agree_right = i == 0 or window[0] == a[i], j == len(b) or window[-1] == b[j - 1]
            if agree_left and agree_right:
                return a[:i] + window + b[j:]
            left = left if agree_left else min(2 * left, len(a))
            right = right if agree_right else min(2 * right, len(b))

    def concatenate(self, parts: list[list[int]]) -> list[int]:
        """Parts of something unsplit, joined in pairs, pairs of pairs and so on."""
        while len(parts) > 1:
            parts = [self.join(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def encode_leaves(self, leaves: Iterable[tuple[int, str]]) -> Iterator[tuple[int, list[int]]]:
        for kind, piece in leaves:
            yield kind, self.encode(piece) if kind == WHOLE else self.encode_part(piece)

    def print_leaves(self, leaves: Iterable[tuple[int, str]]) -> Iterator[tuple[int, Printed | list[int]]]:
        """The same, leaves of kind ``WHOLE`` printed."""
        for kind, piece in leaves:
            yield kind, self.print_all([piece])[0] if kind == WHOLE else self.encode_part(piece)

    def units(self, encoded: Iterable[tuple[int, Printed | list[int]]]) -> Iterator[Printed | list[int]]:
        """Exact encodings of consecutive pieces of a text as they come, parts put together."""
        parts: list[list[int]] = []
        for kind, ids in encoded:
            if kind != PART and parts:
                yield self.concatenate(parts)
                parts = []
            if kind == WHOLE:
                yield ids
            else:
                parts.append(ids)
        if parts:
            yield self.concatenate(parts)


def _solid(char: str) -> bool:
    """Surely no white space, whatever the version of Unicode."""
    return "!" <= char <= "~" or char.isalnum()


def _pieces(text: str) -> list[str]:
    """A text cut at every blank after something solid."""
    return _CUT.split(text)


def _white(text: str, start: int, stop: int) -> int:
    """A place up to ``stop`` where any text is cut: a blank after something solid. 0 if none."""
    at = text.rfind(" ", start + 1, stop + 1)
    while at > 0:
        if _solid(text[at - 1]):
            return at
        at = text.rfind(" ", start + 1, at)
    return 0


class Digests:
    """Running digests of identifiers and of the decoded text."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, unit: Printed | list[int], codec: Codec) -> Digests:
        names, data = codec.printed(unit) if isinstance(unit, list) else unit
        if names:
            self.ids.update(("," * (self.n > 0) + names).encode())
            self.n += names.count(",") + 1
            self.text.update(data.decode(errors="replace").encode())
        return self

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def in_place(docs: DataFrame, path: str, leaf: int) -> DataFrame:
    """Texts encoded by the task that reads them; one of several leaves is put together there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            short, out = iter(codec.print_all([t for t in batch["text"] if len(t) <= leaf])), []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                units = [next(short)] if len(text) <= leaf else codec.units(codec.print_leaves(codec.leaves(text, leaf)))
                digests = Digests()
                for unit in units:
                    digests.add(unit, codec)
                out.append((doc_id, *digests.row()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInPandas(run, _DONE)


def dealt_out(docs: DataFrame, path: str, leaf: int) -> DataFrame:
    """Long texts: their leaves go to tasks by document and number, identifiers come back sorted as a stream."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, names = None, ["uid", "doc_id", "leaf", "kind", "text"]
        for batch in batches:
            codec = codec or Codec(path)
            out = []
            for uid, doc_id, text in zip(batch["uid"], batch["doc_id"], batch["text"]):
                for k, (kind, piece) in enumerate(codec.leaves(text, leaf)):
                    out.append((uid, doc_id, k, kind, piece))
                    if len(out) == 256:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            ids = [np.array(x, "<u4").tobytes() for _, x in codec.encode_leaves(zip(batch["kind"], batch["text"]))]
            yield batch[["uid", "doc_id", "leaf", "kind"]].assign(ids=ids)

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, names = Codec(path), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        stream = (row for batch in batches for row in zip(batch["uid"], batch["doc_id"], batch["kind"], batch["ids"]))
        ahead, out = next(stream, None), []

        def leaves(uid: int) -> Iterator[tuple[int, list[int]]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == uid:
                yield ahead[2], np.frombuffer(ahead[3], "<u4").tolist()
                ahead = next(stream, None)

        while ahead is not None:
            doc_id, digests = ahead[1], Digests()
            for ids in codec.units(leaves(ahead[0])):
                digests.add(ids, codec)
            out.append((doc_id, *digests.row()))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    leaves = docs.select("uid", "doc_id", "text").mapInPandas(cut, _LEAVES)
    codes = leaves.repartition("uid", "leaf").mapInPandas(encode, _CODES)
    return codes.repartition("uid").sortWithinPartitions("uid", "leaf").select("uid", "doc_id", "kind", "ids").mapInPandas(assemble, _DONE)


def encoded(docs: DataFrame, path: str = TOKENIZER, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no identifiers. Repeated rows are documents of their own, null ids stay null, other columns are left
    out; an empty table gives none. Strings of added tokens in a text become their identifiers, as the
    library does it. ``docs`` must give the same rows in the same partitions when a task is repeated, as
    tables do. ``path`` must exist on executors."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > spread
    done = in_place(rows.where(~long), path, leaf).union(dealt_out(rows.where(long), path, leaf))
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
