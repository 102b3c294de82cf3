"""Token counts from flat token files by a separator scan.

A token file is nothing but little-endian 16-bit identifiers; a document ends with the end-of-document
identifier, and there is no index. Blocks of a file are dealt to tasks as byte ranges and searched for it with
numpy, independently of each other. A block reports its separators and its first and last identifiers; a prefix scan over the blocks
(the last separator before each block, the first identifiers of the next one) stitches documents that
cross block boundaries. The files may lie where only Spark reads; then each file is read whole, by one task.

``write_token_files`` makes such files from documents. A document starts with its id as ``HEADER`` digits to
the base ``DIGITS``, which never equal the separator, so a file also tells which document a count is for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickforge.llm.common import bounded_batches
from tickforge.sources.stored import scratch_folder

SEPARATOR, DIGITS, HEADER = 50_256, 50_000, 5
BLOCK_TOKENS = 1 << 18
#: Blocks of one window group; blocks that a worker returns at once; bytes that a task reads.
GROUP, FRAME_BLOCKS, TASK_BYTES = 256, 16, 64 << 20
#: Where only Spark reads, a file is one row when it is read; this bounds it by rows of text.
DOCS_A_FILE = 5_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary's public tokenizer splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OFFSET = 1 << 63


def header(doc_id: int) -> list[int]:
    """A 64-bit id as digits, the highest first."""
    value, out = doc_id + _OFFSET, []
    for _ in range(HEADER):
        value, digit = divmod(value, DIGITS)
        out.append(digit)
    return out[::-1]


def encoder(path: str):
    """Encoder of a file of ranks (base64 token, rank), at most 65,535 of them without the separator."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if max(ranks.values()) >= 1 << 16 or SEPARATOR in ranks.values():
        raise ValueError("identifiers must fit 16 bits and leave the separator free")
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> None:
    """Write ``docs(doc_id, text)`` as flat files below ``folder``: one pass, no shuffle, by Spark's text writer, whose
    line end is the separator. Null and empty texts have no token besides header and separator; rows
    without an id are left out; repeated rows are repeated documents. ``tokenizer`` must exist on executors."""
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = None
        for batch in batches:
            tokens = tokens or encoder(tokenizer)
            yield pd.DataFrame({"raw": [np.array(header(i) + tokens(t or ""), "<u2").tobytes() for i, t in zip(batch["doc_id"], batch["text"])]})

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInPandas(encode, "raw binary")
    ends = np.array([SEPARATOR], "<u2").tobytes().decode("latin-1")
    (rows.select(F.col("raw").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", ends)
     .option("maxRecordsPerFile", DOCS_A_FILE).text(folder))


def scan_blocks(spark: SparkSession, files: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS, keep: int = HEADER) -> DataFrame:
    """``(file, block, start, n, separators, heads, first)`` of the blocks of the files of a folder: absolute places of
    separators, up to ``keep`` identifiers after each of them, and the first ``keep`` identifiers of the block.
    A file with an odd number of bytes is no token file and fails. From a file system that is mounted everywhere a
    task reads only the ranges of its blocks; from another store a file is one row, 2 GB at most."""
    bounded_batches(spark)

    def found(path: str, b: int, start: int, block: np.ndarray) -> tuple:
        at = np.flatnonzero(block == separator)
        return (path, b, start, len(block), at + start, [block[i + 1:i + 1 + keep].astype(np.int32) for i in at], block[:keep].astype(np.int32))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, b, length in zip(batch["path"], batch["block"], batch["length"]):
                if length % 2:
                    raise ValueError(f"{path} has half an identifier")
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
                    file.seek(2 * b * block_tokens)
                    ids = np.frombuffer(file.read(min(2 * block_tokens, length - 2 * b * block_tokens)), "<u2")
                if len(ids) < min(block_tokens, length // 2 - b * block_tokens):
                    raise ValueError(f"{path} has changed")
                out.append(found(path, b, b * block_tokens, ids))
                if len(out) == FRAME_BLOCKS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    def search_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if len(content) % 2:
                    raise ValueError(f"{path} has half an identifier")
                ids = np.frombuffer(content, "<u2")
                yield pd.DataFrame([found(path, b, start, ids[start:start + block_tokens]) for b, start in enumerate(range(0, len(ids), block_tokens))],
                                   columns=names)

    names = ["file", "block", "start", "n", "separators", "heads", "first"]
    schema = "file string, block int, start bigint, n int, separators array<bigint>, heads array<array<int>>, first array<int>"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(files)
    where = spark._jvm.org.apache.hadoop.fs.Path(files).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if where.getUri().getScheme() != "file":
        return rows.select("path", "content").mapInPandas(search_whole, schema)
    listed = rows.select("path", "length").where("length > 0")  # the listing alone
    tasks = max(spark.sparkContext.defaultParallelism, (listed.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    blocks = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (2 * block_tokens)))).alias("block"))
    return blocks.repartition(int(tasks), "path", "block").mapInPandas(search, schema)


def documents_of(blocks: DataFrame) -> DataFrame:
    """``(file, ordinal, start, n_ids, head)`` of each document: its place in the file, its identifiers without the
    separator, and its first identifiers. What follows the last separator is an unfinished document and
    counts as one if it is not empty. Two levels of windows: the blocks of one group, and one summary per
    group of a file."""
    blocks = blocks.withColumn("group", F.floor(F.col("block") / GROUP).cast("int"))
    in_group, in_file = Window.partitionBy("file", "group").orderBy("block"), Window.partitionBy("file").orderBy("group")
    before, earlier = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (in_group, in_file))
    some, last, none = F.size("separators") > 0, F.element_at("separators", -1), F.array().cast("array<int>")
    slim = blocks.select("file", "group", "block", F.size("separators").alias("m"), F.when(some, last).alias("last"),
                         F.when(some, F.element_at("heads", -1)).alias("tail"), "first").withColumn("after", F.lead("first").over(in_group))
    groups = slim.groupBy("file", "group").agg(
        F.sum("m").alias("m"), F.max("last").alias("last"), F.min_by("first", "block").alias("first"),
        F.max(F.when(F.col("m") > 0, F.struct("block", "tail", "after"))).alias("t")).withColumn("group_next", F.lead("first").over(in_file))
    groups = groups.select(
        "file", "group", "group_next", F.max("last").over(earlier).alias("group_carry"), F.sum("m").over(earlier).alias("group_done"),
        F.first("first").over(in_file).alias("file_head"), F.lead("group").over(in_file).isNull().alias("last_group"),
        F.last(F.when(F.col("t").isNotNull(), F.concat("t.tail", F.coalesce("t.after", "group_next", none))), ignorenulls=True)
        .over(earlier).alias("group_head"))
    follows = F.coalesce(F.lead("first").over(in_group), F.col("group_next"), none)
    known = blocks.join(groups, ["file", "group"]).withColumns({
        "carry": F.coalesce(F.max(F.when(some, last)).over(before), F.col("group_carry"), F.lit(-1)),
        "done": F.coalesce(F.sum(F.size("separators")).over(before), F.lit(0)) + F.coalesce("group_done", F.lit(0)),
        "next": follows,
        "is_last": F.lead("block").over(in_group).isNull() & F.col("last_group"),
        # heads after a carried separator belong to the block that holds it
        "carry_head": F.coalesce(F.last(F.when(some, F.concat(F.element_at("heads", -1), follows)), ignorenulls=True).over(before), F.col("group_head")),
    })
    starts = F.concat(F.array(F.col("carry")), F.col("separators"))
    heads = F.concat(F.array(F.coalesce("carry_head", "file_head")), F.transform("heads", lambda h: F.concat(h, F.col("next"))))
    ends = F.when(F.col("is_last"), F.concat("separators", F.array(F.col("start") + F.col("n")))).otherwise(F.col("separators"))
    rows = known.select("file", "done", "is_last", F.size("separators").alias("m"), F.posexplode(F.arrays_zip(
        starts.alias("from"), ends.alias("to"), heads.alias("head"))).alias("i", "d"))
    rows = rows.where(F.col("d.to").isNotNull() & ((F.col("i") < F.col("m")) | (F.col("d.to") > F.col("d.from") + 1)))
    return rows.select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.col("d.from") + 1).alias("start"),
                       (F.col("d.to") - F.col("d.from") - 1).alias("n_ids"), F.slice("d.head", 1, HEADER).alias("head"))


def counted(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)`` of documents with headers."""
    digits = F.aggregate(F.slice("head", 2, HEADER), F.element_at("head", 1).cast("decimal(38,0)"),
                         lambda a, d: (a * DIGITS + d).cast("decimal(38,0)"))
    return documents.select((digits - F.lit(str(_OFFSET)).cast("decimal(38,0)")).cast("long").alias("doc_id"), (F.col("n_ids") - HEADER).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row of ``docs`` with an id, by way of flat token files in the shared folder."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "tokens")
    write_token_files(docs, folder, tokenizer)
    return counted(documents_of(scan_blocks(spark, folder)))
