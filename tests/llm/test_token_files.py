import pytest

from tests.llm.util import clashing, docs
from tickforge.llm import token_files as T
from tickforge.sources.stored import scratch_folder


def test_counts_equal_the_encoder_at_every_block_size(spark, sf):
    texts = [(i, f"text number {i} " * (i % 7)) for i in range(-5, 40)] + [(2 ** 62, ""), (-2 ** 62, None), (7, "repeated"), (8, "long " * 30_000), (None, "no id")]
    encode = T.encoder(T.TOKENIZER)
    want = sorted((i, len(encode(t or ""))) for i, t in texts if i is not None)
    folder = scratch_folder(spark, "tokens")
    T.write_token_files(clashing(docs(spark, texts)).repartition(3), folder)
    for block in (5, 6, 7, 64, 1000, 1 << 18):
        got = T.counted(T.documents_of(T.scan_blocks(spark, folder, block_tokens=block)))
        assert sorted(tuple(r) for r in got.collect()) == want, block


def test_unfinished_document_and_odd_file(spark, tmp_path):
    import numpy as np

    np.array([1, 2, T.SEPARATOR, T.SEPARATOR, 3], "<u2").tofile(tmp_path / "part-0")
    for block in (1, 2, 3, 9):
        got = T.documents_of(T.scan_blocks(spark, str(tmp_path), block_tokens=block)).orderBy("ordinal").collect()
        assert [(r.ordinal, r.start, r.n_ids) for r in got] == [(0, 0, 2), (1, 3, 0), (2, 4, 1)]
    (tmp_path / "part-1").write_bytes(b"abc")
    with pytest.raises(Exception, match="half an identifier"):
        T.scan_blocks(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    assert T.token_counts(docs(spark, {})).count() == 0


def test_blocks_of_one_file_go_to_several_tasks_and_groups(spark, tmp_path, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    ids = np.arange(4000) % 700 + 1
    ids[::97] = T.SEPARATOR
    ids[1000:2500] = 5  # a document over many blocks
    ids.astype("<u2").tofile(tmp_path / "part-0")
    ends = np.append(np.flatnonzero(ids == T.SEPARATOR), 4000)
    starts = np.append(0, ends[:-1] + 1)
    want = [(k, a, b - a, ids[a:a + T.HEADER].tolist()) for k, (a, b) in enumerate(zip(starts, ends))]
    monkeypatch.setattr(T, "GROUP", 4, raising=False)
    blocks = T.scan_blocks(spark, str(tmp_path), block_tokens=50)
    got = T.documents_of(blocks).orderBy("ordinal").collect()
    assert [(r.ordinal, r.start, r.n_ids) for r in got] == [w[:3] for w in want]
    assert all(r.head == w[3] for r, w in zip(got, want) if w[2] >= T.HEADER)
    assert blocks.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    # a file above Spark's limit for a row is read in ranges
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert T.documents_of(T.scan_blocks(spark, str(tmp_path), block_tokens=50)).count() == len(want)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
