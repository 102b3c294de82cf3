import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tests.llm.util import clashing, docs
from tickforge.llm import bpe_tree as B
from tickforge.llm import queries as Q


@pytest.fixture(scope="module")
def codec():
    return B.Codec(B.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.TOKENIZER)


def tree(codec, text, size):
    return [i for unit in codec.units(codec.encode_leaves(codec.leaves(text, size))) for i in unit]


BITS = ["a", "b", "aa", "the", " the", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "'ll", "l", "r", "e", "<|endoftext|>", "<|endof", "1", "22", "!", "..", "é", "日本", "語",
        "🙂", " ", "　", "\u0085", "​", "᠎", "\t", "x" * 9, "ing", " in"]


def test_trees_equal_the_library(codec, library):
    rng = random.Random(3)
    for _ in range(6000):
        some = rng.sample(BITS, rng.randint(1, 8))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 120)))
        size = rng.choice([1, 2, 3, 5, 8, 17, 40])
        assert "".join(piece for _, piece in codec.leaves(text, size)) == text
        assert tree(codec, text, size) == library.encode(text, add_special_tokens=False).ids, (text, size)


def test_printed_texts_equal_the_library_and_long_pieces_are_forgotten(codec, library):
    texts = ["", " ", "a b  c\u0085 d_ e\u00b2 f", "same words same words", "x" * 40 + " same", "é <|endoftext|> b", "日本 語\t a"]
    for (names, data), text in zip(codec.print_all(texts), texts):
        assert names == ",".join(map(str, library.encode(text, add_special_tokens=False).ids)) and data.decode() == text
    assert " same" in codec.known and max(map(len, codec.known)) <= B.REMEMBERED


@pytest.mark.parametrize("text", ["a" * 50_001, "ab" * 30_000, "0123456789abcdef" * 4000, "日本語" * 9000, " " * 30_000 + "x", "\n" * 20_001, "'" * 20_000 + "s", "é🙂" * 9000,
                                  "<|endoftext|>" * 3000, "word " * 9000])
def test_unsplit_texts(codec, library, text):
    for size in (64, 1000, B.LEAF):
        assert tree(codec, text, size) == library.encode(text, add_special_tokens=False).ids


def test_windows_grow_until_both_sides_agree(codec, library):
    rng = random.Random(4)
    for _ in range(3000):
        some = rng.choice(["ab", "aaab", "etaoin", "=-", "xyzq"])
        a, b = ("".join(rng.choice(some) for _ in range(rng.randint(1, 90))) for _ in range(2))
        assert codec.join(codec.encode_part(a), codec.encode_part(b)) == codec.encode_part(a + b)
    grown = []
    plain = codec.merged
    codec.merged = lambda symbols: grown.append(len(symbols)) or plain(symbols)
    try:
        codec.join(plain("a" * 3), plain("a" * 4096))
    finally:
        codec.merged = plain
    assert len(grown) > 3 and grown[-1] == 4099  # every identifier after the join moves


def expected(library, texts):
    out = []
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert decoded == (text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_table(spark, library):
    rng = random.Random(6)
    texts = [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 400)))) for k in range(120)]
    texts += [(None, "no id"), (2 ** 62 + 1, None), (-3, ""), (7, "again"), (7, "again"), (8, "a" * 70_001), (9, "long word " * 30_000), (9, "<|endoftext|>" + "z" * 20_000)]
    frame = clashing(docs(spark, texts)).selectExpr("*", "1 AS uid", "2 AS leaf", "3 AS kind", "'x' AS ids")
    want = expected(library, texts)
    for leaf, spread in ((16, 200), (1000, 5000), (B.LEAF, B.SPREAD)):
        assert sorted(map(tuple, B.encoded(frame.repartition(3), leaf=leaf, spread=spread).collect()), key=repr) == want
    assert B.encoded(docs(spark, {})).count() == 0


def test_leaves_of_one_text_go_to_several_tasks(spark):
    text = docs(spark, {1: "word " * 40_000})
    frame = text.selectExpr("0L AS uid", "'1' AS doc_id", "text")
    plan = B.dealt_out(frame, B.TOKENIZER, 1000)._jdf.queryExecution().toString()
    assert "hashpartitioning(uid" in plan and "leaf" in plan


def test_refuses_what_it_cannot_join(tmp_path):
    import json

    made_of = json.load(open(B.TOKENIZER, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": made_of["model"] | {"merges": made_of["model"]["merges"][::-1]}}):
        path = tmp_path / "vocabulary.json"
        path.write_text(json.dumps(made_of | change))
        with pytest.raises(Exception):  # noqa: B017  the library may refuse it first
            B.Codec(str(path))


def test_registered_query(spark, sf, library):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, Q.QUERIES["op12_bpe_tree"](spark, sf).collect()), key=repr) == expected(library, texts)
