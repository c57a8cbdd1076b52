import base64
import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sondar.llm import bpe

PATH = bpe.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary files")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.perfect_hash(PATH))


def test_perfect_hash_holds_every_key_and_no_other():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys, list(range(3000)))
    assert sorted(table.keys) == sorted(keys)
    assert [table.get(k) for k in keys] == list(range(3000)) and table.get(b"x") == -1
    assert bpe.PerfectHash([b"a"], [7]).get(b"a") == 7


CASES = ["", " ", "  a", "a  b", "x \n y", "x\n y", "\n\n  b", "don't  ", "a　b c", "x" * 4000, "ab" * 2000 + " q", "<|endoftext|> hi", "é ß 中文 текст", "a\r\n b\t c", "\x00\x07 z", "🙂 👩‍👩‍👧"]


@pytest.mark.parametrize("text", CASES)
def test_cases(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t a'sb1. é中ß\r_-", max_size=40))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_memo_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 5)
    small = bpe.Encoder(bpe.perfect_hash(PATH))
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join("".join(rng.choices("abcé中", k=6)) for _ in range(8))
        assert small.encode(text) == reference.encode_ordinary(text)
        assert len(small.memo) <= 5 and len(small.tokens) <= 5


def test_columns(spark, reference):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "doc_id bigint, text string").selectExpr("*", "'x' AS ids", "1 AS tokens")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_column(df, "doc_id", "text").collect())
    ab = reference.encode_ordinary("a b")
    assert got == [(1, ab), (1, ab), (2, []), (3, [])]
    assert bpe.encode_column(df.where("false"), "doc_id", "text").schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert bpe.encode_column(df.where("false"), "doc_id", "text").count() == 0
