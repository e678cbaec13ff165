import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkveil.llm import bpe
from sparkveil.llm.queries import rank_file


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*rank_file())


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file()[0].splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"key{i}".encode() for i in range(5000)] + [b"\0", b"\0\0"]
    h = bpe.PerfectHash(keys)
    slots = h.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert (h.slots([b"other", b"", b"key5000"]) == -1).all()


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "don't stop  \n\n now", "é" * 100, "<|endoftext|> x", "\t\t 123 \u200b 漢字 𝔘"])
def test_same_ids_as_the_library(codec, plain, text):
    ids = codec.encode([text])[0]
    assert ids.tolist() == plain.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_the_library_on_any_text(texts):
    codec = bpe.codec(*rank_file())
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file()[0].splitlines())} if not hasattr(test_same_ids_as_the_library_on_any_text, "plain") else None
    if ranks:
        test_same_ids_as_the_library_on_any_text.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = test_same_ids_as_the_library_on_any_text.plain
    assert [x.tolist() for x in codec.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_rows_survive_nulls_repeats_and_clashing_names(spark, plain):
    rows = [(1, "hello world", "old"), (1, "hello world", "old"), (2, None, None), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, token_ids string")
    out = bpe.decode(bpe.encode(df, *rank_file()), *rank_file()).collect()
    assert len(out) == 4
    for r in out:
        assert list(r["token_ids"]) == plain.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    packed = bpe.encode(df, *rank_file(), as_bytes=True, keep=["doc_id"]).collect()
    want = sorted(hashlib.sha256(np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest() for _, t, _ in rows)
    assert sorted(hashlib.sha256(bytes(r["token_ids"])).hexdigest() for r in packed) == want
    assert bpe.encode(df.limit(0), *rank_file()).count() == 0
