import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm.bpe import NONE, Encoder, PairTree, bpe_digest, decode, encode, load_ranks, merge_bytes, unpacked

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = load_ranks(PATH)
LONGEST = max(map(len, RANKS))
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = Encoder(RANKS, public_tokenizers.PATTERN)


def test_leftmost_minimum():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 64, 65):
        keys = [rng.randint(0, 5) << 32 | i for i in range(n)]
        tree = PairTree(list(keys))
        for _ in range(100):
            assert tree.least() == min(keys)
            i = rng.randrange(n)
            keys[i] = NONE if rng.random() < 0.3 else rng.randint(0, 5) << 32 | i
            tree.put(i, keys[i])


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert list(unpacked(OURS.encode(text))) == THEIRS.encode_ordinary(text)


def test_every_code_point_is_split_as_by_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{p}b {p}1{p} " for p in points[at : at + 4096])
        assert list(unpacked(OURS.encode(text))) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("piece", ["a" * 20_000, "é" * 5_000, "\n" * 7_000, "the" * 3_000, "=-" * 4_000, "9" * 3_001])
def test_very_long_pieces(piece):
    assert list(unpacked(OURS.encode(piece))) == THEIRS.encode_ordinary(piece)


def test_a_piece_that_is_a_token_is_not_merged():
    # No merge leads to the token abcd; only a piece that is this token becomes it.
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 290, b"ab": 300, b"abcd": 400}
    assert merge_bytes(b"abcd", ranks, 4) == [400] and merge_bytes(b"abcde", ranks, 4) == [97, 290, 100, 101]


def digest(text):
    ids = THEIRS.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_rows_against_the_library(spark, awkward):
    rows = awkward.select("doc_id", "text").collect()
    got = bpe_digest(spark, awkward, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(str((r["doc_id"], *digest(r["text"]))) for r in rows)


def test_whole_table_against_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe_digest(spark, docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {r["doc_id"]: digest(r["text"]) for r in docs.collect()}


def test_round_trip_and_nothing(spark, awkward, nothing):
    both = decode(encode(awkward, RANKS, public_tokenizers.PATTERN), RANKS, keep_ids=False)
    assert both.columns == ["doc_id", "decoded"]
    want = [(r["doc_id"], (r["text"] or "").encode()) for r in awkward.collect()]
    assert sorted(map(str, [(r["doc_id"], bytes(r["decoded"])) for r in both.collect()])) == sorted(map(str, want))
    assert encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert list(unpacked(OURS.encode("one two"))) == THEIRS.encode_ordinary("one two")


def test_pieces_are_forgotten_in_generations(monkeypatch):
    monkeypatch.setattr("strandwise.llm.bpe.KEPT", 3)
    encoder, text = Encoder(RANKS, public_tokenizers.PATTERN), "one two three four two one zwei drei vier two " * 5
    assert list(unpacked(encoder.encode(text))) == THEIRS.encode_ordinary(text) and len(encoder) <= 3 and len(encoder.older) <= 3


def test_a_vocabulary_beyond_the_bound_is_an_error():
    with pytest.raises(ValueError):
        load_ranks(PATH, max_bytes=1_000)
