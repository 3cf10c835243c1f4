import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from telemill.llm import bpe, packing
from tests.llm.cases import nothing, odd, small_texts  # noqa: F401 (fixtures)

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")


def reference():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def check_packing(rows, docs, capacity=4096):
    """Every id in one piece, pieces gapless in sequences; returns padding and ids."""
    t, by, sequences = reference(), defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert bytes(r["ids"]) == ids[at:at + r["length"]].tobytes()
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, total


def test_packing_is_whole_and_tight(spark, small_texts):
    df = spark.createDataFrame(small_texts, "doc_id long, text string").repartition(3)
    padding, total = check_packing(packing.pack(df, WORDS).collect(), small_texts)
    assert padding < 0.01 * total


def test_packing_odd_rows(spark, odd, nothing):
    rows = packing.pack(odd, WORDS).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 30_001
    assert packing.pack(nothing, WORDS).count() == 0


def test_capacity_must_be_a_power_of_two(odd):
    with pytest.raises(ValueError):
        packing.pack(odd, WORDS, capacity=1000)


@given(st.integers(1, 20_000), st.sampled_from([64, 256, 4096]))
@settings(max_examples=200, deadline=None)
def test_cuts_fill_classes(n, capacity):
    parts = packing.cuts(n, capacity)
    assert sum(parts) == n and all(0 < p <= capacity for p in parts)
    for p in parts:
        j = capacity // p
        assert capacity - j * p <= max(packing.TOLERANCE * capacity, j)  # a bin of j such pieces is nearly full


@given(st.lists(st.text(alphabet=st.sampled_from(list("abS'sdréΣς.,<|> \n\t\x1c\x85̸İ 9½’中ガ\U0001f600")),
                        max_size=40), max_size=8))
@settings(max_examples=100, deadline=None)
def test_word_ids_equal_the_library(texts):
    coder, t = packing.word_ids(WORDS), reference()
    got = {}
    for a, b, ids, off in coder.batch(pa.array(texts, pa.string())):
        got.update({k: ids[off[k - a]:off[k - a + 1]].tolist() for k in range(a, b)})
    assert [got[k] for k in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@given(st.text(alphabet=st.sampled_from(list("ab's 1\n\t\x1c\x85.,é中  \U0001f600")), max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_bpe_parts_equal_the_library(text, limit):
    coder = bpe.Coder.of(RANKS, P.PATTERN)
    ids = coder.ids(text, limit).tolist()
    assert ids == coder.encoding.encode_ordinary(text)
    assert coder.encoding.decode_bytes(ids) == text.encode()


def test_bpe_round_trip(spark, odd, nothing, small_texts):
    df = spark.createDataFrame(small_texts, "doc_id long, text string")
    rows = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    enc = bpe.Coder.of(RANKS, P.PATTERN).encoding
    assert isinstance(enc, tiktoken.Encoding)
    want = dict(small_texts)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(want[r["doc_id"]])
        assert bytes(r["decoded"]).decode() == want[r["doc_id"]]
    got = bpe.decode(bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert [r["n_tokens"] for r in got.collect() if r["doc_id"] in (2, 3)] == [0, 0]
    assert bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


def test_white_space_beyond_the_library(spark):
    coder = bpe.Coder.of(RANKS, P.PATTERN)
    text = " " * 300_000 + "a"
    assert coder.encoding.decode_bytes(coder.ids(text).tolist()) == text.encode()


def test_crc_of_a_piece(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = packing.pack(df, WORDS).withColumn("crc", F.crc32("ids")).first()
    assert r["crc"] == zlib.crc32(bytes(r["ids"]))
