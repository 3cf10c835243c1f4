"""Regular strings on which sums of powers modulo 2**64 collide, and the operators that hash words or lines."""

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from telemill.llm import bpe, fingerprints, minmax, packing, repetition, text, toxicity
from tests.llm.cases import frame

N = 4096
THUE = "".join("ab"[bin(k).count("1") % 2] for k in range(N))
EHUT = THUE.translate(str.maketrans("ab", "ba"))


def test_spans_of_a_regular_make_have_different_hashes():
    rnd = np.random.default_rng(1)
    data = np.frombuffer((THUE + EHUT).encode(), np.uint8)
    for n in (1, 7, 8, 9, 63, 64, 65, 1024, 2048, 4096):
        a, b = text.span_hash(data, np.array([0, N]), np.array([n, N + n]))
        assert a != b
    data = rnd.integers(0, 256, 20_000).astype(np.uint8)
    start = rnd.integers(0, 19_000, 3000)
    end = start + rnd.integers(0, 120, 3000)
    h = text.span_hash(data, start, end)
    raw = data.tobytes()
    assert len(set(h.tolist())) == len({raw[a:b] for a, b in zip(start, end)})
    moved = text.span_hash(np.concatenate((rnd.integers(0, 256, 11).astype(np.uint8), data)), start + 11, end + 11)
    assert (moved == h).all()


def test_packing_and_sets_and_fingerprints_tell_them_apart(spark):
    docs = frame(spark, [(1, THUE), (2, EHUT), (3, f"{THUE} {EHUT}"), (4, THUE)]).coalesce(1)
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {}
    for r in packing.pack(docs, P.path("word_bpe_49k.json")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, t in ((1, THUE), (2, EHUT), (3, f"{THUE} {EHUT}")):
        assert [x for _, ids in sorted(got[i]) for x in ids] == coder.encode(t, add_special_tokens=False).ids + [2]
    near = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 1}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()} if hasattr(fingerprints, "fingerprints") else None
    if prints:
        assert prints[1] == prints[4] != prints[2]


def test_repeated_lines_and_words_are_counted_by_their_bytes():
    column = pa.array([f"{THUE}\n{EHUT}", f"{THUE}\n{THUE}", " ".join([THUE, "x", "y", "z", "w", EHUT, "x", "y", "z", "w"])])
    out = {k: np.concatenate([m[k] for m in repetition.measure(column)]).tolist() for k in ("n_dup_lines", "n_repeat_words")}
    assert out == {"n_dup_lines": [0, 1, 0], "n_repeat_words": [0, 0, 0]}


@pytest.mark.parametrize("odd", ["\x1c", "\x1c\x1d\x1e\x1f"])
def test_private_characters_stay_beside_separators(odd):
    coder = bpe.Coder.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    t = odd + "" + "a" * 60_000 + "" + odd
    assert coder.encoding.decode_bytes(coder.ids(t, 1000).tolist()) == t.encode()
    assert "".join(coder.matches(t)) == t


def test_every_significant_feature_is_kept(spark):
    """More toxic words than any fixed number of features would hold."""
    bad = " ".join(f"{a}{b}{c}{d}nk" for a in "bcdfghjk" for b in "aeiou" for c in "lmnprstvz" for d in "aeiou")
    docs = frame(spark, [(k, bad if k % 2 else "calm and quiet words of no harm at all") for k in range(160)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)], "doc_id long, toxic int")
    docs = toxicity.as_text(docs, "doc_id", "text")
    model = toxicity.train(docs, labels, toxicity.trigrams(docs))
    assert len(model["chosen"]) > 4000
