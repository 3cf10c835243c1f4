"""Byte-level BPE encoding and decoding with the tiktoken library.

The library is given a local rank file. A text over PART_CHARS is cut before
it is encoded, at places that no match of the split pattern crosses, so the
ids are those of the whole text. Ids travel as little-endian unsigned 32-bit
integers in a binary column; decoding joins the tokens' raw bytes, which need
not be valid UTF-8 for a part of a text.

Defined cases: null text counts as empty and gives no ids (decoded: no
bytes); equal rows are encoded each; an empty table gives an empty table; other
columns take no part in `encode` and stay in `decode`.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_text, documents, map_batches

#: A longer text is cut at safe boundaries; also the longest white space run left to the library's pattern.
PART_CHARS = 32_768
_coders: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """The encoding of a rank file, made once in each worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        # the place after a visible character and before one plain space or line feed is never inside a match
        self.safe = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> "Coder":
        if (ranks_path, pattern) not in _coders:
            _coders[ranks_path, pattern] = cls(ranks_path, pattern)
        return _coders[ranks_path, pattern]

    def parts(self, text: str, limit: int):
        """Parts of about `limit` characters, cut at safe places only."""
        at = 0
        while len(text) - at > limit:
            m = self.safe.search(text, at + limit)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:]

    def ids(self, text: str, limit: int = PART_CHARS) -> np.ndarray:
        if len(text) <= limit:
            return np.asarray(self.encoding.encode_ordinary(text), dtype="<u4")
        out = []
        for part in self.parts(text, limit):
            if len(part) <= 2 * limit:
                out.append(self.encoding.encode_ordinary(part))
            else:  # no safe place for long: match by match, as the library's own matcher would run out of stack
                out += [self.encoding._core_bpe.encode_single_piece(m.encode()) for m in self.matches(part)]
        return np.fromiter(itertools.chain.from_iterable(out), dtype="<u4")

    def matches(self, text: str):
        """The pattern's matches; the library counts as white space what Unicode does, without \\x1c to \\x1f."""
        odd = [c for c in range(0x1C, 0x20) if chr(c) in text]
        if odd:
            # private characters that the text lacks stand in for them; the pattern treats both as it treats other signs
            free = (k for k in range(0xE000, 0xF900) if chr(k) not in text)
            there = dict(zip(odd, free, strict=False))
            if len(there) < len(odd):
                raise ValueError("a text with every private character and no safe place")
            back = {v: k for k, v in there.items()}
            return [m.translate(back) for m in self.pattern.findall(text.translate(there))]
        return self.pattern.findall(text)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32 bit) of every whole text."""
    def run(batches):
        coder = Coder.of(ranks_path, pattern)
        for b in batches:
            ids = [coder.ids(t, part_chars) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_batches(as_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The given columns and `decoded`: the raw bytes of the ids."""
    names = encoded.columns
    at = names.index(ids_col)

    def run(batches):
        coder = Coder.of(ranks_path, pattern)
        for b in batches:
            out = [None if x is None else coder.encoding.decode_bytes(np.frombuffer(x, "<u4").tolist())
                   for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_batches(encoded, run, f"{schema}, decoded binary")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    ranks, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    out = decode(encode(documents(spark, sf_dir), ranks, pattern), ranks, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
