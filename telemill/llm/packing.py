"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length n belongs to the reciprocal-capacity class j = capacity // n
(n lies in (capacity/(j+1), capacity/j]), and a bin of class j takes exactly j
pieces. Pieces may be cut freely, so a document is first cut into whole
sequences (class 1, no padding); the rest is cut at capacity // (j+1), which
fills a bin of class j+1, as long as what it would waste in class j exceeds
`tolerance` of the capacity. The cut-off remainder shrinks with the square of
the class, so a document has few pieces.

Each task fills the bins of its own partition, without a shuffle, and keeps at
most j-1 pieces of a class. What is left in incomplete bins at its end is laid
end to end and cut into full sequences; the last of these is cut into
sequences whose lengths are powers of two, which are not padded. Sequence ids
are partition number * 2**40 + a running number, so a task that is run again
gives the same ids.

Defined cases: null text counts as empty: a document of the end id alone;
equal rows are packed each; a null doc_id stays null; other columns take no
part.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_text, documents, map_batches
from .text import IS_SPACE, slices, span_hash

CAPACITY = 4096
END_ID = 2
TOLERANCE = 1 / 256
#: Words whose ids a worker keeps; beyond it starts again.
KNOWN_WORDS = 600_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class WordIds:
    """Ids of texts by the tokenizers library, each different word encoded once.

    The tokenizer drops white space and lowers case, and none of its pieces
    crosses white space or the place between an ASCII letter and an ASCII
    mark other than the apostrophe; so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.begin, self.count = np.zeros(KNOWN_WORDS * 2, np.int64), np.zeros(KNOWN_WORDS * 2, np.int64)

    def spans(self, data: np.ndarray, off: np.ndarray):
        n = len(data)
        word = ~IS_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[off] = True
        cut = np.zeros(n + 1, bool)
        cut[1:n] = word[1:] != word[:-1]
        cut[1:n] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cut |= first
        cut[n] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        keep = word[start]
        start, end = start[keep], end[keep]
        return start, end, np.searchsorted(start, off, side="left")

    def learn(self, words: list[bytes], hashes: list[int]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        ids = [e.ids for e in found]
        at = len(self.number)
        if at + len(ids) > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros(len(ids) + len(self.begin), np.int64)))
            self.count = np.concatenate((self.count, np.zeros(len(ids) + len(self.count), np.int64)))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used:self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.begin[at:at + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.count[at:at + len(ids)] = sizes
        self.used += total
        self.number.update(zip(hashes, range(at, at + len(ids)), strict=True))

    def batch(self, column: pa.Array):
        """For each slice of texts: (first row, end row, all ids, offsets of the ids)."""
        for a, b, data, off in slices(column):
            if not len(data):
                yield a, b, np.zeros(0, np.uint32), np.zeros(b - a + 1, np.int64)
                continue
            upper = (data >= 65) & (data <= 90)
            data = data + upper * np.uint8(32)
            start, end, words_off = self.spans(data, off)
            codes, uniques = pd.factorize(span_hash(data, start, end))
            if len(self.number) > KNOWN_WORDS:
                self.clear()
            number = self.number
            hashes = uniques.tolist()
            new = [i for i, h in enumerate(hashes) if h not in number]
            if new:
                place = np.empty(len(uniques), np.int64)
                place[codes[::-1]] = np.arange(len(codes))[::-1]
                raw = data.tobytes()
                self.learn([raw[start[place[i]]:end[place[i]]] for i in new], [hashes[i] for i in new])
            which = np.fromiter((number[h] for h in hashes), np.int64, len(hashes))[codes] if len(codes) else codes
            count = self.count[which]
            to = np.concatenate(([0], np.cumsum(count)))
            ids = self.flat[np.repeat(self.begin[which] - to[:-1], count) + np.arange(to[-1])]
            yield a, b, ids, to[words_off]


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def cuts(n: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        piece = capacity // (j + 1)
        if capacity - j * rest <= tolerance * capacity or piece == 0:
            out.append(rest)
            break
        out.append(piece)
        rest -= piece
    return out


class Bins:
    """The open bins of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, tolerance: float, first: int):
        self.capacity, self.tolerance, self.next = capacity, tolerance, first
        self.open: dict[int, list] = {}
        self.done: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.done.append((doc_id, start, len(ids), ids.tobytes(), n, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        for n in cuts(len(ids), self.capacity, self.tolerance):
            j = self.capacity // n
            held = self.open.setdefault(j, [])
            held.append((doc_id, at, ids[at:at + n].copy(), len(ids)))
            at += n
            if len(held) == j:
                self.close(self.open.pop(j))

    def finish(self) -> None:
        """Incomplete bins, largest pieces first, as full sequences and then powers of two."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open = {}
        rest = sum(len(p[2]) for p in left)
        room, held = 0, []
        for doc_id, start, ids, n in left:
            while len(ids):
                if not room:
                    room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
                take = min(room, len(ids))
                held.append((doc_id, start, ids[:take], n))
                start, ids, room, rest = start + take, ids[take:], room - take, rest - take
                if not room:
                    self.close(held)
                    held = []

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned
    32 bit), doc_tokens, sequence_id, offset.

    The partitions of `docs` are packed independently of each other. Pieces of
    a sequence lie at gapless offsets from 0. A sequence has at most `capacity`
    ids; a shorter one is padded to it, unless its length is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches):
        from pyspark import TaskContext
        coder = word_ids(tokenizer_path)
        bins = Bins(capacity, tolerance, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4")
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, last, ids, off in coder.batch(b.column(1)):
                for k in range(first, last):
                    bins.add(doc_ids[k], np.concatenate((ids[off[k - first]:off[k - first + 1]], end)))
                yield bins.take()
        bins.finish()
        yield bins.take()

    return map_batches(as_text(docs, id_col, text_col), run,
                       "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op1_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    out = pack(documents(spark, sf_dir), P.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")
