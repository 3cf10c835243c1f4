"""Long repeats over a corpus: windows meet under the anchor they contain.

A window is `width` consecutive tokens (words or bytes) of one document. Its
anchor is the one of its `gram`-token strings with the least hash, the first
of equals; equal windows have equal anchors at the same place. Consecutive
windows with one anchor make a segment, so all occurrences of a window lie in
segments under one anchor, and only these need to meet. Equal segments are
settled by hash there; segments that share an anchor but not their whole text
are fetched and handed to an exact operator (`exact`), in groups of bounded
size. Segments of an anchor with over `hot` different texts go on as single
windows, dealt out by the window's hash instead.

Rows are moved as blobs: all entries of a task's input that go to one bucket
are one binary value, repeats within that input having been settled before.
So a passage that a third of all documents hold sends one entry for each such
input, not one for each document.

Everything is dealt out by hash into buckets whose number grows with the
input; each bucket has a bounded expected size and is gathered in one task,
which goes through its buckets one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import MOST_TASKS, buckets, map_batches, total_bytes, written
from .text import _TABLE, mix, powers, slices, span_hash, window_min, word_spans

#: In memory: anchor and context (names the segment's text) of 48 bits, document, a tag of its text, first window,
#: number of windows, the anchor's place in the segment, what the rule marked.
ENTRY = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("tag", "<u2"), ("lo", "<u4"), ("m", "<u1"),
                  ("at", "<u1"), ("mark", "<u1")])
#: Bytes of text whose segments are settled among themselves before they are dealt out.
INPUT_BYTES = 24_000_000
#: Bytes of text for each bucket, and different texts under one anchor from which it is split.
BUCKET_BYTES, HOT = 8_000_000, 1000
MASK48 = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Windows:
    """What a window is, and which occurrences are repeats.

    first_only: occurrences in documents after the first (by id) are repeats;
    otherwise all occurrences of what occurs twice or more are. hot: different texts under one
    anchor beyond which it is split.
    """
    width: int
    gram: int
    words: bool
    first_only: bool
    hot: int = HOT

    def tokens(self, data: np.ndarray, off: np.ndarray):
        """Token hashes, offsets of documents in tokens, and starts and ends of tokens in bytes."""
        if not self.words:
            return _TABLE[data], off, None, None
        start, end, words = word_spans(data, off)
        return span_hash(data, start, end), words, start, end


def segments(tokens: np.ndarray, off: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Entries of all segments of documents with token offsets `off`; `doc` is the place in off."""
    n = len(tokens)
    if n < width:
        return np.zeros(0, ENTRY)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * powers(n), out=c[1:])
    g = mix((c[gram:] - c[:-gram]) * powers(n - gram + 1, inverse=True))
    low = np.uint64((1 << n.bit_length()) - 1)
    least = window_min((g & ~low) | np.arange(len(g), dtype=np.uint64), width - gram + 1)
    anchor = (least & low).astype(np.int64)
    room = np.repeat(off[1:], np.diff(off))[:len(anchor)] - np.arange(len(anchor))
    place = np.flatnonzero(room >= width)
    if not len(place):
        return np.zeros(0, ENTRY)
    anchor = anchor[place]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1))))
    lo, anchor = place[first], anchor[first]
    m = np.diff(np.append(first, len(place)))
    out = np.zeros(len(lo), ENTRY)
    out["anchor"] = g[anchor] & MASK48
    end = lo + m + (width - 1)
    out["context"] = mix(mix((c[end] - c[lo]) * powers(n + 1, inverse=True)[lo])
                         + (anchor - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + m.astype(np.uint64)) & MASK48
    doc = np.searchsorted(off, lo, side="right") - 1
    out["doc"], out["lo"], out["m"], out["at"] = doc, lo - off[doc], m, anchor - lo
    return out


def text_tags(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16 bits of each text's hash, to tell rows of one doc_id apart."""
    return (span_hash(data, off[:-1], off[1:]) >> np.uint64(48)).astype(np.uint16)


# ---- blobs

def pack(e: np.ndarray) -> bytes:
    """The entries, column by column."""
    base = int(e["doc"].min())
    wide = int(e["doc"].max()) - base >= 1 << 32
    doc = (e["doc"] - base).astype("<u8" if wide else "<u4")
    head = np.array([len(e), base, wide], "<i8")
    parts = [head, (e["anchor"] >> np.uint64(16)).astype("<u4"), e["anchor"].astype("<u2"),
             (e["context"] >> np.uint64(16)).astype("<u4"), e["context"].astype("<u2"), doc,
             *(np.ascontiguousarray(e[k]) for k in ("tag", "lo", "m", "at", "mark"))]
    return b"".join(p.tobytes() for p in parts)


def unpack(blob: bytes) -> np.ndarray:
    n, base, wide = np.frombuffer(blob, "<i8", 3).tolist()
    e, at = np.zeros(n, ENTRY), 24

    def column(kind):
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    for k in ("anchor", "context"):
        e[k] = column("<u4").astype(np.uint64) << np.uint64(16)
        e[k] |= column("<u2")
    e["doc"] = column("<u8" if wide else "<u4").astype(np.int64) + base
    for k, kind in (("tag", "<u2"), ("lo", "<u4"), ("m", "u1"), ("at", "u1"), ("mark", "u1")):
        e[k] = column(kind)
    return e


def split(e: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(e):
        order = np.argsort(bucket, kind="stable")
        e, bucket = e[order], bucket[order]
        edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for x, y in zip([0, *edge], [*edge, len(e)], strict=True):
            yield int(bucket[x]), e[x:y]


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """As doc_bucket_column; n is a prime."""
    x = doc ^ (doc >> 20) ^ (doc >> 40)
    return x % n


def doc_bucket_column(n: int):
    return F.expr(f"cast(pmod(doc_id ^ shiftright(doc_id, 20) ^ shiftright(doc_id, 40), {n}) as int)")


def next_prime(n: int) -> int:
    while any(n % p == 0 for p in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


#: Kinds of rows: entries to meet, fetched segments to settle exactly, spans found, segments to fetch.
MEET, SETTLE, SPANS, FETCH = 0, 1, 2, 3
ROW = "bucket int, kind int, blob binary"


def rows(kind: int, parts) -> pa.RecordBatch:
    """parts: (bucket, entries)."""
    got = [(b, pack(e)) for b, e in parts]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()),
                                       pa.array([kind] * len(got), pa.int32()),
                                       pa.array([x for _, x in got], pa.binary())], ["bucket", "kind", "blob"])


# ---- the rule

def _classes(e: np.ndarray):
    """Entries in order, first entry of each (anchor, context), first class of each anchor."""
    e = e[np.lexsort((e["lo"], e["doc"], e["context"], e["anchor"]))]
    new_anchor = np.concatenate(([True], e["anchor"][1:] != e["anchor"][:-1]))
    first = np.flatnonzero(new_anchor | np.concatenate(([True], e["context"][1:] != e["context"][:-1])))
    return e, first, np.flatnonzero(new_anchor[first])


def settle(e: np.ndarray, rule: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(repeats known now, entries that stand for the rest) among entries of one input or bucket."""
    if not len(e):
        return e, e
    e, first, _ = _classes(e)
    size = np.diff(np.append(first, len(e)))
    of = np.repeat(np.arange(len(first)), size)
    if rule.first_only:
        later = e["doc"] > e["doc"][first][of]
        return e[later], e[~later]
    # mark 1: the class occurs twice or more, and those occurrences have been told
    told = np.zeros(len(first), bool)
    np.logical_or.at(told, of, e["mark"] > 0)
    twice = told | (size > 1)
    repeats = e[twice[of] & (e["mark"] == 0)]
    keep = np.ones(len(e), bool)
    keep[twice[of]] = False
    keep[first[twice]] = True
    e["mark"][first[twice]] = 1
    return repeats, e[keep]


def meet(e: np.ndarray, rule: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(repeats, segments whose texts must be compared) of one bucket.

    Of the latter, mark bit 1: may hold windows that repeat others; bit 2: the anchor is hot.
    """
    repeats, e = settle(e, rule)
    if not len(e):
        return repeats, e
    e, first, anchors = _classes(e)
    kinds = np.diff(np.append(anchors, len(first)))
    size = np.diff(np.append(first, len(e)))
    group = np.repeat(np.arange(len(anchors)), kinds)
    if rule.first_only:
        least = np.minimum.reduceat(e["doc"][first], anchors)
        need = e["doc"][first] > least[group]
    else:
        need = e["mark"][first] == 0
    go = (kinds > 1) & np.logical_or.reduceat(need, anchors)
    mark = need.astype(np.uint8) + 2 * (kinds[group] > rule.hot).astype(np.uint8)
    keep = np.repeat(go[group], size)
    e["mark"] = np.repeat(mark, size)
    return repeats, e[keep]


# ---- stages

def _dealt(docs: DataFrame, rule: Windows, n: int, input_bytes: int) -> DataFrame:
    """Entries of all segments by anchor, repeats within a task's input settled."""
    def run(batches):
        held, size = [], 0

        def flush():
            e = np.concatenate(held) if held else np.zeros(0, ENTRY)
            repeats, rest = settle(e, rule)
            yield rows(SPANS, split(repeats, doc_bucket(repeats["doc"], n)))
            yield rows(MEET, split(rest, (rest["anchor"] % np.uint64(n)).astype(np.int64)))

        for b in batches:
            ids = b.column(0).to_numpy()
            for x, y, data, off in slices(b.column(1)):
                tokens, toff, _, _ = rule.tokens(data, off)
                e = segments(tokens, toff, rule.width, rule.gram)
                e["tag"] = text_tags(data, off)[e["doc"]]
                e["doc"] = ids[x:y][e["doc"]]
                held.append(e)
                size += len(data)
            if size >= input_bytes:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return map_batches(docs, run, ROW)


def _by_bucket(df: DataFrame, n: int, fn: Callable) -> DataFrame:
    """fn(kind -> blobs of the bucket) -> batches of rows, for each bucket; buckets of SPANS rows pass."""
    def run(batches):
        at, held = None, {}
        for b in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at and held:
                    yield from fn(held)
                    held = {}
                at = bucket
                held.setdefault(kind, []).append(blob)
        if held:
            yield from fn(held)

    return map_batches(df.repartition(min(n, MOST_TASKS), "bucket").sortWithinPartitions("bucket"), run, ROW)


def _beside_texts(df: DataFrame, docs: DataFrame, n: int, fn: Callable, schema: str) -> DataFrame:
    """fn(entries of a bucket of documents, doc_ids, texts, rest) -> batches, without a join.

    docs: doc_id, text and, where the caller wants other columns back, a struct
    named rest. Rows without doc_id come with no entries, in buckets chosen by
    their text.
    """
    place = F.coalesce(doc_bucket_column(n), F.pmod(F.xxhash64("text"), F.lit(n)).cast("int"))
    names = [c for c in ("doc_id", "text", "rest") if c in docs.columns]
    text = docs.select(place.alias("bucket"), F.lit(9).alias("kind"), F.lit(None).cast("binary").alias("blob"), *names)
    both = df.select("bucket", "kind", "blob", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in names)
                     ).unionByName(text)

    def run(batches):
        at, held, entries = None, [], None
        for b in batches:
            bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | ((kind[1:] == 9) != (kind[:-1] == 9))) + 1
            for x, y in zip([0, *edge], [*edge, len(bucket)], strict=True):
                if x == y:
                    continue
                if bucket[x] != at:
                    at, held, entries = bucket[x], [], None
                part = b.slice(x, y - x)
                if kind[x] != 9:
                    held += [unpack(v) for v in part.column(2).to_pylist()]
                else:
                    if entries is None:
                        e = np.concatenate(held) if held else np.zeros(0, ENTRY)
                        entries, held = e[np.lexsort((e["lo"], e["tag"], e["doc"]))], []
                    yield from fn(entries, *part.columns[3:])

    return map_batches(both.repartition(min(n, MOST_TASKS), "bucket").sortWithinPartitions("bucket", "kind"), run, schema)


def of_documents(entries: np.ndarray, ids: np.ndarray, null: np.ndarray, tags: np.ndarray):
    """Place in `entries` (sorted by doc, tag) of the first and past the last entry of each document."""
    key = np.zeros(len(ids), [("doc", "<i8"), ("tag", "<u2")])
    key["doc"], key["tag"] = ids, tags
    have = np.zeros(len(entries), key.dtype)
    have["doc"], have["tag"] = entries["doc"], entries["tag"]
    x, y = (np.searchsorted(have, key, side=s) for s in ("left", "right"))
    return np.where(null, 0, x), np.where(null, 0, y)


def _fetched(found: DataFrame, docs: DataFrame, rule: Windows, n: int) -> DataFrame:
    """Texts of the segments to compare: blobs of entries followed by their token hashes or bytes."""
    def run(entries, ids, texts):
        null = np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy()
        out, hot = [], []
        for x, y, data, off in slices(texts):
            tokens, toff, _, _ = rule.tokens(data, off)
            a, b = of_documents(entries, ids[x:y], null[x:y], text_tags(data, off))
            doc = np.repeat(np.arange(y - x), b - a)
            if not len(doc):
                continue
            e = entries[np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange(len(doc))]
            start = toff[doc] + e["lo"]
            content = tokens if rule.words else data
            warm = (e["mark"] & 2) > 0
            if warm.any():
                w, s = e[warm], start[warm]
                m = w["m"].astype(np.int64)
                step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                one = np.repeat(w, m)
                c = np.zeros(len(tokens) + 1, np.uint64)
                np.cumsum(tokens * powers(len(tokens)), out=c[1:])
                p = np.repeat(s, m) + step
                name = mix((c[p + rule.width] - c[p]) * powers(len(tokens) + 1, inverse=True)[p])
                one["anchor"], one["context"] = name & MASK48, mix(name) & MASK48
                one["lo"] += step.astype(np.uint32)
                one["m"], one["at"], one["mark"] = 1, 0, 0
                hot.append(one)
            e, start = e[~warm], start[~warm]
            for bucket, i in split(np.arange(len(e)), (e["anchor"] % np.uint64(n)).astype(np.int64)):
                part = [content[s:s + k] for s, k in
                        zip(start[i].tolist(), (e["m"][i].astype(np.int64) + rule.width - 1).tolist(), strict=True)]
                out.append((bucket, pack(e[i]) + np.concatenate(part).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()),
                                              pa.array([SETTLE] * len(out), pa.int32()),
                                              pa.array([x for _, x in out], pa.binary())], ["bucket", "kind", "blob"])
        if hot:
            repeats, rest = settle(np.concatenate(hot), rule)
            yield rows(SPANS, split(repeats, doc_bucket(repeats["doc"], n)))
            yield rows(MEET, split(rest, (rest["anchor"] % np.uint64(n)).astype(np.int64)))

    return _beside_texts(found, docs, n, run, ROW)


def segment_texts(blobs: list[bytes], rule: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, contents end to end, offsets) of fetched segments, ordered by anchor."""
    es, texts = [], []
    for blob in blobs:
        e = unpack(blob)
        size = int((e["m"].astype(np.int64) + rule.width - 1).sum()) * (8 if rule.words else 1)
        es.append(e)
        texts.append(np.frombuffer(blob, "<u8" if rule.words else "u1", offset=len(blob) - size))
    e, content = np.concatenate(es), np.concatenate(texts)
    length = e["m"].astype(np.int64) + rule.width - 1
    start = np.cumsum(length) - length
    order = np.lexsort((e["lo"], e["tag"], e["doc"], e["anchor"]))
    e, start, length = e[order], start[order], length[order]
    off = np.concatenate(([0], np.cumsum(length)))
    return e, content[np.repeat(start - off[:-1], length) + np.arange(off[-1])], off


def repeats(docs: DataFrame, rule: Windows, exact: Callable, bucket_bytes: int = BUCKET_BYTES,
            input_bytes: int = INPUT_BYTES) -> tuple[DataFrame, int]:
    """(rows of SPANS: repeated windows by bucket of documents, number of buckets).

    exact(entries, contents, offsets) -> entries of the repeats (lo, m) among fetched segments, which come
    ordered by anchor.
    """
    n = next_prime(buckets(total_bytes(docs), bucket_bytes))
    known = docs.where("doc_id IS NOT NULL")

    def first(held):
        if MEET in held:
            found, more = meet(np.concatenate([unpack(b) for b in held[MEET]]), rule)
            yield rows(SPANS, split(found, doc_bucket(found["doc"], n)))
            yield rows(FETCH, split(more, doc_bucket(more["doc"], n)))
        yield passed(held)

    def second(held):
        if SETTLE in held:
            found = exact(*segment_texts(held[SETTLE], rule))
            yield rows(SPANS, split(found, doc_bucket(found["doc"], n)))
        if MEET in held:
            found, _ = settle(np.concatenate([unpack(b) for b in held[MEET]]), rule)
            yield rows(SPANS, split(found, doc_bucket(found["doc"], n)))
        yield passed(held)

    def passed(held):
        blobs = held.get(SPANS, [])
        return pa.RecordBatch.from_arrays([
            pa.array([_bucket_of(b, n) for b in blobs], pa.int32()),
            pa.array([SPANS] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

    met = written(_by_bucket(_dealt(known, rule, n, input_bytes), n, first))
    settled = written(_by_bucket(_fetched(met.where(F.col("kind") == FETCH), known, rule, n), n, second))
    spans = met.where(F.col("kind") == SPANS).unionByName(settled.where(F.col("kind") == SPANS))
    return spans, n


def _bucket_of(blob: bytes, n: int) -> int:
    """The bucket of documents of a blob of spans: that of its least doc_id, which the blob names."""
    return int(doc_bucket(np.frombuffer(blob, "<i8", 1, 8), n)[0])


def covered(entries: np.ndarray, doc: np.ndarray, toff: np.ndarray, width: int) -> np.ndarray:
    """Which tokens (of documents with offsets toff) the entries' windows cover."""
    d = np.zeros(int(toff[-1]) + 1, np.int64)
    start = toff[doc] + entries["lo"]
    np.add.at(d, start, 1)
    np.add.at(d, start + entries["m"] + (width - 1), -1)
    return np.cumsum(d[:-1]) > 0


def beside(spans: DataFrame, n: int, docs: DataFrame, rule: Windows, fn: Callable, schema: str) -> DataFrame:
    """fn(ids, texts and rest (Arrow), data, byte offsets, covered tokens, token offsets) -> batch, by slice of texts."""
    def run(entries, ids, texts, rest=None):
        null = np.asarray(ids.is_null())
        number = ids.fill_null(0).to_numpy()
        for x, y, data, off in slices(texts):
            tags = text_tags(data, off)
            toff = word_spans(data, off)[2] if rule.words else off
            a, b = of_documents(entries, number[x:y], null[x:y], tags)
            doc = np.repeat(np.arange(y - x), b - a)
            e = entries[np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange(len(doc))]
            yield fn(*(c if c is None else c.slice(x, y - x) for c in (ids, texts, rest)), data, off,
                     covered(e, doc, toff, rule.width), toff)

    return _beside_texts(spans, docs, n, run, schema)
