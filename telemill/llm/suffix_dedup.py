"""Byte-exact removal of repeated substrings, by blockwise suffix sorting with a difference cover.

Each byte covered by a string of `width` bytes that also starts in a document
with a smaller doc_id is removed; strings are judged on the input.

Strings meet under their anchors (see anchors.py). Where segments under one
anchor differ, their suffixes are sorted to the depth of `width` bytes:

* the cover sample holds the places whose residue modulo PERIOD is in COVER,
  a difference cover: for any two suffixes there is a shift below PERIOD that
  takes both to sample places. Sample places are ranked first, by the
  `width - GAP` bytes that start there;
* suffixes are then sorted one bucket of leading bytes at a time, of at most
  BLOCK suffixes: by their next GAP bytes, then by the rank of the first
  sample place from there (what is left of a long tie), then by their last
  GAP bytes. Segments are laid out with their anchors at residue 0, so equal
  strings have equal residues and reach the same sample place.

Equal neighbours in that order are one string; the least doc_id among them
keeps it.

Defined cases: null text counts as empty; a text below `width` bytes keeps all;
rows of one doc_id don't remove each other's strings; equal rows get equal
results; a row without doc_id takes no part and keeps all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import ENTRY, HOT, Windows, beside, repeats
from .frames import as_text, documents

WIDTH = 50
#: A difference cover modulo 13; its largest gap.
PERIOD, COVER, GAP = 13, (0, 1, 3, 9), 6
#: Suffixes sorted at once.
BLOCK = 400_000


def rule(width: int = WIDTH, hot: int = HOT) -> Windows:
    return Windows(width=width, gram=max(1, 2 * width // 5), words=False, first_only=True, hot=hot)


def _number(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n <= 8 bytes from each place as a number, first byte highest."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | x[at + k]
    return out


def _ranks(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each row in it, equal rows alike), first column most significant."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.cumsum(new)


def classes(x: np.ndarray, place: np.ndarray, width: int):
    """Sorted blocks of suffixes: (places in order, number of each one's string within the block).

    x: bytes, followed by at least PERIOD + width more; place: where strings of `width` bytes start.
    """
    depth = width - GAP
    to_sample = np.array([next(k for k in range(PERIOD) if (r + k) % PERIOD in COVER) for r in range(PERIOD)])
    sample = np.unique(place + to_sample[place % PERIOD])
    order, rank = _ranks([_number(x, sample + k, min(8, depth - k)) for k in range(0, depth, 8)])
    by_place = np.empty(len(sample), np.int64)
    by_place[order] = rank
    # buckets by the two leading bytes, of about BLOCK suffixes at most
    lead = _number(x, place, 2).astype(np.int64)
    size = np.bincount(lead, minlength=1 << 16)
    bucket = (np.cumsum(size) - size) // BLOCK
    part = bucket[lead]
    for b in np.unique(part):
        p = place[part == b]
        shift = to_sample[p % PERIOD]
        order, name = _ranks([_number(x, p, GAP), shift.astype(np.uint64), by_place[np.searchsorted(sample, p + shift)],
                              _number(x, p + depth, GAP)])
        yield p[order], name


def repeated_segments(e: np.ndarray, content: np.ndarray, off: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Entries (one window each) of strings that also start in a smaller doc_id."""
    length = np.diff(off)
    room = (length + PERIOD + PERIOD - 1) // PERIOD * PERIOD
    begin = np.cumsum(room) - room + (-e["at"].astype(np.int64)) % PERIOD  # anchors lie at residue 0
    x = np.zeros(int(room.sum()) + 2 * (width + PERIOD), np.uint64)
    x[np.repeat(begin - off[:-1], length) + np.arange(off[-1])] = content
    m = e["m"].astype(np.int64)
    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    of = np.repeat(np.arange(len(e)), m)
    place = begin[of] + step
    segment = np.zeros(len(x), np.int32)
    segment[place] = of
    doc, found = e["doc"], []
    for p, name in classes(x, place, width):
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        own = doc[segment[p]]
        least = np.minimum.reduceat(own, first)[name]
        found.append(p[own > least])
    p = np.concatenate(found) if found else np.zeros(0, np.int64)
    out = e[segment[p]].copy()
    out["lo"] += (p - begin[segment[p]]).astype(np.uint32)
    out["m"] = 1
    return joined(out)


def joined(e: np.ndarray) -> np.ndarray:
    """Single windows of one segment that follow each other, as one entry (of at most 255 windows)."""
    e = e[np.lexsort((e["lo"], e["tag"], e["doc"]))]
    if not len(e):
        return e.astype(ENTRY)
    new = (e["doc"][1:] != e["doc"][:-1]) | (e["tag"][1:] != e["tag"][:-1]) | (e["lo"][1:] != e["lo"][:-1] + 1)
    first = np.flatnonzero(np.concatenate(([True], new)))
    run = np.arange(len(e)) - np.repeat(first, np.diff(np.append(first, len(e))))
    first = np.flatnonzero(run % 255 == 0)
    out = e[first].copy()
    out["m"] = np.diff(np.append(first, len(e)))
    return out


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes)."""
    docs, own = as_text(docs, id_col, text_col), rule(width, hot)
    spans, n = repeats(docs, own, lambda e, c, o: repeated_segments(e, c, o, width))

    def result(ids, texts, rest, data, off, gone, toff):
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1
        first = off[:-1][np.diff(off) > 0]
        edge[first] = gone[first]
        c, s = (np.concatenate(([0], np.cumsum(v))) for v in (gone, edge))
        keep = [data[x:y][~gone[x:y]].tobytes() if c[y] > c[x] else data[x:y].tobytes()
                for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([
            ids, pa.array(np.diff(off)), pa.array(c[off[1:]] - c[off[:-1]]), pa.array(s[off[1:]] - s[off[:-1]]),
            pa.array(keep, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return beside(spans, n, docs, own, result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    out = remove_repeated_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of 50 bytes, in hexadecimal.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, cast(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
g AS (SELECT doc_id, i, md5_number(substr(hx, 2 * i + 1, 100)) AS h
      FROM (SELECT doc_id, hx, unnest(range(0, n - 49)) AS i FROM t WHERE n >= 50)),
hit AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT h, min(doc_id) AS first FROM g GROUP BY h) f ON g.h = f.h AND g.doc_id > f.first),
b AS (SELECT doc_id, hx, unnest(range(0, n)) AS j FROM t),
c AS (SELECT b.doc_id, j, substr(hx, 2 * j + 1, 2) AS x,
             coalesce(max(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY j
                      ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.j = hit.i),
d AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM c),
k AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans,
             coalesce(string_agg(x, '' ORDER BY j) FILTER (WHERE gone = 0), '') AS kept FROM d GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       cast(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
