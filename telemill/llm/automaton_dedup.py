"""Removal of repeated passages of words, by suffix automata of reference shards.

Each word covered by a window of `width` consecutive words that also starts
anywhere else (the same document included) is removed; windows are judged on
the input.

Windows meet under their anchors (see anchors.py). Where segments under one
anchor differ, they are the references: whole groups of anchors fill shards
of at most SHARD_WORDS words, each shard's suffix automaton is built with the
number of places its states end at, and the segments stream through it. The
matching statistic is followed up to `width` words; where the state that
holds the last `width` words ends at two or more places, the window is a
repeat. A corpus-wide broadcast of automata would make every document pass
every shard; here each shard and the segments that can match it are dealt to
one task, so work grows with the input.

Defined cases: null text has no words; a text below `width` words keeps all;
equal rows are copies of each other; rows of one doc_id are documents of their
own; a row without doc_id takes part under a
name made from its text, and keeps the null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import HOT, Windows, beside, repeats
from .frames import as_text, documents
from .suffix_dedup import joined

WIDTH = 35
#: Words in a shard; a group of one anchor is never cut (it has at most `hot` segments of 2 * WIDTH words).
SHARD_WORDS = 50_000


def rule(width: int = WIDTH, hot: int = HOT) -> Windows:
    return Windows(width=width, gram=max(1, width // 3), words=True, first_only=False, hot=hot)


class SuffixAutomaton:
    """Suffix automaton of several word sequences; `ends` counts the places where a state's strings end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length, ends = self.next, self.link, self.length, self.ends
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # the string is known from an earlier sequence
                if length[q] == length[last] + 1:
                    last = q
                    ends[last] += 1
                    continue
                last = self._clone(last, w, q)
                ends[last] += 1
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            ends.append(1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.ends.append(0)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def count(self) -> None:
        """Carries the places of longer strings to their suffixes; once, after the last sequence."""
        length, link, ends = self.length, self.link, self.ends
        for s in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            ends[link[s]] += ends[s]

    def repeated(self, words: list[int], width: int) -> list[int]:
        """Places of the windows of `width` words that end at two or more places of the sequences."""
        nxt, link, length, ends = self.next, self.link, self.length, self.ends
        out, s, n = [], 0, 0
        for i, w in enumerate(words):
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            if n >= width:
                while length[link[s]] >= width:
                    s = link[s]
                n = width  # the last `width` words are what matters
                if ends[s] > 1:
                    out.append(i - width + 1)
        return out


def repeated_segments(e: np.ndarray, content: np.ndarray, off: np.ndarray, width: int = WIDTH,
                      shard_words: int = SHARD_WORDS) -> np.ndarray:
    """Entries (lo, m) of windows that occur twice or more among segments ordered by anchor."""
    group = np.flatnonzero(np.concatenate(([True], e["anchor"][1:] != e["anchor"][:-1])))
    group = np.append(group, len(e))
    segment, place = [], []
    i = 0
    while i < len(group) - 1:
        j = i + 1
        while j < len(group) - 1 and off[group[j + 1]] - off[group[i]] <= shard_words:
            j += 1
        shard = SuffixAutomaton()
        words = {k: content[off[k]:off[k + 1]].tolist() for k in range(group[i], group[j])}
        for w in words.values():
            shard.add(w)
        shard.count()
        for k, w in words.items():
            if e["mark"][k] & 1:
                hit = shard.repeated(w, width)
                segment += [k] * len(hit)
                place += hit
        i = j
    out = e[np.array(segment, np.int64)].copy()
    out["lo"] += np.array(place, np.uint32)
    out["m"] = 1
    return joined(out)


def _kept(data: np.ndarray, off: np.ndarray, gone: np.ndarray, toff: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Words removed, and the kept words joined by one space, of each document."""
    c = np.concatenate(([0], np.cumsum(gone)))
    removed = c[toff[1:]] - c[toff[:-1]]
    raw, keep = data.tobytes(), []
    for x, y, a, b, k in zip(toff[:-1].tolist(), toff[1:].tolist(), off[:-1].tolist(), off[1:].tolist(),
                             removed.tolist(), strict=True):
        words = raw[a:b].split()
        if k:
            words = [w for w, g in zip(words, gone[x:y].tolist(), strict=True) if not g]
        keep.append(b" ".join(words).decode())
    return removed, keep


def _named(carried: DataFrame) -> DataFrame:
    """Rows without doc_id take part under a name made from their text; who carries them knows that they have none."""
    return carried.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("text")))


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    docs = _named(as_text(docs, id_col, text_col, F.struct(docs[id_col].isNull().alias("null")).alias("rest")))
    own = rule(width, hot)
    spans, n = repeats(docs.drop("rest"), own, lambda e, c, o: repeated_segments(e, c, o, width))

    def result(ids, texts, rest, data, off, gone, toff):
        removed, keep = _kept(data, off, gone, toff)
        ids = pc.if_else(pc.struct_field(rest, "null"), pa.scalar(None, pa.int64()), ids)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(toff)), pa.array(removed), pa.array(keep, pa.string())],
                                          ["doc_id", "n_words", "n_removed", "kept"])

    return beside(spans, n, docs, own, result, "doc_id long, n_words long, n_removed long, kept string")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
            hot: int = HOT) -> DataFrame:
    """The documents with all their columns; a text that loses words is its kept words joined by one space."""
    names, own = docs.columns, rule(width, hot)
    kind = docs.schema[text_col].dataType
    carried = _named(as_text(docs, id_col, text_col, F.struct(*(docs[c] for c in names)).alias("rest")))
    spans, n = repeats(carried.drop("rest"), own, lambda e, c, o: repeated_segments(e, c, o, width))

    def result(ids, texts, rest, data, off, gone, toff):
        removed, keep = _kept(data, off, gone, toff)
        return pa.RecordBatch.from_arrays(
            [rest, pa.array([t if k else None for t, k in zip(keep, removed.tolist(), strict=True)], pa.string())],
            ["rest", "kept"])

    # the text travels once: outside of rest
    slim = F.struct(*(F.lit(None).cast(kind).alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in names))
    null = F.col("rest").getField(text_col).isNull()
    carried = carried.select("doc_id", "text", F.struct(slim.alias("row"), null.alias("null")).alias("rest"))
    schema = f"rest {carried.schema['rest'].dataType.simpleString()}, kept string, text string"

    def with_text(ids, texts, rest, data, off, gone, toff):
        b = result(ids, texts, rest, data, off, gone, toff)
        return pa.RecordBatch.from_arrays([*b.columns, texts.cast(pa.string())], ["rest", "kept", "text"])

    out = beside(spans, n, carried, own, with_text, schema)
    text = F.when(F.col("kept").isNotNull(), F.col("kept")).when(~F.col("rest.null"), F.col("text"))
    return out.select(*(text.cast(kind).alias(c) if c == text_col else F.col(f"rest.row.`{c}`").alias(c) for c in names))


def op4_suffix_automaton_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: All windows of 35 words.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
hit AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
b AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM t),
c AS (SELECT b.doc_id, j, word, coalesce(max(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (
               PARTITION BY b.doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.j = hit.i),
k AS (SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0), '') AS kept
      FROM c GROUP BY doc_id)
SELECT t.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
