"""Quality rules on repetition within a document, by a suffix array over words.

Documents are worked on in slices of bounded size. Word sequences of a slice
are sorted as suffixes: a suffix whose first `min_words` words occur once in
its document can't belong to a repeat and drops out before the sort; the rest
are ranked by prefix doubling (each round sorts only suffixes that still tie).
Longest common prefixes of neighbours in the suffix array bound the intervals
of maximal repeated substrings: the longest repeat that starts at a place is
the larger of its two neighbours' prefixes, and every maximal repeat of at
least `min_words` words is a union of such starts. Their spans are united; a
document fails if they cover more than `max_covered` of its words, or if its
longest repeat has more than `max_repeat` words.

Defined cases: null text counts as empty, has no words and fails the base
rule; equal rows are judged each; spans never leave a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import as_text, documents, map_batches
from .text import (IS_SPACE, mix, places_in_documents, slices, span_hash, window_hash,
                   word_spans)

#: Shortest repeat that counts, in words.
MIN_WORDS = 8
#: Largest fraction of a document's words inside repeats.
MAX_COVERED = 0.2
#: Longest repeat allowed, in words.
MAX_REPEAT = 100

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _per_document(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of `flags` between consecutive offsets."""
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def _salted(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The hashes, made different for each document."""
    doc = np.repeat(np.arange(1, len(off), dtype=np.uint64), np.diff(off))
    return mix(h ^ (doc * np.uint64(0xA24BAED4963EE407)))


def _covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Which of n places the spans cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:n]) > 0


def repeated_windows(h: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Places whose k words occur at another place of the same document too."""
    at = places_in_documents(off, k)
    if not len(at):
        return at
    doc = np.searchsorted(off, at, side="right").astype(np.uint64)
    g = mix(window_hash(h, k)[at] ^ (doc * np.uint64(0xA24BAED4963EE407)))
    order = np.argsort(g, kind="stable")
    g = g[order]
    same = g[1:] == g[:-1]
    tied = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    return at[np.sort(order[tied])]


def longest_repeats(h: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths): the longest repeat of at least min_words words that starts at each place.

    h: hashes of the words of many documents, off: the documents' offsets.
    """
    at = repeated_windows(h, off, min_words)
    if not len(at):
        return at, at
    n = int(off[-1])
    last = np.zeros(n + 1, np.int64)
    last[at] = off[np.searchsorted(off, at, side="right")]
    words = np.concatenate((h, [np.uint64(0)]))

    def next_words(place, stop):
        """The min_words words from each place, last one first; 0 past the document's end."""
        return [np.where(place + k < stop, words[np.minimum(place + k, n)], np.uint64(0))
                for k in reversed(range(min_words))]

    def changes(*keys):
        out = np.zeros(len(keys[0]), bool)
        out[:1] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
        return out

    # rank: 1 + place of the first suffix of its class in the order so far; 0: unlike any other, or past the end
    rank = np.zeros(n + 1, np.int64)
    keys = [*next_words(at, last[at]), last[at]]
    order = np.lexsort(keys)
    sa, levels, width = at[order], [], min_words
    group = np.maximum.accumulate(np.where(changes(*(k[order] for k in keys)), np.arange(len(sa)), 0))
    rank[sa] = group + 1
    while True:
        levels.append((width, rank.copy()))
        tie = np.concatenate((group[1:] == group[:-1], [False]))
        tie |= np.concatenate(([False], tie[:-1]))
        if not tie.any():
            break
        # the next words decide, then the rank of the block there; a place without a rank is unlike any other
        slot = np.flatnonzero(tie)
        place = sa[slot]
        follow = place + width
        second = rank[np.minimum(follow, n)]
        second = np.where((second > 0) & (follow < last[place]), second, -1 - place)
        keys = [second, *next_words(follow, last[place]), group[slot]]
        order = np.lexsort(keys)
        place = place[order]
        sa[slot] = place
        group[slot] = np.maximum.accumulate(np.where(changes(*(k[order] for k in keys)), slot, 0))
        rank[place] = group[slot] + 1
        width *= 2
    # common prefix of neighbours: the widest block that ties, then ever narrower ones, then single words
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for width, r in reversed(levels):
        same = (r[np.minimum(a, n)] > 0) & (r[np.minimum(a, n)] == r[np.minimum(b, n)])
        lcp += same * width
        a, b = a + same * width, b + same * width
    live = np.flatnonzero(lcp)
    stop_a, stop_b = last[sa[:-1]], last[sa[1:]]
    for _ in range(min_words):
        x, y = a[live], b[live]
        ok = (x < stop_a[live]) & (y < stop_b[live])
        ok &= words[np.minimum(x, n)] == words[np.minimum(y, n)]
        live = live[ok]
        lcp[live] += 1
        a[live] += 1
        b[live] += 1
    longest = np.maximum(np.concatenate(([0], lcp)), np.concatenate((lcp, [0])))
    return sa, longest


def measure(column: pa.Array, min_words: int = MIN_WORDS):
    """For each slice of texts a dictionary of arrays, one value per document."""
    for _, _, data, off in slices(column):
        space = IS_SPACE[data]
        start, end, woff = word_spans(data, off)
        h = span_hash(data, start, end)
        n_words = np.diff(woff)
        visible = ~space & ((data & 0xC0) != 0x80)
        # lines: from the start of a document or after a line feed
        first = np.zeros(len(data) + 1, bool)
        first[off[:-1]] = True
        first[1:] |= data == 10
        first[off[-1]:] = False
        line = np.flatnonzero(first)
        line_off = np.searchsorted(line, off, side="left")
        doc_end = np.repeat(off[1:], np.diff(line_off))
        line_end = np.minimum(np.concatenate((line[1:], off[-1:]))[:len(line)], doc_end)
        line_end -= (line_end > line) & (data[line_end - 1] == 10)
        has_word = np.concatenate(([0], np.cumsum(~space)))
        real = has_word[line_end] > has_word[line]
        lh = _salted(span_hash(data, line, line_end), line_off)
        idx = np.flatnonzero(real)
        order = idx[np.argsort(lh[idx], kind="stable")]
        dup = np.zeros(len(line), bool)
        dup[order[1:]] = lh[order[1:]] == lh[order[:-1]]
        five = _covered(len(h), repeated_windows(h, woff, 5), 5)
        place, length = longest_repeats(h, woff, min_words)
        keep = length >= min_words
        place, length = place[keep], length[keep]
        longest = np.zeros(len(off) - 1, np.int64)
        np.maximum.at(longest, np.searchsorted(woff, place, side="right") - 1, length)
        yield {
            "n_words": n_words, "word_chars": _per_document(visible, off),
            "n_symbols": _per_document(_SYMBOL[data], off), "n_dup_lines": _per_document(dup, line_off),
            "n_repeat_words": _per_document(five, woff),
            "covered_words": _per_document(_covered(len(h), place, length), woff), "longest_repeat": longest,
        }


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def verdicts(column: pa.Array, min_words: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    got = list(measure(column, min_words))
    out = {k: np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in NAMES}
    n = out["n_words"]
    out["base_failed"] = (n < 10) | (100 * out["n_repeat_words"] > 20 * n)
    out["kept"] = ~out["base_failed"] & (out["covered_words"] <= max_covered * n) & (out["longest_repeat"] <= max_repeat)
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
            max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, the counts of `measure`, base_failed and kept, one row per document."""
    names = [*NAMES, "base_failed", "kept"]

    def run(batches):
        for b in batches:
            out = verdicts(b.column(1), min_words, max_covered, max_repeat)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[k]) for k in names)], ["doc_id", *names])

    return map_batches(as_text(docs, id_col, text_col), run,
                       "doc_id long, " + ", ".join(f"{k} long" for k in NAMES) + ", base_failed boolean, kept boolean")


def filter_quality(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS,
                   max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents kept, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(verdicts(b.column(at), min_words, max_covered, max_repeat)["kept"]))

    return map_batches(docs, run, docs.schema)


def op6_suffix_repetition(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).drop("covered_words", "longest_repeat")


def _repeated_windows_sql(k: int) -> str:
    """(doc_id, i): windows of k words found twice or more in their document."""
    return f"""SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM (
    SELECT doc_id, i, md5_number(array_to_string(w[i:i + {k - 1}], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM t WHERE len(w) >= {k}))) WHERE n > 1"""


def _covered_words_sql(windows: str, k: int) -> str:
    """(doc_id, n): words covered by those windows."""
    return f"""SELECT doc_id, sum(gone) AS n FROM (
  SELECT b.doc_id, coalesce(max(CASE WHEN x.i IS NOT NULL THEN 1 ELSE 0 END) OVER (
           PARTITION BY b.doc_id ORDER BY j ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 0) AS gone
  FROM b LEFT JOIN {windows} x ON b.doc_id = x.doc_id AND b.j = x.i) GROUP BY doc_id"""


#: The same rules from all windows: repeats of at least MIN_WORDS words cover what repeated windows of MIN_WORDS
#: words cover, and the longest one is too long if a window of MAX_REPEAT + 1 words is repeated.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
b AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j FROM t),
five AS (%s), eight AS (%s), long AS (%s),
c5 AS (%s), c8 AS (%s),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
r AS (SELECT t.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             cast(len(regexp_extract_all(text, '[#*$%%&|<>]')) AS BIGINT) AS n_symbols,
             cast(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, cast(coalesce(c5.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(c8.n, 0) AS covered, t.doc_id IN (SELECT doc_id FROM long) AS too_long
      FROM t LEFT JOIN lines ON t.doc_id = lines.doc_id LEFT JOIN c5 ON t.doc_id = c5.doc_id LEFT JOIN c8 ON t.doc_id = c8.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND covered <= %s * n_words AND NOT too_long AS kept
FROM r
""" % (*(_repeated_windows_sql(k) for k in (5, MIN_WORDS, MAX_REPEAT + 1)), _covered_words_sql("five", 5),
       _covered_words_sql("eight", MIN_WORDS), MAX_COVERED)
