"""Periodic runs of words, found in tiles for each octave of periods.

A run is a stretch of words with least period q, at least `least` words and
`exponent` periods long, that no neighbouring word extends keeping period q.

For periods of an octave [P, 2P), boundaries lie every P words. A run of period
p has an equality stretch (places i whose words i and i + p are the same) of at
least 3p places, so it holds 2P such places from its first boundary on. That
gives three steps:

1. Explode. The words of a document become numbers. At each boundary the hash of
   2P words is compared with the hashes P to 2P - 1 words later; boundaries
   without an equal one hold no run of the octave. Tiles around the others,
   overlapping by what a boundary needs, become rows: (row, octave, tile).
   Boundaries inside a known stretch of a period below P are left out: any run
   of the octave there would have that period too.
2. Solve. Each tile goes to any task. At each of its boundaries one Z-function
   of the words to the right and one of the words to the left, reversed, give
   for every period of the octave how far the equality stretch reaches.
3. Stitch. The stretches are shuffled by (row, period), and those that touch are
   joined. Stretches of at least max(least, 4p) words that lie in no run of a
   smaller period are the runs.

Words are compared by their bytes: hashes only leave out boundaries. Documents
without such a boundary are ready after step 1; only the others are shuffled.

Defined cases: null or empty text has no words and no runs; rows are judged one
by one, so repeated rows give repeated results and rows without doc_id keep the
null (and are never altered); other columns take no part.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import as_text, documents, map_batches, written
from .text import mix, powers

#: Least words of a run, and least number of periods in it.
LEAST, EXPONENT = 6, 4
#: Words between the starts of tiles (four times the octave's P, if that is more).
TILE_WORDS = 2048
#: Text whose words are numbered and hashed at once; a longer document is worked on alone.
SLICE_BYTES = 2_000_000
#: Tiles for each task of the second step.
TILES_A_TASK = 2000

#: Kinds of rows after the first step.
READY, WORDS, TILE = 0, 1, 2
ROW = "kind int, row long, doc_id long, octave int, base long, blob binary, sha string"
RUNS = "array<struct<start:long,length:long,period:long>>"


def altered(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p): words from a on repeat with period p, for a tenth of the documents."""
    if n == 0 or doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _prefix(codes: np.ndarray) -> np.ndarray:
    c = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x51ED270B)) * powers(len(codes)), out=c[1:])
    return c


def _windows(c: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` words from each place, from the prefix hash."""
    n = len(c) - width
    return (c[width:] - c[:-width]) * powers(n, inverse=True) if n > 0 else np.zeros(0, np.uint64)


def _matches(v: np.ndarray, p: int) -> np.ndarray:
    """(boundary, period - P): whether the windows are equal; places past the end are not."""
    full = max(0, len(v) // p - 1)
    eq = v[p:(full + 1) * p].reshape(full, p) == v[:full * p:p, None]
    rest = v[(full + 1) * p:]
    if len(rest):
        tail = np.zeros((1, p), bool)
        tail[0, :len(rest)] = rest == v[full * p]
        eq = np.concatenate((eq, tail))
    return eq


def suspicious(codes: np.ndarray, off: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which documents (word numbers, offsets) may hold a run: some boundary has an equal window."""
    out = np.zeros(len(off) - 1, bool)
    of = np.arange(len(off) - 1)
    p = 1
    while len(codes):
        length = np.diff(off)
        long = length >= max(least, EXPONENT * p)
        if not long.all():
            keep = np.repeat(long, length)
            codes, of, off = codes[keep], of[long], np.concatenate(([0], np.cumsum(length[long])))
            if not len(of):
                break
        hit = np.flatnonzero(_matches(_windows(_prefix(codes), 2 * p), p).any(axis=1)) * p
        out[of[np.searchsorted(off, hit, side="right") - 1]] = True
        p *= 2
    return out


def tiles(codes: np.ndarray, least: int = LEAST, tile_words: int = TILE_WORDS):
    """(octave, base, boundaries relative to base, words from base on) of one document."""
    n = len(codes)
    if n < least:
        return
    c = _prefix(codes)
    reach = np.zeros(n + 1, np.int64)  # how far a known stretch of a smaller period goes that covers the place
    octave, p = 0, 1
    while EXPONENT * p <= n:
        eq = _matches(_windows(c, 2 * p), p)
        b = np.arange(len(eq)) * p
        b = b[eq.any(axis=1) & (reach[b] < np.minimum(b + 4 * p, n))]
        if len(b):
            first = p + eq[b // p].argmax(axis=1)
            stride = max(4 * p, tile_words)
            for t in np.unique(b // stride).tolist():
                base = max(0, t * stride - p)
                yield octave, base, b[b // stride == t] - base, codes[base:min(n, (t + 1) * stride + 5 * p)]
            step = np.arange(2 * p)
            true = (codes[b[:, None] + step] == codes[(b + first)[:, None] + step]).all(axis=1)
            b, first = b[true], first[true]
            if len(b):
                new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (b[1:] - b[:-1] > 2 * p))))
                last = np.append(new[1:], len(b)) - 1
                np.maximum.at(reach, b[new], b[last] + 2 * p + first[last])
                np.maximum.accumulate(reach, out=reach)
        octave, p = octave + 1, 2 * p


def z_function(s: list) -> list[int]:
    """How many values from each place equal those from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve(octave: int, base: int, boundaries: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, lo, hi): equality stretches through the tile's boundaries, those that touch joined."""
    p = 1 << octave
    words, found = codes.tolist(), {}
    for b in boundaries.tolist():
        ahead = z_function(words[b:b + 5 * p])
        periods = [q for q in range(p, min(2 * p, len(ahead))) if ahead[q] >= 2 * p]
        if not periods:
            continue
        before = words[max(0, b - p):b][::-1]
        back = z_function([*before, None, *words[b:b + 2 * p][::-1], *before])
        after = min(2 * p, len(words) - b)
        for q in periods:
            lo = base + b - (back[len(before) + 1 + after - q] if before else 0)
            hi = base + b + ahead[q]
            spans = found.setdefault(q, [])
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
    return [(q, lo, hi) for q, spans in found.items() for lo, hi in spans]


def least_periods(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The (start, length, period) that lie in no other one of a smaller period, by start and period."""
    kept: list[tuple[int, int, int]] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, runs = 0, sorted(runs, key=lambda r: r[2])
    while at < len(runs):
        end = at
        while end < len(runs) and runs[end][2] == runs[at][2]:
            end += 1
        new = []
        for s, length, q in runs[at:end]:
            k = np.searchsorted(starts, s, side="right")
            if k == 0 or reach[k - 1] < s + length:
                new.append((s, length, q))
        if new:
            kept = sorted(kept + new)
            starts = np.array([r[0] for r in kept])
            reach = np.maximum.accumulate(np.array([r[0] + r[1] for r in kept]))
        at = end
    return sorted(kept, key=lambda r: (r[0], r[2]))


def _blob(boundaries: np.ndarray, codes: np.ndarray) -> bytes:
    return np.concatenate(([len(boundaries)], boundaries, codes)).astype("<i4").tobytes()


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(blob, "<i4")
    return x[1:1 + x[0]], x[1 + x[0]:]


def exploded(docs: DataFrame, alter: bool = False, least: int = LEAST, tile_words: int = TILE_WORDS) -> DataFrame:
    """Rows READY (documents without a run), WORDS (documents that may have some) and TILE. docs: (doc_id, text)."""
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 36

        def ready(held):
            nonlocal row
            out = []
            number = {w: k for k, w in enumerate(set().union(*(words for _, words in held)))}
            off = np.concatenate(([0], np.cumsum([len(words) for _, words in held]))).astype(np.int64)
            codes = np.fromiter((number[w] for _, words in held for w in words), np.int32, int(off[-1]))
            for (doc_id, words), more, x, y in zip(held, suspicious(codes, off, least).tolist(), off[:-1], off[1:], strict=True):
                text = b" ".join(words)
                if not more:
                    out.append((READY, None, doc_id, None, None, None, hashlib.sha256(text).hexdigest()))
                    continue
                row += 1
                out.append((WORDS, row, doc_id, None, None, text, None))
                for octave, base, boundaries, part in tiles(codes[x:y], least, tile_words):
                    out.append((TILE, row, None, octave, base, _blob(boundaries, part), None))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                              ["kind", "row", "doc_id", "octave", "base", "blob", "sha"])

        held, size = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = text.split()
                change = altered(len(words), doc_id) if alter else None
                if change:
                    a, p = change
                    words = words[:a] + [words[a + k % p] for k in range(len(words) - a)]
                held.append((doc_id, words))
                size += len(text)
                if size >= SLICE_BYTES:
                    yield ready(held)
                    held, size = [], 0
        if held:
            yield ready(held)

    return map_batches(docs, run, ROW)


def stitched(tile_rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(row, runs): stretches long enough, joined over tile borders, as an unsorted list of a row."""
    def run(batches):
        for b in batches:
            out = []
            for row, octave, base, blob in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(row, *x) for x in solve(octave, base, *_unblob(blob))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "period", "lo", "hi"])

    n = max(int(tile_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tile_rows.count() // TILES_A_TASK))
    parts = map_batches(tile_rows.select("row", "octave", "base", "blob").repartition(n, "row", "octave", "base"),
                        run, "row long, period long, lo long, hi long")
    by = Window.partitionBy("row", "period").orderBy("lo", "hi")
    parts = parts.withColumn("before", F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("island", F.sum(F.when(F.col("lo") <= F.col("before"), 0).otherwise(1)).over(by))
    whole = (parts.groupBy("row", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
             .withColumn("length", F.col("hi") - F.col("start") + F.col("period"))
             .where((F.col("length") >= least) & (F.col("length") >= EXPONENT * F.col("period"))))
    return whole.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  tile_words: int = TILE_WORDS, alter: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed (text: words joined by one space,
    without those that a run repeats after its first period; null where no run is), collapsed_sha256.

    `alter` makes a tenth of the documents periodic first, as the query asks.
    """
    rows = written(exploded(as_text(docs, id_col, text_col), alter, least, tile_words))

    def collapse(batches):
        for b in batches:
            lists, texts = [], []
            for blob, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = least_periods([(r["start"], r["length"], r["period"]) for r in runs or ()])
                words = blob.split(b" ")
                gone = np.zeros(len(words) + 1, np.int64)
                for s, length, q in runs:
                    gone[s + q] += 1
                    gone[s + length] -= 1
                gone = (np.cumsum(gone[:-1]) > 0).tolist()
                texts.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g]))
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                                             ["doc_id", "runs", "collapsed"])

    words = rows.where(F.col("kind") == WORDS).select("row", "doc_id", "blob")
    words = words.join(stitched(rows.where(F.col("kind") == TILE), least), "row", "left").select("doc_id", "blob", "runs")
    found = map_batches(words, collapse, f"doc_id long, runs {RUNS}, collapsed string")
    found = found.withColumn("collapsed_sha256", F.sha2("collapsed", 256))
    return found.unionByName(rows.where(F.col("kind") == READY).select(
        "doc_id", F.expr(f"cast(array() as {RUNS})").alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("sha").alias("collapsed_sha256")))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(documents(spark, sf_dir), alter=True)
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    text = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), "collapsed_sha256")
