"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct five-word shingles (letters A-Z lowered;
a shorter document is one shingle). Under each of `permutations` hash
functions both the least and the greatest value are kept, so a signature of
128 values takes 64 evaluations of a hash per shingle; each value agrees with
the probability of the Jaccard similarity. Bands of four values name buckets.

1. Documents with the same set are one vertex, named by the least doc_id.
2. In each bucket every member is paired with the bucket's least member (a
   star, not all pairs). Pairs whose signatures agree enough are confirmed on
   full sets; links give components.
3. What a star can't see is looked up next: in a bucket that still holds
   several components, the members outside its largest one are compared with
   all others by signature, in blocks that bound any task, each pair in the
   first bucket it shares. Documents that agree enough with one of another
   component are named once a bucket, and compared there on full sets, again
   in blocks. So every pair of a bucket is in one component or has been
   compared, and no list of pairs is ever made.

Hot buckets and hot hubs are split by salts made from their counts.

Defined cases: null or empty text has no words, an empty set and no links;
equal rows are one vertex; rows that share a doc_id are one vertex too; a row
without doc_id is linked with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import as_text, documents, map_batches, written
from .text import mix, powers, slices, span_hash, window_hash, word_spans

SHINGLE = 5
PERMUTATIONS = 64
#: Values in a band: 32 bands miss a pair of similarity 0.75 with a probability of 5e-6.
ROWS = 4
#: Signatures of 128 values that agree in less are not confirmed: four standard errors below 0.75.
AGREE = 0.6
#: Documents of one group that a task holds, and that it lets stream by.
HELD, BLOCK = 500, 2000


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    for a, b, data, off in slices(column):
        upper = (data >= 65) & (data <= 90)
        data = data + upper * np.uint8(32)
        start, end, words = word_spans(data, off)
        h = span_hash(data, start, end)
        g = window_hash(h, k)
        for x, y in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            if y - x >= k:
                yield np.unique(g[x:y - k + 1])
            elif y > x:
                yield mix((h[x:y] * powers(k)[:y - x]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(y - x))
            else:
                yield np.zeros(0, np.uint64)


class MinMax:
    def __init__(self, permutations: int):
        rng = np.random.default_rng(64)
        self.xor = rng.integers(1, 1 << 63, permutations, dtype=np.uint64)
        self.by = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> bytes:
        """Least and greatest 32-bit value under each permutation, as 16-bit hashes."""
        low = high = None
        for p in range(0, len(shingles), 1024):
            v = shingles[p:p + 1024, None] ^ self.xor
            v *= self.by
            v = (v >> np.uint64(32)).astype(np.uint32)
            lo, hi = v.min(axis=0), v.max(axis=0)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        both = np.stack((low, high), axis=1).ravel().astype(np.uint64)
        return (mix(both + np.uint64(1)) >> np.uint64(48)).astype("<u2").tobytes()


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(shingles * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return np.array([a, b], "<u8").tobytes()


def signatures(docs: DataFrame, k: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n_shingles, key (names the set), sig (null for an empty set)."""
    def run(batches):
        hashes = MinMax(permutations)
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([hashes.signature(s) if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "n_shingles", "key", "sig"])

    return map_batches(docs, run, "doc_id long, n_shingles long, key binary, sig binary")


def full_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, key, shingles (sorted 64-bit hashes as bytes)."""
    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_key(s) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["doc_id", "key", "shingles"])

    return map_batches(docs, run, "doc_id long, key binary, shingles binary")


def _agreeing(pairs: DataFrame, reps: DataFrame, agree: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least that share of values."""
    sig = reps.select("rep", "sig")
    both = (pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(b.num_rows, -1) for i in (2, 3))
                yield b.filter(pa.array((x == y).mean(axis=1) >= agree)).select([0, 1])

    return map_batches(both.select("a", "b", "sig_a", "sig_b"), run, "a long, b long")


def _sets_of(used: DataFrame, docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the given representatives (id), written."""
    # the documents' texts are dealt by id at every size
    wanted = docs.join(used.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    keys = reps.join(used.withColumnRenamed("id", "rep"), "rep", "left_semi").select(F.col("rep").alias("doc_id"), "key")
    sets = full_sets(wanted, k).join(keys, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return written(sets.select(F.col("doc_id").alias("id"), "shingles"))


def _confirmed(star: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) among the pairs (a, b) of a star, on full sets.

    The set of a hub is sent once to each part of its partners, and kept while
    their sets stream by.
    """
    sets = _sets_of(star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct(), docs, reps, k)
    count = star.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    partner = (star.join(count, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
               .join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles"))
    hub = (count.join(sets.withColumnRenamed("id", "a"), "a")
           .select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                   F.lit(None).cast("long").alias("b"), "shingles"))
    rows = hub.unionByName(partner).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        at, held = None, []
        for batch in batches:
            out = ([], [])
            for a, part, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(raw, "<u8")
                if b is None:
                    held = [*held, s] if at == (a, part) else [s]
                    at = (a, part)
                elif at == (a, part) and any(alike(own, s, percent) for own in held):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v"])

    return written(map_batches(rows, run, "u long, v long"))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    if 100 * len(b) < percent * len(a):
        return False
    i = np.searchsorted(a, b)
    same = int((a[np.minimum(i, len(a) - 1)] == b).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def _agreement(held, i: int, rep, comp, sig, band: int, rows: int, agree: float) -> np.ndarray:
    """Which held documents document i is to be compared with.

    held: (rep, component, signature) of documents outside the bucket's largest
    component. Both agree enough, are of different components, and this band
    is the first that they share, so a pair is dealt with in one bucket only.
    """
    r, c, s = held
    near = (c != comp[i]) & ((s == sig[i]).mean(axis=1) >= agree)
    hit = np.flatnonzero(near)
    if len(hit):
        first = (s[hit] == sig[i]).reshape(len(hit), -1, rows).all(axis=2).argmax(axis=1)
        hit = hit[first == band]
    return hit


def _blocks(batch: pa.RecordBatch, columns: int):
    """(start, end) of runs of rows that agree in the first `columns` columns."""
    key = np.stack([batch.column(i).to_numpy() for i in range(columns)], axis=1)
    edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    return zip([0, *edge], [*edge, len(key)], strict=True)


def _left_over(members: DataFrame, reps: DataFrame, placed: DataFrame, agree: float, rows: int) -> DataFrame:
    """(bucket, band, id, kind): documents that have to be compared in a bucket, once each.

    placed: (rep, component). kind 0: outside the bucket's largest component;
    kind 1: what those may be linked with.
    """
    placed = members.where("n > 2").select("bucket", "band", "rep").join(placed, "rep")
    per = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    # the largest component of a bucket; buckets of one component are done
    main = (per.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n"),
                                      F.count("*").alias("kinds"))
            .where("kinds > 1").select("bucket", F.col("top.component").alias("main"), "n",
                                       (F.col("n") - F.col("top.c")).alias("odd")))
    found = written(placed.join(main, "bucket").join(reps.select("rep", "sig"), "rep")
                    .withColumn("blocks", F.ceil(F.col("odd") / BLOCK).cast("int"))
                    .withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda c: F.pmod(F.xxhash64("rep"), c).cast("int")
    columns = ["bucket", "band", "block", "part", "kind", "rep", "component", "sig"]
    odd = found.where("component != main").withColumn("block", one("blocks")).withColumn("part", each("parts"))
    stream = (odd.withColumn("kind", F.lit(0)).select(columns)
              .unionByName(found.withColumn("block", each("blocks")).withColumn("part", one("parts"))
                           .withColumn("kind", F.lit(1)).select(columns))
              .repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "kind", "rep"))

    def run(batches):
        at, held, told = None, None, set()
        for batch in batches:
            out = []
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                bucket, band, block, part, kind, rep, comp = (batch.column(i).to_numpy() for i in range(7))
                for x, y in _blocks(batch, 5):
                    now = (bucket[x], block[x], part[x])
                    if kind[x] == 0:
                        mine = (rep[x:y], comp[x:y], sig[x:y])
                        if at == now:
                            held = [np.concatenate(p) for p in zip(held, mine, strict=True)]
                        else:
                            at, held, told = now, mine, set()
                    elif at == now:
                        for i in range(x, y):
                            hit = _agreement(held, i, rep, comp, sig, band[x], rows, agree)
                            if len(hit):
                                new = set(held[0][hit].tolist()) - told
                                told |= new
                                out += [(int(bucket[x]), int(band[x]), j, 0) for j in sorted(new)]
                                out.append((int(bucket[x]), int(band[x]), int(rep[i]), 1))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], k) for i, k in enumerate(
                (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["bucket", "band", "id", "kind"])

    return map_batches(stream, run, "bucket long, band int, id long, kind int").distinct()


def _settled(named: DataFrame, placed: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int,
             agree: float, rows: int) -> DataFrame:
    """Links (u, v) between the documents named by _left_over, on full sets, bucket by bucket.

    A bucket is cut into blocks of kind 0, which are held, and parts of kind
    1, which stream by; a held document needs one link to a component only.
    """
    sets = _sets_of(named.select("id").distinct(), docs, reps, k)
    size = lambda kind, n: F.greatest(F.lit(1), F.ceil(F.sum((F.col("kind") == kind).cast("int")) / n)).cast("int")
    counts = named.groupBy("bucket").agg(size(0, HELD).alias("blocks"), size(1, BLOCK).alias("parts"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    known = (named.join(counts, "bucket").join(placed.withColumnRenamed("rep", "id"), "id")
             .join(reps.select(F.col("rep").alias("id"), "sig"), "id").join(sets, "id"))
    columns = ["bucket", "band", "block", "part", "kind", "id", "component", "sig", "shingles"]
    stream = (known.where("kind = 0").withColumn("block", one("blocks")).withColumn("part", each("parts")).select(columns)
              .unionByName(known.where("kind = 1").withColumn("block", each("blocks")).withColumn("part", one("parts"))
                           .select(columns))
              .repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part", "kind", "id"))

    def run(batches):
        at, held, kept, linked = None, None, [], set()
        for batch in batches:
            out = ([], [])
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                bucket, band, block, part, kind, rep, comp = (batch.column(i).to_numpy() for i in range(7))
                sets_ = [np.frombuffer(v, "<u8") for v in batch.column(8).to_pylist()]
                for x, y in _blocks(batch, 5):
                    now = (bucket[x], block[x], part[x])
                    if kind[x] == 0:
                        mine = (rep[x:y], comp[x:y], sig[x:y])
                        if at == now:
                            held, kept = [np.concatenate(p) for p in zip(held, mine, strict=True)], kept + sets_[x:y]
                        else:
                            at, held, kept, linked = now, mine, sets_[x:y], set()
                    elif at == now:
                        for i in range(x, y):
                            for j in _agreement(held, i, rep, comp, sig, band[x], rows, agree).tolist():
                                if (j, comp[i]) not in linked and alike(kept[j], sets_[i], percent):
                                    linked.add((j, comp[i]))
                                    out[0].append(int(held[0][j]))
                                    out[1].append(int(rep[i]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["u", "v"])

    return written(map_batches(stream, run, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    k: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS,
                    agree: float = AGREE) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (doc_id is it)."""
    docs = as_text(docs, id_col, text_col)
    signed = written(signatures(docs, k, permutations))
    reps = written(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key")
                   .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    width = 2 * rows
    bands = reps.select("rep", F.posexplode(F.expr(
        f"transform(sequence(0, {2 * permutations // rows - 1}), j -> xxhash64(j, substring(sig, {width} * j + 1, {width})))"
    )).alias("band", "bucket"))
    hubs = bands.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = written(bands.join(hubs, "bucket"))
    star = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(written(_agreeing(star, reps, agree)), docs, reps, k, percent)

    def placed(parts):
        return (reps.select("rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
                .select("rep", F.coalesce("component", "rep").alias("component")))

    parts = components(links)
    now = written(placed(parts))
    named = written(_left_over(members, reps, now, agree, rows))
    if not named.isEmpty():
        parts = components(links.union(_settled(named, now, docs, reps, k, percent, agree, rows)))
    parts = written(parts)
    of_rep = (reps.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
              .select("key", F.coalesce("component", "rep").alias("component")))
    return (signed.select("doc_id", "n_shingles", "key").join(of_rep, "key", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def op9_minmax_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: Brute force: all shingles joined, links on full sets, least reachable doc_id.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM inter JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links) l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
