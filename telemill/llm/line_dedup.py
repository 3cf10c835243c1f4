"""Line dedup with two Bloom filters, for lines seen once and lines seen twice.

A line's key is the line without white space at its ends, letters A-Z
lowered. A key of at least `min_chars` code points that several documents hold
loses its lines in all of them but the first one.

1. Each task reads its documents and names every key by a 128-bit digest.
   Keys are gathered by input of about `flush_bytes`; a key that several
   documents of one input hold is a sure repeat. By a hash the keys belong to
   shards, whose number grows with the number of lines, so that a shard's two
   filters have a fixed size.
2. A shard's task reads its rows as a stream, twice: first the digests of all
   inputs fill the two filters (what the first filter knows already goes into
   the second one), then the keys are tested against the second one. It holds
   two filters and one row at a time. Keys that miss go no further.
3. Suspected repeats only are shuffled by digest: the least and the greatest
   document of a key confirm a repeat and choose its first occurrence. False
   positives of the filters end here. Keys with over a thousandth of the
   suspects (at most a thousand) are joined by broadcast, all others by shuffle.
4. The documents meet the digests of the lines they lose.

Defined cases: a null or empty text is one empty line; rows with one doc_id
are one document, whose lines are not repeats of each other; rows without
doc_id come after all others, are named by a hash of their text, and take part
like them; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import documents, map_batches, written

MIN_CHARS = 10
#: Text of an input whose keys are gathered at once.
FLUSH_BYTES = 32_000_000
#: Bits of a filter, hashes for each key, and keys a shard is laid out for: false positives below 1 in 1,000.
BITS, HASHES, SHARD_KEYS = 1 << 22, 4, 1 << 18
#: White space that lines lose at their ends.
SPACE = b" \t\n\x0b\x0c\r"

#: A key held by a document: digest, and the document (without id or not, id or hash of the text).
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("null", "u1"), ("doc", "<i8")])
#: Kinds of rows, in the order in which a shard reads them.
ONCE, TWICE, TEST, SURE = 0, 1, 2, 3
ROW = "shard int, kind int, blob binary"


def digest(line: bytes, min_chars: int) -> bytes | None:
    """128 bits that name a line's key; None for a short key."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class Filter:
    """A Bloom filter whose places are taken from one 64-bit hash."""

    def __init__(self, bits: int = BITS, hashes: int = HASHES):
        self.mask, self.hashes, self.bits = np.uint64(bits - 1), hashes, np.zeros(bits, bool)

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(self.hashes):
            yield ((h + np.uint64(k) * step) & self.mask).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for p in self.places(h):
            self.bits[p] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h):
            out &= self.bits[p]
        return out


def _rows(parts: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()),
        pa.array([p[2].tobytes() for p in parts], pa.binary())], ["shard", "kind", "blob"])


def gathered(e: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows for the shards from the entries of one input."""
    e = e[np.lexsort((e["doc"], e["null"], e["h2"], e["h1"], e["h1"] % np.uint64(shards)))]
    new = np.ones(len(e), bool)
    new[1:] = (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])
    other = new.copy()
    other[1:] |= (e["doc"][1:] != e["doc"][:-1]) | (e["null"][1:] != e["null"][:-1])
    e, new = e[other], new[other]
    first = np.flatnonzero(new)
    several = np.diff(np.append(first, len(e))) > 1
    sure = np.repeat(several, np.diff(np.append(first, len(e))))
    shard = (e["h1"] % np.uint64(shards)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))).tolist() if len(e) else []
    parts = []
    for a, b in zip(cut, [*cut[1:], len(e)], strict=True):
        x, s = e[a:b], sure[a:b]
        parts += [(int(shard[a]), kind, v) for kind, v in (
            (ONCE, x["h2"][~s]), (TWICE, x["h2"][s & new[a:b]]), (TEST, x[~s]), (SURE, x[s])) if len(v)]
    return _rows(parts)


def suspects(docs: DataFrame, shards: int, min_chars: int = MIN_CHARS, flush_bytes: int = FLUSH_BYTES,
             bits: int = BITS) -> DataFrame:
    """(h1, h2, null, doc): keys that several documents may hold, once for each document.

    docs: (null, doc, text).
    """
    def prints(batches):
        held, size = [], 0
        for b in batches:
            nulls, ids = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            for null, doc, text in zip(nulls.tolist(), ids.tolist(), b.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                found = {digest(x, min_chars) for x in text.split(b"\n")}
                found.discard(None)
                if found:
                    e = np.zeros(len(found), ENTRY)
                    h = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
                    e["h1"], e["h2"], e["null"], e["doc"] = h[:, 0], h[:, 1], null, doc
                    held.append(e)
                size += len(text)
                if size >= flush_bytes and held:
                    yield gathered(np.concatenate(held), shards)
                    held, size = [], 0
        if held:
            yield gathered(np.concatenate(held), shards)

    def tested(batches):
        shard = once = twice = None
        for b in batches:
            out = []
            for s, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s != shard:
                    shard, once, twice = s, Filter(bits), Filter(bits)
                if kind == ONCE:
                    h = np.frombuffer(blob, "<u8")
                    twice.add(h[once.holds(h)])
                    once.add(h)
                elif kind == TWICE:
                    h = np.frombuffer(blob, "<u8")
                    once.add(h)
                    twice.add(h)
                else:
                    e = np.frombuffer(blob, ENTRY)
                    out.append(e[twice.holds(e["h2"])] if kind == TEST else e)
            e = np.concatenate(out) if out else np.zeros(0, ENTRY)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(np.ascontiguousarray(e[k]).view("<i8")) for k in ("h1", "h2")),
                pa.array(e["null"] > 0), pa.array(np.ascontiguousarray(e["doc"]))], ["h1", "h2", "null", "doc"])

    rows = map_batches(docs, prints, ROW)
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return map_batches(rows, tested, "h1 long, h2 long, null boolean, doc long")


def lost_lines(found: DataFrame) -> DataFrame:
    """(null, doc, lost): digests of the lines that a document loses. found: a written table of suspects."""
    total = found.count()
    own = F.struct("null", "doc")
    keys = (found.groupBy("h1", "h2").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.count("*").alias("n"))
            .where("first != last").select("h1", "h2", "first", (F.col("n") * 1000 > total).alias("hot")))
    keys = written(keys)
    hot = keys.where("hot").select("h1", "h2", F.col("first").alias("hot_first"))  # at most 1,000 rows
    all_ = found.join(F.broadcast(hot), ["h1", "h2"], "left")
    rest = (all_.where("hot_first IS NULL").drop("hot_first")
            .join(keys.where("NOT hot").select("h1", "h2", "first"), ["h1", "h2"]))
    lost = rest.unionByName(all_.where("hot_first IS NOT NULL").withColumnRenamed("hot_first", "first"))
    return (lost.where(own != F.col("first")).groupBy("null", "doc")
            .agg(F.collect_list(F.struct("h1", "h2")).alias("lost")))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                          flush_bytes: int = FLUSH_BYTES, shard_keys: int = SHARD_KEYS, bits: int = BITS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept (the remaining lines), one row per row."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.isnull("doc_id").alias("null"),
                       F.coalesce("doc_id", F.xxhash64("text")).alias("doc"), "text")
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // shard_keys))
    found = written(suspects(docs.select("null", "doc", "text"), shards, min_chars, flush_bytes, bits))

    def kept(batches):
        for b in batches:
            texts, all_lines, dropped = [], [], []
            for text, lost in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                keep = lines
                if lost:
                    lost = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in lost}
                    keep = [x for x in lines if digest(x, min_chars) not in lost]
                texts.append(b"\n".join(keep))
                all_lines.append(len(lines))
                dropped.append(len(lines) - len(keep))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(all_lines, pa.int64()), pa.array(dropped, pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    both = docs.join(lost_lines(found), ["null", "doc"], "left").select("doc_id", "text", "lost")
    return map_batches(both, kept, "doc_id long, n_lines long, n_dropped long, kept string")


def op13_bloom_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, r.first IS NOT NULL AND doc_id > r.first AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
