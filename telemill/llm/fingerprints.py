"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words, letters A-Z lowered, weighted by how
often they occur. For sample k a word has r, c ~ Gamma(2, 1) and b ~ U(0, 1),
all drawn from a hash of the word and k. With weight w,

    t = floor(ln(w) / r + b)    ln(a) = ln(c) - r * (t - b) - r

and the sample is the (word, t) of the least a. Two documents get the same
sample with a probability equal to their generalised Jaccard similarity
(sum of the lesser weights over sum of the greater ones). A fingerprint is
the 16-bit hashes of all samples in hexadecimal; the likeness of two is the
share of samples in which they agree, less what agrees by chance.

Defined cases: null text counts as empty; texts without a word share one
fingerprint (all zeros, alike in every sample) and are unlike all others;
other columns take no part. The gamma samples are taken from 4,096 quantiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import MOST_TASKS, as_text, buckets, documents, map_batches, total_bytes
from .text import mix, slices, span_hash, word_spans

SAMPLES = 128
#: Bytes of text in a range of doc_ids that one task goes through.
RANGE_BYTES = 8_000_000
#: (word, weight) pairs whose samples are worked out at once, those held at once, and bytes of text in one go.
_AT_ONCE, _HELD, _TEXT_BYTES = 512, 100_000, 2_500_000


def _gamma_quantiles(n: int) -> np.ndarray:
    """Gamma(2, 1) at the middles of n equal shares, by bisection."""
    u, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(less, x, low), np.where(less, high, x)
    return low.astype(np.float32)


def _mix32(x: np.ndarray) -> np.ndarray:
    """The 32-bit finaliser of MurmurHash3, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class Sampler:
    """Draws the samples of weighted words.

    The least a names its sample: it follows from the word, the sample's
    number and t alone, so documents that share the sample share it to the bit.
    """

    def __init__(self, samples: int):
        self.samples = samples
        salt = mix(np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.salt = (salt >> np.uint64(32)).astype(np.uint32).reshape(3, samples)
        self.r = _gamma_quantiles(4096)

    def ln_a(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """ln(a) of each (word, weight) and sample."""
        low, high = term.astype(np.uint32), (term >> np.uint64(32)).astype(np.uint32)
        x = _mix32(low[:, None] ^ self.salt[0])
        r = self.r[x >> np.uint32(20)]
        b = (x & np.uint32((1 << 20) - 1)).astype(np.float32)
        b += np.float32(0.5)
        b *= np.float32(2.0 ** -20)
        u = (_mix32(high[:, None] ^ self.salt[1]) >> np.uint32(8)).astype(np.float32)
        v = (_mix32((low + high)[:, None] ^ self.salt[2]) >> np.uint32(8)).astype(np.float32)
        u += np.float32(0.5)
        v += np.float32(0.5)
        u *= v
        u *= np.float32(2.0 ** -48)
        np.log(u, out=u)
        np.negative(u, out=u)
        np.log(u, out=u)  # ln(c)
        more = np.flatnonzero(weight > 1)  # t is 0 for a word that occurs once
        b[more] -= np.floor(np.log(weight[more].astype(np.float32))[:, None] / r[more] + b[more])
        b -= np.float32(1)
        b *= r
        u += b
        return u

    def fingerprints(self, column: pa.Array) -> np.ndarray:
        """(texts, samples) 16-bit samples; 0 in all samples for a text without a word."""
        out = [np.zeros((0, self.samples), np.uint16)]
        for a, b, data, off in slices(column, _TEXT_BYTES):
            upper = (data >= 65) & (data <= 90)
            data = data + upper * np.uint8(32)
            start, end, words = word_spans(data, off)
            part = np.zeros((b - a, self.samples), np.uint16)
            out.append(part)
            if not len(start):
                continue
            codes, terms = pd.factorize(span_hash(data, start, end))
            doc = np.repeat(np.arange(b - a), np.diff(words))
            pair, weight = np.unique(doc * len(terms) + codes, return_counts=True)
            docs, first = np.unique(pair // len(terms), return_index=True)
            part[docs] = self.least(terms, pair % len(terms), weight, first)
        return np.concatenate(out)

    def least(self, terms, code, weight, first) -> np.ndarray:
        """Samples of consecutive documents whose pairs start at `first`."""
        top = int(weight.max()) + 1
        name, back = np.unique(code * top + weight, return_inverse=True)
        best = np.full((len(first), self.samples), np.inf, np.float32)
        last = np.append(first[1:], len(code))
        for p in range(0, len(name), _HELD):  # more than one round for very long documents only
            rows = np.empty((min(_HELD, len(name) - p), self.samples), np.float32)
            for q in range(0, len(rows), _AT_ONCE):
                x = name[p + q:p + q + _AT_ONCE][:len(rows) - q]
                rows[q:q + len(x)] = self.ln_a(terms[x // top], x % top)
            for i in range(len(first)):
                own = back[first[i]:last[i]]
                own = own[(own >= p) & (own < p + len(rows))] - p if len(name) > _HELD else own
                for k in range(0, len(own), 4096):
                    np.minimum(best[i], rows[own[k:k + 4096]].min(axis=0), out=best[i])
        return np.maximum((_mix32(best.view(np.uint32)) >> np.uint32(16)).astype(np.uint16), 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, less the 2**-16 that agree by chance."""
    share = (a == b).mean(axis=1)
    return np.clip((share - 2.0 ** -16) / (1 - 2.0 ** -16), 0.0, 1.0)


_samplers: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def hexadecimal(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint (hexadecimal, four digits a sample) of every whole text."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hexadecimal(sampler(samples).fingerprints(b.column(1))))],
                                             ["doc_id", "fingerprint"])

    return map_batches(as_text(docs, id_col, text_col), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(range, tail, doc_id, text), sorted within partitions so that each document is
    followed by the next one by descending doc_id (after the last: the first).

    doc_ids are cut into ranges of about range_bytes (MOST_TASKS of them at most;
    a longer range only streams longer); a range ends with a copy
    (tail 1) of the first document of the range after it. Only ids of ranges
    go through the driver, one for each range. Rows of the same doc_id are
    ordered by text, null ids come last.
    """
    spark = docs.sparkSession
    n = min(buckets(total_bytes(docs), range_bytes), MOST_TASKS)
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    splits = sorted(set(docs.select(F.col("doc_id").cast("double").alias("p")).na.drop()
                        .approxQuantile("p", [i / n for i in range(1, n)], 0.25 / n)))
    keyed = docs.withColumn("place", place)
    if splits:
        from pyspark.ml.feature import Bucketizer
        keyed = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="place", outputCol="range",
                           handleInvalid="keep").transform(keyed)
    else:
        keyed = keyed.withColumn("range", F.lit(0.0))
    keyed = keyed.select(F.col("range").cast("int").alias("range"), "doc_id", "text")
    heads = keyed.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()  # one row a range
    used = [r["range"] for r in heads]
    to = spark.createDataFrame([(r["range"], r["head"], used[(i + 1) % len(used)]) for i, r in enumerate(heads)],
                               "range int, head long, target int")
    first = (keyed.join(F.broadcast(to), "range").where(F.col("doc_id").eqNullSafe(F.col("head")))
             .groupBy("target").agg(F.min(F.struct(F.col("text"), F.col("doc_id"))).alias("x")))
    rows = keyed.select("range", F.lit(0).alias("tail"), "doc_id", "text").unionByName(
        first.select(F.col("target").alias("range"), F.lit(1).alias("tail"), "x.doc_id", "x.text"))
    return rows.repartition(n, "range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "text")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, and of the text whose second half comes from the next document's start.

    doc_id, n_chars, edited (the edited text's SHA-256), fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    def run(batches):
        draw = sampler(samples).fingerprints
        rows = []  # the last row waits for its next document
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(rows) > 1:
                n, size = 1, 0
                while n < len(rows) and size < _TEXT_BYTES // 5:  # a text and its edited text are drawn together
                    size += len(rows[n - 1][3])
                    n += 1
                part, rows = rows[:n], rows[n - 1:]
                live = [i for i in range(n - 1) if not part[i][1]]
                texts = [r[3] for r in part]
                edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][:len(texts[i]) // 2] for i in live]
                prints = draw(pa.array(texts + edited, pa.large_string()))
                own, after, new = prints[live], prints[[i + 1 for i in live]], prints[n:]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part[i][2] for i in live], pa.int64()),
                    pa.array([len(texts[i]) for i in live], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(hexadecimal(own), pa.string()), pa.array(hexadecimal(new), pa.string()),
                    pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, after), pa.float64()),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return map_batches(with_next(as_text(docs, id_col, text_col)), run,
                       "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                       "edited_fingerprint string, near_edited double, near_next double")


def op5_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))
