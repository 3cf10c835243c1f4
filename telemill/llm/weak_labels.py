"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document. A
label model (two classes; each labeller has its own accuracy in either class,
abstentions say nothing) is fitted by expectation-maximisation on the counts of
vote patterns over all documents: there are at most 3 ** labellers patterns,
however large the corpus. The posterior of each document's pattern is its
training label for a linear scorer over hashed words and word shapes: every
task runs stochastic gradient steps over all its documents, and the tasks'
weights are averaged by the number of their documents, in `epochs` rounds. No
given label is used.

Defined cases: null or empty text gets the votes of a text without words and
is not kept; equal rows score alike; an empty table gives an empty table; other
columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_text, documents, map_batches
from .repetition import _covered, _per_document, repeated_windows
from .text import mix, slices, span_hash, word_spans

BITS, EPOCHS = 15, 2
#: A document is kept from this score on.
KEEP = 0.5
BAD, GOOD, ABSTAIN = 0, 1, 2
LABELLERS = ("symbols", "repetition", "capitals", "length", "variety", "neighbours", "exclaiming", "marked")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Slice:
    """Word counts and shares of the documents in one slice of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.start, self.end, self.words = word_spans(data, off)
        self.hash = span_hash(data, self.start, self.end)
        self.n = np.diff(self.words)

    def share(self, flags: np.ndarray) -> np.ndarray:
        """Share of each document's words."""
        return _per_document(flags, self.words) / np.maximum(self.n, 1)

    def votes(self) -> np.ndarray:
        """(documents, labellers)."""
        data, off, n = self.data, self.off, self.n
        upper = _per_document((data >= 65) & (data <= 90), off)
        lower = _per_document((data >= 97) & (data <= 122), off)
        capitals = upper / np.maximum(upper + lower, 1)
        symbols = _per_document(_SYMBOL[data], off) / np.maximum(n, 1)
        repeat = self.share(_covered(len(self.hash), repeated_windows(self.hash, self.words, 5), 5))
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(mix(self.hash ^ (doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))), kind="stable")
        h, d = self.hash[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        variety = np.bincount(d[new], minlength=len(n)) / np.maximum(n, 1)
        same = np.zeros(len(h), bool)
        same[1:] = (self.hash[1:] == self.hash[:-1]) & (doc[1:] == doc[:-1])
        neighbours = self.share(same)
        exclaiming = self.share(data[np.maximum(self.end - 1, 0)] == ord("!")) if len(data) else np.zeros(len(n))

        # words that are marks alone, or end in a symbol
        sign = _SYMBOL[data] | ((data >= 33) & (data <= 47)) if len(data) else np.zeros(0, bool)
        c = np.concatenate(([0], np.cumsum(sign)))
        bare = c[self.end] - c[self.start] == self.end - self.start
        marked = self.share(bare | _SYMBOL[data[np.maximum(self.end - 1, 0)]]) if len(data) else np.zeros(len(n))

        def vote(x, good, bad):
            return np.where(x >= bad, BAD, np.where(x <= good, GOOD, ABSTAIN))

        some = n >= 30
        out = np.stack([
            vote(symbols, 0.02, 0.15), vote(repeat, 0.1, 0.3), vote(capitals, 0.15, 0.5),
            np.where(n == 0, BAD, np.where(some, GOOD, ABSTAIN)),
            np.where(some, vote(1 - variety, 0.6, 0.85), ABSTAIN),
            vote(neighbours, 0.03, 0.2), vote(exclaiming, 0.05, 0.3), vote(marked, 0.05, 0.25)], axis=1).astype(np.int64)
        out[n == 0] = ABSTAIN
        out[n == 0, LABELLERS.index("length")] = BAD
        return out

    def features(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, hashed features, weights): words, their last two bytes and letter cases, and the votes."""
        data, start, end = self.data, self.start, self.end
        doc = np.repeat(np.arange(len(self.n)), self.n)
        last = data[end - 1].astype(np.uint64) if len(end) else np.zeros(0, np.uint64)
        second = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.uint64) if len(end) else last
        capital = ((data >= 65) & (data <= 90)) if len(data) else np.zeros(0, bool)
        c = np.concatenate(([0], np.cumsum(capital)))
        case = np.minimum(c[end] - c[start], 3).astype(np.uint64)
        f = np.concatenate((self.hash, mix(last * np.uint64(256) + second + np.uint64(1 << 40)),
                            mix(case + np.uint64(1 << 50))))
        f = (f & np.uint64((1 << BITS) - 1)).astype(np.int64)
        pair, count = np.unique((np.tile(doc, 3) << BITS) | f, return_counts=True)
        doc = pair >> BITS
        weight = np.log1p(count)
        size = np.sqrt(np.bincount(doc, weights=weight ** 2, minlength=len(self.n)))
        cast = mix((votes + 3 * np.arange(votes.shape[1]) + (1 << 60)).astype(np.uint64)).ravel()
        return (np.concatenate((doc, np.repeat(np.arange(len(votes)), votes.shape[1]))),
                np.concatenate((pair & ((1 << BITS) - 1), (cast & np.uint64((1 << BITS) - 1)).astype(np.int64))),
                np.concatenate((weight / size[doc], np.full(votes.size, 0.5))))


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> dict:
    """Prior of good, and each labeller's vote probabilities by class, from counted patterns."""
    votes = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    one = np.eye(3)[votes][:, :, :2]  # pattern, labeller, vote; an abstention says nothing
    good = (votes == GOOD).sum(1) + 0.5
    p = good / (good + (votes == BAD).sum(1) * 2 + 0.5)  # start: most votes win, a bad one weighs double
    for _ in range(rounds):
        w = np.stack((counts * (1 - p), counts * p))  # class, pattern
        prior = (w[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cp,plv->clv", w, one) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        z = np.log(prior) - np.log(1 - prior) + np.einsum("plv,lv->p", one, np.log(table[1]) - np.log(table[0]))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return {"prior": float(prior), "table": table, "posterior": dict(zip(patterns.tolist(), p.tolist(), strict=True))}


def label_model(docs: DataFrame) -> dict:
    """The label model of a table of documents."""
    def run(batches):
        n = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for _, _, data, off in slices(b.column(1)):
                n += np.bincount(pattern(Slice(data, off).votes()), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pattern", "n"])

    got = (map_batches(docs, run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
           .orderBy("pattern").collect())  # at most 3 ** labellers rows
    if not got:
        return {"posterior": {}, "prior": 0.5, "table": None}
    return fit_label_model(np.array([r["pattern"] for r in got]), np.array([r["n"] for r in got], float), len(LABELLERS))


def _posterior(model: dict, votes: np.ndarray) -> np.ndarray:
    return np.array([model["posterior"][k] for k in pattern(votes).tolist()], float)


def train_scorer(docs: DataFrame, model: dict, epochs: int = EPOCHS, step: float = 2.0) -> np.ndarray:
    """Weights (the last one is the bias): averaged over tasks after each pass over all documents."""
    chunk, size = 1 << 10, (1 << BITS) + 1
    weights = np.zeros(size)
    for epoch in range(epochs):
        def run(batches, w0=weights, rate=step / (1 + epoch)):
            w, n = w0.copy(), 0
            for b in batches:
                for x, y, data, off in slices(b.column(1), 250_000):
                    s = Slice(data, off)
                    cast = s.votes()
                    goal = _posterior(model, cast)
                    doc, f, v = s.features(cast)
                    z = np.bincount(doc, weights=w[f] * v, minlength=y - x) + w[-1]
                    e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal
                    # good and bad documents weigh the same
                    e *= np.where(goal > 0.5, 0.5 / max(model["prior"], 1e-3), 0.5 / max(1 - model["prior"], 1e-3))
                    w -= rate * np.bincount(f, weights=e[doc] * v, minlength=size) / (y - x) * min(1.0, (y - x) / 32)
                    w[-1] -= rate * e.mean() * min(1.0, (y - x) / 32)
                    n += y - x
            if n:
                parts = [(k, w[k * chunk:(k + 1) * chunk]) for k in range(-(-size // chunk))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()),
                                                  pa.array([(p * n).astype("<f8").tobytes() for _, p in parts], pa.binary()),
                                                  pa.array([float(n)] * len(parts))], ["part", "sum", "n"])

        def add(batches):
            have: dict = {}
            for b in batches:
                for k, raw, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    total = have.setdefault(k, [0.0, 0.0])
                    total[0] = total[0] + np.frombuffer(raw, "<f8")
                    total[1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()),
                                              pa.array([v[0].tobytes() for v in have.values()], pa.binary()),
                                              pa.array([v[1] for v in have.values()], pa.float64())], ["part", "sum", "n"])

        kind = "part int, sum binary, n double"
        got = map_batches(map_batches(docs, run, kind).repartition("part"), add, kind).collect()  # 33 rows
        weights = np.zeros(size)
        for r in got:
            part = np.frombuffer(r["sum"], "<f8") / r["n"]
            weights[r["part"] * chunk:r["part"] * chunk + len(part)] = part
    return weights


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS,
                   keep: float = KEEP) -> DataFrame:
    """doc_id, votes (one letter a labeller: g, b or -), posterior, score, kept."""
    docs = as_text(docs, id_col, text_col)
    model = label_model(docs)
    weights = train_scorer(docs, model, epochs)
    letters = np.array(["b", "g", "-"])

    def run(batches):
        for b in batches:
            votes, posterior, score, n = [], [], [], []
            for x, y, data, off in slices(b.column(1)):
                s = Slice(data, off)
                v = s.votes()
                doc, f, weight = s.features(v)
                z = np.bincount(doc, weights=weights[f] * weight, minlength=y - x) + weights[-1]
                votes += ["".join(r) for r in letters[v]]
                posterior.append(_posterior(model, v))
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                n.append(s.n)
            if b.num_rows:
                score, n = np.concatenate(score), np.concatenate(n)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes), pa.array(np.concatenate(posterior)),
                                                  pa.array(score), pa.array((score >= keep) & (n > 0))],
                                                 ["doc_id", "votes", "posterior", "score", "kept"])

    return map_batches(docs, run, "doc_id long, votes string, posterior double, score double, kept boolean")


def op10_weak_label_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir))
