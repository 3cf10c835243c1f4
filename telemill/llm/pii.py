"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns with checks (email, ip, card, phone). The
random field adds to them. Its nodes are a document's words with a digit or
an @; labels: none, the four kinds, and secret (tokens and keys). Potentials:

* unary, by a softmax model over features of shape and surroundings;
* chain edges between neighbouring words;
* skip edges between a word and its next occurrence anywhere in the document
  (outer marks aside), and between words that end in the same seven digits.

Loopy sum-product message passing makes labels agree across a document, so a
number found once by its form is found again where the form is gone. The
potentials are trained here, on the base spans and key assignments of a sample
of documents of about TRAIN_NODES nodes in all (a bound, not a filter of what
is searched: every document is searched whole).

All patterns are applied in linear time, however long a text or a run of
digits is.

Defined cases: null or empty text has no spans; equal rows have equal spans;
without a document to train on only base spans remain; other columns take no
part in the spans and stay in `redact`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_text, documents, map_batches
from .text import mix, slices, word_spans

BASE = ("email", "ip", "card", "phone")
LABELS = ("none", *BASE, "secret")
KINDS = (*BASE, "secret", *(f"likely_{k}" for k in BASE))
TRAIN_NODES, BITS, ROUNDS, TOLERANCE = 20_000, 13, 300, 1e-8
#: Least belief for a span to be added.
BELIEF = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""(?:token|key|secret|passw(?:or)?d)[\x20]?[=:][\x20]?["']([^"'\s]{16,})["']""", re.IGNORECASE)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[^0-9]")
_OUTER = "\"'()[]{}<>.,;:!?"


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping emails, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at - _LOCAL_END.match(text[done:at][::-1]).end()
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def shape(word: str) -> str:
    """Digits by the length of their runs, letters as one a."""
    word = re.sub(r"[^\W\d_]+", "a", word[:80])
    return re.sub(r"[0-9]+", lambda m: f"9{len(m.group())}", word)


class Nodes:
    """Nodes and edges of one document."""

    def __init__(self, text: str):
        words = list(_WORD.finditer(text))
        place = [i for i, m in enumerate(words) if re.search(r"[0-9@]", m.group())]
        self.spans = [words[i].span() for i in place]
        self.features = [self.describe(words, i) for i in place]
        self.edges = []
        for k in range(1, len(place)):
            if place[k] == place[k - 1] + 1:
                self.edges.append((k - 1, k, 0))
        seen: dict = {}
        for k, i in enumerate(place):
            w = words[i].group().strip(_OUTER).lower()
            digits = _DIGITS.sub("", w)
            keys = [(1, w)] if len(w) >= 4 else []
            if len(digits) >= 7:
                keys.append((2, digits[-7:]))
            for key in keys:
                if key in seen and place[seen[key]] != i - 1:  # neighbours have a chain edge
                    self.edges.append((seen[key], k, key[0]))
                seen[key] = k

    @staticmethod
    def describe(words, i: int) -> list[int]:
        w = words[i].group()
        core = w.strip(_OUTER)
        digits = _DIGITS.sub("", core)
        before = words[i - 1].group() if i else ""
        after = words[i + 1].group() if i + 1 < len(words) else ""
        name = [f"s{shape(core)}", f"w{shape(w)[:3]}", f"p{shape(before)}", f"n{shape(after)}",
                f"P{before.lower()[:16]}", f"d{min(len(digits), 20)}", f"c{core.count('.')}{core.count('-')}",
                f"@{'@' in core}", f"+{core[:1] == '+' or before[:1] == '+'}",
                f"q{w[:1] in '\"' + chr(39)}{len(core) >= 16}", f"x{bool(re.fullmatch('[0-9A-Fa-f]{32,}', core))}", "b"]
        if 12 <= len(digits) <= 19:
            name.append(f"l{luhn(digits)}")
        parts = core.split(".")
        if len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 9 for p in parts):
            name.append(f"o{all(int(p) <= 255 for p in parts)}")
        raw = np.array([sum(ord(c) * 1_000_003 ** k for k, c in enumerate(n)) & (2 ** 63 - 1) for n in name], np.uint64)
        return (mix(raw) & np.uint64((1 << BITS) - 1)).astype(np.int64).tolist()

    def labels(self, base, secrets) -> list[int]:
        """Of the base spans (and key assignments) that nodes overlap; the first listed kind counts."""
        out = [0] * len(self.spans)
        for kind, a, b in [*sorted(base, key=lambda s: -BASE.index(s[0])), *(("secret", a, b) for a, b in secrets)]:
            for k, (x, y) in enumerate(self.spans):
                if x < b and a < y:
                    out[k] = LABELS.index(kind)
        return out


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in _SECRET.finditer(text)]


def interesting(column: pa.Array) -> np.ndarray:
    """How many words with a digit or an @ each text has."""
    out = [np.zeros(0, np.int64)]
    for _, _, data, off in slices(column):
        start, end, words = word_spans(data, off)
        c = np.concatenate(([0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))))
        hit = np.concatenate(([0], np.cumsum(c[end] > c[start])))
        out.append(hit[words[1:]] - hit[words[:-1]])
    return np.concatenate(out)


def fit_unary(rows: list[list[int]], y: np.ndarray, steps: int = 200, ridge: float = 0.5) -> np.ndarray:
    """Softmax regression on hashed features by scaled gradient steps."""
    n = len(LABELS)
    w = np.zeros((1 << BITS, n))
    if not rows:
        w[:, 0] = 1.0
        return w
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.array(r) for r in rows])
    size = np.bincount(col, minlength=1 << BITS)[:, None] + ridge
    goal = np.eye(n)[y]
    v = np.zeros_like(w)
    for _ in range(steps):
        z = np.zeros((len(rows), n))
        np.add.at(z, at, w[col])
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = np.zeros_like(w)
        np.add.at(g, col, (p - goal)[at])
        v = 0.9 * v - 0.1 * (g + 0.02 * w) / size
        w += v
    return w


def fit_edges(pairs: list[tuple[int, int, int]]) -> np.ndarray:
    """Pair potentials by kind of edge: log-odds of the two labels over chance, both ways round."""
    out = np.zeros((3, len(LABELS), len(LABELS)))
    for kind in range(3):
        c = np.full((len(LABELS), len(LABELS)), 0.2) + 2 * np.eye(len(LABELS)) * (kind > 0)
        for a, b, k in pairs:
            if k == kind:
                c[a, b] += 1
                if kind:
                    c[b, a] += 1
        chance = c.sum(1, keepdims=True) * c.sum(0, keepdims=True) / c.sum()
        out[kind] = np.clip(np.log(c / chance), -3, 3)
    return out


def beliefs(unary: np.ndarray, u: np.ndarray, v: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by loopy sum-product, until no message changes by more than TOLERANCE, or after `rounds`.

    unary: (nodes, labels) logs; pair: (edges, labels of u, labels of v).
    """
    there = np.zeros((len(u), unary.shape[1]))
    back = np.zeros_like(there)
    total = unary.copy()

    def summed(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for _ in range(rounds if len(u) else 0):
        new_there = summed((total[u] - back)[:, :, None] + pair, 1)
        new_back = summed((total[v] - there)[:, None, :] + pair, 2)
        new_there = 0.5 * there + 0.5 * (new_there - new_there.max(axis=1, keepdims=True))
        new_back = 0.5 * back + 0.5 * (new_back - new_back.max(axis=1, keepdims=True))
        change = max(np.abs(new_there - there).max(), np.abs(new_back - back).max())
        there, back = new_there, new_back
        total = unary.copy()
        np.add.at(total, v, there)
        np.add.at(total, u, back)
        if change < TOLERANCE:
            break
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, nodes: int = TRAIN_NODES) -> dict:
    """Potentials from a sample of documents with about `nodes` nodes in all."""
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(interesting(b.column(1)))], ["doc_id", "n"])

    sizes = map_batches(docs, count, "doc_id long, n long").where(f"n > 0 AND n <= {nodes}")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return {"unary": None, "pair": None}
    share = min(1.0, nodes / total)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for b in batches:
            n = interesting(b.column(1))
            out = []
            for t, k in zip(b.column(1).to_pylist(), n.tolist(), strict=True):
                if 0 < k <= nodes:
                    doc = Nodes(t)
                    y = doc.labels(base_spans(t), secrets(t))
                    out.append((doc.features, y, [(y[a], y[c], kind) for a, c, kind in doc.edges]))
            flat = [(f, y) for fs, ys, _ in out for f, y in zip(fs, ys, strict=True)]
            pairs = [p for _, _, e in out for p in e]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in flat], pa.list_(pa.int64())),
                                              pa.array([y for _, y in flat], pa.int64()),
                                              pa.array([None] * len(flat), pa.list_(pa.int64()))], ["f", "y", "e"])
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(pairs), pa.list_(pa.int64())),
                                              pa.array([None] * len(pairs), pa.int64()),
                                              pa.array([list(p) for p in pairs], pa.list_(pa.int64()))], ["f", "y", "e"])

    got = map_batches(sample, run, "f array<long>, y long, e array<long>").collect()  # about `nodes` short rows
    rows = [r for r in got if r["f"] is not None]
    return {"unary": fit_unary([r["f"] for r in rows], np.array([r["y"] for r in rows], int)),
            "pair": fit_edges([tuple(r["e"]) for r in got if r["e"] is not None])}


def find(texts: list[str], model: dict) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text, by start and then kind as listed."""
    out = [[(*s, True) for s in base_spans(t)] for t in texts]
    if model["unary"] is None:
        return out
    docs = [Nodes(t) for t in texts]
    first = np.concatenate(([0], np.cumsum([len(d.spans) for d in docs])))
    if not first[-1]:
        return out
    unary = np.stack([model["unary"][f].sum(axis=0) for d in docs for f in d.features])
    edges = np.array([(a + f, b + f, k) for d, f in zip(docs, first.tolist(), strict=False) for a, b, k in d.edges],
                     np.int64).reshape(-1, 3)
    p = beliefs(unary, edges[:, 0], edges[:, 1], model["pair"][edges[:, 2]])
    label, sure = p.argmax(axis=1), p.max(axis=1) >= BELIEF
    for i, d in enumerate(docs):
        taken, added = [(a, b) for _, a, b, _ in out[i]], []
        for k, (x, y) in enumerate(d.spans):
            j = first[i] + k
            if label[j] and sure[j] and not any(a < y and x < b for a, b in taken):
                word = texts[i][x:y]
                x += len(word) - len(word.lstrip(_OUTER))
                y = x + len(word.strip(_OUTER))
                name = LABELS[label[j]]
                kind = name if name == "secret" else f"likely_{name}"
                near = added and added[-1][0] == kind and texts[i][added[-1][2]:x].strip(_OUTER + " ") == ""
                if near and x - added[-1][2] <= 3:
                    added[-1] = (kind, added[-1][1], y, False)
                elif y > x:
                    added.append((kind, x, y, False))
        out[i] = sorted(out[i] + added, key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def _spans(column: pa.Array, model: dict) -> list[list[tuple[str, int, int, bool]]]:
    out: list = [[] for _ in range(len(column))]
    n = interesting(column)
    at = np.flatnonzero(n)
    for x in range(0, len(at), 64):
        part = at[x:x + 64]
        for i, s in zip(part.tolist(), find([column[i].as_py() for i in part.tolist()], model), strict=True):
            out[i] = s
    return out


SPAN = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  train_nodes: int = TRAIN_NODES) -> DataFrame:
    """doc_id and spans: kind, start, end (code points, end exclusive), base (by a pattern)."""
    docs = as_text(docs, id_col, text_col)
    model = train(docs, train_nodes)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in d]
                    for d in _spans(b.column(1), model)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_batches(docs, run, f"doc_id long, spans {SPAN}")


def redact(docs: DataFrame, text_col: str = "text", train_nodes: int = TRAIN_NODES) -> DataFrame:
    """The documents with each span (overlapping ones as one) replaced by its first kind in angle brackets."""
    model = train(docs.select(F.lit(0).cast("long").alias("doc_id"),
                              F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), train_nodes)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            column = b.column(at)
            texts = column.to_pylist()
            for i, spans in enumerate(_spans(column.fill_null(""), model)):
                out, done, end = [], 0, -1
                for kind, x, y, _ in spans:
                    if x >= end:
                        out += [texts[i][done:x], f"<{kind.upper()}>"]
                    end = max(end, y)
                    done = end
                if spans:
                    texts[i] = "".join(out) + texts[i][done:]
            columns = list(b.columns)
            columns[at] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_batches(docs, run, docs.schema)


def op8_skip_chain_pii(spark, sf_dir: str) -> DataFrame:
    out = personal_data(documents(spark, sf_dir))
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{k}')) as long)").alias(f"n_{k}")
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return out.select("doc_id", *map(count, BASE),
                      F.sha2(F.expr(joined.format("filter(spans, s -> s.base)")).cast("binary"), 256).alias("base_sha256"),
                      F.expr(joined.format("spans")).alias("spans"))
