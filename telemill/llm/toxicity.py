"""Toxicity of noisy text: restore it under a noisy channel, then score it.

1. A character model (trigrams of letters within words) is counted over all
   documents.
2. Suspicious places of a text (digits or marks between letters, letters three
   times or more in a row, letters or their look-alikes set apart one by one by
   any number of separators) become lattices: a mark may stand for letters it
   looks like, a separator for nothing or a word's end, a letter or look-alike
   that repeats the last letter for nothing. The Viterbi path of least cost
   (channel plus character model) is the restored word.
3. Words of the restored text, and their first 4 to 8 bytes, occurring once,
   twice or three times and more, are features by hash. Those that labelled
   training documents of the two classes differ in most are kept; a logistic
   model over them gives the score. Counts cover all training documents; the
   model is fitted on a sample of at most about `fit_rows` of them.

Labels are learned only where `train` holds; neither id nor any other column
enters a score.

Defined cases: null or empty text scores as the model's base rate; equal rows
score alike; labels that are null or contradict each other for one doc_id are
left out; without labels of both classes every score is 0; other columns take
no part, and a null doc_id stays null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import as_text, documents, map_batches, written
from .text import mix, powers, prefix_hash, slices

#: Hash buckets of features (2**22; every one that passes the test is kept) and labelled rows the logistic model is fitted on.
BITS, FIT_ROWS = 22, 50_000
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Letters that digits and marks are written for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*'`~^/\\,:;#%&="
#: Costs (nats) of the channel: a letter look-alike, a dropped repeat, a dropped mark, a word's end at a separator,
#: a vowel behind an asterisk.
ALIKE, REPEAT, DROP, END, HIDDEN = 0.7, 0.3, 8.0, 0.5, 1.0
#: Longest place that is remembered; longer ones seldom come again.
REMEMBERED = 64

#: What belongs to a token besides letters; what single characters of a row are, and which may follow one as punctuation.
MARKS = "".join(LOOKS_LIKE) + SEPARATORS.strip()
PUNCTUATION = "!|+"
#: What ends a row of letters set apart one by one, though its bytes are those of letters.
NO_LETTER = regex.compile(r"([^\p{L}\x00-\x7f]+)")
#: What makes a token of letters and marks worth a look.
ODD = regex.compile(r"\p{L}[^\p{L}]+\p{L}|^[0-9@$!|+]+\p{L}|\p{L}[0-9@$|+]|(\p{L})\1\1", regex.IGNORECASE)
LETTER = regex.compile(r"\p{L}")

_MARKS = np.zeros(256, bool)
_MARKS[list(MARKS.encode())] = True
_APART = np.zeros(256, bool)
_APART[list(SEPARATORS.encode())] = True
_ALIKE = np.zeros(256, bool)
_ALIKE[list("".join(LOOKS_LIKE).encode())] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(PUNCTUATION.encode())] = True
_CLASS = np.zeros(256, np.int16)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0xC0:] = 27
SIZE = 28


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Letters A-Z and the capitals of Latin-1 lowered, in UTF-8 bytes."""
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    if len(data) > 1:
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data = data + capital * np.uint8(32)
    return data


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of (letter, letter, letter) within words over all documents; 0: a word's edge, 27: any other letter."""
    def run(batches):
        n = np.zeros(SIZE ** 3, np.int64)
        for b in batches:
            for _, _, data, _ in slices(b.column(1)):
                k = _CLASS[data[(data & 0xC0) != 0x80]].astype(np.int32)
                k = np.concatenate(([0, 0], k, [0, 0]))
                n += np.bincount((k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:], minlength=SIZE ** 3)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["k", "n"])

    total = map_batches(docs, run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE ** 3, np.int64)
    for r in total.collect():  # at most 28 ** 3 rows
        out[r["k"]] = r["n"]
    return out


class Channel:
    """Restores suspicious places; remembers what it has restored."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SIZE, SIZE, SIZE) + 0.0
        two = c.sum(axis=2, keepdims=True)
        one = c.sum(axis=0)
        back = (one + 0.5) / (one.sum(axis=1, keepdims=True) + 0.5 * SIZE)
        self.cost = -np.log((c + 8 * back[None]) / (two + 8)).astype(np.float32)
        self.cost = self.cost.tolist()
        self.known: dict[str, str] = {}

    def choices(self, s: str, i: int):
        """(letter written or '', cost) for the character at i."""
        ch = s[i]
        out = []
        if ch.isalpha():
            out.append((ch, 0.0))
        else:
            out += [(x, ALIKE) for x in LOOKS_LIKE.get(ch, "")]
            if ch == "*":
                out += [(x, HIDDEN) for x in "aeiou"]
            if ch in SEPARATORS:
                out += [("", 0.0 if ch != "'" else 1.0), (" ", END)]
            else:
                out.append(("", DROP))
                if i and s[i - 1] == ch:
                    out.append(("", REPEAT))
        return out

    def restore(self, place: str) -> str:
        s = place.lower()
        if len(s) > REMEMBERED:
            return self.viterbi(s)
        got = self.known.get(s)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[s] = self.viterbi(s)
        return got

    def viterbi(self, s: str) -> str:
        number = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
        # by the last two letters: (cost, letters); letters are (last letter, the letters before), shared between the
        # paths and let go with them, so time and memory grow with the place's length
        paths = {(0, 0): (0.0, None)}
        for i in range(len(s)):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, price in self.choices(s, i):
                for (a, b), (cost, text) in paths.items():
                    if letter == "":
                        key, total, now = (a, b), cost + price, text
                    elif letter == " ":
                        if b == 0:
                            key, total, now = (a, b), cost + price, text
                        else:
                            key, total, now = (0, 0), cost + price + self.cost[a][b][0], (" ", text)
                    else:
                        k = number(letter)
                        if k == b and text[0] == letter:  # the last letter again, whatever was dropped between
                            key, total = (a, b), cost + price + REPEAT
                            if key not in new or total < new[key][0]:
                                new[key] = (total, text)
                        key, total, now = (b, k), cost + price + self.cost[a][b][k], (letter, text)
                    if key not in new or total < new[key][0]:
                        new[key] = (total, now)
            paths = new
        (a, b), (_, text) = min(paths.items(), key=lambda p: p[1][0] + self.cost[p[0][0]][p[0][1]][0])
        out = []
        while text is not None:
            letter, text = text
            out.append(letter)
        return "".join(reversed(out))

    def token(self, token: str) -> str:
        """The token with what lies between its outer marks restored."""
        core = token.lstrip(SEPARATORS).rstrip(SEPARATORS + PUNCTUATION)
        if not ODD.search(core):
            return token
        at = token.index(core)
        return token[:at] + self.restore(core) + token[at + len(core):]

    def spaced(self, place: str) -> str:
        """The place with each row of letters set apart restored."""
        parts = NO_LETTER.split(place)
        for i in range(0, len(parts), 2):
            core = parts[i].strip(SEPARATORS)
            if len(core) > 4 and LETTER.search(core):
                at = parts[i].index(core)
                parts[i] = parts[i][:at] + self.restore(core) + parts[i][at + len(core):]
        return "".join(parts)


def odd_places(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, spaced) in bytes, apart from each other: tokens worth a look, and rows of single letters."""
    n = len(data)
    if n < 5:
        return [(x, y, False) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) if y > x]
    low = lower_bytes(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    flag = np.zeros(n + 1, bool)
    flag[1:n] |= _MARKS[low[:-1]] & letter[1:]
    flag[1:n] |= letter[:-1] & np.isin(low[1:], np.frombuffer(b"0123456789@$|+", np.uint8))
    flag[2:n] |= letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    flag[4:n] |= (low[4:] >= 0xC0) & (low[4:] == low[2:-2]) & (low[4:] == low[:-4])  # a letter of two bytes
    token = letter | _MARKS[low]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = np.flatnonzero(token & (first[:n] | np.concatenate(([True], ~token[:-1]))))
    end = np.flatnonzero(token & (first[1:] | np.concatenate((~token[1:], [True])))) + 1
    hit = np.unique(np.searchsorted(begin, np.flatnonzero(flag[:n] & token), side="right") - 1)
    out = [(x, y, False) for x, y in zip(begin[hit].tolist(), end[hit].tolist(), strict=True)]
    # single letters or look-alikes (punctuation may follow), only separators between: from each first to the last of its row
    unit = letter | _ALIKE[low]
    start = np.flatnonzero(unit & (first[:n] | np.concatenate(([True], ~unit[:-1]))))
    stop = np.flatnonzero(unit & (first[1:] | np.concatenate((~unit[1:], [True])))) + 1
    chars = np.concatenate(([0], np.cumsum(unit & ((low & 0xC0) != 0x80))))
    marks = np.concatenate(([0], np.cumsum(_PUNCTUATION[low])))
    letters = np.concatenate(([0], np.cumsum(letter)))
    apart_ = np.concatenate(([0], np.cumsum(_APART[low])))
    docs = np.searchsorted(off, start, side="right")
    lead = (chars[stop] - chars[start]) - (marks[stop] - marks[start])
    single = (chars[stop] - chars[start] == 1) | ((lead == 1) & ~_PUNCTUATION[low[start]])
    start, stop, docs = start[single], stop[single], docs[single]
    if len(start) > 2:
        gap = start[1:] - stop[:-1]
        near = (gap > 0) & (apart_[start[1:]] - apart_[stop[:-1]] == gap) & (docs[1:] == docs[:-1])
        new = np.flatnonzero(np.concatenate(([True], ~near)))
        last = np.concatenate((new[1:], [len(start)])) - 1
        many = marks[stop] - marks[start]
        end = np.where(chars[stop] - chars[start] > 1, stop - many, stop)  # punctuation behind the last stays
        x, y = start[new], end[last]
        row = (last - new >= 2) & (letters[y] > letters[x])
        out += [(i, j, True) for i, j in zip(x[row].tolist(), y[row].tolist(), strict=True)]
    apart: list[tuple[int, int, bool]] = []
    for x, y, spaced in sorted(out):
        if apart and x < apart[-1][1]:
            x, y, spaced = apart[-1][0], max(y, apart[-1][1]), spaced or apart[-1][2]
            apart.pop()
        apart.append((x, y, spaced))
    return apart


def restored(column: pa.Array, channel: Channel) -> pa.Array:
    """The texts, with suspicious places restored."""
    texts = None
    for a, _, data, off in slices(column):
        places = odd_places(data, off)
        if not places:
            continue
        raw, changed = data.tobytes(), {}
        doc = np.searchsorted(off, [p[0] for p in places], side="right") - 1
        for k, (x, y, spaced) in zip(doc.tolist(), places, strict=True):
            old = raw[x:y].decode()
            new = channel.spaced(old) if spaced else channel.token(old)
            if new != old:
                changed.setdefault(k, []).append((x, y, new))
        if changed and texts is None:
            texts = column.to_pylist()
        for k, parts in changed.items():
            out, p = [], int(off[k])
            for x, y, new in parts:
                out += [raw[p:x].decode(), new]
                p = y
            texts[a + k] = "".join(out) + raw[p:int(off[k + 1])].decode()
    return column if texts is None else pa.array(texts, pa.large_string())


def features(column: pa.Array, wanted: np.ndarray | None = None):
    """For each slice of texts: (first row, documents, feature numbers), each pair once.

    wanted: only features whose base number has a place >= 0 there.
    """
    low = np.uint64((1 << BITS) - 1)
    for a, b, data, off in slices(column):
        data = lower_bytes(data)
        n = len(data)
        letter = ((data >= 97) & (data <= 122)) | (data >= 0x80)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = letter[1:] != letter[:-1]
        cut[off] = True
        cut[n] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        keep = letter[start] if n else np.zeros(0, bool)
        start, end = start[keep], end[keep]
        doc = np.searchsorted(off, start, side="right") - 1
        c, inv = prefix_hash(data), powers(n + 1, inverse=True)
        parts = [(doc, mix((c[end] - c[start]) * inv[start]))]
        for k in PREFIXES:
            i = np.flatnonzero(end - start > k)
            s = start[i]
            parts.append((doc[i], mix((c[s + k] - c[s]) * inv[s] + np.uint64(k))))
        d, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        f = (f & low).astype(np.int64)
        if wanted is not None:
            i = np.flatnonzero(wanted[f])
            d, f = d[i], f[i]
        pair, count = np.unique((d.astype(np.int64) << BITS) | f, return_counts=True)
        d, f = pair >> BITS, pair & ((1 << BITS) - 1)
        # once, twice, three times and more are features of their own
        again = [(d, f)] + [(d[count >= k], (f[count >= k] * 3 + k) % (1 << BITS)) for k in (2, 3)]
        yield a, np.concatenate([x for x, _ in again]), np.concatenate([y for _, y in again])


def _bases(chosen: np.ndarray) -> np.ndarray:
    """Which base numbers can lead to a chosen feature."""
    wanted = np.zeros(1 << BITS, bool)
    is_chosen = np.zeros(1 << BITS, bool)
    is_chosen[chosen] = True
    f = np.arange(1 << BITS)
    wanted |= is_chosen
    for k in (2, 3):
        wanted |= is_chosen[(f * 3 + k) % (1 << BITS)]
    return wanted


def class_counts(labelled: DataFrame, counts: np.ndarray) -> DataFrame:
    """feature, n0, n1: in how many labelled documents of each class it occurs."""
    chunk = 1 << 14

    def count(batches):
        channel = Channel(counts)
        have = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            toxic = b.column(2).to_numpy()
            for a, d, f in features(restored(b.column(1), channel)):
                for k in (0, 1):
                    np.add.at(have[k], f[toxic[a + d] == k], 1)
        at = np.flatnonzero(have.any(axis=0))
        part = at // chunk
        edge = np.flatnonzero(np.diff(part)) + 1
        out = [(int(part[x]), at[x:y].astype("<i4").tobytes() + have[:, at[x:y]].astype("<i4").tobytes())
               for x, y in zip([0, *edge], [*edge, len(at)], strict=True) if y > x]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()),
                                          pa.array([x for _, x in out], pa.binary())], ["part", "blob"])

    def add(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n0, n1 = np.frombuffer(blob, "<i4").reshape(3, -1)
                total = have.setdefault(part, np.zeros((2, chunk), np.int64))
                total[0, at - part * chunk] += n0
                total[1, at - part * chunk] += n1
        for part, total in have.items():
            at = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array((at + part * chunk).astype(np.int32)), pa.array(total[0, at]),
                                              pa.array(total[1, at])], ["feature", "n0", "n1"])

    parts = map_batches(labelled, count, "part int, blob binary").repartition((1 << BITS) // chunk // 4, "part")
    return map_batches(parts, add, "feature int, n0 long, n1 long")


#: Numbers gathered at once while the model is fitted.
FIT_BLOCK = 1 << 20


class _Sums:
    """Sums of values[index[start[k]:start[k + 1]]] for each k, a block at a time."""

    def __init__(self, index: np.ndarray, start: np.ndarray):
        self.index, self.start, self.n = index, start, len(start) - 1
        full = np.flatnonzero(np.diff(start))
        cut = np.unique(np.searchsorted(start[full], np.arange(FIT_BLOCK, max(int(start[-1]), 1), FIT_BLOCK)))
        self.blocks = [x for x in np.split(full, cut) if len(x)]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for k in self.blocks:
            lo, hi = self.start[k[0]], self.start[k[-1] + 1]
            out[k] = np.add.reduceat(values[self.index[lo:hi]], self.start[k] - lo)
        return out


def fit_logistic(col: np.ndarray, off: np.ndarray, y: np.ndarray, n: int, steps: int = 300, ridge: float = 2.0):
    """Weights and bias by gradient steps with momentum. Row k has the features col[off[k]:off[k + 1]].

    The numbers are held once by row and once by feature; beside them only a block's values.
    """
    count = np.bincount(col, minlength=n)
    by_row = _Sums(col, off)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(off))
    by_feature = _Sums(row[np.argsort(col, kind="stable")], np.concatenate(([0], np.cumsum(count))))
    w, bias = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    size, v, vb = count + ridge, np.zeros(n), 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(by_row(w) + bias, -30, 30))) - y
        v, vb = 0.9 * v - 0.2 * (by_feature(e) + ridge * w) / size, 0.9 * vb - 0.2 * e.mean()
        w, bias = w + v, bias + vb
        if max(np.abs(v).max(initial=0.0), abs(vb)) < 1e-4:
            break
    return w, bias


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, fit_rows: int = FIT_ROWS) -> dict:
    """Features and weights learned from labels (doc_id, toxic) of the documents."""
    clean = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other"))
    # labels grow with the documents: a shuffled join at every size
    labelled = written(docs.join(clean.hint("shuffle_hash"), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")))
    size = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}  # two rows
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return {"chosen": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -30.0}
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n0") + 0.5) / (n0 + 1.0)
    both = (F.col("n1") + F.col("n0") + 1.0) / (n1 + n0 + 2.0)
    z = (p1 - p0) / F.sqrt(both * (1 - both) * (1.0 / n1 + 1.0 / n0))
    best = class_counts(labelled, counts).withColumn("z", z).where("abs(z) >= 4").select("feature")
    chosen = np.sort(best.toArrow().column(0).to_numpy().astype(np.int64))  # at most 2**BITS numbers
    wanted, place = _bases(chosen), np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    share = min(1.0, fit_rows / (n0 + n1))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        channel = Channel(counts)
        for b in batches:
            toxic = b.column(2).to_numpy()
            rows = [b""] * b.num_rows
            for a, d, f in features(restored(b.column(1), channel), wanted):
                p = place[f]
                d, p = d[p >= 0], p[p >= 0]
                order = np.argsort(d, kind="stable")
                d, p = d[order], p[order].astype("<i4")
                edge = np.flatnonzero(np.diff(d)) + 1
                for x, y in zip([0, *edge], [*edge, len(d)], strict=True):
                    if y > x:
                        rows[a + d[x]] = p[x:y].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(rows, pa.binary())], ["toxic", "row"])

    got = map_batches(sample, run, "toxic int, row binary").toArrow().combine_chunks()  # about fit_rows short rows
    if not got.num_rows:
        return {"chosen": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -30.0}
    column = pc.cast(got.column(1).combine_chunks(), pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, edges, data = column.buffers()
    off = np.frombuffer(edges, "<i8", count=len(column) + 1 + column.offset)[column.offset:] // 4
    col = np.frombuffer(data, "<i4") if data is not None else np.zeros(0, "<i4")
    weights, bias = fit_logistic(col, off, got.column(0).to_numpy().astype(float), len(chosen))
    return {"chosen": chosen, "weights": weights, "bias": bias}


def score(docs: DataFrame, counts: np.ndarray, model: dict) -> DataFrame:
    """doc_id, score (0 to 1)."""
    def run(batches):
        channel = Channel(counts)
        wanted, weight = _bases(model["chosen"]), np.zeros(1 << BITS, np.float64)
        weight[model["chosen"]] = model["weights"]
        for b in batches:
            z = np.full(b.num_rows, model["bias"])
            for a, d, f in features(restored(b.column(1), channel), wanted):
                np.add.at(z, a + d, weight[f])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                             ["doc_id", "score"])

    return map_batches(docs, run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score, predicted; labels (doc_id, toxic) must hold training rows only."""
    docs = as_text(docs, id_col, text_col)
    counts = trigrams(docs)
    model = train(docs, labels, counts, fit_rows=fit_rows)
    return score(docs, counts, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_noisy_channel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out)
    return toxicity(docs, labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")
