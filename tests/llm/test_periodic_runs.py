import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from telemill.llm import periodic_runs as pr
from tests.llm.cases import frame, nothing, odd, small_texts  # noqa: F401 (fixtures)


def brute_runs(words, least=6, exponent=4):
    """Every maximal stretch of every period whose least period it is, by definition."""
    n, code = len(words), {}
    c = np.array([code.setdefault(w, len(code)) for w in words], int)
    found = set()
    for p in range(1, n // exponent + 1):
        same = np.concatenate(([0], (c[:-p] == c[p:]).astype(int), [0]))
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            x = c[s:e + p]
            if len(x) >= max(least, exponent * p) and not any((x[q:] == x[:-q]).all() for q in range(1, p)):
                found.add((s, len(x), p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def changed(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def local(words, tile_words):
    """The three steps without Spark."""
    code = {w: k for k, w in enumerate(set(words))}
    c = np.array([code[w] for w in words], np.int32)
    spans = {}
    for octave, base, b, part in pr.tiles(c, tile_words=tile_words):
        for q, lo, hi in pr.solve(octave, base, *pr._unblob(pr._blob(b, part))):
            spans.setdefault(q, []).append((lo, hi))
    runs = []
    for q, xs in spans.items():
        joined = []
        for lo, hi in sorted(xs):
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = max(hi, joined[-1][1])
            else:
                joined.append([lo, hi])
        runs += [(lo, hi - lo + q, q) for lo, hi in joined if hi - lo + q >= max(6, 4 * q)]
    return pr.least_periods(runs)


def random_words(rnd):
    out = []
    while len(out) < rnd.choice([5, 30, 200, 700]):
        base = [rnd.choice("abc") for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 13, 40]))]
        if rnd.random() < 0.3:
            base = base * rnd.randrange(2, 5)
        out += base * rnd.randrange(1, 12) + base[:rnd.randrange(len(base))]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tiles_find_all_runs(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        words = random_words(rnd)
        runs = brute_runs(words)
        for tile_words in (1, 16, 2048):
            assert local(words, tile_words) == runs
        c = np.array([ord(w[0]) for w in words], np.int32)
        if runs:
            assert pr.suspicious(c, np.array([0, len(c)]))[0]


def test_long_repetition_makes_few_tiles():
    c = np.zeros(100_000, np.int32)
    size = sum(len(part) for *_, part in pr.tiles(c))
    assert size < 12 * len(c)
    assert local(["x"] * 20_000, 2048) == [(0, 20_000, 1)]
    thue = ["ab"[bin(k).count("1") % 2] for k in range(5000)]
    assert local(thue, 2048) == [] and local(thue * 4, 2048) == [(0, 20_000, 5000)] == brute_runs(thue * 4)


def test_documents_against_brute_force(spark, small_texts):  # noqa: F811
    rnd = random.Random(7)
    docs = small_texts + [(10 ** 6 + k, " ".join(random_words(rnd))) for k in range(60)]
    docs += [(2 * 10 ** 6 + k, "\n".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 40)))) for k in range(60)]
    got = {r["doc_id"]: r for r in pr.periodic_runs(frame(spark, docs).repartition(3), alter=True, tile_words=64).collect()}
    n = 0
    for i, text in docs:
        words = changed(re.findall(r"[^\x20\x09-\x0D]+", text or ""), i)
        runs = brute_runs(words)
        n += bool(runs)
        assert [(r["start"], r["length"], r["period"]) for r in got[i]["runs"]] == runs
        assert got[i]["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert len(got) == len(docs) and n > 60


def test_query_columns(spark):
    out = {r["doc_id"]: r for r in pr.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for i, text in rows:
        words = changed(re.findall(r"[^\x20\x09-\x0D]+", text or ""), i)
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert tuple(out[i]) == (i, len(runs), best[0], best[1], best[2], milli, digest,
                                 hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_odd_rows(spark, odd, nothing):  # noqa: F811
    got = pr.periodic_runs(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and [(r["start"], r["length"], r["period"]) for r in by[5]["runs"]] == [(0, 30_000, 1)]
    assert by[5]["collapsed"] == "word"
    for i in (1, 2, 3, 4, None, 6, 7, 8):
        assert by[i]["runs"] == [] and by[i]["collapsed"] is None
    assert by[2]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest() == by[4]["collapsed_sha256"]
    assert pr.periodic_runs(nothing).count() == 0
    clash = spark.createDataFrame([(1, "a " * 9, 1, 2, "x")], "row long, blob string, kind long, period long, sha string")
    assert [tuple(r["runs"][0]) for r in pr.periodic_runs(clash, "row", "blob").collect()] == [(0, 9, 1)]
