import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from telemill.llm import automaton_dedup, components, minmax, suffix_dedup
from tests.llm.cases import frame, nothing, odd  # noqa: F401 (fixtures)


def brute_bytes(docs, width):
    first, out = {}, {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, b in texts:
        for p in range(len(b) - width + 1):
            s = b[p:p + width]
            first[s] = min(first.get(s, i), i)
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < i:
                gone[p] += 1
                gone[p + width] -= 1
        g = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out[i] = (len(b), int(g.sum()), spans, np.frombuffer(b, np.uint8)[~g].tobytes())
    return out


def brute_words(docs, width):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    n = Counter(tuple(w[p:p + width]) for _, w in words for p in range(len(w) - width + 1))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if n[tuple(w[p:p + width])] > 1:
                gone[p:p + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def mixture(seed, n=60):
    """Documents that share passages, cut and joined at random places."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "the", "a"]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 90))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            p = rnd.choice(passages)
            x = rnd.randrange(0, len(p) // 2)
            parts.append(p[x:x + rnd.randrange(30, len(p))] if rnd.random() < 0.7
                         else " ".join(rnd.choice(vocabulary) for _ in range(30)))
        docs.append((rnd.randrange(10 ** 12) if rnd.random() < 0.2 else i * 7, rnd.choice([" ", "\n"]).join(parts)))
    return list({i: (i, t) for i, t in docs}.values()) + [(10 ** 13, "tick tock " * 200), (10 ** 13 + 1, "tick tock " * 90)]


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 1), (3, 3)])
def test_bytes_against_brute_force(spark, seed, hot):
    docs = mixture(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffix_dedup.remove_repeated_bytes(frame(spark, docs).repartition(3), hot=hot).collect()}
    assert got == brute_bytes(docs, 50)


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 1), (3, 3)])
def test_words_against_brute_force(spark, seed, hot):
    docs = mixture(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"])
           for r in automaton_dedup.remove_repeated_passages(frame(spark, docs).repartition(3), width=12, hot=hot).collect()}
    assert got == brute_words(docs, 12)


def test_suffix_blocks_find_equal_strings(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 2, 600).astype(np.uint64)
    place = np.arange(0, 500) // 13 * 13  # of one residue, as anchored segments are
    place = np.unique(place)
    width = 14
    for p, name in suffix_dedup.classes(x, place, width):
        strings = [bytes(x[a:a + width].astype(np.uint8)) for a in p]
        for i in range(1, len(p)):
            assert (name[i] == name[i - 1]) == (strings[i] == strings[i - 1])


def test_cover_is_a_difference_cover():
    have = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert have == set(range(suffix_dedup.PERIOD))


def test_automaton_counts_windows():
    rnd = random.Random(2)
    sequences = [[rnd.randrange(3) for _ in range(rnd.randrange(0, 40))] for _ in range(12)]
    shard = automaton_dedup.SuffixAutomaton()
    for s in sequences:
        shard.add(s)
    shard.count()
    for width in (1, 3, 6):
        n = Counter(tuple(s[p:p + width]) for s in sequences for p in range(len(s) - width + 1))
        for s in sequences:
            assert shard.repeated(s, width) == [p for p in range(len(s) - width + 1) if n[tuple(s[p:p + width])] > 1]


def test_passages_of_rows_without_id_count(spark):
    rnd = random.Random(12)
    shared, own = (" ".join(f"{rnd.choice('abcd')}{rnd.randrange(10 ** 6)}" for _ in range(50)) for _ in range(2))
    docs = frame(spark, [(1, f"one {shared}"), (None, f"{shared} two"), (None, own), (None, own), (2, "nothing shared here")]).repartition(3)
    got = sorted(tuple(r) for r in automaton_dedup.remove_repeated_passages(docs).select("n_words", "n_removed", "kept").collect())
    assert got == [(3, 0, "nothing shared here"), (50, 50, ""), (50, 50, ""), (51, 50, "one"), (51, 50, "two")]
    ids = automaton_dedup.remove_repeated_passages(docs).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in ids) == [(False, 1), (False, 2), (True, 0), (True, 0), (True, 0)]
    out = automaton_dedup.rewrite(docs)
    assert out.where("doc_id IS NULL").count() == 3 and sorted(r["text"] for r in out.collect())[:3] == ["", "", "nothing shared here"]


def test_odd_rows(spark, odd, nothing):
    rows = suffix_dedup.remove_repeated_bytes(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [r["n_removed"] for r in by[1]] == [0, 0] and by[8][0]["n_removed"] == by[8][0]["n_bytes"] == 59
    assert by[2][0]["n_bytes"] == by[3][0]["n_bytes"] == 0 and by[None][0]["n_removed"] == 0
    assert by[5][0]["n_removed"] == by[6][0]["n_removed"] == 0
    rows = automaton_dedup.remove_repeated_passages(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[5]["n_removed"] == by[5]["n_words"] == 30_000 and by[None]["n_removed"] == 0
    assert suffix_dedup.remove_repeated_bytes(nothing).count() == 0
    assert automaton_dedup.remove_repeated_passages(nothing).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    a, b = "first " * 3 + "one two three four five six seven eight nine ten " * 2, "second text altogether " * 9
    docs = [(1, a), (1, b), (0, a)]
    rows = {(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeated_bytes(frame(spark, docs)).collect()}
    assert rows == {(1, b""), (1, b.encode()), (0, a.encode())}


def test_rewrite_keeps_columns(spark, odd):
    out = automaton_dedup.rewrite(odd)
    assert out.schema.simpleString() == odd.schema.simpleString()
    got = Counter((r["doc_id"], r["bucket"], r["kind"], r["text"]) for r in out.collect())
    want = Counter((r["doc_id"], r["bucket"], r["kind"], "" if r["doc_id"] == 5 else r["text"]) for r in odd.collect())
    assert got == want


# ---- near-duplicates

def brute_near(docs, percent=75):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[p:p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def chain(seed, n, words=60):
    """Texts that each differ from the one before by a few words: links without one hub."""
    rnd = random.Random(seed)
    text = [f"t{rnd.randrange(1000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(text)
        text[rnd.randrange(words)] = f"n{rnd.randrange(10 ** 6)}"
        out.append(" ".join(text))
    return out


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(7)
    texts = chain(1, 40) + chain(2, 25, 200) + chain(3, 10, 12) + ["", None, "a b", "A B", "a b c"] + chain(4, 3, 5)
    texts += [t.upper() for t in chain(1, 40)[::5]]
    ids = rnd.sample(range(10 ** 9), len(texts))
    docs = list(zip(ids, texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute_near(docs)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Hot hubs and buckets are split into many parts, with the same result."""
    monkeypatch.setattr(minmax, "HELD", 3)
    monkeypatch.setattr(minmax, "BLOCK", 4)
    docs = list(enumerate(chain(5, 60) + chain(6, 30)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute_near(docs)


def test_near_duplicates_odd_rows(spark, odd, nothing):
    rows = minmax.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["component_id"] == 1 and not by[8]["kept"] and by[2]["n_shingles"] == 0 and by[2]["component_id"] == 2
    assert by[None]["kept"] and by[None]["component_id"] is None and by[5]["n_shingles"] == 1
    assert minmax.near_duplicates(nothing).count() == 0


def test_signature_is_unbiased():
    rnd = np.random.default_rng(1)
    hashes, errors = minmax.MinMax(64), []
    for _ in range(30):
        pool = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = pool[:220], pool[60:]
        x, y = (np.frombuffer(hashes.signature(np.unique(s)), "<u2") for s in (a, b))
        errors.append((x == y).mean() - 160 / 300)
    assert abs(np.mean(errors)) < 0.03


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 30)]
    df = spark.createDataFrame(path + star + [(5000, 5001), (5001, 5000), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = {i: 0 for i in range(61)} | {1000 + k: 1000 for k in range(30)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert components.components(df.limit(0)).count() == 0


