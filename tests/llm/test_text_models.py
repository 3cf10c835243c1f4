import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from telemill.llm import fingerprints, pii, repetition, text, toxicity, weak_labels
from tests.llm.cases import DIR, frame, nothing, odd, small_texts  # noqa: F401 (fixtures)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- text helpers

@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\t\U0001f600")), max_size=30), max_size=6), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_slices_and_words(texts, limit):
    got = []
    for a, b, data, off in text.slices(pa.array(texts, pa.string()), limit):
        start, end, words = text.word_spans(data, off)
        raw = data.tobytes()
        for k in range(b - a):
            got.append([raw[x:y].decode() for x, y in zip(start[words[k]:words[k + 1]], end[words[k]:words[k + 1]])])
    assert got == [WORD.findall(t) for t in texts]


def test_window_minimum_and_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 60, 50, dtype=np.uint64)
    for w in (1, 2, 3, 7, 8, 31):
        assert text.window_min(h, w).tolist() == [min(h[i:i + w].tolist()) for i in range(51 - w)]
    two = np.concatenate((h, h))
    assert text.window_hash(two, 5)[:46].tolist() == text.window_hash(two, 5)[50:96].tolist()


# ---- repetition

def brute_repetition(t, m=8):
    w = WORD.findall(t or "")
    n = len(w)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    five = Counter(tuple(w[i:i + 5]) for i in range(n - 4))
    hit = {k for i in range(n - 4) if five[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    cover, longest, k = set(), 0, m
    while True:
        c = Counter(tuple(w[i:i + k]) for i in range(n - k + 1))
        at = [i for i in range(n - k + 1) if c[tuple(w[i:i + k])] > 1]
        if not at:
            break
        longest = k
        cover |= {j for i in at for j in range(i, i + k)}
        k += 1
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit),
            len(cover), longest)


def test_repetition_against_brute_force():
    rnd = random.Random(1)
    parts = ["a ", "b ", "c\n", "é# ", "\n", "a b c d e f g h ", "  ", "x y z\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 60))) for _ in range(500)]
    texts += [None, "", " ", "a " * 300, "\n\na\n\na"]
    got = repetition.verdicts(pa.array(texts), 8, 0.2, 100)
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in repetition.NAMES) == brute_repetition(t), t


def test_quality_verdict_and_odd_rows(spark, odd, nothing):
    clean = " ".join(f"w{i}" for i in range(400))
    twice = clean + " " + " ".join(f"w{i}" for i in range(60))
    r = {x["doc_id"]: x for x in repetition.quality(frame(spark, [(1, clean), (2, twice)]), max_repeat=50).collect()}
    assert r[1]["kept"] and not r[2]["base_failed"] is None and r[2]["longest_repeat"] == 60 and not r[2]["kept"]
    rows = {x["doc_id"]: x for x in repetition.quality(odd).collect()}
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and rows[5]["longest_repeat"] == 29_999
    kept = repetition.filter_quality(odd)
    assert kept.schema == odd.schema
    assert sorted((x["doc_id"] or 0, x["bucket"]) for x in kept.collect()) == [(0, "y"), (1, "x"), (1, "x"), (8, "x")]
    assert repetition.quality(nothing).count() == 0 and repetition.filter_quality(nothing).count() == 0


# ---- fingerprints

def jaccard(a, b):
    a, b = (Counter(WORD.findall(x.lower())) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collisions_follow_generalised_jaccard(small_texts):
    texts = [t for _, t in small_texts if len(t) > 300][:120]
    draw = fingerprints.Sampler(128)
    errors = []
    for a, b in zip(texts, texts[1:]):
        edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        p = draw.fingerprints(pa.array([a, edited, b]))
        errors.append(fingerprints.likeness(p[:1], p[1:2])[0] - jaccard(a, edited))
        errors.append(fingerprints.likeness(p[:1], p[2:])[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.05


def test_edited_texts(spark, small_texts, odd, nothing):
    import hashlib
    docs = sorted(small_texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(frame(spark, docs).repartition(5)).collect()}
    for k, (i, t) in enumerate(docs):
        j, nxt = docs[(k + 1) % len(docs)]
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (np.frombuffer(bytes.fromhex(got[x]["fingerprint"]), ">u2")[None] for x in (i, j))
        assert got[i]["near_next"] == pytest.approx(fingerprints.likeness(a, b)[0])
    rows = fingerprints.edited_likeness(odd).collect()
    assert len(rows) == odd.count()
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 8)}
    assert len(same) == 1 and len({r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.edited_likeness(nothing).count() == 0
    assert fingerprints.fingerprint(odd).count() == odd.count()


def test_ranges_do_not_change_the_order(spark):
    rnd = random.Random(3)
    docs = [(i, f"text {i} " + "x " * rnd.randrange(50)) for i in rnd.sample(range(10 ** 12), 300)]
    df = fingerprints.as_text(frame(spark, docs), "doc_id", "text")
    rows = fingerprints.with_next(df, range_bytes=800).collect()
    order = sorted((i for i, _ in docs), reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    follows = {}
    for a, b in zip(rows, rows[1:]):
        if a["range"] == b["range"] and not a["tail"]:
            follows[a["doc_id"]] = b["doc_id"]
    assert len({r["range"] for r in rows}) > 3 and follows == after


# ---- toxicity

def test_channel_restores_known_words():
    rnd = random.Random(1)
    words = "the stupid idiot moron and trash of a clown was in that worthless loser to".split()
    column = pa.array([" ".join(rnd.choice(words) for _ in range(4000))])
    n = np.zeros(toxicity.SIZE ** 3, np.int64)
    for _, _, data, _ in text.slices(column):
        k = np.concatenate(([0, 0], toxicity._CLASS[data].astype(np.int32), [0, 0]))
        n += np.bincount((k[:-2] * 28 + k[1:-1]) * 28 + k[2:], minlength=28 ** 3)
    channel = toxicity.Channel(n)
    noisy = ["you 1d10t", "s t u p i d man", "stuuuupid clown", "m.o.r.o.n", "w0rthl3ss", "$tupid", "tr@sh", "lo$er!",
             "id-iot", "plain words stay", "", "c l o w n", "st*pid"]
    want = ["you idiot", "stupid man", "stupid clown", "moron", "worthless", "stupid", "trash", "loser!", "idiot",
            "plain words stay", "", "clown", "stupid"]
    assert toxicity.restored(pa.array(noisy), channel).to_pylist() == want


def _channel(words):
    rnd = random.Random(1)
    n = np.zeros(toxicity.SIZE ** 3, np.int64)
    for _, _, data, _ in text.slices(pa.array([" ".join(rnd.choice(words.split()) for _ in range(4000))])):
        k = np.concatenate(([0, 0], toxicity._CLASS[data].astype(np.int32), [0, 0]))
        n += np.bincount((k[:-2] * 28 + k[1:-1]) * 28 + k[2:], minlength=28 ** 3)
    return toxicity.Channel(n)


def test_channel_restores_places_of_any_length():
    channel = _channel("you are stupid idiot and moron trash clown worthless loser")
    said = "you are stupid idiot and moron".split()
    spaced = " ".join("".join(said))
    chained = ".".join(["clown", "1d10t", "trash", "moron", "worthless", "loser", "stupid", "clown"])
    noisy = [spaced, " ".join("".join(said * 8)), "stu" + "u" * 100 + "pid", chained, "\u2014 a b \u2014", "i d i o t-clown"]
    assert len(spaced) > 48 and len(" ".join("".join(said * 8))) > 384 and len(chained) > 48
    got = toxicity.restored(pa.array(noisy), channel).to_pylist()
    assert [g.replace(" ", "") for g in got[:2]] == ["".join(said), "".join(said * 8)]
    assert got[0].split() == said and got[1].split() == said * 8 and got[2] == "stupid"
    assert got[3].replace(" ", "") == "clownidiottrashmoronworthlessloserstupidclown"
    assert got[4:] == ["\u2014 a b \u2014", "idiot clown"]
    assert len(toxicity.restored(pa.array(["stu" + "u" * 200_000 + "pid " + "a b " * 50_000]), channel)[0].as_py()) < 400_000


def test_channel_restores_mixed_noise():
    channel = _channel("you are stupid idiot and moron trash clown worthless loser")
    noisy = ["i d 1 0 t", "1 d 1 0 t", "s t u p 1 d", "i  d  i  o  t", "i - d - i - o - t", "stu#pid", "i~d~i~o~t",
             "m/o/r/o/n", "m,o:r;0%n", "s s t u u u p 1 d!", "t r @ @ s h.", "c=l=0=0=0=w=n", "!diot",
             "1 2 3 4", "a b", "3 + 4 = 7", "\u2014 \u2014 \u2014", "plain words, and more: of them"]
    want = ["idiot", "idiot", "stupid", "idiot", "idiot", "stupid", "idiot", "moron", "moron", "stupid!", "trash.",
            "clown", "idiot", "1 2 3 4", "a b", "3 + 4 = 7", "\u2014 \u2014 \u2014", "plain words, and more: of them"]
    got = toxicity.restored(pa.array(noisy), channel).to_pylist()
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w] == []


def test_toxicity_learns_and_bears_odd_rows(spark, odd, nothing):
    rnd = random.Random(2)
    plain = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ato", "emi", "ilo", "onu", "ura")]
    rows, labels = [], []
    for i in range(1, 900):
        words = [rnd.choice(plain) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rnd.randrange(40)] = rnd.choice(["vexgrub", "zornak", "vexgrubs"])
        if bad and i % 10 == 0:
            words = [w.replace("o", "0").replace("e", "3") if w.startswith(("vex", "zor")) else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    given = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, rows), given).collect()}
    held = [(y, got[i]["predicted"]) for i, y in labels if i % 3 == 0]
    assert np.mean([p for y, p in held if y]) > 0.9 and np.mean([p for y, p in held if not y]) < 0.02
    out = toxicity.toxicity(odd, spark.createDataFrame([(1, 1), (2, 0), (5, None)], "doc_id long, toxic int")).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    none = toxicity.toxicity(odd, given.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert toxicity.toxicity(nothing, given).count() == 0


# ---- personal data

E, I, C, P = (re.compile(x) for x in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(t):
    out = [("email", *m.span()) for m in E.finditer(t)]
    out += [("ip", *m.span()) for m in I.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in C.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and brute_luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in P.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


@given(st.text(alphabet=st.sampled_from(list("aA1209.@+-%_ ()é")), max_size=50))
@settings(max_examples=1000, deadline=None)
def test_base_spans(t):
    assert pii.base_spans(t) == brute_spans(t)


def test_base_spans_in_linear_time():
    import time
    t0 = time.time()
    for t in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000, "+1" + " " * 200_000, "a@b." * 40_000):
        pii.base_spans(t)
    assert time.time() - t0 < 20


def _people(n):
    rnd = random.Random(4)
    out = []
    for i in range(n):
        p = f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        out.append((i, f"we met in room {rnd.randrange(100)} call {p} or mail a{i}@mail{i % 7}.example.com about version "
                       f"{rnd.randrange(9)}.{rnd.randrange(9)} token = \"{rnd.getrandbits(160):040x}\" thanks"))
    return out


def test_field_finds_what_lost_its_form(spark):
    model = pii.train(fingerprints.as_text(frame(spark, _people(300)), "doc_id", "text"))
    text_ = "we met in room 7 call +1 (202) 555-0143 and later again 555-0143 about version 3.4 of it"
    found = [(k, text_[a:b], base) for k, a, b, base in pii.find([text_], model)[0]]
    assert found == [("phone", "+1 (202) 555-0143", True), ("likely_phone", "555-0143", False)]
    # the skip edge to the number's first occurrence adds to the belief
    nodes = pii.Nodes(text_)
    unary = np.stack([model["unary"][f].sum(axis=0) for f in nodes.features])
    last = nodes.spans.index((text_.rindex("555-0143"), text_.rindex("555-0143") + 8))
    assert any(kind > 0 and k == last for _, k, kind in nodes.edges)

    def belief(edges):
        e = np.array(edges, int).reshape(-1, 3)
        return pii.beliefs(unary, e[:, 0], e[:, 1], model["pair"][e[:, 2]])[last, pii.LABELS.index("phone")]

    assert belief(nodes.edges) > belief([e for e in nodes.edges if e[2] == 0])


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(3)
    unary = rng.normal(size=(4, 3))
    u, v = np.array([0, 1, 1]), np.array([1, 2, 3])
    pair = rng.normal(size=(3, 3, 3))
    p = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(pair[e, y[u[e]], y[v[e]]] for e in range(3)))
        for i in range(4):
            p[i, y[i]] += w
    assert pii.beliefs(unary, u, v, pair, rounds=200) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=1e-6)


def test_personal_data_odd_rows_and_redaction(spark, odd, nothing):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == [] for r in rows)
    assert pii.personal_data(nothing).count() == 0 and pii.redact(nothing).count() == 0
    docs = [(1, "mail ä.x a.b@c.example.org, call +1 (202) 555-0143."), (2, None), (3, "4111111111111111, 1.2.3.4")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, docs)).collect()}
    assert got == {1: "mail ä.x <EMAIL>, call <PHONE>.", 2: None, 3: "<CARD>, <IP>"}
    assert pii.redact(odd).schema == odd.schema


# ---- weak labels

def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(5)
    n, accuracy = 20_000, np.array([0.95, 0.9, 0.8, 0.85, 0.7])
    y = (rng.random(n) < 0.8).astype(int)
    votes = np.where(rng.random((n, 5)) < accuracy, y[:, None], 1 - y[:, None])
    votes = np.where(rng.random((n, 5)) < 0.2, weak_labels.ABSTAIN, votes)
    patterns, counts = np.unique(weak_labels.pattern(votes), return_counts=True)
    m = weak_labels.fit_label_model(patterns, counts.astype(float), 5)
    assert m["prior"] == pytest.approx(0.8, abs=0.03)
    assert m["table"][1, :, 1] == pytest.approx(accuracy, abs=0.04)
    guess = np.array([m["posterior"][k] > 0.5 for k in weak_labels.pattern(votes).tolist()])
    assert (guess == y).mean() > 0.95


def test_quality_scores_on_labelled_documents(spark):
    sf = DIR.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_labels.quality_scores(docs).join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.1


def test_quality_scores_odd_rows(odd, nothing):
    rows = weak_labels.quality_scores(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in rows)
    assert not any(r["kept"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert weak_labels.quality_scores(nothing).count() == 0
