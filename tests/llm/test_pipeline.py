import random
import re

import numpy as np
import public_tokenizers as P

import __spark_entry__ as entry
import corpus_pipeline
from telemill.llm.queries import ORACLE, QUERIES
from tests.llm.cases import DIR, nothing, odd  # noqa: F401 (fixtures)
from tests.llm.test_dedup import brute_near, brute_words
from tests.llm.test_packing_bpe import check_packing
from tests.llm.test_text_models import brute_repetition, brute_spans


def _documents():
    """Clean texts, near copies, shared passages, personal data and repetitive junk."""
    rnd = random.Random(8)
    fresh = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(10 ** 5)}" for _ in range(n)]
    passage = fresh(60)
    docs = []
    for i in range(60):
        words = fresh(rnd.randrange(40, 200))
        if i % 4 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = passage
        if i % 5 == 0:
            words.insert(10, f"a{i}@mail{i}.example.com")
            words.insert(20, "4111111111111111,")
        docs.append((i * 3, " ".join(words)))
    near = docs[7][1].split()
    near[3] = "changed"
    docs += [(500, " ".join(near)), (501, docs[9][1]), (502, "same words again " * 40), (503, "too short"), (504, None)]
    return [(i, t, "en", "src", -1 if t is None else len(t)) for i, t in docs]


def test_run_against_brute_force(spark, tmp_path):
    docs = _documents()
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()

    kept = [(i, t) for i, t, *_ in docs if _passes(t)]
    assert {502, 503, 504}.isdisjoint(i for i, _ in kept)
    groups = brute_near(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    assert {500, 501}.isdisjoint(i for i, _ in kept)
    words = brute_words(kept, 35)
    kept = [(i, words[i][2] if words[i][1] else t) for i, t in kept]
    assert any(words[i][1] for i, _ in kept)
    final = [(i, _redacted(t)) for i, t in kept]
    assert any("<EMAIL>" in t for _, t in final)
    padding, total = check_packing(rows, final)
    assert {r["doc_id"] for r in rows} == {i for i, _ in final} and padding <= 0.02 * total


def test_repeated_rows_leave_one(spark, tmp_path):
    rnd = random.Random(9)
    fresh = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(10 ** 5)}" for _ in range(n)]
    a, b, c, d = fresh(60), fresh(70), fresh(80), fresh(90)
    near = [*d[:30], "changed", *d[31:]]
    texts = [(1, a), (1, a), (1, a), (2, b), (2, c), (3, a), (4, d), (4, near), (5, c), (6, fresh(50))]
    docs = [(i, " ".join(w), "en", "src", len(" ".join(w))) for i, w in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    stage = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in stage if r["doc_id"] != 4) == sorted(
        {(i, n) for i, _, _, _, n in docs if i in (1, 2, 6)})
    left = [r["text"] for r in stage if r["doc_id"] == 4]
    assert len(left) == 1 and left[0] in (" ".join(d), " ".join(near))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 4, 6}
    check_packing(rows, [(r["doc_id"], r["text"]) for r in stage if r["doc_id"] != 2])
    empty = spark.createDataFrame([(7, "", "en", "src", 0)] * 2 + [(8, "", "en", "src", 0)], schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, empty, folder).collect()) == [7, 8]


def _passes(t):
    n, _, _, _, repeat, covered, longest = brute_repetition(t)
    return not (n < 10 or 100 * repeat > 20 * n) and covered <= 0.2 * n and longest <= 100


def _redacted(t):
    out, done, end = [], 0, -1
    for kind, x, y in brute_spans(t):  # these texts hold nothing that only the random field finds
        if x >= end:
            out += [t[done:x], f"<{kind.upper()}>"]
        end = max(end, y)
        done = end
    return "".join(out) + t[done:]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "repeated_passages", "personal_data", "pack"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DIR)
        assert after.schema.simpleString() == docs.schema.simpleString()
        before = corpus_pipeline.written(after)
    assert 0 < before.count() < docs.count()
    bad = [r for r in before.collect() if r["n_chars"] != len(r["text"]) or re.search(r"@mail\d", r["text"])]
    assert not bad


def test_stages_bear_odd_rows(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, DIR).collect()
        assert stage(spark, nothing, DIR).count() == 0, name


def test_columns_of_any_name_survive_the_second_stage(spark):
    words = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)]
    rows = [(1, words[0], 777, 1, 5, "a"), (1, words[0], 777, 1, 5, "a"), (2, words[1], 778, 2, 6, "b"), (None, words[2], 779, 3, 7, "c"),
            (None, words[2], 779, 3, 7, "c"), (None, words[1], 780, 4, 8, "d"), (3, words[3], 781, 5, 9, "e")]
    schema = "doc_id long, text string, _row long, number long, least long, row string"
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(3), DIR)
    assert out.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[2]) == [rows[0], rows[2], rows[3], rows[6]]


def test_entry_lists_the_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(q) and set(ORACLE) <= set(o) and "pipeline" in q
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert np.all([k in q for k in o])
    assert P.path("word_bpe_49k.json")
