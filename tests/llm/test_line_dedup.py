import random

import numpy as np
import pytest

from telemill.llm import line_dedup
from tests.llm.cases import frame, nothing, odd  # noqa: F401 (fixtures)

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs, least=10):
    first, holders = {}, {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, i), i)
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and first[key(x)] < i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def mixture(seed, n=120):
    rnd = random.Random(seed)
    lines = [f"Shared Line number {k}" for k in range(12)] + ["short", "", "  ", "éééééééééé", "ééééééééé", "ÀÉÎ ÕÜ àéîõ", "licence of all"]
    docs = []
    for i in range(n):
        own = [rnd.choice(lines) if rnd.random() < 0.5 else f"only here {rnd.random()}" for _ in range(rnd.randrange(0, 9))]
        own = [rnd.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rnd.random() < 0.3 else x) + rnd.choice(["", " \r"]) for x in own]
        docs.append((rnd.randrange(-10 ** 12, 10 ** 12), "\n".join([*own, "the line that all documents hold"])))
    return list({i: (i, t) for i, t in docs}.values()) + [(3, None), (4, "")]


@pytest.mark.parametrize("seed,bits,flush,shard", [(1, 1 << 22, 32_000_000, 1 << 18), (2, 64, 300, 20), (3, 1 << 12, 1, 3)])
def test_against_brute_force(spark, seed, bits, flush, shard):
    """Also with filters so full that nearly everything is suspected, and inputs of one document."""
    docs = mixture(seed)
    got = line_dedup.remove_repeated_lines(frame(spark, docs).repartition(3), flush_bytes=flush, shard_keys=shard, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_filters_leave_out_what_occurs_once(spark):
    docs = frame(spark, [(i, f"line that only document {i} holds\nline of documents {i // 2}") for i in range(2000)]).repartition(4)
    docs = docs.selectExpr("false AS null", "doc_id AS doc", "text")
    n = line_dedup.suspects(docs, 8, flush_bytes=1000).count()
    assert 2000 <= n < 2010
    crowded = line_dedup.suspects(docs, 8, flush_bytes=1000, bits=256).count()
    assert n < crowded <= 4000


def test_filter_knows_all_it_was_given():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = line_dedup.Filter(1 << 16)
    f.add(h)
    assert f.holds(h).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert f.holds(other).mean() < 0.02


def test_odd_rows(spark, odd, nothing):  # noqa: F811
    got = line_dedup.remove_repeated_lines(odd)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    rows = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    fox = "the quick brown fox jumps over the lazy dog again and again"
    by = {r[0]: r[1:] for r in rows}
    assert len(rows) == 10 and [r for r in rows if r[0] == 1] == [(1, 1, 0, fox)] * 2
    assert by[2] == (1, 0, "") and by[3] == (1, 0, "") and by[4] == (2, 0, " \n\t ")
    assert by[8] == (1, 1, "") and by[None] == (1, 0, "a row without an id has a text all the same and it is kept")
    assert by[6] == (1, 0, "x" * 200_000)
    assert line_dedup.remove_repeated_lines(nothing).count() == 0


def test_rows_without_id_take_part(spark):
    docs = frame(spark, [(5, "a line for everyone\nmine"), (None, "a line for everyone\nx"), (None, "a line for those\ny"),
                         (None, "a line for those\nz")])
    got = sorted((tuple(r)[1:] for r in line_dedup.remove_repeated_lines(docs).collect()))
    assert [g[1] for g in got].count(1) == 2
    assert (2, 1, "x") in got and (2, 0, "a line for everyone\nmine") in got
    assert sum(g[2].startswith("a line for those") for g in got) == 1


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "one line of some length", 5, 6, 7), (2, "one line of some length", 5, 6, 7)],
                               "id long, body string, null int, doc int, h1 int")
    got = line_dedup.remove_repeated_lines(df, "id", "body")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0, "one line of some length"), (2, 1, 1, "")]
