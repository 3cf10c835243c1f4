import math
import random

import duckdb
import numpy as np
import pytest

from telemill.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int"


def brute(rows, every=50, n_pos=5, n_neg=3):
    """By definition, over plain Python numbers."""
    good = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), k, other) for k, other, w in good if k != i]
        positives = sorted((s, k) for s, k, other in scores if other == label)[:n_pos]
        for ps, pid in positives:
            fit = sorted((s, k) for s, k, other in scores if other != label and 50 * -ps <= 100 * -s <= 95 * -ps)
            out += [(i, pid, r + 1, k, -ps, -s) for r, (s, k) in enumerate(fit[:n_neg])]
    return sorted(out)


def vectors(seed, n=600, dims=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dims))
    rows = []
    for i in range(n):
        c = int(rnd.integers(12))
        v = centres[c] + rnd.normal(size=dims) * rnd.choice([0.0, 0.02, 0.5])
        rows.append((i * 5, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int((c + (rnd.random() < 0.3)) % 4)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def result(df, **kw):
    return sorted(tuple(r) for r in hn.hard_negatives(hn.labelled_vectors(df), **kw).collect())


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"group": 7, "cell_anchors": 20}), (3, {"group": 1}), (4, {"cell_rows": 40})])
def test_against_brute_force(spark, seed, kw):
    rows = vectors(seed)
    assert result(frame(spark, rows).repartition(4), **kw) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(5, 200)
    rows += [(None, [1.0] * 12, 1), (7, None, 1), (50, [1.0] * 12, None), (3, [nan] * 12, 2), (4, [inf] * 12, 2), (6, [None] * 12, 2),
             (8, [], 3), (9, [0.5], 2), (100, [], 1), rows[0], rows[10], rows[20], (rows[20][0], rows[21][1], 2)]
    want = brute([(i, v + [0.0] * (12 - len(v)) if v is not None else v, label) for i, v, label in rows])
    assert result(frame(spark, rows)) == want and want
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(50, [1.0, 0.0], 1)])) == []


def test_very_large_components(spark):
    rnd = random.Random(3)
    rows = [(i * 10, [float(np.float32(rnd.choice([1, 1e4, 1e6]) * rnd.gauss(0, 1))) for _ in range(5)], i % 2) for i in range(60)]
    assert result(frame(spark, rows)) == brute(rows)


def test_trees_and_bounds_leave_rows_out(monkeypatch):
    rnd = np.random.default_rng(8)
    centres = rnd.integers(-100, 100, (4, 16))
    x = np.repeat(centres, 16, axis=0) + rnd.integers(-1, 2, (64, 16))
    order, parent, edge = hn.spanning_tree(x)
    assert sorted(order) == list(range(64)) and parent[0] == -1 and all(parent[k] < k for k in range(1, 64))
    assert all(abs(np.linalg.norm(x[order[k]] - x[order[parent[k]]]) - edge[k]) < 1e-9 for k in range(1, 64))
    assert (edge > 50).sum() == 3  # one edge between groups of neighbours
    tree = hn.Tree(0, list(range(64)), [0] * 64, parent, edge, 16, x[order].astype("<i8").tobytes(),
                   [[[hn._I64.min, hn._I64.max, 5, []]] for _ in range(64)])
    rows = np.repeat(rnd.integers(-100, 100, (50, 16)), 200, axis=0) + rnd.integers(-1, 2, (10_000, 16))
    for at in range(0, 10_000, 1000):
        y = rows[at:at + 1000]
        tree.block(y, y.astype(float), np.arange(100 + at, 100 + at + 1000), np.zeros(1000, int),
                   np.sqrt((y.astype(float) ** 2).sum(axis=1)), True)
    scores = rows @ x[order].T
    for k in range(64):
        best = sorted(((-s, i + 100) for i, s in enumerate(scores[:, k].tolist())))[:5]
        assert [(-s, i) for s, i in tree.wanted[k][0][3]] == best
    assert tree.scored < 0.35 * 64 * len(rows)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duck.sql(hn.ORACLE_SQL).fetchall()
    assert sorted(tuple(r) for r in hn.op11_anchor_tree_negatives(spark, sf).collect()) == sorted(want) and len(want) > 50
