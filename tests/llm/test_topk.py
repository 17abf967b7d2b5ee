"""Exact top-k: brute force, repeated and invalid rows, large components, many partitions and batches."""

import numpy as np

from riskloom.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, is_query):
    """Plain loops over distinct valid rows."""
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (i, tuple(v)) not in good:
            good.append((i, tuple(v)))
    out = {}
    for i, v in good:
        if is_query(i):
            for c, w in good:
                if c != i:
                    s = sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(v, w))
                    out.setdefault(i, []).append((max(-(2**63), min(2**63 - 1, s)), c))
    ranked = {}
    for q, scores in out.items():
        ranked[q] = [(n + 1, c, s) for n, (s, c) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return ranked


def run(df, k, query="vec_id % 20 = 0", **kw):
    got = {}
    for r in topk.exact_top_k(df, query, k=k, **kw).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16).round(1)]) for i in range(150)]
    rows += [(200, None), (201, [float("nan")] * 16), (202, [None] + [1.0] * 15), (203, []), (40, rows[40][1]), (204, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5, lambda i: i % 20 == 0)
    assert run(df.repartition(3), 5) == want
    assert run(df.repartition(211), 5) == want  # most tasks have a row or none
    assert run(df.repartition(3), 5, query_bytes=3 * 8 * 16) == want  # several batches
    assert run(df.repartition(2), 5, lists=16) == run(df.repartition(2), 5, lists=1) == want


def test_unlike_vectors_of_one_id(spark):
    rows = [(1, [None, 1.0]), (1, [1.0, 2.0]), (20, [1.0, 1.0]), (20, [2.0, -1.0]), (20, [1.0, 1.0]), (3, [3.0, 0.5]), (3, [0.0, 9.0]), (4, [1.0]), (5, [1.0, 0.0, 5.0])]
    assert run(spark.createDataFrame(rows, SCHEMA), 20) == brute([(i, (v + [0.0] * 3)[:3] if None not in v else v) for i, v in rows], 20, lambda i: i % 20 == 0)


def test_large_components(spark):
    rows = [(0, [1.0e8, 1.0]), (1, [2.0, 1.0]), (2, [-1.0e8, 3.0]), (3, [1.0e8, 1.0e8]), (4, [3.0e8, 7.0]), (5, [float("inf"), 1.0]), (6, [2.0, 1.0])]
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(2), 4, "vec_id < 2")
    assert got == brute(rows, 4, lambda i: i < 2)
    assert got[1][0] == (1, 4, 128 * 64 * 300_000_000 + 64 * 7 * 64)


def test_empty_and_few(spark):
    assert run(spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA), 5, "vec_id = 0") == {0: [(1, 1, 64 * 128)]}
    assert run(spark.createDataFrame([], SCHEMA), 5) == {}
    assert run(spark.createDataFrame([(1, [1.0])], SCHEMA), 5) == {}
    assert run(spark.createDataFrame([(0, []), (1, []), (2, [1.0])], SCHEMA), 5, "vec_id < 2") == {0: [(1, 1, 0), (2, 2, 0)], 1: [(1, 0, 0), (2, 2, 0)]}
    assert run(spark.createDataFrame([(0, []), (1, [])], SCHEMA), 5, "vec_id = 0") == {0: [(1, 1, 0)]}
    named = spark.createDataFrame([(0, [1.0], "a", 3), (1, [2.0], "b", 4)], SCHEMA + ", q string, rank int")
    assert run(named, 5, "vec_id = 0") == {0: [(1, 1, 64 * 128)]}


def test_phases_prune():
    """Phase 1 adds up heads alone, phase 3 few of all pairs, and what they find is exact."""
    rng = np.random.default_rng(4)
    q, c = np.floor(rng.normal(0, 20, (30, 32))), np.floor(rng.normal(0, 20, (3000, 32)))
    q[:, :8] *= 4  # lists of unlike weight
    qid, cid = np.arange(30) + 10_000, np.arange(3000)
    first = topk.Block(qid, q, 10, 4, None)
    for a in range(0, 3000, 500):
        first.add(cid[a : a + 500], c[a : a + 500])
    rows, score, _ = first.found()[:3]
    tau = np.array([score[rows == r].min() for r in range(30)])
    last = topk.Block(qid, q, 10, 4, tau)
    for a in range(0, 3000, 500):
        last.add(cid[a : a + 500], c[a : a + 500])
    rows, score, vec = last.found()[:3]
    whole = q @ c.T
    for r in range(30):
        order = np.lexsort((cid, -whole[r]))[:10]
        assert vec[rows == r].tolist() == order.tolist() and score[rows == r].tolist() == whole[r, order].tolist()
    assert first.resolved <= 6 * 30 * 4 * 11 and last.resolved < whole.size / 2
