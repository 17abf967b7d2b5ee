"""Source mixing: the block permutations row for row, bisection, clashing names, both kinds of joins."""

import collections
import math

import pytest

from riskloom.llm import mixing

COLUMNS = "doc_id long, text string, source string"


def _rows():
    rows = [(i, "w " * (10 + i % 7), "big") for i in range(300)] + [(1000 + i, "w " * 12, "mid") for i in range(60)] + [(2000 + i, "w " * 9, None) for i in range(20)]
    return rows + [(3000, None, "none"), (3001, "", "big"), (7, "w " * 17, "big")] + [(2000, "w " * 9, None)] * 4


def _realised(spark, rows, weights, spend, seed=17):
    """{(doc_id, text, source): list of (epoch, block, key)}: plain loops over sources, passes, blocks and keys."""
    # only the hash itself is the engine's
    frame = spark.createDataFrame(list(dict.fromkeys(rows)), COLUMNS).crossJoin(spark.range(12).withColumnRenamed("id", "epoch"))
    frame = frame.selectExpr("*", f"xxhash64({seed}, epoch, xxhash64(doc_id, text)) as k").selectExpr("*", "xxhash64(k) as kk")
    keys = {((r["doc_id"], r["text"], r["source"]), r["epoch"]): (r["k"], r["kk"]) for r in frame.collect()}
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    docs = collections.Counter(s for _, _, s in rows)
    out = collections.defaultdict(list)
    for s in docs:
        blocks = max(1, -(-docs[s] // mixing.BLOCK_DOCS))
        goal = weights.get(s, 0) * spend
        passes = int(math.floor(goal / tokens[s] + 1e-9)) if tokens[s] else 1
        for epoch in range(passes + 1):
            dealt = collections.defaultdict(list)
            for r in rows:
                if r[2] == s:
                    k, kk = keys[r, epoch]
                    dealt[kk % blocks].append((k, r))
            left = goal - passes * tokens[s]
            for b in sorted(dealt):
                for k in sorted({k for k, _ in dealt[b]}):
                    same = [r for kk, r in dealt[b] if kk == k]
                    n = sum(len((r[1] or "").split()) for r in same)
                    take = epoch == 0 if not n else epoch < passes or left > 0
                    if epoch == passes and tokens[s]:
                        left -= n
                    if take:
                        out[same[0]] += [(epoch, b, k)] * len(same)
    return out


@pytest.mark.parametrize("block,run,most", [(1024, 1024, 20_000), (16, 4, 20_000), (16, 2, 0)])
def test_block_permutations_row_for_row(spark, monkeypatch, block, run, most):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    monkeypatch.setattr(mixing, "RUN_BLOCKS", run)
    rows = _rows()
    out = mixing.mix_sources(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), target_entropy=0.95, budget=1500.0, max_broadcast=most).collect()
    weights = {r["source"]: r["mix_weight"] for r in out}
    assert abs(sum(weights.values()) - 1) < 1e-9
    want = _realised(spark, rows, weights, 1500.0)
    got = collections.defaultdict(list)
    for r in out:
        got[(r["doc_id"], r["text"], r["source"])].append((r["mix_epoch"], r["mix_block"], r["mix_key"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_bisection(spark):
    stats = [("a", 900), ("b", 90), ("c", 10)]
    df = spark.createDataFrame(stats, "source string, tokens long")
    for share in (0.6, 0.9, 0.99):
        a = mixing.find_exponent(df, target_entropy=share)
        p = [(n / 1000) ** a for _, n in stats]
        p = [x / sum(p) for x in p]
        assert abs(-sum(x * math.log(x) for x in p) / math.log(3) - share) < 1e-6
    a = mixing.find_exponent(df, max_repeat=3.0)
    assert abs(90 ** (1 - a) - 3) < 1e-6


def test_clashing_names(spark):
    names = ["rk", "blocks", "passes", "rest", "cut_block", "cut_key", "left", "k", "n", "id", "run", "before", "weight", "tokens", "block", "goal", "mix_key", "__mix_id"]
    rows = [(i, "w " * 5, f"s{i % 2}", *[100 + i + j for j in range(len(names))]) for i in range(6)]
    out = mixing.mix_sources(spark, spark.createDataFrame(rows, COLUMNS + "".join(f", `{n}` long" for n in names)), max_repeat=2.0)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 6 and "__mix_id" not in out.columns and all(out.columns.count(n) == 1 for n in names[:-1])
    assert all(got[r[0]][n] == r[3 + j] for r in rows for j, n in enumerate(names[:-2]))
