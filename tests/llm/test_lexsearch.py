"""Ranked lexical search: brute force, SQL, ties across shards, blocks of queries, odd rows."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest

from riskloom.llm import lexsearch

SF = "/root/testdata/sf0.01"


def terms(text):
    out = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in out]


def brute(docs, queries, k):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, ts) for d, ts in bags if ts]
    n, total = len(bags), sum(len(ts) for _, ts in bags)
    df = collections.Counter(x for _, ts in bags for x in set(ts))
    out = []
    for item, text in queries:
        scores = []
        for d, ts in bags:
            m = 50 + (50 * len(ts) * n) // total
            own = collections.Counter(ts)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * own[x]) // (1000 * own[x] + 20 * m)) for x in set(terms(text)) if own[x])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def tables(spark, docs, queries):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, term string")
    return d, spark.createDataFrame([(i, t, 2) for i, t in queries], "item_id long, text string, rank int")


def test_brute_force(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "g1", "Δelta", "漢字", "e_f", "x", "İ", "\U0001f600", "z"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(120)]
    docs += [(200 + i, "alpha beta same") for i in range(40)] + [(500, None), (501, ""), (502, " ,;"), (503, "alpha " * 5000), (None, "beta beta"), (None, "alpha beta same")]
    queries = [(1, "ALPHA alpha beta"), (2, "漢字 Δelta δelta"), (3, None), (4, ""), (5, "unknown"), (6, "x-z.e_f G1"), (7, "i̇ İ"), (8, "\U0001f600")]
    want = brute(docs, queries, 7)
    d, q = tables(spark, docs, queries)
    assert rows(lexsearch.rank_documents(d.repartition(3), q, k=7)) == want
    assert rows(lexsearch.rank_documents(d.repartition(5), q, k=7, shard_docs=4)) == want
    assert rows(lexsearch.rank_documents(d, q, k=7, max_terms=5)) == want  # blocks of a query or two
    assert rows(lexsearch.rank_documents(d, q, k=7, max_queries=3)) == want
    assert rows(lexsearch.rank_documents(d, q, k=1000)) == brute(docs, queries, 1000)


def test_empty(spark):
    d, q = tables(spark, [(1, "a")], [(1, "a")])
    for docs, queries in ((d.limit(0), q), (d, q.limit(0)), (d.where("false"), q.where("false"))):
        out = lexsearch.rank_documents(docs, queries)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    d, q = tables(spark, [(1, " "), (2, None)], [(1, "a")])
    assert lexsearch.rank_documents(d, q).count() == 0
    d, q = tables(spark, [(1, "a b"), (1, "a b"), (2, "c")], [(1, "a"), (1, "a")])
    assert [r[:3] for r in rows(lexsearch.rank_documents(d, q))] == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1)]


def test_ties_are_kept():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 50), rng.permutation(50)
        got = lexsearch.best(scores, ids, 6)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > 0)[:6]
        assert [(-scores[g], ids[g]) for g in got] == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(lexsearch.op13_lexical_search(spark, SF)) == sorted(con.sql(lexsearch.OP13_SQL).fetchall())
