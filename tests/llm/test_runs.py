"""Periodic runs: brute force over random words, the query's digests by plain loops, odd rows."""

import fractions
import hashlib
import random
import re
import zlib

from riskloom.llm import runs


def brute(s, exponent=4, least=6):
    """Every maximal stretch of every period, by comparing words; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    found = [(a, z - a, q) for (a, z), q in out.items() if z - a >= exponent * q and z - a >= least]
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    t = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 11)
        t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
    return t


def test_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = [periodic(rng, rng.randrange(70), rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(1, 7))]
        for exponent, least in ((4, 6), (2, 2)):
            got = runs.runs_of(texts, exponent, least)
            assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(t, exponent, least) for t in texts]


def test_slices(monkeypatch):
    """Leaves traversed a few at a time give the same."""
    rng = random.Random(2)
    texts = [periodic(rng, 300, 2) for _ in range(10)]
    whole = [g.tolist() for g in runs.runs_of(texts)]
    monkeypatch.setattr(runs, "SLICE", 7)
    assert [g.tolist() for g in runs.runs_of(texts)] == whole


def test_very_periodic():
    (got,) = runs.runs_of([[b"x"] * 200_000])
    assert got.tolist() == [[0, 200_000, 1]]
    a, b = [b"a"], [b"b"]
    for _ in range(24):  # Fibonacci words: very many repeats, runs below four periods
        a, b = a + b, a
    (got,) = runs.runs_of([a[:30_000]], 2, 2)
    assert len(got) > 10_000 and (got[:, 1] < 4 * got[:, 2]).all()


def expected(doc_id, text):
    """The query's row by the definition alone."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], digest(lines), digest(kept))


def test_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(150)]
    texts += [None, "", " \t\n", "           ", "é 漢字 " * 40, "one", "A a " * 9 + "  x" * 9, "x\x0by\x0cz " * 30]
    rows = [(i, t, "s", i, "c") for i, t in enumerate(texts)] + [(3, texts[3], "s", 0, "c"), (3, "other a a a a a a", "s", 0, "c"), (None, "b " * 12, "s", 0, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, Runs2 int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op11_periodic_runs(spark, str(tmp_path)).collect()
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r["doc_id"], *(r[c] for c in columns)) for r in got], key=key) == sorted([(d, *expected(d, t)) for d, t, *_ in rows], key=key)
    assert [t for _, t in runs.op11_periodic_runs(spark, str(tmp_path)).dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_operator(spark):
    df = spark.createDataFrame([(1, "k " * 8 + "z", "mine", 5), (2, None, None, None)], "doc_id long, text string, runs string, c0 int")
    got = runs.periodic_runs(df).orderBy("doc_id").collect()
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 8, 1)] and got[0]["collapsed"] == "k z" and got[0]["c0"] == 5
    assert got[1]["runs"] == [] and got[1]["collapsed"] == ""
    assert runs.periodic_runs(df.limit(0)).count() == 0
