"""The salted, shuffled and remembered-too-much paths of the pair operators give the results of the plain ones."""

import random

import numpy as np
import pytest

from riskloom.llm import common, jaccard, linededup, suffixdedup
from tests.llm.test_operators import DOCS, _components, _cut


@pytest.fixture
def forced(monkeypatch):
    """Every bucket is salted, every join is by shuffle, and a task remembers one entry."""
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    for m in (jaccard, suffixdedup):
        monkeypatch.setattr(m, "HOT_MEANS", 0)
        monkeypatch.setattr(m, "HOT_ROWS", 0)
        monkeypatch.setattr(m, "KNOWN", 1)


def _texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocab) for _ in range(60)]
    near = []
    for _ in range(30):
        b = base[:]
        for _ in range(rng.randrange(4)):
            b[rng.randrange(60)] = rng.choice(vocab)
        near.append(" ".join(b))
    passage = " ".join(rng.choice(vocab) for _ in range(45))
    mixed = [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice([6, 12, 20]))) for _ in range(20)]
    return near + mixed + [near[0]] * 40 + [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(10)] + [None, "", "a b"]


def test_jaccard(spark, forced):
    rows = list(enumerate(_texts(5)))
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(spark, spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == _components(rows)


def test_suffix(spark, forced, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", 2)
    rows = list(enumerate(_texts(6)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.cut_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert [got[i] for i in range(len(rows))] == _cut([(t or "").encode() for _, t in rows])


def test_rows_of_one_doc_id_are_cut_apart(spark):
    body = "".join(chr(97 + (i * i) % 26) for i in range(260))
    rows = [(1, "p" * 30 + body), (1, body + "q" * 40), (1, body + "q" * 40), (2, "short")]
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffixdedup.cut_repeats(spark, spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted((a, b) for a, b, *_ in _cut([t.encode() for _, t in rows]))
    named = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS + ", rid long, sha string, n_bytes long")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in suffixdedup.cut_repeats(spark, named).collect()) == got


def test_lines(spark, forced):
    rows = [(i, "\n".join(f"line {(i * j) % 5}" for j in range(i % 9))) for i in range(60)] + [(100 + i, "\n\n\n\n") for i in range(3)]
    plain = sorted(map(str, linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()))
    seen, want = {}, {}
    for d, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[i : i + 3]), (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        want[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(4)).collect()} == want
    assert len(plain) == len(rows)


def test_anchors_do_not_depend_on_what_stands_around():
    """Copies of a string in groups of unlike size choose the same anchor, ties among equal q-grams included."""
    from riskloom.llm.textops import prefix_hash

    rng = np.random.default_rng(3)
    for one in (rng.integers(97, 123, 300, dtype=np.uint8), np.tile(np.frombuffer(b"abc", np.uint8), 100), np.full(300, 120, np.uint8)):
        found = []
        for before in (0, 5, 70_001, 1_500_000):
            data = np.concatenate([rng.integers(97, 123, before, dtype=np.uint8), one])
            offs = np.array([0, before, before + 300])
            pos, doc, lo, hi = suffixdedup.anchors(data, offs, prefix_hash(data))
            own = doc == 1
            found.append([(p - before, a - before, z - before) for p, a, z in zip(pos[own].tolist(), lo[own].tolist(), hi[own].tolist())])
        assert found[0] and all(f == found[0] for f in found)


def test_keep_one_each_by_id(spark):
    rows = [(1, "a b c d e f"), (1, "quite another text of one id"), (2, "A b  c d e f"), (3, "q"), (3, "r"), (None, "q"), (4, None), (5, "q")]
    kept = sorted(map(tuple, jaccard.keep_one_each(spark, spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert kept == sorted([r for r in rows if r[0] not in (2, 5)], key=str)


def test_jaccard_asks_little_of_the_driver(spark, monkeypatch):
    """Rows are counted as they are written, by no job of their own, and documents that are their own component are never broadcast."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = random.Random(9)
    alone = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    rows = list(enumerate(alone + _texts(5)))
    docs, sent = spark.createDataFrame(rows, DOCS), []

    def job(self, *args):
        raise AssertionError("a job that only counts")

    def light(df, n, most=None, f=common.light):
        sent.append(n)
        return f(df, n, most)

    with monkeypatch.context() as m:
        for name in ("count", "first", "head", "isEmpty"):
            m.setattr(DataFrame, name, job)
        for module in (common, jaccard):
            m.setattr(module, "light", light)
        out = jaccard.link_components(spark, docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == _components(rows)
    assert sent and max(sent) < 300
