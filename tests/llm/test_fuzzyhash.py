"""Fuzzy fingerprints: the definition in plain Python, edit distances by the table, successors, odd rows."""

import hashlib
import random

import numpy as np

from riskloom.llm import fuzzyhash as fz
from riskloom.llm.textops import BYTE_CODES, mix


def plain_hash(b: bytes) -> int:
    """The hash of a span by its definition: codes times powers of the base, length mixed in."""
    base, total = 0x9E3779B97F4A7C15 | 1, 0
    for i, x in enumerate(b):
        total += int(BYTE_CODES[x]) * pow(base, i, 2**64)
    return int(mix(np.array([(total + len(b) * 0xD6E8FEB86659FD93) % 2**64], np.uint64))[0])


def plain_fingerprint(text: str | None) -> str:
    b = (text or "").encode()

    def signature(level):
        out, start = "", 0
        for end in range(1, len(b) + 1):
            h = plain_hash(b[max(0, end - fz.WINDOW) : end])
            if end == len(b) or h % (1 << level) == 0:
                out += fz.ALPHABET[plain_hash(b[start:end]) >> 58]
                start = end
        return out

    level = fz.LOWEST
    while len(signature(level)) > fz.SIGNATURE:
        level += 1
    return f"{level}:{signature(level)}:{signature(level + 1)}"


def plain_likeness(f: str, g: str) -> float:
    if f == g:
        return 1.0
    (k, *a), (m, *b) = f.split(":"), g.split(":")
    shared = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if int(k) + i == int(m) + j]
    if not shared:
        return 0.0
    x, y = shared[0]
    if x == y:
        return 1.0
    d = {(i, 0): i for i in range(len(x) + 1)} | {(0, j): j for j in range(len(y) + 1)}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i, j] = d[i - 1, j - 1] if x[i - 1] == y[j - 1] else 1 + min(d[i - 1, j], d[i, j - 1])
    need = min(fz.RUN, max(1, -(-max(len(x), len(y)) // 4)))
    met = any(x[i : i + need] in y for i in range(len(x) - need + 1))
    return 1 - d[len(x), len(y)] / (len(x) + len(y)) if met else 0.0


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnlé漢") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_definition(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 2, 5, 20, 60, 150)] + ["", None, "x", "aaaa" * 300, "ab " * 200, "\U0001f600" * 50]
    want = [plain_fingerprint(t) for t in texts]
    assert fz.fingerprints(texts) == want
    monkeypatch.setattr("riskloom.llm.textops.CHUNK_BYTES", 100)  # groups of texts don't matter
    assert fz.fingerprints(texts) == want


def test_likeness():
    rng = random.Random(2)
    base = [prose(rng, n) for n in (3, 8, 30, 80, 200, 400)]
    texts = base + [t[: len(t) // 2] + prose(rng, 20) for t in base] + [t + " x" for t in base] + [t * 2 for t in base] + ["", "a"]
    prints = fz.fingerprints(texts)
    a, b = [f for f in prints for _ in prints], prints * len(prints)
    got = fz.likeness(a, b)
    assert np.allclose(got, [plain_likeness(f, g) for f, g in zip(a, b, strict=True)])
    assert got.min() >= 0 and got.max() == 1


def test_edits_stay_near_and_others_do_not():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(100, 3000)) for _ in range(200)]
    own = fz.fingerprints(texts)
    small = fz.fingerprints([t[:300] + "inserted" + t[310:] for t in texts])
    half = fz.fingerprints([fz.edited(t, u) for t, u in zip(texts, texts[1:] + texts[:1], strict=True)])
    assert np.mean(fz.likeness(own, small) > 0.8) == 1
    assert np.mean(fz.likeness(own, half) > 0.3) > 0.97
    assert fz.likeness(own, own[1:] + own[:1]).max() == 0
    assert all(len(s) <= fz.SIGNATURE for f in own for s in f.split(":")[1:])


def expected(rows):
    """The query's rows by the definition, documents by doc_id and text, nulls last."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (d, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        f, g, h = plain_fingerprint(t), plain_fingerprint(new), plain_fingerprint(u)
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), f, g, round(plain_likeness(f, g), 9), round(plain_likeness(f, h), 9)))
    return out


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(-50, 10**12), prose(rng, rng.randrange(25))) for _ in range(60)]
    rows += [(7, "same"), (7, "same"), (7, None), (8, ""), (None, "no id"), (None, "nor this"), (9, rows[0][1]), (10, prose(rng, 300))]
    for k, some in enumerate((rows, rows[:1], [])):
        spark.createDataFrame([(d, t, "p", 1) for d, t in some], "doc_id long, text string, part string, lent int").repartition(3).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = fz.op12_fuzzy_fingerprint(spark, f"{tmp_path}/{k}").collect()
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(got, key=key) == sorted(expected(some), key=key)


def test_few_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i, str(i)) for i in range(40)] + [(5, "5")], "doc_id long, text string")
    monkeypatch.setattr("riskloom.llm.common.BATCH_ROWS", 3)
    for parts in (1, 2, 100):
        rows = fz.in_order(docs, parts).collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows if not r["lent"]) == sorted([(i, str(i)) for i in range(40)] + [(5, "5")])
        lent = {r["part"]: r["doc_id"] for r in rows if r["lent"]}
        last = {p: max(r["doc_id"] for r in rows if r["part"] == p and not r["lent"]) for p in lent}
        assert all(lent[p] == (last[p] + 1) % 40 for p in lent)


def test_column(spark):
    df = spark.createDataFrame([("a b c", 1), (None, 2), ("a b c", 3)], "body string, fingerprint int")
    got = [r["fingerprint"] for r in fz.fingerprint_texts(df, "body").collect()]
    assert got == [plain_fingerprint("a b c"), plain_fingerprint(""), plain_fingerprint("a b c")]
    assert fz.fingerprint_texts(df.limit(0), "body").count() == 0
