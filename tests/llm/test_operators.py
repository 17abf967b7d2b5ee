"""Every operator against brute force on small tables, with the edge cases."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import common, jaccard, linededup, media, mixing, packing, pii, quality, suffixdedup, toxicity, webp

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "a"), (4, "x " * 30_000), (5, "same text"), (5, "same text"), (6, "é 漢字 \U0001f600"), (None, "no id")]


def odd(spark):
    """Nulls, empties, a very long text, repeated rows and extra columns with names the operators use themselves."""
    return spark.createDataFrame([(d, t, "s1", 7, 1.0, "m") for d, t in ODD], DOCS + ", source string, n_removed int, quality_score double, pos string")


def empty(spark):
    return spark.createDataFrame([], DOCS + ", source string")


# ---------------------------------------------------------------- shared


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 330)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in common.connected_components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert got == want
    assert common.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 quality, 6 toxicity


def _labelled(spark, n=400):
    rng = random.Random(1)
    words = ["the", "river", "went", "quiet", "under", "stone", "and", "light"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(40))
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " you " + rng.choice(["idiot", "idiots", "moron"])
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = _labelled(spark)
    model = quality.train_quality(spark, docs, labels)
    out = quality.score_quality(spark, docs.withColumn("quality_score", docs.doc_id), model).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and np.mean([(r["quality_score"] >= 0.3) == (r["quality"] == 1) for r in held]) > 0.95
    got = quality.score_quality(spark, odd(spark), model)
    assert got.columns[-1] == "quality_score" and got.columns.count("quality_score") == 1
    scores = [r["quality_score"] for r in got.collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[4] == scores[5]
    assert quality.score_quality(spark, empty(spark), model).count() == 0


def test_quality_without_labels(spark):
    docs, labels = _labelled(spark, 20)
    model = quality.train_quality(spark, docs, labels.where("false"))
    assert {r["quality_score"] for r in quality.score_quality(spark, docs, model).collect()} == {0.5}


def test_toxicity_held_out_and_misspelt(spark):
    docs, labels = _labelled(spark)
    model = toxicity.train_toxicity(spark, docs, labels)
    out = toxicity.score_toxicity(spark, docs, model).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["toxicity_score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.95
    odd_scores = [r["toxicity_score"] for r in toxicity.score_toxicity(spark, odd(spark), model).collect()]
    assert len(odd_scores) == len(ODD) and odd_scores[0] == odd_scores[1] <= min(odd_scores)
    pair = spark.createDataFrame([(1, "the quiet river idiottt and stone"), (2, "the quiet river lantern and stone")], DOCS)
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score_toxicity(spark, pair, model).collect()}
    assert got[1] > got[2]


def test_toxicity_learns_from_long_texts(spark):
    docs, labels = _labelled(spark, 60)
    long = docs.selectExpr("doc_id", "concat(text, ' ', repeat('calm water runs over pale stone ', 500)) as text")
    model = toxicity.train_toxicity(spark, long, labels)
    assert long.selectExpr("min(length(text))").first()[0] > 15_000 and model.constant is None
    assert (toxicity.MAX_TRAIN, toxicity.MAX_BYTES, toxicity.EPOCHS) == (6_000, 32_000_000, 120)


# ---------------------------------------------------------------- 2 PII

KEY = "a key of the tests"


def _feistel(kind, a, b, size_a, size_b, key=KEY):
    for i in range(pii.ROUNDS):
        other = b if i % 2 == 0 else a
        noise = int(hashlib.sha256("|".join(map(str, (key, kind, i, other, size_a, size_b))).encode()).hexdigest()[:14], 16)
        a, b = ((a + noise) % size_a, b) if i % 2 == 0 else (a, (b + noise) % size_b)
    return a, b


def _luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    card, other = "4111111111111111", "5500005555555559"
    texts = [f"pay {card} or 4111-1111-1111-1111", f"x {other}.", "call +1 (974) 555-3436 or (974) 555-3436", "ip 129.38.82.176 not 999.1.1.1", "ssn 123-45-6789 not 000-12-3456",
             "on 2021-03-04, 04.03.2021 and 03/04/2021; never 2021-02-30", "IBAN GB82 WEST 1234 5698 7654 32.", 'token = "f3ef4d6b2755a3d9aab78aa99cbd7049"', "mail a.b@mail3.example.com!", "number 1234567890123456 stays"]
    out = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), DOCS), KEY).orderBy("doc_id").collect()]
    a, b = re.match(r"pay (\d{16}) or ([\d-]{19})$", out[0]).groups()
    assert a == b.replace("-", "") != card and _luhn(a)
    body = _feistel("card", int(card[:7]), int(card[7:15]), 10**7, 10**8)
    assert a[:15] == f"{body[0]:07d}{body[1]:08d}"
    assert _luhn(re.search(r"\d{16}", out[1])[0]) and other not in out[1]
    p, q = re.match(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})$", out[2]).groups()
    assert p == q != "(974) 555-3436"
    assert re.match(r"ip (\d+\.){3}\d+ not 999\.1\.1\.1$", out[3]) and "129.38.82.176" not in out[3]
    assert re.match(r"ssn \d{3}-\d{2}-\d{4} not 000-12-3456$", out[4]) and "123-45-6789" not in out[4]
    y, m, d = re.match(r"on (\d{4})-(\d\d)-(\d\d), ", out[5]).groups()
    assert out[5] == f"on {y}-{m}-{d}, {d}.{m}.{y} and {m}/{d}/{y}; never 2021-02-30"
    iban = re.sub(" ", "", re.match(r"IBAN ([A-Z0-9 ]+)\.$", out[6])[1])
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "GB82WEST12345698765432"
    assert re.match(r'token = "[0-9a-f]{32}"$', out[7]) and "f3ef" not in out[7]
    assert "a.b@" not in out[8] and out[8].endswith("!") and out[9] == texts[9]


def test_pii_is_a_permutation(spark):
    rows = [(i, f"{i:03d}-{g:02d}-0007") for i in range(1, 60) for g in (1, 50, 99)]
    out = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(rows, DOCS), KEY).collect()]
    assert len(set(out)) == len(rows) and not any(re.match(r"000|666|9|\d{3}-00|\d{6}-0000", x) for x in out)


def test_pii_phones_outside_the_plan(spark):
    rows = [(i, f"+1 ({a:03d}) {e:03d}-{n:04d}") for i, (a, e, n) in enumerate((a, e, n) for a in (0, 17, 132, 199, 200, 974) for e in (0, 150, 199, 200, 555, 999) for n in (0, 1352, 9999))]
    out = pii.pseudonymize(spark.createDataFrame(rows + [(1000, "(017) 555-1352 or 017-555-1352 or +10175551352")], DOCS), KEY).orderBy("doc_id").collect()
    new = [r["text"] for r in out[:-1]]
    assert len(set(new)) == len(rows) and all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x) for x in new)
    assert all(a != b and (a[4] > "1" and a[9] > "1") == (b[4] > "1" and b[9] > "1") for a, (_, b) in zip(new, rows, strict=True))
    same = [re.sub(r"\D", "", x)[-10:] for x in out[-1]["text"].split(" or ")]
    assert same == [re.sub(r"\D", "", new[rows.index(next(r for r in rows if r[1] == "+1 (017) 555-1352"))])[1:]] * 3 and out[-1]["pii_kinds"] == {"phone": 3}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_pii_misses_no_phone_of_the_tables(spark, sf):
    phone = re.compile(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![\w])")
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").where("text rlike '[+]1 [(][0-9]{3}[)]'")
    old = {r["doc_id"]: phone.findall(r["text"]) for r in docs.collect()}
    out = {r["doc_id"]: r for r in pii.pseudonymize(docs, KEY).collect()}
    missed = [x for i, xs in old.items() for x in xs if x in out[i]["text"]]
    assert sum(map(len, old.values())) > 0 and missed == []
    assert all(out[i]["pii_kinds"].get("phone", 0) >= len(xs) for i, xs in old.items())


def test_pii_phone_beside_other_numbers(spark):
    texts = ["+1 (826) 555-4081 190.137.223.204", "+49 30 1234567 190.137.223.204", "+49 30 1234567 2021-03-04", "+49 30 123456 4111 1111 1111 1111"]
    out = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), DOCS), KEY).orderBy("doc_id").collect()
    assert [r["pii_kinds"] for r in out[:3]] == [{"phone": 1, "ip": 1}, {"phone": 1, "ip": 1}, {"phone": 1, "date": 1}]
    assert not any(w in r["text"] for r, t in zip(out, texts, strict=True) for w in ("(826) 555-4081", "30 1234567", "30 123456", "190.137.223.204", "2021-03-04") if w in t)


def test_pii_values_inside_longer_matches(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    cases = [
        (f"{card} 12/26", card, {"card": 1}), ("4111111111111111 123", "4111111111111111", {"card": 1}), (f"12 {card}", card, {"card": 1}), (f"2024 {card} 99 7", card, {"card": 1}),
        (f"{card} 5500 0055 5555 5559", "5500 0055 5555 5559", {"card": 2}), (f"{card} 123-45-6789", "123-45-6789", {"card": 1, "ssn": 1}), (f"{card} 10.20.30.40", "10.20.30.40", {"card": 1, "ip": 1}),
        (f"{card} 12/26/2024", "12/26/2024", {"card": 1, "date": 1}), (f"{card} 3rd 5-x", card, {"card": 1}), ("3782-822463-10005 1 2", "3782-822463-10005", {"card": 1}), ("1 " * 3000 + card, card, None),
        (f"{iban} EUR", iban, {"iban": 1}), (f"{iban} GB82 WEST 1234 5698 7654 32 AND", "GB82 WEST 1234 5698 7654 32", {"iban": 2}), (f"{iban} {card}", card, {"iban": 1, "card": 1}),
        ('token = "ABCDEF0123456789ABCDEF0123456789"', "ABCDEF0123456789", {"secret": 1}), ("key: '12345678901234567890'", "1234567890123456", {"secret": 1}), ('secret="AB12CDEF12345678"', "AB12CDEF12345678", {"secret": 1}),
        ("ABCDEF0123456789ABCDEF0123456789", None, {}), ("12345678901234567890", None, {}), ("1111 1111 1111 1111 12", None, {}),
    ]
    out = pii.pseudonymize(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], DOCS), KEY).orderBy("doc_id").collect()
    for r, (text, gone, kinds) in zip(out, cases, strict=True):
        assert r["text"] == text if gone is None else gone not in r["text"], (text, r["text"])
        assert kinds is None or r["pii_kinds"] == kinds, (text, r)
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4} 12/26", out[0]["text"]) and _luhn(re.sub(r"\D", "", out[0]["text"][:19]))
    assert out[0]["text"][:19] == out[2]["text"][3:] == out[3]["text"][5:24] and out[11]["text"][:19] == out[12]["text"][:19]


def test_pii_edges(spark):
    out = pii.pseudonymize(odd(spark).withColumnRenamed("pos", "pii_found"), KEY)
    assert out.columns.count("pii_found") == 1
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (t for _, t in ODD)))
    assert pii.pseudonymize(empty(spark), KEY).count() == 0


def test_pii_runs_without_python(spark):
    plan = pii.pseudonymize(spark.createDataFrame([(1, "x")], DOCS), KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 3 Jaccard join


def _components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets[i], parent[i] = s, i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,small,hold", [(1, 6, 20_000), (2, 2, 25)])
def test_jaccard_components(spark, monkeypatch, seed, small, hold):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "HOLD", hold)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    base = [rng.choice(vocab) for _ in range(100)]
    for _ in range(80):
        b = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            b[rng.randrange(100)] = rng.choice(vocab)
        rows.append(" ".join(b))
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    rows += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 12, 16, 30]))) for _ in range(40)]
    rows += [rng.choice(["a b", "A  b\n", "x", "", "  ", "one two three four five six"]) for _ in range(20)] + [None]
    rows += [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_components(spark, spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == _components(rows)


def test_jaccard_edges(spark):
    got = sorted(map(tuple, jaccard.link_components(spark, odd(spark)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert len(got) == len(ODD) and (None, 1, None) in got and (1, 0, 1) in got and got.count((5, 1, 5)) == 2
    kept = jaccard.keep_one_each(spark, spark.createDataFrame([(1, "a b c"), (2, "A b  c"), (3, "q"), (4, None), (5, None)], DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert jaccard.link_components(spark, empty(spark)).count() == 0


def test_suffix_filter_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        assert jaccard._apart(x, y, 3) <= len(np.setxor1d(x, y))


# ---------------------------------------------------------------- 4 packing


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["It's", "river!!", "Árbol", "12,5", "x—y", "don't", "<|endoftext|>", "漢字", "É!"]) for _ in range(rng.choice([0, 3, 200, 900]))) for _ in range(120)] + [None, "", "z " * 9000]
    rows = list(enumerate(texts))
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(3), size=1024).toPandas()
    for d, g in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*tok.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert g.length.sum() == len(ids) and (g.start.values == np.concatenate([[0], np.cumsum(g.length.values)[:-1]])).all() and (g.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    assert got.doc_id.nunique() == len(rows)
    lengths = got.groupby("sequence_id").length.sum()
    assert lengths.max() <= 1024 and all(n & (n - 1) == 0 for n in lengths)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.concatenate([[0], np.cumsum(g.length.values)[:-1]])).all()
    assert packing.pack_documents(empty(spark)).count() == 0
    assert packing.pack_documents(odd(spark)).groupBy("doc_id").count().count() == 7


def test_sum_of_squares_choice():
    s = packing.SumOfSquares(10)
    for n in (6, 6, 3, 4):
        s.place(packing.Piece(0, 0, n, n, np.zeros(n, np.uint32)))
    # 3 goes on a 6 (levels 9 and 6) and 4 then fills the other 6
    assert len(s.done) == 1 and sorted(s.open) == [9]


# ---------------------------------------------------------------- 5 suffix dedup


def _cut(texts, size=200):
    seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        m = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        out.append((len(t), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    rng = random.Random(hot)

    def prose(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    passage, long = prose(230), prose(700)
    texts = [prose(150) + passage[rng.randrange(40) :] + prose(rng.randrange(200)) for _ in range(15)]
    for _ in range(10):
        at = rng.randrange(len(long))
        texts.append(long[:at] + "#" + long[at + 1 :])
    copy = prose(300)
    texts += [copy, copy, "", None, prose(199), "ab" * 400, prose(250), passage[:199], "x" * 1000, prose(100) + "x" * 210]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.cut_repeats(spark, spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    want = _cut([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_suffix_dedup_edges(spark):
    out = suffixdedup.cut_repeats(spark, odd(spark))
    assert out.count() == len(ODD)
    assert suffixdedup.cut_repeats(spark, empty(spark)).count() == 0


# ---------------------------------------------------------------- 7 media


@pytest.mark.parametrize("w,h", [(1, 1), (2, 3), (16, 5), (19, 9)])
def test_webp_round_trip(w, h):
    rng = np.random.default_rng(w * h)
    kinds = {
        "noise": rng.integers(0, 256, (h, w, 4), dtype=np.uint8),
        "few": np.array([[1, 2, 3, 4], [9, 8, 7, 255], [0, 0, 0, 0]], np.uint8)[rng.integers(0, 3, (h, w))],
        "slope": (np.add.outer(np.arange(h) * 3, np.arange(w) * 5)[..., None] + np.arange(4)).astype(np.uint8),
    }
    for px in kinds.values():
        files = []
        for t in ((), ("green",), ("predictor",), ("cross",), ("predictor", "cross", "green"), ("palette",)):
            for cache in (0, 1, 11):
                for refs in (False, True):
                    meta = rng.integers(0, 3, (-(-h // 4), -(-w // 4))) if t in ((), ("green",)) else None
                    files.append(webp.encode_image(px, t, cache, refs, meta=meta))
        assert all((got == px).all() for got in webp.decode_images(files))


def test_webp_bad_bytes():
    file = webp.encode_image(np.zeros((2, 3, 4), np.uint8))
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)]
    for bad in (b"", b"RIFF", file[:22], b"x" * 100):
        with pytest.raises((webp.BadImage, IndexError)):
            webp.decode_images([bad])


def test_media_columns(spark):
    rows = ODD[:-1] + [(8, "y" * 20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    stored = media.store_texts(docs)
    back = sorted((r["doc_id"], r["n_bytes"], bytes(r["payload"])) for r in media.load_payloads(stored).collect())

    def payload(t):
        raw = (t or "").encode()
        return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))

    assert back == sorted((d, len((t or "").encode()), payload(t)) for d, t in rows)
    for r in media.digests(stored).collect():
        t = next(payload(t) for d, t in rows if d == r["doc_id"])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), hashlib.sha256(t).hexdigest(), zlib.crc32(t[-64:]))
    assert media.digests(media.store_texts(empty(spark))).count() == 0
    images = spark.createDataFrame([(1, bytearray(webp.encode_image(np.zeros((2, 3, 4), np.uint8)))), (2, bytearray(b"no")), (3, None)], "id long, image binary")
    got = {r["id"]: (r["width"], r["height"], r["pixels"] and len(r["pixels"])) for r in media.read_pixels(images, "id", "image").collect()}
    assert got == {1: (3, 2, 24), 2: (None, None, None), 3: (None, None, None)}


# ---------------------------------------------------------------- 8 mixing


def _mix_input(spark):
    rows = [(i, "w " * (10 + i % 7), "big") for i in range(300)] + [(1000 + i, "w " * 12, "mid") for i in range(60)] + [(2000 + i, "w " * 9, None) for i in range(20)] + [(3000, None, "none"), (3001, "", "big")]
    return spark.createDataFrame(rows, DOCS + ", source string")


def test_mixing_by_repetition(spark):
    docs = _mix_input(spark)
    out = mixing.mix_sources(spark, docs, max_repeat=2.0).collect()
    uses = collections.Counter(r["doc_id"] for r in out)
    assert set(uses) == {r["doc_id"] for r in docs.collect()} and max(uses.values()) <= 2
    tokens = collections.Counter()
    for r in out:
        tokens[r["source"]] += r["mix_tokens"]
    total = sum(tokens.values())
    for r in out:
        if r["mix_tokens"]:
            assert abs(tokens[r["source"]] / total - r["mix_weight"]) < 0.02
    assert uses[3000] == uses[3001] == 1


def test_mixing_by_entropy_and_budget(spark):
    docs = _mix_input(spark)
    stats = [("a", 900), ("b", 90), ("c", 10)]
    df = spark.createDataFrame(stats, "source string, tokens long")
    alpha = mixing.find_exponent(df, target_entropy=0.9)
    p = np.array([0.9, 0.09, 0.01]) ** alpha
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.9) < 1e-3
    assert mixing.find_exponent(df, target_entropy=0.0) == 1.0 and mixing.find_exponent(df, target_entropy=1.0) == 0.0
    out = mixing.mix_sources(spark, docs, target_entropy=0.95, budget=1500.0).collect()
    assert abs(sum(r["mix_tokens"] for r in out) - 1500) < 3 * 20
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(spark, docs.repartition(5), target_entropy=0.95, budget=1500.0).collect()))


def test_mixing_edges(spark):
    assert mixing.mix_sources(spark, empty(spark), max_repeat=2.0).count() == 0
    out = mixing.mix_sources(spark, odd(spark).withColumnRenamed("pos", "mix_block"), max_repeat=2.0)
    assert out.count() == len(ODD) and out.columns.count("mix_block") == 1


# ---------------------------------------------------------------- 10 line dedup


def test_line_dedup(spark):
    rows = [(2, "a\nb\nc\nd\ne"), (1, "x\na\nb\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "\n\n\n\n"), (8, "b\nc\nd\nb\nc\nd")]
    seen, gone = {}, collections.defaultdict(set)
    for d, t in sorted(rows):
        lines = t.split("\n") if t is not None else []
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[d] |= {i, i + 1, i + 2}
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}
    got = linededup.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {d: len(gone[d]) for d, _ in rows}


def test_line_dedup_edges(spark):
    out = linededup.dedup_lines(odd(spark))
    assert out.count() == len(ODD) and out.columns.count("n_removed") == 1 and "pos" in out.columns
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], DOCS)
    assert sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(twice).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert json.dumps(sorted(entry.oracle_sql())) and pa.__version__
