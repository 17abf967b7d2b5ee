"""Each kind's pseudonym against a plain Python Feistel network, and as a permutation of all that its format allows."""

import datetime
import hashlib
import random
import re

from riskloom.llm import pii
from tests.llm.test_operators import DOCS, KEY, _feistel, _luhn


def _digits(d, kind):
    """A permutation of all strings of so many digits: two halves."""
    half = len(d) // 2
    a, b = _feistel(kind, int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half))
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def _fill(like, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


def _phone(m):
    d = re.sub(r"\D", "", m)
    home = d if not m.startswith("+") else d[1:] if re.fullmatch("1[0-9]{10}", d) else None
    if home is not None:
        area, exchange, line = int(home[:3]), int(home[3:6]), int(home[6:])
        if area >= 200 and exchange >= 200:
            a, b = _feistel("phone", area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000)
            new = f"{a + 200}{b // 10000 + 200}{b % 10000:04d}"
        else:
            index = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
            a, b = _feistel("phone-off-plan", index, line, 360_000, 10_000)
            new = f"{a // 1000:03d}{a % 1000:03d}{b:04d}" if a < 200_000 else f"{(a - 200_000) // 200 + 200:03d}{(a - 200_000) % 200:03d}{b:04d}"
        return _fill(m, ("1" if m.startswith("+") else "") + new)
    n = 1 if d[0] in pii.COUNTRY_CODES_1 else 2 if d[:2] in pii.COUNTRY_CODES_2 else 3
    return _fill(m, d[:n] + _digits(d[n:], "abroad"))


def _ssn(m):
    area, group, serial = map(int, m.split("-"))
    a, b = _feistel("ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    new = a // 99 + 1
    return f"{new + (new >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def _ip(m):
    o = list(map(int, m.split(".")))
    a, b = _feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def _date(m):
    day = (datetime.date.fromisoformat(m) - datetime.date(1900, 1, 1)).days
    a, b = _feistel("date", day // 4297, day % 4297, 17, 4297)
    return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).isoformat()


def _card(m):
    d = re.sub(r"\D", "", m)
    body = _digits(d[:-1], "card")
    return _fill(m, next(body + str(c) for c in range(10) if _luhn(body + str(c))))


def _email(m):
    return f"u{hashlib.sha256((KEY + '|email|' + m.lower()).encode()).hexdigest()[:32]}@redacted.example"


def test_each_kind_by_plain_python(spark):
    rng = random.Random(8)
    cases = []
    for _ in range(40):
        n = f"{rng.randrange(1000):03d} {rng.randrange(1000):03d} {rng.randrange(10000):04d}".split()
        cases += [("phone", f"({n[0]}) {n[1]}-{n[2]}", _phone), ("phone", f"+1 ({n[0]}) {n[1]}-{n[2]}", _phone), ("phone", f"{n[0]}-{n[1]}-{n[2]}", _phone)]
        cases += [("ip", ".".join(str(rng.randrange(256)) for _ in range(4)), _ip), ("date", (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73_049))).isoformat(), _date)]
        cases += [("ssn", f"{rng.choice([x for x in range(1, 900) if x != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", _ssn), ("email", f"A{rng.randrange(10**6)}.b@mail.example.com", _email)]
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(body + str(c) for c in range(10) if _luhn(body + str(c)))
        cases.append(("card", " ".join(card[i : i + 4] for i in range(0, 16, 4)), _card))
    cases += [("phone", m, _phone) for m in ("+353 1 234567", "+3531234567", "+353-12-34567", "+44 20 7946 0958", "+442079460958", "+49 (30) 1234567", "+7 495 1234567", "+74951234567", "+1 868 12345")]
    out = pii.pseudonymize(spark.createDataFrame([(i, f"see {m}, then") for i, (_, m, _) in enumerate(cases)], DOCS), KEY).collect()
    got = {r["doc_id"]: r for r in out}
    wrong = [(m, got[i]["text"], f(m)) for i, (k, m, f) in enumerate(cases) if got[i]["text"] != f"see {f(m)}, then" or got[i]["pii_kinds"] != {k: 1}]
    assert wrong == []
    digits = [re.sub(r"\D", "", got[len(cases) - 9 + i]["text"]) for i in range(9)]
    assert digits[0] == digits[1] == digits[2] and digits[3] == digits[4] and digits[6] == digits[7]


def test_all_days_are_permuted(spark):
    days = [(i, (datetime.date(1900, 1, 1) + datetime.timedelta(i)).isoformat()) for i in range(73_049)]
    out = {r["text"] for r in pii.pseudonymize(spark.createDataFrame(days, DOCS), KEY).select("text").collect()}
    assert out == {d for _, d in days}


def test_keys_differ(spark):
    df = spark.createDataFrame([(1, "4111 1111 1111 1111 and 2021-03-04")], DOCS)
    assert pii.pseudonymize(df, "a").first()["text"] != pii.pseudonymize(df, "b").first()["text"]


def test_long_repeats_of_every_loop(spark):
    """No pattern takes stack for each repeat of one of its loops; addresses end at the last label that may be last."""
    n = 20_000
    texts = {
        "a@" + "b." * n + "com": 1, "a@" + "b1." * n: 0, "a@b.co." + "9." * n: 1, "a." * n + "@b.com": 1, "a@" * n: 0, "a@b." * n: 0, "1" * n: 0, "1 " * n: 0, "1-" * n: 0,
        'key="' + "a1" * n + '"': 1, "AB12" + " AB12" * n: 0, "DE12" * n: 0, "2020-01-01 " * 500: 500, "1.2.3.4." * n: 0, "1.2.3.4 " * 500: 500, "+1 234" * n: 0, "+" * n: 0, "123-45-6789-" * n: 0, " " * n + "1": 0, "(123" * n: 0,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["pii_found"], r["text"]) for r in pii.pseudonymize(df, KEY).collect()}
    assert [got[i][0] for i in range(len(texts))] == list(texts.values())
    assert re.fullmatch(r"u[0-9a-f]{32}@redacted\.example", got[0][1])
    assert re.fullmatch(r"u[0-9a-f]{32}@redacted\.example\.(?:9\.)+", got[2][1])


def test_addresses_as_before(spark):
    """The possessive pattern finds what greedy labels with a look-behind found."""
    old = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?![A-Za-z0-9-])")
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "1", "-", ".", "@", "co", "uk", " "]) for _ in range(rng.randrange(4, 24))) for _ in range(500)]

    def want(t):
        out, at = [], 0
        while m := old.search(t, at):
            address = m[0]
            while not re.search(r"\.[A-Za-z]{2,20}$", address.partition("@")[2]) and "." in address.partition("@")[2]:
                address = address.rpartition(".")[0]
            if re.search(r"\.[A-Za-z]{2,20}$", address.partition("@")[2]):
                out.append(address)
                at = m.start() + len(address)
            else:
                at = m.start() + 1
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    found = {r["doc_id"]: r["x"] for r in df.selectExpr("doc_id", f"regexp_extract_all(text, r'{pii._PATTERNS['email']}', 0) AS x").collect()}
    assert [found[i] for i in range(len(texts))] == [want(t) for t in texts]
