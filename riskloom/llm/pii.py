"""PII: format-preserving Feistel pseudonyms, built of DataFrame functions only.

Personal data are found by pattern, validated, and replaced in place:

* card numbers (Luhn, also beside other groups of digits), national ids ddd-dd-dddd (assignable ranges), phone numbers
  (ten digits, those outside the ten-digit plan among themselves, or + and a country code), IPv4 addresses, IBANs (mod 97) and dates
  (real days of 1900-2099) go through a keyed Feistel permutation of exactly the
  values their format allows, and keep their length, separators and validity;
* e-mail addresses and quoted hexadecimal secrets have no numeric format to permute in
  and get a keyed digest: 128 bits for addresses, the same length for secrets.

Equal values give equal pseudonyms, however they are punctuated, in all documents under
one key (the caller's; there is no default); different values of one permuted kind never
collide, digests only as 128 bits may. What fails validation stays. Every
text is worked on in its own row: no shuffle, no join.

The permutation: a value is a pair in Z_A x Z_B with A * B the size of the format;
ROUNDS times one half is shifted by a SHA-256 of key, kind, round and the other half.

Edge cases: a null text stays null, an empty text empty; text without personal data is
unchanged; repeated rows get equal results; columns named pii_* are replaced, all others
pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import table

ROUNDS = 10
KINDS = ("email", "secret", "iban", "date", "ip", "ssn", "phone", "card")

#: An address, national id, date or phone number after a space, which isn't part of the number before it.
_OTHER = r"(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)(?!\.[0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])|(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?!\w)(?![-/.][0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?!\w)(?![-.][0-9]))"
#: A plus sign and 8 to 15 digits, written out, as a look-behind takes no repeated group.
_UP_TO_15 = r"\+" + r"[ .()-]{0,3}[0-9]" * 8 + r"(?:[ .()-]{0,3}[0-9]" * 7 + ")?" * 7
_GROUP = r"(?!" + _OTHER + r")[0-9]++(?:-[0-9]++)*+(?![\w-])"

#: A last domain label, and a label that can't be one.
_TOP = r"[A-Za-z]{2,20}(?![A-Za-z0-9-])"
_LABEL = r"(?!" + _TOP + r")[A-Za-z0-9-]++"

#: Country calling codes of one and of two digits; every other code has three (the numbering plan of ITU E.164).
COUNTRY_CODES_1 = ("1", "7")
COUNTRY_CODES_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)

#: Countries by the length of their IBANs (the registry of ISO 13616).
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _national_ibans() -> str:
    """IBANs of exactly their country's length."""
    out = []
    for n, countries in IBAN_COUNTRIES.items():
        fours, rest = divmod(n - 4, 4)
        out.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{fours}}}" + (f"[ ]?[A-Z0-9]{{{rest}}}" if rest else ""))
    return r"(?<![A-Za-z0-9])(?:" + "|".join(out) + r")(?![A-Za-z0-9])"


_PATTERNS = {
    # as many labels as end in one that may be last; possessive, as backing off over a group takes stack for each label
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?:\." + _LABEL + r")*+\." + _TOP + r")++",
    "secret": r"(?<=(?i:token|secret|key|password)[ ]{0,2}[=:][ ]{0,2}[\"'])[0-9a-fA-F]{16,}+(?=[\"'])",
    "iban": _national_ibans() + r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\w.])(?<![0-9][-/])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?!\w)(?![-/.][0-9])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)(?!\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)|(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,5}(?:(?:[.-]?|[ ](?!" + _OTHER + r"))[0-9]{2,5}){1,4}(?<=" + _UP_TO_15 + r")(?!\w)|(?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?!\w)(?![-.][0-9])",
    # a run of digit groups, numbers of other kinds left out; the cards in it are found by _cards
    "card": r"(?<![\w-])(?<!\.)(?=[0-9](?:[ -]?[0-9]){12})" + _GROUP + r"(?:[ ]" + _GROUP + r")*+",
}


def _num(c: Column) -> Column:
    return c.cast("bigint")


def _part(s: Column, start, size) -> Column:
    return F.substr(s, start if isinstance(start, Column) else F.lit(start), size if isinstance(size, Column) else F.lit(size))


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, kind: str, key: str) -> Column:
    """The keyed permutation of Z_size_a x Z_size_b at (a, b), as a struct."""

    def step(s, i):
        first = i % 2 == 0
        other = F.when(first, s["b"]).otherwise(s["a"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"), size_a.cast("string"), size_b.cast("string")), 256)
        noise = F.conv(F.substr(digest, F.lit(1), F.lit(14)), 16, 10).cast("bigint")
        return F.struct(F.when(first, (s["a"] + noise) % size_a).otherwise(s["a"]).alias("a"), F.when(first, s["b"]).otherwise((s["b"] + noise) % size_b).alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(_num(a).alias("a"), _num(b).alias("b")), step)


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(d: Column, kind: str, key: str) -> Column:
    """Feistel over all strings of as many digits as d has (two at least)."""
    u = F.floor(F.length(d) / 2).cast("int")
    v = F.length(d) - u
    pair = feistel(F.substr(d, F.lit(1), u), F.substr(d, u + 1, v), _pow10(u), _pow10(v), kind, key)
    return _let(pair, lambda r: F.concat(F.lpad(r["a"].cast("string"), u, "0"), F.lpad(r["b"].cast("string"), v, "0")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string, its last digit the check digit."""
    each = F.transform(F.reverse(F.split(d, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def mod97(s: Column) -> Column:
    """The number mod 97 of an alphanumeric string, letters counting 10 to 35."""

    def step(acc, c):
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def refill(template: Column, chars: Column, pattern: str = "[0-9]") -> Column:
    """template with its characters of the pattern replaced, in order, by those of chars."""

    def step(s, c):
        hit = c.rlike(pattern)
        return F.struct(F.concat(s["t"], F.when(hit, F.substr(chars, s["n"], F.lit(1))).otherwise(c)).alias("t"), (s["n"] + F.when(hit, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("t"), F.lit(1).alias("n")), step)["t"]


def _card(m: Column, key: str) -> Column:
    """The pseudonym of a card number that has been validated."""

    def new(d):
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
        return refill(m, _let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string"))))

    return _let(_digits(m), new)


#: Cards as they are printed: one block, 4-4-4-4 with up to 3 more, 4-6-5, 4-6-4.
_PRINTED = r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"


def _cards(m: Column, key: str) -> Column:
    """(new text, cards) of a run of digit groups, a null text when it holds no card.

    A card is 13 to 19 digits from one group border to another. From left to right, a card as it
    is printed comes before any other that begins with it or reaches into it, then the longest.
    """
    # of each group, the spans of 19 to 13 digits that begin with it, empty where no border is there
    spans = [F.regexp_extract_all(m, F.lit(rf"(?<![0-9])(?=[0-9])(?:(?=([0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])))|)"), F.lit(1)) for n in range(19, 12, -1)]

    def valid(t):
        return _let(_digits(t), lambda d: (d != "") & ~d.rlike("^(.)\\1*$") & (luhn_sum(d) % 10 == 0))

    def best(found):
        def pick(printed):
            def one(ts, i):
                free = F.filter(ts, lambda t: ~F.exists(F.slice(printed, i + 2, F.size(F.split(t, "[ -]")) - 1), lambda p: p))
                return F.coalesce(F.get(F.filter(ts, lambda t: t.rlike(_PRINTED)), F.lit(0)), F.get(free, F.lit(0)))

            return F.transform(found, one)

        return _let(F.transform(found, lambda ts: F.exists(ts, lambda t: t.rlike(_PRINTED))), pick)

    def fill(cards):
        # of each group one letter: a card begins (1), goes on (2), or there is none (0); no long text is carried along
        def step(s, card):
            hit = (s["left"] == 0) & card.isNotNull()
            left = F.when(hit, F.size(F.split(card, "[ -]")) - 1).otherwise(F.greatest(s["left"] - 1, F.lit(0)))
            return F.struct(F.concat(s["f"], F.when(hit, F.lit("1")).when(s["left"] > 0, F.lit("2")).otherwise(F.lit("0"))).alias("f"), left.alias("left"))

        def text(flags):
            each = F.arrays_zip(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)).alias("group"), cards.alias("card"), flags.alias("flag"))
            parts = F.transform(each, lambda x: F.when(x["flag"] == "1", F.concat(F.regexp_extract(x["group"], "^[ -]?", 0), _card(x["card"], key))).when(x["flag"] == "0", x["group"]).otherwise(F.lit("")))
            n = F.size(F.filter(flags, lambda f: f == "1"))
            return F.struct(F.when(n > 0, F.array_join(parts, "")).alias("new"), n.alias("n"))

        state = F.aggregate(cards, F.struct(F.lit("").alias("f"), F.lit(0).alias("left")), step)
        return _let(F.split(state["f"], ""), text)

    every = F.transform(F.arrays_zip(*[x.alias(f"s{i}") for i, x in enumerate(spans)]), lambda z: F.filter(F.array(*[z[f"s{i}"] for i in range(len(spans))]), valid))
    return _let(_let(every, best), fill)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _num(_part(m, 1, 3)), _num(_part(m, 5, 2)), _num(_part(m, 8, 4))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)

    def text(r):
        new = F.floor(r["a"] / 99).cast("bigint") + 1
        new = new + F.when(new >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((r["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((r["b"] + 1).cast("string"), 4, "0"))

    return F.when(good, _let(feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key), text))


def _phone(m: Column, key: str) -> Column:
    def new(d):
        home = F.when(~m.startswith("+"), d).when(d.rlike("^1[0-9]{10}$"), F.substr(d, F.lit(2)))

        def ten(h):
            area, exchange, line = _num(_part(h, 1, 3)), _num(_part(h, 4, 3)), _num(_part(h, 7, 4))
            pair = feistel(area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000), "phone", key)
            out = _let(pair, lambda r: F.concat((r["a"] + 200).cast("string"), (F.floor(r["b"] / 10000) + 200).cast("string"), F.lpad((r["b"] % 10000).cast("string"), 4, "0")))
            # outside the plan: 200,000 pairs with an area below 200, then 160,000 with only the exchange below 200
            index = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
            pair = feistel(index, line, F.lit(360_000), F.lit(10_000), "phone-off-plan", key)

            def text(r):
                low, rest = r["a"] < 200_000, r["a"] - 200_000
                a = F.when(low, F.floor(r["a"] / 1000)).otherwise(F.floor(rest / 200) + 200)
                return F.concat(*[F.lpad(x.cast("bigint").cast("string"), n, "0") for x, n in ((a, 3), (F.when(low, r["a"] % 1000).otherwise(rest % 200), 3), (r["b"], 4))])

            out = F.when((area >= 200) & (exchange >= 200), out).otherwise(_let(pair, text))
            return F.when(F.length(h) == 10, refill(m, F.concat(F.when(m.startswith("+"), F.lit("1")).otherwise(F.lit("")), out)))

        # by the digits alone, so that a number has one pseudonym however it is punctuated
        country = F.when(d.rlike(f"^(?:{'|'.join(COUNTRY_CODES_1)})"), 1).when(d.rlike(f"^(?:{'|'.join(COUNTRY_CODES_2)})"), 2).otherwise(3)
        rest = F.substr(d, country + 1)
        abroad = m.startswith("+") & F.length(d).between(8, 15) & (F.length(rest) >= 4)
        away = F.when(abroad, refill(m, F.concat(F.substr(d, F.lit(1), country), permute_digits(rest, "abroad", key))))
        return F.when(home.isNotNull(), _let(home, ten)).otherwise(away)

    return _let(_digits(m), new)


def _ip(m: Column, key: str) -> Column:
    def new(o):
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip", key)
        out = _let(pair, lambda r: F.concat_ws(".", F.floor(r["a"] / 256).cast("string"), (r["a"] % 256).cast("string"), F.floor(r["b"] / 256).cast("string"), (r["b"] % 256).cast("string")))
        return F.when(F.forall(o, lambda x: x < 256), out)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("bigint")), new)


def _iban(m: Column, key: str) -> Column:
    def new(s):
        good = F.length(s).between(15, 34) & (mod97(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))) == 1)
        body = F.substr(s, F.lit(5))
        country = F.substr(s, F.lit(1), F.lit(2))

        def digits(d):  # up to 30 digits: two permutations of at most 15
            half = F.floor(F.length(d) / 2).cast("int")
            return F.when(F.length(d) >= 4, F.concat(permute_digits(F.substr(d, F.lit(1), half), "iban1", key), permute_digits(F.substr(d, half + 1), "iban2", key)))

        def checked(x):
            check = F.lpad((F.lit(98) - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
            return refill(m, F.concat(country, check, x), "[A-Z0-9]")

        return F.when(good, _let(refill(body, _let(_digits(body), digits)), checked))

    return _let(F.replace(m, F.lit(" ")), new)


def _date(m: Column, key: str) -> Column:
    sep = F.regexp_extract(m, "[-/.]", 0)

    def like(v, old):
        return F.when(F.length(old) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))

    def new(p):
        iso = F.length(p[0]) == 4
        month_first = ~iso & ((p[1].cast("int") > 12) | (m.contains("/") & (p[0].cast("int") <= 12)))
        year = F.when(iso, p[0]).otherwise(p[2])
        month = F.when(month_first, p[0]).otherwise(p[1])
        day = F.when(iso, p[2]).when(month_first, p[1]).otherwise(p[0])
        when = F.when(year.cast("int").between(1900, 2099), F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))
        index = F.datediff(when, F.lit("1900-01-01").cast("date")).cast("bigint")
        # 1900-2099 has 73,049 days: 17 * 4297
        pair = feistel(F.floor(index / 4297), index % 4297, F.lit(17), F.lit(4297), "date", key)
        date = _let(pair, lambda r: F.date_add(F.lit("1900-01-01").cast("date"), (r["a"] * 4297 + r["b"]).cast("int")))

        def text(x):
            y, mo, d = F.year(x), F.month(x), F.dayofmonth(x)
            out = F.when(iso, F.concat_ws("-", y.cast("string"), like(mo, p[1]), like(d, p[2])))
            out = out.when(month_first, F.concat_ws("-", like(mo, p[0]), like(d, p[1]), y.cast("string")))
            return F.replace(out.otherwise(F.concat_ws("-", like(d, p[0]), like(mo, p[1]), y.cast("string"))), F.lit("-"), sep)

        return F.when(index.isNotNull(), _let(date, text))

    return _let(F.split(m, "[-/.]"), new)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substr(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256), F.lit(1), F.lit(32)), F.lit("@redacted.example"))


def _secret(m: Column, key: str) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(m) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), i.cast("string"), m), 256))
    return F.substr(F.array_join(blocks, ""), F.lit(1), F.length(m))


_RULES = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone}


def _pattern(kinds) -> str:
    """One alternation; each kind's back-references are renumbered to follow the groups before it. Group 1 is a secret."""
    out, groups = [], 1
    for k in kinds:
        own = _PATTERNS[k].count("([")
        p = _PATTERNS[k]
        for g in range(own, 0, -1):
            p = p.replace(f"\\{g}", f"\\{g + groups}")
        out.append(f"({p})" if k == "secret" else f"(?:{p})")
        groups += own
    return "|".join(out)


def _found(m: Column, secret: Column, key: str) -> Column:
    """(kind, pseudonym, values) of a match, secret telling whether it matched as one; a null pseudonym when nothing validates."""
    # a match is tried as each kind whose whole pattern it fits, in order
    shape = {
        "email": m.contains("@"),
        "secret": secret,
        "iban": m.rlike("^[A-Z]{2}[0-9]{2}"),
        "date": m.rlike(r"^(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})$"),
        "ip": m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
        "ssn": m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        "phone": m.rlike(r"^(?:\+|\()|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"),
        "card": m.rlike("^[0-9](?:[ -]?[0-9]){12}"),
    }
    out = None
    for k in KINDS:
        if k == "card":
            new = _let(_cards(m, key), lambda c: F.struct(F.lit("card").alias("kind"), c["new"].alias("new"), c["n"].alias("n")))
        else:
            new = F.struct(F.lit(k).alias("kind"), _RULES[k](m, key).alias("new"), F.lit(1).alias("n"))
        out = F.when(shape[k], new) if out is None else out.when(shape[k], new)
    return out


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised, plus pii_found (all replacements) and pii_kinds (a map of counts)."""
    names = [c for c in docs.columns if c not in ("pii_found", "pii_kinds")]
    any_kind = _pattern(KINDS)
    may = F.col("text").rlike("[0-9@]")
    hits = F.when(may, F.regexp_extract_all("text", F.lit(any_kind), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # of each hit the secret that it is, or an empty string; no elements where a text has no secrets
    secrets = F.when(may & F.col("text").rlike(_PATTERNS["secret"]), F.regexp_extract_all("text", F.lit(any_kind), F.lit(1))).otherwise(F.array().cast("array<string>"))
    new = F.transform(F.arrays_zip(hits.alias("old"), secrets.alias("secret")), lambda h: F.struct(h["old"].alias("old"), _found(h["old"], F.coalesce(h["secret"] != "", F.lit(False)), key).alias("x")))
    base = docs.select(*[F.col(f"`{c}`") for c in names], new.alias("__new"))
    gaps = F.split("text", any_kind, -1)
    middle = F.zip_with(gaps, F.transform("__new", lambda n: F.coalesce(n["x"]["new"], n["old"])), lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
    text = F.when(F.size("__new") > 0, F.array_join(middle, "")).otherwise(F.col("text"))
    kinds = F.flatten(F.transform(F.filter("__new", lambda n: n["x"]["new"].isNotNull()), lambda n: F.array_repeat(n["x"]["kind"], n["x"]["n"])))
    counts = _let(kinds, lambda ks: F.map_from_arrays(F.array_distinct(ks), F.transform(F.array_distinct(ks), lambda k: F.size(F.filter(ks, lambda x: x == k)))))
    return base.select(*[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in names], F.size(kinds).alias("pii_found"), counts.alias("pii_kinds"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_found, one count for each kind) of every document, under a key for demonstration."""
    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="riskloom-demo-key")
    return out.select("doc_id", "text", F.col("pii_found").alias("n_found"), *[F.coalesce(F.col("pii_kinds")[k], F.lit(0)).alias(f"n_{k}") for k in KINDS])
