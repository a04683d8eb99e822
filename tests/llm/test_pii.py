"""Pseudonyms against a Feistel network written out in Python, and spellings of equal values."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sylva.llm import pii
from tests.llm.data import documents

KEY = "test key"


def digest(kind, r, other):
    return hashlib.sha256(f"{KEY}|{kind}|{r}|{other}".encode()).hexdigest()


def moved(half, d):
    out = ""
    for i, c in enumerate(half):
        by = int(d[2 * (i % 32) : 2 * (i % 32) + 2], 16)
        for first, n in (("0", 10), ("a", 26), ("A", 26)):
            if 0 <= ord(c) - ord(first) < n and c.isalnum():
                c = chr((ord(c) - ord(first) + by) % n + ord(first))
                break
        out += c
    return out


def permuted(value, kind):
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            # a substring of Spark that begins at 0 begins at 1
            a = moved(a, digest(kind, r, b))
        else:
            b = moved(b, digest(kind, r, a))
    return a + b


def pair(x, y, sizes, kind):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            x = (x + int(digest(kind, r, y)[:12], 16)) % sizes[0]
        else:
            y = (y + int(digest(kind, r, x)[:12], 16)) % sizes[1]
    return x, y


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))


def card(d):
    body = d[0] + permuted(d[1:-1], "card")
    return body + str((10 - luhn(body + "0") % 10) % 10)


def iban(bare):
    bban = permuted(bare[4:], "iban")
    n = int("".join(str(int(c, 36)) for c in bban + bare[:2] + "00"))
    return f"{bare[:2]}{98 - n % 97:02d}{bban}"


def email(m):
    head, end = m.rsplit(".", 1)
    other = permuted(head.lower(), "email")
    return "".join(b.upper() if a.isupper() else b for a, b in zip(head, other, strict=True)) + "." + end


def planned(n):
    size, base = [], []
    for i in (0, 3):
        low = n[i] in "01"
        size.append(2 if low else 8)
        base.append(0 if low else 2)
    x, y = ((int(n[0]) - base[0]) * size[1] + int(n[3]) - base[1]) * 100 + int(n[1:3]), int(n[4:])
    x, y = pair(x, y, (size[0] * size[1] * 100, 10**6), f"phone{size[0]}{size[1]}")
    lead, rest = divmod(x, 100)
    return f"{lead // size[1] + base[0]}{rest:02d}{lead % size[1] + base[1]}{y:06d}"


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    index = area - (2 if area > 666 else 1)
    x, y = pair(index * 99 + group - 1, serial - 1, (898 * 99, 9999), "ssn")
    a = x // 99
    return f"{a + (2 if a >= 665 else 1):03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def ip(m):
    o = list(map(int, m.split(".")))
    x, y = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


@pytest.fixture(scope="module")
def days():
    """The days of the 400 years in order, those up to the 12th and those after it."""
    every = [datetime.date(1800, 1, 1) + datetime.timedelta(k) for k in range(146_097)]
    return [d for d in every if d.day <= 12], [d for d in every if d.day > 12]


def date(d, days):
    late = d.day > 12
    among, sizes = days[late], (pii.LATE if late else pii.EARLY)
    n = among.index(d)
    x, y = pair(n // sizes[1], n % sizes[1], sizes, "late date" if late else "date")
    return among[x * sizes[1] + y]


def replaced(spark, texts):
    docs = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    return [r.text for r in pii.pseudonymise(docs, KEY).orderBy("doc_id").collect()]


def test_every_format_against_the_network(spark, days):
    cases = {"4111 1111 1111 1111": None, "378282246310005": None, "GB82 WEST 1234 5698 7654 32": None, "ES9121000418450200051332": None,
        "Jo.Doe+x7@Mail-1.example.com": email("Jo.Doe+x7@Mail-1.example.com"),
             "219-09-9999": ssn("219-09-9999"), "899-99-9999": ssn("899-99-9999"), "001-01-0001": ssn("001-01-0001"), "10.0.0.255": ip("10.0.0.255"),
             "255.255.255.255": ip("255.255.255.255")}
    a, b = card("4111111111111111"), iban("GB82WEST12345698765432")
    cases["4111 1111 1111 1111"] = " ".join(a[k : k + 4] for k in range(0, 16, 4))
    cases["378282246310005"] = card("378282246310005")
    cases["GB82 WEST 1234 5698 7654 32"] = " ".join(b[k : k + 4] for k in range(0, 22, 4))
    cases["ES9121000418450200051332"] = iban("ES9121000418450200051332")
    n = planned("2935559179")
    cases["+1 (293) 555-9179"] = f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}"
    n = planned("0120059179")
    cases["+1 012 005 9179"] = f"+1 {n[:3]} {n[3:6]} {n[6:]}"
    n = "442" + permuted("071234567", "phone")
    cases["+44 20 7123 4567"] = f"+{n[:2]} {n[2:4]} {n[4:8]} {n[8:]}"
    for d in (datetime.date(1800, 1, 1), datetime.date(2199, 12, 31), datetime.date(2020, 2, 29), datetime.date(1999, 12, 13),
        datetime.date(1900, 2, 28), datetime.date(2024, 3, 12)):
        cases[d.isoformat()] = date(d, days).isoformat()
    got = replaced(spark, list(cases))
    assert dict(zip(cases, got, strict=True)) == cases
    assert luhn(a) % 10 == 0 and int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1


def test_spellings_of_a_value_are_linked(spark):
    bare = lambda s: re.sub(r"[^A-Za-z0-9]", "", s)
    for group in (["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"],
        ["+44 20 7123 4567", "+442071234567", "+44-20-7123-4567", "+44 (20) 7123 4567"], ["a.b@c-d.org", "A.B@C-d.org"]):
        got = replaced(spark, group)
        assert len({bare(t).lower() for t in got}) == 1 and bare(got[0]) != bare(group[0])
        assert [re.sub("[A-Za-z0-9]", "x", t) for t in got] == [re.sub("[A-Za-z0-9]", "x", t) for t in group]
    got = replaced(spark, ["+1 293 555 9179", "+1-293-555-9179", "+12935559179", "(293) 555-9179", "293.555.9179"])
    assert len({bare(t)[-10:] for t in got}) == 1 and re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", bare(got[3])) and bare(got[3]) != "2935559179"
    trunk = replaced(spark, ["+44 (0)20 7123 4567", "+44 20 7123 4567"])
    assert trunk[0].replace("(0)", "") == trunk[1] and "(0)" in trunk[0]

    def days(texts, ahead=()):
        for k, t in enumerate(texts):
            a = list(map(int, re.split("[./-]", t)))
            y, m, d = a if a[0] > 99 else (a[2], a[0], a[1]) if k in ahead else (a[2], a[1], a[0])
            yield datetime.date(y, m, d)

    assert len(set(days(replaced(spark, ["2021-03-04", "04.03.2021", "4.3.2021", "2021/3/4", "04/03/2021", "4-3-2021"])))) == 1
    got = replaced(spark, ["2021-03-25", "03/25/2021", "25.3.2021", "3/25/2021"])
    assert len(set(days(got, ahead=(1, 3)))) == 1 and all(int(t.split("/")[1]) > 12 for t in (got[1], got[3]))


def test_days_are_permuted(spark):
    d = spark.range(0, 146_097, 1, 4).select(F.date_format(F.expr("date_add(date'1800-01-01', int(id))"), "yyyy-MM-dd").alias("d"))
    got = d.select("d", pii.pseudonym(F.col("d"), F.lit("date"), KEY).alias("p"))
    assert got.agg(F.count_distinct("p"), F.count(F.try_to_date("p", "yyyy-MM-dd")),
        F.count_if((F.right("d", F.lit(2)) > "12") != (F.right("p", F.lit(2)) > "12"))).first() == (146_097, 146_097, 0)


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(documents(spark), "")
    with pytest.raises(TypeError):
        pii.pseudonymise(documents(spark))
