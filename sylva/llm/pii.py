"""Format-preserving pseudonyms for personal data, by a keyed Feistel network in DataFrame functions alone.

E-mail and IP addresses, phone, card, social security and bank account (IBAN) numbers and dates are found by
pattern and validated (Luhn, mod 97, calendar, number ranges). An IBAN ends where its country's length says; phone
numbers may come without separators (+442071234567); dates are year first with - or /, or day first with ., / or
-, padded or not, or month first where the day is over 12 (03/25/2021; 03/04/2021 is read day first).

The bare value is permuted, not its spelling: separators, case, padding and the order of day and month are taken off
first and put back afterwards, so that all spellings of a value get spellings of one pseudonym (4111 1111 1111 1111
and 4111111111111111, 2021-03-04 and 4.3.2021, (293) 555-9179 and +1-293-555-9179). The permutation is a Feistel
network: halves of the value are shifted in turn by digests of the other half and the key, each character within its
own class, or numbers within their own range. Equal values get equal pseudonyms in all documents and different
values different ones. Check digits are computed anew; phone numbers keep to their plan; whether a day is after
the 12th stays to be seen, as a month first can be told by that alone.

Null text stays null, with no findings. What does not validate stays as it is. Repeated rows are changed
alike. Empty table: empty result. Other columns stay; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .matches import found, joined, let

ROUNDS = 8
#: The registry's IBAN lengths and their countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BF BJ BY CI CM CY DO GT HN HU LB ML NI PL SN SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern(n: int, countries: str) -> str:
    """IBANs of n characters, together or in groups of four."""
    groups, rest = divmod(n - 4, 4)
    tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}(?![A-Za-z0-9])"


#: The formats, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_iban_pattern(n, cs) for n, cs in IBAN_LENGTHS.items())}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{7,14}(?![0-9])|\+[2-9](?:\)?[ .-]?\(?[0-9]){7,14}\)?|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4})(?![A-Za-z0-9]|[.-][0-9])",
    "ssn": r"(?<![A-Za-z0-9.-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "date": r"(?<![A-Za-z0-9./-])(?:(?:18|19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:18|19|20|21)[0-9]{2}|(?:0[1-9]|[12][0-9]|3[01])/(?:0[1-9]|1[0-2])/(?:18|19|20|21)[0-9]{2}|[0-3]?[0-9](?:\.[0-3]?[0-9]\.|/[0-3]?[0-9]/|-[0-3]?[0-9]-)(?:18|19|20|21)[0-9]{2}|(?:18|19|20|21)[0-9]{2}(?:/[0-3]?[0-9]/|-[0-3]?[0-9]-)[0-3]?[0-9])(?![A-Za-z0-9]|[./-][0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9.-])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9]|[.-][0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Country calling codes.
COUNTRY_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
#: The 400 years from 1800 on: their days up to the 12th of a month and the later ones, each with two factors of their number.
FIRST_YEAR, FIRST_DAY, MONTHS = 1800, "1800-01-01", 4800
EARLY, LATE = (240, 240), (9, 9833)
LATE_DAYS = LATE[0] * LATE[1]


def _digest(key: str, kind: str | Column, r: Column, other: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), other), 256)


def _shifted(half: Column, digest: Column) -> Column:
    """Each letter and digit of half moved within its class by a byte of the digest."""

    def move(c: Column, i: Column, d: Column) -> Column:
        by = F.conv(F.substr(d, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        turn = lambda first, n: F.char((code - first + by) % n + first)
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    return let(digest, lambda d: F.array_join(F.transform(F.split(half, ""), lambda c, i: move(c, i, d)), ""))


def permuted(value: Column, kind: str, key: str) -> Column:
    """A Feistel permutation of the strings of value's format: the same length, each character in its class."""
    middle = (F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), middle).alias("a"), F.substr(value, middle + 1).alias("b"))

    def turn(s: Column, r: Column) -> Column:
        left = F.struct(_shifted(s["a"], _digest(key, kind, r, s["b"])).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), _shifted(s["b"], _digest(key, kind, r, s["a"])).alias("b"))
        return F.when(r % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def permuted_pair(x: Column, y: Column, sizes: tuple[int | Column, int], kind: str | Column, key: str) -> Column:
    """A Feistel permutation of the pairs (x, y), 0 <= x < sizes[0], 0 <= y < sizes[1]."""
    number = lambda r, other: F.conv(F.substr(_digest(key, kind, r, other.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("long")

    def turn(s: Column, r: Column) -> Column:
        left = F.struct(((s["x"] + number(r, s["y"])) % sizes[0]).alias("x"), s["y"].alias("y"))
        right = F.struct(s["x"].alias("x"), ((s["y"] + number(r, s["x"])) % sizes[1]).alias("y"))
        return F.when(r % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last one is the check digit's place."""

    def value(c: Column, i: Column, n: Column) -> Column:
        d = c.cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    cs = F.split(digits, "")
    return let(F.length(digits), lambda n: F.aggregate(F.transform(cs, lambda c, i: value(c, i, n)), F.lit(0), lambda a, b: a + b))


def mod97(s: Column) -> Column:
    """The number that digits and letters (A = 10) spell, mod 97."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def placed(m: Column, value: Column, but: str = "[^A-Za-z0-9]") -> Column:
    """m with the characters of value one by one in place of those that are not `but`: its separators stay."""
    at = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), but, ""))
    one = lambda v: lambda c, i: F.when(c.rlike(but), c).otherwise(F.substr(v, at(i), F.lit(1)))
    return let(value, lambda v: F.array_join(F.transform(F.split(m, ""), one(v)), ""))


def _card(m: Column, key: str) -> Column:
    def check(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    d = _digits(m)
    middle = F.substr(d, F.lit(2), F.length(d) - 2)  # between the first digit and the check digit
    return placed(m, let(F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted(middle, "card", key)), check))


def _iban(m: Column, key: str) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    country = F.left(m, F.lit(2))

    def check(bban: Column) -> Column:
        rest = F.concat(bban, country, F.lit("00"))
        return F.concat(country, F.lpad((98 - mod97(rest)).cast("string"), 2, "0"), bban)

    return placed(m, let(permuted(F.substr(bare, F.lit(5)), "iban", key), check))


def _iban_valid(m: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    return F.length(bare).between(15, 34) & (mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))) == 1)


def _phone(m: Column, key: str) -> Column:
    """Numbers of plan 1, with or without +1, move within [2-9]xx [2-9]xx xxxx (or within the numbers with a 0 or 1
    in the same one of these two places); others keep their country code and the digit after it."""
    t = F.replace(m, F.lit("(0)"), F.lit("(o)"))  # a trunk digit is no part of the number
    code = F.when(t.rlike(r"^\+[02-9]"), F.regexp_extract(_digits(t), f"^(?:{COUNTRY_CODE})", 0)).otherwise(F.when(t.startswith("+"), F.lit("1")).otherwise(F.lit("")))

    def planned(n: Column) -> Column:
        whole = lambda i, k: F.substr(n, F.lit(i), F.lit(k)).cast("long")
        low = lambda i: whole(i, 1) < 2
        size = lambda i: F.when(low(i), F.lit(2)).otherwise(F.lit(8))
        place = lambda i: whole(i, 1) - F.when(low(i), F.lit(0)).otherwise(F.lit(2))
        x = (place(1) * size(4) + place(4)) * 100 + whole(2, 2)
        kind = F.concat(F.lit("phone"), size(1).cast("string"), size(4).cast("string"))
        pair = permuted_pair(x, whole(5, 6), (size(1) * size(4) * 100, 1_000_000), kind, key)

        def spelled(p: Column) -> Column:
            lead = (p["x"] / 100).cast("int")
            digit = lambda v, i: (v + F.when(low(i), F.lit(0)).otherwise(F.lit(2))).cast("string")
            return F.concat(digit((lead / size(4)).cast("int"), 1), F.lpad((p["x"] % 100).cast("string"), 2, "0"), digit(lead % size(4), 4), F.lpad(p["y"].cast("string"), 6, "0"))

        return let(pair, spelled)

    def moved(s: Column) -> Column:
        kept = F.length(s["code"]) + 1
        other = F.concat(F.left(s["d"], kept), permuted(F.substr(s["d"], kept + 1), "phone", key))
        own = F.concat(s["code"], let(F.right(s["d"], F.lit(10)), planned))
        return F.when(s["code"].isin("", "1") & (F.length(s["d"]) == F.length(s["code"]) + 10), own).otherwise(other)

    value = let(F.struct(code.alias("code"), _digits(t).alias("d")), moved)
    return F.replace(placed(t, value, "[^0-9]"), F.lit("(o)"), F.lit("(0)"))


def _ip(m: Column, key: str) -> Column:
    o = lambda s, i: F.get(s, F.lit(i)).cast("long")
    pair = let(F.split(m, "[.]"), lambda s: permuted_pair(o(s, 0) * 256 + o(s, 1), o(s, 2) * 256 + o(s, 3), (65536, 65536), "ip", key))
    half = lambda x: F.concat((x / 256).cast("int").cast("string"), F.lit("."), (x % 256).cast("string"))
    return let(pair, lambda p: F.concat(half(p["x"]), F.lit("."), half(p["y"])))


def _ssn(m: Column, key: str) -> Column:
    area = F.substr(m, F.lit(1), F.lit(3)).cast("int")
    index = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))  # 001 to 899 without 666
    group, serial = F.substr(m, F.lit(5), F.lit(2)).cast("int") - 1, F.substr(m, F.lit(8), F.lit(4)).cast("int") - 1

    def spelled(p: Column) -> Column:
        a = (p["x"] / 99).cast("int")
        a = a + F.when(a >= 665, F.lit(2)).otherwise(F.lit(1))
        part = lambda n, w: F.lpad(n.cast("string"), w, "0")
        return F.concat_ws("-", part(a, 3), part(p["x"] % 99 + 1, 2), part(p["y"] + 1, 4))

    return let(permuted_pair(index * 99 + group, serial, (898 * 99, 9999), "ssn", key), spelled)


def _date_parts(m: Column) -> Column:
    """year, month, day, whether the month stands before the day, whether the year comes first, sep, and whether
    day and month have two digits. Without the year first, the day is first unless the second number is over 12."""
    first = m.rlike("^[0-9]{4}")
    year = F.when(first, F.left(m, F.lit(4))).otherwise(F.right(m, F.lit(4))).cast("int")
    rest = F.split(F.when(first, F.substr(m, F.lit(6))).otherwise(F.left(m, F.length(m) - 5)), "[./-]")
    sep = F.when(first, F.substr(m, F.lit(5), F.lit(1))).otherwise(F.substr(m, F.length(m) - 4, F.lit(1)))

    def read(r: Column) -> Column:
        a, b = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        ahead = first | (b.cast("int") > 12)
        month, day = F.when(ahead, a).otherwise(b).cast("int"), F.when(ahead, b).otherwise(a).cast("int")
        wide = (F.length(a) == 2) & (F.length(b) == 2)
        parts = {"year": year, "month": month, "day": day, "ahead": ahead, "first": first, "sep": sep, "wide": wide}
        return F.struct(*[c.alias(k) for k, c in parts.items()])

    return let(rest, read)


def _is_day(p: Column) -> Column:
    """Whether there is such a day."""
    spelled = F.concat_ws("-", p["year"].cast("string"), _two(p["month"]), _two(p["day"]))
    return F.try_to_date(spelled, "yyyy-MM-dd").isNotNull()


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _late_before(months: Column) -> Column:
    """Number of days after the 12th of a month in the first so many months from FIRST_DAY."""
    start = F.lit(FIRST_DAY).cast("date")
    return F.datediff(F.add_months(start, months), start) - 12 * months


def _moved(p: Column, key: str) -> Column:
    """year, month and day of the pseudonym of a day. Days up to the 12th and later ones are permuted apart, so that
    a month that stands before its day can still be told from a day before its month."""
    months = (p["year"] - FIRST_YEAR) * 12 + p["month"] - 1

    def early(n: Column) -> Column:
        k = (n / 12).cast("int")
        return F.struct(k.alias("k"), (n % 12 + 1).cast("int").alias("day"))

    def late(n: Column) -> Column:
        guess = F.floor(n * MONTHS / LATE_DAYS).cast("int")
        k = F.when(_late_before(guess + 1) <= n, guess + 1).when(_late_before(guess) <= n, guess).otherwise(guess - 1)
        return let(k, lambda k: F.struct(k.alias("k"), (n - _late_before(k) + 13).cast("int").alias("day")))

    def permuted_number(n: Column, sizes: tuple[int, int], kind: str) -> Column:
        pair = permuted_pair((n / sizes[1]).cast("long"), n % sizes[1], sizes, kind, key)
        return let(pair, lambda q: q["x"] * sizes[1] + q["y"])

    moved_early = let(permuted_number(months * 12 + p["day"] - 1, EARLY, "date"), early)
    moved_late = let(permuted_number(_late_before(months) + p["day"] - 13, LATE, "late date"), late)
    return F.when(p["day"] <= 12, moved_early).otherwise(moved_late)


def _moved_date(m: Column, key: str) -> Column:
    """The day's pseudonym, written as m is: every spelling of a day gets a spelling of the same other day."""

    def spelled(p: Column, q: Column) -> Column:
        number = lambda n: F.when(p["wide"], _two(n)).otherwise(n.cast("string"))
        year, month, day = (F.floor(q["k"] / 12) + FIRST_YEAR).cast("string"), number(q["k"] % 12 + 1), number(q["day"])
        rest = F.when(p["ahead"], F.concat_ws("|", month, day)).otherwise(F.concat_ws("|", day, month))
        out = F.when(p["first"], F.concat_ws("|", year, rest)).otherwise(F.concat_ws("|", rest, year))
        return F.replace(out, F.lit("|"), p["sep"])

    return let(_date_parts(m), lambda p: let(_moved(p, key), lambda q: spelled(p, q)))


def _email(m: Column, key: str) -> Column:
    """All but the top-level domain, in lower case; what was upper case is so again."""
    end = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    head = F.substr(m, F.lit(1), F.length(m) - F.length(end))
    other = F.split(permuted(F.lower(head), "email", key), "")
    cased = F.zip_with(F.split(head, ""), other, lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b))
    return F.concat(F.array_join(cased, ""), end)


def kind_of(m: Column) -> Column:
    """The kind of a valid match, null for one that does not validate."""
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    digits = _digits(m)
    kind = F.when(F.contains(m, F.lit("@")), F.lit("email")).when(m.rlike("^[A-Z]"), F.when(_iban_valid(m), F.lit("iban")))
    kind = kind.when(whole("date"), F.when(let(_date_parts(m), _is_day), F.lit("date"))).when(whole("ip"), F.lit("ip")).when(whole("ssn"), F.lit("ssn"))
    kind = kind.when(whole("phone"), F.when(F.length(digits).between(8, 15), F.lit("phone")))
    return kind.otherwise(F.when((luhn_sum(digits) % 10 == 0) & (F.length(F.regexp_replace(digits, "0", "")) > 0), F.lit("card")))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "iban": _iban, "phone": _phone, "ssn": _ssn, "date": _moved_date, "ip": _ip, "card": _card}
    out = F.when(kind.isNull(), m)
    for k, f in made.items():
        out = out.when(kind == k, f(m, key))
    return out.otherwise(m)


KINDS = tuple(PATTERNS)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in their texts, and n_pii and a count for each kind (n_email and so on).

    key: a secret; whoever has it can undo the pseudonyms.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    made = {"n_pii", *(f"n_{k}" for k in KINDS)}
    keep = common.others(docs.columns, made)
    text = docs["text"]
    # a digit next to a digit or an @ stands in every match: most texts are passed over by that
    hits = F.when(text.rlike("@|[0-9][^A-Za-z]?[0-9]"), found(text, ANY)).otherwise(F.array().cast("array<struct<before:string,match:string,after:string>>"))
    x = docs.select(text.alias("text"), common.held(docs, [c for c in keep if c != "text"]), hits.alias("_hits"))
    x = x.withColumn("_kinds", F.transform("_hits", lambda h: kind_of(h["match"])))
    new = F.zip_with("_hits", "_kinds", lambda h, k: pseudonym(h["match"], k, key))
    x = x.withColumn("text", F.when(F.size("_hits") > 0, joined(F.col("_hits"), new)).otherwise(F.col("text")))
    n = lambda k: F.coalesce(F.size(F.filter("_kinds", lambda x: x == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    total = F.when(F.col("_kinds").isNull(), F.lit(0)).otherwise(F.size(F.array_compact("_kinds"))).cast("long").alias("n_pii")
    return x.select(*[F.col("text") if c == "text" else common.released([c])[0] for c in keep], total, *[n(k) for k in KINDS])
