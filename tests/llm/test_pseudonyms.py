"""Pseudonyms beside a plain restatement, and what must hold of all values of a kind."""

import calendar
import datetime
import hashlib
import itertools
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from bagwise.llm import pii  # noqa: E402
from bagwise.llm.queries import QUERIES  # noqa: E402

KEY = pii.KEY


def feistel(digits, radices, kind):
    half = (len(digits) + 1) // 2
    a, b = list(digits[:half]), list(digits[half:])
    low, high = radices[:half], radices[half:]

    def mixed(own, base, other, turn):
        h = hashlib.sha512(f"{KEY}|{kind}|{turn}|{','.join(map(str, other))}".encode()).hexdigest()
        blocks = [h] + [hashlib.sha512(f"{h}|{i}".encode()).hexdigest() for i in range(1, len(own) // 32 + 1)]
        return [(d + int(blocks[j // 32][j % 32 * 4 : j % 32 * 4 + 4], 16)) % r for j, (d, r) in enumerate(zip(own, base))]

    for turn in range(8):
        if turn % 2 == 0:
            a = mixed(a, low, b, turn)
        else:
            b = mixed(b, high, a, turn)
    return a + b


def put(mould, inside, new):
    new = iter(new)
    return "".join(str(next(new)) if inside(c) else c for c in mould)


def ascii_alnum(c):
    return c.isascii() and c.isalnum()


def in_kind(chars, kind):
    values = [int(c) if c.isdigit() else ord(c.lower()) - 97 for c in chars]
    new = feistel(values, [10 if c.isdigit() else 26 for c in chars], kind)
    return [str(v) if c.isdigit() else chr(v + (97 if c.islower() else 65)) for v, c in zip(new, chars)]


def luhn_sum(d):
    d = d[::-1]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]])


def email(s):
    local, domain = s.split("@")
    return put(local, ascii_alnum, in_kind([c for c in local if ascii_alnum(c)], "email")) + "@" + domain


def mod97(chars):
    return int("".join(str(int(c, 36)) for c in chars)) % 97


def iban(s):
    chars = [c for c in s if c != " "]
    if not 15 <= len(chars) <= 34 or mod97(chars[4:] + chars[:4]) != 1:
        return None
    new = in_kind(chars[4:], "iban")
    check = f"{98 - mod97(new + chars[:2] + ['0', '0']):02d}"
    return put(s, lambda c: c != " ", chars[:2] + list(check) + new)


def ipv4(s):
    parts = s.split(".")
    octets = list(map(int, parts))
    if max(octets) > 255:
        return None
    zero = [len(p) > 1 and p[0] == "0" for p in parts]
    if not any(zero):
        return ".".join(map(str, feistel(octets, [256] * 4, "ipv4")))
    least = [0 if z else {1: 0, 2: 10, 3: 100}[len(p)] for p, z in zip(parts, zero)]
    room = [10 ** (len(p) - 1) if z else {1: 10, 2: 90, 3: 156}[len(p)] for p, z in zip(parts, zero)]
    moved = feistel([o - n for o, n in zip(octets, least)], room, "ipv4 with zeros")
    return ".".join(str(m + n).zfill(len(p)) for m, n, p in zip(moved, least, parts))


def late_day(y, m, d, kind):
    if d <= 28:
        y, m, d = feistel([y - 1900, m - 1, d - 13], [200, 12, 16], f"{kind} to 28")
        return y + 1900, m + 1, d + 13
    if d <= 30 and m != 2:
        y, m, d = feistel([y - 1900, m - 2 if m > 2 else 0, d - 29], [200, 11, 2], f"{kind} 29 and 30")
        return y + 1900, m + 2 if m else 1, d + 29
    months = [1, 3, 5, 7, 8, 10, 12]
    if d == 31 and m in months:
        y, m = feistel([y - 1900, months.index(m)], [200, 7], f"{kind} 31")
        return y + 1900, months[m], 31
    if (d, m) == (29, 2) and calendar.isleap(y):
        n = (y - 1904) // 4
        a, b = feistel([n // 7, n % 7], [7, 7], f"{kind} leap days")
        return 1904 + 4 * (a * 7 + b), 2, 29
    return None


def date(s):
    start = datetime.date(1900, 1, 1)
    if re.match("[0-9]{2}/", s):
        a, b, y = map(int, s.split("/"))
        if not (1900 <= y < 2100 and a and b):
            return None
        if a <= 12 and b <= 12:
            a, b, y = feistel([a - 1, b - 1, y - 1900], [12, 12, 200], "either day or month")
            return f"{a + 1:02d}/{b + 1:02d}/{y + 1900}"
        if a <= 12:
            found = late_day(y, a, b, "month first")
            return found and f"{found[1]:02d}/{found[2]:02d}/{found[0]}"
        found = late_day(y, b, a, "day first") if b <= 12 else None
        return found and f"{found[2]:02d}/{found[1]:02d}/{found[0]}"
    parts = re.split("[-/.]", s)
    dotted = "." in s
    y, m, d = map(int, parts[::-1] if dotted else parts)
    wide = dotted and len(parts[0]) == len(parts[1]) == 2
    if dotted and not wide and (parts[0] != str(d) or parts[1] != str(m)):
        return None
    try:
        n = (datetime.date(y, m, d) - start).days
    except ValueError:
        return None
    if not 0 <= n < 319 * 229:
        return None
    a, b = feistel([n // 229, n % 229], [319, 229], "date")
    new = start + datetime.timedelta(a * 229 + b)
    if dotted:
        return f"{new.day:02d}.{new.month:02d}.{new.year}" if wide else f"{new.day}.{new.month}.{new.year}"
    return new.strftime("%Y-%m-%d" if "-" in s else "%Y/%m/%d")


def ssn(s):
    a, g, n = map(int, s.split("-"))
    if not 1 <= a <= 899 or a == 666 or not g or not n:
        return None
    a, g, n = feistel([a - 2 if a > 666 else a - 1, g - 1, n - 1], [898, 99, 9999], "ssn")
    return f"{a + 2 if a >= 665 else a + 1:03d}-{g + 1:02d}-{n + 1:04d}"


def phone(s):
    digits = [c for c in s if c.isdigit()]
    code = 0
    if s[0] == "+":
        code = 1 if digits[0] in "17" else 2 if "".join(digits[:2]) in pii.TWO_DIGIT_CODES else 3
    return put(s, str.isdigit, digits[:code] + feistel(list(map(int, digits[code:])), [10] * (len(digits) - code), "phone"))


def card(s):
    d = [int(c) for c in s if c.isdigit()]
    if luhn_sum(d) % 10:
        return None
    new = feistel(d[:-1], [10] * (len(d) - 1), "card")
    return put(s, str.isdigit, new + [-luhn_sum(new + [0]) % 10])


PLAIN = {"email": email, "iban": iban, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}


def plain(text):
    counts = dict.fromkeys(PLAIN, 0)

    def swapped(found):
        s = found[0]
        name = next(k.name for k in pii.KINDS if re.fullmatch(k.pattern, s))
        new = PLAIN[name](s)
        counts[name] += new is not None
        return s if new is None else new

    return re.sub("|".join(f"(?:{k.pattern})" for k in pii.KINDS), swapped, text), counts


def replaced(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.pseudonymise(rows).collect(), key=lambda r: r.doc_id)]


def test_whole_table_as_restated(spark, small):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    rows = QUERIES["op4_pii"](spark, small).collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_phone + r.n_card for r in rows)
    for r in rows:
        text, counts = plain(docs[r.doc_id]) if docs[r.doc_id] is not None else (None, dict.fromkeys(PLAIN, 0))
        assert (r.text, {k: r[f"n_{k}"] for k in PLAIN}) == (text, counts)


ODD = [
    "DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819, not DE88 3704 0044 0532 0130 00",
    "01.2.3.4 1.2.3.4 010.20.003.255 255.255.255.255 256.1.1.1 192.168.001.1",
    "2024/02/29 2023/02/29 9.2.2024 09.02.2024 09.2.2024 31.4.2024 1.1.1899 29/02/1900 02/29/2000 13/13/2000 00/05/1999",
    "+1 017 555 7713, +10175557713, (017) 555-7713, 017-555-7713, +49 30 1234 5678, +49-30-12345678, +352 26 123 456",
    "..a.b@x.com " + "a1" * 300 + "@long.example.org Jürgen.Müller@post.de x@y " + "A-" * 40 + "b@c.de",
    "4111-1111 1111 1111; 4111 1111 1111 1112 ID12 4111 1111 1111 1111",
    "123-45-6789 666-45-6789 667-01-0001 899-99-9999 900-01-0001",
]


def test_odd_values_as_restated(spark):
    assert replaced(spark, ODD) == [plain(t)[0] for t in ODD]


def test_equal_phone_numbers_stay_linked(spark):
    out = replaced(spark, [ODD[3]])[0].split(", ")
    digits = [re.sub("[^0-9]", "", s) for s in out]
    assert digits[0] == digits[1] and digits[0][0] == "1" and digits[2] == digits[3] == digits[0][1:]
    assert digits[4] == digits[5] and digits[4].startswith("49") and digits[6].startswith("352")


def test_account_numbers_stay_valid(spark):
    out = replaced(spark, [ODD[0]])[0]
    found = re.findall(r"(?:DE|GB)[0-9A-Z ]+[0-9]", out)
    assert [iban_valid(f) for f in found] == [True, True, False] and "DE89" not in out and "DE88 3704" in out
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", found[0]) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", found[1])


def iban_valid(s):
    chars = s.replace(" ", "")
    return mod97(chars[4:] + chars[:4]) == 1


@pytest.mark.parametrize("form", ["{m:02d}/{d:02d}/{y}", "{d:02d}/{m:02d}/{y}"])
def test_every_slashed_date_has_a_pseudonym_of_its_own(spark, form):
    """All days of two centuries in one spelling, with all ambiguous ones of the other."""
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(73049)]
    given = sorted({form.format(y=x.year, m=x.month, d=x.day) for x in days} | {f"{a:02d}/{b:02d}/{y}" for a, b, y in itertools.product(range(1, 13), range(1, 13), range(1900, 2100))})
    out = replaced(spark, given)
    assert len(set(out)) == len(given) and set(out) == set(given)


@pytest.mark.parametrize("separator, parts", [(".", "dmy"), ("-", "ymd"), ("/", "ymd")])
def test_other_dates_have_pseudonyms_of_their_own(spark, separator, parts):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(0, 73049, 7)]
    given = [separator.join({"d": f"{x.day:02d}", "m": f"{x.month:02d}", "y": str(x.year)}[p] for p in parts) for x in days]
    assert len(set(replaced(spark, given))) == len(given)


def test_long_local_parts_are_replaced(spark):
    values = ["a" * 70 + "@x.com", "a" * 69 + "b@x.com", "B7" * 10_000 + "@x.com"]
    out = replaced(spark, values)
    assert out == [email(v) for v in values] and len(set(out) | set(values)) == 6


def test_long_runs_take_no_time(spark):
    begin = datetime.datetime.now()
    text = "a" * 400_000 + " " + "1" * 400_000 + " " + "a." * 200_000
    assert replaced(spark, [text]) == [text]
    assert (datetime.datetime.now() - begin).total_seconds() < 60
