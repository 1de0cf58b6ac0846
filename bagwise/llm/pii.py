"""Personal data replaced by format-preserving Feistel pseudonyms, in built-in functions only.

A value is found by its pattern, validated (Luhn and mod-97 sums, octets, real dates, assignable numbers),
taken apart into digits of mixed radices, permuted by a keyed Feistel network and put back into its format.
The permutation depends on the key and the format alone, so equal values stay equal in every document,
different values stay different, and results are valid values of the same kind. A form that can be read in
two ways, such as 03/04/1999, is permuted among the forms that can. Phone numbers are permuted behind their
country code, whatever separates their digits. IPv6 addresses and names are not looked for.

A round adds to every digit of one half a keyed hash of the other half, modulo the digit's radix, which
the same round with a minus sign undoes: the network is a permutation for any radices and halves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import table, text_of

ROUNDS = 8
#: Example of a key; pass your own from a secret store.
KEY = "demonstration key"
#: Days from 1900-01-01 to 2099-12-31, as a product of two radices.
DAYS = (319, 229)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def feistel(digits: Column, radices: Column, key: str, kind: str) -> Column:
    """Permute an array of any number of ints, each below its radix."""
    half = F.floor((F.size(digits) + 1) / 2).cast("int")
    rest = F.size(digits) - half

    def stream(digest: Column, place: Column) -> Column:
        """Sixteen bits per digit: 32 from the digest, further ones from digests of it."""
        block = F.floor(place / 32)
        further = F.sha2(F.concat(digest, F.lit("|"), block.cast("string")), 512)
        four = F.substr(F.when(block == 0, digest).otherwise(further), ((place % 32) * 4 + 1).cast("int"), F.lit(4))
        return F.conv(four, 16, 10).cast("int")

    def mixed(own: Column, base: Column, other: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), F.array_join(other.cast("array<string>"), ","))

        def added(digest: Column) -> Column:
            moved = F.transform(own, lambda d, j: d + stream(digest, j))
            return F.zip_with(moved, base, lambda x, r: (x % r).cast("int"))

        # One element stands for a variable: the other half is hashed once.
        return F.flatten(F.transform(F.array(F.sha2(seed, 512)), added))

    low, high = F.slice(radices, F.lit(1), half), F.slice(radices, half + 1, rest)
    start = F.struct(F.slice(digits, F.lit(1), half).alias("a"), F.slice(digits, half + 1, rest).alias("b"))

    def step(state: Column, turn: Column) -> Column:
        return F.when(
            turn % 2 == 0, F.struct(mixed(state.a, low, state.b, turn).alias("a"), state.b.alias("b"))
        ).otherwise(F.struct(state.a.alias("a"), mixed(state.b, high, state.a, turn).alias("b")))

    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, start, step, lambda s: F.concat(s.a, s.b))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _ints(s: Column) -> Column:
    return _chars(s).cast("array<int>")


def _tens(digits: Column, radix: int = 10) -> Column:
    return F.transform(digits, lambda _: F.lit(radix))


def _luhn_sum(digits: Column) -> Column:
    """Sum with every second digit from the right doubled, the last one counted singly."""
    return F.aggregate(
        F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)),
        F.lit(0),
        lambda a, d: a + d,
    )


def _is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _is_letter(c: Column) -> Column:
    return F.lower(c).between("a", "z")


def _put(mould: Column, places: Callable[[Column], Column], new: Column) -> Column:
    """The mould with the characters of ``new`` in its places, in order; linear but for one sort."""
    chars = F.transform(_chars(mould), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    swapped = F.zip_with(F.filter(chars, lambda x: places(x.c)), new, lambda x, c: F.struct(x.i.alias("i"), c.alias("c")))
    whole = F.array_sort(F.concat(swapped, F.filter(chars, lambda x: ~places(x.c))))
    return F.array_join(F.transform(whole, lambda x: x.c), "")


def _into(mould: Column, digits: Column) -> Column:
    """Put digits where the mould has digits."""
    return _put(mould, _is_digit, digits.cast("array<string>"))


def _values(chars: Column) -> Column:
    """Digits as 0 to 9 and letters as 0 to 25."""
    return F.transform(chars, lambda c: F.when(_is_digit(c), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97).cast("int"))


def _radices(chars: Column) -> Column:
    return F.transform(chars, lambda c: F.when(_is_digit(c), 10).otherwise(26))


def _like(values: Column, chars: Column) -> Column:
    """Values written as the kind of character they had: digits, small or capital letters."""
    return F.zip_with(values, chars, lambda v, c: (
        F.when(_is_digit(c), v.cast("string")).when(c.between("a", "z"), F.chr(v + 97)).otherwise(F.chr(v + 65))
    ))


def _digits(s: Column) -> Column:
    return _ints(F.regexp_replace(s, "[^0-9]", ""))


def _card(s: Column, key: str) -> Column:
    digits = _digits(s)
    body = F.slice(digits, F.lit(1), F.size(digits) - 1)
    new = feistel(body, _tens(body), key, "card")
    check = (10 - _luhn_sum(F.concat(new, F.array(F.lit(0)))) % 10) % 10
    valid = (_luhn_sum(digits) % 10 == 0) & F.size(digits).between(13, 19)
    return F.when(valid, _into(s, F.concat(new, F.array(check.cast("int")))))


#: Country calling codes of one and of two digits; all others have three.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98",
)


def _phone(s: Column, key: str) -> Column:
    """The country code stays; the digits behind it are one number, however they are grouped."""
    digits = _digits(s)
    head = lambda n: F.substr(F.regexp_replace(s, "[^0-9]", ""), F.lit(1), F.lit(n))
    own = F.when(head(1).isin(*ONE_DIGIT_CODES), 1).when(head(2).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
    code = F.when(s.startswith("+"), own).otherwise(0)
    national = F.slice(digits, code + 1, F.size(digits))
    return _into(s, F.concat(F.slice(digits, F.lit(1), code), feistel(national, _tens(national), key, "phone")))


def _ipv4(s: Column, key: str) -> Column:
    """Octets from 0 to 255. Where some have leading zeros, every octet keeps its width and its zeros."""
    parts = F.split(s, r"\.")
    octets = parts.cast("array<int>")
    plain = F.array_join(feistel(octets, _tens(octets, 256), key, "ipv4").cast("array<string>"), ".")
    padded = F.exists(parts, lambda p: p.rlike("^0[0-9]"))
    # Behind a leading zero any digits may stand; other octets are from the least number of their width.
    least = F.transform(parts, lambda p: F.when(p.rlike("^0[0-9]"), 0).when(F.length(p) == 1, 0).when(F.length(p) == 2, 10).otherwise(100))
    room = F.transform(parts, lambda p: (
        F.when(p.rlike("^0[0-9]{2}"), 100).when(p.rlike("^0[0-9]") | (F.length(p) == 1), 10).when(F.length(p) == 2, 90).otherwise(156)
    ))
    moved = feistel(F.zip_with(octets, least, lambda o, n: o - n), room, key, "ipv4 with zeros")
    value = F.zip_with(moved, least, lambda m, n: (m + n).cast("string"))
    wide = F.array_join(F.zip_with(value, parts, lambda v, p: F.lpad(v, F.length(p), "0")), ".")
    return F.when(F.forall(octets, lambda o: o < 256), F.when(padded, wide).otherwise(plain))


#: Countries whose account numbers have this form.
IBAN_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO "
    "KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
).split()


def _iban(s: Column, key: str) -> Column:
    """Country and grouping stay; letters and digits of the account change in kind, and the check digits follow."""
    chars = F.filter(_chars(s), lambda c: c != " ")
    country, account = F.slice(chars, 1, 2), F.slice(chars, F.lit(5), F.size(chars))

    def remainder(parts: Column) -> Column:
        number = lambda c: F.when(_is_digit(c), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.aggregate(parts, F.lit(0), lambda a, c: ((a * F.when(_is_digit(c), 10).otherwise(100) + number(c)) % 97).cast("int"))

    valid = (remainder(F.concat(account, F.slice(chars, 1, 4))) == 1) & F.size(chars).between(15, 34)
    new = _like(feistel(_values(account), _radices(account), key, "iban"), account)
    check = F.lpad((98 - remainder(F.concat(new, country, F.array(F.lit("0"), F.lit("0"))))).cast("string"), 2, "0")
    return F.when(valid, _put(s, lambda c: c != " ", F.concat(country, _chars(check), new)))


def _ssn(s: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    part = F.split(s, "-").cast("array<int>")
    area, group, serial = part[0], part[1], part[2]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = feistel(place, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    back = F.transform(F.array(new), lambda x: F.format_string(
        "%03d-%02d-%04d", F.when(x[0] >= 665, x[0] + 2).otherwise(x[0] + 1), x[1] + 1, x[2] + 1))
    return F.when(valid, back[0])


#: The years of slashed dates, and the months of 31 days.
FIRST_YEAR, YEARS = 1900, 200
LONG_MONTHS = (1, 3, 5, 7, 8, 10, 12)


def _day_behind_the_twelfth(year: Column, month: Column, day: Column, key: str, kind: str) -> Column:
    """``y, m, d`` as an array, permuted among dates of the same class, all of which exist.

    Classes: days 13 to 28; days 29 and 30 outside February; 31sts; 29ths of February.
    """
    y = year - FIRST_YEAR
    lits = lambda *n: F.array(*[F.lit(x) for x in n])
    early = feistel(F.array(y, month - 1, day - 13), lits(YEARS, 12, 16), key, f"{kind} to 28")
    late = feistel(F.array(y, F.when(month > 2, month - 2).otherwise(0), day - 29), lits(YEARS, 11, 2), key, f"{kind} 29 and 30")
    long = lits(*LONG_MONTHS)
    last = feistel(F.array(y, (F.array_position(long, month) - 1).cast("int")), lits(YEARS, len(LONG_MONTHS)), key, f"{kind} 31")
    leap = F.floor((year - FIRST_YEAR) / 4 - 1).cast("int")  # 1904 is the first of 49
    leaps = feistel(F.array(F.floor(leap / 7).cast("int"), leap % 7), lits(7, 7), key, f"{kind} leap days")
    one = lambda a, f: F.transform(F.array(a), f)[0]
    as_int = lambda *c: F.array(*[x.cast("int") for x in c])
    return (
        F.when(day <= 28, one(early, lambda n: as_int(n[0] + FIRST_YEAR, n[1] + 1, n[2] + 13)))
        .when((day <= 30) & (month != 2), one(late, lambda n: as_int(n[0] + FIRST_YEAR, n[1] + F.when(n[1] > 0, 2).otherwise(1), n[2] + 29)))
        .when((day == 31) & F.array_contains(long, month), one(last, lambda n: as_int(n[0] + FIRST_YEAR, F.get(long, n[1]), F.lit(31))))
        .when(
            (day == 29) & (month == 2) & (year % 4 == 0) & (year != 1900),
            one(leaps, lambda n: as_int((n[0] * 7 + n[1] + 1) * 4 + FIRST_YEAR, F.lit(2), F.lit(29))),
        )
    )


def _slashed(s: Column, key: str) -> Column:
    """Two numbers and a year. Which is the day can be told only where one is above 12."""
    part = F.split(s, "/").cast("array<int>")
    a, b, year = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.get(part, F.lit(2))
    written = lambda x, y, z: F.format_string("%02d/%02d/%04d", x, y, z)
    either = feistel(F.array(a - 1, b - 1, year - FIRST_YEAR), F.array(F.lit(12), F.lit(12), F.lit(YEARS)), key, "either day or month")
    month_first = _day_behind_the_twelfth(year, a, b, key, "month first")
    day_first = _day_behind_the_twelfth(year, b, a, key, "day first")
    one = lambda n, f: F.get(F.transform(F.filter(F.array(n), lambda x: x.isNotNull()), f), F.lit(0))
    in_range = year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1) & (a >= 1) & (b >= 1)
    return F.when(
        in_range,
        F.when((a <= 12) & (b <= 12), one(either, lambda n: written(n[0] + 1, n[1] + 1, n[2] + FIRST_YEAR)))
        .when(a <= 12, one(month_first, lambda n: written(n[1], n[2], n[0])))
        .when(b <= 12, one(day_first, lambda n: written(n[2], n[1], n[0]))),
    )


def _date(s: Column, key: str) -> Column:
    """Days are permuted among all days; where the order of day and month is open, see :func:`_slashed`."""

    def permuted(pattern: str) -> Column:
        day = F.try_to_timestamp(s, F.lit(pattern)).cast("date")
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))
        pair = F.array(F.floor(n / DAYS[1]).cast("int"), (n % DAYS[1]).cast("int"))
        new = F.aggregate(
            feistel(pair, F.array(*[F.lit(r) for r in DAYS]), key, "date"), F.lit(0), lambda a, d: a * DAYS[1] + d
        )
        valid = n.between(0, DAYS[0] * DAYS[1] - 1) & (F.date_format(day, pattern) == s)
        return F.when(valid, F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), new), pattern))

    days = F.coalesce(*[permuted(p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "d.M.yyyy")])
    return F.when(s.rlike("^[0-9]{2}/"), _slashed(s, key)).otherwise(days)


def _email(s: Column, key: str) -> Column:
    """Letters and digits of the local part change within their kind; case and the domain stay."""
    local, domain = F.substring_index(s, "@", 1), F.concat(F.lit("@"), F.substring_index(s, "@", -1))
    known = lambda c: _is_digit(c) | _is_letter(c)
    chars = F.filter(_chars(local), known)
    return F.concat(_put(local, known, _like(feistel(_values(chars), _radices(chars), key, "email"), chars)), domain)


@dataclass(frozen=True)
class Kind:
    """A pattern, and what a valid match becomes; null means the match was not valid and stays."""

    name: str
    pattern: str
    pseudonym: Callable[[Column, str], Column]


#: Order matters where patterns could meet: the first kind takes its match out of the others' sight.
KINDS = (
    # A run of these characters is tried at its start only, and never backwards.
    Kind("email", r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{'|'.join(IBAN_COUNTRIES)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])", _iban),
    Kind("ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _ipv4),
    Kind("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])", _date),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    Kind("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])", _phone),
    Kind("card", r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])", _card),
)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id``, the text with pseudonyms, and how many values of each kind were replaced.

    The text is cut once at all matches; only matches are worked on. Null text stays null with counts
    of 0; repeated rows stay repeated; other columns are not read. Matches that do not validate (a card
    number with a wrong sum, a 31st of February, an octet above 255) are left as they are.
    """
    either = "|".join(f"(?:{k.pattern})" for k in KINDS)
    some = F.col("text").rlike("[0-9]|@")
    found = docs.select(
        "doc_id",
        "text",
        F.when(some, F.regexp_extract_all("text", F.lit(f"({either})"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("_found"),
    )
    told = found.withColumn(
        "_told",
        F.transform(
            "_found",
            lambda s: F.coalesce(
                *[F.when(s.rlike(f"^(?:{k.pattern})$"), F.struct(F.lit(k.name).alias("kind"), k.pseudonym(s, key).alias("new"))) for k in KINDS]
            ),
        ),
    )
    pieces = F.split("text", either, -1)
    middles = F.zip_with("_found", "_told", lambda s, t: F.coalesce(t["new"], s))
    joined = F.array_join(F.flatten(F.zip_with(pieces, middles, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")

    def count(kind: str) -> Column:
        return F.size(F.filter("_told", lambda t: (t.kind == kind) & t["new"].isNotNull())).cast("long").alias(f"n_{kind}")

    counts = [count(k.name) for k in KINDS]
    return told.select("doc_id", F.when(F.size("_found") > 0, joined).otherwise(F.col("text")).alias("text"), *counts)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
