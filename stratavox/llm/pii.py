"""Format-preserving pseudonyms for personal values; DataFrame functions only.

Values are found by one pattern, validated (Luhn sum, IBAN remainder, calendar, number plans, octets)
and permuted by a keyed Feistel network inside the set of valid values of their format, so that a
pseudonym is valid again, equal values get equal pseudonyms in every document, and different ones stay
different.  Card, phone, social security and IP numbers and dates are ranked and split into two
numbers; e-mail names and hosts, IBAN accounts, access keys, secrets and IPv6 addresses are split into
two strings whose characters move within their class.  Each of the eight rounds adds a keyed hash of
one half to the other.  What does not validate stays as it is, but for phone numbers outside the
number plan, which are permuted among themselves.

A format's set is closed under its permutation: dates with slashes, which may be read day or month
first, are one set for each number of digits; hexadecimal digits of a secret stay such.  No pattern
repeats a group without a bound, so the matcher's stack does not grow with a text.

Edge cases, all defined: a null text stays null with 0 values; an empty text stays empty; texts are
read whole; repeated rows get equal results; an empty table gives an empty result; other columns pass
through ``pseudonymise_column`` untouched.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The session setting that holds the key.
KEY_SETTING = "spark.stratavox.pseudonym.key"
#: Stands in where the setting is missing; anyone can invert pseudonyms made with it.
PUBLIC_KEY = "stratavox pseudonyms"
#: Characters that one Feistel network takes; longer strings are permuted piece by piece.
PIECE = 256

#: The formats, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}+",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "access_key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![\w./])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2}:|(?![\w-]))|(?:[0-9]{2}\.[0-9]{2}\.|[0-9]{1,2}/[0-9]{1,2}/)[0-9]{4}(?![\w/-]))",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)",
    "phone_plus": r"(?<![\w+])\+[0-9](?:[ .-]?[0-9]){7,14}(?!\w)",
    "card": r"(?<!\w)[0-9](?:[ -]?[0-9]){12,18}(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any of them holds; texts without it are passed over.
SCREEN = r"[0-9][0-9 /-]|[0-9]\.[0-9]{1,3}\.[0-9]|@|[=:]|A[KS]IA"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters that hexadecimal numbers have, apart from the others: what is hexadecimal stays so.
BY_HEX = (DIGITS, LOWER[:6], LOWER[6:], UPPER[:6], UPPER[6:])


def _let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def key_of(spark: SparkSession) -> str:
    """The key of ``KEY_SETTING``; warns and gives ``PUBLIC_KEY`` where it is not set."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with a public key and can be inverted", stacklevel=2)
    return key or PUBLIC_KEY


def _hash(key: str, kind: str, i: Column, half: Column, block: Column | None = None, piece: Column | None = None) -> Column:
    named = [F.lit(f"{key}|{kind}|")] if piece is None else [F.lit(f"{key}|{kind}"), F.when(piece > 0, F.concat(F.lit("#"), piece.cast("string"))).otherwise(F.lit("")), F.lit("|")]
    parts = [*named, i.cast("string"), F.lit("|"), half.cast("string")]
    if block is not None:
        parts += [F.lit("|"), block.cast("string")]
    return F.sha2(F.concat(*parts), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def feistel_pair(a: Column, b: Column, size_a: Column, size_b: Column, kind: str, key: str, body) -> Column:
    """``body`` of the struct (a, b): a permutation of the pairs below (size_a, size_b)."""

    def step(s: Column, i: Column) -> Column:
        x, y = s["a"], s["b"]
        new_x = (x + _number(F.substring(_hash(key, kind, i, y), 1, 13))) % size_a
        new_y = (y + _number(F.substring(_hash(key, kind, i, x), 1, 13))) % size_b
        return F.when(i % 2 == 0, F.struct(new_x.alias("a"), y.alias("b"))).otherwise(F.struct(x.alias("a"), new_y.alias("b")))

    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step), body)


def _characters(s: Column) -> Column:
    """The characters of ``s``, which should be a bound value: it is evaluated for each of them."""
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda j: F.substr(s, j, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _moved(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    out = c
    for letters in alphabets:
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substr(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def feistel_string(s: Column, kind: str, key: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """A permutation of the strings of one format: each character stays within its alphabet, others stay.

    Pieces of ``PIECE`` characters are permuted each, the later ones by permutations of their own, so that time
    is linear in the length.
    """

    def whole(s: Column, piece: Column) -> Column:
        def added(half: Column, other: Column, i: Column) -> Column:
            def one(c: Column, j: Column) -> Column:
                stream = F.substr(_hash(key, kind, i, other, F.floor(j / 8), piece), (j % 8 * 8 + 1).cast("int"), F.lit(8))
                return _moved(c, _number(stream), alphabets)

            return F.array_join(F.transform(_characters(half), one), "")

        def step(t: Column, i: Column) -> Column:
            x, y = t["a"], t["b"]
            return F.when(i % 2 == 0, F.struct(added(x, y, i).alias("a"), y.alias("b"))).otherwise(F.struct(x.alias("a"), added(y, x, i).alias("b")))

        half = F.floor(F.length(s) / 2).cast("int")
        start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))
        return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda t: F.concat(t["a"], t["b"]))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), whole), "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refilled(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced by ``digits``, in order."""

    def whole(digits: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            at = F.length(_digits(F.substr(s, F.lit(1), (j + 1).cast("int"))))
            return F.when(c.between("0", "9"), F.substr(digits, at, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(_characters(s), one), "")

    return _let(digits, whole)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string, its last digit being the check digit."""

    def whole(digits: Column) -> Column:
        n = F.length(digits)

        def one(total: Column, j: Column) -> Column:
            d = F.substr(digits, j, F.lit(1)).cast("int")
            twice = F.when((n - j) % 2 == 1, d * 2).otherwise(d)
            return total + F.when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), one) % 10

    return _let(digits, whole)


def _power(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("bigint")


def _card(m: Column, key: str) -> Column:
    def valid(digits: Column) -> Column:
        n = F.length(digits) - 1
        u = F.floor(n / 2).cast("int")

        def joined(t: Column) -> Column:
            return F.concat(F.lpad(t["a"].cast("string"), u, F.lit("0")), F.lpad(t["b"].cast("string"), n - u, F.lit("0")))

        new = feistel_pair(F.substr(digits, F.lit(1), u).cast("bigint"), F.substr(digits, u + 1, n - u).cast("bigint"), _power(u), _power(n - u), "card", key, joined)
        checked = _let(new, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn_sum(digits) == 0, _refilled(m, checked)).otherwise(m)

    return _let(_digits(m), valid)


def _phone(m: Column, key: str) -> Column:
    """Numbers of the plan (area and exchange from 200 on) are permuted among themselves, all others too."""

    def valid(digits: Column) -> Column:
        area = F.substr(digits, F.length(digits) - 9, F.lit(3)).cast("bigint")
        rest = F.substr(digits, F.length(digits) - 6, F.lit(7)).cast("bigint")
        country = F.substr(digits, F.lit(1), F.length(digits) - 10)
        joined = lambda t: F.concat(country, (t["a"] + 200).cast("string"), (t["b"] + 2_000_000).cast("string"))
        new = feistel_pair(area - 200, rest - 2_000_000, F.lit(800), F.lit(8_000_000), "phone", key, joined)
        return F.when((area >= 200) & (rest >= 2_000_000), _refilled(m, new)).otherwise(_refilled(m, unplanned(area, rest, country)))

    def unplanned(area: Column, rest: Column, country: Column) -> Column:
        # 200 areas of 10**7 numbers each, then the 2 * 10**6 low numbers of each of the 800 others: 3600 * 10**6
        rank = F.when(area < 200, area * 10_000_000 + rest).otherwise(2_000_000_000 + (area - 200) * 2_000_000 + rest)

        def number(n: Column) -> Column:
            late = n - 2_000_000_000
            return F.when(late < 0, n).otherwise((F.floor(late / 2_000_000) + 200) * 10_000_000 + late % 2_000_000)

        joined = lambda t: F.concat(country, F.lpad(number(t["a"] * 1_000_000 + t["b"]).cast("string"), 10, "0"))
        return feistel_pair(F.floor(rank / 1_000_000), rank % 1_000_000, F.lit(3600), F.lit(1_000_000), "phone_unplanned", key, joined)

    return _let(_digits(m), valid)


def _phone_plus(m: Column, key: str) -> Column:
    return _let(_digits(m), lambda d: _refilled(m, F.concat(F.substr(d, F.lit(1), F.lit(2)), feistel_string(F.substr(d, F.lit(3), F.length(d)), "phone_plus", key))))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(at), F.lit(n)).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    pad = lambda x, n: F.lpad(x.cast("string"), F.lit(n), F.lit("0"))

    def joined(t: Column) -> Column:
        place = F.when(t["a"] < 665, t["a"] + 1).otherwise(t["a"] + 2)
        return F.concat_ws("-", pad(place, 3), pad(F.floor(t["b"] / 9999) + 1, 2), pad(t["b"] % 9999 + 1, 4))

    new = feistel_pair(F.when(area < 666, area - 1).otherwise(area - 2), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key, joined)
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = [F.element_at(F.split(m, r"\."), i).cast("bigint") for i in (1, 2, 3, 4)]
    joined = lambda t: F.concat_ws(".", *(x.cast("string") for x in (F.floor(t["a"] / 256), t["a"] % 256, F.floor(t["b"] / 256), t["b"] % 256)))
    new = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip", key, joined)
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), new).otherwise(m)


def slash_dates() -> dict[tuple[int, int], list[str]]:
    """Per number of digits the strings a/b that are a day and a month, in either order, of every year."""
    last = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    days = [(m + 1, d) for m, n in enumerate(last) for d in range(1, n + 1)]
    out: dict[tuple[int, int], set[str]] = {}
    for a, b in (p for m, d in days for p in ((m, d), (d, m))):
        out.setdefault((2, 2), set()).add(f"{a:02d}/{b:02d}")
        for x, y in ((f"{a}", f"{b}"), (f"{a}", f"{b:02d}"), (f"{a:02d}", f"{b}")):
            if (len(x), len(y)) != (2, 2):
                out.setdefault((len(x), len(y)), set()).add(f"{x}/{y}")
    return {k: sorted(v) for k, v in sorted(out.items())}


#: Years that dates are permuted within, from 1800 on, and those of them with 366 days.
FIRST_YEAR, YEARS = 1800, 400
LEAP = [y for y in range(FIRST_YEAR, FIRST_YEAR + YEARS) if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)]


def _slash_date(m: Column, key: str) -> Column:
    """Dates with slashes: a year and a place in the list of day-and-month strings; 29 February among leap years."""
    head, year = F.substring_index(m, "/", 2), F.substring_index(m, "/", -1).cast("bigint")

    def among(names: list[str], kind: str, years: list[int]) -> tuple[Column, Column]:
        width = len(names[0]) + 1
        table = F.lit("|" + "|".join(names) + "|")
        at = F.instr(table, F.concat(F.lit("|"), head, F.lit("|")))
        nth = _place(year, years)
        moved = lambda t: F.concat(F.substr(table, (t["b"] * width + 2).cast("int"), F.lit(width - 1)), F.lit("/"), _year_at(t["a"], years))
        return (at > 0) & (nth >= 0), feistel_pair(nth, F.floor((at - 1) / width), F.lit(len(years)), F.lit(len(names)), kind, key, moved)

    out = m
    sets = [(f"date/{a}/{b}", names, list(range(FIRST_YEAR, FIRST_YEAR + YEARS))) for (a, b), names in slash_dates().items()]
    sets += [("date/22", ["02/29", "29/02"], LEAP), ("date/12", ["2/29"], LEAP), ("date/21", ["29/2"], LEAP)]
    for kind, names, years in sets:
        valid, new = among(names, kind, years)
        out = F.when(valid, new).otherwise(out)
    return out


def _place(year: Column, years: list[int]) -> Column:
    """The place of a year in a list, -1 where it is not in it."""
    if len(years) == YEARS:
        return F.when(year.between(years[0], years[-1]), year - years[0]).otherwise(F.lit(-1))
    return F.array_position(F.array(*map(F.lit, years)).cast("array<bigint>"), year) - 1


def _year_at(place: Column, years: list[int]) -> Column:
    if len(years) == YEARS:
        return (place + years[0]).cast("string")
    return F.get(F.array(*map(F.lit, years)), place.cast("int")).cast("string")


def _date(m: Column, key: str) -> Column:
    """Days are permuted within the 400 years from 1800 on, which is 189 times 773 days."""
    first = F.lit(f"{FIRST_YEAR}-01-01").cast("date")

    def permuted(layout: str) -> tuple[Column, Column]:
        day = F.try_to_timestamp(m, F.lit(layout)).cast("date")
        n = F.datediff(day, first).cast("bigint")
        valid = F.coalesce((n >= 0) & (n < 189 * 773), F.lit(False))
        moved = lambda t: F.date_format(F.date_add(first, (t["a"] * 773 + t["b"]).cast("int")), layout)
        return valid, feistel_pair(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), "date", key, moved)

    out = F.when(F.contains(m, F.lit("/")), _slash_date(m, key)).otherwise(m)
    for shape, layout in ((r"\.", "dd.MM.yyyy"), (r"^[0-9]{4}-", "yyyy-MM-dd")):
        valid, new = permuted(layout)
        out = F.when(m.rlike(shape) & valid, new).otherwise(out)
    return out


def _mod97(s: Column) -> Column:
    def one(total: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return (total * F.when(v > 9, 100).otherwise(10) + v) % 97

    return _let(s, lambda x: F.aggregate(_characters(x), F.lit(0), one))


def _iban(m: Column, key: str) -> Column:
    """The account moves, the check digits follow; spaces stay."""

    def valid(c: Column) -> Column:
        country, account = F.substr(c, F.lit(1), F.lit(2)), F.substr(c, F.lit(5), F.length(c))
        check = lambda x: F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), F.lit(2), F.lit("0"))
        new = _let(feistel_string(account, "iban", key), lambda x: F.concat(country, check(x), x))
        spaced = _let(new, lambda x: F.when(F.contains(m, F.lit(" ")), F.array_join(F.regexp_extract_all(x, F.lit(".{1,4}"), F.lit(0)), " ")).otherwise(x))
        return F.when(_mod97(F.concat(account, F.substr(c, F.lit(1), F.lit(4)))) == 1, spaced).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), valid)


def _email(m: Column, key: str) -> Column:
    """Name and host move each on its own, so that addresses of one host keep one host; the last label stays."""
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    shape = r"^(.*)(\.[A-Za-z]+)$"
    return F.concat(feistel_string(name, "email", key), F.lit("@"), feistel_string(F.regexp_extract(host, shape, 1), "host", key), F.regexp_extract(host, shape, 2))


def _access_key(m: Column, key: str) -> Column:
    return F.concat(F.substr(m, F.lit(1), F.lit(4)), feistel_string(F.substr(m, F.lit(5), F.lit(16)), "access_key", key))


def _secret(m: Column, key: str) -> Column:
    shape = r"^([^=:]*[=:]\s{0,3}[\"']?)([A-Za-z0-9+/_-]+)$"
    return F.concat(F.regexp_extract(m, shape, 1), feistel_string(F.regexp_extract(m, shape, 2), "secret", key, BY_HEX))


def _ipv6(m: Column, key: str) -> Column:
    return feistel_string(m, "ipv6", key, BY_HEX)


MAKERS = {
    "email": _email, "secret": _secret, "access_key": _access_key, "iban": _iban, "date": _date,
    "ip": _ip, "ipv6": _ipv6, "ssn": _ssn, "phone": _phone, "phone_plus": _phone_plus, "card": _card,
}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found value, by the first format that it has."""
    out = m
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), MAKERS[kind](m, key)).otherwise(out)
    return out


def pseudonymise(text: Column, key: str) -> Column:
    """Struct (text, n_values): the text with its values replaced, and how many were."""

    def replaced(found: Column) -> Column:
        return _let(F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))), joined)

    def joined(new: Column) -> Column:
        pieces = F.zip_with(F.split(text, ANY, -1), new, lambda g, v: F.concat(F.coalesce(g, F.lit("")), F.coalesce(v["new"], F.lit(""))))
        count = F.size(F.filter(new, lambda v: v["old"] != v["new"]))
        return F.struct(F.array_join(pieces, "").alias("text"), count.cast("bigint").alias("n_values"))

    as_is = F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n_values"))
    return F.when(text.rlike(SCREEN), _let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)).otherwise(as_is)


def pseudonymise_texts(docs: DataFrame, key: str) -> DataFrame:
    """Per row: doc_id, text with pseudonyms and n_values."""
    done = docs.select("doc_id", F.inline(F.array(pseudonymise(F.col("text"), key))))
    return done.select("doc_id", "text", "n_values")


def pseudonymise_column(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all other columns as they are."""
    return docs.withColumn("text", pseudonymise(F.col("text"), key)["text"])
