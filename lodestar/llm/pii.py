"""PII: format-preserving Feistel pseudonyms, in SQL expressions only.

Found are e-mail addresses, IBANs, payment cards, IPv4 addresses, social security numbers, phone numbers and dates. A
find counts only if it is valid (check digits, octet ranges, assignable areas, calendar), and is replaced by the image
of its value under a keyed permutation of the values of its format, so equal values get equal pseudonyms in all
documents and different values different ones.

Two Feistel networks do this. Characters: the letters and digits of a value are cut in two halves; each round adds to
every character of one half, within its alphabet, an amount drawn from the SHA-512 of key, round and the other half
(cards without check digit, IBANs without check digits, e-mail names, other phone numbers). Numbers: a value is a pair
in Z_a x Z_b, and each round adds to one part an amount drawn from the SHA-256 of key, round and the other part
(addresses: 65536 x 65536; social security numbers: 88902 x 9999; North American phone numbers: 800 x 8000000; dates:
the 146097 days of a 400-year cycle, 189 x 773). Check digits are computed anew; separators and layout stay.

Defined results: null text stays null, empty text empty; texts of any length are read whole; repeated rows get equal
results; an empty table gives an empty result; other columns are kept by pseudonymise(); columns of the result's names
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import free_names

ROUNDS = 8
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
#: Characters of an IBAN by country (registry and countries that use the form).
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: At its country's length, so that it ends before the next word; of any length for other countries or lengths.
_IBAN = (
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:(?:" + "|".join(_iban_of(n, c) for n, c in _IBAN_LENGTHS.items())
    + r")|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
_IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
_AMERICAN = r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
_ABROAD = r"(?<![0-9A-Za-z+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])"
_ANY = "|".join([_EMAIL, _IBAN, _IPV4, _DATE, _SSN, _CARD, _AMERICAN, _ABROAD])


def _between(x: Column, low: int, high: int) -> Column:
    return (x >= low) & (x <= high)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _position(at: Column) -> Column:
    return F.sequence(F.lit(1), at)


# ---------------------------------------------------------------- the two networks


def _shift(c: Column, by: Column) -> Column:
    code = F.ascii(c)
    turn = lambda first, size: F.char((first + (code - first + by) % size).cast("int"))
    return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)


def permute_characters(text: Column, key: str, kind: str) -> Column:
    """Feistel network on the characters of text: letters stay letters, digits stay digits. Each half is
    moved by 32 amounts drawn from the whole other half, which begin anew after every 32 characters."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def add(own: Column, other: Column, step: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other), 512)
        moved = F.transform(_chars(own), lambda c, k: _shift(c, F.conv(F.substring(noise, (k % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")))
        return F.array_join(moved, "")

    def one(a: Column, step: Column) -> Column:
        even = step % 2 == 0
        return F.struct(
            F.when(even, add(a["l"], a["r"], step)).otherwise(a["l"]).alias("l"), F.when(even, a["r"]).otherwise(add(a["r"], a["l"], step)).alias("r")
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one, lambda a: F.concat(a["l"], a["r"]))


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Feistel network on Z_a x Z_b: struct l, r."""

    def amount(other: Column, step: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(noise, 1, 15), 16, 10).cast("long")

    def one(s: Column, step: Column) -> Column:
        even = step % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + amount(s["r"], step)) % a).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + amount(s["l"], step)) % b).alias("r")
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)


def _lay_out(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by the given ones, in order."""
    put = lambda c, k: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), k + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(_chars(shape), put), "")


def _with(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


# ---------------------------------------------------------------- formats: each gives the pseudonym, or null if not valid


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits, the last one counted once."""
    def add(d, k):
        x = d.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), add), F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    def make(d):
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        return _with(permute_characters(body, key, "card"), lambda p: _lay_out(m, F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))))

    d = _digits(m)
    return F.when(_between(F.length(d), 13, 19) & ~m.rlike(r"[+().]") & (_luhn(d) % 10 == 0), _with(d, make))


def _mod97(text: Column) -> Column:
    """Remainder of the number that letters (10 to 35) and digits spell."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(text), F.lit(0).cast("int"), lambda a, c: ((a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def _iban(m: Column, key: str) -> Column:
    bare = F.regexp_replace(m, " ", "")
    country, body = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    valid = _mod97(F.concat(body, F.substring(bare, 1, 4))) == 1

    def make(p):
        new = F.concat(country, F.lpad((98 - _mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p)
        put = lambda c, k: F.when(c == " ", c).otherwise(F.substring(new, F.length(F.regexp_replace(F.substring(m, F.lit(1), k + 1), " ", "")), F.lit(1)))
        return F.array_join(F.transform(_chars(m), put), "")

    return F.when(m.rlike("^(?:" + _IBAN + ")$"), F.when(valid, _with(permute_characters(body, key, "iban"), make)))


def _ipv4(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    valid = m.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$")

    def make(p):
        swapped = permute_pair(F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), 65536, 65536, key, "ipv4")
        octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
        return F.when(F.array_max(p) <= 255, _with(swapped, lambda s: F.concat_ws(".", octets(s["l"]), octets(s["r"]))))

    return F.when(valid, _with(part, make))


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    rank = F.when(area < 666, area - 1).otherwise(area - 2)

    def make(s):
        a = F.floor(s["l"] / 99)
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", pad(F.when(a < 665, a + 1).otherwise(a + 2), 3), pad(s["l"] % 99 + 1, 2), pad(s["r"] + 1, 4))

    return F.when(valid, _with(permute_pair(rank * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), make))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    ten = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    american = ten.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & m.rlike("^(?:" + _AMERICAN + ")$") & m.rlike("[^0-9]")

    def make(s):
        new = F.concat((s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string"))
        return _lay_out(m, F.concat(F.when(F.length(d) == 11, "1").otherwise(""), new))

    pair = permute_pair(F.substring(ten, 1, 3).cast("long") - 200, F.substring(ten, 4, 7).cast("long") - 2_000_000, 800, 8_000_000, key, "phone")
    other = m.startswith("+") & _between(F.length(d), 8, 15)
    abroad = _with(permute_characters(F.substring(d, F.lit(3), F.length(d)), key, "phone"), lambda p: _lay_out(m, F.concat(F.substring(d, 1, 2), p)))
    return F.when(american, _with(pair, make)).when(other, abroad)


_FIRST_DAY = "DATE'1800-01-01'"
_CYCLE = 146_097


def _date(m: Column, key: str) -> Column:
    """ISO dates, and day-month-year with points or slashes; a slashed date that is none is read as month-day-year."""
    part = F.split(m, "[./-]")
    iso = m.rlike("^[0-9]{4}-")
    at = lambda k: F.get(part, F.lit(k)).cast("int")
    make_date = lambda y, mo, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
    little = make_date(at(2), at(1), at(0))
    swapped = little.isNull() & m.contains("/")
    day = F.when(iso, make_date(at(0), at(1), at(2))).otherwise(F.coalesce(little, F.when(swapped, make_date(at(2), at(0), at(1)))))

    def make(n):
        cycle, place = F.floor(n / _CYCLE), F.pmod(n, F.lit(_CYCLE))
        moved = permute_pair(F.floor(place / 773), place % 773, 189, 773, key, "date")
        return _with(moved, lambda s: _with(F.date_add(F.expr(_FIRST_DAY), (cycle * _CYCLE + s["l"] * 773 + s["r"]).cast("int")), write))

    def write(new):
        wide = lambda k, n: F.when(F.length(F.get(part, F.lit(k))) > 1, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        first, second = F.when(swapped, F.month(new)).otherwise(F.dayofmonth(new)), F.when(swapped, F.dayofmonth(new)).otherwise(F.month(new))
        mark = F.when(m.contains("/"), "/").otherwise(".")
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(wide(0, first), mark, wide(1, second), mark, F.lpad(F.year(new).cast("string"), 4, "0")))

    return F.when(m.rlike("^(?:" + _DATE + ")$"), F.when(day.isNotNull(), _with(F.date_diff(day, F.expr(_FIRST_DAY)).cast("long"), make)))


def _email(m: Column, key: str) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.when(m.contains("@"), F.concat(permute_characters(name, key, "email"), F.lit("@"), host))


FORMATS = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(match: Column, key: str) -> Column:
    """Pseudonym of a string that has one of the formats; null if it is not valid in any."""
    return F.coalesce(*[make(match, key) for make in FORMATS.values()])


def pseudonymise(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """df with the pseudonyms put into column, and n_pseudonyms, how many there are."""
    text = F.col(column).cast("string")
    may = text.rlike("[0-9@]")
    # what no format can match is cheap to tell and stays as it is
    found = F.when(may, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    was, new = free_names(df, "__found", "__new")
    with_found = df.withColumn(was, found).withColumn(new, F.transform(was, lambda m: pseudonym(m, key)))
    pieces = F.split(text, _ANY, -1)
    joined = F.array_join(
        F.transform(pieces, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.coalesce(F.get(F.col(new), k - 1), F.get(F.col(was), k - 1)), p))), ""
    )
    return with_found.withColumns({
        column: F.when(F.size(was) > 0, joined).otherwise(text), "n_pseudonyms": F.size(F.filter(new, lambda x: x.isNotNull()))
    }).drop(was, new)
