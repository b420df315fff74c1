"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers and dates that pass their validation are permuted with a key inside their
own format: a card number becomes another that passes the Luhn test, an IBAN
another of its country with right check digits (its letters move too), a date
another day of the same two centuries written the same way. The permutation depends
on the key, the kind and the value alone, so equal values stay equal in every
document, different ones stay different, and who has the key can invert it. E-mail
addresses become keyed addresses and secrets a keyed mark; these have no inverse.

One pass of one pattern finds the candidates of a text; candidates that fail their
validation stay as they are. Every repeated group of the pattern is bounded, so a
text of any length takes no more stack than a short one. Ten digits in a row are
not taken for a phone number: nothing about them can be validated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import unused

ROUNDS = 8
KINDS = ("email", "secret", "ip", "date", "phone", "ssn", "iban", "card")
#: Days from 1900-01-01 to 2099-12-31: 17 * 4297, the two halves of the dates' network.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 17, 4297

#: Fixed: letters of an IBAN by its country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Labels of a host name, at most 126 in its 253 characters.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
SECRET_NAME = r"(?i:\b(?:access[_-]?token|auth[_-]?token|token|password|passwd|pwd|secret|api[_-]?key|private[_-]?key)\b[\"']?\s{0,8}(?:[=:]|\bis\b(?=\s{1,8}[\"']?[A-Za-z+/_.~-]{0,64}[0-9]))\s{0,8}[\"']?)"
#: Fixed: how the tokens of widely used services begin.
TOKEN = r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,250}|sk_live_[A-Za-z0-9]{16,99})(?![A-Za-z0-9_-])"
SECRET = SECRET_NAME + r"[A-Za-z0-9+/_.~-]{8,}|" + TOKEN
OCTETS = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
IP = r"(?<![0-9A-Za-z.])" + OCTETS + r"(?![0-9A-Za-z]|\.\d)"
DATE = r"(?<![0-9A-Za-z./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![0-9A-Za-z]|[./-]\d)"
PHONE = r"(?<![0-9A-Za-z+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|[2-9]\d{2} [2-9]\d{2} \d{4}(?! ?\d))(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z]|-\d)"
def _iban_pattern() -> str:
    """An IBAN of its country's length, in one piece or in groups of four."""
    cases = []
    for n, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        cases.append(f"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{fours}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "") + ")")
    return r"(?<![0-9A-Za-z])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(cases) + r")(?![0-9A-Za-z])"


IBAN = _iban_pattern()
CARD = r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5})(?![0-9A-Za-z])"
PATTERN = "|".join((EMAIL, SECRET, IP, DATE, PHONE, SSN, IBAN, CARD))


def _round(key: str, tweak: Column, i: Column, value: Column, modulus: Column) -> Column:
    """A keyed number below the modulus: 60 bits of SHA-256."""
    said = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint"), modulus)


def feistel(key: str, tweak: Column, left: Column, right: Column, left_size: Column, right_size: Column, back: bool = False) -> tuple[Column, Column]:
    """Permute a pair of numbers below the two sizes; ``back`` inverts."""
    sign = F.lit(-1 if back else 1).cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        moved = F.pmod(acc["l"] + sign * _round(key, tweak, i, acc["r"], left_size), left_size)
        other = F.pmod(acc["r"] + sign * _round(key, tweak, i, acc["l"], right_size), right_size)
        return F.struct(F.when(i % 2 == 1, moved).otherwise(acc["l"]).alias("l"), F.when(i % 2 == 0, other).otherwise(acc["r"]).alias("r"))

    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    both = F.aggregate(order, F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)
    return both["l"], both["r"]


def _ten_to(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")


def permuted_digits(key: str, kind: str | Column, digits: Column, back: bool = False) -> Column:
    """Another string of as many digits (at most 36); none stays none."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    tweak = F.concat_ws("/", F.lit(kind) if isinstance(kind, str) else kind, n.cast("string"))
    as_number = lambda s: F.concat(F.lit("0"), s).cast("bigint")
    left, right = feistel(key, tweak, as_number(F.substring(digits, F.lit(1), u)), as_number(F.substring(digits, u + 1, n - u)), _ten_to(u), _ten_to(n - u), back)
    written = F.concat(F.when(u > 0, F.lpad(left.cast("string"), u, "0")).otherwise(""), F.lpad(right.cast("string"), n - u, "0"))
    return F.when(n > 0, written).otherwise("")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _fill(form: Column, digits: Column) -> Column:
    """Write digits over the digits of a form, in order."""
    return F.aggregate(
        F.split(form, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("at"),
        ),
        lambda acc: acc["out"],
    )


def luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10; the last digit is the check digit."""
    return F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")),
        lambda acc, c: F.struct(
            (acc["s"] + F.when(c == "", 0).when(acc["i"] % 2 == 0, c.try_cast("int")).otherwise(F.floor(2 * c.try_cast("int") / 10) + (2 * c.try_cast("int")) % 10)).cast("int").alias("s"),
            (acc["i"] + 1).alias("i"),
        ),
        lambda acc: acc["s"] % 10,
    )


def _mod97(text: Column) -> Column:
    """Modulo 97 of a text of digits and A-Z, letters as 10 to 35."""
    value = lambda c: F.when(c == "", 0).when(c.rlike("^[0-9]$"), F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: ((acc * F.when(c == "", 1).when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def _card(key: str, m: Column) -> Column:
    own = _digits(m)
    body = permuted_digits(key, "card", F.substring(own, F.lit(1), F.length(own) - 1))
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when(luhn_sum(own) == 0, _fill(m, F.concat(body, check.cast("string"))))


def _iban(key: str, m: Column) -> Column:
    own = F.replace(m, F.lit(" "), F.lit(""))
    tail = F.substring(own, F.lit(5), F.length(own))
    # the digits move by a permutation that the letters choose, then the letters by steps that the new digits choose
    digits = permuted_digits(key, F.concat_ws("/", F.lit("iban"), F.regexp_replace(tail, "[0-9]", "")), _digits(tail))
    steps = F.sha2(F.concat_ws("|", F.lit(key), F.lit("iban-letters"), digits), 256)
    step = lambda i: F.conv(F.substring(steps, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    lettered = F.array_join(F.transform(F.split(tail, ""), lambda c, i: F.when(c.rlike("^[A-Z]$"), F.char((F.ascii(c) - 65 + step(i)) % 26 + 65)).otherwise(c)), "")
    moved = _fill(lettered, digits)
    country = F.substring(own, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    out = F.concat(country, check, moved)
    spaced = F.aggregate(
        F.split(m, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substring(out, acc["at"], F.lit(1)))).alias("out"), (acc["at"] + F.when(c == " ", 0).otherwise(1)).alias("at")),
        lambda acc: acc["out"],
    )
    return F.when((_mod97(F.concat(tail, F.substring(own, 1, 4))) == 1) & (F.length(_digits(tail)) <= 36), spaced)


def _ip(key: str, m: Column) -> Column:
    octet = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("int")
    size = F.lit(65536).cast("bigint")
    left, right = feistel(key, F.lit("ip"), octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), size, size)
    out = F.concat_ws(".", *[x.cast("bigint").cast("string") for v in (left, right) for x in (F.floor(v / 256), v % 256)])
    return F.when(F.greatest(*[octet(k) for k in range(1, 5)]) <= 255, out)


def _date(key: str, m: Column) -> Column:
    mark = F.regexp_extract(m, r"[-/.]", 0)
    part = lambda k: F.split_part(m, mark, F.lit(k))
    year_first = F.length(part(1)) == 4
    day_of = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    ymd, dmy, mdy = day_of(part(1), part(2), part(3)), day_of(part(3), part(2), part(1)), day_of(part(3), part(1), part(2))
    number = F.date_diff(F.when(year_first, ymd).otherwise(F.coalesce(dmy, mdy)), F.lit(FIRST_DAY).cast("date"))
    left, right = feistel(key, F.lit("date"), F.floor(number / DAYS_RIGHT), F.pmod(number, F.lit(DAYS_RIGHT)), F.lit(DAYS_LEFT).cast("bigint"), F.lit(DAYS_RIGHT).cast("bigint"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (left * DAYS_RIGHT + right).cast("int"))
    sized = lambda v, like: F.when(F.length(like) == 2, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
    y, mo, d = F.year(day), F.month(day), F.dayofmonth(day)
    join = lambda a, b, c: F.concat(a, mark, b, mark, c)
    out = (
        F.when(year_first, join(y.cast("string"), sized(mo, part(2)), sized(d, part(3))))
        .when(dmy.isNotNull(), join(sized(d, part(1)), sized(mo, part(2)), y.cast("string")))
        .otherwise(join(sized(mo, part(1)), sized(d, part(2)), y.cast("string")))
    )
    return F.when(number.between(0, DAYS_LEFT * DAYS_RIGHT - 1), out)


def _phone(key: str, m: Column) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    own = _digits(rest)
    return F.when(F.length(own).between(7, 15), F.concat(code, _fill(rest, permuted_digits(key, "phone", own))))


def _ssn(key: str, m: Column) -> Column:
    valid = ~m.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$")
    return F.when(valid, _fill(m, permuted_digits(key, "ssn", _digits(m))))


def _mark(key: str, kind: str, m: Column, size: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m), 256), 1, size)


def pseudonym(key: str, m: Column) -> Column:
    """(kind, new) of a candidate; a null ``new`` if it fails its validation."""
    prefix = F.regexp_extract(m, "^" + SECRET_NAME, 0)
    secret = F.concat(prefix, F.lit("[secret-"), _mark(key, "secret", F.substring(m, F.length(prefix) + 1, F.length(m)), 12), F.lit("]"))
    email = F.concat(F.lit("u"), _mark(key, "email", F.lower(m), 12), F.lit("@mail.invalid"))
    cases = (
        ("email", m.contains("@"), email),
        ("secret", (prefix != "") | m.rlike("^" + TOKEN + "$"), secret),
        ("ip", m.rlike("^" + OCTETS + "$"), _ip(key, m)),
        ("date", m.rlike(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"), _date(key, m)),
        ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(key, m)),
        ("phone", m.rlike(r"^[+(]|^\d{3}[-. ]\d{3}[-. ]\d{4}$"), _phone(key, m)),
        ("iban", m.rlike("^[A-Z]{2}"), _iban(key, m)),
        ("card", F.lit(True), _card(key, m)),
    )
    kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, holds, made in reversed(cases):
        kind, new = F.when(holds, F.lit(name)).otherwise(kind), F.when(holds, made).otherwise(new)
    return F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, m).alias("new"))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text's personal data replaced, and ``pii`` (the kinds replaced, in order).

    Null text stays null with no kinds, empty text stays empty; rows stand by
    themselves, so repeated ones get the same result, null ids do not matter and an
    empty table stays empty. A column named ``pii`` in ``docs`` is replaced; all
    others go through as they are. Whole texts of any length are searched. There is
    no key but the caller's: an empty one is refused.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    said, found, new = F.coalesce(text_col, F.lit("")), unused(docs, "found_pii"), unused(docs, "new_pii")
    known = docs.withColumn(found, F.regexp_extract_all(said, F.lit(PATTERN), F.lit(0)))
    named = known.withColumn(new, F.transform(found, lambda m: pseudonym(key, m)))
    pieces = F.split(F.col(text_col), PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.transform(new, lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = named.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(F.col(text_col)))
    return out.withColumn("pii", F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull())).drop(found, new)
