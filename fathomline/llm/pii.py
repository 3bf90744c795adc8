"""Personal data replaced by format-preserving pseudonyms.

A value that is found and validated (Luhn for cards, 0..255 for IPv4 addresses, mod 97 for IBANs, the calendar for
dates, assigned areas for social security numbers) is permuted by a keyed Feistel network within its own format, so the same
value gets the same pseudonym in every document, two values never share one, and a card number stays a card number.  What is
not valid stays as it is.

The network works on a product a * b: a number is split into (left, right) in Z_a x Z_b, and each of ROUNDS rounds adds
a keyed SHA-256 of one half to the other, modulo its size.  That is a permutation for any a and b, so no cycle walking
is needed: digits split 10^u * 10^v, dates 189 * 773 (the 146,097 days of 1800 to 2199).

Values are linked by what they mean, not by how they are written: cards, phones and IPv6 addresses by their digits, a phone's
country code apart (ten digits without one count as +1; other national forms aren't found), e-mail names and domains whatever
their capitals, which stay where they were.  Addresses keep the block they are in: 10.x within 10.x, 192.168.x within 192.168.x.

Texts are searched a line at a time, and only lines that hold one of `@ = :` or a figure are, in one scan that also tells each
match's kind.  A match of several tokens may take one too many, or start one too early.  settled() therefore cuts the line
behind the form that is valid (an IBAN of its country's length, else the longest), or before the next start if none is, and
the rest is searched anew; where overlapping forms are valid, the one that starts first is taken.  Slash dates are dd/MM, or
MM/dd if they can't be that; those are permuted among themselves.

All of it is DataFrame expressions.  A null text counts as empty and comes back null.  Repeated rows, null doc_ids and
other columns pass through unchanged.  An empty table stays empty.  A long text is searched in its own row, and Spark's limit
of 2 GB a value bounds it.  A line that holds all 32 of the noncharacters U+FDD0 to U+FDEF stays as it is.
"""

from __future__ import annotations

import functools
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch_root

ROUNDS = 8
#: The example key of the registered query.  It is no secret; the pipeline never uses it.
KEY = "fathomline-example-key"
FIRST_DAY, DAYS = "1800-01-01", (189, 773)

#: A session's setting with the key of the pipeline's pseudonyms.
KEY_SETTING = "spark.fathomline.pii.key"

#: A column that only lives within pseudonymize().
FOUND = "__fathomline_found"

_HEX = "[0-9A-Fa-f]{1,4}"
#: kind: pattern (Java), in order of precedence.  None of them crosses a line or has groups that capture.
PATTERNS: dict[str, str] = {
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)[^\S\n]{0,3}[=:][^\S\n]{0,3}(?:\x22[^\x22\s]{6,}\x22|'[^'\s]{6,}'|[^\s\x22',;]{6,})",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![A-Za-z0-9]|[.-][0-9])",
    "phone": r"(?<![A-Za-z0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "ip6": rf"(?<![A-Za-z0-9:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![A-Za-z0-9:])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
}
ANY = "|".join(PATTERNS.values())
#: What every value holds: all patterns ask for a figure, an @, or a sign after a secret's name.
GUARD = "[0-9@=:]"
#: A group for each kind, and signs one of which parts them in the result of a scan.
KINDS = "|".join(f"({p})" for p in PATTERNS.values())
MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]
#: Calling codes of two figures; 1 and 7 are of one, all others of three.
CALLING = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: How the first token of an IBAN or of a card in groups begins.
STARTS = r"[A-Z]{2}[0-9]{2}|[0-9]{4}[ -]"
#: Characters of an IBAN by country.
_LENGTHS = (
    "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 "
    "AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 "
    "AL28 AZ28 BY28 CY28 DO28 GT28 HN28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"
)
_LAYOUTS = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{4}/": "yyyy/MM/dd", r"^[0-9]{2}/": "dd/MM/yyyy", r"^[0-9]{2}\.": "dd.MM.yyyy"}

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_CHUNK = {DIGITS: 16, LOWER: 11, UPPER: 11, HEX: 14}


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _div(n: Column, by) -> Column:
    """Exact integer division of longs; `/` would go through doubles."""
    return F.call_function("div", n, by if isinstance(by, Column) else F.lit(by).cast("long"))


def feistel(n: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1 that depends on the tweak."""

    def prf(half: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i, half), 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, (s["l"] + prf(s["r"], i)) % a).otherwise(s["l"])
        right = F.when(i % 2 == 1, (s["r"] + prf(s["l"], i)) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(_div(n, b).alias("l"), (n % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _power(base: Column, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("long"), lambda x, i: F.when(i == 0, x).otherwise(x * base))


def _chunk(s: Column, alphabet: Column, tweak: Column, key: str) -> Column:
    base = F.length(alphabet).cast("long")
    n = F.aggregate(F.regexp_extract_all(s, F.lit("(.)"), F.lit(1)), F.lit(0).cast("long"), lambda x, c: x * base + F.instr(alphabet, c) - 1)
    size = F.length(s)
    low = F.floor(size / 2).cast("int")
    moved = _let(F.struct(n.alias("n"), _power(base, size - low).alias("a"), _power(base, low).alias("b")), lambda x: feistel(x["n"], x["a"], x["b"], F.concat_ws("/", tweak, base, size), key))
    spell = lambda m: F.aggregate(
        F.sequence(F.lit(1), size),
        F.struct(F.lit("").alias("out"), m.alias("rest")),
        lambda s, i: F.struct(F.concat(F.substr(alphabet, (s["rest"] % base + 1).cast("int"), F.lit(1)), s["out"]).alias("out"), _div(s["rest"], base).alias("rest")),
        lambda s: s["out"],
    )
    return _let(moved, spell)


def permute(s: Column, alphabet: Column | str, tweak: Column, key: str) -> Column:
    """A string over the alphabet to another of its length, one to one; long ones in chunks that know their place."""
    if isinstance(alphabet, str):
        width, alphabet = F.lit(f"(.{{1,{_CHUNK[alphabet]}}})"), F.lit(alphabet)
    else:
        width = F.get(F.array(*(F.lit(f"(.{{1,{w}}})") for w in _CHUNK.values())), F.array_position(F.array(*map(F.lit, _CHUNK)), alphabet).cast("int") - 1)
    chunks = F.transform(F.regexp_extract_all(s, width, F.lit(1)), lambda c, i: _chunk(c, alphabet, F.concat_ws("#", tweak, i), key))
    return F.array_join(chunks, "")


def _refill(layout: Column, digits: Column, lower: Column, upper: Column) -> Column:
    """The layout with its digits and letters replaced, in their order, by those given."""

    def step(s: Column, c: Column) -> Column:
        kinds = {"d": ("[0-9]", digits), "l": ("[a-z]", lower), "u": ("[A-Z]", upper)}
        new = c
        for k, (pattern, fill) in kinds.items():
            new = F.when(c.rlike(pattern), F.substr(fill, s[k], F.lit(1))).otherwise(new)
        return F.struct(F.concat(s["out"], new).alias("out"), *((s[k] + c.rlike(p).cast("int")).alias(k) for k, (p, _) in kinds.items()))

    start = F.struct(F.lit("").alias("out"), *(F.lit(1).alias(k) for k in "dlu"))
    return F.aggregate(F.regexp_extract_all(layout, F.lit("((?s).)"), F.lit(1)), start, step, lambda s: s["out"])


def _only(s: Column, kept: str) -> Column:
    return F.regexp_replace(s, f"[^{kept}]", "")


def _shape(s: Column, tweak: Column, key: str) -> Column:
    """Digits to digits, small letters to small letters, capitals to capitals."""
    part = lambda kept, alphabet, k: F.struct(_only(s, kept).alias("s"), F.lit(alphabet).alias("alphabet"), F.concat(tweak, F.lit(k)).alias("tweak"))
    parts = F.array(part("0-9", DIGITS, ".d"), part("a-z", LOWER, ".l"), part("A-Z", UPPER, ".u"))
    moved = F.transform(parts, lambda p: permute(p["s"], p["alphabet"], p["tweak"], key))
    return _let(moved, lambda p: _refill(s, *(F.get(p, F.lit(i)) for i in range(3))))


def _luhn(digits: Column, first: int) -> Column:
    """The Luhn sum; first: 0 if the last digit counts once, 1 if it is doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _let(F.when(c == "", 0).otherwise(F.when(c == "", "0").otherwise(c).cast("int") * F.when((i + first) % 2 == 1, 2).otherwise(1)), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda x, d: x + d)


def _card(m: Column, key: str, shaped: Column) -> Column:
    def number(digits: Column) -> Column:
        body = permute(F.substr(digits, F.lit(1), F.length(digits) - 1), DIGITS, F.lit("card"), key)
        new = _let(body, lambda b: F.concat(b, ((10 - _luhn(b, 1) % 10) % 10).cast("string")))
        return F.when(_luhn(digits, 0) % 10 == 0, _let(new, lambda n: _refill(m, n, F.lit(""), F.lit(""))))

    return _let(_only(m, "0-9"), number)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


#: First octets whose second one also names the block, and those that stay as they are by themselves.
_TWO, _ONE = (169, 172, 192), (0, 10, 127, *range(224, 256))
_FREE = [x for x in range(256) if x not in _TWO + _ONE]


def _ip(m: Column, key: str, shaped: Column) -> Column:
    """Within the first octets that name no block, or within the block that one or two octets name."""
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    quad = lambda v: F.concat_ws(".", *((_div(v, 1 << s) % 256) for s in (24, 16, 8, 0)))
    free = F.array(*(F.lit(x) for x in _FREE))

    def moved(n: Column) -> Column:
        first, low = _div(n, 1 << 24), n % (1 << 24)
        place = (F.array_position(free, first.cast("int")) - 1) * (1 << 24) + low
        anywhere = _let(feistel(place, _long(len(_FREE) << 8), _long(1 << 16), F.lit("ip"), key), lambda x: F.get(free, _div(x, 1 << 24).cast("int")).cast("long") * (1 << 24) + x % (1 << 24))
        in_two = (n - n % (1 << 16)) + feistel(n % (1 << 16), _long(1 << 8), _long(1 << 8), F.concat(F.lit("ip/"), _div(n, 1 << 16)), key)
        in_one = (n - low) + feistel(low, _long(1 << 12), _long(1 << 12), F.concat(F.lit("ip/"), first), key)
        return F.when(first.isin(*_TWO), in_two).when(first.isin(*_ONE), in_one).otherwise(anywhere)

    n = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda x, o: x * 256 + o)
    return _let(parts, lambda p: F.when(F.forall(p, lambda o: o < 256), _let(_let(n(p), moved), quad)))


def _ip6(m: Column, key: str, shaped: Column) -> Column:
    """All groups but the first, which names the block; written out in full.  Three groups at least have to be there."""

    def whole(sides: Column) -> Column:
        left, right = F.split(F.get(sides, F.lit(0)), ":"), F.split(F.get(sides, F.lit(1)), ":")
        gap = 8 - F.size(left) - F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
        return F.when(F.size(sides) == 1, left).when((gap > 0) & (gap < 6), filled)

    digits = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    plain = lambda h: F.array_join(F.transform(F.regexp_extract_all(h, F.lit("(.{4})"), F.lit(1)), lambda x: F.regexp_replace(x, "^0{1,3}", "")), ":")
    new = lambda h: plain(F.concat(F.substring(h, 1, 4), permute(F.substring(h, 5, 28), HEX, F.concat(F.lit("ip6/"), F.substring(h, 1, 4)), key)))
    return _let(whole(F.split(F.lower(m), "::")), lambda g: F.when(g.isNotNull(), _let(digits(g), new)))


def _mod97(s: Column) -> Column:
    return F.aggregate(
        F.split(s, ""), F.lit(0), lambda x, c: F.when(c == "", x).when(c.rlike("[0-9]"), (x * 10 + F.when(c.rlike("[0-9]"), c).otherwise("0").cast("int")) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97)
    )


def _iban(m: Column, key: str, shaped: Column) -> Column:
    """Country, new check digits, and the shaped account number."""

    def account(s: Column) -> Column:
        country, body = F.substring(s, 1, 2), F.substr(s, F.lit(5), F.length(s))
        new = _let(F.get(shaped, F.lit(0)), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        spread = lambda n: F.aggregate(
            F.regexp_extract_all(m, F.lit("((?s).)"), F.lit(1)),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
            lambda a, c: F.struct(F.concat(a["out"], F.when(c == " ", c).otherwise(F.substr(n, a["i"], F.lit(1)))).alias("out"), (a["i"] + F.when(c == " ", 0).otherwise(1)).alias("i")),
            lambda a: a["out"],
        )
        return F.when(_mod97(F.concat(body, F.substring(s, 1, 4))) == 1, _let(new, spread))

    return _let(F.regexp_replace(m, " ", ""), account)


def _late(n: Column, key: str) -> Column:
    """A date of a day after the 12th, by its number of days since FIRST_DAY, to another such date; there are 9 * 9833.

    Twelve days of each month aren't counted, so month k begins at its first day's number - 12 * k.  Months have 16 to 19
    days that count, and none begins farther than one month from where it would if all had as many."""
    first = F.to_date(F.lit(FIRST_DAY))
    a, b = F.lit(9).cast("long"), F.lit(9833).cast("long")
    place = _let(F.date_add(first, n.cast("int")), lambda d: n - 12 * ((F.year(d) - F.year(first)) * 12 + F.month(d)))
    begins = lambda k: F.date_diff(F.add_months(first, k), first) - 12 * k
    about = lambda r: _div(r * 4800, 9 * 9833).cast("int")
    month = lambda r: F.array_max(F.filter(F.sequence(F.greatest(about(r) - 1, F.lit(0)), about(r) + 1), lambda k: begins(k) <= r))
    moved = _let(place, lambda x: feistel(x.cast("long"), a, b, F.lit("date/late"), key))
    return _let(moved, lambda r: F.date_add(first, (r + 12 * (month(r) + 1)).cast("int")))


def _date(m: Column, key: str, shaped: Column) -> Column:
    out = F.lit(None).cast("string")
    first = F.to_date(F.lit(FIRST_DAY))
    total = DAYS[0] * DAYS[1]
    for pattern, layout in _LAYOUTS.items():
        day = F.date_diff(F.try_to_timestamp(m, F.lit(layout)).cast("date"), first)
        moved = lambda n: F.date_format(F.date_add(first, feistel(n.cast("long"), F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), F.lit("date"), key).cast("int")), layout)  # noqa: B023, E731
        out = F.when(m.rlike(pattern), _let(day, lambda n: F.when(n.between(0, total - 1), moved(n)))).otherwise(out)  # noqa: B023
    other = "MM/dd/yyyy"
    late = F.date_diff(F.try_to_timestamp(m, F.lit(other)).cast("date"), first)
    turned = _let(late, lambda n: F.when(n.between(0, total - 1), F.date_format(_late(n, key), other)))
    return F.when(m.rlike("^[0-9]{2}/(?:1[3-9]|[23][0-9])/"), turned).otherwise(out)


#: What comes before a secret's value.
_NAMED = r"^(AKIA|[A-Za-z_-]+\s{0,3}[=:]\s{0,3}[\x22']?)"


def _secret(m: Column, key: str, shaped: Column) -> Column:
    return F.concat(F.regexp_extract(m, _NAMED, 1), F.get(shaped, F.lit(0)))


def _cased(layout: Column, small: Column) -> Column:
    """A text in small letters with capitals where the layout has them."""
    letters = lambda x: F.regexp_extract_all(x, F.lit("((?s).)"), F.lit(1))
    return F.array_join(F.zip_with(letters(layout), letters(small), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")


def _email(m: Column, key: str, shaped: Column) -> Column:
    """Name and domain, each by itself; the domain's last part stays."""
    last = F.regexp_extract(F.lower(m), r"(\.[a-z]+)$", 1)
    return _let(F.concat(F.get(shaped, F.lit(0)), F.lit("@"), F.get(shaped, F.lit(1)), last), lambda v: _cased(m, v))


def _bodies(kind: str, m: Column) -> Column:
    """(s, tweak): what of a match is permuted sign by sign."""
    body = lambda s, tweak: F.struct(s.alias("s"), F.lit(tweak).alias("tweak"))
    if kind == "secret":
        return F.array(body(F.regexp_replace(m, _NAMED, ""), "secret"))
    if kind == "email":
        return F.array(body(F.substring_index(F.lower(m), "@", 1), "email"), body(F.regexp_extract(F.lower(m), r"@(.*)\.[a-z]+$", 1), "domain"))
    return F.array(body(F.substr(F.regexp_replace(m, " ", ""), F.lit(5), F.length(m)), "iban"))


def _phone(m: Column, key: str, shaped: Column) -> Column:
    """The country code stays, and a 0 after it; the other digits are permuted, as one number however they are parted."""

    def number(d: Column) -> Column:
        known = m.startswith("+")
        short = F.when(F.substring(d, 1, 1).isin("1", "7"), 1).when(F.substring(d, 1, 2).isin(*CALLING), 2).otherwise(3)
        return F.struct(F.when(known, F.substr(d, F.lit(1), short)).otherwise("").alias("code"), F.when(known, F.substr(d, short + 1, F.length(d))).otherwise(d).alias("rest"))

    def new(n: Column) -> Column:
        zero = F.when(n["rest"].startswith("0"), "0").otherwise("")
        tweak = F.concat(F.lit("phone/"), F.when(n["code"] == "", "1").otherwise(n["code"]))
        return _let(F.concat(n["code"], zero, permute(F.substr(n["rest"], F.length(zero) + 1, F.length(n["rest"])), DIGITS, tweak, key)), lambda d: _refill(m, d, F.lit(""), F.lit("")))

    return _let(_let(_only(m, "0-9"), number), new)


def _ssn(m: Column, key: str, shaped: Column) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001; others aren't assigned and stay."""
    part = lambda at, n: F.substring(m, at, n).cast("long")

    def spelled(x: Column) -> Column:
        area = _div(x, 99 * 9999) + 1
        return F.concat_ws("-", F.lpad((area + (area >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((_div(x, 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((x % 9999 + 1).cast("string"), 4, "0"))

    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    place = ((area - 1 - (area > 666).cast("int")) * 99 + group - 1) * 9999 + serial - 1
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _let(_let(place, lambda x: feistel(x, _long(898), _long(99 * 9999), F.lit("ssn"), key)), spelled))


_MAKERS = {"secret": _secret, "email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "ip6": _ip6, "date": _date}


def _valid(kind: str, m: Column) -> Column:
    if kind == "card":
        return _let(_only(m, "0-9"), lambda d: _luhn(d, 0) % 10 == 0)
    return _let(F.regexp_replace(m, " ", ""), lambda s: _mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def _until(kind: str, m: Column) -> Column:
    """How many characters of a match of several tokens to keep before the text is searched anew; all: null."""
    full = f"^(?:{PATTERNS[kind]})$"
    size = lambda tokens, k: F.aggregate(F.slice(tokens, 1, k), F.lit(-1), lambda n, t: n + F.length(t) + 1)

    def cut(tokens: Column) -> Column:
        forms = F.transform(F.sequence(F.size(tokens), F.lit(1), F.lit(-1)), lambda k: F.substr(m, F.lit(1), size(tokens, k)))
        if kind == "iban":
            bare = lambda x: F.length(F.regexp_replace(x, " ", "")).cast("string")
            own = _let(forms, lambda all_: F.concat(F.filter(all_, lambda x: F.contains(F.lit(_LENGTHS), F.concat(F.substring(x, 1, 2), bare(x)))), all_))
            starts = F.filter(F.sequence(F.lit(1), F.size(tokens) - 1), lambda k: F.get(tokens, k).rlike("^[A-Z]{2}[0-9]{2}"))
            none = _let(F.get(starts, F.lit(0)), lambda k: F.when(k.isNotNull(), size(tokens, k)))
        else:
            own, none = forms, size(tokens, F.lit(1))
        first = F.get(F.filter(own, lambda x: F.when(x.rlike(full), _valid(kind, x)).otherwise(F.lit(False))), F.lit(0))
        return _let(first, lambda x: F.when(x.isNull(), none).when(F.length(x) < F.length(m), F.length(x)))

    return _let(F.split(m, "[ -]"), lambda tokens: F.when(F.size(tokens) > 1, cut(tokens)))


def _first_cut(text: Column) -> Column:
    """Where the text has to be cut first, if anywhere."""
    pairs = F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    which = lambda m: F.when(m.rlike(f"^(?:{PATTERNS['iban']})$"), _until("iban", m)).when(m.rlike(f"^(?:{PATTERNS['card']})$"), _until("card", m))
    # Secrets and e-mail addresses come before both.
    until = lambda m: F.when(~m.rlike(f"^(?:{PATTERNS['secret']}|{PATTERNS['email']})$"), which(m))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["gap"])
        return F.when(s["cut"].isNotNull(), s).otherwise(F.struct((at + F.coalesce(F.length(p["m"]), F.lit(0))).alias("at"), (at + until(p["m"])).alias("cut")))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("cut")), step, lambda s: s["cut"])


def settled(text: Column) -> Column:
    """The text in pieces in each of which a match takes no token too many.  A cut passes one of STARTS at least."""

    def step(s: Column, _: Column) -> Column:
        def go(c: Column) -> Column:
            rest = F.substr(s["rest"], c + 1, F.length(s["rest"]))
            return F.struct(F.concat(s["pieces"], F.array(F.when(c.isNull(), s["rest"]).otherwise(F.substr(s["rest"], F.lit(1), c)))).alias("pieces"), F.when(c.isNotNull(), rest).alias("rest"))

        return F.when(s["rest"].isNull(), s).otherwise(_let(_first_cut(s["rest"]), go))

    steps = F.size(F.regexp_extract_all(text, F.lit(f"({STARTS})"), F.lit(1)))
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.when(F.lit(True), text).alias("rest"))
    last = lambda s: F.when(s["rest"].isNull(), s["pieces"]).otherwise(F.concat(s["pieces"], F.array(s["rest"])))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step, last)).otherwise(F.array(text))


def _scan(x: Column) -> Column:
    """A line in parts: text, a field for each kind (one of them with the match), text, and so on."""
    fields = lambda mark: F.concat(mark, *(y for i in range(len(PATTERNS)) for y in (F.lit(f"${i + 1}"), mark)))
    free = F.get(F.filter(F.array(*map(F.lit, MARKS)), lambda c: ~F.contains(x, c)), F.lit(0))
    return _let(free, lambda mark: F.when(mark.isNull(), F.array(x)).otherwise(F.split(F.regexp_replace(x, F.lit(KINDS), fields(mark)), mark, -1)))


def _rendered(parts: Column, key: str) -> Column:
    """struct(text, kinds) of a line's parts, valid matches replaced."""
    step = len(PATTERNS) + 1

    def chosen(fields: Column, kinds: list[str], f) -> Column:
        out = F.lit(None)
        for kind in reversed(kinds):
            m = F.get(fields, F.lit(list(PATTERNS).index(kind)))
            out = F.when(m != "", f(kind, m)).otherwise(out)
        return out

    def one(fields: Column) -> Column:
        """(kind, new): what a match is, and its pseudonym; if it isn't valid, no kind and the match."""
        bodies = chosen(fields, ["secret", "email", "iban"], _bodies)
        shaped = F.transform(bodies, lambda b: _shape(b["s"], b["tweak"], key))
        new = _let(shaped, lambda sh: chosen(fields, list(PATTERNS), lambda kind, m: _MAKERS[kind](m, key, sh)))
        kind = chosen(fields, list(PATTERNS), lambda kind, m: F.lit(kind))
        told = lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, F.array_join(fields, "")).alias("new"))
        return _let(new, told)

    found = F.transform(F.sequence(F.lit(0), _div(F.size(parts).cast("long") - 1, step).cast("int") - 1), lambda i: F.struct(F.get(parts, i * step).alias("gap"), one(F.slice(parts, i * step + 2, step - 1)).alias("p")))
    told = lambda f: F.struct(
        F.concat(F.array_join(F.transform(f, lambda y: F.concat(y["gap"], y["p"]["new"])), ""), F.element_at(parts, -1)).alias("text"),
        F.filter(F.transform(f, lambda y: y["p"]["kind"]), lambda k: k.isNotNull()).alias("kinds"),
    )
    none = F.struct(F.element_at(parts, -1).alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(F.size(parts) > 1, _let(found, told)).otherwise(none)


def _line(x: Column, key: str) -> Column:
    """struct(text, kinds) of a line."""
    step = len(PATTERNS) + 1
    at = [list(PATTERNS).index(k) + 1 for k in ("iban", "card")]
    several = lambda parts: F.exists(F.transform(parts, lambda p, i: (i % step).isin(at) & (p != "")), lambda b: b)
    pieces = lambda parts: F.when(several(parts), F.transform(settled(x), _scan)).otherwise(F.array(parts))
    joined = lambda r: F.struct(F.array_join(r["text"], "").alias("text"), F.flatten(r["kinds"]).alias("kinds"))
    return _let(_let(_scan(x), pieces), lambda all_: _let(F.transform(all_, lambda parts: _rendered(parts, key)), joined))


@functools.lru_cache(8)
def _lines(text_col: str, key: str, application: str) -> Column:
    """struct(text, kinds) of each line.  Some thousands of nodes, which take seconds to put together; so they are kept."""
    plain = lambda x: F.struct(x.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.transform(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x: F.when(x.rlike(GUARD), _line(x, key)).otherwise(plain(x)))


def pseudonymize(docs: DataFrame, key: str = KEY, text_col: str = "text", kinds_col: str = "pii") -> DataFrame:
    """docs with the text replaced, and a column of the kinds found in their order (an empty array: none), which takes the
    place of one of that name."""
    text = F.col(f"`{text_col}`")
    df = docs.withColumn(FOUND, F.when(text.rlike(GUARD), _lines(text_col, key, docs.sparkSession.sparkContext.applicationId)))
    found = F.col(FOUND)
    new = {text_col: F.when(found.isNotNull(), F.array_join(found["text"], "\n")).otherwise(text), kinds_col: F.coalesce(F.flatten(found["kinds"]), F.array().cast("array<string>"))}
    return df.withColumns(new).drop(FOUND)


def secret_key(spark: SparkSession) -> str:
    """The session's KEY_SETTING, or else a random key that is made once and kept in the folder of spark.checkpoint.dir, so
    that later runs there give the same pseudonyms."""
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/pseudonyms.key")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fresh = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/pseudonyms-{secrets.token_hex(8)}.key")
        out = fs.create(fresh, False)
        out.write(bytearray(secrets.token_hex(32).encode()))
        out.close()
        fs.setPermission(fresh, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        if fs.exists(path) or not fs.rename(fresh, path):
            fs.delete(fresh, False)  # another driver was first
    return spark.read.text(path.toString()).first()[0]


def clean_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs, same columns, with pseudonyms in the text and n_chars, if it is there, counted anew.  Without a key, it is
    secret_key()."""
    out = pseudonymize(docs, key or secret_key(docs.sparkSession), kinds_col="__fathomline_kinds")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymize(docs).select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join("pii", ",").alias("kinds"))
