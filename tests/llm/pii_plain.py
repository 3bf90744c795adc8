"""Pseudonyms once more, in plain Python, a character at a time: what the column expressions must give on whole texts."""

import datetime
import hashlib
import re

from fathomline.llm import pii

RULES = {kind: re.compile(p, re.A) for kind, p in pii.PATTERNS.items()}
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), re.A)
FIRST = datetime.date(1800, 1, 1)
LENGTHS = {x[:2]: int(x[2:]) for x in pii._LENGTHS.split()}


def feistel(n, a, b, tweak, key):
    left, right = divmod(n, b)
    for i in range(pii.ROUNDS):
        number = lambda half: int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + number(right)) % a
        else:
            right = (right + number(left)) % b
    return left * b + right


def permute(s, alphabet, tweak, key):
    width, base, out = pii._CHUNK[alphabet], len(alphabet), ""
    for i in range(0, len(s), width):
        piece = s[i : i + width]
        n = 0
        for c in piece:
            n = n * base + alphabet.index(c)
        low = len(piece) // 2
        n = feistel(n, base ** (len(piece) - low), base**low, f"{tweak}#{i // width}/{base}/{len(piece)}", key)
        new = ""
        for _ in piece:
            n, r = divmod(n, base)
            new = alphabet[r] + new
        out += new
    return out


def refill(layout, given, kept):
    it = iter(given)
    return "".join(next(it) if c in kept else c for c in layout)


def shape(s, tweak, key):
    parts = [("".join(c for c in s if c in alphabet), alphabet, letter) for alphabet, letter in ((pii.DIGITS, "d"), (pii.LOWER, "l"), (pii.UPPER, "u"))]
    for only, alphabet, letter in parts:
        s = refill(s, permute(only, alphabet, f"{tweak}.{letter}", key), alphabet)
    return s


def digits(s):
    return "".join(c for c in s if c in pii.DIGITS)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def card(m, key):
    d = digits(m)
    if not luhn(d):
        return None
    body = permute(d[:-1], pii.DIGITS, "card", key)
    return refill(m, body + next(c for c in pii.DIGITS if luhn(body + c)), pii.DIGITS)


def iban(m, key):
    s = m.replace(" ", "")
    if mod97(s[4:] + s[:4]) != 1:
        return None
    body = shape(s[4:], "iban", key)
    it = iter(f"{s[:2]}{98 - mod97(body + s[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(it) for c in m)


def email(m, key):
    name, _, domain = m.lower().partition("@")
    domain, _, last = domain.rpartition(".")
    new = f"{shape(name, 'email', key)}@{shape(domain, 'domain', key)}.{last}"
    return "".join(b.upper() if a in pii.UPPER else b for a, b in zip(m, new, strict=True))


def secret(m, key):
    n = re.match(pii._NAMED, m, re.A).end()
    return m[:n] + shape(m[n:], "secret", key)


def phone(m, key):
    d = digits(m)
    n = 0 if m[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in pii.CALLING else 3
    code, rest = d[:n], d[n:]
    zero = rest[: rest.startswith("0")]
    return refill(m, code + zero + permute(rest[len(zero) :], pii.DIGITS, f"phone/{code or 1}", key), pii.DIGITS)


def ssn(m, key):
    a, g, s = map(int, m.split("-"))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    x = feistel(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898, 99 * 9999, "ssn", key)
    a = x // (99 * 9999) + 1
    return f"{a + (a >= 666):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def ip(m, key):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return None
    n = (o[0] << 24) + (o[1] << 16) + (o[2] << 8) + o[3]
    if o[0] in pii._TWO:
        n = (n >> 16 << 16) + feistel(n % (1 << 16), 1 << 8, 1 << 8, f"ip/{n >> 16}", key)
    elif o[0] in pii._ONE:
        n = (o[0] << 24) + feistel(n % (1 << 24), 1 << 12, 1 << 12, f"ip/{o[0]}", key)
    else:
        x = feistel((pii._FREE.index(o[0]) << 24) + n % (1 << 24), len(pii._FREE) << 8, 1 << 16, "ip", key)
        n = (pii._FREE[x >> 24] << 24) + x % (1 << 24)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def ip6(m, key):
    left, gap, right = m.lower().partition("::")
    groups = left.split(":")
    if gap:
        right = right.split(":")
        missing = 8 - len(groups) - len(right)
        if not 0 < missing < 6:
            return None
        groups = groups + ["0"] * missing + right
    h = "".join(g.rjust(4, "0") for g in groups)
    h = h[:4] + permute(h[4:], pii.HEX, f"ip6/{h[:4]}", key)
    return ":".join(re.sub("^0{1,3}", "", h[i : i + 4]) for i in range(0, 32, 4))


_LATE = [d for d in (FIRST + datetime.timedelta(i) for i in range(146_097)) if d.day > 12]


def date(m, key):
    form = "%Y-%m-%d" if m[4] == "-" else "%Y/%m/%d" if m[4] == "/" else "%d.%m.%Y" if m[2] == "." else "%m/%d/%Y" if 12 < int(m[3:5]) < 40 else "%d/%m/%Y"
    try:
        d = datetime.datetime.strptime(m, form).date()
    except ValueError:
        return None
    if not 1800 <= d.year < 2200:
        return None
    if form == "%m/%d/%Y":
        return _LATE[feistel(_LATE.index(d), 9, 9833, "date/late", key)].strftime(form)
    return (FIRST + datetime.timedelta(feistel((d - FIRST).days, *pii.DAYS, "date", key))).strftime(form)


MAKERS = {"secret": secret, "email": email, "iban": iban, "card": card, "phone": phone, "ssn": ssn, "ip": ip, "ip6": ip6, "date": date}


def first_cut(rest):
    """Where a card or IBAN takes a token too many, or starts one too early."""
    for found in ANY.finditer(rest):
        kind, m = found.lastgroup, found.group()
        tokens = re.split("[ -]", m)
        if kind not in ("iban", "card") or len(tokens) == 1:
            continue
        ends = [sum(len(t) + 1 for t in tokens[:k]) - 1 for k in range(len(tokens), 0, -1)]
        forms = [m[:e] for e in ends]
        if kind == "iban":
            forms = [f for f in forms if LENGTHS.get(f[:2]) == len(f.replace(" ", ""))] + forms
        good = [f for f in forms if RULES[kind].fullmatch(f) and MAKERS[kind](f, "") is not None]
        if good:
            if len(good[0]) < len(m):
                return found.start() + len(good[0])
        elif kind == "card":
            return found.start() + len(tokens[0])
        else:
            later = [k for k in range(1, len(tokens)) if re.match("[A-Z]{2}[0-9]{2}", tokens[k])]
            if later:
                return found.start() + sum(len(t) + 1 for t in tokens[: later[0]]) - 1
    return None


def pseudonymized(text, key=pii.KEY):
    """(text, kinds)."""
    lines, kinds = [], []
    for line in (text or "").split("\n"):
        out, rest = "", line
        while rest is not None:
            at = first_cut(rest)
            piece, rest = (rest, None) if at is None else (rest[:at], rest[at:])
            done = 0
            for found in ANY.finditer(piece):
                new = MAKERS[found.lastgroup](found.group(), key)
                kinds += [found.lastgroup] if new is not None else []
                out += piece[done : found.start()] + (found.group() if new is None else new)
                done = found.end()
            out += piece[done:]
        lines.append(out)
    return "\n".join(lines), kinds
