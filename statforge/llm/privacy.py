"""Format-preserving pseudonyms by a keyed Feistel network.

Private values are found by form and validated: card numbers by the Luhn sum,
IBANs by their mod-97 sum, dates by the calendar, US social security numbers
and IPv4 addresses by their ranges, phone numbers by their grouping; e-mail
addresses and quoted secrets by their surroundings.  Each value is a number
below the size of its format.  With P a Feistel permutation of those numbers,
the pseudonym of x is P(P^-1(x) + s) for a keyed shift s > 0: a permutation
without fixed points.  Separators, widths, letter case and check digits stay
valid, a text keeps its length, and equal values get equal pseudonyms in all
documents, whatever separators they are written with.

Letters and digits of addresses and secrets stay within their class: those of
one alphabet and case, for other scripts those of one category among 128
neighbouring code points.  Where there are more than ``SMALL`` such values, the
Feistel network works on the characters' places in their classes, the first
half of them against the second, with a key stream as long as the half; its
cost is linear in the length.  The domain of an address stays.

Cards and IBANs are also found where other numbers or words stand next to them:
any whole digit groups that make a valid card are one, as is an IBAN that ends
at any blank.  Where digits could be read in several ways, a pseudonym is
stepped on until it is read in the same way; there alone, equal values may get
different pseudonyms.

Results: null and empty texts stay as they are, as do values that fail their
validation.  Values and texts of any length are treated whole.  Repeated rows
get equal texts, an empty table gives an empty one, and other columns of any
name stay as they are.  ``reveal`` undoes ``conceal`` for the same key, but perhaps in
long runs of numbers of which no reading like the first is found.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statforge.sources.shipping import ship

from .textops import begins

DEFAULT_KEY = b"statforge demonstration key"
ROUNDS = 8
#: Formats of more values than this are permuted character by character.
SMALL = 1 << 128


class Feistel:
    """A keyed permutation of 0..n-1 for any n, by alternating rounds and cycle walking."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.cached = lru_cache(maxsize=1 << 16)(self._shifted)

    def _f(self, tweak: str, i: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{v}".encode(), key=self.key, digest_size=24).digest(), "big")

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        a = math.isqrt(max(n - 1, 0)) + 1
        b = -(-n // a)
        while True:
            v, u = divmod(x, a)
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if i % 2 == 0:
                    u = (u - self._f(tweak, i, v) if back else u + self._f(tweak, i, v)) % a
                else:
                    v = (v - self._f(tweak, i, u) if back else v + self._f(tweak, i, u)) % b
            x = v * a + u
            if x < n:
                return x

    def _shifted(self, x: int, n: int, tweak: str, back: bool) -> int:
        if n < 2:
            return x
        s = 1 + self._f(tweak, ROUNDS, n) % (n - 1)
        return self.permute((self.permute(x, n, tweak, True) + (-s if back else s)) % n, n, tweak)

    def swap(self, x: int, n: int, tweak: str, back: bool) -> int:
        return self.cached(x, n, tweak, back)

    def _stream(self, tweak: bytes, i: int, data: bytes, size: int) -> np.ndarray:
        """``size`` keyed numbers that depend on all of ``data``."""
        seed = hashlib.blake2b(b"%d|%d|%d|" % (i, len(tweak), size) + tweak + data, key=self.key, digest_size=32).digest()
        return np.frombuffer(hashlib.shake_256(self.key + seed).digest(8 * size), "<u8")

    def swap_places(self, x: np.ndarray, size: np.ndarray, tweak: str, back: bool) -> np.ndarray:
        """The like of ``swap`` for a string of numbers below ``size`` each, of which none is under 2."""
        head, wide, name = len(x) // 2, size.astype(np.uint64), tweak.encode()
        shift = self._stream(name, ROUNDS, b"", len(x)) % wide
        shift[0] = 1 + shift[0] % (wide[0] - np.uint64(1))
        x = x.astype(np.uint64)
        half = (slice(0, head), slice(head, None))

        def turn(x: np.ndarray, undo: bool) -> None:
            for i in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
                own, other = half[i % 2], half[1 - i % 2]
                add = self._stream(name, i, x[other].astype("<u2").tobytes(), len(x[own])) % wide[own]
                x[own] = (x[own] + (wide[own] - add if undo else add)) % wide[own]

        turn(x, True)
        x = (x + (wide - shift if back else shift)) % wide
        turn(x, False)
        return x


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 if valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _fill(shape: str, digits: str) -> str:
    """Put digits in the places of a string's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)])), "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))]
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_HEX = ["0123456789", "abcdef", "ABCDEF"]
_HEX_PLACE = {c: (a, i) for a in _HEX for i, c in enumerate(a)}


@lru_cache(maxsize=4096)
def _block(block: int, category: str) -> str:
    """The letters or digits of one category among 128 neighbouring code points, but for those of the alphabets above."""
    return "".join(c for c in map(chr, range(block << 7, (block + 1) << 7)) if unicodedata.category(c) == category and c not in _PLACE)


def _placed(c: str, place: dict) -> tuple[str, int] | None:
    """The class of a character and its place there; None if it stays."""
    found = place.get(c)
    if found or place is _HEX_PLACE or not c.isalnum():
        return found
    if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"):
        own = _block(ord(c) >> 7, unicodedata.category(c))
        if len(own) > 1:
            return own, own.index(c)
    return None


def _classes(f: Feistel, s: str, tweak: str, back: bool, place: dict = _PLACE) -> str:
    """Permute a string among those with the same kind of character in each place."""
    seen: dict[str, tuple[str, int] | None] = {}
    for c in s:
        if c not in seen:
            seen[c] = _placed(c, place)
    found = [seen[c] for c in s]
    tweak = f"{tweak}/{''.join(p[0][0] if p else '-' for p in found)}"
    inner = [p for p in found if p]
    if not inner:
        return s
    n = 1
    for a, _ in inner:
        n *= len(a)
        if n > SMALL:
            places = f.swap_places(np.array([i for _, i in inner]), np.array([len(a) for a, _ in inner]), tweak, back).tolist()
            break
    else:
        x, n, places = 0, 1, []
        for a, i in inner:
            x, n = x + i * n, n * len(a)
        x = f.swap(x, n, tweak, back)
        for a, _ in inner:
            x, i = divmod(x, len(a))
            places.append(i)
    new = iter(places)
    return "".join(p[0][next(new)] if p else c for c, p in zip(s, found))


def _card(f: Feistel, s: str, back: bool) -> str:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d) or d[0] == "0":
        return s
    n = len(d) - 2
    body = d[0] + str(f.swap(int(d[1:-1]), 10**n, f"card/{len(d)}/{d[0]}", back)).zfill(n)
    return _fill(s, body + str(-luhn(body + "0") % 10))


def _phone(f: Feistel, s: str, back: bool) -> str:
    d = _digits(s)
    lead, rest = d[:-10], d[-10:]
    return _fill(s, lead + str(f.swap(int(rest), 10**10, "phone", back)).zfill(10))


def _abroad(f: Feistel, s: str, back: bool) -> str:
    d = _digits(s)
    if not 8 <= len(d) <= 15:
        return s
    n = len(d) - 2
    return _fill(s, d[:2] + str(f.swap(int(d[2:]), 10**n, f"abroad/{d[:2]}/{n}", back)).zfill(n))


_OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip(f: Feistel, s: str, back: bool) -> str:
    parts = s.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return s
    x, n = 0, 1
    for p in parts:
        low, size = _OCTETS[len(p)]
        x, n = x + (int(p) - low) * n, n * size
    x = f.swap(x, n, f"ip/{[len(p) for p in parts]}", back)
    out = []
    for p in parts:
        low, size = _OCTETS[len(p)]
        x, i = divmod(x, size)
        out.append(str(low + i))
    return ".".join(out)


def _ssn(f: Feistel, s: str, back: bool) -> str:
    area, group, serial = (int(x) for x in s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return s
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = f.swap(x, 898 * 99 * 9999, "ssn", back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(f: Feistel, s: str, back: bool) -> str:
    tight = s.replace(" ", "")
    if not 15 <= len(tight) <= 34 or _mod97(tight) != 1:
        return s
    body = _classes(f, tight[4:], f"iban/{tight[:2]}", back)
    new = iter(tight[:2] + f"{98 - _mod97(tight[:2] + '00' + body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(f: Feistel, s: str, back: bool) -> str:
    """Year first, or day and month first: day.month unless only month/day is possible."""
    mark = re.search(r"\D", s).group()
    a, b, c = s.split(mark)
    order = "ymd" if len(a) == 4 else "mdy" if int(b) > 12 else "dmy"
    try:
        day = datetime.date(*(int(dict(zip(order, (a, b, c)))[k]) for k in "ymd")).toordinal()
    except ValueError:
        return s
    if not _FIRST <= day <= _LAST:
        return s
    x = day
    while True:
        x = _FIRST + f.swap(x - _FIRST, _LAST - _FIRST + 1, "date", back)
        new = datetime.date.fromordinal(x)
        if order != "mdy" or new.day > 12:  # the result must be read in the same order again
            break
    part = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return mark.join(part[k] for k in order)


def _email(f: Feistel, s: str, back: bool) -> str:
    local, _, domain = s.rpartition("@")
    name = local.lstrip(".%+-")
    return f"{local[: len(local) - len(name)]}{_classes(f, name, 'email', back)}@{domain}"


def _secret(f: Feistel, s: str, back: bool) -> str:
    hexed = all(c in _HEX_PLACE for c in s)
    return _classes(f, s, "secret", back, _HEX_PLACE if hexed else _PLACE)


_KINDS: list[tuple[str, str, Callable[[Feistel, str, bool], str]]] = [
    ("secret", r"(?<=[=:]\s[\"'])[0-9A-Za-z_\-/+]{16,}(?=[\"'])|(?<=[=:][\"'])[0-9A-Za-z_\-/+]{16,}(?=[\"'])", _secret),
    ("email", r"(?<![\w.%+\-])[\w.%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", _email),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", _iban),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", _ip),
    ("date", r"(?<![0-9\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9\-/])", _date),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", _ssn),
    ("phone", r"(?<![0-9])(?:\+?1[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9.\-])(?:\+1[ .\-]?)?[0-9]{3}([ .\-])[0-9]{3}\g<mark>[0-9]{4}(?![0-9\-])", _phone),
    ("abroad", r"(?<![0-9+])\+[2-9][0-9](?:[ .\-]?[0-9]){6,13}(?![0-9])", _abroad),
    ("card", r"(?<![0-9\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9\-])", _card),
]
_KINDS = [(k, p.replace(r"([ .\-])", r"(?P<mark>[ .\-])").replace(r"\g<mark>", "(?P=mark)"), g) for k, p, g in _KINDS]
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in _KINDS))
_FIND_OTHER = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in _KINDS if k != "card"))
_ACT = {k: g for k, _, g in _KINDS}
_ALONE = re.compile(r"[0-9]{13,19}")
_RUN = re.compile(r"[0-9](?:[ \-]?[0-9])*")
_GROUP = re.compile(r"[0-9]+")
#: How cards are grouped in print; any other grouping comes after these and the other kinds.
_PRINTED = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}
_IBAN_SIZE = {k: int(n) for k, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 "
    "GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 "
    "MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 "
    "TN:24 TR:26 UA:29 VA:22 VG:24 XK:20").split())}  # fmt: skip
#: Steps of the walk that looks for a text read like the one it stands for.
_WALK = 500

Span = tuple[int, int, str]


def _cards(text: str, start: int, stop: int, printed: bool) -> list[Span]:
    """Valid cards of whole digit groups, apart from each other: those in printed groupings, or all, the longest first."""
    groups = [m.span() for m in _GROUP.finditer(text, start, stop)]
    found = []
    for i, (low, _) in enumerate(groups):
        n, shape = 0, ()
        for s, e in groups[i : i + 19]:
            n, shape = n + e - s, (*shape, e - s)
            if n > 19:
                break
            if n >= 13 and (not printed or shape in _PRINTED) and text[low] != "0" and not luhn(_digits(text[low:e])):
                found.append((-n, low, e))
    out: list[Span] = []
    for _, low, e in sorted(found):
        k = bisect_right(out, (low, e, "card"))
        if (k == 0 or out[k - 1][1] <= low) and (k == len(out) or e <= out[k][0]):
            insort(out, (low, e, "card"))
    return out


def _between(spans: list[Span], start: int, stop: int) -> Iterator[tuple[int, int]]:
    for s, e, _ in spans:
        yield start, s
        start = e
    yield start, stop


def _in_run(text: str, start: int, stop: int) -> list[Span]:
    """Values in a run of digit groups: cards in printed groupings, other kinds, then cards however grouped."""
    spans = _cards(text, start, stop, True)
    others = [(m.start(), m.end(), _kind(m)) for low, high in _between(spans, start, stop) for m in _FIND_OTHER.finditer(text, low, high)]
    spans = sorted(spans + others)
    return sorted(spans + [x for low, high in _between(spans, start, stop) for x in _cards(text, low, high, False)])


def _iban_end(m: re.Match) -> int:
    """Where the IBAN that a match begins with ends, or -1: at its country's length or else at any blank, the longest first."""
    s = m.group()
    ends = sorted({i for i, c in enumerate(s) if c == " "} | {len(s)}, reverse=True)
    size = _IBAN_SIZE.get(s[:2])
    for end in sorted(ends, key=lambda e: e - s.count(" ", 0, e) != size):
        tight = s[:end].replace(" ", "")
        if 15 <= len(tight) <= 34 and _mod97(tight) == 1:
            return m.start() + end
    return -1


def _kind(m: re.Match) -> str:
    return "phone" if m.lastgroup == "mark" else m.lastgroup


def _spans(text: str, start: int, stop: int) -> tuple[list[Span], list[tuple[int, int]]]:
    """The values in a stretch, and the parts of it where other digits could have been read otherwise."""
    out, unsure, at = [], [], start
    while m := _FIND.search(text, at, stop):
        kind, at = _kind(m), m.end()
        if kind == "card":
            at = _RUN.match(text, m.start(), stop).end()
            found = _in_run(text, m.start(), at)
            if [x[:2] for x in found] != [m.span()] or at != m.end():
                unsure.append((m.start(), at))
            out += found
        elif kind == "iban":
            end = _iban_end(m)
            if end != m.end():
                unsure.append(m.span())
            if end >= 0:
                out.append((m.start(), end, "iban"))
                at = end
            else:  # neighbours may have been read as one number
                at = m.start() + len(m.group().split(" ")[0])
                out += [(k.start(), k.end(), "card") for k in _ALONE.finditer(text, m.start(), at) if not luhn(k.group()) and k.group()[0] != "0"]
        else:
            out.append((m.start(), m.end(), kind))
    return out, unsure


def _swapped(f: Feistel, text: str, back: bool) -> str:
    """``text`` with its values swapped.

    Digits that could be read in several ways must be read in the same way
    afterwards, else ``reveal`` would take other digits for the value: there,
    all values of the stretch step on along their permutations until they are.
    """
    out, done = [], 0
    for start, end in _islands(text):
        out.append(text[done:start])
        island, done = text[start:end], end
        pad = text[max(0, start - 4) : start]  # what stands before decides, too
        spans, unsure = _spans(pad + island, len(pad), len(pad) + len(island))
        out.append(_stepped(f, pad + island, spans, unsure, back)[len(pad) :])
    return "".join(out) + text[done:] if out else text


def _stepped(f: Feistel, text: str, spans: list[Span], unsure: list[tuple[int, int]], back: bool) -> str:
    def step(t: str, which: list[Span]) -> str:
        new, at = [], 0
        for s, e, kind in which:
            new += [t[at:s], _ACT[kind](f, t[s:e], back)]
            at = e
        return "".join(new) + t[at:]

    parts: list[tuple[int, int, list[Span]]] = []
    for low, high in sorted(unsure):
        if parts and low < parts[-1][1]:
            low, high = parts[-1][0], max(high, parts.pop()[1])
        own = [x for x in spans if low <= x[0] < high]
        parts.append((low, max([high, *(e for _, e, _ in own)]), own))
    held = {x for _, _, own in parts for x in own}
    text = step(text, [x for x in spans if x not in held])
    out, done = [], 0
    for low, high, own in parts:
        if not own:
            continue
        pad = max(0, low - 4)  # what stands before decides, too
        own, part, top = [(s - pad, e - pad, k) for s, e, k in own], text[pad:high], high - pad
        first = new = step(part, own)
        for _ in range(_WALK):
            if new != part and _spans(new, low - pad, top)[0] == own:
                break
            new = step(new, own)
        else:
            new = first
        out += [text[done:low], new[low - pad :]]
        done = high
    return "".join(out) + text[done:] if out else text


_SIGN = re.compile(r"[0-9@]|[=:]\s?[\"']")
_NONBLANK = re.compile(r"\S*")
#: No value reaches further than this from a digit or at sign in it, but for runs without blanks.
_REACH = 48


def _islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits, at signs and quotes after = or :, cut at blanks; no value lies outside or across."""
    start = end = -1
    for m in _SIGN.finditer(text):
        at = m.start()
        if at < end:
            if at + _REACH > end:
                end = _NONBLANK.match(text, min(at + _REACH, len(text))).end()
            continue
        low = max(0, at - _REACH, end)
        edge = max(text.rfind(c, max(0, end), low + 1) for c in " \n\t\r") + 1
        low = edge if edge or end < 0 else low
        if low > end:
            if end >= 0:
                yield start, end
            start = low
        end = _NONBLANK.match(text, min(at + _REACH, len(text))).end()
    if end >= 0:
        yield start, end


def conceal(text: str, key: bytes = DEFAULT_KEY) -> str:
    return _swapped(_network(key), text, False)


def reveal(text: str, key: bytes = DEFAULT_KEY) -> str:
    return _swapped(_network(key), text, True)


@lru_cache(maxsize=8)
def _network(key: bytes) -> Feistel:
    return Feistel(key)


def pseudonymised(df: DataFrame, text_col: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """``df`` with its text pseudonymised; all other columns and rows as they are."""
    ship(df.sparkSession)

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins("privacy")
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at)
            hit = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|[=:]\s?[\"']"), False)
            if pc.any(hit).as_py():
                new = pc.replace_with_mask(texts, hit, pa.array([conceal(t, key) for t in texts.filter(hit).to_pylist()], texts.type))
                batch = batch.set_column(at, batch.schema.field(at), new)
            yield batch

    return df.mapInArrow(swap, df.schema)
