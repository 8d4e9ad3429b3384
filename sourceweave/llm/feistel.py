"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated: card and account numbers by their
check digits, addresses by their ranges, dates by the calendar. A keyed balanced
Feistel network, walked until it lands in range again, permutes each value
within its own format: digits stay digits, letters keep their case, a date stays
a date, a card stays valid. Equal values get equal pseudonyms in all documents
under one key, and ``reveal`` undoes them.

Defined results: null texts stay null and count nothing; a text without personal
data is returned unchanged, byte for byte. Matches do not overlap; the kind
listed first wins. A card is looked for on the group boundaries of its run of
digits, so a count, a CVV or a date beside it hides nothing. A value that fails validation is left alone (a number that is
no card, the 31st of February). Rows are judged one by one.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: the key of a test run; a deployment passes its own
KEY = b"corpus-pseudonyms-1"
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
DIGITS, SMALL, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _round(key: bytes, tweak: bytes, r: int, value: int, size: int) -> int:
    data = tweak + bytes([r]) + value.to_bytes((value.bit_length() + 8) // 8, "big")
    return int.from_bytes(hmac.new(key, data, hashlib.sha256).digest(), "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: Feistel on two halves, walked until the result is in range."""
    if size <= 1:
        return value
    half = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, half)
        for r in range(ROUNDS):
            if back:
                a, b = (b - _round(key, tweak, ROUNDS - 1 - r, a, half)) % half, a
            else:
                a, b = b, (a + _round(key, tweak, r, b, half)) % half
        value = a * half + b
        if value < size:
            return value


def permute_symbols(text: str, key: bytes, tweak: bytes, back: bool = False) -> str:
    """Permutes the letters and digits of a string together; each keeps its class, everything else its place."""
    value, size, classes = 0, 1, []
    for c in text:
        alphabet = next((x for x in (DIGITS, SMALL, UPPER) if c in x), None)
        classes.append(alphabet or c)
        if alphabet:
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    value = permute(value, size, key, tweak + b"".join(x.encode() + b"/" for x in classes), back)
    out = []
    for x in reversed(classes):
        if x in (DIGITS, SMALL, UPPER):
            value, at = divmod(value, len(x))
            x = x[at]
        out.append(x)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check digit of a payload."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _only_digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in text)


def _card(text: str, key: bytes, back: bool) -> str | None:
    d = "".join(c for c in text if c in DIGITS)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    head = permute_symbols(d[:-1], key, b"card", back)
    return _only_digits(text, head + str(luhn(head)))


def _number(text: str, key: bytes, back: bool) -> str | None:
    """A plain long number that is no card: permuted as it stands, never into a valid card; a short one that satisfies Luhn still does."""
    d = "".join(c for c in text if c in DIGITS)
    if len(d) < 9:  # digits of other scripts
        return None
    if luhn(d[:-1]) == int(d[-1]):
        if len(d) > 12:
            return None
        head = permute_symbols(d[:-1], key, b"number-luhn", back)
        return _only_digits(text, head + str(luhn(head)))
    # payload and check offset are permuted apart, so the offset stays away from 0
    head = permute_symbols(d[:-1], key, b"number", back)
    off = (int(d[-1]) - luhn(d[:-1])) % 10
    new = permute(off - 1, 9, key, b"offset" + (d[:-1] if not back else head).encode(), back) + 1
    return _only_digits(text, head + str((luhn(head) + new) % 10))


def _address(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, permute(value, 2**32, key, b"ip", back).to_bytes(4, "big")))


def _email(text: str, key: bytes, back: bool) -> str | None:
    name, _, host = text.rpartition("@")
    labels = host.split(".")
    # the top-level label is a public name and stays
    return permute_symbols(name, key, b"mail", back) + "@" + ".".join([*(permute_symbols(x, key, b"host", back) for x in labels[:-1]), labels[-1]])


def _phone(text: str, key: bytes, back: bool) -> str | None:
    d = "".join(c for c in text if c in DIGITS)
    if not 9 <= len(d) <= 15:
        return None
    keep = 1 if text.startswith("+") else 0  # the first digit of a country code stays
    return _only_digits(text, d[:keep] + permute_symbols(d[keep:], key, b"phone", back))


_DATES = [(re.compile(r"(\d{4})(-)(\d\d)(-)(\d\d)"), (0, 2, 4)), (re.compile(r"(\d{1,2})([./])(\d{1,2})([./])(\d{4})"), (4, 2, 0))]


def _date(text: str, key: bytes, back: bool) -> str | None:
    for pattern, order in _DATES:
        m = pattern.fullmatch(text)
        if not m:
            continue
        parts = list(m.groups())
        if parts[1] != parts[3]:
            return None
        try:
            day = dt.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = dt.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date", back))
        if order[0] == 0:
            return new.isoformat()
        return f"{new.day:02d}{parts[1]}{new.month:02d}{parts[1]}{new.year:04d}"
    return None


def _secret(text: str, key: bytes, back: bool) -> str | None:
    # blocks of 64: half a block stays under the 256 bits of a round, and time follows the length
    return "".join(permute_symbols(text[i : i + 64], key, b"secret", back) for i in range(0, len(text), 64))


#: kind, pattern, treatment; a group named v is the value, else the whole match
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", _email),
    ("secret", r"(?<![A-Za-z0-9])AKIA(?P<v1>[A-Z0-9]{16})(?![A-Za-z0-9])", _secret),
    ("secret", r"(?i:\b(?:password|passwd|secret|token|api_?key))[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?P<v2>[A-Za-z0-9_\-]{8,})", _secret),
    ("address", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)", _address),
    ("date", r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-]|\.\d)", _date),
    ("phone", r"(?<![\dA-Za-z])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)", _phone),
    ("phone", r"(?<![\dA-Za-z+])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)", _phone),
    ("card", r"(?<![\dA-Za-z.+-])\d(?:[ -]?\d){12,}(?![\dA-Za-z])", _card),
    ("number", r"(?<![\dA-Za-z.+-])\d{9,19}(?![\dA-Za-z])", _number),
]
NAMES = list(dict.fromkeys(k for k, _, _ in KINDS))
_PATTERN = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p, _) in enumerate(KINDS)))
_CARD, _CARD_RUN = next((f"k{i}", re.compile(p)) for i, (k, p, _) in enumerate(KINDS) if k == "card")
#: what may start at a group of a digit run that is no card
_REST = re.compile("|".join(f"(?P<k{i}>{p})" for i, (k, p, _) in enumerate(KINDS) if k != "card"))
#: group lengths in which cards are printed
LAYOUTS = [(4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5)]
#: no kind crosses a line feed, and a line without any of these (or AKIA) holds no value
_ANY = re.compile(r"[0-9@=:]")


def cards(run: str) -> list[tuple[int, int]]:
    """Places of the valid cards in a run of digit groups, on group boundaries.

    Single groups come first, then printed layouts, then the longest other stretch of 13 to 19 digits whose groups have
    three digits or more, or that is the whole run; so digits beside a card do not change what is found.
    """
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    sizes = [e - s for s, e in groups]
    free, found = [True] * len(groups), []

    def take(i: int, n: int) -> bool:
        if not all(free[i : i + n]) or not 13 <= sum(sizes[i : i + n]) <= 19:
            return False
        d = "".join(c for c in run[groups[i][0] : groups[i + n - 1][1]] if c in DIGITS)
        if len(d) < 13 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return False
        free[i : i + n] = [False] * n
        found.append((groups[i][0], groups[i + n - 1][1]))
        return True

    for i in range(len(groups)):
        take(i, 1)
    for layout in LAYOUTS:
        for i in range(len(groups) - len(layout) + 1):
            if tuple(sizes[i : i + len(layout)]) == layout:
                take(i, len(layout))
    if len(groups) <= 19:
        take(0, len(groups))
    for i in range(len(groups)):
        n = 0
        while i + n < min(len(groups), i + 6) and sizes[i + n] >= 3:
            n += 1
        any(take(i, k) for k in range(n, 1, -1))
    return sorted(found)


def pseudonymise(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, dict[str, int]]:
    """(text with pseudonyms, number of values replaced by kind)."""
    found: dict[str, int] = {}

    def swap(m: re.Match) -> str | None:
        i = int(m.lastgroup[1:]) if m.lastgroup.startswith("k") else next(i for i in range(len(KINDS)) if f"k{i}" in m.re.groupindex and m.group(f"k{i}") is not None)
        kind, _, treat = KINDS[i]
        group = next((g for g in ("v1", "v2") if f"(?P<{g}>" in KINDS[i][1]), f"k{i}")
        new = treat(m.group(group), key, back)
        if new is None:  # the number may still be of a later kind
            for j in range(i + 1, len(KINDS)):
                if KINDS[j][0] not in (kind, "card") and re.fullmatch(KINDS[j][1], m.group(group)):
                    kind, new = KINDS[j][0], KINDS[j][2](m.group(group), key, back)
                    if new is not None:
                        break
        if new is None:
            return None
        found[kind] = found.get(kind, 0) + 1
        return m.string[m.start() : m.start(group)] + new + m.string[m.end(group) : m.end()]

    def run(line: str, start: int, end: int) -> tuple[str, int]:
        """(what replaces a run of digit groups, where the search goes on)."""
        out, at = [], start
        places = [(start + a, start + b) for a, b in cards(line[start:end])]
        for a, b in [*places, (end, end)]:
            while at < a:
                m = _REST.match(line, at) if line[at] in DIGITS else None
                new = swap(m) if m and (m.end() <= a or a == end) else None
                if new is not None:
                    out.append(new)
                    at = m.end()
                else:  # one group or separator further
                    n = re.compile(r"\d+|.").match(line, at).end()
                    out.append(line[at:n])
                    at = n
            if b > a:
                out.append(_card(line[a:b], key, back))
                found["card"] = found.get("card", 0) + 1
                at = b
        return "".join(out), at

    def whole(line: str) -> str:
        out, at = [], 0
        while m := _PATTERN.search(line, at):
            out.append(line[at : m.start()])
            if m.lastgroup == _CARD:
                new, at = run(line, m.start(), m.end())
            else:
                new, at = swap(m), m.end()
                if new is None and (inside := _CARD_RUN.match(line, m.start())):
                    new, at = run(line, m.start(), inside.end())
            out.append(m.group() if new is None else new)
        return "".join([*out, line[at:]])

    if not _ANY.search(text) and "AKIA" not in text:
        return text, found
    return "\n".join([whole(x) if _ANY.search(x) or "AKIA" in x else x for x in text.split("\n")]), found


def reveal(text: str, key: bytes = KEY) -> str:
    """The text before ``pseudonymise`` under the same key, if no other value of a kind stood in it."""
    return pseudonymise(text, key, True)[0]


def pseudonyms(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", key: bytes = KEY, counts: bool = True) -> DataFrame:
    """``carry`` columns, the text with pseudonyms and, if wanted, the values replaced by kind; no shuffle."""
    keep = [c for c in carry if c != text]
    src = docs.select(*keep, text)
    names = [f"n_{k}" for k in NAMES] if counts else []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema] + [f"{n} int" for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(None, {}) if t is None else pseudonymise(t, key) for t in batch.column(text).to_pylist()]
            cols = [batch.column(c) for c in keep] + [pa.array([t for t, _ in out], pa.string())]
            cols += [pa.array([f.get(n[2:], 0) for _, f in out], pa.int32()) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, text, *names])

    return src.mapInArrow(work, schema)
