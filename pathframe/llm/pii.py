"""Personal data, plain and disguised, as spans of the original text.

Plain identifiers (e-mail, ip, card, phone) are matched as they stand.  For
disguised ones a chain of transducers rewrites the text: look-alike letters,
wide digits and invisible characters are folded, bracketed or spelled "at" and
"dot" become marks, spelled digits become digits.  Every rewritten character
keeps the source range that it came from, so a match over the rewritten text
maps back to exact source offsets.  Spans are in code points, end exclusive.

A document enters the chain only if it holds something a transducer rewrites;
for any other the rewritten text is the text.  All matching is linear: e-mails
start from each ``@``, digit runs are taken whole.

Null text is empty: no spans.  Repeated rows are searched each.  An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathframe.llm.common import tidy

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


# -- plain identifiers --------------------------------------------------------


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split("."))))


def cards(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d))


def phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)``, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", *s) for s in emails(text))
    if _DIGIT.search(text):
        for kind, search in (("ip", ips), ("card", cards), ("phone", phones)):
            found += ((kind, *s) for s in search(text))
    return found


# -- transducers --------------------------------------------------------------


@dataclass
class Mapped:
    """A rewritten text; character ``i`` came from source ``[start[i], end[i])``."""

    text: str
    start: list[int]
    end: list[int]

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str | None]) -> Mapped:
        """Each match's first group (or all of it) becomes ``to(match)``; every new character maps to the whole of it."""
        parts: list[str] = []
        start: list[int] = []
        end: list[int] = []
        at = 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None:
                continue
            a, b = m.span()
            parts += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        if not at:
            return self
        parts.append(self.text[at:])
        return Mapped("".join(parts), start + self.start[at:], end + self.end[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ё": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ї": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ℓ": "l", "∙": ".", "•": ".", "·": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
# Characters that show nothing.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
# Digits as words, in the corpus's languages; "plus", and words that repeat the next digit.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
REPEATS = {"double": 2, "triple": 3}
PLUS_WORDS = ("plus", "más", "mas")
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe", "ät")
DOT_WORDS = ("dot", "punto", "point", "punkt", "period")

_ODD = re.compile(rf"[^\x00-\xac\xae-˿]|[{INVISIBLE}ıɡ·]")
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _CLOSE = r"[\[({<|]", r"[\])}>|]"
_MARK_AT = re.compile(rf"\s*(?:{_OPEN}\s*(?:{_AT}|@|a)\s*{_CLOSE}|(?:(?<=\w)|(?<=\s))[_*-](?:{_AT})[_*-](?=[\w\s]))\s*", re.I)
_MARK_DOT = re.compile(rf"\s*(?:{_OPEN}\s*(?:{_DOT}|\.|d[o0]t)\s*{_CLOSE}|(?:(?<=\w)|(?<=\s))[_*-](?:{_DOT})[_*-](?=[\w\s]))\s*", re.I)
_WORD_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{_DOT})\s+(?=[A-Za-z0-9])", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s*@\s*(?=[A-Za-z0-9])")
#: Stands for a dot that was disguised until "at" is decided.
_FOUND = ""
_WORD_AT_FOUND = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{_AT})\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_FOUND}[A-Za-z0-9-]+)", re.I)
_WORD_AT_PLAIN = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{_AT})\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,10}}(?![A-Za-z0-9]))", re.I)
_SPACED_DOT = re.compile(r"@[A-Za-z0-9-]+(?:\s+\.\s*[A-Za-z0-9-]+)+(?![A-Za-z0-9-])")
_WORDS = "|".join(sorted((*DIGIT_WORDS, *REPEATS), key=len, reverse=True))
_ONE = rf"(?:(?:{_WORDS})(?!\w)|[0-9])"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(PLUS_WORDS)})[\s,-]+)?{_ONE}(?:[\s,./()-]*(?<![a-zA-Z0-9]){_ONE}|(?<=[0-9])[0-9])+", re.I)
_TOKEN = re.compile(rf"({'|'.join(PLUS_WORDS)})(?!\w)|({_WORDS})(?!\w)|([0-9])", re.I)
_MIXED = re.compile(r"[0-9OoIl]{2,}")
_HINT = re.compile(rf"{_OPEN}\s*(?:{_AT}|{_DOT}|[@.a]|d0t)\s*{_CLOSE}|[_*-](?:{_AT}|{_DOT})[_*-]|\s(?:{_DOT})\s", re.I)
_HINT_SPACED_AT = re.compile(r"\s@|@\s")
_HINT_MIXED = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
_INNER_DOT = re.compile(r"\.[A-Za-z]")
#: Digits that are spelled have a word beside another or beside a digit.
_HINT_DIGITS = re.compile(rf"(?<!\w)(?:{_WORDS})[\s,./()-]+(?:(?:{_WORDS})(?!\w)|[0-9])|[0-9][\s,./()-]+(?:{_WORDS})(?!\w)", re.I)
_SPELLING = frozenset((*DIGIT_WORDS, *REPEATS))
_WORD = re.compile(r"\w+")
#: Letters that match i and s where case is ignored, but aren't them in lower case.
_CASELESS = str.maketrans({"İ": "i", "ſ": "s"})
#: A run of spelled digits has so many different ones, or it is a word repeated.
DISTINCT_DIGITS = 3


def _disguised(text: str, digit: bool) -> bool:
    """Whether a transducer may find something; plain substring tests come first.

    Each test holds for all that its transducer rewrites.
    """
    if not text.isascii() and _ODD.search(text):
        return True
    low = text.translate(_CASELESS).lower()
    if any(c in text for c in "[({<|_*-") or any(w in low for w in DOT_WORDS):
        if _HINT.search(text):
            return True
    if "@" in text and (_HINT_SPACED_AT.search(text) or _SPACED_DOT.search(text)):
        return True
    if digit and _HINT_MIXED.search(text):
        return True
    if any(w in low for w in AT_WORDS) and _INNER_DOT.search(text) and _WORD_AT_PLAIN.search(text):
        return True
    return not _SPELLING.isdisjoint(_WORD.findall(low)) and bool(_HINT_DIGITS.search(text))


def _fold(m: re.Match) -> str:
    c = m[0]
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    wide = unicodedata.normalize("NFKC", c)
    if len(wide) == 1 and wide.isascii():
        return wide
    value = unicodedata.digit(c, None)
    return c if value is None else str(value)


def _spelled(m: re.Match) -> str | None:
    found = list(_TOKEN.finditer(m[0]))
    named = lambda t: t[2].translate(_CASELESS).lower()
    digits = {t[3] or DIGIT_WORDS.get(named(t)) for t in found if t[2] or t[3]} - {None}
    if len(digits) < DISTINCT_DIGITS or sum(1 for t in found if t[2]) < 2:
        return None
    out, times, plus, last = [], 1, "", 0
    for t in _TOKEN.finditer(m[0]):
        if out and m[0][last : t.start()] == ".":
            out.append(".")
        last = t.end()
        if t[1]:
            plus = "+"
        elif t[2] and named(t) in REPEATS:
            times = REPEATS[named(t)]
        else:
            out.append((DIGIT_WORDS[named(t)] if t[2] else t[3]) * times)
            times = 1
    return plus + "".join(out)


def _mixed(m: re.Match) -> str | None:
    s = m[0]
    if s.isdigit() or 2 * sum(c.isdigit() for c in s) < len(s):
        return None
    return s.translate(str.maketrans("OoIl", "0011"))


def normalise(text: str) -> Mapped:
    """The text as it reads once disguises are undone."""
    m = Mapped.of(text)
    m = m.rewrite(_ODD, _fold)
    m = m.rewrite(_MIXED, _mixed)
    m = m.rewrite(_MARK_AT, lambda x: "@")
    m = m.rewrite(_MARK_DOT, lambda x: _FOUND)
    m = m.rewrite(_WORD_DOT, lambda x: _FOUND)
    m = m.rewrite(_WORD_AT_FOUND, lambda x: "@")
    # Before a plain domain "at" is common speech: only after a name with a digit, dot or underscore.
    m = m.rewrite(_WORD_AT_PLAIN, lambda x: "@" if re.search(r"[0-9._]", re.search(r"\S*\Z", x.string[max(0, x.start() - 64) : x.start()])[0]) else None)
    m = m.rewrite(re.compile(_FOUND), lambda x: ".")
    m = m.rewrite(_SPACED_AT, lambda x: "@")
    m = m.rewrite(_SPACED_DOT, lambda x: "".join(x[0].split()))
    m = m.rewrite(_SPELLED, _spelled)
    return m


def _near_misses(text: str) -> Iterator[tuple[str, int, int]]:
    """Cards and phones that stand in one run of digits with something else."""
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            continue
        for g in re.finditer(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])", m[0]):
            if luhn(_digits(g[0])):
                yield "card", m.start() + g.start(), m.start() + g.end()
    for m in _PHONE.finditer(text):
        if len(_digits(m[0])) > 15:
            g = re.match(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){2,4}(?![0-9])", m[0])
            if g and 9 <= len(_digits(g[0])) <= 15:
                yield "phone", m.start(), m.start() + g.end()


class _Apart:
    """Spans that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def _met(self, a: int, b: int) -> tuple[int, int]:
        return bisect_right(self.ends, a), bisect_left(self.starts, b)

    def meets(self, a: int, b: int) -> bool:
        first, stop = self._met(a, b)
        return first < stop

    def inside(self, a: int, b: int) -> bool:
        """Whether all that overlap lie within."""
        first, stop = self._met(a, b)
        return first >= stop or (a <= self.starts[first] and self.ends[stop - 1] <= b)

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans, by kind as listed, then start."""
    plain = plain_spans(text)
    digit = bool(_DIGIT.search(text))
    more = list(_near_misses(text)) if digit else []
    if _disguised(text, digit):
        m = normalise(text)
        found = plain_spans(m.text)
        more += ((k, *m.source(a, b)) for k, a, b in found)
        # Spelled digits of a phone's length need no plus: nothing else is spelled so long.
        for x in re.finditer(r"(?<![0-9+])[0-9]{9,12}(?![0-9])", m.text):
            a, b = m.source(*x.span())
            if sum(c.isalpha() for c in text[a:b]) > 20:
                more.append(("phone", a, b))
    kept, at = list(plain), {k: _Apart([s[1:] for s in plain if s[0] == k]) for k in KINDS}
    added = {k: _Apart([]) for k in KINDS}
    # The longest first: one that is added later can't hold one that was added before, so those are apart too.
    for k, a, b in sorted(set(more) - set(plain), key=lambda s: (s[1] - s[2], s[1])):
        # What lies in a span of its kind is said; a card in a longer phone is two things.
        if not added[k].meets(a, b) and at[k].inside(a, b):
            added[k].add(a, b)
            kept.append((k, a, b))
    kept = sorted(set(kept), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return plain, kept


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"<{k}>")
            at = b
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, plain, spans)``: arrays of ``(kind, start, end)``, ``plain`` those that are not disguised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain, spans = [], []
            for value in b.column(1):
                p, s = find_spans(value.as_py() or "")
                plain.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in p])
                spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in s])
            yield pa.record_batch([b.column(0), pa.array(plain, _SPANS), pa.array(spans, _SPANS)], names=["doc_id", "plain", "spans"])
            tidy()

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, plain {kind}, spans {kind}")
