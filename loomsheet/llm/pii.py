"""Personal data in texts, also where it is disguised.

Plain identifiers are found in the text as it is. A second look undoes disguises first: a transducer rewrites homoglyphs
(look-alike letters, full-width forms, invisible characters), digits spelled in four languages ("four one seven") and at/dot
spellings ("name [at] host dot org") and keeps, for each piece it writes, the span of the source it came from. Identifiers
found in the rewritten text are mapped back through these spans; those that meet no plain one of their kind are added.

Texts are judged one by one, so a table is one map over its rows; a text without any sign of a disguise is not rewritten.

Defined cases: a null text counts as empty; positions are code points, end exclusive; matches of a kind are leftmost, do not
overlap, and are dropped without retry when they fail their check; rows that repeat give equal results; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsheet.llm.store import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its first digit only, so long runs cost no retries
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> Iterator[Span]:
    """From each @ leftwards over the local part and rightwards over the host."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def plain(text: str) -> dict[str, list[Span]]:
    """The identifiers of each kind in the text as it is."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    if _DIGIT.search(text):
        found["ip"], found["card"] = list(ips(text)), list(cards(text))
        if "+" in text:
            found["phone"] = list(phones(text))
    return found


# Look-alikes of ASCII letters, in two rows that correspond, and what is invisible.
_LOOK = "аеорсухіјѕһԁАВЕКМНОРСТУХІЈЅοανικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．。․"
_MEAN = "aeopcyxijshdABEKMHOPCTYXIJSoavikptuxABEZHIKMNOPTYX@..."
GLYPHS = dict(zip(_LOOK, _MEAN, strict=True))
GLYPHS |= {chr(0xFEE0 + i): chr(i) for i in range(0x21, 0x7F)}
GLYPHS |= dict.fromkeys("­​‌‍⁠﻿", "")
# The digits 0 to 9 as words, a language a line.
DIGIT_WORDS = """
zero one two three four five six seven eight nine
null eins zwei drei vier fünf sechs sieben acht neun
zéro un deux trois quatre cinq six sept huit neuf
cero uno dos tres cuatro cinco seis siete ocho nueve
"""
DIGITS = {w: str(i) for line in DIGIT_WORDS.split("\n") for i, w in enumerate(line.split())}
_ONE = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Letters that an expression without regard to case takes for others.
_FOLD = str.maketrans("ıİſ", "iis")
#: A number in words of fewer different digits is taken for repeated words.
LEAST_DIGITS = 3
_AT, _DOT = "at|arroba|chez", "dot|punto|punkt|point"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"

_SAT = rf" (?:{_AT}) (?=[a-z0-9-]+(?:(?: (?:{_DOT}) |\.)[a-z0-9-]+)*(?: (?:{_DOT}) |\.)[a-z])"
_SDOT = rf" (?<=[a-z0-9] )(?:{_DOT}) (?=[a-z])"
_PLUS = rf"\bplus[ -]+(?=(?:{_ONE})\b)"
_GLYPH = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
# the branches of the transducer but for spaces around brackets; a digit word counts beside a digit or another digit word only,
# as no identifier has a digit that stands alone
_ENCLOSED = re.compile(rf"{_OPEN} *(?:{_AT}|{_DOT}|@|\.) *{_SHUT}", re.I)
_SPELLED = re.compile(rf"{_SAT}|{_SDOT}", re.I)
_WORDED = re.compile(rf"\b(?:{_ONE})\b[ ().-]*(?:[0-9]|(?:{_ONE})\b)|[0-9][ ().-]+(?:{_ONE})\b|{_PLUS}", re.I)
_REWRITE = re.compile(
    rf"(?P<glyph>[{''.join(map(re.escape, GLYPHS))}])"
    rf"|(?P<at> *{_OPEN} *(?:{_AT}|@) *{_SHUT} *)"
    rf"|(?P<dot> *{_OPEN} *(?:{_DOT}|\.) *{_SHUT} *)"
    rf"|(?P<sat>{_SAT})"
    rf"|(?P<sdot>{_SDOT})"
    rf"|(?P<plus>{_PLUS})"
    rf"|\b(?P<digit>{_ONE})\b",
    re.I,
)


class Rewritten:
    """A text without disguises, as pieces that were copied or written anew; each knows where in the source it comes from."""

    def __init__(self, text: str):
        out: list[str] = []
        self.at: list[int] = []
        self.source: list[Span] = []
        self.copied: list[bool] = []
        size = last = 0

        def put(piece: str, lo: int, hi: int, copied: bool) -> None:
            nonlocal size
            if piece:
                out.append(piece)
                self.at.append(size)
                self.source.append((lo, hi))
                self.copied.append(copied)
                size += len(piece)

        for m in _REWRITE.finditer(text):
            put(text[last : m.start()], last, m.start(), True)
            last = m.end()
            kind = m.lastgroup
            if kind == "glyph":
                new = GLYPHS[m[0]]
            elif kind == "digit":
                new = DIGITS[m[0].translate(_FOLD).lower()]
            else:
                new = {"at": "@", "sat": "@", "dot": ".", "sdot": ".", "plus": "+"}[kind]
            put(new, m.start(), last, False)
        put(text[last:], last, len(text), True)
        self.text = "".join(out)

    def span(self, lo: int, hi: int) -> Span:
        """The source of the written characters lo to before hi."""
        first, last = bisect_right(self.at, lo) - 1, bisect_right(self.at, hi - 1) - 1
        start, end = self.source[first][0], self.source[last][1]
        if self.copied[first]:
            start += lo - self.at[first]
        if self.copied[last]:
            end = self.source[last][0] + hi - self.at[last]
        return start, end

    def spelled(self, lo: int, hi: int) -> int:
        """How many of these characters stand for longer ones."""
        pieces = range(bisect_right(self.at, lo) - 1, bisect_right(self.at, hi - 1))
        return sum(not self.copied[i] and self.source[i][1] - self.source[i][0] > 1 for i in pieces)


def disguised(text: str) -> bool:
    """Whether the text shows a sign of a disguise; rewriting other texts adds nothing."""
    return bool(
        (not text.isascii() and _GLYPH.search(text))
        or _ENCLOSED.search(text)
        or _SPELLED.search(text)
        or _WORDED.search(text)
    )


def added(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Identifiers seen only without disguises, as spans of the source."""
    if not disguised(text):
        return {k: [] for k in KINDS}
    clear = Rewritten(text)
    found = plain(clear.text)
    # a number spelled out in words needs no plus sign to be a phone number
    for m in _CARD.finditer(clear.text):
        lo, hi = m.span()
        digits = m[0].replace(" ", "").replace("-", "")
        if 9 <= len(digits) <= 15 and len(set(digits)) >= LEAST_DIGITS and 2 * clear.spelled(lo, hi) > len(digits):
            found["phone"].append((lo, hi))
    result = {}
    for kind, spans in found.items():
        new: list[Span] = []
        for lo, hi in sorted({clear.span(lo, hi) for lo, hi in spans}):
            if all(hi <= a or b <= lo for a, b in base[kind]) and (not new or new[-1][1] <= lo):
                new.append((lo, hi))
        result[kind] = new
    return result


def _joined(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k in KINDS for lo, hi in sorted(found[k]))


_FIELDS = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            base = plain(text)
            extra = added(text, base)
            every = {k: base[k] + extra[k] for k in KINDS}
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*(len(base[k]) for k in KINDS), digest, _joined(every)))
        columns = list(zip(*rows, strict=True)) or [()] * (len(KINDS) + 2)
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=[f.split()[0] for f in _FIELDS.split(", ")],
        )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_texts(texts, _scan, _FIELDS)
