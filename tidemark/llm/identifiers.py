"""Personal data in texts, plain and disguised, with spans in the text as it was given.

Each kind has a plain detector, linear in the text. Disguises are undone by
transducers, one after another: look-alike characters, at and dot in words or
brackets, spelled digits. Each rewrites the text by a list of edits that keeps
what stood where. The detectors run again over the rewritten text, and what they
find by an edit is mapped back through the edits to the characters it came from.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, slices

TEXT_BYTES = 4 << 20
SCHEMA = (
    "id long, spans array<struct<kind: string, start: long, stop: long, plain: boolean>>"
)
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                   ("plain", pa.bool_())])

# ---- Plain detectors -------------------------------------------------------

# The characters of an address before and after the at sign.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin only where a row of digits does: later digits of it fail alike.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = str.maketrans("", "", " ().-+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low = 0
    for found in _DOMAIN.finditer(text):
        at = found.start()
        # What may stand before the sign, back to the last sign or match.
        low = max(low, text.rfind("@", low, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at:
            yield start, found.end()
            low = found.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for found in _IP.finditer(text):
        parts = (part.lstrip("0") for part in found.groups())
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            yield found.span()


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(one), 10)) for one in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found.group().translate(_NOT_DIGITS)
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 8 <= len(found.group().translate(_NOT_DIGITS)) <= 15:
            yield found.span()


# In the order in which spans are told.
DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


# ---- Rewriting with a way back ---------------------------------------------

class Edit(NamedTuple):
    """``text[start:stop]`` becomes ``out``."""

    start: int
    stop: int
    out: str


class Rewritten:
    """A text after edits (rising, apart), and where its characters came from."""

    def __init__(self, text: str, edits: list[Edit]) -> None:
        pieces, done, size = [], 0, 0
        self.edits = edits
        self.starts: list[int] = []
        for edit in edits:
            pieces += (text[done:edit.start], edit.out)
            size += edit.start - done
            self.starts.append(size)
            size += len(edit.out)
            done = edit.stop
        self.text = "".join((*pieces, text[done:]))

    def _place(self, at: int) -> tuple[int, int]:
        """(start, stop) in the source of one character."""
        number = bisect_right(self.starts, at) - 1
        if number < 0:
            return at, at + 1
        edit = self.edits[number]
        over = at - self.starts[number] - len(edit.out)
        if over < 0:
            return edit.start, edit.stop
        return edit.stop + over, edit.stop + over + 1

    def source(self, start: int, stop: int) -> tuple[int, int]:
        """The span in the source that ``text[start:stop]`` came from."""
        return self._place(start)[0], self._place(stop - 1)[1]


# ---- Transducers -----------------------------------------------------------

# Letters of other scripts and the ASCII letters they look like.
_ALIKE = dict(zip(
    "аеорсухіјѕԁһӏԛԝкмтв" "АВЕКМНОРСТХУІЈЅ" "αονρικυχ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɑɡ" "。",
    "aeopcyxijsdhlqwkmtb" "ABEKMHOPCTXYIJS" "aovpikux" "ABEZHIKMNOPTYX" "iag" "."))
# Characters without a width.
_NO_WIDTH = "­​‌‍⁠﻿"
# Planes that hold compatibility forms of letters, digits and signs.
_PLANES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200))


def _alike(char: str) -> str | None:
    """The one ASCII character that stands for ``char``: by compatibility, or as a digit."""
    plain = unicodedata.normalize("NFKC", char)
    if len(plain) == 1 and " " <= plain <= "~":
        return plain
    digit = unicodedata.decimal(char, None)
    return None if digit is None else str(digit)


def _look_alikes() -> dict[str, str]:
    found = {char: plain for low, high in _PLANES for char in map(chr, range(low, high))
             if (plain := _alike(char)) is not None}
    return found | _ALIKE | dict.fromkeys(_NO_WIDTH, "")


_CHARS = _look_alikes()
# Between digits: dashes, and letters that look like digits.
_BETWEEN = re.compile("(?<=[0-9])(?:[‐-―−]|[OoIl]{1,3})(?=[0-9])")
_AS_DIGITS = str.maketrans("OoIl‐‑‒–—―−", "0011" + "-" * 7)


def _characters(text: str) -> list[Edit]:
    """Look-alikes of other scripts, compatibility forms, marks without a width."""
    # A pattern of the few that occur is far faster than one of them all.
    here = [] if text.isascii() else sorted(_CHARS.keys() & set(text))
    odd = here and re.compile("[" + "".join(map(re.escape, here)) + "]")
    return [Edit(*found.span(), _CHARS[found.group()]) for found in odd.finditer(text)] if here else []


def _digits_alike(text: str) -> list[Edit]:
    """Letters and dashes that stand for a digit or hyphen between digits."""
    return [Edit(*found.span(), found.group().translate(_AS_DIGITS)) for found in _BETWEEN.finditer(text)]


# How the signs of an address are spelled.
_AT, _DOT = "at|arobase|arroba|klammeraffe", "dot|punkt|punto|point"
_GAP = r"(?:[ \t\r\n]{1,3}|[_*]{1,2}|-)"
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]{0,62}"
_OPEN, _SHUT = r"[ \t]{0,3}[\[({<][ \t]{0,2}", r"[ \t]{0,2}[\])}>][ \t]{0,3}"
_BRACKETED = re.compile(
    rf"(?<=[A-Za-z0-9]){_OPEN}(?:(?P<at>@|{_AT})|\.|{_DOT}){_SHUT}(?=[A-Za-z0-9])", re.IGNORECASE)
_DOT_WORD = re.compile(rf"(?<![^\W_])(?:{_DOT})(?![^\W_])", re.IGNORECASE)
# at and dot both in words, as either alone is everyday language; after a sign, dots all in words.
_WORD_DOT, _END = rf"{_GAP}(?:{_DOT}){_GAP}", r"(?![A-Za-z0-9-])"
_IN_WORDS = re.compile(
    rf"(?<=[A-Za-z0-9])(?:(?P<at>{_GAP}(?:{_AT}){_GAP})(?P<domain>{_LABEL}?(?:(?:{_WORD_DOT}|\.){_LABEL}?){{1,8}})"
    rf"|@(?P<after>{_LABEL}?(?:{_WORD_DOT}{_LABEL}?){{1,8}})){_END}", re.IGNORECASE)
_TOP = re.compile(rf"(?<![A-Za-z0-9-])(?!(?:{_DOT})\Z)[A-Za-z]{{2,24}}\Z", re.IGNORECASE)
_DOT_GAP = re.compile(_WORD_DOT, re.IGNORECASE)
_DOT_DIGITS = re.compile(rf"(?<=[0-9])[ \t]{{1,3}}(?:{_DOT})[ \t]{{1,3}}(?=[0-9])", re.IGNORECASE)
_SPACED_SIGN = re.compile(r"(?<=[A-Za-z0-9])(?:[ \t]{1,3}@[ \t]{0,3}|@[ \t]{1,3})(?=[A-Za-z0-9-]+\.[A-Za-z]{2})")


def _brackets(text: str) -> list[Edit]:
    """At and dot signs in brackets, in words or not."""
    return [Edit(*found.span(), "@" if found["at"] else ".") for found in _BRACKETED.finditer(text)]


def _signs(text: str) -> list[Edit]:
    """At and dot signs in words, and at signs with blanks around them."""
    edits = [Edit(*found.span(), "@") for found in _SPACED_SIGN.finditer(text)]
    if _DOT_WORD.search(text):
        edits += [Edit(*found.span(), ".") for found in _DOT_DIGITS.finditer(text)]
        for found in _IN_WORDS.finditer(text):
            part = "domain" if found["at"] else "after"
            dots = [Edit(*dot.span(), ".") for dot in _DOT_GAP.finditer(text, *found.span(part))]
            if dots and _TOP.search(found[part]):
                edits += [Edit(*found.span("at"), "@")] * bool(found["at"]) + dots
    return _apart(edits)


# The digits 0 to 9 as words of four languages.
_NUMBERS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_SPELLED = {word: str(digit) for line in _NUMBERS for digit, word in enumerate(line.split())} | {"oh": "0"}
_TIMES = {"double": 2, "triple": 3}
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_BREAK = r"[ \t\r\n,-]{1,3}"
_ONE = rf"(?:(?:double|triple){_BREAK})?(?:{_WORD})(?![^\W_])"
_SPELLED_RUN = re.compile(
    rf"(?<![^\W_])(?:plus{_BREAK})?{_ONE}(?:(?:{_BREAK}(?:{_DOT})(?![^\W_]))?{_BREAK}{_ONE}|\.{_ONE}){{2,}}",
    re.IGNORECASE)
_TOKEN = re.compile(rf"(?<![^\W_])(?:plus|double|triple|{_DOT}|{_WORD})(?![^\W_])|\.", re.IGNORECASE)


def _spelled(text: str) -> list[Edit]:
    """Rows of three digits or more in words, and the blanks between them."""
    edits = []
    for run in _SPELLED_RUN.finditer(text):
        done, times = run.start(), 1
        for token in _TOKEN.finditer(text, run.start(), run.end()):
            said = token.group().lower()
            if token.start() > done:
                edits.append(Edit(done, token.start(), ""))
            done = token.end()
            if said in _TIMES:
                times = _TIMES[said]
                edits.append(Edit(*token.span(), ""))
            elif said == "plus":
                edits.append(Edit(*token.span(), "+"))
            else:
                edits.append(Edit(*token.span(), times * _SPELLED.get(said, ".")))
                times = 1
    return edits


def _apart(edits: list[Edit]) -> list[Edit]:
    """The edits in order, without those that begin inside an earlier one."""
    found: list[Edit] = []
    for edit in sorted(edits):
        if not found or edit.start >= found[-1].stop:
            found.append(edit)
    return found


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (
    _characters, _brackets, _signs, _spelled, _digits_alike)


# ---- Whole texts -----------------------------------------------------------

class Span(NamedTuple):
    """Code points ``start`` to ``stop`` hold a ``kind``; ``plain`` if without a disguise."""

    kind: str
    start: int
    stop: int
    plain: bool


def find_spans(text: str) -> list[Span]:
    """All spans by kind, start and stop."""
    plain = {kind: list(detect(text)) for kind, detect in DETECTORS.items()}
    found = [Span(kind, *span, True) for kind, spans in plain.items() for span in spans]
    stages: list[Rewritten] = []
    last = text
    for transducer in TRANSDUCERS:
        edits = transducer(last)
        if edits:
            stages.append(Rewritten(last, edits))
            last = stages[-1].text
    if stages:
        for kind, detect in DETECTORS.items():
            starts = [start for start, _ in plain[kind]]
            for span in detect(last):
                low, high = span
                for stage in reversed(stages):
                    low, high = stage.source(low, high)
                if text[low:high] == last[slice(*span)]:
                    continue
                # What a plain span holds already is no find.
                before = bisect_right(starts, low) - 1
                if before < 0 or plain[kind][before][1] < high:
                    found.append(Span(kind, low, high, False))
    order = list(DETECTORS)
    return sorted(found, key=lambda one: (order.index(one.kind), one.start, one.stop))


def find_identifiers(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per input row: ``id`` and its ``spans`` of personal data.

    Kinds are email, ip, card and phone. Spans count code points of the text as
    given, the end exclusive, sorted by kind (in that order), start and stop.
    ``plain`` spans are the leftmost non-overlapping matches of each kind's
    pattern that pass its check. Others were disguised: by look-alike or
    invisible characters, at and dot signs in words or brackets, or spelled
    digits; one that lies inside a plain span of its kind is not told again, but
    one that goes beyond it is.

    Null and empty texts have no spans. Texts are read whole, whatever their
    length; no detector or transducer goes over a text more than once a rule.
    Repeated rows each give a row; an empty table gives an empty result. Only
    the two named columns are read, and no rows are shuffled.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                rows = [[one._asdict() for one in find_spans(text or "")]
                        for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(rows, pa.list_(_SPAN))], names=["id", "spans"])

    return id_and_text(docs, id_column, text_column).mapInArrow(found, SCHEMA)
