"""Personal data in texts, plain or disguised, by code points of the source."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds, written so that no run of characters is walked more than a few times.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]++\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts as far left of its @ as the local part goes, but not before the last match's end."""
    end = 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def plain_spans(text: str) -> list[Span]:
    """(kind, start, end) of the leftmost matches of each kind that pass its test, by kind and start.

    Matches of a kind don't overlap; one that fails its test is dropped and not tried shorter.
    """
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Cyrillic, Greek and other letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "г": "r", "п": "n", "ь": "b", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ӏ": "I",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "օ": "o", "ո": "n", "ս": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "٫": ".", "‚": ",",
}
# Characters without a width, which are skipped.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
# Words for digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words and signs put for the at sign, the dot and the plus sign.
AT_WORDS = ("at", "ät", "arroba", "arobase", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "punto", "point")
PLUS_WORDS = ("plus", "más")

# Which word for a dot may follow which word for an at sign.
AT_AND_DOT = {"at": "dot", "ät": "dot|punkt", "klammeraffe": "dot|punkt", "arroba": "dot|punto", "arobase": "dot|point"}

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOTS, _PLUS = "|".join(DOT_WORDS), "|".join(PLUS_WORDS)
_NAME = r"[a-z0-9-]+"


def _one_of(words: Iterable[str]) -> str:
    """A pattern for any of the words that looks at a first letter once."""
    first: dict[str, list[str]] = {}
    for word in sorted(words, key=len, reverse=True):
        first.setdefault(word[0], []).append(word[1:])
    return f"(?=[{''.join(first)}])(?:{'|'.join(f'{c}(?:{'|'.join(rest)})' for c, rest in first.items())})"


# All of these read a text in lower case.
DIGIT_WORD = re.compile(rf"\b(?:(double|triple)[ -])?({_one_of([*DIGIT_WORDS, 'o', 'oh'])})\b")
#: Digits with letters put for some of them, as o for 0 and l for 1.
MIXED_DIGITS = re.compile(r"(?<![a-z0-9])(?=[ol]*[0-9])(?=[0-9]*[oli])[0-9oli]+(?![a-z0-9])")
LETTERS_TO_DIGITS = str.maketrans("oli", "011")
#: What may stand between two digits that belong together, and a spelled sign before or after one.
GAP = re.compile(r"[ \t\n,-]{1,3}")
DIGIT_BEFORE, DIGIT_AFTER = re.compile(r"[0-9][ \t\n,-]{1,3}\Z"), re.compile(r"[ \t\n,-]{1,3}[0-9]")
SIGN_BEFORE = re.compile(rf"(?<!\w)(?:{_DOTS}|{_PLUS}|{_OPEN}\s?\.\s?){_CLOSE}?\s?\Z|\+\Z")
SIGN_AFTER = re.compile(rf"\s?{_OPEN}?\s?(?:{_DOTS}|(?<=[\[({{<])\.)(?!\w)")
DIGIT_DOT = re.compile(rf"(?<=[0-9])\s(?:{_DOTS})\s(?=[0-9])")
PLUS = re.compile(rf"\b(?:{_PLUS})\s(?=[0-9])")
#: Signs in brackets; a blank before and one after go with them.
MARKED_AT = re.compile(rf"{_OPEN}(?:\s?(?:{'|'.join(AT_WORDS)}|@)\s?{_CLOSE}\s?|(?<=\w.)a[\])](?=\w))")
MARKED_DOT = re.compile(rf"{_OPEN}\s?(?:{_DOTS}|\.)\s?{_CLOSE}\s?")
JOINED_AT = re.compile(rf"(?<=\w)[_-]at[_-](?=[a-z0-9]+(?:[_-]dot[_-]|\s?{_OPEN}|\.[a-z]))")
JOINED_DOT = re.compile(r"(?<=\w)[_-]dot[_-](?=\w)")
#: A bare word or a spaced sign, if a domain with a dot of that language follows.
WORD_AT = re.compile(
    r"\s{1,2}(?:(?P<word>"
    + "|".join(rf"{at}(?=\s{{1,2}}{_NAME}(?:\s(?:{dot})\s|\s?{_OPEN}|\.)[a-z0-9.\s])" for at, dot in AT_AND_DOT.items())
    + rf")|@(?=\s{{1,2}}{_NAME}(?:\s(?:{_DOTS}|\.)\s|\s?{_OPEN}|\.[a-z0-9])))\s{{1,2}}(?={_NAME}(?P<plain>\.)?)"
)
LOCAL_PART = re.compile(r"[a-z0-9._%+-]{1,64}\Z")
TELLING = re.compile(r"[0-9._+]")
#: Dots in words or between blanks, behind an at sign (one language at a time) and before one.
DOMAIN_DOTS = re.compile("|".join(rf"@{_NAME}(?:(?:\s(?:{word}|\.)\s|\.)[a-z0-9][a-z0-9-]*)+" for word in DOT_WORDS))
LOCAL_DOTS = re.compile(r"(?:\s(?:dot|punkt|punto)\s[a-z0-9._%+-]{1,64}){1,8}@")
SPELLED_DOT = re.compile(rf"\s(?:{_DOTS}|\.)\s")

Edit = tuple[int, int, str]


class Rewritten(NamedTuple):
    """A text with edits applied, and where each of its stretches comes from."""

    text: str
    starts: list[int]
    sources: list[tuple[int, int, bool]]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text before the edits; a character put in by an edit stands for all it replaces."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first, _, kept = self.sources[i]
        begin = first + start - self.starts[i] if kept else first
        first, last, kept = self.sources[j]
        return begin, first + end - self.starts[j] if kept else last

    def edited(self, start: int, end: int) -> bool:
        """Whether a stretch put in by an edit, or a place where one took characters out, lies within."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        return j > i or not self.sources[i][2]


def rewrite(text: str, edits: list[Edit]) -> Rewritten:
    """Apply edits (start, end, replacement), rising and without overlap."""
    parts, starts, sources, at, length = [], [], [], 0, 0
    for start, end, new in [*edits, (len(text), len(text), "")]:
        if start > at:
            parts.append(text[at:start])
            starts.append(length)
            sources.append((at, start, True))
            length += start - at
        if new:
            parts.append(new)
            starts.append(length)
            sources.append((start, end, False))
            length += len(new)
        at = end
    return Rewritten("".join(parts), starts, sources)


@cache
def _characters() -> dict[str, str]:
    """What stands for each character that stands for one ASCII character or none, by Unicode's
    compatibility forms and the list above."""
    table = dict.fromkeys(INVISIBLE, "")
    for code in range(128, 0x1FBFA):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        digit = unicodedata.digit(char, None)
        if len(plain) == 1 and " " <= plain <= "~":
            table[char] = plain
        elif digit is not None:
            table[char] = str(digit)
    del table["ª"], table["º"]
    return table | LOOKALIKES


def _character_edits(text: str) -> list[Edit]:
    if text.isascii():
        return []
    table = _characters()
    if not (present := table.keys() & set(text)):
        return []
    pattern = re.compile("[" + re.escape("".join(sorted(present))) + "]")
    return [(m.start(), m.end(), table[m[0]]) for m in pattern.finditer(text)]


def _digit_edits(text: str) -> list[Edit]:
    """Digit words in company become digits, and what stands between two of them goes.

    Company is another digit word, digits on both sides, or a spelled dot or plus; "o" and "oh" need
    company on both sides. A number word alone in prose stays.
    """
    edits: list[Edit] = [(m.start(), m.end(), m[0].translate(LETTERS_TO_DIGITS)) for m in MIXED_DIGITS.finditer(text)]
    found = list(DIGIT_WORD.finditer(text))
    joined = False
    for i, m in enumerate(found):
        start, end = m.span()
        near = i > 0 and bool(GAP.fullmatch(text, found[i - 1].end(), start))
        after = i + 1 < len(found) and bool(GAP.fullmatch(text, end, found[i + 1].start()))
        before = text[max(0, start - 16) : start]
        left = near or bool(SIGN_BEFORE.search(before))
        right = after or bool(SIGN_AFTER.match(text, end))
        between = bool(DIGIT_BEFORE.search(before)) and bool(DIGIT_AFTER.match(text, end))
        unsure = m[2].lower() in ("o", "oh")
        if not (left and right or between or not unsure and (left or right)):
            joined = False
            continue
        if near and joined:
            edits.append((found[i - 1].end(), start, ""))
        edits.append((start, end, DIGIT_WORDS.get(m[2].lower(), "0") * {"double": 2, "triple": 3}.get((m[1] or "").lower(), 1)))
        joined = True
    return _apart(edits)


def _marked(text: str, pattern: re.Pattern, sign: str) -> list[Edit]:
    """Marks that give way to a sign, with a blank before them."""
    return [(m.start() - (m.start() > 0 and text[m.start() - 1].isspace()), m.end(), sign) for m in pattern.finditer(text)]


def _sign_edits(text: str) -> list[Edit]:
    edits = [(m.start(), m.end(), ".") for m in DIGIT_DOT.finditer(text)]
    for start, end, sign in _marked(text, MARKED_DOT, "."):
        if start and text[start - 1] in "0123456789" and text[end : end + 1] in tuple("0123456789"):
            edits.append((start, end, sign))
    if any(word in text for word in PLUS_WORDS):
        edits += [(m.start(), m.end(), "+") for m in PLUS.finditer(text)]
    return _apart(edits)


def _at_edits(text: str) -> list[Edit]:
    """Marked signs always; a bare word before a domain with a spelled dot, or behind a name with a digit or mark."""
    edits = _marked(text, MARKED_AT, "@")
    if "-at-" in text or "_at_" in text:
        edits += [(m.start(), m.end(), "@") for m in JOINED_AT.finditer(text)]
    for m in WORD_AT.finditer(text):
        local = LOCAL_PART.search(text, max(0, m.start() - 64), m.start())
        if local and (not m["plain"] or not m["word"] or TELLING.search(local[0], 0, len(local[0]) - 1)):
            edits.append((m.start(), m.end(), "@"))
    return _apart(edits)


def _dot_edits(text: str) -> list[Edit]:
    edits = _marked(text, MARKED_DOT, ".")
    if "-dot-" in text or "_dot_" in text:
        edits += [(m.start(), m.end(), ".") for m in JOINED_DOT.finditer(text)]
    if "@" in text:
        for pattern in (DOMAIN_DOTS, LOCAL_DOTS):
            for m in pattern.finditer(text):
                edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in SPELLED_DOT.finditer(m[0])]
    return _apart(edits)


def _apart(edits: list[Edit]) -> list[Edit]:
    """Rising, without those that overlap an earlier one."""
    out: list[Edit] = []
    for edit in sorted(edits):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def _lower(text: str) -> str:
    """Lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


#: Each reads what the one before has written, the later ones in lower case.
TRANSDUCERS = (_character_edits, _digit_edits, _sign_edits, _at_edits, _dot_edits)


def disguised_spans(text: str, known: list[Span]) -> list[Span]:
    """Spans found only once disguises are undone, in places of the source.

    Look-alike characters, spelled digits and disguised signs are rewritten one after the other. A match
    in the rewritten text counts if a rewritten place lies in it and it meets no known span of its kind
    other than one that it holds and goes beyond.
    """
    layers: list[Rewritten] = []
    for transducer in TRANSDUCERS:
        if edits := transducer(text):
            layers.append(rewrite(text, edits))
            text = layers[-1].text
        if transducer is _character_edits:
            text = _lower(text)
    if not layers:
        return []
    taken: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    for kind, start, end in known:
        taken[kind].append((start, end))
    out = []
    for kind, start, end in plain_spans(text):
        touched = False
        for layer in reversed(layers):
            touched = touched or layer.edited(start, end)
            start, end = layer.source(start, end)
        place = bisect_right(taken[kind], (start, end))
        first = max(0, place - 1)
        meets = [(s, e) for s, e in taken[kind][first : first + 3] if s < end and start < e]
        if touched and all(start <= s and e <= end and (s, e) != (start, end) for s, e in meets):
            out.append((kind, start, end))
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end of spans by kind, then start, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Emails, IP addresses, card and phone numbers in every whole text, plain and disguised.

    Returns doc_id, the counts of plain spans per kind, the SHA-256 of their list (base_sha256), all
    spans (kind:start:end by kind and start, code points of the source, end exclusive) and how many of
    them are disguised. Null texts count as empty, with no span; null ids are kept; repeated rows are
    returned each; an empty table gives no rows; further columns are left aside, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                whole = value.as_py() or ""
                plain = plain_spans(whole)
                more = disguised_spans(whole, plain)
                kinds = [k for k, _, _ in plain]
                cells = [*map(kinds.count, KINDS), hashlib.sha256(listed(plain).encode()).hexdigest(), listed(plain + more), len(more)]
                for column, cell in zip(columns, cells):
                    column.append(cell)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.record_batch(arrays, names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, FOUND)
