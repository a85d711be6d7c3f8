r"""Personal data with offset-preserving deobfuscation (operator 10).

Base spans come from four patterns over the text as it is.  A chain of
transducers then rewrites what disguises identifiers, keeping for every output
character the source span it stands for:

1. homoglyphs (full-width forms, Cyrillic and Greek look-alikes) become ASCII
   and zero-width characters vanish;
2. spelled digits ("four two", also in German, French and Spanish) become digits;
3. "at" and "dot" between words, in brackets or as words of their own in an
   address, become @ and a full stop.

The same patterns run over the result and each match is mapped back to source
characters.  Base spans stay as they are; a match is added unless it overlaps a
base span of its kind without holding more than the whole of it.

Texts without a digit, @ or disguise go no further than one scan.  Null counts
as empty: no spans.  Rows are independent, so repeated rows give equal results.
Offsets are code points of the source, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chorus.llm import tokens
from chorus.llm.common import slice_rows, texts

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds.  An address is found from its @
# (what stands before it cannot hold another), and a quad begins where its first
# number does, so long runs of letters or digits cost one scan.
_USER, _HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

# Look-alikes of Latin letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "﹒": ".", "·": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_ZERO_WIDTH = "​‌‍⁠﻿­"

# Names of the digits.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _single(c: str) -> str | None:
    """The ASCII character that c imitates; None if it imitates none."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    point = ord(c)
    if 0xFF01 <= point <= 0xFF5E:  # full-width forms
        return chr(point - 0xFEE0)
    for first in (0x0660, 0x06F0, 0x0966):  # digits of other scripts
        if first <= point < first + 10:
            return chr(48 + point - first)
    for first, n, base in ((0x1D400, 52 * 13, 65), (0x1D7CE, 50, 48)):  # mathematical letters and digits
        if first <= point < first + n:
            k = (point - first) % (52 if base == 65 else 10)
            return chr(48 + k) if base == 48 else chr(65 + k) if k < 26 else chr(71 + k)
    return None


_DISGUISED = "".join([*_LOOKALIKES, *_ZERO_WIDTH]) + "！-～٠-٩۰-۹०-९\U0001d400-\U0001d6a3\U0001d7ce-\U0001d7ff"
_ONE = re.compile(f"[{_DISGUISED}]")
_NAME = "|".join(sorted(_DIGITS, key=len, reverse=True))
_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:plus|{_NAME}|\+|\d+)(?!\w)[ \t,.()-]*){{0,24}}(?:{_NAME})(?!\w)(?:[ \t,.()-]*(?:{_NAME}|dot|point|punkt|punto|\d+)(?!\w))*")
_PART = re.compile(rf"(?i)(?P<plus>plus\b)|(?P<digit>(?:{_NAME})(?!\w))|(?P<dot>(?:dot|point|punkt|punto)(?!\w))|(?P<number>\d+)|(?P<gap>[ \t,]+)|(?P<other>.)")
_OPEN, _CLOSE = r"[ \t]*[\[({<|]+[ \t]*", r"[ \t]*[\])}>|]+[ \t]*"
_AT = rf"(?:{_OPEN}(?:at|@|ät|arroba|arobase){_CLOSE}|[ \t]+(?:at|arroba|arobase)[ \t]+|[ \t]*@[ \t]*|[ _-]+AT[ _-]+)"
_DOT = rf"(?:{_OPEN}(?:dot|\.|punkt|point|punto){_CLOSE}|[ \t]+(?:dot|punkt|point|punto)[ \t]+|\.|[ _-]+DOT[ _-]+)"
_ADDRESS = re.compile(rf"(?i)(?<![A-Za-z0-9_%+-])(?P<user>[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,8}}){_AT}(?P<host>[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}})")
_PLAIN_AT = re.compile(r"(?i)[ \t]+(?:at|arroba|arobase)[ \t]+")
# Last labels that make words around a plain "at" an address.
_TOP_LABELS = frozenset("com org net edu gov mil int info biz io co ai app dev me eu uk de fr es it nl be at ch us ca au in jp cn ru br mx se no dk fi pl pt ie nz".split())
_DOT_IN = re.compile(f"(?i){_DOT}")
_NUMBERS = re.compile(rf"(?i)(?<!\d)\d+(?:{_DOT}\d+){{3}}")

_AT_WORDS = ("at", "arroba", "arobase", "ät")
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_bytes = np.arange(256)
_IS_DIGIT = (_bytes >= 48) & (_bytes <= 57)
#: First bytes of the characters that may be disguises: above ASCII, but not U+00C0 to U+00FF or U+0140 to U+017F.
_IS_RARE = (_bytes >= 0xC0) & (_bytes != 0xC3) & (_bytes != 0xC5)


def _word_hashes(words: Iterable[str]) -> np.ndarray:
    return np.sort(tokens.words(*tokens.string_bytes(pa.array(sorted(words))), tokens.NOT_ALNUM)[0])


def _flags(column) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text may hold a base span, and whether it may hold a disguised one, which
    takes in all that the patterns match: a rare character; a spelled digit beside another,
    a number, a plus or a word for a full stop; a mark for @ with one for a full stop; a mark for a
    full stop and a digit; or a stop between letters with a word for @, or an @ that is not
    between letters.  Names with letters above ASCII count in any case."""
    data, offsets = tokens.string_bytes(column)
    n = len(offsets) - 1

    def texts_with(at: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        out[np.searchsorted(offsets, at, "right") - 1] = True
        return out

    digit = texts_with(np.flatnonzero(_IS_DIGIT[data]))
    at_sign = texts_with(np.flatnonzero(data == 64))
    h, start, _, first = tokens.words(data, offsets, tokens.NOT_ALNUM)
    of = tokens.lengths_to_index(np.diff(first))

    def holding(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=n) > 0

    name = np.isin(h, _word_hashes({*_DIGITS, *map(str.upper, _DIGITS)}))
    dot = np.isin(h, _word_hashes(_DOT_WORDS))
    number = name | dot | np.isin(h, _word_hashes(["plus"])) | _IS_DIGIT[data[start]]
    beside = np.zeros(len(h), bool)
    beside[1:] = (name[1:] & number[:-1] | number[1:] & name[:-1]) & (of[1:] == of[:-1])
    stop = np.flatnonzero(data[1:-1] == 46) + 1
    before, after = data[stop - 1], data[stop + 1]
    label = ~tokens.NOT_ALNUM[tokens.LOWER]
    label[list(b"_%+-")] = True
    joins = texts_with(stop[label[before] & label[after]])
    near = data != 32
    near &= data != 9
    solid = np.flatnonzero(near)  # what stands next to a stop across blanks
    at = np.searchsorted(solid, stop)
    box = list(b"[({<|")
    boxed = texts_with(stop[np.isin(data[solid[np.maximum(at - 1, 0)]], box)]) if len(stop) else np.zeros(n, bool)
    dotted = boxed | holding(dot)
    at_word = holding(np.isin(h, _word_hashes({*_AT_WORDS, *map(str.upper, _AT_WORDS)})))
    marked = at_sign | at_word
    sign = np.flatnonzero(data == 64)
    loose = list(b" \t[({<|])}>")
    spaced = texts_with(sign[np.isin(data[np.maximum(sign - 1, 0)], loose) | np.isin(data[np.minimum(sign + 1, max(0, len(data) - 1))], loose)]) | at_word
    # the signs × and ÷ part words, and ſ matches s in any case
    rare = np.r_[np.flatnonzero(_IS_RARE[data]), np.flatnonzero((data[:-1] == 0xC3) & np.isin(data[1:], [0x97, 0xB7]) | (data[:-1] == 0xC5) & (data[1:] == 0xBF))]
    return digit | at_sign, texts_with(rare) | holding(beside) | marked & dotted | spaced & joins | dotted & digit


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _USER:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            done = host.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the undisguised identifiers, by kind, then start."""
    out = list(_emails(text))
    for kind, pattern in _PATTERNS.items():
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _passes(kind, m[0])]
    return out


class _Tape:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewritten(self, edits: Iterable[tuple[int, int, str]]) -> _Tape:
        """With text[a:b] replaced for each (a, b, new), in order, not overlapping."""
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            starts += self.starts[at:a] + ([self.starts[a]] * len(new) if b > a else [])
            ends += self.ends[at:a] + ([self.ends[b - 1]] * len(new) if b > a else [])
            at = b
        return _Tape("".join([*parts, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])


def _plain_letters(tape: _Tape) -> Iterator[tuple[int, int, str]]:
    for m in _ONE.finditer(tape.text):
        yield m.start(), m.end(), "" if m[0] in _ZERO_WIDTH else _single(m[0]) or m[0]


def _plain_digits(tape: _Tape) -> Iterator[tuple[int, int, str]]:
    for m in _RUN.finditer(tape.text):
        parts = list(_PART.finditer(m[0]))
        if sum(p.lastgroup in ("digit", "number") for p in parts) < 2:
            continue
        for p in parts:
            new = {"plus": "+", "digit": _DIGITS.get(p[0].lower(), ""), "dot": ".", "gap": ""}.get(p.lastgroup)
            if new is not None and (p.lastgroup != "gap" or 0 < p.start() and p.end() < len(m[0])):
                yield m.start() + p.start(), m.start() + p.end(), new


def _plain_marks(tape: _Tape) -> Iterator[tuple[int, int, str]]:
    for m in _ADDRESS.finditer(tape.text):
        host = m["host"]  # a plain "at" is a word first: then the last label has to be a known one
        if _PLAIN_AT.fullmatch(tape.text, m.end("user"), m.start("host")) and _DOT_IN.split(host)[-1].lower() not in _TOP_LABELS:
            continue
        dots = [(d.start(), d.end(), ".") for part in ("user", "host") for d in _DOT_IN.finditer(tape.text, m.start(part), m.end(part))]
        yield from sorted([*dots, (m.end("user"), m.start("host"), "@")])


def _plain_numbers(tape: _Tape) -> Iterator[tuple[int, int, str]]:
    for m in _NUMBERS.finditer(tape.text):
        yield from ((d.start(), d.end(), ".") for d in _DOT_IN.finditer(tape.text, m.start(), m.end()))


def _hidden_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the normalised text shows."""
    tape, found = _Tape(text), []
    for step in (_plain_letters, _plain_digits, _plain_numbers, _plain_marks):
        if edits := [e for e in step(tape) if tape.text[e[0] : e[1]] != e[2]]:
            tape = tape.rewritten(edits)
            found += [(kind, tape.starts[a], tape.ends[b - 1]) for kind, a, b in base_spans(tape.text)]
    out: list[tuple[str, int, int]] = []
    for span in sorted(set(found), key=lambda s: (s[0], s[1], -s[2])):
        meets = [(s, e) for k, s, e in base if k == span[0] and s < span[2] and span[1] < e]
        wider = all(span[1] <= s and e <= span[2] and (s, e) != span[1:] for s, e in meets)
        if wider and not any(k == span[0] and s < span[2] and span[1] < e for k, s, e in out):
            out.append(span)
    return out


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted([*base, *_hidden_spans(text, base)], key=lambda s: (order[s[0]], *s[1:]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slice_rows(whole)):
        column = b.column("text")
        plain, hidden = _flags(column)
        counts: list[list[int]] = [[] for _ in KINDS]
        base_texts, all_texts = [], []
        for i, (has_plain, has_hidden) in enumerate(zip(plain, hidden, strict=True)):
            base: list = []
            spans: list = []
            if has_hidden:
                base, spans = find_spans(column[i].as_py())
            elif has_plain:
                base = spans = base_spans(column[i].as_py())
            for kind, out in zip(KINDS, counts, strict=True):
                out.append(sum(s[0] == kind for s in base))
            base_texts.append(joined(base))
            all_texts.append(joined(spans))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in base_texts], pa.string()), pa.array(all_texts, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Every row of docs as (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    The counts and the digest are of the base spans; ``spans`` holds all."""
    return texts(docs).mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
