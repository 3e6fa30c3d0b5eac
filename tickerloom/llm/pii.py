"""Personal data in texts, also where it is disguised, with spans in the source text.

Each text is searched twice. The base pass finds plain identifiers (email, ip, card, phone). The second pass normalises
the text by a small transducer: look-alike letters and digits of other scripts become ASCII, zero-width characters go,
spelled digits become digits, and spelled or bracketed ``at``, ``dot``, ``plus``, ``dash`` become their signs. Every piece
of output knows the source characters it came from, so what is found in the normalised text maps back to a source
span. Only finds that hold a changed piece count, and only where no plain find of the kind lies.

A bare word `` at `` is a sign only before a host whose dot is spelled or bracketed too and whose last label has two letters or
more, and a bare `` dot `` only between two labels; a determiner ("at the dot on the map") begins no such host. So ordinary
sentences stay as they are, and no list of top-level labels is needed.

Cases: null and empty texts have no spans; texts of any length are searched whole, in time linear in their length; repeated
rows each get their result; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = "email", "ip", "card", "phone"
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[Span]:
    """An address begins where the run of allowed characters before its ``@`` begins (or the last address ends)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and passes_luhn(d):
            out.append(m.span())
    return out


def found(text: str) -> dict[str, list[Span]]:
    """The plain identifiers of a text by kind: leftmost, not overlapping; a match that fails its test is dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        out["card"] = _cards(text)
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like an ASCII letter.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "ο": "o", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ɑ": "a", "ﬁ": "fi", "‐": "-", "‑": "-", "–": "-", "−": "-", "․": ".", "。": ".",
    "ſ": "s", "İ": "I", "\u212a": "K",
}
# Spelled digits and signs.
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
}
_HIDDEN = frozenset("­​‌‍⁠﻿")
_DIGIT_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_OPEN, _SHUT = r"[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]"
# Words that begin no spelled host.
_DETERMINERS = "a an the this that these those each every any some no my your his her its our their one"
_DOT = rf"(?:\s{{0,3}}{_OPEN}(?:dot|punkt|point|punto){_SHUT}\s{{0,3}}|\s{{1,3}}dot\s{{1,3}})"
#: Each alternative is one arc of the transducer; outside of these a character stands for itself.
_ARCS = re.compile(
    rf"(?P<at>\s{{0,3}}{_OPEN}at{_SHUT}\s{{0,3}}|(?<=[a-z0-9_%+-])\s{{1,3}}at\s{{1,3}}"
    rf"(?!(?:{_DETERMINERS.replace(' ', '|')})\b)"
    rf"(?=[a-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[a-z0-9-]{{1,63}}){{0,4}}?{_DOT}[a-z]{{2,63}}\b))"
    rf"|(?P<dot>(?<=[a-z0-9]){_DOT}(?=[a-z0-9]))"
    rf"|(?P<dash>(?<=[a-z0-9])\s{{1,3}}(?:dash|hyphen)\s{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<plus>\bplus\s{{1,3}}(?=[0-9]|(?:{_DIGIT_WORD})\b))"
    rf"|(?P<digit>(?<![^\W\d_])(?:{_DIGIT_WORD})(?![^\W\d_])(?:[\s,-]{{1,3}}(?=(?:{_DIGIT_WORD})(?![^\W\d_])))?)",
    re.IGNORECASE,
)
_SIGNS = {"at": "@", "dot": ".", "dash": "-", "plus": "+"}
_DIGIT_WORDS = frozenset(_SPELLED)
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII_CUTS = {c: c if chr(c).isalpha() else " " for c in range(128)}
_BRACKETED = re.compile(rf"{_OPEN}(?:at|dot|punkt|point|punto){_SHUT}", re.IGNORECASE)


def _folds() -> dict[int, str]:
    """Look-alikes, and every compatibility character or digit that stands for one ASCII character."""
    out = {ord(a): b for a, b in _LOOKALIKES.items()}
    for block in (range(0x2460, 0x24EA), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x0660, 0x0E60)):
        for code in block:
            c = chr(code)
            plain = str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and not plain.isspace():
                out.setdefault(code, plain)
    return out


_FOLDS = _folds()
_FOLDED = frozenset(map(chr, _FOLDS)) | _HIDDEN


def _latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1")) and "\xad" not in text
    except UnicodeEncodeError:
        return False


def _letter_runs(low: str) -> list:
    """The runs of letters, as the arcs see them."""
    if low.isascii():
        return low.translate(_ASCII_CUTS).split()
    return _LETTERS.findall(low)


@lru_cache(maxsize=4096)
def _beside_digits(words: frozenset[str]) -> re.Pattern:
    """One of the digit words with nothing but signs and blanks between it and a digit or a digit word."""
    own = "|".join(sorted(words, key=len, reverse=True))
    return re.compile(rf"(?:{own})\W*+(?:[0-9]|{own})|[0-9]\W*+(?:{own})")


def may_be_disguised(text: str) -> bool:
    """False only for a text in which the transducer changes nothing that a find could hold. Cheap, as most texts are plain.

    Without folds and without ``dot``, ``plus``, ``dash``, ``hyphen`` and bracketed signs only digit words are left. They
    change an address only around an ``@``; in all other kinds they stand beside another digit.
    """
    if not text.isascii() and not _latin(text) and not _FOLDED.isdisjoint(text):
        return True
    low = text.lower()
    if "dot" in low or "plus" in low or "dash" in low or "hyphen" in low:
        return True
    if ("at" in low or "p" in low) and any(c in low for c in "([{<") and _BRACKETED.search(low):
        return True
    words = _DIGIT_WORDS.intersection(_letter_runs(low))
    return bool(words) and ("@" in low or _beside_digits(words).search(low) is not None)


@dataclass(frozen=True)
class Normalised:
    """The normalised text, and for each changed piece (start and end in it, start and end in the source)."""

    text: str
    pieces: list[tuple[int, int, int, int]]

    @cached_property
    def begins(self) -> list[int]:
        return [p[0] for p in self.pieces]

    def source(self, start: int, end: int) -> tuple[Span, bool]:
        """The source span of a normalised span, and whether it holds a changed piece."""
        first, last = bisect_right(self.begins, start) - 1, bisect_right(self.begins, end - 1) - 1
        # Pieces do not overlap: all between the first and the last lie inside.
        changed = last > first or (last >= 0 and self.pieces[last][1] > start)

        def place(i: int, at: int, inside: int) -> int:
            if i < 0:
                return at
            _, b, *ends = self.pieces[i]
            return ends[inside] if at - inside < b else ends[1] + at - b

        return (place(first, start, 0), place(last, end, 1)), changed


def normalised(text: str) -> Normalised:
    """Runs the transducer over the text: first character folds, then the arcs, keeping source offsets throughout."""
    odd = [i for i, c in enumerate(text) if c in _FOLDED] if not text.isascii() else []
    out, origin, done = [], [], 0  # pieces of text, and for each character of the folded text its source offset
    for i in odd:
        out.append(text[done:i])
        origin += range(done, i)
        fold = "" if text[i] in _HIDDEN else _FOLDS[ord(text[i])]
        out.append(fold)
        origin += [i] * len(fold)
        done = i + 1
    out.append(text[done:])
    folded = "".join(out)
    origin += range(done, len(text) + 1)
    marks, changed = set(odd), []
    parts, at, size = [], 0, 0

    def keep(upto: int) -> None:
        """Copies folded characters; each folded one is a changed piece of its own."""
        nonlocal size
        for j in range(at, upto) if marks else ():
            if origin[j] in marks or (j and origin[j] - origin[j - 1] > 1):
                changed.append((size + j - at, size + j - at + 1, origin[j], origin[j] + 1))
        parts.append(folded[at:upto])
        size += upto - at

    for m in _ARCS.finditer(folded):
        keep(m.start())
        sign = _SIGNS.get(m.lastgroup) or _SPELLED[m[0].lower().rstrip(" \t\r\n\f\v,-")]
        changed.append((size, size + 1, origin[m.start()], origin[m.end() - 1] + 1))
        parts.append(sign)
        size, at = size + 1, m.end()
    keep(len(folded))
    return Normalised("".join(parts), changed)


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Finds of the normalised text that hold a changed piece, as source spans, where no plain one of the kind lies."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not may_be_disguised(text):
        return out
    norm = normalised(text)
    if not norm.pieces:
        return out
    for kind, spans in found(norm.text).items():
        ends = [y for _, y in plain[kind]]  # ascending, as plain finds do not overlap
        for start, end in spans:
            (a, b), changed = norm.source(start, end)
            at = bisect_right(ends, a)
            if changed and (at == len(ends) or b <= plain[kind][at][0]):
                out[kind].append((a, b))
    return out


def _listed(spans: dict[str, list[Span]]) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) in order."""
    return sorted((a, KINDS.index(kind), b) for kind, own in spans.items() for a, b in own)


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in _listed(spans))


def personal_data(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per document: the numbers of plain finds, ``base`` (their spans), ``spans`` (all), ``found`` (as structs)."""
    kind = docs.schema[row_id].dataType

    def search(frames):
        for frame in frames:
            rows = []
            for raw in frame["text"]:
                plain = found(raw or "")
                more = disguised(raw or "", plain)
                every = {k: plain[k] + more[k] for k in KINDS}
                own = [{"kind": KINDS[k], "start": a, "end": b, "disguised": (a, b) in more[KINDS[k]]}
                       for a, k, b in _listed(every)]
                base = joined(plain)
                rows.append((*(len(plain[k]) for k in KINDS), base, hashlib.sha256(base.encode()).hexdigest(),
                             joined(every), own))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "spans", "found"]
            yield pd.concat([frame["id"].rename(row_id), pd.DataFrame(rows, columns=names, index=frame.index)], axis=1)

    schema = T.StructType([T.StructField(row_id, kind)] + T._parse_datatype_string(
        "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, base_sha256 string, spans string, "
        "found array<struct<kind: string, start: int, end: int, disguised: boolean>>").fields)
    return docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).mapInPandas(search, schema)
