"""Tokens per section of a document, from one encoding of the whole document.

Encoding each section alone gives other tokens than the document has, and encodes twice. Here a document is encoded once;
every token gets its span of characters from its bytes, spans are joined to the sections they touch (both ascending, by
binary search), and a token that touches several sections goes to one of them by a stated rule:

- ``majority``: the section that holds most of its characters, the earlier one on a tie;
- ``first`` / ``last``: the first or last section it touches.

So the sections' counts and the count outside of all sections add up to the document's.

Cases: a null or empty text has no tokens and one empty section; a section without tokens has a row with 0; characters
that several tokens share belong to each of them; repeated rows each get their rows; other columns are dropped; an empty table
gives an empty table. Texts are encoded whole, of any length: runs of white space too long for the encoder's pattern are
handed to it apart, cut where the pattern cuts them, so tokens are the same.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The pattern that cuts a text into the pieces of a byte-level BPE (fixed value of the public vocabularies).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = "majority", "first", "last"
# The white space of the pattern's engine (Unicode's White_Space).
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of white space from this length on are encoded apart. The pattern's engine takes several times as many.
LONG_BLANK = 100_000


@functools.lru_cache(maxsize=4)
def _long_blank(size: int) -> re.Pattern:
    return re.compile(rf"[{_BLANK}]{{{size},}}")


@functools.lru_cache(maxsize=4)
def _encoder(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray, tiktoken.Encoding]:
    """The encoder of a vocabulary file's content, the bytes of each token, and an encoder of text that is one piece."""
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    sizes = np.zeros(max(table.values()) + 1, dtype=np.int64)
    for piece, rank in table.items():
        sizes[rank] = len(piece)
    coder = functools.partial(tiktoken.Encoding, mergeable_ranks=table, special_tokens={})
    return coder("corpus", pat_str=PATTERN), sizes, coder("piece", pat_str=r"[\s\S]+")


def encoded(text: str, ranks: bytes, long_blank: int = LONG_BLANK) -> np.ndarray:
    """The tokens of a text."""
    encoder, _, piece = _encoder(ranks)
    if len(text) < long_blank:
        return np.asarray(encoder.encode_ordinary(text), dtype=np.int64)
    out, at = [], 0
    for run in _long_blank(long_blank).finditer(text):
        # The pattern takes such a run as one piece, but for the last character if something follows.
        end = run.end() - (run.end() < len(text))
        out += [encoder.encode_ordinary(text[at : run.start()]), piece.encode_ordinary(text[run.start() : end])]
        at = end
    out.append(encoder.encode_ordinary(text[at:]))
    return np.array([token for part in out for token in part] if len(out) > 1 else out[0], dtype=np.int64)


def token_spans(text: str, ranks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; a token of some bytes of a character covers that character."""
    sizes = _encoder(ranks)[1]
    ends = np.cumsum(sizes[encoded(text, ranks)])
    starts = np.r_[0, ends[:-1]][: len(ends)]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    number = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    return number[starts] - 1, number[ends - 1]


def lines_of(text: str) -> list[tuple[int, int]]:
    """A section for each line, with the line break that ends it."""
    out, at = [], 0
    while (end := text.find("\n", at)) >= 0:
        out.append((at, end + 1))
        at = end + 1
    return [*out, (at, len(text))] if at < len(text) or not out else out


def shared_out(
    starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str
) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and boundary-crossing tokens of each section, and tokens outside. Sections ascend and do not overlap."""
    begin, stop = (np.array(x, dtype=np.int64) for x in zip(*sections, strict=True))
    # The join: a token touches the sections from the first that ends after its start to the last that begins before its end.
    first, last = np.searchsorted(stop, starts, "right"), np.searchsorted(begin, ends, "left") - 1
    touches = first <= last
    owner, crossing = first.copy(), np.flatnonzero(touches & (first < last))
    if rule == "last":
        owner = np.where(touches, last, owner)
    elif rule == "majority":
        for t in crossing:
            part = range(first[t], last[t] + 1)
            owner[t] = max(part, key=lambda s: (min(ends[t], stop[s]) - max(starts[t], begin[s]), -s))
    n = len(sections)
    counts = np.bincount(owner[touches], minlength=n)
    return counts, np.bincount(owner[crossing], minlength=n), int((~touches).sum())


def read_vocabulary(path: str) -> bytes:
    """The content of a vocabulary file on the driver; tasks get it by broadcast (a fixed size, under 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


def section_tokens(
    docs: DataFrame, vocabulary: bytes, text: str = "text", row_id: str = "doc_id", rule: str = "majority",
    sections: str | None = None, cut: Callable[[str], list[tuple[int, int]]] = lines_of,
) -> DataFrame:
    """Per document and section: section (from 0), char_start, char_end, n_tokens, n_crossing, doc_tokens.

    ``sections`` may name a column of array<struct<start, end>> (ascending, not overlapping); else ``cut`` makes them.
    Tokens outside of all sections are counted in a row with section -1, if there are any.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    named = [F.col(row_id).alias("id"), F.col(text).alias("text")] + ([F.col(sections).alias("parts")] if sections else [])
    kind = docs.schema[row_id].dataType

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = {c: [] for c in ("row", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens")}
            for row, raw in enumerate(frame["text"]):
                text = raw or ""
                parts = [(p["start"], p["end"]) for p in (frame["parts"].iloc[row] or [])] if sections else cut(text)
                starts, ends = token_spans(text, shared.value) if text else (np.zeros(0, np.int64),) * 2
                counts, crossing, outside = (
                    shared_out(starts, ends, parts, rule) if len(parts) else (starts[:0], starts[:0], len(starts)))
                rows = [(i, *p, counts[i], crossing[i]) for i, p in enumerate(parts)]
                rows += [(-1, None, None, outside, 0)] if outside else []
                for name, values in zip(list(own)[1:6], zip(*rows, strict=True), strict=False):
                    own[name] += values
                own["row"] += [row] * len(rows)
                own["doc_tokens"] += [len(starts)] * len(rows)
            ids = frame["id"].iloc[own.pop("row")].reset_index(drop=True)
            yield pd.DataFrame({row_id: ids, **own})

    schema = T.StructType([T.StructField(row_id, kind)] + T._parse_datatype_string(
        "section int, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint").fields)
    return docs.select(*named).mapInPandas(count, schema)


def default_vocabulary(spark: SparkSession) -> str:
    """The path, on the driver, in the setting ``spark.tickerloom.vocabulary``, else where this machine keeps a byte-level BPE."""
    return spark.conf.get("spark.tickerloom.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")
