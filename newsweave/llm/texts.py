"""What the near-duplicate operators share: bodies, their words as numbers, runs of three words, exact similarity.

A body is an article's own text: full_text without page furniture and markup or, where nothing is left, the summary
without markup. Its words (lower-cased runs of letters and digits) are written as 32-bit hashes in their order, with a
0 at the end of each unit (a sentence, or a part of a long one), and a run of three words is a 64-bit number made of
three of them, whatever the units. Two different words have one hash once in four thousand million, so equal numbers
stand for equal words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

from newsweave.llm.markup import MAYBE, to_clean

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?…](?=[\s\"'”’»)]|$)|\n")
_MAYBE = re.compile(MAYBE.replace("(?m)", ""), re.M)
#: Much cheaper than MAYBE, true for every text that it is true for.
_SIGN = re.compile(r"[<*`\\$\[{=#~|>_]|&[\w#]|''|(?:^|\n)[ \t]*(?:[-+]|\d{1,3}\.) ")
#: Words that one task remembers the hashes of.
REMEMBERED = 400_000
#: A unit of fewer words than LEAST joins the next; one of more than LONGEST is cut, where its words say so.
LEAST, LONGEST = 5, 26
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def body_of(full_text: str | None, summary: str | None, page: Callable[[str], str] | None = None) -> str:
    """The body of an article, '' if it has none; page: takes the furniture out of full_text."""
    for text, reader in ((full_text, page), (summary, None)):
        if text and text.strip():
            if reader:
                text = reader(text)
            if text and _SIGN.search(text) and _MAYBE.search(text):
                text = to_clean(text)
            if text and any(c.isalnum() for c in text):
                return text
    return ""


def encode(body: str, known: dict[str, int]) -> list[int]:
    """Words as signed 32-bit hashes, none of them 0, in their order, and a 0 after each unit. known: filled as it goes,
    emptied when it is full."""
    out: list[int] = []
    start = 0
    for part in _END.split(body.lower()):
        words = _WORD.findall(part)
        if not words:
            continue
        try:
            out += [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words) - known.keys():
                h = xxhash.xxh32_intdigest(w) or 1
                known[w] = h - (1 << 32) if h >> 31 else h
            out += [known[w] for w in words]
        if len(out) - start >= LEAST:
            if len(out) - start > LONGEST:
                out[start:] = _cut(out[start:])
            out.append(0)
            start = len(out)
    if start < len(out):
        if start and len(out) - start < LEAST:
            del out[start - 1]  # too short for a unit of its own
        out.append(0)
    return out


def _cut(unit: list[int]) -> list[int]:
    """A unit too long for a sentence with a 0 where its words say so: an insertion moves only the cuts beside it."""
    out, start = [], 0
    for i, c in enumerate(unit, 1):
        out.append(c)
        if (i - start >= 8 and (c & 0xFFFFFFFF) * 2654435761 % (1 << 32) < (1 << 32) // 8 or i - start >= LONGEST) and len(unit) - i >= LEAST:
            out.append(0)
            start = i
    return out


def words_of(codes: list[int] | np.ndarray) -> np.ndarray:
    """The words without the ends of units."""
    c = np.asarray(codes, "i4")
    return c[c != 0]


def _hashes(words: np.ndarray) -> np.ndarray:
    """The runs of three words as 64-bit numbers, in their order."""
    c = words.view("u4").astype("u8")
    if len(c) < 3:
        return np.empty(0, "u8")
    with np.errstate(over="ignore"):
        h = (((c[:-2] + np.uint64(1)) * _A) ^ c[1:-1]) * _B
        h = ((h ^ (h >> _C)) + c[2:]) * _A
    return h ^ (h >> _C)


def runs(codes: list[int] | np.ndarray) -> np.ndarray:
    """The distinct runs of three words as sorted 64-bit numbers."""
    h = np.sort(_hashes(words_of(codes)))
    if not len(h):
        return h
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def flat_codes(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of many texts one after the other, and the number of the text of each."""
    return np.concatenate([np.asarray(c, "i4") for c in codes]), np.repeat(np.arange(len(codes)), [len(c) for c in codes])


def run_counts(codes: list[np.ndarray]) -> np.ndarray:
    """How many distinct runs of three words each of many texts has."""
    flat, text = flat_codes(codes)
    flat, text = flat[flat != 0], text[flat != 0]
    h = _hashes(flat)
    whole = text[: len(h)] == text[2:]  # runs that lie in one text
    h, text = h[whole], text[: len(h)][whole]
    at = np.lexsort((h, text))
    h, text = h[at], text[at]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: len(h)]
    return np.bincount(text[new], minlength=len(codes))


def body_key(codes: list[int]) -> int:
    """64 bits that stand for the words of a body."""
    h = xxhash.xxh64_intdigest(words_of(codes).tobytes())
    return h - (1 << 64) if h >> 63 else h


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted lists of distinct numbers have in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def similarity(a: list[int] | np.ndarray, b: list[int] | np.ndarray) -> float:
    """Shared distinct runs of three words over the runs in either; 0 if there are none."""
    x, y = runs(a), runs(b)
    both = shared(x, y)
    return both / (len(x) + len(y) - both) if both else 0.0
