"""Splitting texts into pre-tokens, vectorised over the characters of many texts.

Two public split patterns are covered: the byte-level one, in which a space goes with the
run behind it, and the word one, in which white space is dropped. Both split off the
English contractions. A character that this interpreter's Unicode tables do not know is
reported as UNKNOWN, so that a caller can hand its text to the tokenizers library, whose
tables may be newer.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)

#: The code points with Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

APOSTROPHE = 0x27


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        table[c] = UNKNOWN if kind == "Cn" else of.get(kind[0], OTHER)
    table[list(WHITE_SPACE)] = SPACE
    return table


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and code points of all characters of a UTF-8 buffer."""
    if not len(buf) or buf.max() < 0x80:
        return np.arange(len(buf)), buf.astype(np.int32)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.int32)
    code = lead.copy()
    for low, high, n, bits in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
        own = np.flatnonzero((lead >= low) & (lead < high))
        if len(own):
            value = lead[own] & bits
            for k in range(1, n + 1):
                value = value << 6 | (buf[at[own] + k] & 0x3F)
            code[own] = value
    return at, code


def _contractions(code: np.ndarray, first: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where 's 't 'm 'd 're 've 'll begin, and their lengths. opens: where a pre-token can begin with an apostrophe."""
    none = np.zeros(0, np.int64)
    tick = np.flatnonzero((code == APOSTROPHE) & opens)
    if not len(tick):
        return none, none
    ahead = np.concatenate([code, [0, 0]])
    end = np.concatenate([first, [True, True]])  # a text's first character ends the one before
    one, two = ahead[tick + 1], ahead[tick + 2]
    has_one, has_two = ~end[tick + 1], ~end[tick + 1] & ~end[tick + 2]
    size = np.where(has_one & np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for a, b in ("re", "ve", "ll"):
        size = np.where(has_two & (one == ord(a)) & (two == ord(b)), 3, size)
    return tick[size > 0], size[size > 0]


def _split(buf: np.ndarray, offsets: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters' bytes, classes, where runs begin (contractions done), and the texts' first characters."""
    at, code = characters(buf)
    kind = class_table()[code]
    first = np.zeros(len(code) + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    first = first[:-1]
    before = np.concatenate([[SPACE], kind[:-1]]).astype(np.uint8)
    before[first] = SPACE
    start = (before != kind) | first
    if singles:
        start |= kind == NUMBER
    opens = before != OTHER
    if not singles:  # a space before an apostrophe goes with it
        opens &= ~(np.concatenate([[0], code[:-1]]) == 32) | first
    tick, size = _contractions(code, first, opens)
    start[tick + 1] = False
    inner = tick[size == 3]
    start[inner + 2] = False
    after = tick + size
    after = after[after < len(code)]
    start[after] = True
    return at, kind, start, code


def _spans(at: np.ndarray, size: int, begin: np.ndarray, keep: np.ndarray | None, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = at[begin]
    tails = np.concatenate([heads[1:], [size]]) if len(heads) else heads
    if keep is not None:
        heads, tails = heads[keep], tails[keep]
    return heads, tails, np.searchsorted(heads, offsets)


def word_pretokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the word pattern's pre-tokens, and each text's first one (n + 1)."""
    at, kind, start, _ = _split(buf, offsets, singles=True)
    begin = np.flatnonzero(start)
    return _spans(at, len(buf), begin, kind[begin] != SPACE, offsets)


def byte_pretokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the byte-level pattern's pre-tokens, and each text's first one (n + 1)."""
    at, kind, start, code = _split(buf, offsets, singles=False)
    n = len(code)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    # the last white space before a run stands alone, or, if it is a space, begins the run
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]) if n else np.zeros(0, np.int64)
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    return _spans(at, len(buf), np.flatnonzero(start), None, offsets)


def unknown_texts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have characters that are UNKNOWN here."""
    out = np.zeros(len(offsets) - 1, bool)
    if not len(buf) or buf.max() < 0x80:
        return out
    at, code = characters(buf)
    odd = np.flatnonzero(class_table()[code] == UNKNOWN)
    if len(odd):
        out[np.searchsorted(offsets, at[odd], side="right") - 1] = True
    return out
