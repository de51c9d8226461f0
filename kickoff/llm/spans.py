"""Vectorised span helpers: whitespace words, GPT-2 style pre-tokens, span hashes, doubling ranks.

Everything here works on one bounded chunk of texts inside a task. A *span* is a half-open range
``[start, end)`` of an array of units (UTF-8 bytes for words, code points for pre-tokens).
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import regex

# The word separators of the contracts (\x20 and \x09-\x0D).
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
# Code points with the White_Space property (what \s means to the tokenizer).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
               0x205F, 0x3000]

_U = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two hash lanes


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64) of a copy of ``x``, in two arrays of its size."""
    x = x.astype(_U)
    part = x >> _U(30)
    x ^= part
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, _U(27), out=part)
    x *= _U(0x94D049BB133111EB)
    x ^= np.right_shift(x, _U(31), out=part)
    return x


class SpanHasher:
    """Polynomial hash of spans, two independent 64-bit lanes; powers are kept between chunks."""

    def __init__(self) -> None:
        self._pow: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
        self._inv: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

    def _powers(self, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow[lane]) < n:
            for store, base in ((self._pow, _BASE[lane]), (self._inv, pow(_BASE[lane], -1, 1 << 64))):
                p = np.full(n, base, _U)
                p[0] = 1
                store[lane] = np.multiply.accumulate(p)
        return self._pow[lane], self._inv[lane]

    def __call__(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, _U)
        power, inverse = self._powers(lane, len(units) + 1)
        value = mix(np.arange(256, dtype=_U) + _U(1 + 1000 * lane))[units] if units.dtype == np.uint8 else \
            mix(units.astype(_U) + _U(1 + 1000 * lane))
        value *= power[: len(units)]
        total = np.zeros(len(units) + 1, _U)
        np.cumsum(value, out=total[1:])
        del value
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def word_spans(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without a separator) of a byte array."""
    sep = np.zeros(256, bool)
    sep[list(SEPARATORS)] = True
    inside = np.zeros(len(units) + 2, np.int8)
    inside[1:-1] = ~sep[units]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a separator after each text, and the offset of each text (and the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8), offsets


def word_hashes(texts: list[bytes], hasher: SpanHasher, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the number of words of each, ``step`` bytes at a time."""
    hashes, sizes, begin, held = [], [], 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held > step or i == len(texts) - 1:
            units, offsets = join_texts(texts[begin: i + 1])
            starts, ends = word_spans(units)
            hashes.append(hasher(units, starts, ends))
            sizes.append(np.diff(np.searchsorted(starts, offsets)))
            begin, held = i + 1, 0
    return np.concatenate([np.zeros(0, _U), *hashes]), np.concatenate([np.zeros(0, np.int64), *sizes])


def class_table(pieces: Callable[[str], list]) -> bytes:
    """Compressed class of each code point: 0 other, 1 letter, 2 number, 3 white space.

    ``pieces`` is the tokenizer's own splitter. Two Unicode versions (of ``unicodedata`` and ``regex``) give
    the classes; it decides the code points in which they differ, so its own version holds.
    """
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])  # surrogates never occur in a text
    text = points.astype(np.uint32).tobytes().decode("utf-32-le")
    newer = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            newer[points[m.start(): m.end()]] = kind
    kinds = {"L": 1, "N": 2}
    table = np.zeros(0x110000, np.uint8)
    table[points] = [kinds.get(unicodedata.category(c)[0], 0) for c in text]
    for cp in np.flatnonzero(table != newer).tolist():
        table[cp] = 1 if len(pieces("a" + chr(cp))) == 1 else 2 if len(pieces("1" + chr(cp))) == 1 else 0
    table[WHITE_SPACE] = 3
    return zlib.compress(table.tobytes(), 9)


def load_classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def pretoken_spans(units: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-token starts and the text each belongs to, for texts laid end to end.

    ``units``: code points of all texts; ``offsets``: where each text starts, and the end. The rule is
    the public byte-level pattern: contractions, then letters, numbers or others with one optional
    space before, then white space without the last one before a visible character, then the rest.
    """
    n = len(units)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes[units]
    first = np.zeros(n + 1, bool)  # first unit of a text; n closes the last one
    first[offsets] = True
    start = first.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    # the last white space before a visible character stands alone, or opens that character's token
    white = cls == 3
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:n])
    start[last] = True
    spaced = last[units[last] == 32] + 1
    start[spaced] = False
    # contractions open at an apostrophe that is a token of its own and is followed by the letters
    quote = np.flatnonzero((units == 39) & start[:n])
    if len(quote):
        padded = np.concatenate([units, np.zeros(2, units.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~first[np.minimum(quote + 1, n)]
        two = one & ~first[np.minimum(quote + 2, n)]
        pair = two & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))  # re ve ll
        single = one & ((a == 115) | (a == 116) | (a == 109) | (a == 100))  # s t m d
        for hit, width in ((quote[single], 2), (quote[pair & ~single], 3)):
            start[hit + 1] = False
            end = hit + width
            start[end] = True
        # an apostrophe after white space belongs to that token, so it never opens a contraction
    at = np.flatnonzero(start[:n])
    return at, np.searchsorted(offsets, at, side="right") - 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each distinct key and the inverse, in key order."""
    _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return index, inverse
