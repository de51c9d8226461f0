"""Token ids of whole chunks of texts under a lower-casing word BPE with word ends (``word_bpe_49k.json``).

The texts of a chunk are normalised, laid end to end and cut into words by array operations over their
code points; Arrow's dictionary encoding (which compares values) numbers the distinct words, each of which
the tokenizer's own BPE model merges once. A document's ids are gathered from those of its words. The ids equal those
of ``Tokenizer.encode(text, add_special_tokens=False)``.

Fixed rules of that file: special strings are found in the raw text; then NFC, white space to one space, lower case
character by character; words are contractions, runs of letters, single numbers, runs of other visible
characters; white space belongs to no word; the last character of a word carries the word end.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .spans import class_table

KEPT_WORDS = 1 << 18  # words a task remembers before it starts afresh
STABLE = 0x300  # below this code point no text changes under NFC and lower case needs no context


def word_classes(path: str) -> bytes:
    """Class of each code point (0 other, 1 letter, 2 number, 3 white space) by the tokenizer's own splitter."""
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def joined(pair: str) -> list[str]:
        c = pair[1]
        letter = len(split("a" + c)) == 1
        if pair[0] == "a":
            return [pair] if letter else [pair[0], c]
        return [pair] if not letter and len(split("!" + c)) == 2 else [pair[0], c]

    return class_table(joined)


def word_starts(units: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Marks where a word, or a run of white space, starts in normalised texts that white space separates."""
    cls = classes[units]
    start = np.ones(len(units) + 1, bool)
    np.not_equal(cls[1:], cls[:-1], out=start[1:-1])
    start[:-1] |= cls == 2
    quote = np.flatnonzero((units == 39) & start[:-1])
    if len(quote):
        padded = np.concatenate([units, np.zeros(2, units.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        single = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # s t m d
        pair = (((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        for hit, width in ((quote[single], 2), (quote[pair], 3)):
            start[hit + 1] = False
            start[hit + width] = True
    return start


class WordTokenizer:
    """Ids of texts; distinct words are merged once and remembered."""

    def __init__(self, path: str, classes: np.ndarray) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.classes = classes
        self.table = dict(enumerate(byte_alphabet()))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def _normal(self, text: str) -> str:
        if text.isascii() or max(text) < chr(STABLE):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def _merge(self, word: str) -> tuple[int, ...]:
        if self.classes[ord(word[0])] == 3:
            return ()
        return tuple(t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.table)))

    def _stretches(self, text: str) -> list[str | int]:
        """Ordinary stretches and ids of special strings, in order."""
        parts: list[str | int] = [text]
        for special, number in self.special.items():
            if special in text:
                parts = list(chain.from_iterable([p] if isinstance(p, int) else _between(p.split(special), number) for p in parts))
        return parts

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts laid end to end, and where each text starts (and the end)."""
        pieces: list[str] = []
        owner_ends: list[int] = []
        specials: list[tuple[int, int]] = []  # (number of the stretch that a special string precedes, its id)
        for text in texts:
            for part in self._stretches(text or ""):
                if isinstance(part, int):
                    specials.append((len(pieces), part))
                else:
                    pieces.append(self._normal(part))
            owner_ends.append(len(pieces))
        flat, ends = self._plain(pieces)
        bounds = np.concatenate([[0], ends[np.array(owner_ends, np.int64)]]) if texts else np.zeros(1, np.int64)
        if specials:  # rare: rebuild with the special ids between the stretches
            at = np.array([ends[k] for k, _ in specials], np.int64)
            flat = np.insert(flat, at, [i for _, i in specials])
            before = np.searchsorted(np.array([k for k, _ in specials]), owner_ends, side="left")
            bounds[1:] += before
        return flat, bounds

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised stretches, and the number of ids before each stretch (and the end)."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        joined = "\n".join(pieces) + "\n"
        units = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start = np.flatnonzero(word_starts(units, self.classes))
        data = joined.encode()
        if len(data) == len(units):
            places = start
        else:
            widths = np.ones(len(units), np.int8)
            for least in (0x80, 0x800, 0x10000):
                widths += units >= least
            before = np.zeros(len(units) + 1, np.int64)
            np.cumsum(widths, out=before[1:])
            places = before[start]
        kind, offset = (pa.large_utf8(), np.int64) if len(data) >= 1 << 31 else (pa.utf8(), np.int32)
        words = pa.Array.from_buffers(kind, len(start) - 1, [None, pa.py_buffer(places.astype(offset)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        merged = []
        for word in coded.dictionary.to_pylist():
            entry = self.known.get(word)
            if entry is None:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                entry = self.known[word] = self._merge(word)
            merged.append(entry)
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        store = np.fromiter(chain.from_iterable(merged), np.uint32, int(lengths.sum()))
        begins = np.cumsum(lengths) - lengths
        code = coded.indices.to_numpy()
        each = lengths[code]
        total = np.zeros(len(code) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        flat = store[np.repeat(begins[code] - total[:-1], each) + np.arange(total[-1])]
        stretch = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in pieces], out=stretch[1:])
        # the separator after a stretch may share a run with its last white space: the run has no ids either way
        return flat, total[np.searchsorted(start, stretch, side="left")]


def _between(parts: list[str], number: int) -> list[str | int]:
    out: list[str | int] = []
    for part in parts:
        out += [part, number]
    return out[:-1]

