"""Quality rules by suffix-array repetition (operator 8).

The words of each text are sorted as suffixes by prefix doubling (all texts of a chunk at once; the
text number is the leading key, so suffixes of different texts never mix, and only suffixes that
still tie are sorted again). Longest common prefixes of neighbours in that order give the LCP
intervals: the longest repeat that starts at a word is the larger prefix it shares with a
neighbour; the longest that occurs three times or more is the larger prefix shared by three suffixes in a row. The union
of those spans is the union of all maximal repeated substrings. A text is rejected if the spans of at least
``long_repeat`` words, or of at least ``min_repeat`` words that occur three times or more, cover more than ``max_covered`` of
its words, or if one repeat has more than ``max_longest`` words. (A header line that comes back once as a footer
is no reason; the same line all over a text is.)

Defined cases: a null or empty text has zero words and fails the base rule (fewer than 50 words).
Texts of any length are measured whole; repeated rows and equal ids are measured independently;
null ids stay null; other columns are ignored by ``measure`` and passed through by ``keep_clean``.
No row depends on another one, so there is no shuffle and a lost executor costs only its own chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bytes_of, chunks
from .spans import SEPARATORS, join_texts, word_spans

MIN_REPEAT = 5
LONG_REPEAT = 16
MAX_COVERED = 0.30
MAX_LONGEST = 200
# The base rules of the contract.
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def suffix_repeats(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word position the length of the longest repeat within its text that starts there, and of the longest that
    occurs three times or more."""
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")

    def groups(sorted_key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each group's first member, and which members share their group."""
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        head = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        return head, ~(new & np.concatenate([new[1:], [True]]))

    slots = np.arange(n)
    head, tied = groups(key[order], slots)
    rank = np.full(n + 1, -1, np.int64)  # the unit after the end differs from all
    rank[order] = head
    levels, width = [], 1
    slots = slots[tied]
    while len(slots):
        levels.append(rank)
        at = order[slots]
        after = np.minimum(at + width, n)
        after = np.where((after < n) & (text[np.minimum(after, n - 1)] == text[at]), rank[after] + 1, 0)
        key = rank[at] * (n + 1) + after
        perm = np.argsort(key, kind="stable")
        order[slots] = at[perm]
        head, tied = groups(key[perm], slots)
        rank = rank.copy()
        rank[at[perm]] = head
        slots, width = slots[tied], width * 2
    # common prefix of neighbours in suffix order, from the widest tie down
    pairs = np.flatnonzero(text[order[1:]] == text[order[:-1]])
    i, j = order[pairs].copy(), order[pairs + 1].copy()
    common = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = (levels[level][i] == levels[level][j]) * (1 << level)
        common, i, j = common + step, i + step, j + step
    shared = np.zeros(n + 1, np.int64)  # words that the suffix in a place shares with the one before it
    shared[pairs + 1] = common
    three = np.minimum(shared[:-1], shared[1:])  # with one on either side
    best, thrice = np.empty(n, np.int64), np.empty(n, np.int64)
    best[order] = np.maximum(shared[:-1], shared[1:])
    thrice[order] = np.maximum(three, np.maximum(np.append(0, three[:-1]), np.append(three[1:], 0)))
    return best, thrice


def covered(best: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Mask of the words inside the union of the repeats of ``least`` words or more (cut to ``width``)."""
    at = np.flatnonzero(best >= least)
    ends = at + (best[at] if width is None else width)
    edge = np.bincount(at, minlength=len(best) + 1) - np.bincount(ends, minlength=len(best) + 1)
    return np.cumsum(edge[:-1]) > 0


def distinct_words(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words, equal for equal words (Arrow's dictionary encoding compares the bytes; gaps get numbers too)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    offsets = np.empty(2 * len(starts), np.int32)
    offsets[0::2], offsets[1::2] = starts, ends
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(units)])
    return pieces.dictionary_encode().indices.to_numpy()[0::2].astype(np.int64)


def stats(texts: list[bytes | None], min_repeat: int, long_repeat: int) -> dict[str, np.ndarray]:
    texts = [t or b"" for t in texts]
    units, offsets = join_texts(texts)
    starts, ends = word_spans(units)
    text = np.searchsorted(offsets, starts, side="right") - 1
    n = len(texts)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text[mask], minlength=n)

    best, thrice = suffix_repeats(distinct_words(units, starts, ends), text)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, best)
    lines = [[x for x in t.split(b"\n") if x.strip(SEPARATORS)] for t in texts]
    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": total(((units & 0xC0) != 0x80) & ~np.isin(units, list(SEPARATORS))),
        "n_symbols": total(np.isin(units, list(SYMBOLS))),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": per_text(covered(best, 3, 3)),
        "covered_words": per_text(covered(best, long_repeat) | covered(thrice, min_repeat)),
        "longest_repeat": longest,
    }


def verdicts(s: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
    repeats = (s["covered_words"] > max_covered * s["n_words"]) | (s["longest_repeat"] > max_longest)
    return failed, ~failed & ~repeats


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT,
            long_repeat: int = LONG_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document: id, the counts, ``base_failed`` and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            s = stats(bytes_of(part, "text"), min_repeat, long_repeat)
            failed, kept = verdicts(s, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(s[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept)],
                names=[id_col, *COUNTS, "base_failed", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, long_repeat: int = LONG_REPEAT,
               max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text passes the rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            s = stats(bytes_of(part, text_col), min_repeat, long_repeat)
            yield part.filter(pa.array(verdicts(s, max_covered, max_longest)[1]))

    return docs.mapInArrow(run, docs.schema)
