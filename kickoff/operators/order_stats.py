"""Exact values at given ranks of many columns, without sorting or gathering a column.

Values are mapped to 64-bit integers in the same order (a double's bits, with the lower ones flipped below zero). All columns are
narrowed together: one pass counts each column's values in at most ``1 << STEP`` equal sections of the integer range, with the lowest
and highest value of each; the driver keeps the section that holds a wanted rank, and the next pass divides
that part again. A part with few values is listed (each distinct value with its count), a section of one value is the answer. So at most
six passes of fixed-size histograms end the search, whatever the values; two and a listing are usual.
A pass is one scan: tasks count in vectorised batches and send only the sections that are not empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

STEP = 12
LISTED = 10_000  # a part with at most so many values is listed
LOWEST, BITS = -(1 << 63), 64


@dataclass(frozen=True)
class Part:
    """The integers ``lo .. lo + 2**bits - 1`` of a column's range; ``below`` values are smaller."""

    column: int
    lo: int
    bits: int
    below: int
    inside: int

    @property
    def shift(self) -> int:
        return max(self.bits - STEP, 0)


def to_keys(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the values."""
    if values.dtype == np.int64:
        return values
    bits = (values + 0.0).view(np.int64)  # one zero
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def from_key(key: int, integral: bool) -> float | int:
    if integral:
        return key
    bits = np.array([key], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64)[0])


def _inside(keys: np.ndarray, lo: int, bits: int) -> np.ndarray:
    """Distances from ``lo`` of the keys inside a part."""
    away = keys.view(np.uint64) - np.uint64(lo % (1 << 64))
    return away if bits == BITS else away[(keys >= lo) & (away < np.uint64(1 << bits))]


def _columns(batches: Iterator[pa.RecordBatch], parts: list[Part]) -> Iterator[tuple[Part, np.ndarray]]:
    for batch in batches:
        known: dict[int, np.ndarray] = {}
        for part in parts:
            if part.column not in known:
                values = batch.column(f"c{part.column}").drop_null().to_numpy(zero_copy_only=False)
                known[part.column] = to_keys(values[~np.isnan(values)] if values.dtype.kind == "f" else values)
            yield part, _inside(known[part.column], part.lo, part.bits)


def _count(df: DataFrame, parts: list[Part]) -> dict[Part, dict[str, np.ndarray]]:
    """Per part the sections of it that hold values, in order: their counts, lowest and highest values."""
    top = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {part: (np.zeros(1 << STEP, np.int64), np.full(1 << STEP, top), np.full(1 << STEP, LOWEST)) for part in parts}
        for part, away in _columns(batches, parts):
            if not len(away):
                continue
            away = np.sort(away)
            section = (away >> np.uint64(part.shift)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], section[1:] != section[:-1]])[: len(section)])
            last = np.append(first[1:], len(section)) - 1
            held, (n, lo, hi) = section[first], total[part]
            keys = (away + np.uint64(part.lo % (1 << 64))).view(np.int64)
            n[held] += last - first + 1
            lo[held] = np.minimum(lo[held], keys[first])
            hi[held] = np.maximum(hi[held], keys[last])
        held = [np.flatnonzero(total[part][0]) for part in parts]
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.repeat(np.arange(len(parts)), [len(h) for h in held]), pa.int32()), "section": pa.array(np.concatenate(held), pa.int64()),
            **{c: pa.array(np.concatenate([total[p][k][h] for p, h in zip(parts, held)]), pa.int64()) for k, c in enumerate(("n", "lo", "hi"))}})

    return _collected(df.mapInArrow(run, "i int, section long, n long, lo long, hi long"), parts)


def _list(df: DataFrame, parts: list[Part]) -> dict[Part, dict[str, np.ndarray]]:
    """Per part its distinct values in order, and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (part, away) in ((parts.index(p), (p, a)) for p, a in _columns(batches, parts)):
            values, n = np.unique(away, return_counts=True)
            keys = (values + np.uint64(part.lo % (1 << 64))).view(np.int64)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(n), i), pa.int32()), "section": pa.array(keys, pa.int64()),
                                              "n": pa.array(n, pa.int64()), "lo": pa.array(keys, pa.int64()), "hi": pa.array(keys, pa.int64())})

    return _collected(df.mapInArrow(run, "i int, section long, n long, lo long, hi long"), parts)


def _collected(rows: DataFrame, parts: list[Part]) -> dict[Part, dict[str, np.ndarray]]:
    table = (rows.groupBy("i", "section").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .toArrow().sort_by([("i", "ascending"), ("section", "ascending")]))
    i = table.column("i").to_numpy()
    columns = {c: table.column(c).to_numpy() for c in ("n", "lo", "hi")}
    return {part: {c: v[i == k] for c, v in columns.items()} for k, part in enumerate(parts)}


def values_at(df: DataFrame, cols: list[str], ranks: Callable[[int], list[int]]) -> dict[str, list]:
    """For every column the values at ``ranks(n)``, n being its number of values that are neither null nor NaN."""
    if not cols:
        return {}
    integral = [isinstance(df.schema[c].dataType, IntegralType) for c in cols]
    plain = df.select(*[F.col(f"`{c}`").cast("long" if whole else "double").alias(f"c{k}") for k, (c, whole) in enumerate(zip(cols, integral))])
    start = [Part(k, LOWEST, BITS, 0, 0) for k in range(len(cols))]
    wanted: dict[tuple[int, int], Part] = {}  # (column, rank) -> part that holds it
    order: dict[int, list[int]] = {}
    counted = _count(plain, start)
    for part in start:
        order[part.column] = ranks(int(counted[part]["n"].sum()))
        wanted.update({(part.column, r): part for r in order[part.column]})
    found: dict[tuple[int, int], float | int] = {}

    def narrow(held: dict[Part, dict[str, np.ndarray]]) -> None:
        """Each wanted rank moves to the section that holds it; a section of one value is the answer."""
        for target, part in list(wanted.items()):
            if part in held:
                n, lo, hi = (held[part][c] for c in ("n", "lo", "hi"))
                upto = part.below + np.cumsum(n)
                at = int(np.searchsorted(upto, target[1], side="right"))
                low, high = int(lo[at]), int(hi[at])
                if low == high:
                    found[target] = from_key(low, integral[target[0]])
                    del wanted[target]
                else:
                    wanted[target] = Part(target[0], low, (high - low).bit_length(), int(upto[at] - n[at]), int(n[at]))

    while wanted:
        narrow(counted)
        small = sorted({p for p in wanted.values() if p.inside <= LISTED}, key=lambda p: (p.column, p.lo))
        if small:
            narrow(_list(plain, small))
        rest = sorted(set(wanted.values()), key=lambda p: (p.column, p.lo))
        counted = _count(plain, rest) if rest else {}
    return {c: [found[k, r] for r in order[k]] for k, c in enumerate(cols)}
