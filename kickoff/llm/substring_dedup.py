"""Substring dedup by level-wise doubling (operator 2).

Windows of ``first`` words that repeat anywhere are the candidates of the next level; a window of twice
the length can only repeat if both of its halves do, so only those are extended, until the window has
``window`` words or no candidate survives. Every word covered by a window that also starts earlier
(smaller id, or same id and earlier start) is removed; windows are judged on the input.

A block sends each distinct window once, however often it occurs, so a passage that a third of the corpus
shares weighs as much in a bucket as any other. Below the last level a bucket only has to say which windows a
second block holds, so 24 bits of the hash in addition to the bucket are enough (a confusion only makes one more
candidate). The last level compares 56 bits in addition to the bucket, which an independent hash chooses (63 bits with
128 buckets, more with more data), and the block's earliest (id, start) of each window. Documents without candidates
are finished at once; only the others travel on with their block, compressed.

Defined cases: a null text has no words and hashes as the empty text. A text shorter than the window keeps all words.
Rows with the same id are separate documents of which none is earlier at the same start. Null ids come
last. Ids are integers. Other columns are ignored. An empty table gives an empty result. Documents must be a
stored table, because they are read twice; a block that differs between readings raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BlockIds, bucket_count, bytes_of, chunks, cuts, pack, partition_column, rows_batch, unpack
from .spans import SpanHasher, mix, word_hashes

WINDOW = 20
FIRST = 10
BLOCK = 4 << 20
LAST = np.iinfo(np.int64).max  # stands for a null id

_SCHEMA = pa.schema([
    ("target", pa.int64()), ("block", pa.int64()), ("bucket", pa.int64()), ("signature", pa.int64()),
    ("keys", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("bits", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("texts", pa.binary()), ("done_ids", pa.list_(pa.int64())),
    ("done_words", pa.list_(pa.int64())), ("done_sha", pa.list_(pa.string()))])
_DDL = "target bigint, block bigint, bucket bigint, signature bigint, keys binary, docs binary, " \
       "starts binary, bits binary, ids array<bigint>, lengths binary, texts binary, done_ids array<bigint>, " \
       "done_words array<bigint>, done_sha array<string>"


def _packed(texts: list[bytes | None]) -> dict:
    """A block's texts as one compressed value (a null text is an empty one)."""
    texts = [t or b"" for t in texts]
    return {"lengths": pack(np.fromiter(map(len, texts), np.int64, len(texts)), 5),
            "texts": zstandard.ZstdCompressor(level=1).compress(b"".join(texts))}


def _unpacked(row: dict) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(row["texts"])
    ends = np.cumsum(unpack(row["lengths"], 5).astype(np.int64)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def _starts(row: dict) -> np.ndarray:
    """The candidate windows that travel with a block."""
    return np.cumsum(unpack(row["starts"], 5).astype(np.int64))


class Windows:
    """The words of a list of texts and the hashes of their windows."""

    def __init__(self, texts: list[bytes | None], hasher: SpanHasher) -> None:
        self.words, self.sizes = word_hashes([t or b"" for t in texts], hasher)
        self.ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.start = np.arange(len(self.words)) - np.repeat(self.ends - self.sizes, self.sizes)
        self.left = np.repeat(self.ends, self.sizes) - np.arange(len(self.words))  # words from here to the end
        self.hasher = hasher
        self.signature = int(np.bitwise_xor.reduce(mix(self.words + np.arange(len(self.words), dtype=np.uint64)),
                                                   initial=np.uint64(len(texts))) >> np.uint64(1))

    def hashes(self, at: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
        return self.hasher(self.words, at, at + width, lane)


def _screen_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 24 | 24 further bits."""
    return (hashes % np.uint64(buckets) << np.uint64(24) | (hashes >> np.uint64(40))).astype(np.int64)


def _ask_screen(w: Windows, at: np.ndarray, width: int, buckets: int) -> Iterator[dict]:
    keys = np.unique(_screen_keys(w.hashes(at, width), buckets))
    for bucket, a, b in cuts(keys >> 24):
        yield {"target": bucket, "bucket": bucket, "keys": pack(keys[a:b] & 0xFFFFFF, 3)}


def _answer_screen(rows: list[dict]) -> list[dict]:
    keys = [unpack(r["keys"], 3).astype(np.int64) for r in rows]
    _, which, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    out, at = [], 0
    for r, k in zip(rows, keys):
        out.append({"target": r["block"], "block": r["block"], "bucket": r["bucket"], "signature": r["signature"],
                    "bits": np.packbits(held[which[at: at + len(k)]] > 1).tobytes()})
        at += len(k)
    return out


def _bits(rows: list[dict], sizes: list[int]) -> np.ndarray:
    """The answers of all buckets in the order asked (by bucket)."""
    rows = sorted((r for r in rows if r["bits"] is not None), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=n).astype(bool)
                                                for r, n in zip(rows, sizes))])


def _screened(w: Windows, at: np.ndarray, width: int, buckets: int, rows: list[dict]) -> np.ndarray:
    """Which of the windows at ``at`` repeat, in another block or in this one."""
    keys, which, here = np.unique(_screen_keys(w.hashes(at, width), buckets), return_inverse=True, return_counts=True)
    elsewhere = _bits(rows, [b - a for _, a, b in cuts(keys >> 24)])
    return (elsewhere | (here > 1))[which]


class Last:
    """The windows of the last level: distinct ones, each at its earliest place in the block, by bucket and place."""

    def __init__(self, w: Windows, ids: np.ndarray, at: np.ndarray, width: int, buckets: int) -> None:
        self.at = at
        key = w.hashes(at, width) >> np.uint64(8)
        bucket = (w.hashes(at, width, 1) % np.uint64(buckets)).astype(np.int64)
        doc, start = ids[w.doc[at]], w.start[at]
        order = np.lexsort((start, doc, key, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        first = order[new]
        group = np.zeros(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        self.later_here = (doc != doc[first][group]) | (start != start[first][group])
        # asked by bucket and place: ids and starts then rise in small steps, which compress well
        placed = np.lexsort((start[first], doc[first], bucket[first]))
        self.which = np.argsort(placed, kind="stable")[group]
        first = first[placed]
        self.key, self.bucket, self.doc, self.start = key[first], bucket[first], doc[first], start[first]

    def requests(self) -> Iterator[dict]:
        for bucket, a, b in cuts(self.bucket):
            step = np.diff(self.doc[a:b], prepend=np.int64(0))
            start = np.where(step == 0, np.diff(self.start[a:b], prepend=0), self.start[a:b])
            yield {"target": bucket, "bucket": bucket, "keys": pack(self.key[a:b], 7), "docs": pack(step.view(np.uint64), 8),
                   "starts": pack(start, 5)}

    def removed(self, rows: list[dict]) -> np.ndarray:
        """The windows (starts in the block) that also start earlier."""
        earlier = _bits(rows, [b - a for _, a, b in cuts(self.bucket)])
        return self.at[earlier[self.which] | self.later_here]


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and starts from the steps of ``Last.requests``."""
    step = unpack(row["docs"], 8).view(np.int64)
    start = unpack(row["starts"], 5).astype(np.int64)
    run = np.cumsum(start)
    head = np.maximum.accumulate(np.where(step != 0, np.arange(len(step)), 0)) if len(step) else step
    return np.cumsum(step), run - (run - start)[head]


def _answer_last(rows: list[dict]) -> list[dict]:
    places = [_places(r) for r in rows]
    key = np.concatenate([unpack(r["keys"], 7) for r in rows])
    doc, start = np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places])
    order = np.lexsort((start, doc, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the earliest of each one's group
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    out, at = [], 0
    for r in rows:
        n = len(r["keys"]) // 7
        out.append({"target": r["block"], "block": r["block"], "bucket": r["bucket"], "signature": r["signature"],
                    "bits": np.packbits(later[at: at + n]).tobytes()})
        at += n
    return out


def _digest(words: Iterator[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   first: int = FIRST) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``removed``, the removed word ranges.

    ``window`` must be ``first`` times a power of two. ``kept_text`` applies ``removed`` to a text.
    """
    levels = [first]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window:
        raise ValueError("window must be first times a power of two")
    buckets = bucket_count(docs)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
                       F.col(text_col).cast("binary").alias("text"), partition_column())

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, blocks = SpanHasher(), BlockIds()
        for part in chunks(batches, "text", BLOCK):
            w, number = Windows(bytes_of(part, "text"), hasher), blocks(part)
            at = np.flatnonzero(w.left >= first)
            if first == window:
                ids = np.array(part.column("id").to_pylist(), np.int64)
                asked = Last(w, ids, at, window, buckets).requests()
            else:
                asked = _ask_screen(w, at, first, buckets)
            yield rows_batch([r | {"block": number, "signature": w.signature} for r in asked], _SCHEMA)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = BlockIds()
        for part in chunks(batches, "text", BLOCK):
            number = blocks(part)
            yield rows_batch([{"target": number, "block": number, "ids": part.column("id").to_pylist(),
                               **_packed(bytes_of(part, "text"))}], _SCHEMA)

    def answer(last: bool):
        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            if rows[0]["target"] < 0:  # a block's documents pass
                return table
            return pa.Table.from_pylist((_answer_last if last else _answer_screen)(rows), schema=_SCHEMA)
        return run

    def survivors(w: Windows, rows: list[dict], width: int) -> np.ndarray:
        """Starts of the windows of twice ``width`` whose halves both repeat."""
        if width == first:
            at = np.flatnonzero(w.left >= first)
        else:
            at = _starts(next(r for r in rows if r["ids"] is not None))
        repeats = np.zeros(len(w.words) + width, bool)
        repeats[at[_screened(w, at, width, buckets, rows)]] = True
        both = np.flatnonzero(repeats[:-width] & repeats[width:])
        return both[w.left[both] >= 2 * width]

    def extend(width: int):
        """Block stage after level ``width``: finish what has no candidate, ask about the doubled windows."""

        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            head = next(r for r in rows if r["ids"] is not None)
            whole = _unpacked(head)
            w = Windows(whole, SpanHasher())
            if any(r["signature"] not in (None, w.signature) for r in rows):
                raise ValueError("a block's documents changed between two readings; give a stored table")
            at = survivors(w, rows, width)
            live = np.zeros(len(head["ids"]), bool)
            live[w.doc[at]] = True
            done = np.flatnonzero(~live).tolist()
            texts = list(compress(whole, live))
            rest = Windows(texts, SpanHasher())
            at = np.flatnonzero(live[w.doc])[:0] if not len(at) else np.searchsorted(np.flatnonzero(live[w.doc]), at)
            ids = np.array(head["ids"], np.int64)[live]
            if 2 * width == window:
                asked = list(Last(rest, ids, at, window, buckets).requests())
            else:
                asked = list(_ask_screen(rest, at, 2 * width, buckets))
            own = {"target": head["block"], "block": head["block"], "ids": ids.tolist(), **_packed(texts),
                   "starts": pack(np.diff(at, prepend=0), 5),  # mostly ones: candidates come in runs
                   "done_ids": (head["done_ids"] or []) + [head["ids"][i] for i in done],
                   "done_words": (head["done_words"] or []) + [int(w.sizes[i]) for i in done],
                   "done_sha": (head["done_sha"] or []) + [_digest(whole[i].split()) for i in done]}
            return pa.Table.from_pylist([own, *(r | {"block": head["block"], "signature": rest.signature} for r in asked)],
                                        schema=_SCHEMA)
        return run

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        texts = _unpacked(head)
        w = Windows(texts, SpanHasher())
        if any(r["signature"] not in (None, w.signature) for r in rows):
            raise ValueError("a block's documents changed between two readings; give a stored table")
        ids = np.array(head["ids"], np.int64)
        at = np.flatnonzero(w.left >= window) if first == window else _starts(head)
        hit = Last(w, ids, at, window, buckets).removed(rows)
        edge = np.zeros(len(w.words) + window + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge)[: len(w.words)] > 0
        done = len(head["done_ids"] or [])
        out = {"id": (head["done_ids"] or []) + head["ids"], "n_words": (head["done_words"] or []) + w.sizes.tolist(),
               "n_removed": [0] * done, "kept_sha256": list(head["done_sha"] or []), "removed": [[]] * done}
        for text, a, b in zip(texts, (w.ends - w.sizes).tolist(), w.ends.tolist()):
            mask = gone[a:b]
            out["n_removed"].append(int(mask.sum()))
            out["kept_sha256"].append(_digest(compress(text.split(), ~mask)))
            step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
            out["removed"].append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(step == 1).tolist(),
                                                                         np.flatnonzero(step == -1).tolist())])
        return pa.table([pa.array([None if i == LAST else i for i in out["id"]], pa.int64()),
                         pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                         pa.array(out["kept_sha256"], pa.string()),
                         pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                        names=[id_col, "n_words", "n_removed", "kept_sha256", "removed"])

    asked = rows.mapInArrow(ask_first, _DDL)
    now = asked.groupBy("target").applyInArrow(answer(first == window), _DDL).unionByName(rows.mapInArrow(carry, _DDL))
    for width in levels[:-1]:
        now = (now.groupBy("target").applyInArrow(extend(width), _DDL)
               .groupBy("target").applyInArrow(answer(2 * width == window), _DDL))
    return now.groupBy("target").applyInArrow(
        finish, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
                "removed array<struct<start:int,end:int>>")


def kept_text(text: str | None, removed: list[tuple[int, int]]) -> str:
    """The words of ``text`` outside the ``removed`` ranges, joined by one space."""
    words = (text or "").encode().split()
    keep = np.ones(len(words), bool)
    for start, end in removed:
        keep[start:end] = False
    return b" ".join(compress(words, keep)).decode()
