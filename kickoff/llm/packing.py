"""Cost-balanced packing of documents into token sequences (operator 12).

A document's ids (and one end id) are cut into pieces of at most ``capacity`` tokens. A piece is estimated to cost
``linear * length + quadratic * length**2`` (attention stays inside a piece). Pieces are dealt at random
to groups of some ``GROUP_BYTES`` of text, so that a group is a bounded task whatever a document, an id or a
group of copies weighs. In a group the pieces go in descending cost to the sequence of lowest cost that
still has room for them whole. When none has, the piece fills the sequence with the most room and its
rest goes on looking. A group opens as many full sequences as its tokens fill, and for
the tokens left over sequences of powers of two (which need no padding), so the room equals the tokens
and every sequence ends up full.

Only what a piece needs travels: full pieces are sequences of their own and send no ids (unless ``with_ids``), the others
send two bytes an id, once.

The key of a document is its partition and its position there, so repeated ids are documents of their own.
Documents should be a stored table (or any input that gives the same rows in the same order when a lost
partition is read again).

Defined cases: a null text is an empty one (its end id is one piece of one token). Special strings inside a
text are one id each. Texts of any length are cut, never shortened. Repeated rows are packed each, null ids stay
null, other columns are ignored, ties go by the key of the document, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import CHUNK_BYTES, chunks, pack, partition_column, unpack
from .spans import load_classes
from .word_ids import WordTokenizer, word_classes

CAPACITY = 4096  # a power of two
END = 2  # fixed value of the contract: the id that closes a document
LINEAR, QUADRATIC = 1.0, 1.0 / 2048  # cost of a token, and of a pair of tokens of one piece
GROUP_BYTES = 12 << 20  # text of a group: about a thousand sequences
GROUP_DOCS = 1 << 15


def powers_of_two(tokens: int) -> list[int]:
    return [1 << k for k in reversed(range(tokens.bit_length())) if tokens >> k & 1]


def place(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(piece, begin inside it, length, sequence, offset) for pieces in descending order of length."""
    full = int(np.searchsorted(-lengths, -capacity, side="right"))
    for i in range(full):
        yield i, 0, capacity, i, 0
    total = int(lengths[full:].sum())
    room = np.array([capacity] * (total // capacity) + powers_of_two(total % capacity), np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    for i in range(full, len(lengths)):
        begin, left = 0, int(lengths[i])
        while left:
            fitting = np.where(room >= left, cost, np.inf)
            to = int(fitting.argmin())
            if fitting[to] == np.inf:
                to = int(room.argmax())
            take = min(left, int(room[to]))
            yield i, begin, take, full + to, int(size[to] - room[to])
            room[to] -= take
            cost[to] += linear * take + quadratic * take * take
            begin, left = begin + take, left - take


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY,
                   end: int = END, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, on request, ``ids``.

    ``path``: the tokenizer file, at the same place on driver and executors; ``capacity``: a power of two.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    packed = word_classes(path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), partition_column())
    id_type = rows.schema["id"].dataType
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count(F.lit(1)).alias("docs")).first()
    groups = max(1, -(-(size["bytes"] or 0) // GROUP_BYTES), -(-size["docs"] // GROUP_DOCS))
    arrow_id, kind = to_arrow_type(id_type), id_type.simpleString()
    piece_schema = pa.schema([("key", pa.int64()), ("id", arrow_id), ("start", pa.int64()), ("length", pa.int64()),
                              ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    width = 2  # bytes of an id in the shuffle, more if the vocabulary needs them
    while WordTokenizer(path, np.zeros(0, np.uint8)).tokenizer.get_vocab_size() > 1 << 8 * width:
        width += 1
    result = [(id_col, arrow_id), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
              ("sequence_id", pa.int64()), ("offset", pa.int64()), *([("ids", pa.list_(pa.int32()))] * with_ids)]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seq, out, held = WordTokenizer(path, load_classes(packed)), 0, [], 0
        for part in chunks(batches, "text"):
            first = part.column("part")[0].as_py() << 40
            flat, bounds = words.ids(part.column("text").to_pylist())
            bounds = bounds.tolist()
            for number, a, b in zip(part.column("id").to_pylist(), bounds, bounds[1:]):
                ids, seq = np.append(flat[a:b], np.uint32(end)), seq + 1
                for start in range(0, len(ids), capacity):
                    piece = ids[start: start + capacity]
                    whole = len(piece) == capacity
                    sent = None if whole and not with_ids else pack(piece, width)
                    out.append((first + seq, number, start, len(piece), len(ids), crc(piece) if whole else None, sent))
                    held += 64 + len(sent or b"")
                if held > CHUNK_BYTES:
                    yield _batch(out, piece_schema)
                    out, held = [], 0
        yield _batch(out, piece_schema)

    def assign(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("start", "ascending")])
        number, begins, tokens = (table.column(c).to_pylist() for c in ("id", "start", "doc_tokens"))
        known, sent = table.column("ids_crc32").to_pylist(), table.column("ids")
        base = key[0].as_py() << 32
        ids, of, out = None, -1, []
        for i, begin, length, sequence, offset in place(table.column("length").to_numpy(), capacity, linear, quadratic):
            if i != of and sent[i].is_valid:
                ids, of = unpack(sent[i].as_py(), width), i
            check = known[i] if known[i] is not None else crc(ids[begin: begin + length])
            out.append((number[i], begins[i] + begin, length, check, tokens[i], base + sequence, offset,
                        *((ids[begin: begin + length].astype(np.int32),) if with_ids else ())))
        return pa.Table.from_batches([_batch(out, pa.schema(result))])

    pieces = rows.mapInArrow(tokenise, f"key bigint, id {kind}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary")
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("key", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(
        lambda key, table: assign(key, table),
        f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
        + ", ids array<int>" * with_ids)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
