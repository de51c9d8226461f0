"""Arrow batches cut into bounded chunks, and the two-hop exchange used by corpus-wide lookups.

Corpus-wide lookups (token counts, substring dedup, language model) follow one pattern. A map task
works on *blocks* of documents. For each block it sends one packed row to every *bucket* of the
keys (words, windows, n-grams) that the block holds, each key once. A bucket sees the keys of all
blocks, answers each block in the order asked, and the answers meet the block again. Rows of one
bucket grow with the number of blocks, not with the frequency of a key, so a key that a third of
the corpus holds weighs no more than any other. ``target`` is a bucket (>= 0) or a block (< 0).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20


def chunks(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a chunk's text stays under ``max_bytes`` (one longer text is a chunk of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size + 1
        yield batch.slice(begin)


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def input_bytes(df: DataFrame) -> int:
    """Optimizer estimate of the size of ``df`` (file sizes for a scan); no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partition_column() -> Column:
    return F.spark_partition_id().alias("part")


def bucket_count(df: DataFrame, bytes_each: int = 4 << 20) -> int:
    """Buckets in proportion to the input, so that one bucket stays in a task's memory at any size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, min(input_bytes(df) // bytes_each, 1 << 20))


class BlockIds:
    """Numbers (< 0) of the blocks of a task, the same whenever the same partition is read again. The rows
    carry their partition in the column ``part`` (a task's own number differs below a union)."""

    def __init__(self) -> None:
        self.seq = 0

    def __call__(self, chunk: pa.RecordBatch) -> int:
        self.seq += 1
        return -((chunk.column("part")[0].as_py() << 32) + self.seq)


def pack(values: np.ndarray, width: int = 4) -> bytes:
    """Integers as byte planes (lowest first): small values leave planes of zeros, which compress well."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of each run of equal keys."""
    if not len(sorted_keys):
        return
    edges = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(sorted_keys)]):
        yield int(sorted_keys[a]), a, b


def rows_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)
