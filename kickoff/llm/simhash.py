"""SimHash near-dedup by multi-index hashing (operator 3).

Fingerprints: ``A``-``Z`` are lower-cased, words joined by one space, every 3-word shingle hashed by
XXH64; a bit is one if it is one in over half of the shingles. Equal fingerprints are one node.

Links of at most two differing bits: the 64 bits are two segments of 32. Two such fingerprints agree
in the low segment, or agree in the high segment, or differ in exactly one bit of each. So each node
fetches its own value from both segment tables, and the values of the one-bit ball around its high
segment (only from the side whose bit is zero), and verifies the whole distance. A table value that
more than ``BUCKET`` nodes share is not paired up: the rest of the distance is enumerated as a ball in
the other segment and looked up as whole fingerprints, which costs at most 528 probes a node however
large the bucket is. No link is lost either way. Components then come from alternating stars.

Defined cases: a null or empty text, or one of separators only, has fingerprint zero and is linked like any
other. A null id is never a component id unless all ids of the component are null. Rows that repeat an
id are separate rows with the same id. Extra columns are ignored by ``near_duplicates`` and passed
through by ``keep_one``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kickoff.session import materialize

from .blocks import bytes_of, chunks
from .components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 32  # nodes of one table value that are still verified pair by pair
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(),
                                                               ends[width - 1:].tolist())),
                       np.uint64, len(words) - width + 1)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    h = shingle_hashes(text, shingle)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i: i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a (signed) long called ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            marks = pa.array([fingerprint(t, shingle) for t in bytes_of(part, text_col)], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, marks], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _masks(bits: list[int], most: int) -> list[int]:
    """All non-zero masks of up to ``most`` of these bits, as signed longs."""
    one = [1 << b for b in bits]
    two = [a | b for i, a in enumerate(one) for b in one[:i]] if most > 1 else []
    return [m - (1 << 64) if m >> 63 else m for m in one + two]


def _longs(values: list[int]) -> Column:
    return F.lit(np.array(values, dtype=np.int64))


def links(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, distinct) → (u, v): every pair at one or two differing bits, at least once."""
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    own = F.array(F.struct(F.lit(0).alias("seg"), hi.alias("val")), F.struct(F.lit(1).alias("seg"), lo.alias("val")))
    table = nodes.select("fp", F.explode(own).alias("k")).select("fp", "k.seg", "k.val")
    bits = F.lit(np.arange(32, dtype=np.int32))
    flips = nodes.select("fp", F.explode(bits).alias("b")).where(
        hi.bitwiseAND(F.expr("shiftleft(1L, b)")) == 0).select(
        "fp", F.lit(0).alias("seg"), hi.bitwiseXOR(F.expr("shiftleft(1L, b)")).alias("val"), F.col("b").alias("flip"))
    probes = table.select("fp", "seg", "val", F.lit(-1).alias("flip")).unionByName(flips)
    sizes = table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    hits = materialize(probes.join(sizes, ["seg", "val"]).where("flip >= 0 or n > 1"), "simhash-hits")

    small = hits.where(F.col("n") <= BUCKET).select(F.col("fp").alias("u"), "seg", "val", "flip")
    pairs = small.join(table.withColumnRenamed("fp", "v"), ["seg", "val"]).where(
        (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS) & ((F.col("flip") >= 0) | (F.col("u") < F.col("v"))))

    large = hits.where(F.col("n") > BUCKET)
    high, low = list(range(32, 64)), list(range(32))
    around = large.select(
        "fp", F.explode(F.when(F.col("flip") >= 0, _longs(_masks(low, 1)))
                        .when(F.col("seg") == 0, _longs(_masks(low, 2))).otherwise(_longs(_masks(high, 2)))).alias("m"),
        F.when(F.col("flip") >= 0, F.expr("shiftleft(1L, 32 + flip)")).otherwise(F.lit(0)).alias("f"), "flip")
    wanted = around.select(F.col("fp").alias("u"), F.col("fp").bitwiseXOR(F.col("m")).bitwiseXOR(F.col("f")).alias("fp"),
                           "flip").where("flip >= 0 or u < fp")
    exact = wanted.join(nodes, "fp").select("u", F.col("fp").alias("v"))
    return pairs.select("u", "v").union(exact)


def _groups(prints: DataFrame) -> DataFrame:
    """(id, fp) rows → (fp, root, component_id) for each distinct fingerprint; root is the smallest fp linked."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")))
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = materialize(with_fingerprint(rows, "fp", "text", shingle).select("id", "fp"), "simhash-prints")
    return prints.join(_groups(prints), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (nulls last), once. Of rows that share that id
    and its fingerprint but differ otherwise, the one whose hash of all columns is least, so reruns agree."""
    taken = {c.lower() for c in docs.columns}
    fp, row = (next(f"{name}_{i}" for i in range(len(taken) + 1) if f"{name}_{i}" not in taken) for name in ("fp", "row"))
    marked = materialize(with_fingerprint(docs, fp, text_col, shingle).withColumn(row, F.xxhash64(*docs.columns)), "simhash-marked")
    prints = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    firsts = prints.join(_groups(prints), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    # narrow rows choose: the least fingerprint of a component's first id, then the least hash of a row
    stays = firsts.groupBy("root").agg(F.min(F.struct("fp", "row")).alias("k"), F.first("component_id").alias("keep_id")).select(
        F.col("k.fp").alias("keep_fp"), F.col("k.row").alias("keep_row"), "keep_id")
    same = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col(fp) == F.col("keep_fp")) & (F.col(row) == F.col("keep_row"))
    return marked.join(stays, same, "left_semi").dropDuplicates([id_col, fp, row]).drop(fp, row)
