"""Exact top-k inner-product search by block-max pruning over ranges of documents (operator 5).

Vectors are scaled to integers, term by term. Documents are ordered by the pivot that fits them best (pivots:
a bounded sample of ``PIVOTS`` vectors, chosen by a hash; they only set the order) and cut into ranges of
``RANGE`` documents. A range is one packed row: ids, a forward index (the matrix), and the maximum and minimum of every term. Inside
a range, blocks of ``BLOCK`` documents have maxima of their own.

1. Queries are packed in bands. Every band meets the *maxima* of all ranges (two short vectors a range, never its documents);
   a query's bound for a range is the sum over terms of its weight times the range's maximum (minimum for a
   negative weight). The ``PROBES`` ranges of highest bound per query are scored: their k-th score is a threshold.
2. The same meeting again names the (query, range) pairs whose bound reaches the threshold. Only those ranges and queries travel
   and are scored: blocks by descending bound through the forward index until the next bound falls below the k-th score.
   A bound that may tie is kept; bounds get a margin for rounding.

Queries and ranges are numbered by rows of stored tables, so neither a repeated id nor a group of equal vectors that holds a third of all rows
fills one band or one range. A task holds one range and one band of queries.

Defined cases: a vector that is null, or holds a null or non-finite component (or one that is not finite once scaled), takes
no part, neither as query nor as candidate; so do rows with a null id. Finite components of any size count exactly; a score beyond a
long is given as the nearest one but the lowest. Shorter vectors count as padded with zeros. Rows that repeat an id are candidates of their own, and
queries of their own (each returns its ranks); a query does not see rows of its own id. Ties go to the smaller id. With fewer than k candidates
all are returned. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kickoff.session import materialize

SCALE = 1024  # fixed values of the contract
EVERY = 100
K = 10
PIVOTS = 256
BLOCK = 64
RANGE = 1024  # documents of a range
BAND = 512  # queries of a band
SUMMARIES = 256  # ranges whose maxima travel as one row
PROBES = 2  # ranges scored first for a threshold
LONG = (1 << 63) - 1
EPS = 2.0 ** -52


def scaled(vector: Column) -> Column:
    """Whole numbers as doubles, or null if the vector takes no part."""
    numbers = F.transform(vector, lambda x: _floor(x.cast("double") * SCALE))
    fits = F.forall(numbers, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & fits, numbers)


def _floor(x: Column) -> Column:
    """floor(x) as a double; doubles of 2**52 or more are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _matrix(values: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims), np.float64)
    lengths = np.diff(values.offsets.to_numpy())
    rows = np.repeat(np.arange(len(values)), lengths)
    columns = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, columns] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def pack(m: np.ndarray) -> bytes:
    """A matrix of whole numbers in the narrowest type that holds it."""
    top = np.abs(m).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind.encode() + m.astype(kind).tobytes()


def unpack(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).reshape(-1, dims).astype(np.float64)


def exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in floating point while no partial sum can reach 2**53, else in integers as long as needed."""
    largest = float(np.abs(query).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(len(query), 1)
    if largest < 2.0 ** 53:
        return (rows @ query).astype(np.int64)
    if largest < 2.0 ** 62 and np.abs(query).max() < 2.0 ** 62 and np.abs(rows).max() < 2.0 ** 62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    weights = [int(x) for x in query]
    return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, weights) if a and b))) for row in rows.tolist()], np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds (queries by ranges or blocks) of the inner products, rounding included."""
    reach = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T + reach * (queries.shape[1] + 4) * EPS


def block_bounds(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Upper bounds (queries by blocks) from the term maxima and minima of each block of documents."""
    starts = np.arange(0, len(vectors), BLOCK)
    return bounds(queries, np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0))


def search_range(ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, own: int, query: np.ndarray, k: int,
                 least: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best k documents of a range for one query, best first; none need be below ``least``."""
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] >= least]
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, width = 0, 2  # blocks are taken in growing groups, so that early scores prune the rest
    while at < len(order):
        taken = order[at: at + width]
        if len(found) >= k:
            taken = taken[bound[taken] >= float(scores[k - 1]) - abs(float(scores[k - 1])) * EPS]
        if not len(taken):
            break  # bounds only fall from here on
        rows = (taken[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rows = rows[rows < len(ids)]
        rows = rows[ids[rows] != own]
        found, scores = np.concatenate([found, ids[rows]]), np.concatenate([scores, exact(vectors[rows], query)])
        best = np.lexsort((found, -scores))[:k]
        found, scores = found[best], scores[best]
        at, width = at + width, width * 2
    return found, scores


def _ranges(rows: DataFrame, pivots: np.ndarray, dims: int) -> DataFrame:
    """(range, ids, m, high, low): documents ordered by pivot, packed; a group of equal vectors is cut by row number."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.argmax(_matrix(batch.column("v"), dims) @ pivots.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int64())], names=[*batch.schema.names, "pivot"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, RANGE):
                piece = batch.slice(at, RANGE)
                m = _matrix(pa.concat_arrays([piece.column("v")]), dims)
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array([(part << 32) + seq], pa.int64()), "ids": pa.array([piece.column("id").to_numpy().tobytes()], pa.binary()),
                    "m": pa.array([pack(m)], pa.binary()), "high": pa.array([m.max(axis=0).tobytes()], pa.binary()),
                    "low": pa.array([m.min(axis=0).tobytes()], pa.binary())})
                seq += 1

    placed = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(place, "id long, v array<double>, row long, pivot long")
    ordered = placed.repartitionByRange(max(1, rows.count() // (8 * RANGE)), "pivot", "row")
    return ordered.sortWithinPartitions("pivot", "row").mapInArrow(cut, "range long, ids binary, m binary, high binary, low binary")


def _bands(queries: DataFrame, bands: int, dims: int) -> DataFrame:
    """(band, numbers, m, least, probed): one packed row per band of queries."""
    def packed(key: tuple, table: pa.Table) -> pa.Table:
        m = _matrix(table.column("v").combine_chunks(), dims)
        probed = np.array([list(p) + [-1] * (PROBES - len(p)) for p in (x or [] for x in table.column("probed").to_pylist())], np.int64)
        least = np.array([-np.inf if x is None else x for x in table.column("least").to_pylist()], float)
        return pa.table({"band": pa.array([key[0].as_py()], pa.int64()), "numbers": pa.array([table.column("number").to_numpy().tobytes()], pa.binary()),
                         "queries": pa.array([pack(m)], pa.binary()), "least": pa.array([least.tobytes()], pa.binary()),
                         "probed": pa.array([probed.tobytes()], pa.binary())})

    keyed = queries.withColumn("band", F.pmod(F.xxhash64("number"), F.lit(bands)).cast("long"))
    return keyed.groupBy("band").applyInArrow(lambda key, t: packed(key, t), "band long, numbers binary, queries binary, least binary, probed binary")


def _meet(index: DataFrame, packed: DataFrame, bands: int, dims: int, best_only: bool) -> DataFrame:
    """(number, range, bound): the ranges of highest bound of each query, or all that reach its threshold and were not probed."""
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SUMMARIES):
                piece = batch.slice(at, SUMMARIES)
                yield pa.RecordBatch.from_pydict({"ranges": pa.array([piece.column("range").to_numpy().tobytes()], pa.binary()),
                                                  "high": pa.array([b"".join(piece.column("high").to_pylist())], pa.binary()),
                                                  "low": pa.array([b"".join(piece.column("low").to_pylist())], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ranges, numbers = np.frombuffer(r["ranges"], np.int64), np.frombuffer(r["numbers"], np.int64)
                high, low = (np.frombuffer(r[c]).reshape(-1, dims) for c in ("high", "low"))
                bound = bounds(unpack(r["queries"], dims), high, low)
                if best_only:
                    top = np.argsort(-bound, axis=1, kind="stable")[:, :PROBES]
                    q, c = np.repeat(np.arange(len(numbers)), top.shape[1]), top.ravel()
                else:
                    probed = np.frombuffer(r["probed"], np.int64).reshape(-1, PROBES)
                    fresh = (ranges[None, :, None] != probed[:, None, :]).all(axis=2)
                    q, c = np.nonzero((bound >= np.frombuffer(r["least"])[:, None]) & fresh)
                yield pa.RecordBatch.from_pydict({"number": pa.array(numbers[q], pa.int64()), "range": pa.array(ranges[c], pa.int64()),
                                                  "bound": pa.array(bound[q, c], pa.float64())})

    summary = index.select("range", "high", "low").mapInArrow(chunk, "ranges binary, high binary, low binary")
    spread = summary.withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))))
    return spread.join(packed, "band").mapInArrow(run, "number long, range long, bound double")


def _score(index: DataFrame, pairs: DataFrame, queries: DataFrame, bands: int, dims: int, k: int) -> DataFrame:
    """(number, query_id, vec_id, score): the best k of each range for each query of its pairs."""
    asked = (pairs.select("number", "range").join(queries.select("number", "id", "v", "least"), "number")
             .withColumn("band", F.pmod(F.xxhash64("number"), F.lit(bands)).cast("long")))
    held = asked.select(F.col("range").alias("of"), F.col("band").alias("for")).distinct()
    needed = index.select("range", "ids", "m").join(held, F.col("range") == F.col("of"))

    def run(documents: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if documents.num_rows and wanted.num_rows:
            ids = np.frombuffer(documents.column("ids")[0].as_py(), np.int64)
            vectors = unpack(documents.column("m")[0].as_py(), dims)
            m = _matrix(wanted.column("v").combine_chunks(), dims)
            reach = block_bounds(vectors, m)
            for q, bound, number, own, least in zip(m, reach, *(wanted.column(c).to_pylist() for c in ("number", "id", "least"))):
                found, scores = search_range(ids, vectors, bound, own, q, k, -np.inf if least is None else least)
                out += zip([number] * len(found), [own] * len(found), found.tolist(), scores.tolist())
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["number", "query_id", "vec_id", "score"])

    return needed.groupBy("of", "for").cogroup(asked.groupBy("range", "band")).applyInArrow(
        run, "number long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"))
                       .where("id is not null and v is not null"), "topk-vectors")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(PIVOTS).select("v").toPandas()["v"]  # at most PIVOTS vectors
    pivots = np.zeros((len(sample), dims))
    for i, v in enumerate(sample):
        pivots[i, : len(v)] = v
    index = materialize(_ranges(rows, pivots, dims), "topk-ranges")
    plain = materialize(rows.where(F.col("id") % every == 0).withColumn("number", F.monotonically_increasing_id()), "topk-queries")
    bands = max(1, -(-plain.count() // BAND))
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")

    # thresholds from the ranges of highest bound
    asked = plain.withColumn("least", F.lit(None).cast("double")).withColumn("probed", F.array().cast("array<long>"))
    first = _meet(index, _bands(asked, bands, dims), bands, dims, best_only=True)
    best = Window.partitionBy("number").orderBy(F.desc("bound"), "range")
    probes = materialize(first.withColumn("n", F.row_number().over(best)).where(F.col("n") <= PROBES), "topk-probes")
    found = materialize(_score(index, probes, asked, bands, dims, k).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k), "topk-first")
    least = found.where(F.col("n") == k).select("number", F.col("score").cast("double").alias("least"))
    # a long may be rounded up as a double: one step lower is a safe threshold
    least = least.withColumn("least", F.col("least") - F.abs("least") * EPS)
    probed = probes.groupBy("number").agg(F.collect_list("range").alias("probed"))  # PROBES values
    asked = materialize(plain.join(least, "number", "left").join(probed, "number", "left"), "topk-thresholds")

    # all other ranges that may still hold one of the best
    pairs = _meet(index, _bands(asked, bands, dims), bands, dims, best_only=False)
    rest = _score(index, pairs, asked, bands, dims, k)
    ranked = found.drop("n").unionByName(rest).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
