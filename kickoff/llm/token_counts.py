"""Token counts without token ids (operator 1).

Texts are split into pre-tokens. A block of documents sends each of its distinct pre-tokens once, with
the list of (document, frequency) in the block, to the bucket of the pre-token. There the pieces of each
distinct pre-token are counted once, joined to the frequencies, and summed per document of the block;
only those partial sums travel on and meet the block's documents. No id list is ever built.

A pre-token that more than ``HOT`` documents of a block hold is dealt to a bucket that also depends on
the block, so the lists of very common words spread over all buckets (they are counted once per bucket).
Rows are self-contained, so a bucket is streamed; a task holds the counts of its buckets' pre-tokens.

Defined cases: a null text is an empty one (zero bytes, zero tokens). Special strings inside a text are
one token each. Repeated rows and ids are counted independently, null ids stay null, other columns are
ignored. An empty table gives an empty result. Documents should be a stored table (or any input that
gives the same rows in the same order when a lost partition is read again).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import BlockIds, bucket_count, chunks, cuts, pack, partition_column, rows_batch, unpack
from .bpe import Pretokens, Vocabulary
from .spans import SpanHasher, class_table, load_classes

LIMIT = 1024
HOT = 1024
BLOCK = 2 << 20
_FIELDS = "block bigint, sizes array<bigint>, special array<bigint>, words binary, lengths binary, hits binary, " \
          "docs binary, counts binary"


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``. ``path``: the byte-level BPE file."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    packed = class_table(Vocabulary(path).pieces)
    buckets = bucket_count(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), partition_column())
    id_type = rows.schema["id"].dataType
    kind = id_type.simpleString()
    schema = pa.schema([("target", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("block", pa.int64()),
                        ("sizes", pa.list_(pa.int64())), ("special", pa.list_(pa.int64())),
                        *((c, pa.binary()) for c in ("words", "lengths", "hits", "docs", "counts"))])
    ddl = f"target bigint, ids array<{kind}>, {_FIELDS}"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, hasher, vocabulary, blocks = load_classes(packed), SpanHasher(), Vocabulary(path), BlockIds()
        for part in chunks(batches, "text", BLOCK):
            block = blocks(part)
            texts = [t or "" for t in part.column("text").to_pylist()]
            special, stretches, owner = [], [], []
            for i, text in enumerate(texts):
                parts = vocabulary.split(text)
                special.append(sum(isinstance(p, int) for p in parts))
                for p in parts:
                    if isinstance(p, str):
                        stretches.append(p)
                        owner.append(i)
            out = [{"target": block, "block": block, "ids": part.column("id").to_pylist(), "special": special,
                    "sizes": [len(t.encode()) for t in texts]}]
            pre = Pretokens(stretches, classes, hasher)
            doc = np.array(owner, np.int64)[pre.text] if len(pre.code) else np.zeros(0, np.int64)
            pair, freq = np.unique(pre.code * len(texts) + doc, return_counts=True)
            word, doc = pair // max(len(texts), 1), pair % max(len(texts), 1)
            hits = np.bincount(word, minlength=len(pre.words))
            bucket = (pre.keys + np.where(hits > HOT, np.uint64(-block % (1 << 63)), np.uint64(0))) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")  # words by bucket, and their lists with them
            lists = np.argsort(np.argsort(order, kind="stable")[word], kind="stable")
            doc, freq, hits = doc[lists], freq[lists], hits[order]
            ends = np.concatenate([[0], np.cumsum(hits)])
            for key, a, b in cuts(bucket[order]):
                words = [pre.words[i] for i in order[a:b].tolist()]
                span = slice(int(ends[a]), int(ends[b]))
                out.append({"target": key, "block": block, "words": b"".join(words),
                            "lengths": pack(np.fromiter(map(len, words), np.int64, len(words))),
                            "hits": pack(hits[a:b]), "docs": pack(doc[span]), "counts": pack(freq[span])})
            yield rows_batch(out, schema)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        pieces: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["words"] is None:
                    out.append(row)
                    continue
                ends = np.cumsum(unpack(row["lengths"]).astype(np.int64)).tolist()
                counts = []
                for a, b in zip([0, *ends], ends):
                    word = row["words"][a:b]
                    n = pieces.get(word)
                    if n is None:
                        n = pieces[word] = len(vocabulary.merge(word))
                    counts.append(n)
                doc = unpack(row["docs"]).astype(np.int64)
                tokens = np.repeat(np.array(counts, np.int64), unpack(row["hits"]).astype(np.int64)) * unpack(
                    row["counts"]).astype(np.int64)
                total = np.bincount(doc, weights=tokens).astype(np.int64)  # exact: far below 2**53
                at = np.flatnonzero(total)
                out.append({"target": row["block"], "block": row["block"], "docs": pack(at), "counts": pack(total[at], 8)})
            yield rows_batch(out, schema)

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        total = np.array(head["special"], np.int64)
        for r in rows:
            if r["docs"] is not None:
                total[unpack(r["docs"]).astype(np.int64)] += unpack(r["counts"], 8).astype(np.int64)
        return pa.table([pa.array(head["ids"], schema.field("ids").type.value_type), pa.array(head["sizes"], pa.int64()),
                         pa.array(total), pa.array(total > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    asked = rows.mapInArrow(ask, ddl).repartition("target")
    return asked.mapInArrow(answer, ddl).groupBy("target").applyInArrow(
        add_up, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
