"""Language model scoring with a weighted backoff automaton (operator 6).

The model holds every word and word pair of the training texts. Pairs are smoothed by interpolated
absolute discounting over add-``ALPHA`` single words:

    P(w | h) = max(c(h,w) - D, 0) / c(h) + L(h) P1(w),   L(h) = D T(h) / c(h),   P1(w) = (c(w) + a) / (N + a (V + 1))

with D = n1 / (n1 + 2 n2) from the numbers of pairs seen once and twice and T(h) the distinct words
after h. As an automaton: a state per history, an arc per seen pair weighing log P(w | h) into the state
of w, and a failure arc weighing log L(h) into the root, which has an arc for every word (and one for
unknown words). A history that training never saw fails into the root for free.

The whole automaton is never in one place. A block of documents asks the buckets of its histories for
c(h), T(h) and for the counts of its pairs, each once, and gets the part of the automaton that its
documents walk. A bucket sums the training counts of all blocks before it answers. Histories with more
than a ``HOT_SHARE`` of the words are found first; their pairs are dealt over all buckets and their T(h) is
summed from all of them, so no bucket holds a frequent word's continuations alone.

Words are told apart by 64-bit hashes and a history's continuations by 48 bits in addition; with V words
the chance that any two are confused is about V squared / 2**65.

Defined cases: a null text is an empty one (only the end token). A null id counts as empty text in the
training rule (held out). Repeated rows and ids are separate documents. Without training texts every
probability is one. Other columns are ignored. An empty table gives an empty result. Documents must be
a stored table, because they are read three times; a block that differs between two readings is detected
by its signature and raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickoff.session import materialize

from .blocks import BlockIds, bucket_count, bytes_of, chunks, cuts, pack, partition_column, rows_batch, unpack
from .spans import SpanHasher, mix, word_hashes

ALPHA = 0.1  # fixed value of the contract's base score
HELD_OUT_MOD = 10
HOT_SHARE = 2000  # a history with more than 1/HOT_SHARE of all words is dealt over all buckets
BLOCK = 2 << 20
START, END = np.uint64(1), np.uint64(2)  # the histories before the first and the symbol after the last word
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_48 = np.uint64((1 << 48) - 1)


def token_hashes(texts: list[bytes], hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the number of words of each text."""
    return word_hashes([t.translate(_LOWER) for t in texts], hasher)


class Walk:
    """The documents of a block as symbols, with the histories and pairs they use, in the order asked."""

    def __init__(self, texts: list[bytes], train: np.ndarray, hasher: SpanHasher, hot: np.ndarray, buckets: int) -> None:
        words, self.sizes = token_hashes(texts, hasher)
        self.lengths = self.sizes + 1  # the end is a token
        ends = np.cumsum(self.lengths)
        self.symbol = np.full(int(self.lengths.sum()), END, np.uint64)
        inner = np.ones(len(self.symbol), bool)
        inner[ends - 1] = False
        self.symbol[inner] = words
        before = np.roll(self.symbol, 1)
        if len(before):
            before[np.concatenate([[0], ends[:-1]])] = START
        self.signature = int(np.bitwise_xor.reduce(mix(self.symbol + np.arange(len(self.symbol), dtype=np.uint64)),
                                                   initial=np.uint64(0)) >> np.uint64(1))
        trained = np.repeat(train, self.lengths)
        # histories: each distinct word (whether or not it precedes anything else) and the start
        self.history, at = np.unique(np.concatenate([before, self.symbol]), return_inverse=True)
        self.before, self.at = at[: len(before)], at[len(before):]
        hot_at = np.searchsorted(hot, self.history)
        is_hot = hot[np.minimum(hot_at, len(hot) - 1)] == self.history
        self.hot_number = np.where(is_hot, hot_at, -1)
        # pairs: history number and continuation
        key = mix(self.history[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.symbol)
        _, first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        self.pair_key = key[first]
        self.pair_history = self.before[first]
        self.pair_count = np.bincount(self.pair[trained], minlength=len(first))
        home = (self.history % np.uint64(buckets)).astype(np.int64)
        spread = (self.pair_key >> np.uint64(13)) % np.uint64(buckets)
        self.pair_bucket = np.where(is_hot[self.pair_history], spread, home[self.pair_history]).astype(np.int64)
        # asked in the order (bucket, hot or not, history, pair)
        self.asked = np.lexsort((self.pair_key, self.pair_history, is_hot[self.pair_history], self.pair_bucket))
        cold = np.flatnonzero(~is_hot)
        self.asked_history = cold[np.argsort(home[cold], kind="stable")]
        self.home = home

    def requests(self) -> Iterator[dict]:
        """Per bucket: histories, the run length of their pairs, pair keys (48 bits) and training counts."""
        pairs = {k: (a, b) for k, a, b in cuts(self.pair_bucket[self.asked])}
        histories = {k: (a, b) for k, a, b in cuts(self.home[self.asked_history])}
        for key in sorted(set(pairs) | set(histories)):
            a, b = pairs.get(key, (0, 0))
            asked = self.asked[a:b]
            hot = self.hot_number[self.pair_history[asked]]
            cold = asked[hot < 0]
            a, b = histories.get(key, (0, 0))
            own = self.asked_history[a:b]
            place = np.zeros(len(self.history), np.int64)
            place[own] = np.arange(len(own))
            runs = np.bincount(place[self.pair_history[cold]], minlength=len(own))
            yield {"target": key, "histories": self.history[own].tobytes(), "runs": pack(runs),
                   "pairs": pack(self.pair_key[cold] & _48, 6), "counts": pack(self.pair_count[cold]),
                   "hot": pack(hot[hot >= 0], 2), "hot_pairs": pack(self.pair_key[asked[hot >= 0]] & _48, 6),
                   "hot_counts": pack(self.pair_count[asked[hot >= 0]])}

    def assemble(self, answers: list[dict], hot_c: np.ndarray, hot_t: np.ndarray) -> tuple[np.ndarray, ...]:
        """c(h), T(h) of the block's histories and c(h, w) of its pairs, from the buckets' answers."""
        c, t = np.zeros(len(self.history), np.int64), np.zeros(len(self.history), np.int64)
        known = self.hot_number >= 0
        c[known], t[known] = hot_c[self.hot_number[known]], hot_t[self.hot_number[known]]
        answers = sorted(answers, key=lambda r: r["bucket"])
        if any(r["signature"] != self.signature for r in answers):
            raise ValueError("a block's documents changed between two readings; score a stored table")

        def whole(name: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(unpack(r[name], 6).astype(np.int64) for r in answers)])

        c[self.asked_history], t[self.asked_history] = whole("c"), whole("t")
        pairs = np.zeros(len(self.pair_key), np.int64)
        pairs[self.asked] = whole("pairs")
        return c, t, pairs


def answer_bucket(rows: list[dict]) -> tuple[list[dict], dict]:
    """Sum the training counts of all blocks, then answer each; and what the bucket adds to the totals."""
    size = [len(r["histories"]) // 8 for r in rows]
    history, at = np.unique(np.concatenate([np.frombuffer(r["histories"], np.uint64) for r in rows]), return_inverse=True)
    own = np.repeat(at, np.concatenate([unpack(r["runs"]) for r in rows]).astype(np.int64))
    pair = np.concatenate([unpack(r["pairs"], 6) for r in rows])
    count = np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.int64)
    _, first, which = np.unique(mix(history[own] + mix(pair)), return_index=True, return_inverse=True)
    total = np.bincount(which, weights=count, minlength=len(first)).astype(np.int64)
    c = np.bincount(own, weights=count, minlength=len(history)).astype(np.int64)
    t = np.bincount(own[first[total > 0]], minlength=len(history))
    hot = np.concatenate([unpack(r["hot"], 2) for r in rows]).astype(np.int64)
    hot_count = np.concatenate([unpack(r["hot_counts"]) for r in rows]).astype(np.int64)
    hot_pair = np.concatenate([unpack(r["hot_pairs"], 6) for r in rows]) | hot.astype(np.uint64) << np.uint64(48)
    _, hot_first, hot_which = np.unique(hot_pair, return_index=True, return_inverse=True)
    hot_total = np.bincount(hot_which, weights=hot_count, minlength=len(hot_first)).astype(np.int64)
    numbers = np.unique(hot)
    hot_c = np.bincount(hot, weights=hot_count, minlength=1).astype(np.int64)
    hot_t = np.bincount(hot[hot_first[hot_total > 0]], minlength=len(hot_c))
    words = history != END  # the end precedes nothing; its count is the number of training texts
    summary = {"words": int(c[words].sum()), "distinct": int((c[words] > 0).sum()),
               "once": int((total == 1).sum() + (hot_total == 1).sum()),
               "twice": int((total == 2).sum() + (hot_total == 2).sum()),
               "hot": numbers.tolist(), "hot_c": hot_c[numbers].tolist(), "hot_t": hot_t[numbers].tolist()}
    out = []
    h_at = p_at = q_at = 0
    for r, n in zip(rows, size):
        p, q = len(r["pairs"]) // 6, len(r["hot_pairs"]) // 6
        mine = at[h_at: h_at + n]
        # cold pairs first, then hot ones: the order in which the block listed them
        counts = np.concatenate([total[which[p_at: p_at + p]], hot_total[hot_which[q_at: q_at + q]]])
        out.append({"target": r["block"], "bucket": r["target"], "signature": r["signature"], "c": pack(c[mine], 6),
                    "t": pack(t[mine], 6), "pairs": pack(counts, 6)})
        h_at, p_at, q_at = h_at + n, p_at + p, q_at + q
    return out, summary


@dataclass
class Model:
    """What all documents share: totals, the discount, and the hot histories (hashes, c, T)."""

    hot: np.ndarray
    c: np.ndarray
    t: np.ndarray
    words: int = 0
    distinct: int = 0
    discount: float = 0.5
    texts: int = field(init=False)

    def __post_init__(self) -> None:
        at = int(np.searchsorted(self.hot, START))
        self.texts = int(self.c[at])  # every training text leaves the start once
        self.words += int(self.c.sum()) - self.texts + self.texts  # hot words and the ends
        self.distinct += int((np.delete(self.c, at) > 0).sum()) + (self.texts > 0)


def walk(block: Walk, model: Model, c: np.ndarray, t: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
    """One left-to-right traversal of the block's documents: weight of each step, added up per document.

    The state before a token is its history; it takes the pair's arc if there is one, else the failure
    arc into the root and the root's arc. All documents of the block step at once, because the state that
    a token leads to is the token itself.
    """
    own = c.copy()
    own[block.history == END] = model.texts
    single = (own + ALPHA) / (model.words + ALPHA * (model.distinct + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        failure = np.where(c > 0, model.discount * t / np.maximum(c, 1), 1.0)
        known = c[block.pair_history]
        seen = np.where(pairs > 0, (pairs - model.discount) / np.maximum(known, 1), 0.0)
    root = single[block.at]
    weight = np.log10(seen[block.pair] + failure[block.before] * root)
    edges = np.concatenate([[0], np.cumsum(block.lengths)])

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, edges[:-1]) if len(block.lengths) else np.zeros(0)

    return {"n_tokens": block.lengths, "n_known": per_text((own[block.at] > 0).astype(np.int64)),
            "base_score": per_text(np.log10(root)), "score": per_text(weight)}


_REQUEST = ("histories", "runs", "pairs", "counts", "hot", "hot_pairs", "hot_counts")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    held_out_mod: int = HELD_OUT_MOD) -> DataFrame:
    """Per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    buckets = bucket_count(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % held_out_mod != 0).alias("train"),
                       partition_column())
    id_type = rows.schema["id"].dataType

    def texts_of(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
        return [t or b"" for t in bytes_of(part, "text")], np.array(part.column("train").to_pylist(), bool)

    # 1. histories that are frequent anywhere: a sum over the blocks in which they are frequent
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for part in chunks(batches, "text", BLOCK):
            words, _ = token_hashes(texts_of(part)[0], hasher)
            word, n = np.unique(words, return_counts=True)
            often = n * 2 * HOT_SHARE >= len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(word[often].view(np.int64), 0)), pa.array(np.append(n[often], len(words)))],
                names=["word", "n"])  # word 0 carries the block's total

    found = materialize(rows.mapInArrow(frequent, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-hot")
    total = found.where("word = 0").agg(F.max("n")).first()[0] or 0
    listed = found.where(f"word <> 0 and n >= {max(1, total // (2 * HOT_SHARE))}").select("word").collect()  # 2 * HOT_SHARE
    hot = np.unique(np.concatenate([[START], np.array([r["word"] for r in listed], np.int64).view(np.uint64)]).astype(np.uint64))

    # 2. each block asks, each bucket sums and answers
    request = pa.schema([("target", pa.int64()), ("block", pa.int64()), ("signature", pa.int64()),
                         *((c, pa.binary()) for c in _REQUEST)])
    reply = pa.schema([("target", pa.int64()), ("bucket", pa.int64()), ("signature", pa.int64()), ("c", pa.binary()),
                       ("t", pa.binary()), ("pairs", pa.binary()), *((c, pa.int64()) for c in
                                                                   ("words", "distinct", "once", "twice")),
                       *((c, pa.list_(pa.int64())) for c in ("hot", "hot_c", "hot_t"))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, blocks = SpanHasher(), BlockIds()
        for part in chunks(batches, "text", BLOCK):
            block, number = Walk(*texts_of(part), hasher, hot, buckets), blocks(part)
            yield rows_batch([r | {"block": number, "signature": block.signature} for r in block.requests()], request)

    def answer(table: pa.Table) -> pa.Table:
        replies, summary = answer_bucket(table.to_pylist())
        return pa.Table.from_pylist([*replies, summary], schema=reply)

    asked = rows.mapInArrow(ask, "target bigint, block bigint, signature bigint, " + ", ".join(f"{c} binary" for c in _REQUEST))
    answers = materialize(asked.groupBy("target").applyInArrow(
        answer, "target bigint, bucket bigint, signature bigint, c binary, t binary, pairs binary, words bigint, "
                "distinct bigint, once bigint, twice bigint, hot array<bigint>, hot_c array<bigint>, hot_t array<bigint>"), "lm-answers")

    # 3. totals: a few numbers and at most 2 * HOT_SHARE + 1 hot histories
    parts = answers.where("target is null")
    sums = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "distinct", "once", "twice"))).first()
    c, t = np.zeros(len(hot), np.int64), np.zeros(len(hot), np.int64)
    for r in parts.select(F.explode(F.arrays_zip("hot", "hot_c", "hot_t")).alias("z")).groupBy("z.hot").agg(
            F.sum("z.hot_c").alias("c"), F.sum("z.hot_t").alias("t")).collect():
        c[r["hot"]], t[r["hot"]] = r["c"], r["t"]
    once, twice = sums["once"], sums["twice"]
    model = Model(hot, c, t, sums["words"], sums["distinct"], once / (once + 2 * twice) if once else 0.5)

    # 4. the answers meet the documents of their block again
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = BlockIds()
        for part in chunks(batches, "text", BLOCK):
            number = blocks(part)
            yield pa.RecordBatch.from_arrays(  # one row, so that the documents keep their order
                [pa.array([number], pa.int64()),
                 *(pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in ("id", "text", "train"))],
                names=["target", "id", "text", "train"])

    def score(block_rows: pa.Table, replies: pa.Table) -> pa.Table:
        part = pa.RecordBatch.from_arrays([block_rows.column(c).chunk(0).flatten() for c in ("id", "text", "train")],
                                          names=["id", "text", "train"])
        texts, train = texts_of(part)
        block = Walk(texts, train, SpanHasher(), hot, buckets)
        out = walk(block, model, *block.assemble(replies.select(["bucket", "signature", "c", "t", "pairs"]).to_pylist(),
                                                 model.c, model.t))
        return pa.table([part.column("id"), pa.array(~train), pa.array(out["n_tokens"], pa.int64()),
                         pa.array(out["n_known"], pa.int64()), pa.array([model.words] * len(texts), pa.int64()),
                         pa.array(out["base_score"], pa.float64()), pa.array(out["score"], pa.float64())],
                        names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = id_type.simpleString()
    placed = rows.mapInArrow(documents, f"target bigint, id array<{kind}>, text array<string>, train array<boolean>")
    return placed.groupBy("target").cogroup(answers.where("target is not null").groupBy("target")).applyInArrow(
        score, f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
               "base_score double, score double")
