"""Conversation structure repair by a grammar-compressed DP (operator 11).

Each row of a conversation becomes a symbol: its role's initial and its fault. Rows are range-partitioned by (conversation,
turn, …) and streamed in order into blocks of bounded rows and bytes, so a conversation of any length is many blocks
in many tasks. The distinct symbol strings of all blocks are compressed with one grammar by Re-Pair rounds (pairs are
counted by Spark over all strings, the most frequent ones that share no symbol become rules). Each
rule gets one min-plus transfer matrix with ropes of edits, bottom-up (``transfer.py``); blocks of all
conversations share them. A conversation that is one block is finished where it lies. For the others one
small row per block (sixteen costs and ranks) is folded in order, the chosen states go back to the blocks, and their rows
stream in order into the digest. The grammar only saves work: any rules give the same repair.

A row is a duplicate if its role and text stood earlier in the conversation. The earliest row of each (conversation, digest
of role and text) is found by an aggregation (combined before the shuffle) and sent into the ordered
stream as a mark on that row; rows without a mark are duplicates. No join, no set of seen texts.

Order: turn (null first); rows of one turn by role and the SHA-256 of role and text. Messages should be a
stored table: the marks are found in a read of their own, and a mark that does not meet its row raises.

Defined cases: null conversation ids are one conversation; null roles and texts are one space (role " " has no
legal initial, text " " is blank); rows with a null turn come first and count for no gap; repeated rows are duplicates; a conversation
without rows has zeros and an empty audit; texts of any length are kept whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kickoff.session import fresh_path, materialize

from .blocks import bucket_count
from .transfer import MUST_DELETE, START, Front, Grammar, pair_counts, text, walk

BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 20  # a block of a conversation (one longer text is a block of its own)
PARTITION = 32 << 20  # bytes of input per range partition
ROUNDS, RULES, AT_LEAST = 12, 1024, 2  # effort of the compression: rounds, rules, occurrences of a pair
KEPT_AUDITS = 1 << 16  # audits a task remembers before it starts afresh
SPACES = " \t\n\x0b\x0c\r"  # fixed values of the contract
LEGAL = ("su", "ua", "au")


def damage(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The contract's damage: (conversation, turn, role, text, ``dropped``); a dropped row only names its conversation."""
    role, body = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
        (kind == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return rows.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
                       F.col("text").alias(text_col), "dropped")


def _rows(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, dropped: Column) -> DataFrame:
    role, body = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), body.alias("text"),
                           dropped.alias("dropped"), F.monotonically_increasing_id().alias("uid"))
    seen = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv", "turn", "role", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
        "uid", "dropped", (seen == "").alias("blank"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o")).alias("initial"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("truncated"), "text")


def ordered(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows in order with a mark (``kind`` 0) before the first of each role and text, range-partitioned."""
    first = (rows.where("NOT dropped").groupBy("conv", "role", "digest")
             .agg(F.min(F.struct("turn", "uid")).alias("first")))
    marks = first.select("conv", F.col("first.turn").alias("turn"), "role", "digest", F.col("first.uid").alias("uid"),
                         F.lit(0).alias("kind"))
    keys = ["conv", "turn", "role", "digest", "uid"]  # a mark has the key of its row, so no border parts them
    return (rows.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
            .repartitionByRange(partitions, *keys).sortWithinPartitions(*keys, "kind"))


class _Block:
    """Rows of one conversation on their way into a block."""

    def __init__(self, conv, part: int, seq: int) -> None:
        self.conv, self.part, self.seq, self.bytes = conv, part, seq, 0
        self.symbols: list[str] = []
        self.initials: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.counts = [0, 0, 0]  # blank, duplicate, truncated
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turn, role: str, body: str, initial: str, blank: bool, first: bool, truncated: bool) -> None:
        if blank or not first:
            self.counts[0 if blank else 1] += 1
            self.symbols.append(MUST_DELETE)
        else:
            self.counts[2] += truncated
            self.symbols.append(initial.upper() if truncated else initial)
        self.initials.append(initial)
        self.roles.append(role)
        self.texts.append(body)
        self.bytes += len(body) + len(role)
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def row(self, whole: bool) -> tuple:
        pairs = zip(self.initials, self.initials[1:])
        return (whole, self.conv, self.part, self.seq, "".join(self.symbols), self.roles, self.texts, "".join(self.initials[:1]),
                "".join(self.initials[-1:]), sum(a + b not in LEGAL for a, b in pairs), *self.counts, self.turns, self.first_turn,
                self.last_turn)


_BLOCK = [("whole", pa.bool_()), ("conv", None), ("part", pa.int32()), ("seq", pa.int64()), ("symbols", pa.string()),
          ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("head", pa.string()), ("tail", pa.string()),
          ("illegal", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
          ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
_DDL = ("whole boolean, conv {}, part int, seq bigint, symbols string, roles array<string>, texts array<string>, head string, tail string, "
        "illegal bigint, blank bigint, duplicate bigint, truncated bigint, turns bigint, first_turn bigint, last_turn bigint")


def _schema(fields: list, conv_type: pa.DataType) -> pa.Schema:
    return pa.schema([(n, conv_type if t is None else t) for n, t in fields])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def blocks(stream: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Blocks of the ordered stream; ``whole`` ones surely hold all rows of their conversation."""
    conv_type = stream.schema["conv"].dataType
    schema = _schema(_BLOCK, to_arrow_type(conv_type))
    columns = ["conv", "turn", "role", "text", "uid", "kind", "dropped", "blank", "initial", "truncated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, alone, seq, mark, out, held = None, False, 0, None, [], 0
        for batch in batches:
            for conv, turn, role, body, uid, kind, dropped, blank, initial, truncated in zip(*(batch.column(c).to_pylist() for c in columns)):
                if mark is not None and (kind == 0 or uid != mark):
                    raise RuntimeError("the messages changed between two reads: give the operator a stored table")
                if block is None:
                    block = _Block(conv, part, seq)  # may have begun in the partition before
                elif conv != block.conv:
                    out.append(block.row(alone))
                    held, seq, alone = held + block.bytes + 256, seq + 1, True
                    block = _Block(conv, part, seq)
                elif kind and len(block.symbols) and (len(block.symbols) >= block_rows or block.bytes + len(body) > block_bytes):
                    out.append(block.row(False))
                    held, seq, alone = held + block.bytes + 256, seq + 1, False
                    block = _Block(conv, part, seq)
                if kind == 0:
                    mark = uid
                elif not dropped:
                    block.add(turn, role, body, initial, blank, mark is not None, truncated)
                    mark = None
                if held > 4 << 20:
                    yield _batch(out, schema)
                    out, held = [], 0
        if mark is not None:
            raise RuntimeError("the messages changed between two reads: give the operator a stored table")
        if block is not None:
            out.append(block.row(False))  # may go on in the next partition
        yield _batch(out, schema)

    return stream.select(*columns).mapInArrow(run, _DDL.format(conv_type.simpleString()))


def learn(symbols: DataFrame, rounds: int = ROUNDS, most: int = RULES, at_least: int = AT_LEAST) -> Grammar:
    """Re-Pair over all distinct symbol strings (column ``symbols``, with their number ``n``)."""
    grammar = Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for s, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                for pair, k in pair_counts(grammar.compress(s)).items():
                    total[pair] += k * n
        yield pa.RecordBatch.from_pydict({"pair": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    for _ in range(rounds):
        pairs = symbols.mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        found = pairs.where(F.col("n") >= at_least).orderBy(F.desc("n"), "pair").limit(256).collect()  # bounded: a round's candidates
        used: set[str] = set()
        for r in found:
            if len(grammar.rules) < most and not used & set(r["pair"]):
                used |= set(r["pair"])
                grammar.add(r["pair"])
        if not used or len(grammar.rules) >= most:
            break
    return grammar


class _Digest:
    """SHA-256 of ``role:text`` rows joined by line breaks."""

    def __init__(self) -> None:
        self.sha, self.some = hashlib.sha256(), False

    def add(self, rows: list[tuple[str, str]]) -> None:
        for role, body in rows:
            self.sha.update(f"{chr(10) if self.some else ''}{role}:{body}".encode())
            self.some = True


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           dropped_col: str | None = None, with_messages: bool = False, block_rows: int = BLOCK_ROWS,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``
    and, on request, the repaired ``messages``. Rows with ``dropped_col`` true only name their conversation."""
    spark = messages.sparkSession
    rows = _rows(messages, conv_col, turn_col, role_col, text_col, F.col(dropped_col) if dropped_col else F.lit(False))
    conv_type = rows.schema["conv"].dataType
    arrow, kind = to_arrow_type(conv_type), conv_type.simpleString()
    path = fresh_path(spark, "conversation-blocks")
    blocks(ordered(rows, bucket_count(messages, PARTITION)), block_rows, block_bytes).write.partitionBy("whole").parquet(path)
    block_schema = _DDL.format(kind).replace("whole boolean, ", "") + ", whole boolean"
    stored = spark.read.schema(block_schema).parquet(path)
    grammar = learn(materialize(stored.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "conversation-symbols"))

    said = [("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))] * with_messages
    said_ddl = ", messages array<struct<role:string,text:string>>" * with_messages
    result = _schema([(conv_col, None), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      ("audit", pa.string()), ("repaired_sha256", pa.string()), *said], arrow)
    result_ddl = (f"`{conv_col}` {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
                  f"audit string, repaired_sha256 string{said_ddl}")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str]] = {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["symbols"] not in known:
                    if len(known) >= KEPT_AUDITS:
                        known.clear()
                    matrix, front = grammar.matrix(r["symbols"]), Front()
                    front.advance(matrix.costs, matrix.ranks)
                    cost, state, more = front.finish()
                    known[r["symbols"]] = cost, text(matrix.ropes[4 * START + state]) + "I" * more
                cost, audit = known[r["symbols"]]
                digest = _Digest()
                repaired, _ = walk(audit, r["roles"], r["texts"], START)
                digest.add(repaired)
                out.append((r["conv"], _gaps(r["first_turn"], r["last_turn"], r["turns"]), r["blank"], r["duplicate"], r["truncated"],
                            r["illegal"], cost, audit, digest.sha.hexdigest(), *([[{"role": a, "text": b} for a, b in repaired]] * with_messages)))
            yield _batch(out, result)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = [grammar.matrix(s) for s in batch.column("symbols").to_pylist()]
            kept = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([m.costs for m in matrices], pa.list_(pa.int64())),
                 pa.array([m.ranks for m in matrices], pa.list_(pa.int64()))], names=[*kept, "costs", "ranks"])

    path_schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("state", pa.int32()), ("to", pa.int32()), ("more", pa.int32()),
                             ("totals", pa.list_(pa.int64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States chosen for each block of a conversation; the last block gets the totals and the trailing inserts."""
        open_conv, steps = False, []
        conv = front = last = None
        totals, turns = [0] * 6, [None, None, 0]  # turns: first, last, distinct

        def close() -> list[tuple]:
            cost, state, more = front.finish()
            totals[5] = cost
            out, final = [], (more, [_gaps(*turns), *totals[1:]])
            for part, seq, via in reversed(steps):
                out.append((part, seq, via[state], state, *(final if not out else (0, None))))
                state = via[state]
            return out

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if not open_conv or r["conv"] != conv:
                    if open_conv:
                        done += close()
                    open_conv, conv, front, steps, last, totals, turns = True, r["conv"], Front(), [], None, [0] * 6, [None, None, 0]
                steps.append((r["part"], r["seq"], front.advance(r["costs"], r["ranks"])))
                for k, c in enumerate(("blank", "duplicate", "truncated", "illegal"), 1):
                    totals[k] += r[c]
                if r["head"]:
                    totals[4] += last is not None and last + r["head"] not in LEGAL
                    last = r["tail"]
                if r["first_turn"] is not None:
                    turns[2] += r["turns"] - (r["first_turn"] == turns[1])
                    turns[0] = r["first_turn"] if turns[0] is None else turns[0]
                    turns[1] = r["last_turn"]
            yield _batch(done, path_schema)
        if open_conv:
            yield _batch(close(), path_schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a conversation in order, each with its states: audit and digest."""
        digest, audit, kept = _Digest(), [], []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                word = text(grammar.matrix(r["symbols"]).ropes[4 * r["state"] + r["to"]]) + "I" * r["more"]
                repaired, _ = walk(word, r["roles"], r["texts"], r["state"])
                digest.add(repaired)
                audit.append(word)
                if with_messages:
                    kept += [{"role": a, "text": b} for a, b in repaired]
                if r["totals"] is not None:
                    out.append((r["conv"], *r["totals"], "".join(audit), digest.sha.hexdigest(), *([kept] * with_messages)))
                    digest, audit, kept = _Digest(), [], []
            yield _batch(out, result)

    parted = stored.where("NOT whole")
    names = ["conv", "part", "seq", "head", "tail", "illegal", "blank", "duplicate", "truncated", "turns", "first_turn", "last_turn"]
    summary = parted.select(*names, "symbols").mapInArrow(
        summarise, f"conv {kind}, part int, seq bigint, head string, tail string, illegal bigint, blank bigint, duplicate bigint, "
                   "truncated bigint, turns bigint, first_turn bigint, last_turn bigint, costs array<bigint>, ranks array<bigint>")
    paths = (summary.repartition("conv").sortWithinPartitions("conv", "part", "seq")
             .mapInArrow(fold, "part int, seq bigint, state int, to int, more int, totals array<bigint>"))
    chosen = (parted.select("conv", "part", "seq", "symbols", "roles", "texts").join(paths, ["part", "seq"])
              .repartition("conv").sortWithinPartitions("conv", "part", "seq"))
    return (stored.where("whole").drop("whole").mapInArrow(alone, result_ddl)
            .unionByName(chosen.mapInArrow(apply, result_ddl)))
