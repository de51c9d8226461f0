"""BPE encoding and decoding with a transducer lexicon (operator 10).

Pre-tokens are counted over the whole corpus; those above the count that leaves at most ``LEXICON``
words of ``LEXICON_BYTES`` together are the frequent ones; a word of over ``WORD_BYTES`` is never one. They are compiled into a minimal acyclic automaton (shared prefixes and
suffixes). Each arc carries the number of accepted words that precede it, so the sum along a path is
the word's number, the transducer's output, which points at its ids. States are laid out as a double
array (next = base + byte, valid where check = state), written to one file in the shared scratch
folder, handed out by ``SparkContext.addFile`` and memory-mapped by the tasks. The distinct pre-tokens of a chunk
walk the automaton together, one byte a step. A word outside the lexicon is merged exactly by the
tokenizer's own BPE model. The lexicon only saves work: any choice of words gives the same ids.

Texts are split as the tokenizer does: special strings first, then the byte-level pattern
(``spans.pretoken_spans``). Decoding joins the bytes of the ids.

Defined cases: a null text is an empty one (no ids). Texts of any length are encoded whole. Repeated
rows and ids are encoded independently, null ids stay null, other columns are ignored. An empty table
gives an empty result. A lost executor costs its own chunks; the automaton file is in the shared folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kickoff.session import materialize, scratch_path

from .blocks import chunks
from .spans import SpanHasher, class_table, distinct, load_classes, pretoken_spans

LEXICON = 1 << 16  # most words of the lexicon
LEXICON_BYTES = 1 << 20  # most bytes of its words together
WORD_BYTES = 256  # most bytes of one of its words
EXACT = 1 << 16  # counts below have a step of the histogram each, larger ones share 1024 steps per doubling
COUNTED, COUNT_CHUNK = 1 << 16, 1 << 20  # words that a counting task holds before it sends them on; bytes of its chunks
KEPT_WORDS = 1 << 17  # merged words a task remembers before it starts afresh (some 250 bytes each)
CHUNK = 1 << 19  # bytes of an encoding chunk; hashing its words takes some 60 bytes each


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What encoding needs of a byte-level BPE file: exact merges, bytes of ids, special strings."""

    def __init__(self, path: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        self._table = dict(enumerate(alphabet))
        back = {c: b for b, c in enumerate(alphabet)}
        self._model = tokenizer.model
        self.pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.bytes = {i: t.encode() if t in self.special else bytes(back[c] for c in t)
                      for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}

    def merge(self, word: bytes) -> list[int]:
        return [t.id for t in self._model.tokenize(word.decode("latin-1").translate(self._table))]

    def split(self, text: str) -> list[str | int]:
        """Ordinary stretches and ids of special strings, in order."""
        parts: list[str | int] = [text]
        for special, number in self.special.items():
            if special in text:
                new: list[str | int] = []
                for part in parts:
                    if isinstance(part, int):
                        new.append(part)
                    else:
                        for piece in part.split(special):
                            new += [piece, number]
                        new.pop()
                parts = new
        return parts


class Pretokens:
    """The pre-tokens of a chunk of texts: text number, distinct word number, the words' bytes."""

    def __init__(self, texts: list[str], classes: np.ndarray, hasher: SpanHasher) -> None:
        joined = "".join(texts)
        units = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        starts, self.text = pretoken_spans(units, offsets, classes)
        ends = np.append(starts[1:], len(units))
        keys = hasher(units, starts, ends)
        first, code = distinct(keys)
        other = hasher(units, starts, ends, 1)
        if not np.array_equal(other, other[first][code]):  # two words share one 64-bit hash: number them by both
            both = np.rec.fromarrays([keys, other])
            _, first, code = np.unique(both, return_index=True, return_inverse=True)
        self.code, self.keys = code, keys[first]  # a word's key is the same in every chunk
        self.words = [joined[a:b].encode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]


def corpus_words(docs: DataFrame, text_col: str, vocabulary_path: str) -> DataFrame:
    """(word, n): every pre-token of the corpus that occurs more than once, with its count."""
    packed = class_table(Vocabulary(vocabulary_path).pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, hasher, vocabulary = load_classes(packed), SpanHasher(), Vocabulary(vocabulary_path)
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                             names=["word", "n"])
            counts.clear()
            return out

        for part in chunks(batches, "text", COUNT_CHUNK):
            texts = [s for t in part.column("text").to_pylist() if t for s in vocabulary.split(t) if isinstance(s, str)]
            pre = Pretokens(texts, classes, hasher)
            for word, n in zip(pre.words, np.bincount(pre.code, minlength=len(pre.words)).tolist()):
                counts[word] = counts.get(word, 0) + n
            if len(counts) >= COUNTED:
                yield flush()
        if counts:
            yield flush()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def frequent_words(docs: DataFrame, text_col: str, vocabulary_path: str, most: int = LEXICON) -> list[bytes]:
    """At most ``most`` words of at most ``LEXICON_BYTES`` together: all above one step of the histogram of counts. If
    the step that no longer fits holds words of ``EXACT`` occurrences or more, as many of them as surely fit are taken too."""
    n = F.col("n")
    step = F.when(n < EXACT, n).otherwise(F.lit(EXACT) + F.floor((F.log2(n.cast("double")) - EXACT.bit_length() + 1) * 1024)).cast("long")
    counts = materialize(corpus_words(docs, text_col, vocabulary_path).withColumn("step", step)
                         .withColumn("bytes", F.octet_length("word").cast("long")), "bpe-words").where(F.col("bytes") <= WORD_BYTES)
    histogram = counts.groupBy("step").agg(F.count(F.lit(1)).alias("words"), F.sum("bytes").alias("bytes")).collect()  # bounded by the steps
    least, held, size, extra = None, 0, 0, []
    for r in sorted(histogram, key=lambda r: -r["step"]):
        if held + r["words"] > most or size + r["bytes"] > LEXICON_BYTES:
            if r["step"] >= EXACT:
                room = min(most - held, (LEXICON_BYTES - size) // WORD_BYTES)
                extra = counts.where(F.col("step") == r["step"]).select("word").limit(room).collect() if room > 0 else []
            break
        least, held, size = r["step"], held + r["words"], size + r["bytes"]
    rows = counts.where(F.col("step") >= least).select("word").collect() if least is not None else []
    return sorted(bytes(r["word"]) for r in [*rows, *extra])


class Lexicon:
    """Minimal acyclic automaton of sorted words; the outputs along a path add up to the word's number."""

    ARRAYS = ("base", "check", "target", "skip", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Lexicon:
        # states in the making: [final, {byte: state}]; a finished state is known by its content
        known: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = []
        final: list[bool] = []
        below: list[int] = []  # accepted words from the state on

        def settle(state: list) -> int:
            key = (state[0], tuple(state[1].items()))
            if key not in known:
                known[key] = len(arcs)
                arcs.append(state[1])
                final.append(state[0])
                below.append(int(state[0]) + sum(below[t] for t in state[1].values()))
            return known[key]

        path: list[list] = [[False, {}]]
        last = b""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            while len(path) > shared + 1:
                done = path.pop()
                path[-1][1][last[len(path) - 1]] = settle(done)
            for _ in word[shared:]:
                path.append([False, {}])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = path.pop()
            path[-1][1][last[len(path) - 1]] = settle(done)
        root = settle(path[0])

        # double array: states with many arcs first, each at the first place where all its slots are free
        slots = 2 * sum(map(len, arcs)) + 1024
        base = np.zeros(len(arcs), np.int32)
        used = np.zeros(slots, bool)
        check, target, skip = np.full(slots, -1, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        free = 0
        places = np.arange(1024)[:, None]
        for state in sorted(range(len(arcs)), key=lambda s: -len(arcs[s])):
            if not arcs[state]:
                continue
            marks = np.array(sorted(arcs[state]), np.int64)
            at = max(free - int(marks[0]), 0)
            while len(marks) > 1 or used[at + marks[0]]:
                if at + 1024 + 256 >= len(used):
                    used, check, target, skip = (np.concatenate([x, np.full(len(x), fill, x.dtype)])
                                                 for x, fill in ((used, False), (check, -1), (target, 0), (skip, 0)))
                open_places = np.flatnonzero(~used[at + places + marks].any(axis=1))
                if len(open_places):
                    at += int(open_places[0])
                    break
                at += 1024
            base[state] = at
            used[marks + at] = True
            while free < len(used) - 1 and used[free]:
                free += 1
            passed = int(final[state])
            for mark in marks.tolist():
                to = arcs[state][mark]
                check[at + mark], target[at + mark], skip[at + mark] = state, to, passed
                passed += below[to]
        check = np.concatenate([check, np.full(256, -1, np.int32)])  # base + byte stays inside
        start = np.zeros(len(words) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=start[1:])
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(start[-1]))
        return cls({"base": base, "check": check, "target": target, "skip": skip, "final": np.array(final, np.int8),
                    "start": start, "ids": np.append(flat, root).astype(np.int32)})

    def to_bytes(self) -> bytes:
        """A line of JSON (names, types, lengths) and the arrays, each at a multiple of 8 bytes."""
        arrays = [getattr(self, n) for n in self.ARRAYS]
        head = json.dumps([[n, a.dtype.str, len(a)] for n, a in zip(self.ARRAYS, arrays)]).encode() + b"\n"
        head = head[:-1].ljust(-len(head) % 8 + len(head) - 1) + b"\n"
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def map_file(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            line = f.readline()
        arrays, at = {}, len(line)
        for name, kind, n in json.loads(line):
            size = n * np.dtype(kind).itemsize
            arrays[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
            at += size + -size % 8
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton does not accept it."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        begins = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(n, int(self.ids[-1]), np.int64)
        number = np.zeros(n, np.int64)
        alive = np.arange(n)
        for depth in range(int(lengths.max(initial=0))):
            alive = alive[lengths[alive] > depth]
            if not len(alive):
                break
            at = self.base[state[alive]] + flat[begins[alive] + depth].astype(np.int64)
            ok = self.check[at] == state[alive]
            number[alive[~ok]] = -1
            state[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            number[alive] += self.skip[at]
            state[alive] = self.target[at]
        reached = state >= 0
        number[reached] = np.where(self.final[state[reached]] == 1, number[reached], -1)
        return number


def publish(spark, lexicon: Lexicon) -> str:
    """Write the automaton to the shared scratch folder, hand it to all executors, return the file's name."""
    import uuid

    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(lexicon.to_bytes()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Encoder:
    """Encodes chunks of texts: lexicon words by their number, others by exact merges (remembered)."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, classes: np.ndarray) -> None:
        self.vocabulary, self.lexicon, self.classes, self.hasher = vocabulary, lexicon, classes, SpanHasher()
        start, ids = lexicon.start.tolist(), lexicon.ids[:-1].tolist()
        self.listed = [self._entry(ids[a:b]) for a, b in zip(start[:-1], start[1:])]
        self.merged: dict[bytes, tuple] = {}

    def _entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(str, ids)), b"".join(self.vocabulary.bytes[i] for i in ids)

    def _merged(self, word: bytes) -> tuple[int, str, bytes]:
        entry = self.merged.get(word)
        if entry is None:
            if len(self.merged) >= KEPT_WORDS:
                self.merged.clear()
            n, written, decoded = self._entry(self.vocabulary.merge(word))
            entry = self.merged[word] = n, written, word if decoded == word else decoded  # not held twice
        return entry

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, bytes]]:
        """For each text the number of ids, the ids joined by commas, and their decoded bytes."""
        split = [self.vocabulary.split(t or "") for t in texts]
        plain = [s for parts in split for s in parts if isinstance(s, str)]
        pre = Pretokens(plain, self.classes, self.hasher)
        entries = [self.listed[k] if k >= 0 else self._merged(w)
                   for w, k in zip(pre.words, self.lexicon.numbers(pre.words).tolist())]
        lengths = np.fromiter((e[0] for e in entries), np.int64, len(entries))
        written, decoded = [e[1] for e in entries], [e[2] for e in entries]
        bounds = np.searchsorted(pre.text, np.arange(len(plain) + 1)).tolist()
        totals = np.concatenate([[0], np.cumsum(lengths[pre.code])])
        at = 0
        for parts in split:
            count, ids, out = 0, [], []
            for part in parts:
                if isinstance(part, int):
                    count += 1
                    ids.append(str(part))
                    out.append(self.vocabulary.bytes[part])
                    continue
                a, b = bounds[at], bounds[at + 1]
                at += 1
                if a < b:
                    codes = pre.code[a:b].tolist()
                    count += int(totals[b] - totals[a])
                    ids.append(",".join(map(written.__getitem__, codes)))
                    out += map(decoded.__getitem__, codes)
            yield count, ",".join(ids), b"".join(out)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     path: str | None = None, lexicon_words: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """Per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on request, ``ids``.

    ``path``: the tokenizer file, at the same place on driver and executors.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    words = frequent_words(docs, text_col, path, lexicon_words)
    vocabulary = Vocabulary(path)
    name = publish(spark, Lexicon.build(words, [vocabulary.merge(w) for w in words]))
    packed = class_table(vocabulary.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path), Lexicon.map_file(SparkFiles.get(name)), load_classes(packed))
        for part in chunks(batches, "text", CHUNK):
            counts, ids_sha, text_sha, ids = [], [], [], []
            for count, written, decoded in encoder.encode(part.column("text").to_pylist()):
                counts.append(count)
                ids_sha.append(hashlib.sha256(written.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append([int(i) for i in written.split(",")] if written else [])
            columns = [part.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                       pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
                                             names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
