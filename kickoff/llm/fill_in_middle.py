"""Fill-in-the-middle transformation by secondary sort (operator 13).

A map task cuts a text into prefix, middle and suffix at two of its lines, chosen by a hash of the
document's id, and emits the parts as pieces: runs of whole lines of at most ``PIECE`` bytes (a longer
line is cut by bytes), keyed by document and position in the *output*. One exchange by document, sorted
by (document, position), streams the pieces of a document in output order into an incremental digest.
The same pass reads the sentinels back out of that stream, which tells each piece's place in the text;
a second sort of the same partition (no second exchange) streams the pieces in text order into the digest of
the restored text. A task holds one batch of pieces, ``ROWS`` of them as Python values, and
two digests, whatever the length of a text.

The key of a document is its partition and its position there, so repeated ids are documents of their own
and a hot id is spread. Documents should be a stored table (or any input that gives the same rows in
the same order when a lost partition is read again).

Defined cases: a null text is an empty one (no lines, ``plain``, empty output). A text that holds a sentinel
stays plain, as does an empty one; part lengths are null then. A null id hashes as an empty number. A text
without a line break is one line, so that two of the three parts are empty. Texts of any length are whole.
Repeated rows give repeated results, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import CHUNK_BYTES, bucket_count, chunks, partition_column

# Fixed values of the contract: sentinels, and the order of the parts in each form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}  # order of the parts in the text
SEED = 7

PIECE = 16 << 10  # bytes of a piece: a batch of pieces stays small
PARTITION = 32 << 20  # bytes of input per partition of the exchange
TAIL = 3  # place of the row that closes a document
ROWS = 512  # pieces that a task holds as Python values at a time


def draw(number: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of a document's id."""
    digest = hashlib.sha256(f"{seed}:{number}".encode()).digest()
    return tuple(int.from_bytes(digest[i: i + 4], "big") for i in (0, 4, 8, 12))


def choose(text: bytes, number: str, rate: int, spm: int, seed: int) -> tuple[str, int, int, int]:
    """Form, number of lines, and the byte offsets at which the prefix and the middle end."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    n = len(breaks) + (not text.endswith(b"\n") and bool(text))
    h1, h2, h3, h4 = draw(number, seed)
    if not text or any(s in text for s in PLACE) or h3 % 100 >= rate:
        return "plain", n, 0, 0
    ends = [0 if k == 0 else len(text) if k == n else int(breaks[k - 1]) + 1 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return "spm" if h4 % 100 < spm else "psm", n, ends[0], ends[1]


def runs(text: bytes, begin: int, end: int, most: int) -> Iterator[bytes]:
    """Whole lines of ``text[begin:end]`` up to ``most`` bytes at a time; at least one piece."""
    while end - begin > most:
        cut = text.rfind(b"\n", begin, begin + most) + 1 or begin + most
        yield text[begin:cut]
        begin = cut
    yield text[begin:end]


def output_pieces(text: bytes, form: str, a: int, b: int, most: int) -> Iterator[bytes]:
    """The output in order; a piece that opens a part begins with its sentinel."""
    if form == "plain":
        yield from runs(text, 0, len(text), most)
        return
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    for sentinel in ORDER[form]:
        for k, piece in enumerate(runs(text, *parts[sentinel], most)):
            yield piece if k else sentinel + piece


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50, seed: int = SEED,
              piece_bytes: int = PIECE, with_output: bool = False) -> DataFrame:
    """Per document: id, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars``, digests of output and restored text.

    ``rate``: percentage of documents to transform, ``spm``: percentage of those that get the suffix first.
    ``with_output`` adds the output text itself (then a task holds one output at a time).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), partition_column())
    id_type = rows.schema["id"].dataType
    kind = id_type.simpleString()
    head = [("id", to_arrow_type(id_type)), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
            ("middle_chars", pa.int64())]
    head_ddl = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint"
    closing = [("output_sha256", pa.string()), *([("output", pa.string())] * with_output)]
    piece_schema = pa.schema([("key", pa.int64()), ("pos", pa.int64()), ("piece", pa.binary()), *head])
    text_schema = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("pos", pa.int64()), ("piece", pa.binary()), *head, *closing])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, out, held = 0, [], 0
        for part in chunks(batches, "text"):
            first = part.column("part")[0].as_py() << 40
            for number, text in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                text, seq = text or b"", seq + 1
                form, n, a, b = choose(text, "" if number is None else str(number), rate, spm, seed)
                sizes = (None, None) if form == "plain" else (len(text[:a].decode()), len(text[a:b].decode()))
                for pos, piece in enumerate(output_pieces(text, form, a, b, piece_bytes)):
                    out.append((first + seq, pos, piece, *((number, n, form, *sizes) if pos == 0 else (None,) * 5)))
                    held += len(piece) + 64
                    if held > CHUNK_BYTES:
                        yield _batch(out, piece_schema)
                        out, held = [], 0
        yield _batch(out, piece_schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in output order: digest of the output, and the place of each piece in the text."""
        key = opening = digest = place = kept = None

        def tail() -> tuple:
            return (key, TAIL, 0, None, *opening, digest.hexdigest(), *([b"".join(kept).decode()] * with_output))

        nothing = (None,) * (len(text_schema) - 4)
        for batch in slices(batches):
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                piece = row[2]
                if row[0] != key:
                    if key is not None:
                        out.append(tail())
                    key, opening, digest, place, kept = row[0], row[3:], hashlib.sha256(), 0, []
                digest.update(piece)
                if with_output:
                    kept.append(piece)
                if opening[2] != "plain" and piece[:3] in PLACE:  # no piece of the text itself can hold a sentinel
                    place, piece = PLACE[piece[:3]], piece[3:]
                out.append((key, place, row[1], piece, *nothing))
            yield _batch(out, text_schema)
        if key is not None:
            yield _batch([tail()], text_schema)

    result = pa.schema([(id_col, head[0][1]), *head[1:], *closing, ("restored_sha256", pa.string())])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in text order, closed by the document's row: digest of the restored text."""
        digest = hashlib.sha256()
        for batch in slices(batches):
            out = []
            places, pieces = batch.column("place").to_pylist(), batch.column("piece").to_pylist()
            for i, (place, piece) in enumerate(zip(places, pieces)):
                if place == TAIL:
                    out.append((*(batch.column(c)[i].as_py() for c in range(4, len(text_schema))), digest.hexdigest()))
                    digest = hashlib.sha256()
                else:
                    digest.update(piece)
            if out:
                yield _batch(out, result)

    pieces = rows.mapInArrow(cut, f"key bigint, pos bigint, piece binary, {head_ddl}")
    extra = ", output string" if with_output else ""
    written = (pieces.repartition(bucket_count(docs, PARTITION), "key").sortWithinPartitions("key", "pos")
               .mapInArrow(write, f"key bigint, place int, pos bigint, piece binary, {head_ddl}, output_sha256 string{extra}"))
    return written.sortWithinPartitions("key", "place", "pos").mapInArrow(
        restore, f"`{id_col}` {head_ddl[3:]}, output_sha256 string{extra}, restored_sha256 string")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def restore_text(output: str, form: str) -> str:
    """The text from its output and form (what the streams compute piece by piece)."""
    if form == "plain":
        return output
    parts, rest = {}, output
    for sentinel, following in zip(ORDER[form], (*ORDER[form][1:], None)):
        rest = rest[3:]
        at = rest.index(following.decode()) if following else len(rest)
        parts[sentinel], rest = rest[:at], rest[at:]
    return "".join(parts[s] for s in sorted(parts, key=PLACE.get))
