"""Packing: ids against the tokenizers library, and the rules that any packing must keep."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kickoff.llm import packing, queries, spans, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def check(rows, docs, library, capacity=4096):
    """Every id of every document in one piece, checks right, sequences gapless and full or a power of two; returns padding."""
    want = Counter()
    for number, text in docs:
        want[number, tuple(ids_of(library, text))] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] > 0 and 0 <= r["start"] and r["start"] + r["length"] <= r["doc_tokens"]
    for (number, n), pieces in by_doc.items():
        copies = [(ids, c) for (i, ids), c in want.items() if i == number and len(ids) == n]
        assert copies
        cover = np.zeros(n + 1, np.int64)
        for start, length, _ in pieces:
            cover[start] += 1
            cover[start + length] -= 1
        assert (np.cumsum(cover)[:-1] == sum(c for _, c in copies)).all()
        for start, length, value in pieces:
            assert value in {crc(ids[start: start + length]) for ids, _ in copies}
    assert {(i, len(ids)) for i, ids in want} == set(by_doc)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_query(spark, odd_dir, odd_rows, library):
    rows = queries.QUERIES["op12_packing"](spark, odd_dir).collect()
    assert check(rows, [(r[0], r[1]) for r in odd_rows], library) == 0
    assert {tuple(r) for r in rows} == {tuple(r) for r in queries.QUERIES["op12_packing"](spark, odd_dir).collect()}


def test_many_groups_and_ids(spark, odd_dir, odd_rows, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 50_000)
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    rows = packing.pack_documents(docs, capacity=256, with_ids=True).collect()
    assert check(rows, [(r[0], r[1]) for r in odd_rows], library, 256) == 0
    assert len({r["sequence_id"] >> 32 for r in rows}) > 5
    assert all(crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)


def test_ids_equal_the_library(library):
    words = word_ids.WordTokenizer(PATH, spans.load_classes(word_ids.word_classes(PATH)))
    rng = random.Random(1)
    parts = ["a", "B", "S", "'s", "'", "'Re", "'LL", "d", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "²", "12", "é", "É", "İ",
             "Σ", "ΟΔΟΣ", "ß", "ẞ", "!", "_", "..", " ", "　", "日本", "Ⅷ", "١", "👩‍👩‍👧", "̇", "̣̀", "<|endoftext|>",
             "<|startoftext|>", "<|end", "\x00", "ŉ", "Ǆ", "가", "ﬁ", "Ᲊ", "᷺", "x" * 300]
    for _ in range(600):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) for _ in range(5)] + [None, ""]
        flat, bounds = words.ids(texts)
        for i, text in enumerate(texts):
            assert flat[bounds[i]: bounds[i + 1]].tolist() == ids_of(library, text)[:-1], text


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(word_ids, "KEPT_WORDS", 3)
    words = word_ids.WordTokenizer(PATH, spans.load_classes(word_ids.word_classes(PATH)))
    text = " ".join(f"word{k % 11} Other" for k in range(100))
    assert words.ids([text])[0].tolist() == ids_of(library, text)[:-1]


def test_very_long_texts(spark, tmp_path, library):
    rng = random.Random(2)
    rows = [(1, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(600_000))), (2, "z" * 3_000_000), (3, None), (4, "end.")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    assert check(packing.pack_documents(spark.read.parquet(f"{tmp_path}/docs")).collect(), rows, library) == 0


def test_repeated_rows_and_clashing_names(spark, tmp_path, library):
    rows = [(k % 3, "the same text of a third of all rows " * 9) for k in range(300)] + [(None, "x")] * 3 + [(7, "")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in (
        "id", "key", "start", "length", "ids", "group", "part", "doc_tokens", "offset")))
    docs.write.parquet(f"{tmp_path}/docs")
    assert check(packing.pack_documents(spark.read.parquet(f"{tmp_path}/docs")).collect(), rows, library) == 0


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 3000, 4000))[::-1].copy()
    cost = Counter()
    for _, _, n, sequence, _ in packing.place(lengths, 4096, 1.0, 1 / 2048):
        cost[sequence] += n + n * n / 2048
    full = np.array([cost[s] for s in cost if s < lengths.sum() // 4096])
    in_order = Counter()  # the same documents laid end to end
    at = 0
    for n in rng.permutation(lengths).tolist():
        while n:
            take = min(n, 4096 - at % 4096)
            in_order[at // 4096] += take + take * take / 2048
            at, n = at + take, n - take
    assert full.std() < 0.5 * np.array(list(in_order.values())).std()
