"""Small stored tables with every awkward case, next to the given ones of the smallest scale."""

import os
import random
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


def odd_documents():
    rng = random.Random(5)
    words = ["lorem", "Ipsum", "dolor", "sit", "amet", "été", "naïve", "Straße", "x", "#tag", "1²3", "don't", "'ll"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(60))
    prose = " ".join(rng.choice(words) + str(rng.randrange(5000)) for _ in range(4000))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "a b c", passage, passage, passage + " tail",
             "head " + passage, passage + "\n" + passage, "same line here\n" * 30, "that " * 400, prose,
             prose[: len(prose) // 2] + "\x00\x1c\u0085 　 " + passage, "<|endoftext|>", "a<|endoftext|><|endoftext|> b",
             "日本語 ١٢٣ 👩‍👩‍👧 'S 's\n\n  x's's", "password = 'abcdefgh1' PassWd:short api_key=\"0123456789\" token token=zzzzzzzz",
             "AKIA" + "A" * 12 + " AKIA" + "A" * 11 + " " + "f" * 32 + "g" + "f" * 31 + " AKIAAKIAAKIAAKIAx",
             "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY----- secret:ſecret12 ſecret=aaaaaaaaa", "# * $ % & | < >" * 20]
    ids = list(range(100_000, 100_000 + len(texts)))
    rows = list(zip(ids, texts))
    rows += [rows[6], rows[6], (100_500, prose), (100_500, passage), (None, passage), (None, None), (None, "one two three four")]
    return [(i, t, None if n % 7 == 3 else "en", None if n % 5 == 2 else f"odd{n % 3}", None if n % 4 == 1 else len(t or ""))
            for n, (i, t) in enumerate(rows)]


def table(rows):
    columns = list(zip(*rows)) or [()] * 5
    return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "text": pa.array(columns[1], pa.string()),
                     "lang": pa.array(columns[2], pa.string()), "source": pa.array(columns[3], pa.string()),
                     "n_chars": pa.array(columns[4], pa.int64())})


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    """The given documents and the awkward ones over several files; labels and embeddings with nulls and ties."""
    d = tmp_path_factory.mktemp("odd")
    given = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text", "lang", "source", "n_chars"])
    rows = odd_documents() + [tuple(r.values()) for r in given.to_pylist()]
    (d / "documents.parquet").mkdir()
    for k in range(4):
        pq.write_table(table(rows[k::4]), d / "documents.parquet" / f"part-{k}.parquet")
    labels = pq.read_table(f"{SMALL}/labels.parquet").to_pylist()
    labels += [{"doc_id": None, "quality": 1, "toxic": 0}, {"doc_id": 100_003, "quality": None, "toxic": None}]
    pq.write_table(pa.Table.from_pylist(labels), d / "labels.parquet")
    rng = random.Random(9)
    vectors = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, 0.1]) for _ in range(8)]) for i in range(0, 700)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(150)] + [(100, [0.5] * 8), (None, [0.1] * 8), (2000, None), (2100, []),
                (2200, [None] * 8), (2300, [float("nan")] * 8), (2400, [float("inf")] * 8), (2500, [0.5] * 3), (2600, [1e30] * 8)]
    pq.write_table(pa.table({"vec_id": pa.array([v[0] for v in vectors], pa.int64()),
                             "embedding": pa.array([v[1] for v in vectors], pa.list_(pa.float32())),
                             "label": pa.array([1] * len(vectors), pa.int32())}), d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    pq.write_table(table([]), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()),
                             "toxic": pa.array([], pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())),
                             "label": pa.array([], pa.int32())}), d / "embeddings.parquet")
    pq.write_table(pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()),
                             "text": pa.array([], pa.string())}), d / "conversations.parquet")
    return str(d)


@pytest.fixture(scope="session")
def odd_rows(odd_dir):
    return [tuple(r.values()) for r in pq.read_table(f"{odd_dir}/documents.parquet").to_pylist()]
