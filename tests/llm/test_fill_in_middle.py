"""Fill-in-the-middle against a plain version on whole texts."""

import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kickoff.llm import fill_in_middle, queries

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(number, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if number is None else number}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return (number, n, "plain", None, None, sha(text), sha(text)), text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (number, n, form, len(prefix), len(middle), sha(output), sha(text)), output


def key(row):
    return tuple((x is not None, x) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)


def test_query(spark, odd_dir, odd_rows):
    expected = sorted((plain_version(r[0], r[1])[0] for r in odd_rows), key=key)
    assert rows_of(queries.QUERIES["op13_fill_in_middle"](spark, odd_dir)) == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("piece", [1, 7, 4096])
def test_awkward_texts_in_small_pieces(spark, tmp_path, piece):
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "\na", "<P", "<<P>", "a<M>b", "S>\nP>", "<\n<S\n<P\n<M\n", "é\n日本\n👩‍👩‍👧\n", "\r\n\r\n x",
             "line\n" * 300, "x" * 5000 + "\n" + "é" * 3000, "<P" + "\n" * 50 + "P>"]
    rows = [(k * 20 + j, t) for k in range(3) for j, t in enumerate(texts)] + [(None, "a\nb\nc"), (900, "a\n"), (900, "a\n")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    got = fill_in_middle.transform(spark.read.parquet(f"{tmp_path}/docs"), piece_bytes=piece, with_output=True)
    assert rows_of(got) == sorted((plain_version(*r)[0] for r in rows), key=key)
    outputs = {(r["doc_id"], r["output"]) for r in got.collect()}
    assert outputs == {(i, plain_version(i, t)[1]) for i, t in rows}
    text = dict(rows)
    for r in got.where("doc_id is not null").collect():
        assert fill_in_middle.restore_text(r["output"], r["form"]) == (text[r["doc_id"]] or "")


def test_very_long_texts(spark, tmp_path):
    long = "\n".join(f"line {k} of some words" for k in range(300_000))  # over one chunk of a task
    rows = [(1, long), (2, "y" * 5_000_000), (3, "short\ntext\n"), (4, long + "<S>")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    got = fill_in_middle.transform(spark.read.parquet(f"{tmp_path}/docs"))
    assert rows_of(got) == sorted((plain_version(*r)[0] for r in rows), key=key)


def test_rate_and_extra_columns(spark, tmp_path):
    rows = [(k, "a\nb\nc\n") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in (
        "id", "key", "pos", "piece", "part", "place", "n", "form", "output_sha256")))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert rows_of(fill_in_middle.transform(docs)) == sorted((plain_version(*r)[0] for r in rows), key=key)
    forms = {f: n for f, n in fill_in_middle.transform(docs, rate=50, spm=0).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 70 < forms["plain"] < 130


def test_a_task_holds_few_pieces_as_values():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1300))})
    parts = list(fill_in_middle.slices([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert [p.num_rows for p in parts] == [512, 512, 276, 3]
    assert [x for p in parts for x in p.column("x").to_pylist()] == [*range(1300), 0, 1, 2]
