"""The pipeline's rows against a plain run of its stages, and each stage's columns."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from kickoff.llm import secret_scan
from kickoff.sources.tables import read_table


def plain_redact(text):
    found = secret_scan.Scanner(secret_scan.BASE + secret_scan.EXTRA).spans([text])[0]
    out, end = "", 0
    for a, _, b in found:
        if a >= end:
            out += text[end:a] + "[secret]"
        end = max(end, b)
    return out + text[end:] if found else text


def test_stages_return_the_columns_of_documents(spark, odd_dir, tmp_path):
    docs = read_table(spark, odd_dir, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_rows(spark, odd_dir, odd_rows):
    kept = [r for r in odd_rows if brute.quality(r[1])[-1]]
    marks = brute.simhash([(r[0], r[1]) for r in kept])
    first, seen = [], set()
    for r, (i, f, c) in zip(kept, marks):
        if i == c and c not in seen:
            seen.add(c)
            first.append(r)
    assert len({r[0] for r in first}) == len(first)
    clean = {r[0]: plain_redact(r[1]) for r in first}
    got = corpus_pipeline.run(spark, odd_dir).collect()
    expected = {e[0]: e for e in brute.encoded(list(clean.items()))}
    copies = {}
    for r in got:
        assert tuple(r) == expected[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    sizes = [(r[3], len(brute.words(clean[r[0]]))) for r in first]
    total, target = brute.targets(sizes)
    for r in first:
        rate = target[r[3]] / total[r[3]]
        assert int(rate) <= copies.get(r[0], 0) <= min(3, int(rate) + 1)


def test_every_name_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_empty(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:4]], ids=lambda s: s[0])
def test_extra_columns_pass(spark, odd_dir, stage):
    docs = read_table(spark, odd_dir, "documents").withColumns({n: F.lit("c") for n in ("fp_0", "id", "row", "size", "draw", "rate", "copies", "bits")})
    assert stage[1](spark, docs, odd_dir).columns == docs.columns
