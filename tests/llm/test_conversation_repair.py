"""Conversation repair against a plain recursion over rows, and the algebra of its matrices."""

import hashlib
import random
import re
import zlib
from functools import cache

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kickoff.llm import conversation_repair, queries, transfer

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows):
    """(conv, turn, role, text or None for a dropped row)."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, None if kind == 0 else text)] * (2 if kind == 3 else 1)
    return out


def best_repair(faults, initials):
    """Least (cost, audit) by recursion from the back; whole suffixes are compared."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        options = []
        need = "a" if state == "u" else "u"
        if inserted < 3:
            cost, word = best(i, need, inserted + 1)
            options.append((cost + 3, "I" + word))
        if i == len(faults):
            if state in ("", "a"):
                options.append((0, ""))
        else:
            cost, word = best(i + 1, state, 0)
            options.append((cost + 4, "D" + word))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 if faults[i] == "truncated" else 0
                cost, word = best(i + 1, need, 0)
                options.append((cost + 3 + late, "R" + word))
                if (state, initials[i]) in after:
                    cost, word = best(i + 1, after[state, initials[i]], 0)
                    options.append((cost + late, "K" + word))
        return min(options, default=(10 ** 9, ""))

    for i in range(len(faults), 0, -1):  # fill the memory from the back: no deep recursion
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def plain_version(rows):
    """Expected rows of ``damaged`` rows."""
    out, by_conv = [], {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    for conv, all_rows in by_conv.items():
        kept = sorted((r for r in all_rows if r[3] is not None), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in kept:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in kept]
        cost, audit = best_repair(tuple(faults), tuple(initials))
        lines, state, at = [], "", 0
        for letter in audit:
            need = "a" if state == "u" else "u"
            if letter == "D":
                at += 1
                continue
            text = "" if letter == "I" else kept[at][3]
            role = kept[at][2] if letter == "K" else {"u": "user", "a": "assistant"}[need]
            lines.append(f"{role}:{text}")
            state, at = (role[:1] if letter == "K" else need), at + (letter != "I")
        turns = {r[1] for r in kept if r[1] is not None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def same(df, expected):
    got = sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)
    assert got == sorted(expected, key=key)


def odd_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "Yes.  \n", "é.", "　", "Yes. ", "...", ".", "a\x85", "x. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "System", "u", "sys"]
    rows = [(c, t, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts[:5] if rng.random() < 0.3 else [f"t{rng.random()}."] + texts))
            for c in range(150) for t in range(rng.randrange(1, 12))]
    rows += [(900, t, rng.choice(roles[:3]), rng.choice(["same.", f"other {t}.", f"open {t}"])) for t in range(400)]  # a long one
    rows += [(901, None, "user", "same."), (901, None, "user", "same."), (901, 3, "assistant", "b."), (901, 3, "user", "b.")] * 3
    rows += [(None, t, "user", "x.") for t in range(5)] + [(None, None, None, None)]
    rows += [(2000 + k, 0, "user", "alone.") for k in range(60)]  # some lose their only row
    rows += [(902, 7, "user", "u" * 50_000 + "."), (902, 9, "assistant", "v" * 50_000), (903, -5, "system", "s."), (903, 10 ** 12, "user", "q?")]
    return rows


@pytest.fixture(scope="module")
def chat_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("chats")
    given = pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pylist()
    rows = odd_rows() + [(10_000 + r["conv_id"], r["turn"], r["role"], r["text"]) for r in given]
    (d / "conversations.parquet").mkdir()
    for k in range(3):
        part = rows[k::3]
        pq.write_table(pa.table({"conv_id": pa.array([r[0] for r in part], pa.int64()), "turn": pa.array([r[1] for r in part], pa.int64()),
                                 "role": pa.array([r[2] for r in part], pa.string()), "text": pa.array([r[3] for r in part], pa.string()),
                                 **{c: pa.array(["clash"] * len(part)) for c in ("conv", "dropped", "uid", "kind", "symbols", "whole")}}),
                       d / "conversations.parquet" / f"part-{k}.parquet")
    return str(d), rows


def test_query(spark, chat_dir):
    path, rows = chat_dir
    expected = plain_version(damaged(rows))
    same(queries.QUERIES["op11_conversation_repair"](spark, path), expected)
    assert {len(set(r[7])) for r in expected} >= {1, 2, 3, 4} and "" in {r[7] for r in expected}


@pytest.mark.parametrize(("rows_each", "partitions"), [(1, 1), (3, 5), (64, 40)])
def test_small_blocks_and_many_partitions(spark, chat_dir, monkeypatch, rows_each, partitions):
    path, rows = chat_dir
    monkeypatch.setattr(conversation_repair, "bucket_count", lambda *_: partitions)
    messages = conversation_repair.damage(spark.read.parquet(f"{path}/conversations.parquet"))
    got = conversation_repair.repair(messages, dropped_col="dropped", block_rows=rows_each, with_messages=True)
    same(got, plain_version(damaged(rows)))
    for r in got.select("audit", "messages").collect():
        initials = "".join(m["role"][:1] for m in r["messages"])
        assert re.fullmatch("(s?(ua)+)?", initials)
        assert len(r["messages"]) == len(r["audit"]) - r["audit"].count("D")


def test_undamaged_messages_and_empty_table(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "a."), (1, 2, "assistant", "b."), (2, 0, "assistant", "c."), (3, 0, "system", "only.")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(conversation_repair.repair(chats), plain_version(rows))
    assert conversation_repair.repair(chats.limit(0)).collect() == []


def test_grammar_and_matrices_agree_with_the_recursion(spark):
    rng = random.Random(3)
    strings = ["".join(rng.choice(transfer.SYMBOLS) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["ua" * 500, "u" * 77, "sua" * 9]
    counted = spark.createDataFrame([(s, 1 + k % 3) for k, s in enumerate(strings)], "symbols string, n long")
    grammar = conversation_repair.learn(counted)
    assert len(grammar.rules) > 20
    plain = transfer.Grammar()  # no rules
    assert len(grammar.compress("ua" * 500)) < 40
    names = {"x": "blank", "s": "", "u": "", "a": "", "o": ""}
    for s in strings:
        answers = []
        for g in (grammar, plain):
            matrix, front = g.matrix(s), transfer.Front()
            front.advance(matrix.costs, matrix.ranks)
            cost, state, more = front.finish()
            answers.append((cost, transfer.text(matrix.ropes[state]) + "I" * more))
        assert answers[0] == answers[1]
        if len(s) < 300:
            assert answers[0] == best_repair(tuple(names.get(c, "truncated") for c in s), tuple(c.lower() for c in s))


def test_pairs_do_not_overlap():
    assert transfer.pair_counts("uuuuu") == {"uu": 2} and transfer.pair_counts("uuauu") == {"uu": 2, "ua": 1, "au": 1}


def test_a_changed_input_is_noticed(spark):
    chats = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    rows = conversation_repair._rows(chats, "conv_id", "turn", "role", "text", F.lit(False))
    stream = conversation_repair.ordered(rows, 1).where("kind = 0 OR text <> 'a.'")
    with pytest.raises(Exception, match="changed between two reads"):
        conversation_repair.blocks(stream, 10, 10).collect()
