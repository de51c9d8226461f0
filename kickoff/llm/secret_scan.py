"""Secret scans with a trigram inverted index (operator 9).

From each rule's regular expression a Boolean query over trigrams is derived: strings that every match
must hold are cut into trigrams (AND), alternatives are joined by OR. A chunk of texts gets an inverted
index (trigram → texts that hold it, case folded, for the trigrams that some query names); the postings
are intersected and united as the query says, and only the texts that remain are searched with the
expression. A rule without a mandatory trigram searches all texts in full.

The base kinds are the contract's; ``EXTRA`` adds well-known credential formats after them. A span is
``[start, end)`` of the whole match in code points; spans of one kind do not overlap, spans of two kinds may.

Defined cases: a null text is an empty one and has no span. Texts of any length are searched whole.
Repeated rows and ids are scanned independently, null ids stay null, extra columns are ignored by
``scan`` and passed through by ``redact``. Rows are independent: no shuffle, nothing to recover but the
lost chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre_c  # the standard library's own parse tree of a pattern
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0
    ignore_case: bool = False


# The base kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # a run is maximal either way; shorter ones would be dropped
)
EXTRA = (
    # a whole key block up to its END line; without one, the header and the base64 lines that follow it
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\\:,.\s-]*?-----END [A-Z ]*PRIVATE KEY-----"
                        r"|(?:(?:\s|\\n)*[A-Za-z0-9+/=]{16,})*(?:\s*[A-Za-z0-9+/]+={1,2})?)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
MAX_STRINGS = 64  # exact strings a pattern part may expand to before it counts as free text
ALL = True  # the query that every text satisfies


def both(parts: list) -> object:
    rest = [p for p in parts if p is not ALL]
    return ALL if not rest else rest[0] if len(rest) == 1 else ("and", rest)


def either(parts: list) -> object:
    return ALL if any(p is ALL for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def of_strings(strings: set[str]) -> object:
    """Some of the strings occurs: OR over them of the AND of their trigrams."""

    def one(s: str) -> object:
        raw = s.encode()
        return both([("tri", raw[i: i + 3]) for i in range(len(raw) - 2)])

    return either([one(s) for s in sorted(strings)])


def _class(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre_c.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre_c.RANGE and arg[1] - arg[0] < MAX_STRINGS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _parts(tree) -> Iterator[tuple[set[str] | None, object]]:
    """(exact strings or None if free, query known to hold) of each element of a sequence."""
    for op, arg in tree:
        if op is sre_c.LITERAL:
            yield {chr(arg).lower()}, ALL
        elif op is sre_c.IN:
            yield _class(arg), ALL
        elif op is sre_c.SUBPATTERN:
            yield from _whole(arg[3])
        elif op is sre_c.BRANCH:
            options = [list(_whole(x)) for x in arg[1]]
            if all(len(o) == 1 and o[0][0] is not None for o in options):
                yield set().union(*(o[0][0] for o in options)), ALL
            else:
                yield None, either([_join(o) for o in options])
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT):
            least, most, inner = arg
            own = list(_whole(inner))
            exact = own[0][0] if len(own) == 1 else None
            if exact is not None and (least, most) == (0, 1):
                yield exact | {""}, ALL
            elif least:
                yield from own * min(least, 4)
                if least > 4 or most != least:
                    yield None, ALL
            else:
                yield None, ALL
        elif op is not sre_c.AT:
            yield None, ALL


def _whole(tree) -> Iterator[tuple[set[str] | None, object]]:
    """A sequence with neighbouring exact parts multiplied out."""
    run: set[str] | None = None
    for exact, query in _parts(tree):
        if exact is not None and query is ALL:
            grown = {a + b for a in run for b in exact} if run is not None else exact
            if len(grown) <= MAX_STRINGS:
                run = grown
                continue
        if run is not None:
            yield run, ALL
        run = exact if query is ALL else None
        if run is None:
            yield None, query
    if run is not None:
        yield run, ALL


def _join(parts: list) -> object:
    return both([q if exact is None else both([q, of_strings(exact)]) for exact, q in parts])


def trigram_query(rule: Rule) -> object:
    """The Boolean trigram query that every match of the rule satisfies (on case-folded bytes)."""
    return _join(list(_whole(sre.parse(rule.pattern))))


def trigrams(query: object) -> set[bytes]:
    if query is ALL:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(q) for q in query[1]))


def _fold(units: np.ndarray) -> np.ndarray:
    return np.where((units >= 65) & (units <= 90), units + 32, units).astype(np.int32)


def _code(tri: bytes) -> int:
    return tri[0] << 16 | tri[1] << 8 | tri[2]


class Index:
    """Inverted index of a chunk: postings (texts, as a mask) of the trigrams that the queries name."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray) -> None:
        self.n = len(texts)
        offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        u = _fold(np.frombuffer(b"\0".join(texts) + b"\0" if texts else b"", np.uint8))
        code = (u[:-2] << 16) | (u[1:-1] << 8) | u[2:]
        at = np.flatnonzero(wanted[code])
        text = np.searchsorted(offsets, at, side="right") - 1
        pairs = np.unique(code[at].astype(np.int64) * self.n + text)
        self.code, self.text = pairs // max(self.n, 1), pairs % max(self.n, 1)

    def run(self, query: object) -> np.ndarray:
        if query is ALL:
            return np.ones(self.n, bool)
        if query[0] == "tri":
            a, b = np.searchsorted(self.code, [_code(query[1]), _code(query[1]) + 1])
            hit = np.zeros(self.n, bool)
            hit[self.text[a:b]] = True
            return hit
        found = [self.run(q) for q in query[1]]
        return np.logical_and.reduce(found) if query[0] == "and" else np.logical_or.reduce(found)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.compiled = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for query in self.queries:
            for tri in trigrams(query):
                self.wanted[_code(tri)] = True

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, rule number, end) of all accepted matches, by start and rule."""
        texts = [t or "" for t in texts]
        index = Index([t.encode() for t in texts], self.wanted)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.compiled)):
            for i in np.flatnonzero(index.run(query)).tolist():
                out[i] += [(m.start(), number, m.end()) for m in pattern.finditer(texts[i])
                           if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for found in out:
            found.sort()
        return out


def _written(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """Per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` (all, as text)."""
    rules = BASE + tuple(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part in chunks(batches, "text"):
            found = scanner.spans(part.column("text").to_pylist())
            base = [[s for s in f if s[1] < len(BASE)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"),
                 *(pa.array([sum(s[1] == k for s in f) for f in base], pa.int64()) for k in range(len(BASE))),
                 pa.array([hashlib.sha256(_written(f, rules).encode()).hexdigest() for f in base], pa.string()),
                 pa.array([_written(f, rules) for f in found], pa.string())],
                names=[id_col, *(f"n_{r.kind}" for r in BASE), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{r.kind} bigint" for r in BASE)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None,
           extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """``docs`` with the union of all spans replaced by ``[secret]``; ``length_col``, if given, is set to
    the new number of characters of changed texts. Rows without a secret are returned as they are."""
    rules = BASE + tuple(extra)

    def clean(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
        if not found:
            return text
        out, end = [], 0
        for a, _, b in found:
            if a >= end:
                out += [text[end:a], "[secret]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part in chunks(batches, text_col):
            texts = part.column(text_col).to_pylist()
            found = scanner.spans(texts)
            new = [clean(t, f) for t, f in zip(texts, found)]
            columns = dict(zip(part.schema.names, part.columns))
            columns[text_col] = pa.array(new, part.schema.field(text_col).type)
            if length_col:
                old = columns[length_col].to_pylist()
                columns[length_col] = pa.array([len(t) if f else n for t, f, n in zip(new, found, old)],
                                               part.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)
