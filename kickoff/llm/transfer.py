"""Min-plus transfer matrices of conversation rows, and a Re-Pair grammar over their symbols.

A repaired conversation's role initials form ``(s?(ua)+)?``. Reading it takes four states: nothing read, ``s``,
``u``, ``a``. A row (or a run of rows) turns each state into each other state at a least cost, by edits
written as letters: ``I`` insert, then for the row itself ``K`` keep, ``R`` rerole or ``D`` delete. Inserts
are counted to the row that follows, so a word of edits ends with a row's letter, two words over the same
rows have the same number of row letters, and none is a proper prefix of another. So their order survives
whatever is appended, and a matrix needs only the *ranks* of its sixteen words: composing two matrices compares
(cost, rank on the left, rank on the right). Words are ropes, written out when asked for.
"""

from __future__ import annotations

from collections import Counter

# Fixed values of the contract: costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEEDS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}  # role of an insert or rerole in a state
ACCEPTING = (START, ASSISTANT)

MUST_DELETE = "x"  # other symbols: s, u, a, o (any other initial), in capitals if the text is truncated
SYMBOLS = "xsuaoSUAO"
NEVER = 1 << 60
EAGER = 64  # words of rules over so few rows are written out at once

Rope = str | tuple | None


def step(state: int, initial: str) -> int | None:
    return NEXT.get((state, initial))


def filled(state: int) -> int:
    """The state after a row of the role that the state needs."""
    return NEXT[state, NEEDS[state][0]]


def inserts() -> dict[tuple[int, int], int]:
    """Least number of inserts that lead from one state to another."""
    out = {}
    for state in range(4):
        at, n = state, 0
        while (state, at) not in out:
            out[state, at] = n
            at, n = filled(at), n + 1
    return out


INSERTS = inserts()


class Transfer:
    """Costs, ranks of the words and the words (ropes) of the sixteen pairs of states, row by row."""

    __slots__ = ("costs", "ranks", "ropes", "rows")

    def __init__(self, costs: list[int], ranks: list[int], ropes: list[Rope], rows: int) -> None:
        self.costs, self.ranks, self.ropes, self.rows = costs, ranks, ropes, rows

    @classmethod
    def of_symbol(cls, symbol: str) -> Transfer:
        late = TRUNCATED if symbol.isupper() else 0
        best: list[tuple[int, str]] = [(NEVER, "")] * 16
        for (a, b), n in INSERTS.items():
            edits = [(DELETE, "D", b)]
            if symbol != MUST_DELETE:
                edits.append((REROLE + late, "R", filled(b)))
                kept = step(b, symbol.lower())
                if kept is not None:
                    edits.append((late, "K", kept))
            for cost, letter, to in edits:
                best[4 * a + to] = min(best[4 * a + to], (INSERT * n + cost, "I" * n + letter))
        order = {w: k for k, w in enumerate(sorted({w for c, w in best if c < NEVER}))}
        return cls([c for c, _ in best], [order.get(w, -1) for _, w in best], [w if c < NEVER else None for c, w in best], 1)

    @classmethod
    def identity(cls) -> Transfer:
        """Of no rows at all."""
        same = [k % 5 == 0 for k in range(16)]
        return cls([0 if s else NEVER for s in same], [0 if s else -1 for s in same], ["" if s else None for s in same], 0)

    def then(self, other: Transfer) -> Transfer:
        """The matrix of these rows followed by those of ``other``."""
        if not self.rows or not other.rows:
            return other if not self.rows else self
        costs, keys, ropes = [NEVER] * 16, [(-1, -1)] * 16, [None] * 16
        for a in (0, 4, 8, 12):
            for b in range(4):
                best = (NEVER, 0, 0)
                via = -1
                for m in range(4):
                    left, right = self.costs[a + m], other.costs[4 * m + b]
                    if left < NEVER and right < NEVER:
                        key = (left + right, self.ranks[a + m], other.ranks[4 * m + b])
                        if key < best:
                            best, via = key, m
                if via >= 0:
                    costs[a + b], keys[a + b] = best[0], best[1:]
                    ropes[a + b] = (self.ropes[a + via], other.ropes[4 * via + b])
        order = {k: n for n, k in enumerate(sorted({k for k in keys if k[0] >= 0}))}
        rows = self.rows + other.rows
        if rows <= EAGER:
            ropes = [None if r is None else text(r) for r in ropes]
        return Transfer(costs, [order.get(k, -1) for k in keys], ropes, rows)


def text(rope: Rope) -> str:
    """The word of a rope."""
    out, open_ropes = [], [rope]
    while open_ropes:
        r = open_ropes.pop()
        if isinstance(r, tuple):
            open_ropes += (r[1], r[0])
        else:
            out.append(r)
    return "".join(out)


class Front:
    """The best word into each state from the start of a conversation, matrix after matrix."""

    __slots__ = ("costs", "ranks")

    def __init__(self) -> None:
        self.costs, self.ranks = [0, NEVER, NEVER, NEVER], [0, -1, -1, -1]

    def advance(self, costs: list[int], ranks: list[int]) -> list[int]:
        """Take in a matrix; returns the state that each new state was best reached from (-1: not reached)."""
        new, keys, via = [NEVER] * 4, [(-1, -1)] * 4, [-1] * 4
        for b in range(4):
            best = (NEVER, 0, 0)
            for m in range(4):
                if self.costs[m] < NEVER and costs[4 * m + b] < NEVER:
                    key = (self.costs[m] + costs[4 * m + b], self.ranks[m], ranks[4 * m + b])
                    if key < best:
                        best, via[b] = key, m
            new[b], keys[b] = best[0], best[1:]
        order = {k: n for n, k in enumerate(sorted({k for k, v in zip(keys, via) if v >= 0}))}
        self.costs, self.ranks = new, [order[k] if v >= 0 else -1 for k, v in zip(keys, via)]
        return via

    def finish(self) -> tuple[int, int, int]:
        """(cost, last state, inserts after the last row) of the best complete repair."""
        ends = []
        for state in range(4):
            if self.costs[state] < NEVER:
                for end in ACCEPTING:
                    if (state, end) in INSERTS:
                        n = INSERTS[state, end]
                        ends.append((self.costs[state] + INSERT * n, self.ranks[state], n, state))
        cost, _, n, state = min(ends)
        return cost, state, n


def walk(word: str, roles: list[str], texts: list[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """Apply edits to rows: the repaired (role, text) rows and the state reached."""
    out, at = [], 0
    for letter in word:
        if letter == "D":
            at += 1
        elif letter == "K":
            out.append((roles[at], texts[at]))
            state, at = step(state, roles[at][:1]), at + 1
        else:
            out.append((NEEDS[state], "" if letter == "I" else texts[at]))
            state, at = filled(state), at + (letter == "R")
    return out, state


class Grammar:
    """Rules ``symbol -> two symbols`` in the order they were found, each with its transfer matrix."""

    FIRST = 0x4E00  # code points of rule symbols

    def __init__(self) -> None:
        self.rules: list[tuple[str, str]] = []  # (pair, symbol)
        self.matrices = {s: Transfer.of_symbol(s) for s in SYMBOLS}

    def add(self, pair: str) -> None:
        symbol = chr(self.FIRST + len(self.rules))
        self.rules.append((pair, symbol))
        self.matrices[symbol] = self.matrices[pair[0]].then(self.matrices[pair[1]])

    def compress(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            symbols = symbols.replace(pair, symbol)  # leftmost first, no overlaps
        return symbols

    def matrix(self, symbols: str) -> Transfer:
        """The matrix of a whole run of rows: halves of its compressed form, put together."""
        parts = [self.matrices[s] for s in self.compress(symbols)] or [Transfer.identity()]
        while len(parts) > 1:
            pairs = [parts[k].then(parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(pairs) * 2:]
        return parts[0]


def pair_counts(symbols: str) -> Counter:
    """How often each pair of neighbours can be replaced (in a run of one symbol, pairs do not overlap)."""
    counts: Counter = Counter()
    counted = False
    for a, b in zip(symbols, symbols[1:]):
        counted = not (a == b and counted)
        if counted:
            counts[a + b] += 1
        counted = counted and a == b
    return counts
