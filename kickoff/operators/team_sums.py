"""The sums behind the team features, in one stream over sorted rows (W1–W8 and head-to-head).

A task gets the rows of its keys and blocks in stream order as Arrow batches and cuts them, at the edge of a day, into chunks of some
``CHUNK`` rows. Over a chunk every sum is a difference of running sums at two positions of the row's own partition: ``upto``, the first
row of its day (or just after the row, ``inclusive``), and ``n`` rows before that or the start of the key, season or pair.
What a key's next chunk needs of this one is lent to it: the last rows of every stream (marked like the halo of a time block), the
season's sums so far, and the current runs. So a task holds a chunk, not a key, however long its history is.

Ratios and rules are column expressions over these sums (``team_windows``); sums are integers, so they do not depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CHUNK = 1 << 16
NUMBERS = ("gf", "ga", "points", "win", "loss", "clean_sheet", "shots_for", "sot_for")
SEASON = ("n", "win", "pts", "gf", "ga", "cs")
RUNS = ("win_streak", "unbeaten_streak", "loss_streak")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values have equal codes; nulls are equal to each other."""
    held = column.combine_chunks()
    held = held.dictionary_encode() if not isinstance(held, pa.ChunkedArray) else pa.concat_arrays(held.chunks).dictionary_encode()
    return held.indices.fill_null(len(held.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values (0 for null), and which there are."""
    there = column.is_valid().to_numpy()
    return column.fill_null(0).to_numpy().astype(np.int64), there


def _days(column: pa.ChunkedArray) -> np.ndarray:
    """Days since 1970; nulls are a day of their own."""
    return column.cast(pa.int32()).fill_null(np.iinfo(np.int32).min).to_numpy().astype(np.int64)


def _starts(changes: np.ndarray) -> np.ndarray:
    """For every row the position of the last change up to it."""
    return np.maximum.accumulate(np.where(changes, np.arange(len(changes)), 0))


def _changes(*codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes[0]), bool)
    out[:1] = True
    for c in codes:
        out[1:] |= c[1:] != c[:-1]
    return out


class _Frame:
    """Rows of one stream in order: where each one's partition starts and up to where it sees (exclusive)."""

    def __init__(self, key: np.ndarray, day: np.ndarray, inclusive: bool):
        changes = _changes(key)
        self.start = _starts(changes)
        self.upto = np.arange(1, len(key) + 1) if inclusive else _starts(changes | _changes(day))
        self.seen = self.upto - self.start

    def last(self, values: np.ndarray, n: int) -> np.ndarray:
        """Sum over the last ``n`` rows that each row sees."""
        return self.between(values, np.maximum(self.upto - n, self.start))

    def between(self, values: np.ndarray, lo: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.upto] - sums[lo]


def _tail(code: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` of ``rows`` (positions in order) of each code."""
    ordered = rows[np.argsort(code[rows], kind="stable")]
    last = np.flatnonzero(np.append(code[ordered][1:] != code[ordered][:-1], True))
    left = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(ordered))
    return np.sort(ordered[left < n])


def raw_columns(groups: set[str], form_windows: tuple[int, ...], fallback: int) -> list[tuple[str, str]]:
    """Name and type of what the stream adds to its rows."""
    out = [("_n", "long")]
    for n in form_windows if "form" in groups else ():
        out += [(f"_f{n}_{m}", "long") for m in ("points", "win", "gf", "ga")]
    if "exp" in groups:
        out.append(("exp_form", "double"))
    if "shooting" in groups:
        out += [(f"_s_{m}", "long") for m in ("nv", "shots", "sot", "sotn", "goals")]
    if "rest" in groups:
        out.append(("rest_days", "int"))
    if "season" in groups:
        out += [(f"_fb_{m}", "long") for m in SEASON[1:]] + [(f"_sn_{m}", "long") for m in SEASON]
    if "streaks" in groups:
        out += [(f"_run_{s}", "long") for s in RUNS] + [(f"_open_{s}", "boolean") for s in RUNS]
    if "venue" in groups:
        out += [(f"_v_{m}", "long") for m in ("n", "win", "gf", "ga", "clean_sheet")]
    if "h2h" in groups:
        out += [(f"_h_{m}", "long") for m in ("n", "win", "gf")]
    return out


def team_sums(carry: list[str], keys: list[str], halo: str, groups: set[str], form_windows: tuple[int, ...], weights: list[float],
              windows: dict[str, int], depths: dict[str, int], inclusive: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow`` over rows sorted by ``keys`` and stream order. It returns the rows without a mark in
    ``halo``: the columns ``carry`` and ``raw_columns``. ``windows``: rows of a frame by its group; ``depths``: rows that a stream lends."""
    names = [name for name, _ in raw_columns(groups, form_windows, windows["season"])]

    def measured(rows: pa.Table, lent: dict | None) -> tuple[pa.RecordBatch, pa.Table, dict]:
        """The answers of a chunk (which starts with what the one before lent), and what it lends to the next one: rows, and running values
        of the last key. ``lent``: those of the key that this chunk goes on with."""
        key = np.cumsum(_changes(*[_codes(rows.column(c)) for c in keys]))
        day, season = _days(rows.column("match_date")), _days(rows.column("season_start"))
        mark = rows.column(halo)
        real = mark.is_null().to_numpy()
        of = {s: real | (pa.compute.equal(mark, s).fill_null(False).to_numpy()) for s in depths}
        value, there = {}, {}
        for c in NUMBERS:
            value[c], there[c] = _numbers(rows.column(c))
        out: dict[str, np.ndarray | pa.Array] = {}
        running: dict = {}

        at = np.flatnonzero(of["team"])  # ---- team stream
        mine = real[at]
        frame = _Frame(key[at], day[at], inclusive)
        v = {c: x[at] for c, x in value.items()}
        first = key[at] == 1 if lent else np.zeros(len(at), bool)  # rows of the key that went on from the chunk before
        end = _Frame.__new__(_Frame)  # what a row after the last one would see
        end.upto, last_start = np.array([len(at)]), frame.start[-1:] if len(at) else np.zeros(1, int)
        out["_n"] = frame.seen
        for n in form_windows if "form" in groups else ():
            for m in ("points", "win", "gf", "ga"):
                out[f"_f{n}_{m}"] = frame.last(v[m], n)
        if "exp" in groups:
            num, den = np.zeros(len(at)), np.zeros(len(at))
            got = there["points"][at]
            for k in range(len(weights), 0, -1):  # oldest first: same summation order as the oracle
                back = frame.upto - k
                has = (back >= frame.start) & got[np.maximum(back, 0)] if len(at) else np.zeros(0, bool)
                num = num + np.where(has, weights[k - 1] * v["points"][np.maximum(back, 0)], 0.0)
                den = den + np.where(has, weights[k - 1], 0.0)
            with np.errstate(invalid="ignore"):
                out["exp_form"] = np.where(den > 0, num / den, np.nan)
        if "shooting" in groups:
            valid = v["shots_for"] > 0
            for m, x in (("nv", valid), ("shots", np.where(valid, v["shots_for"], 0)), ("sot", np.where(valid, v["sot_for"], 0)),
                         ("sotn", valid & there["sot_for"][at]), ("goals", np.where(valid, v["gf"], 0))):
                out[f"_s_{m}"] = frame.last(x.astype(np.int64), windows["shooting"])
        if "rest" in groups:
            days, before = day[at], np.arange(len(at)) - 1
            none = np.iinfo(np.int32).min
            known = (before >= frame.start) & (days != none) & (days[before] != none) if len(at) else np.zeros(0, bool)
            out["rest_days"] = np.where(known, days - (days[before] if len(at) else 0), none)
        if "season" in groups:
            of_season = {"n": mine.astype(np.int64), **{m: np.where(mine, v[c], 0) for m, c in zip(SEASON[1:], ("win", "points", "gf", "ga", "clean_sheet"))}}
            changed = _changes(key[at], season[at])
            begins = _starts(changed)
            on = first & (season[at] == lent["season"]) if lent else first
            for m, x in of_season.items():
                if m != "n":
                    out[f"_fb_{m}"] = frame.last(v[{"pts": "points", "cs": "clean_sheet"}.get(m, m)], windows["season"])
                out[f"_sn_{m}"] = frame.between(x, begins) + np.where(on, lent[m] if lent else 0, 0)
                if len(at):
                    running[m] = int(end.between(x, begins[-1:])[0]) + (lent[m] if lent and on[-1] else 0)
            running["season"] = season[at][-1] if len(at) else None
        if "streaks" in groups:
            before = frame.between(mine.astype(np.int64), frame.start)
            ranks = np.concatenate([[0], np.cumsum(mine)])
            for s, breaks in zip(RUNS, ((v["win"] == 0) & there["win"][at], (v["loss"] == 1) & there["loss"][at], (v["loss"] == 0) & there["loss"][at])):
                broken = np.concatenate([[-1], np.maximum.accumulate(np.where(breaks & mine, np.arange(len(at)), -1))])

                def run(upto: np.ndarray, start: np.ndarray, seen: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    where = broken[upto]  # the last break that a row sees
                    none = where < start
                    since = seen - np.where(none, 0, ranks[where + 1] - ranks[start])
                    more = none & goes_on
                    return since + np.where(more, lent["run"][s] if lent else 0, 0), none & (~more | (lent["open"][s] if lent else True))

                out[f"_run_{s}"], out[f"_open_{s}"] = run(frame.upto, frame.start, before, first)
                if len(at):
                    since, none = run(end.upto, last_start, end.between(mine.astype(np.int64), last_start), first[-1:])
                    running.setdefault("run", {})[s], running.setdefault("open", {})[s] = int(since[0]), bool(none[0])
        if not (len(at) and key[at[-1]] == key[-1]):  # so far the last key has only rows that were lent to other streams
            running = {}
        place = np.flatnonzero(mine)
        out = {c: x[place] for c, x in out.items()}  # the real rows, in order

        for stream, group, by, prefix, sums in (("venue", "venue", "is_home", "_v_", ("win", "gf", "ga", "clean_sheet")),
                                                ("h2h", "h2h", "opponent", "_h_", ("win", "gf"))):
            if group not in groups:
                continue
            at = np.flatnonzero(of[stream])
            other = _codes(rows.column(by))
            pair = key * (other.max(initial=0) + 1) + other
            at = at[np.argsort(pair[at], kind="stable")]
            frame = _Frame(pair[at], day[at], inclusive)
            back = np.empty(len(rows), np.int64)
            back[at] = np.arange(len(at))
            back = back[np.flatnonzero(real)]
            out[prefix + "n"] = frame.seen[back]
            for m in sums:
                out[prefix + m] = frame.last(value[m][at], windows[group])[back]

        # ---- what the next chunk may need: it goes on with the last key, if at all
        tails, last = [], key == key[-1] if len(key) else np.zeros(0, bool)
        for stream, by in (("team", None), ("venue", "is_home"), ("h2h", "opponent")):
            if stream in depths:
                held = np.flatnonzero(of[stream] & last)
                kept = rows.take(_tail(np.zeros(len(rows), int) if by is None else _codes(rows.column(by)), held, depths[stream]))
                tails.append(kept.set_column(kept.schema.get_field_index(halo), kept.schema.field(halo), pa.array([stream] * len(kept), pa.string())))

        answers = []
        for c in names:
            x = out[c]
            if c == "exp_form":
                answers.append(pa.array(x, pa.float64(), mask=np.isnan(x)))
            elif c == "rest_days":
                answers.append(pa.array(x.astype(np.int32), pa.int32(), mask=x == np.iinfo(np.int32).min))
            else:
                answers.append(pa.array(x, pa.bool_() if c.startswith("_open_") else pa.int64()))
        kept = (rows if real.all() else rows.filter(pa.array(real))).select(carry).combine_chunks()
        columns = [pa.concat_arrays(kept.column(c).chunks) if kept.column(c).num_chunks != 1 else kept.column(c).chunk(0) for c in carry]
        return pa.RecordBatch.from_arrays([*columns, *answers], [*carry, *names]), pa.concat_tables(tails), running

    def last_edge(rows: pa.Table) -> int:
        """Where the last day of the last key begins."""
        edges = np.flatnonzero(_changes(*[_codes(rows.column(c)) for c in keys], _days(rows.column("match_date"))))
        return int(edges[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        tail, running, key = None, None, None

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            nonlocal tail, running, key
            begins = [rows.column(c)[0].as_py() for c in keys]
            on = key == begins
            answers, tail, running = measured(pa.concat_tables([tail, rows]) if on else rows, running if on else None)
            key = [rows.column(c)[-1].as_py() for c in keys]
            return answers

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= CHUNK:
                rows = pa.Table.from_batches(waiting)
                edge = last_edge(rows)
                if edge:
                    yield chunk(rows.slice(0, edge))
                waiting = rows.slice(edge).to_batches()
        if waiting:
            yield chunk(pa.Table.from_batches(waiting))

    return run
