"""Histogram gradient boosting for class labels, several ensembles in one pass.

Features are cut into at most ``BINS`` bins by quantiles once; rows travel as blocks of byte matrices (one byte a value).
A tree level is one pass: every task adds the counts, gradients and second derivatives of its blocks by (node, feature, bin), for the
trees of all classes of all ensembles (specs) that train together — models, folds or trials cost one pass, not one each.
Features are counted in groups: a count of the combinations of two or more features' bins holds the counts of each (``groups_of``).
The partial histograms are summed (by a shuffle on the ensemble and class when there are many), the driver reads one histogram of
bounded size and picks the splits. Rows never leave their task. The scores of the rows are cached with the blocks, brought up to date once
a round by the first pass that reads them, and written every ``KEEP`` rounds to the shared folder, so a lost executor repeats little.
A table of at most ``ONE_TASK`` rows (counted; a few MB of bytes) needs no exchange between tasks: there every ensemble is a
task of its own that runs the same steps on the same blocks, instead of hundreds of jobs of a tenth of a second. So it is up to
``LARGER`` times as many rows (some 200 MB a task), where a core is still done with its ensemble before passes over all cores are.

Two kinds of trees (``second_order``):

* regularised second-order: g = p - y, h = 2p(1-p); a leaf weighs ``-soft(G, alpha) / (H + lambda)``, a split gains
  ``soft(G)^2 / (H + lambda)`` of its sides over the parent's and needs ``min_child_weight`` of H on both;
* first-order: residuals y - p, a split maximises ``nl * nr * (mean difference)^2`` with ``min_leaf`` rows on both
  sides, a leaf is ``(K-1)/K * sum(r) / sum(|r| (1-|r|))``; scores start from the log class shares.

Rows are drawn per round by a hash of their number, features per tree by a seeded generator, so reruns agree. A null or NaN value is in
the lowest bin. Ties between splits go to the first feature, then the lowest bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BINS = 64
BLOCK_ROWS = 1 << 17
KEEP = 10  # rounds between two writes of the scores
DIRECT = 32  # partial histograms of an ensemble that the driver may add up itself; more are summed by a shuffle first
BLOCKS_EACH = 8  # most blocks per partition
CELLS = 1 << 12  # most combinations of bins that a group of features may have
ONE_TASK = 1 << 17  # rows of a small table
LARGER = 8  # times as many rows may one task hold


@dataclass(frozen=True)
class Spec:
    """One ensemble. Trains on the rows with ``lo <= idx < hi`` (None: no bound)."""

    name: str
    rounds: int = 200
    depth: int = 4
    rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 1.0
    second_order: bool = False
    min_leaf: int = 1
    min_child_weight: float = 0.0
    alpha: float = 0.0
    lam: float = 0.0
    hi: int | None = None
    seed: int = 42


@dataclass
class Tree:
    """Complete binary tree in level order; ``feature`` -1 marks a leaf."""

    feature: np.ndarray
    split: np.ndarray  # the left side holds bins up to here
    value: np.ndarray
    gain: np.ndarray
    smaller: np.ndarray | None = None  # while it grows: the side of a split that is counted (0: left), as a rule the one with fewer rows

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n), np.zeros(n, np.int8))

    def _reached(self, bins: np.ndarray, depth: int, held: np.ndarray) -> np.ndarray:
        """What ``held`` has for the node that each row (column of ``bins``) reaches within ``depth`` steps. Node numbers of whole columns are
        chosen from the leaves up by bit masks, a byte or two a row, and looked up once."""
        kind = np.uint8 if len(self.feature) <= 256 else np.uint16

        def at(node: int, left: int) -> np.ndarray:
            f = self.feature[node]
            if f < 0 or not left:
                return kind(node)
            above, below = at(2 * node + 2, left - 1), at(2 * node + 1, left - 1)
            mask = np.negative((bins[f] > int(self.split[node])).astype(kind))  # all bits of the rows that go right
            return below ^ ((below ^ above) & mask)

        return np.broadcast_to(held[at(0, depth)], bins.shape[1])

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row (column of ``bins``) reaches."""
        return self._reached(bins, depth, np.arange(len(self.feature)))

    def values(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The value of the node that each row reaches."""
        return self._reached(bins, depth, self.value)


@dataclass
class Boosted:
    """A trained ensemble: class shares, bin edges and ``trees[round][class]``."""

    spec: Spec
    columns: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.tile(self.base[:, None], (1, bins.shape[1]))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[k] += tree.values(bins, self.spec.depth)
        return out

    def importances(self) -> np.ndarray:
        """Share of the total gain by feature."""
        total = np.zeros(len(self.columns))
        for tree in (t for trees in self.trees for t in trees):
            used = tree.feature >= 0
            np.add.at(total, tree.feature[used], tree.gain[used])
        return total / total.sum() if total.sum() else total

    def probabilities(self) -> Column:
        """Array column of the class probabilities of the feature columns."""
        model = self

        @F.pandas_udf("array<double>")
        def score(rows):
            import pandas as pd

            values = np.array(rows.tolist(), float).reshape(len(rows), len(model.columns)).T
            return pd.Series(list(softmax(model.scores(to_bins(values, model.edges))).T))

        return score(F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns]))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = scores - scores.max(axis=0)
    np.exp(e, out=e)
    e /= e.sum(axis=0)
    return e


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value (features by rows): the number of edges below it."""
    out = np.zeros(values.shape, np.uint8)
    for f, edge in enumerate(edges):
        column = np.where(np.isnan(values[f]), -np.inf, values[f])
        out[f] = np.searchsorted(edge, column, side="left")
    return out


def bins_of(edges: list[np.ndarray]) -> tuple[int, ...]:
    """The number of bins of each feature."""
    return tuple(len(e) + 1 for e in edges)


def bin_edges(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Inner bin borders of every column: approximate quantiles, distinct."""
    shares = [k / bins for k in range(1, bins)]
    sketch = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")), shares, 2000)
                        .alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [np.unique(np.array(sketch[f"c{k}"] or [], float)) for k in range(len(columns))]


def drawn(idx: np.ndarray, spec: Spec, turn: int) -> np.ndarray:
    """Rows of a round, by a hash of their number."""
    if spec.subsample >= 1:
        return np.ones(len(idx), bool)
    x = idx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((spec.seed << 32) + turn + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(spec.subsample * (1 << 63)) * 2)


def features_of(spec: Spec, turn: int, k: int, n: int) -> np.ndarray:
    """Features that a tree may use."""
    if spec.colsample >= 1:
        return np.ones(n, bool)
    chosen = np.random.default_rng([spec.seed, turn, k]).choice(n, max(1, int(spec.colsample * n)), replace=False)
    return np.isin(np.arange(n), chosen)


def derivatives(scores: np.ndarray, labels: np.ndarray, spec: Spec) -> np.ndarray:
    """First and second derivatives (or residuals and their weights) as the parts of a complex number, which are summed at once."""
    p = softmax(scores)
    y = np.arange(len(p), dtype=labels.dtype)[:, None] == labels
    out = np.empty(p.shape, complex)
    if spec.second_order:
        np.subtract(p, y, out=out.real)
        np.multiply(2 * p, 1 - p, out=out.imag)
    else:
        r = np.subtract(y, p, out=p)
        out.real = r
        np.abs(r, out=r)
        np.multiply(r, 1 - r, out=out.imag)
    return out


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def leaf(n: np.ndarray, g: np.ndarray, h: np.ndarray, spec: Spec, classes: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        value = -_soft(g, spec.alpha) / (h + spec.lam) if spec.second_order else (classes - 1) / classes * g / h
    return spec.rate * np.where(np.isfinite(value) & (h > 1e-150), value, 0.0)


def best_splits(hist: np.ndarray, spec: Spec, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, left sums, all sums) of each node of ``hist`` (sums, nodes, features, bins)."""
    upto = hist.cumsum(axis=3)
    left, total = upto[..., :-1], upto[:, :, 0, -1]
    all_n, all_g, all_h = total[:, :, None, None]
    (n, g, h), right_n = left, all_n - left[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        if spec.second_order:
            def score(g, h):
                return _soft(g, spec.alpha) ** 2 / (h + spec.lam)
            right_h = all_h - h
            gain = score(g, h) + score(all_g - g, right_h) - score(all_g, all_h)
            fits = (h >= spec.min_child_weight) & (right_h >= spec.min_child_weight)
        else:
            apart = g / n - (all_g - g) / right_n
            gain = n * right_n / all_n * apart ** 2
            fits = np.ones(gain.shape, bool)
    fits &= (n >= max(spec.min_leaf, 1)) & (right_n >= max(spec.min_leaf, 1)) & allowed[None, :, None]
    gain = np.where(fits & np.isfinite(gain), gain, -np.inf).reshape(hist.shape[1], -1)
    if not gain.shape[1]:
        return np.full(len(gain), -np.inf), np.zeros(len(gain), int), np.zeros(len(gain), int), total.T, total.T
    at = gain.argmax(axis=1)
    node = np.arange(len(gain))
    f, b = at // left.shape[3], at % left.shape[3]
    return gain[node, at], f, b, left[:, node, f, b].T, total.T


def used(idx: np.ndarray, spec: Spec, turn: int) -> np.ndarray:
    """Rows that a round's trees are grown on."""
    use = drawn(idx, spec, turn)
    return np.flatnonzero(use if spec.hi is None else use & (idx < spec.hi))


def groups_of(sizes: tuple[int, ...], most: int) -> list[list[int]]:
    """Features to count together: the first of a group changes slowest, and its combinations of bins are at most ``most``
    (a feature with more is alone). Large ones look for a place first."""
    groups: list[list[int]] = []
    cells: list[int] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        at = next((i for i, n in enumerate(cells) if n * sizes[f] <= most), None)
        if at is None:
            groups.append([f])
            cells.append(sizes[f])
        else:
            groups[at].append(f)
            cells[at] *= sizes[f]
    return groups


class Scratch:
    """Arrays that a task uses for one block after another: fresh memory for each would take longer than the counting."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def empty(self, name: str, n: int, kind: type) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, kind)
        return self.held[name][:n]

    def taken(self, name: str, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return values.take(at, out=self.empty(f"{name} {values.dtype}", len(at), values.dtype), mode="clip")  # other modes need fresh memory


def coded(bins: np.ndarray, sizes: tuple[int, ...], most: int) -> list[tuple[list[int], np.ndarray]]:
    """Groups of features with the combination of their bins (at most ``most``) of each row (column of ``bins``)."""
    out = []
    for group in groups_of(sizes, most):
        if len(group) == 1:
            out.append((group, bins[group[0]]))
            continue
        code = bins[group[0]].astype(np.uint16)
        for f in group[1:]:
            code *= np.uint16(sizes[f])
            code += bins[f]
        out.append((group, code))
    return out


def apart(cells: np.ndarray, group: list[int], sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """The histogram of each feature of a group from those of their combinations (nodes, cells)."""
    for f in group[:0:-1]:
        cells = cells.reshape(len(cells), -1, sizes[f])
        yield f, cells.sum(axis=1)
        cells = cells @ np.ones(sizes[f], cells.dtype)
    yield group[0], cells


def counted(groups: list[tuple[list[int], np.ndarray]], at: np.ndarray | None, node: np.ndarray | None, weights: list[np.ndarray],
            nodes: int, sizes: tuple[int, ...], scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The number (nodes, features, bins) and the sums of each of the complex ``weights`` over the rows ``at`` (None: all), which are
    in ``node``. Features are counted by group."""
    number, sums = np.zeros((nodes, len(sizes), BINS)), np.zeros((len(weights), nodes, len(sizes), BINS), complex)
    for group, code in groups:
        width = int(np.prod([sizes[f] for f in group]))
        code = code if at is None else scratch.taken("code", code, at)
        place = scratch.empty("place", len(code), np.intp)
        if node is None:
            place[:] = code
        else:
            np.multiply(node, width, out=place)
            place += code
        for out, weight in ((number, 1.0), *zip(sums, weights)):
            cells = scratch.empty(out.dtype.name, nodes * width, out.dtype)
            cells.fill(0)
            np.add.at(cells, place, weight)
            for f, part in apart(cells.reshape(nodes, width), group, sizes):
                out[:, f, :sizes[f]] = part
    return number, sums


def histograms(bins: np.ndarray, groups: list[tuple[list[int], np.ndarray]], gh: np.ndarray, level: int, trees: list[Tree],
               sizes: tuple[int, ...], scratch: Scratch) -> np.ndarray:
    """(classes, [count, g, h], smaller nodes of the level, features, bins) of the used rows of one block; below the root the other nodes
    are what is left of their parents (``both_sides``). ``groups``: the rows' codes (``coded``), ``sizes``: the bins of each feature."""
    first = (1 << level) - 1
    if level == 0:
        number, sums = counted(groups, None, None, list(gh), 1, sizes, scratch)
        return np.stack([np.stack([number, s.real, s.imag]) for s in sums])
    out = []
    for k, tree in enumerate(trees):
        node = tree.nodes(bins, level).astype(np.intp) - first
        at = np.flatnonzero((node >= 0) & (node % 2 == tree.smaller[first // 2: first][node >> 1]))  # rows that stopped in a leaf above are done
        number, sums = counted(groups, at, node[at] >> 1, [scratch.taken("weight", gh[k], at)], 1 << (level - 1), sizes, scratch)
        out.append(np.stack([number, sums[0].real, sums[0].imag]))
    return np.stack(out)


def both_sides(counted: np.ndarray, parents: np.ndarray | None, trees: list[Tree], level: int) -> np.ndarray:
    """Histograms of all nodes of a level from those of the smaller ones and of the level above."""
    if parents is None:
        return counted
    nodes = counted.shape[2]
    out = np.zeros((*counted.shape[:2], 2 * nodes, *counted.shape[3:]))
    above = (1 << level - 1) - 1
    for k, tree in enumerate(trees):
        for i in np.flatnonzero(tree.feature[above: above + nodes] >= 0):
            side = int(tree.smaller[above + i])
            out[k, :, 2 * i + side] = counted[k, :, i]
            out[k, :, 2 * i + 1 - side] = parents[k, :, i] - counted[k, :, i]
    return out


def to_blocks(rows: DataFrame, columns: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(n, idx, label, bins): blocks of rows as byte matrices. ``rows`` has ``idx``, ``label`` and the features."""
    most = BLOCK_ROWS

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        idx, label, bins = (np.concatenate(p, axis=-1) for p in zip(*parts))
        return pa.RecordBatch.from_pydict({"n": pa.array([len(idx)], pa.int64()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in (
            ("idx", idx), ("label", label), ("bins", bins))}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for whole in batches:
            begin = 0
            while begin < whole.num_rows:
                batch = whole.slice(begin, most - sum(len(p[0]) for p in parts))
                values = np.array([batch.column(f"c{k}").to_numpy(zero_copy_only=False) for k in range(len(columns))], float)
                parts.append((batch.column("idx").to_numpy().astype(np.int64), batch.column("label").to_numpy().astype(np.uint8),
                              to_bins(values.reshape(len(columns), batch.num_rows), edges)))
                begin += batch.num_rows
                if sum(len(p[0]) for p in parts) == most:
                    yield block(parts)
                    parts = []
        if parts:
            yield block(parts)

    plain = rows.select("idx", "label", *[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    return plain.mapInArrow(run, "n bigint, idx binary, label binary, bins binary")


def _read(row: tuple, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, idx, label, bins = row[:4]
    return np.frombuffer(bins, np.uint8).reshape(features, n), np.frombuffer(label, np.uint8), np.frombuffer(idx, np.int64)


def boost(rows: DataFrame, columns: list[str], specs: list[Spec], classes: int = 3, edge_rows: DataFrame | None = None) -> list[Boosted]:
    """Train all ``specs`` together on ``rows`` (``idx``, ``label`` 0..classes-1, features). ``edge_rows``: rows that
    the bin edges may be taken from (default: all)."""
    edges = bin_edges(edge_rows if edge_rows is not None else rows, columns)
    shares = rows.groupBy("label").agg(*[F.count_if(F.col("idx") < s.hi if s.hi is not None else F.lit(True)).alias(f"s{j}")
                                         for j, s in enumerate(specs)]).collect()
    models = []
    for j, spec in enumerate(specs):
        count = np.zeros(classes)
        for r in shares:
            count[int(r["label"])] = r[f"s{j}"]
        share = np.maximum(count / max(count.sum(), 1), 1e-12)
        models.append(Boosted(spec, columns, edges, np.zeros(classes) if spec.second_order else np.log(share)))

    n = rows.count()
    if n <= ONE_TASK * LARGER:
        return _in_tasks(rows, columns, models, classes, n <= ONE_TASK)
    # a task for every core (a pass is computing, not reading), more when a task would hold too many blocks
    parts = min(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (BLOCK_ROWS * BLOCKS_EACH))), max(1, -(-n // 256)))
    bins = to_blocks(rows.repartition(parts, "idx").sortWithinPartitions("idx"), columns, edges)
    base = np.array([m.base for m in models])

    ensure_checkpoint_dir(rows.sparkSession)
    # hundreds of short jobs read these blocks: as an RDD they need no planning and no conversion for each
    width = len(columns)
    blocks = bins.rdd.map(lambda r: (r["n"], bytes(r["idx"]), bytes(r["label"]), bytes(r["bins"]), np.repeat(
        base[:, :, None], r["n"], axis=2).tobytes())).persist(StorageLevel.MEMORY_AND_DISK)

    for turn in range(max((s.rounds for s in specs), default=0)):
        live = [j for j, s in enumerate(specs) if turn < s.rounds]
        old = None
        if turn:
            old, blocks = blocks, _advanced(blocks, models, turn - 1, width, classes).persist(StorageLevel.MEMORY_AND_DISK)
            if turn % KEEP == 0:
                blocks.checkpoint()
        for j in live:
            models[j].trees.append([Tree.empty(specs[j].depth) for _ in range(classes)])
        above: dict[int, np.ndarray] = {}
        for level in range(max(specs[j].depth for j in live)):
            growing = [j for j in live if level < specs[j].depth]
            counts = _pass(blocks, models, growing, turn, level, width, classes, parts)
            if old is not None:
                old.unpersist()  # the pass has filled the cache of its successor
                old = None
            for j in growing:
                above[j] = both_sides(counts[j], above.get(j), models[j].trees[turn], level)
                _grow(models[j], above[j], turn, level, classes)
    blocks.unpersist()
    return models


def _in_tasks(rows: DataFrame, columns: list[str], models: list[Boosted], classes: int, small: bool) -> list[Boosted]:
    """The blocks go to one task per ensemble, the one with most to do first, which returns the trees as arrays. ``small``: sums are added in
    the order of the rows and by feature (small tables have many splits of equal gain: the order of additions decides between these)."""
    if not models:
        return []
    width = len(columns)
    blocks = to_blocks(rows.coalesce(1) if small else rows, columns, models[0].edges)
    order = sorted(range(len(models)), key=lambda j: -models[j].spec.rounds * models[j].spec.depth * (models[j].spec.hi or 1 << 62))
    each = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1)))).repartitionById(len(models), F.col("slot"))
    fields = {"feature": np.int16, "split": np.int16, "value": np.float64, "gain": np.float64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, j = [], None
        for batch in batches:
            for r in batch.to_pylist():
                j = order[r["slot"]]
                own, labels, idx = _read((r["n"], r["idx"], r["label"], r["bins"]), width)
                use = slice(None) if models[j].spec.hi is None else idx < models[j].spec.hi
                parts.append((own[:, use], labels[use], idx[use]))
        if j is None:
            return
        model, sizes, scratch = models[j], bins_of(models[j].edges), Scratch()
        bins, labels, idx = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
        parts.clear()
        if not small:  # blocks come in any order
            at = np.argsort(idx, kind="stable")
            bins, labels, idx = bins.take(at, axis=1), labels[at], idx[at]
        scores = np.repeat(model.base[:, None], bins.shape[1], axis=1)
        for turn in range(model.spec.rounds):
            model.trees.append([Tree.empty(model.spec.depth) for _ in range(classes)])
            above, rows, most, groups = None, used(idx, model.spec, turn), None, []
            drawn_bins, gh = bins.take(rows, axis=1), derivatives(scores.take(rows, axis=1), labels[rows], model.spec)
            for level in range(model.spec.depth):
                cells = 1 if small else max(BINS, min(CELLS, len(rows) >> 2 * level))
                if cells != most:
                    most, groups = cells, coded(drawn_bins, sizes, cells)
                counts = histograms(drawn_bins, groups, gh, level, model.trees[turn], sizes, scratch)
                above = both_sides(counts, above, model.trees[turn], level)
                _grow(model, above, turn, level, classes, pick=not small)
            scores = _advance(scores, bins, model.trees[turn:], model.spec.depth)
        flat = {f: np.array([[getattr(t, f) for t in trees] for trees in model.trees], kind).tobytes() for f, kind in fields.items()}
        yield pa.RecordBatch.from_pydict({"j": pa.array([j], pa.int32()), **{f: pa.array([v], pa.binary()) for f, v in flat.items()}})

    ddl = "j int, " + ", ".join(f"{f} binary" for f in fields)
    for r in each.mapInArrow(run, ddl).toArrow().to_pylist():
        model = models[r["j"]]
        shape = (model.spec.rounds, classes, (2 << model.spec.depth) - 1)
        arrays = {f: np.frombuffer(r[f], kind).reshape(shape) for f, kind in fields.items()}
        model.trees = [[Tree(*(arrays[f][t, k] for f in fields)) for k in range(classes)] for t in range(model.spec.rounds)]
    return models


def _grow(model: Boosted, hist: np.ndarray, turn: int, level: int, classes: int, pick: bool = True) -> None:
    """Split the nodes of a level; children get their values at once. ``pick``: the smaller child is counted next, else the left one."""
    spec, first = model.spec, (1 << level) - 1
    for k, tree in enumerate(model.trees[turn]):
        gain, f, b, left, total = best_splits(hist[k], spec, features_of(spec, turn, k, len(model.columns)))
        if level == 0:
            tree.value[0] = leaf(*total[0], spec, classes)
        for i in np.flatnonzero(gain > 1e-12):
            node = first + int(i)
            tree.feature[node], tree.split[node], tree.gain[node] = f[i], b[i], gain[i]
            tree.value[2 * node + 1] = leaf(*left[i], spec, classes)
            tree.value[2 * node + 2] = leaf(*(total[i] - left[i]), spec, classes)
            tree.smaller[node] = pick and 2 * left[i][0] > total[i][0]


def _advance(scores: np.ndarray, bins: np.ndarray, recent: list[list[Tree]], depth: int) -> np.ndarray:
    scores = scores.copy()
    for trees in recent:
        for k, tree in enumerate(trees):
            scores[k] += tree.values(bins, depth)
    return scores


def _pass(blocks: RDD, models: list[Boosted], growing: list[int], turn: int, level: int, width: int, classes: int,
          parts: int) -> dict[int, np.ndarray]:
    """The summed histograms of one tree level of all growing ensembles."""
    work = [(j, models[j].spec, models[j].trees[turn]) for j in growing]
    count, sizes = len(models), bins_of(models[0].edges)
    nodes = max(1, (1 << level) // 2)
    held = np.flatnonzero(np.arange(BINS) < np.array(sizes)[:, None])  # only bins that exist travel

    def run(rows: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        scratch = Scratch()
        for row in rows:
            bins, labels, idx = _read(row, width)
            scores = np.frombuffer(row[4]).reshape(count, classes, row[0])
            draws: dict[tuple, tuple] = {}
            for j, spec, trees in work:
                if (spec.seed, spec.subsample) not in draws:  # ensembles with the same draw share its rows
                    at = np.flatnonzero(drawn(idx, spec, turn))
                    drawn_bins = bins.take(at, axis=1, out=scratch.empty(f"bins{len(draws)}", width * len(at), np.uint8).reshape(width, -1), mode="clip")
                    draws[spec.seed, spec.subsample] = at, idx[at], labels[at], drawn_bins, coded(
                        drawn_bins, sizes, max(BINS, min(CELLS, len(at) >> 2 * level)))  # fewer where a level's nodes have fewer rows
                at, numbers, drawn_labels, drawn_bins, groups = draws[spec.seed, spec.subsample]
                n = len(at) if spec.hi is None else int(np.searchsorted(numbers, spec.hi))  # rows lie by number
                if n:
                    gh = derivatives(scores[j].take(at[:n], axis=1), drawn_labels[:n], spec)
                    part = histograms(drawn_bins[:, :n], [(f, c[:n]) for f, c in groups], gh, level, trees, sizes, scratch)
                    sums[j] = sums[j] + part if j in sums else part
        for j, part in sums.items():
            for k in range(classes):
                yield j * classes + k, part[k].reshape(3, nodes, -1)[:, :, held]

    partial = blocks.mapPartitions(run)
    if parts * len(growing) > DIRECT:
        partial = partial.reduceByKey(np.add, min(parts, len(growing) * classes))
    sums = np.zeros((count, classes, 3, nodes, len(held)))
    for k, part in partial.collect():
        sums[k // classes, k % classes] += part
    out = {}
    for j in growing:
        out[j] = np.zeros((classes, 3, nodes, width * BINS))
        out[j][..., held] = sums[j]
        out[j] = out[j].reshape(classes, 3, nodes, width, BINS)
    return out


def _advanced(blocks: RDD, models: list[Boosted], turn: int, width: int, classes: int) -> RDD:
    """The blocks with the scores after round ``turn``; an ensemble's rows from ``hi`` on are never used and keep theirs."""
    work = [(j, m.spec, m.trees[turn]) for j, m in enumerate(models) if turn < len(m.trees)]
    count = len(models)

    def run(row: tuple) -> tuple:
        bins, _, idx = _read(row, width)
        scores = np.frombuffer(row[4]).reshape(count, classes, row[0]).copy()
        for j, spec, trees in work:
            n = len(idx) if spec.hi is None else int(np.searchsorted(idx, spec.hi))
            for k, tree in enumerate(trees):
                scores[j, k, :n] += tree.values(bins[:, :n], spec.depth)
        return *row[:4], scores.tobytes()

    return blocks.map(run, preservesPartitioning=True)
