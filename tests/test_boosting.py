"""Histogram boosting against a plain version that looks at every split of every node directly."""

import numpy as np
import pytest

from kickoff.operators import boosting as BO

SPECS = [BO.Spec("second", rounds=6, depth=3, second_order=True, colsample=0.8, alpha=0.1, lam=1.0, min_child_weight=3.0),
         BO.Spec("first", rounds=6, depth=3, min_leaf=15), BO.Spec("fold", rounds=3, depth=2, min_leaf=15, hi=400, subsample=1.0)]


def table(spark, n=1500):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.exponential(size=n), rng.normal(size=n) * 0, rng.normal(size=n)])
    x[::17, 2] = np.nan
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) > 1).astype(int) + (np.nan_to_num(x[:, 2]) > 1)
    cols = [f"f{k}" for k in range(x.shape[1])]
    rows = [(i, float(y[i]), *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "idx long, label double, " + ", ".join(f"{c} double" for c in cols))
    return df.repartition(5), cols, x, y


def plain_scores(model, x, y):
    """Train again, one node at a time, from the same bins, draws and features."""
    spec, classes = model.spec, 3
    bins = BO.to_bins(x.T, model.edges)
    idx = np.arange(len(y))
    inside = idx < (spec.hi if spec.hi is not None else len(y))
    scores = np.tile(model.base[:, None], (1, len(y)))
    for turn in range(spec.rounds):
        use = BO.drawn(idx, spec, turn) & inside
        p = np.exp(scores - scores.max(0))
        p /= p.sum(0)
        new = scores.copy()
        for k in range(classes):
            t = (y == k).astype(float)
            g, h = (p[k] - t, 2 * p[k] * (1 - p[k])) if spec.second_order else (t - p[k], np.abs(t - p[k]) * (1 - np.abs(t - p[k])))
            allowed = np.flatnonzero(BO.features_of(spec, turn, k, x.shape[1]))

            def soft(v):
                return np.sign(v) * max(abs(v) - spec.alpha, 0)

            def value(rows):
                rows = rows & use
                if spec.second_order:
                    return -soft(g[rows].sum()) / (h[rows].sum() + spec.lam)
                return 2 / 3 * g[rows].sum() / h[rows].sum()

            def grow(rows, depth):
                best = (1e-12, None)
                train = rows & use
                for f in allowed if depth else []:
                    for b in range(BO.BINS - 1):
                        left, right = train & (bins[f] <= b), train & (bins[f] > b)
                        if left.sum() < max(1, spec.min_leaf) or right.sum() < max(1, spec.min_leaf):
                            continue
                        if spec.second_order:
                            if h[left].sum() < spec.min_child_weight or h[right].sum() < spec.min_child_weight:
                                continue
                            gain = sum(s * soft(g[r].sum()) ** 2 / (h[r].sum() + spec.lam) for s, r in ((1, left), (1, right), (-1, train)))
                        else:
                            gain = left.sum() * right.sum() / train.sum() * (g[left].mean() - g[right].mean()) ** 2
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, b))
                if best[1] is None:
                    new[k, rows] += spec.rate * value(rows)
                else:
                    f, b = best[1]
                    grow(rows & (bins[f] <= b), depth - 1)
                    grow(rows & (bins[f] > b), depth - 1)

            grow(np.ones(len(y), bool), spec.depth)
        scores = new
    return scores


@pytest.fixture(scope="module")
def trained(spark):
    df, cols, x, y = table(spark)
    return BO.boost(df, cols, SPECS), df, cols, x, y


def test_trees_equal_a_plain_version(trained):
    models, _, _, x, y = trained
    for model in models:
        got = model.scores(BO.to_bins(x.T, model.edges))
        assert np.allclose(got, plain_scores(model, x, y), atol=1e-9), model.spec.name


@pytest.mark.parametrize("direct", [16, 0])
def test_distributed_passes_give_the_same_trees(trained, monkeypatch, direct):
    models, df, cols, x, _ = trained
    for name, value in (("ONE_TASK", 0), ("BLOCK_ROWS", 200), ("KEEP", 2), ("DIRECT", direct)):
        monkeypatch.setattr(BO, name, value)
    for a, b in zip(models, BO.boost(df, cols, SPECS)):
        bins = BO.to_bins(x.T, a.edges)
        assert np.allclose(a.scores(bins), b.scores(bins), atol=1e-9)


def test_scoring_and_importances(trained):
    models, df, cols, x, y = trained
    got = {r["idx"]: r["p"] for r in df.select("idx", models[0].probabilities().alias("p")).collect()}
    expected = BO.softmax(models[0].scores(BO.to_bins(x.T, models[0].edges))).T
    assert np.allclose([got[i] for i in range(len(y))], expected)
    assert (expected.argmax(1) == y).mean() > (y == np.bincount(y).argmax()).mean()
    share = models[0].importances()
    assert share.sum() == pytest.approx(1) and share[3] == 0  # a constant column is never used


def test_no_rows(spark):
    df, cols, *_ = table(spark, 40)
    model = BO.boost(df.limit(0), cols, [SPECS[0]])[0]
    assert np.allclose(BO.softmax(model.scores(np.zeros((5, 2), np.uint8))), 1 / 3)


def test_nodes_and_values_of_an_uneven_tree():
    tree = BO.Tree.empty(3)
    tree.value[:] = np.arange(15)
    tree.feature[[0, 2, 6]], tree.split[[0, 2, 6]] = [0, 1, 0], [3, 2, 5]  # the left child of the root is a leaf
    bins = np.random.default_rng(1).integers(0, 8, (2, 300)).astype(np.uint8)
    expected = [1 if a <= 3 else 5 if b <= 2 else 13 if a <= 5 else 14 for a, b in bins.T]
    assert tree.nodes(bins, 3).tolist() == expected and tree.values(bins, 3).tolist() == expected
    assert tree.nodes(bins, 1).tolist() == [1 if a <= 3 else 2 for a in bins[0]]


def test_a_pass_has_a_task_for_every_core(spark, monkeypatch):
    df, cols, *_ = table(spark, 3000)
    seen, passed = [], BO._pass
    monkeypatch.setattr(BO, "ONE_TASK", 0)
    monkeypatch.setattr(BO, "_pass", lambda blocks, *a: (seen.append(a[-1]), passed(blocks, *a))[1])
    BO.boost(df, cols, [BO.Spec("one", rounds=1, depth=1)])
    assert seen == [min(max(spark.sparkContext.defaultParallelism, 1), 12)]


@pytest.mark.parametrize("depth", [0, 1, 4, 8])
def test_nodes_and_values_of_whole_columns(depth):
    rng = np.random.default_rng(depth)
    tree, inner = BO.Tree.empty(depth), (1 << depth) - 1
    tree.feature[:inner] = np.where(rng.random(inner) < 0.85, rng.integers(0, 5, inner), -1)
    tree.split[:inner] = rng.integers(0, 63, inner)
    tree.value[:] = rng.normal(size=len(tree.value))
    bins = rng.integers(0, 64, (5, 300)).astype(np.uint8)
    for steps in range(depth + 1):
        want = []
        for row in bins.T:
            node = 0
            for _ in range(steps):
                if tree.feature[node] < 0:
                    break
                node = 2 * node + 1 + int(row[tree.feature[node]] > tree.split[node])
            want.append(node)
        assert tree.nodes(bins, steps).tolist() == want and tree.values(bins, steps).tolist() == tree.value[want].tolist()


def test_whole_columns_are_looked_up_in_bytes(monkeypatch):
    """A value per node and row is not put together: one look-up of node numbers a tree."""
    def never(*a):
        raise AssertionError("rows were handled in values")

    tree = BO.Tree.empty(4)
    tree.feature[:15], tree.value[:] = 0, np.arange(31)
    tree.split[:15] = [31, 15, 47, 7, 23, 39, 55, 3, 11, 19, 27, 35, 43, 51, 59]
    monkeypatch.setattr(np, "where", never)
    bins = np.arange(64, dtype=np.uint8)[None]
    assert tree.values(bins, 4).tolist() == [15 + b // 4 for b in range(64)]


def test_features_are_counted_in_groups():
    """Every feature is in one group of few combinations, and the counts of a group are those of its features."""
    rng, sizes = np.random.default_rng(4), (64, 3, 64, 17, 2, 5, 40)
    groups = BO.groups_of(sizes, 4096)
    assert sorted(f for group in groups for f in group) == list(range(len(sizes))) and len(groups) < 5
    assert all(np.prod([sizes[f] for f in group]) <= 4096 for group in groups)
    assert all(len(group) == 1 or np.prod([sizes[f] for f in group]) <= 64 for group in BO.groups_of(sizes, 64))
    n = 20_000
    bins = np.array([rng.integers(0, k, n) for k in sizes], np.uint8)
    gh = rng.normal(size=(2, n)) + 1j * rng.normal(size=(2, n))
    trees = [BO.Tree.empty(2) for _ in gh]
    for tree, (feature, split, smaller) in zip(trees, ((0, 20, 0), (3, 5, 1))):
        tree.feature[0], tree.split[0], tree.smaller[0] = feature, split, smaller
    for level, most in ((0, 4096), (1, 4096), (1, 1)):
        got = BO.histograms(bins, BO.coded(bins, sizes, most), gh, level, trees, sizes, BO.Scratch())
        for k, tree in enumerate(trees):
            rows = np.flatnonzero(tree.nodes(bins, 1) == 1 + tree.smaller[0]) if level else np.arange(n)
            for f in range(len(sizes)):
                for i, weights in enumerate((np.ones(n), gh[k].real, gh[k].imag)):
                    assert np.allclose(got[k, i, 0, f], np.bincount(bins[f, rows], weights[rows], BO.BINS))


def test_scores_are_brought_up_to_date_once_a_round(trained, monkeypatch):
    """No pass adds the trees of earlier rounds again: that is done once a round, and the blocks keep the scores."""
    models, df, cols, x, _ = trained
    turns, advanced = [], BO._advanced
    monkeypatch.setattr(BO, "ONE_TASK", 0)
    monkeypatch.setattr(BO, "_advanced", lambda blocks, models, turn, *a: (turns.append(turn), advanced(blocks, models, turn, *a))[1])
    got = BO.boost(df, cols, SPECS)
    assert turns == list(range(max(s.rounds for s in SPECS) - 1))
    for a, b in zip(models, got):
        bins = BO.to_bins(x.T, a.edges)
        assert np.allclose(a.scores(bins), b.scores(bins), atol=1e-9)


def test_a_block_holds_rows_of_several_batches(spark, monkeypatch):
    df, cols, x, _ = table(spark, 700)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    monkeypatch.setattr(BO, "BLOCK_ROWS", 400)
    try:
        blocks = BO.to_blocks(df.coalesce(1), cols, BO.bin_edges(df, cols)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [b["n"] for b in blocks] == [400, 300]
    idx = np.concatenate([np.frombuffer(b["idx"], np.int64) for b in blocks])
    assert sorted(idx) == list(range(700))


def test_a_table_of_several_small_ones_is_still_a_task_an_ensemble(trained, monkeypatch):
    """No passes up to LARGER times ONE_TASK rows; blocks of several partitions in any order give the same trees."""
    def never(*a):
        raise AssertionError("a pass was started")

    models, df, cols, x, _ = trained
    for name, value in (("ONE_TASK", 300), ("BLOCK_ROWS", 200), ("_pass", never)):
        monkeypatch.setattr(BO, name, value)
    for a, b in zip(models, BO.boost(df, cols, SPECS)):
        bins = BO.to_bins(x.T, a.edges)
        assert np.allclose(a.scores(bins), b.scores(bins), atol=1e-9)


def test_what_tasks_run_needs_no_installed_package():
    """Functions travel by value; one behind a C wrapper (as lru_cache) would be looked up by name on the executor."""
    import subprocess
    import sys
    import tempfile

    from pyspark import cloudpickle

    with tempfile.TemporaryDirectory() as empty:
        done = subprocess.run([sys.executable, "-c", "import pickle, sys; f = pickle.load(sys.stdin.buffer); assert f((4, 4), 64) == [[0, 1]]"],
                              input=cloudpickle.dumps(BO.groups_of), cwd=empty, env={"PATH": "/usr/bin", "PYTHONPATH": ":".join(
                                  p for p in sys.path if "pyspark" in p or "py4j" in p)}, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()
