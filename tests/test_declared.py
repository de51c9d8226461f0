"""Jobs that the reference only declares, against plain versions."""

import datetime as dt
import random
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kickoff.operators import bayes, drift, intervals, order_stats, pages, retrieval


def test_ks_distance_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), bool(s)) for g in ("a", "b") for v, s in zip(np.round(rng.normal(size=900), 2), rng.random(900) < 0.4)]
    rows += [("a", 0.5, True)] * 400 + [("c", 1.0, True), ("a", None, True), ("b", float("nan"), False)]
    df = spark.createDataFrame(rows, "g string, v double, s boolean")
    got = {r["g"]: r for r in drift.ks_two_sample(df.repartition(7), ["g"], "v", F.col("s")).collect()}
    for g in ("a", "b"):
        x, y = (np.sort([v for k, v, s in rows if k == g and s is side and v is not None and v == v]) for side in (False, True))
        every = np.concatenate([x, y])
        ks = max(abs(np.searchsorted(x, every, side="right") / len(x) - np.searchsorted(y, every, side="right") / len(y)))
        assert got[g]["ks"] == pytest.approx(ks, abs=1e-12) and (got[g]["n_first"], got[g]["n_second"]) == (len(x), len(y))
    assert got["c"]["ks"] is None


@pytest.mark.parametrize("width", [1, 7, 400])
def test_interval_join_meets_every_pair_once(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "LONG", 4)
    rng = random.Random(3)
    day = dt.date(1969, 11, 1)
    points = [(i, rng.choice("ab"), day + dt.timedelta(rng.randrange(400))) for i in range(200)] + [(900, None, day), (901, "a", None)]
    spans = [(i, rng.choice("ab"), s := day + dt.timedelta(rng.randrange(400)), s + dt.timedelta(rng.choice([0, 3, 40, 900, -2]))) for i in range(120)]
    spans += [(800, "a", day, day + dt.timedelta(20000)), (801, "a", None, day), (802, "a", day, None), (803, None, day, day)]
    got = intervals.interval_join(spark.createDataFrame(points, "p long, k string, d date"), spark.createDataFrame(spans, "s long, k string, lo date, hi date"),
                                  ["k"], "d", "lo", "hi", width)
    expected = Counter((p, s) for p, k, d in points for s, j, lo, hi in spans if k is not None and k == j and None not in (d, lo, hi) and lo <= d <= hi)
    assert Counter((r["p"], r["s"]) for r in got.collect()) == expected and max(expected.values()) == 1


def test_naive_bayes_scores(spark, monkeypatch):
    monkeypatch.setattr(bayes, "HOT", 3)  # some words are broadcast, some joined
    rows = [(1, "a a b", "x"), (2, "b c", "y"), (3, "a d a", "x"), (4, "a b z", "y"), (5, None, "x"), (6, "q q", None), (7, "", "y"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {(r["id"], r["class"]): (r["score"], r["best"]) for r in bayes.naive_bayes(df, "id", "text", "lang", F.col("id") <= 3).collect()}
    words = {"x": Counter("a a b a d a".split()), "y": Counter("b c".split())}
    vocabulary = set(words["x"]) | set(words["y"])
    for i, text, _ in rows:
        scores = {c: np.log({"x": 2, "y": 1}[c] / 3) + sum(np.log((words[c][w] + 1) / (sum(words[c].values()) + len(vocabulary)))
                                                          for w in (text or "").split() if w in vocabulary) for c in "xy"}
        if i is not None:
            for c in "xy":
                assert got[i, c][0] == pytest.approx(scores[c]) and got[i, c][1] == (c == max("xy", key=lambda k: scores[k]))


def test_cell_index_recall_and_whole_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS_PER_CELL", 40)
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path, centroids = retrieval.build_index(vectors, "vec_id", "embedding", f"{tmp_path}/cells")
    v = np.array(table.column("embedding").to_pylist(), float)
    ids = table.column("vec_id").to_numpy()
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert spark.read.parquet(path).count() == len(ids) and len(centroids) == 50
    assert 1 < retrieval.choose_probes(spark, path, centroids) < 50
    asked = vectors.where("vec_id % 20 = 0")
    found = {}
    for r in retrieval.nearest(spark, path, centroids, asked, "vec_id", "embedding").collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[ids == ids[q]] = -2
        best = set(ids[np.argsort(-score, kind="stable")[:10]].tolist())
        hits, total = hits + len(best & found.get(int(ids[q]), set())), total + 10
    assert hits / total >= 0.9


def test_cell_index_of_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, e array<float>")
    path, centroids = retrieval.build_index(df, "i", "e", f"{tmp_path}/cells")
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["cosine"], 6)) for r in retrieval.nearest(spark, path, centroids, df, "i", "e").collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 1, 1, 1.0)]
    empty, none = retrieval.build_index(df.limit(0), "i", "e", f"{tmp_path}/none")
    assert retrieval.nearest(spark, empty, none, df, "i", "e").collect() == []


def test_cells_are_cut_by_their_own_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS_PER_CELL", 40)
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 8 * 4 * 16)  # 16 rows or queries a group
    monkeypatch.setattr(retrieval, "TILE", 50)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 4)).astype(np.float32)
    v[7:19] = v[6]  # ties
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "i long, e array<float>").repartition(3)
    path, centroids = retrieval.build_index(df, "i", "e", f"{tmp_path}/cells")
    index = spark.read.parquet(path)
    assert index.schema["v"].dataType.simpleString() == "array<float>"
    cut = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), (F.max("chunk") + 1).alias("parts")).collect()
    assert len(cut) > 1 and all(r["parts"] <= -(-r["n"] // 16) for r in cut) and max(r["parts"] for r in cut) > 1
    got = {}
    for r in retrieval.nearest(spark, path, centroids, df, "i", "e", probes=len(centroids)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["cosine"], r["id"]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    for q in range(400):
        score = u @ u[q]
        score[q] = -2
        assert [got[q][k][0] for k in range(1, 11)] == pytest.approx(np.sort(score)[::-1][:10].tolist())
        assert all(score[i] == pytest.approx(c) for c, i in got[q].values()) and len({i for _, i in got[q].values()}) == 10


def test_values_at_ranks(spark):
    rng = np.random.default_rng(1)
    n = 30_001
    columns = {"a": rng.normal(size=n), "b": rng.integers(-3, 4, n).astype(float), "c": np.where(rng.random(n) < 0.5, np.nan, rng.exponential(size=n)),
               "d": np.full(n, 7.0), "e": np.where(rng.random(n) < 0.7, 0.0, -rng.random(n) * 1e-300), "f": np.r_[np.full(n - 3, -0.0), np.inf, -np.inf, 1e308]}
    ids = rng.integers(-2 ** 62, 2 ** 62, n)
    rows = [(*(None if i % 911 == 0 else float(v[i]) for v in columns.values()), int(ids[i])) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", i long").repartition(5)
    got = order_stats.values_at(df, [*columns, "i"], lambda n: [0, n // 3, n // 2, n - 1])
    for c, v in columns.items():
        kept = np.sort([x for i, x in enumerate(v) if i % 911 and x == x])
        assert got[c] == [kept[r] for r in (0, len(kept) // 3, len(kept) // 2, len(kept) - 1)], c
    assert got["i"] == [np.sort(ids)[r] for r in (0, n // 3, n // 2, n - 1)]
    assert order_stats.values_at(df.limit(0), ["a"], lambda n: []) == {"a": []}


class Plain(HTMLParser):
    """Shown text by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], None

    def handle_starttag(self, tag, attrs):
        if tag in pages.LINES:
            self.out.append("\0")
        if tag in pages.HIDDEN:
            self.hidden = tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in pages.LINES:
            self.out.append("\0")
        if tag == self.hidden:
            self.hidden = None

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def plain_text(page):
    p = Plain()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.out).split("\0")) if x)


def test_given_pages_equal_the_standard_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in pages.clean_pages(rows).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        assert got[r["page_id"]] == plain_text(r["html"])


HOSTILE = [
    "a<b>c</b>d<br>e", "<p title=\"a>b\">x</p>", "<p title='a>b' id=c>x", "x<!-- <p>y</p> -->z", "x<!-->y", "x<!--->y", "x<!-- a --!>y", "<!DOCTYPE html><p>t",
    "<?php echo 1 ?>x", "</>x", "</ p>x", "1 < 2 and 3 > 2", "a<", "&lt;b&gt; &amp;amp; &#65;&#x42; &eacute;t&eacute; &copy 2020 &nosuch; &#0;", "<script>if (a < b) x('</p>')</script>y",
    "<SCRIPT type=a>x</Script >y", "<style>p{}</style><script>1</script>2", "<title>A &amp; B</title><body><h1>C</h1>D", "<div>a<div>b</div>c</div>d",
    "<ul><li>1<li>2</ul>", "  many \n\t spaces  ", "<p>é日本</p>", "<a href=x/>y</a>", "<img src=\"a\" alt=\"<p>\">z", "<td>1<td>2", "", "<p", "x<p class='", "<b/>q",
]


@pytest.mark.parametrize("page", HOSTILE)
def test_hostile_pages(page):
    expected = {"x<p class='": "x", "<p": "", "a<": "a<", "x<!-->y": "xy", "x<!--->y": "xy", "x<!-- a --!>y": "xy", "</ p>x": "x"}
    assert pages.visible_text(page) == expected.get(page, plain_text(page))


def test_unclosed_raw_text_ends_with_the_page():
    assert pages.visible_text("a<script>b</p>") == "a" and pages.visible_text("a<!-- b <p>") == "a" and pages.visible_text("a<style>x</style") == "a"


def test_absences_meet_days_of_a_team_not_contests(spark, tmp_path, monkeypatch):
    from kickoff.plans import declared

    days = [dt.datetime(2000, 1, 5)] * 4 + [dt.datetime(2000, 3, 1)]
    orders = [(k * 200, 20, d) for k, d in enumerate(days)] + [(None, 20, days[0]), (0, 20, days[0])]  # a repeated and a missing id
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(10, 20, 1, 3.0, 0.04, dt.datetime(2000, 1, 4)), (20, 20, 2, 1.0, 0.01, dt.datetime(2000, 1, 5)), (30, 20, 1, 2.0, 0.09, dt.datetime(2000, 2, 1))]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_shipdate timestamp") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    met, join = [], intervals.interval_join
    monkeypatch.setattr(declared.intervals, "interval_join", lambda points, *a: (met.append(points.count()), join(points, *a))[1])
    got = sorted(tuple(r) for r in declared.absence_impact(spark, str(tmp_path)).where("is_home").collect() if r["match_id"] is not None)
    assert got == [(0, True, 4, 10, 2), (0, True, 4, 10, 2), *[(k, True, 2, 5, 2) for k in (200, 400, 600)], (800, True, 0, 0, 0)]
    assert met[0] <= 2 * 2 + 2 * 4  # two home days, and at most four away sides on each; fourteen sides in all


def test_naive_bayes_writes_no_table_of_documents_and_words(spark, monkeypatch):
    written, write = [], bayes.materialize
    monkeypatch.setattr(bayes, "materialize", lambda df, name: (written.append(df.columns), write(df, name))[1])
    rows = [(1, "a b b", "x"), (1, "c", "x"), (2, "b d", "y"), (3, "a z", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {(r["id"], r["class"]): r["score"] for r in bayes.naive_bayes(df, "id", "text", "lang", F.lit(True)).collect()}
    assert not [c for c in written if "id" in c]
    assert got[3, "x"] == pytest.approx(np.log(0.5) + np.log(2 / 8)) and got[3, "y"] == pytest.approx(np.log(0.5) + np.log(1 / 6))
