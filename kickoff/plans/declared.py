"""Queries for jobs that the reference only declares (R3, R4, R6, R7, R8, R9, R10, R11, R13) and the observed cleaning run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prices as P
from ..operators import bayes, drift, entities, intervals, pages, quality, retrieval, similar
from ..session import fresh_path, materialize
from ..sources.contests import contests, dirty_contests
from ..sources.tables import read_table
from ..streaming import run as SR
from . import catalog as C
from . import features as FE
from . import oracle_sql as O
from . import training as TR
from . import tuning

# ---------------------------------------------------------------- P2, P6 the report of the run that writes the table
C.register("cleaning_observed", "P2,P3,P6,P7", C.SQL["cleaning_report"])(
    lambda spark, sf: quality.write_cleaned(dirty_contests(spark, sf), fresh_path(spark, "cleaned")))

# ---------------------------------------------------------------- R11 distribution drift between seasons
DRIFT = ["odds_prob_home", "odds_prob_draw", "odds_prob_away", "hs", "fthg"]


def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of every feature between a season and the one before it."""
    c = contests(spark, sf_dir)
    seasons = c.select("season").distinct()  # a few rows
    later = seasons.select("season", F.lead("season").over(Window.partitionBy(F.lit(0)).orderBy("season")).alias("later"))
    rows = c.select("season", *P.implied_probabilities(), "hs", "fthg").join(F.broadcast(later), "season")
    long = rows.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in DRIFT])).alias("x"),
        "season", "later")
    sides = long.select("x.*", F.explode(F.array(F.struct("season", F.lit(True).alias("second")),
                                                 F.struct(F.col("later").alias("season"), F.lit(False).alias("second")))).alias("s"))
    out = drift.ks_two_sample(sides.select("feature", "v", "s.*").where("season IS NOT NULL"), ["season", "feature"], "v", F.col("second"))
    return out.where("ks IS NOT NULL").select("season", "feature", "n_first", "n_second", F.round("ks", 9).alias("ks"))


C.register("ks_drift", "R11", O.with_(O.CONTESTS) + ", i AS (SELECT season, hs, fthg, " + O.odds_cols() + " FROM c), l AS (" + " UNION ALL ".join(
    f"SELECT season, '{f}' AS feature, CAST({f} AS DOUBLE) AS v FROM i" for f in DRIFT) + """),
s AS (SELECT season, lead(season) OVER (ORDER BY season) AS later FROM (SELECT DISTINCT season FROM c)),
b AS (SELECT feature, v, season, 1 AS second FROM l UNION ALL SELECT l.feature, l.v, s.later, 0 FROM l JOIN s USING (season) WHERE s.later IS NOT NULL),
g AS (SELECT season, feature, v, SUM(1 - second) AS a, SUM(second) AS z FROM b WHERE v IS NOT NULL GROUP BY ALL),
r AS (SELECT season, feature, SUM(a) OVER w AS ca, SUM(z) OVER w AS cz, SUM(a) OVER (PARTITION BY season, feature) AS na,
        SUM(z) OVER (PARTITION BY season, feature) AS nz FROM g WINDOW w AS (PARTITION BY season, feature ORDER BY v))
SELECT season, feature, CAST(na AS BIGINT) AS n_first, CAST(nz AS BIGINT) AS n_second,
  round(max(abs(CAST(ca AS DOUBLE) / na - CAST(cz AS DOUBLE) / nz)), 9) AS ks FROM r WHERE na > 0 AND nz > 0 GROUP BY ALL""")(ks_drift)

# ---------------------------------------------------------------- R6 absences that hold on a contest's day
LONG_ABSENCE = 400  # days of an absence of line number 7


def absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absence spans of a team, from line items: ship date, ``quantity`` days (every seventh line a long one), severity. Equal
    spans are one row with their number and total severity."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    start = F.to_date("l_shipdate")
    days = F.when(F.col("l_linenumber") == 7, LONG_ABSENCE).otherwise(F.col("l_quantity").cast("int"))
    spans = li.select(F.concat(F.lit("L"), (F.col("l_orderkey") % 10).cast("string")).alias("div"),
                      F.concat(F.lit("T"), (F.col("l_suppkey") % 20).cast("string")).alias("team"), start.alias("start_day"),
                      F.date_add(start, days).alias("end_day"), F.round(F.col("l_discount") * 100).cast("long").alias("severity"))
    return spans.groupBy("div", "team", "start_day", "end_day").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").alias("severity"))


def absence_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For both sides of every contest the absences that hold on its day, their severity, and the longest time left."""
    c = contests(spark, sf_dir)
    points = c.select("match_id", "match_date", "div", F.explode(F.array(
        F.struct(F.lit(True).alias("is_home"), F.col("home_team").alias("team")),
        F.struct(F.lit(False).alias("is_home"), F.col("away_team").alias("team")))).alias("s")).select("match_id", "match_date", "div", "s.*")
    # the answer is the same for all contests of a team on a day: absences meet days, whose number the calendar bounds, not contests
    days = points.select("div", "team", "match_date").distinct()
    met = intervals.interval_join(days, absences(spark, sf_dir), ["div", "team"], "match_date", "start_day", "end_day")
    held = met.groupBy("div", "team", "match_date").agg(F.sum("n").alias("absent"), F.sum("severity").alias("severity"),
                                                        F.max(F.datediff("end_day", "match_date")).alias("days_left"))
    # rows that share a contest and side count together; those without an id stay apart (and zero)
    alone = F.when(F.col("match_id").isNull(), F.xxhash64("div", "team", "match_date"))
    side = Window.partitionBy("match_id", "is_home", alone)
    known, zero = F.col("match_id").isNotNull(), F.lit(0).cast("long")
    return points.join(held, ["div", "team", "match_date"], "left").select(
        "match_id", "is_home", F.coalesce(F.when(known, F.sum("absent").over(side)), zero).alias("absent"),
        F.coalesce(F.when(known, F.sum("severity").over(side)), zero).alias("severity"),
        F.coalesce(F.when(known, F.max("days_left").over(side)), F.lit(0)).alias("days_left"))


C.register("absence_impact", "R6", O.with_(O.CONTESTS) + f""",
p AS (SELECT match_id, match_date, div, TRUE AS is_home, home_team AS team FROM c UNION ALL SELECT match_id, match_date, div, FALSE, away_team FROM c),
a AS (SELECT CONCAT('L', CAST(l_orderkey % 10 AS VARCHAR)) AS div, CONCAT('T', CAST(l_suppkey % 20 AS VARCHAR)) AS team,
        CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(CASE WHEN l_linenumber = 7 THEN {LONG_ABSENCE} ELSE floor(l_quantity) END AS INTEGER) AS e,
        CAST(round(l_discount * 100) AS BIGINT) AS severity FROM lineitem)
SELECT p.match_id, p.is_home, COUNT(a.s) AS absent, CAST(COALESCE(SUM(a.severity), 0) AS BIGINT) AS severity,
  CAST(COALESCE(MAX(a.e - p.match_date), 0) AS INTEGER) AS days_left
FROM p LEFT JOIN a ON a.div = p.div AND a.team = p.team AND p.match_date BETWEEN a.s AND a.e GROUP BY p.match_id, p.is_home""")(absence_impact)

# ---------------------------------------------------------------- R9 class of an article
HELD_OUT = 5  # ids divisible by it do not teach


def article_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes score of every document for every language, learned from four fifths of the documents."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    train = F.col("doc_id") % HELD_OUT != 0
    out = bayes.naive_bayes(docs, "doc_id", "text", "lang", train)
    return out.select(F.col("id").alias("doc_id"), F.col("class").alias("lang"), F.round("score", 6).alias("score"))


def article_class_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents held out of training by language and best class."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    train = F.col("doc_id") % HELD_OUT != 0
    best = bayes.naive_bayes(docs, "doc_id", "text", "lang", train).where("best").select(F.col("id").alias("doc_id"), F.col("class").alias("predicted"))
    return (docs.where(~train & F.col("lang").isNotNull()).select("doc_id", "lang").join(best, "doc_id")
            .groupBy("lang", "predicted").agg(F.count(F.lit(1)).alias("n")))


_BAYES = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS word FROM documents),
f AS MATERIALIZED (SELECT doc_id, word, COUNT(*) AS tf FROM t GROUP BY ALL),
tr AS MATERIALIZED (SELECT DISTINCT doc_id, lang FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL),
cnt AS MATERIALIZED (SELECT word, lang, SUM(tf) AS n FROM f JOIN tr USING (doc_id) GROUP BY ALL),
k AS MATERIALIZED (SELECT tr.lang, ln(COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM tr)) AS share,
        COALESCE((SELECT SUM(n) FROM cnt WHERE cnt.lang = tr.lang), 0) + (SELECT COUNT(DISTINCT word) FROM cnt) AS size FROM tr GROUP BY tr.lang),
w AS MATERIALIZED (SELECT v.word, k.lang, ln((COALESCE(cnt.n, 0) + 1) / CAST(k.size AS DOUBLE)) AS weight
      FROM (SELECT DISTINCT word FROM cnt) v CROSS JOIN k LEFT JOIN cnt ON cnt.word = v.word AND cnt.lang = k.lang),
s AS (SELECT f.doc_id, w.lang, SUM(f.tf * w.weight) AS total FROM f JOIN w USING (word) GROUP BY ALL),
scored AS (SELECT d.doc_id, k.lang, k.share + COALESCE(s.total, 0) AS score FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN k
           LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang = k.lang)
"""
C.register("article_class", "R9", _BAYES + "SELECT doc_id, lang, round(score, 6) AS score FROM scored")(article_class)
C.register("article_class_held_out", "R9", _BAYES + """, best AS (SELECT doc_id, arg_max(lang, score) AS predicted FROM scored GROUP BY doc_id)
SELECT d.lang, best.predicted, COUNT(*) AS n FROM documents d JOIN best USING (doc_id) WHERE d.doc_id % 5 = 0 AND d.lang IS NOT NULL GROUP BY ALL""")(
    article_class_held_out)

# ---------------------------------------------------------------- R13 retrieval by cosine
QUERY_EVERY = 20


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows by cosine of every row whose id is divisible by 20, from a cell index over all rows."""
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    path, centroids = retrieval.build_index(vectors, "vec_id", "embedding")
    found = retrieval.nearest(spark, path, centroids, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


C.register("similar_vectors", "R13")(similar_vectors)


# ---------------------------------------------------------------- R8 shown text of pages
C.register("page_text", "R8")(lambda spark, sf: pages.clean_pages(read_table(spark, sf, "pages", "page_id", "html")))

# ---------------------------------------------------------------- M10 hyper-parameter search
def tune_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials (the reference's 50 a model) of every model over its full space, pruned ones marked."""
    data = materialize(TR.prepare(FE.model_ready(FE.match_features(spark, sf_dir))), "model-rows")
    return tuning.trials_table(spark, tuning.search(data))


C.register("tune_models", "M10,M9")(tune_models)


# ---------------------------------------------------------------- R3, R4 with keyed state in the state store
C.register("value_moves_state", "R3", C.SQL["value_moves"])(SR.value_moves_stateful)
C.register("elo_state", "R4", C.SQL["elo_stream"])(SR.elo_stateful)


# ---------------------------------------------------------------- R7 duplicate articles
def article_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal articles, number of similar classes, and whether the article is the most authoritative of its kind."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return similar.duplicates(docs, "doc_id", "text", "source").select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "links", "keep")


C.register("article_duplicates", "R7", r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
      FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
j AS MATERIALIZED (SELECT p.a, p.b, p.c, x.n + y.n - p.c AS u FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
      WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
k AS MATERIALIZED (SELECT d.doc_id, least(d.doc_id, COALESCE(min(j.b) FILTER (WHERE j.c = j.u), d.doc_id)) AS class_id, any_value(d.source) AS source
      FROM documents d LEFT JOIN j ON j.a = d.doc_id GROUP BY d.doc_id),
l AS (SELECT j.a, COUNT(DISTINCT kb.class_id) AS links FROM j JOIN k ka ON ka.doc_id = j.a JOIN k kb ON kb.doc_id = j.b
      WHERE ka.class_id <> kb.class_id GROUP BY j.a),
better AS (SELECT DISTINCT j.a FROM j JOIN k x ON x.doc_id = j.a JOIN k y ON y.doc_id = j.b
      WHERE (y.source IS NOT NULL AND (x.source IS NULL OR y.source < x.source)) OR (y.source IS NOT DISTINCT FROM x.source AND y.doc_id < x.doc_id))
SELECT k.doc_id, k.class_id, COALESCE(l.links, 0) AS links, better.a IS NULL AS keep
FROM k LEFT JOIN l ON l.a = k.doc_id LEFT JOIN better ON better.a = k.doc_id""")(article_duplicates)


# ---------------------------------------------------------------- R10 mentions of sites in documents
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias table from page addresses: a site is its host without a leading www, m or blog; its aliases are the site's first label
    and that label with spaces for hyphens."""
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    site = F.regexp_replace(F.lower(host), r"^(www|m|blog)\.", "")
    sites = read_table(spark, sf_dir, "pages", "url").select(site.alias("site")).where("site <> ''").distinct()
    label = F.regexp_extract("site", r"^[^.]+", 0)
    return entities.alias_table(sites.select("site", F.explode(F.array_distinct(F.array(label, F.translate(label, "-", " ")))).alias("alias")),
                                "alias", "site")


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every site, exact mentions, documents that mention it, and words that miss its name by one edit."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    names = materialize(site_names(spark, sf_dir), "site-names")
    exact = entities.find_mentions(docs, "doc_id", "text", names).groupBy("entity").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("id").alias("documents"))
    near = entities.near_names(docs, "text", names).groupBy("entity").agg(F.sum("n").alias("near"))
    zero = F.lit(0).cast("long")
    return (names.select("entity").distinct().join(exact, "entity", "left").join(near, "entity", "left")
            .select("entity", *(F.coalesce(c, zero).alias(c) for c in ("mentions", "documents", "near"))))


C.register("entity_mentions", "R10")(entity_mentions)
