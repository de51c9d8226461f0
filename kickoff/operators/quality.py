"""Cleaning, validation and contracts.

Cleaning is one chain of narrow expressions (no shuffle). Validation computes every count in
one aggregation pass and returns a tidy table ``(check, column, n_bad, detail)`` instead of
log lines. Duplicate handling aggregates copies with partial aggregation, so a group of copies
holding a third of the table is pre-reduced map-side, never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.calendar import season_label, season_start

# Valid result codes, essential and statistic columns (lower-case names).
VALID_RESULTS = ["H", "D", "A"]
ESSENTIAL = ["match_date", "home_team", "away_team", "fthg", "ftag", "ftr"]
STATS = ["hs", "aws", "hst", "ast", "hc", "ac", "hf", "af", "hy", "ay", "hr", "ar"]
YEAR_PIVOT = 69  # the usual rule for two-digit years


def parse_day_first(text_col: str, pivot: int = YEAR_PIVOT) -> "F.Column":
    """Day-first dates with one- or two-digit days and months and four- or two-digit years
    (two digits from ``pivot`` on are 19xx, below it 20xx); unparsable → null (ANSI-safe).

    The year is completed in the text first, so the date is parsed once, in one format."""
    t = F.trim(F.col(text_col))
    short = t.rlike(r"/\d\d$")
    century = F.when(F.right(t, F.lit(2)) >= f"{pivot:02d}", "19").otherwise("20")
    return F.try_to_date(F.when(short, F.concat(F.expr(f"left(trim(`{text_col}`), length(trim(`{text_col}`)) - 2)"), century,
                                                F.right(t, F.lit(2)))).otherwise(t), "d/M/yyyy")


def strip(c: str):
    """Python ``str.strip`` semantics (all leading/trailing whitespace)."""
    return F.regexp_replace(F.regexp_replace(F.col(c), r"^\s+", ""), r"\s+$", "")


def clean_contests(raw: DataFrame, date_text: str = "date_text") -> DataFrame:
    """P7 = P1 → P2 → P3 → P4 → P5 (sorting is left to the writer)."""
    df = raw.withColumn("match_date", parse_day_first(date_text))
    df = df.where(F.col("ftr").isin(VALID_RESULTS))                       # P2
    df = df.na.drop(subset=[c for c in ESSENTIAL if c in df.columns])     # P3
    df = df.withColumn("home_team", strip("home_team")).withColumn("away_team", strip("away_team"))  # P4
    df = df.withColumn("fthg", F.col("fthg").cast("int")).withColumn("ftag", F.col("ftag").cast("int"))  # P5
    for c in STATS:
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("int"))
    keep = [c for c in df.columns if c not in (date_text, "_true_date")]
    return (df.select(*keep).withColumn("season_start", season_start("match_date"))
              .withColumn("season", season_label("match_date")))


REPORT = ["rows_in", "removed_bad_result", "removed_missing", "rows_out", "first_date", "last_date", "home_teams"]


def cleaning_report(raw: DataFrame, date_text: str = "date_text") -> DataFrame:
    """P2/P3/P6 counts of one cleaning run, in one aggregation pass."""
    d = parse_day_first(date_text)
    ok_ftr = F.col("ftr").isin(VALID_RESULTS)
    ess_null = (d.isNull() | F.col("home_team").isNull() | F.col("away_team").isNull()
                | F.col("fthg").isNull() | F.col("ftag").isNull() | F.col("ftr").isNull())
    kept = ok_ftr & ~ess_null
    return raw.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~ok_ftr | F.col("ftr").isNull()).alias("removed_bad_result"),
        F.count_if(ok_ftr & ess_null).alias("removed_missing"),
        F.count_if(kept).alias("rows_out"),
        F.min(F.when(kept, d)).alias("first_date"), F.max(F.when(kept, d)).alias("last_date"),
        F.count_distinct(F.when(kept, strip("home_team"))).alias("home_teams"))


def write_cleaned(raw: DataFrame, path: str, date_text: str = "date_text") -> DataFrame:
    """P7 and P2/P3/P6 in one job: the cleaned table is written to ``path`` while its report is observed on the rows that pass by.
    Returns the report (the row of ``cleaning_report``). Distinct home teams are observed as a set, bounded by the league's teams."""
    spark = raw.sparkSession
    d = parse_day_first(date_text)
    ok_ftr = F.coalesce(F.col("ftr").isin(VALID_RESULTS), F.lit(False))
    essential = (d.isNull() | F.col("home_team").isNull() | F.col("away_team").isNull() | F.col("fthg").isNull() | F.col("ftag").isNull())
    kept = ok_ftr & ~essential
    seen = Observation("cleaning")
    observed = raw.observe(
        seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(~ok_ftr).alias("removed_bad_result"), F.count_if(ok_ftr & essential).alias("removed_missing"),
        F.count_if(kept).alias("rows_out"), F.min(F.when(kept, d)).alias("first_date"), F.max(F.when(kept, d)).alias("last_date"),
        F.size(F.collect_set(F.when(kept, strip("home_team")))).cast("long").alias("home_teams"))
    clean_contests(observed, date_text).write.parquet(path)
    row = seen.get
    return spark.createDataFrame([tuple(row[c] for c in REPORT)], ", ".join(f"{c} {'date' if c.endswith('date') else 'long'}" for c in REPORT))


def _row(check: str, column: str, n, detail=None):
    return F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), n.cast("long").alias("n_bad"),
                    (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def dq_report(df: DataFrame, order_col: str = "match_id", file_col: str | None = None) -> DataFrame:
    """V1–V7 as one tidy table ``(check, column, n_bad, detail)``. ``df`` has parsed ``match_date`` (nulls allowed).

    A check whose columns are missing is left out; the missing column has a row of its own. Every bad
    result value is a row (``invalid_value`` with its count), so no list of values is gathered.
    """
    cols = set(df.columns)
    present = [c for c in ESSENTIAL if c in cols]
    aggs, rows = [], [_row("missing_column", c, F.lit(1)) for c in ESSENTIAL if c not in cols]
    for c in present:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null__{c}"))
        rows.append(_row("null_values", c, F.col(f"null__{c}")))
    bad = ~F.col("ftr").isin(VALID_RESULTS) & F.col("ftr").isNotNull() if "ftr" in cols else None
    if bad is not None:
        aggs.append(F.count_if(bad).alias("bad__ftr"))
        rows.append(_row("invalid_result", "ftr", F.col("bad__ftr")))
    for c in ("fthg", "ftag"):
        if c in cols:
            aggs.append(F.count_if(F.col(c) < 0).alias(f"neg__{c}"))
            rows.append(_row("negative_goals", c, F.col(f"neg__{c}")))
    both = df.agg(*(aggs or [F.count(F.lit(1)).alias("rows")]))
    # the other results are single values: attached as scalar subqueries (no join)
    if {"match_date", "home_team", "away_team"} <= cols:
        dup = (df.groupBy("match_date", "home_team", "away_team").count()
               .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("dups")))
        both = both.withColumn("dups", dup.scalar())
        rows.append(_row("duplicates", "match_date,home_team,away_team", F.col("dups")))
    if {"match_date", order_col} <= cols:
        both = both.withColumn("unordered", out_of_order(df, order_col, file_col).scalar())
        rows.append(_row("date_order", "match_date", F.col("unordered")))
    out = both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if bad is not None:
        out = out.unionByName(df.where(bad).groupBy("ftr").agg(F.count(F.lit(1)).alias("n_bad")).select(
            F.lit("invalid_value").alias("check"), F.lit("ftr").alias("column"), "n_bad", F.col("ftr").alias("detail")))
    return out


def validate(df: DataFrame, strict: bool = False, order_col: str = "match_id", file_col: str | None = None) -> DataFrame:
    """V7: the report; with ``strict`` a report with any bad row raises and names the failed checks."""
    report = dq_report(df, order_col, file_col)
    if strict:
        failed = (report.where((F.col("n_bad") > 0) & (F.col("check") != "invalid_value"))
                  .select("check", "column", "n_bad").collect())  # a few rows: one per check and column
        if failed:
            raise ValueError("validation failed: " + "; ".join(f"{r['check']} {r['column']}: {r['n_bad']}" for r in failed))
    return report


def out_of_order(df: DataFrame, order_col: str = "match_id", file_col: str | None = None, bits: int = 20) -> DataFrame:
    """V4: number of rows whose date is earlier than the previous row's in file order.

    Rows are compared inside buckets of 2**bits order values; each bucket then is one row (first and last
    date, rows out of order so far) and buckets are compared inside buckets of buckets, until one is left.
    No window holds more than 2**bits distinct order values, whatever the size of a file.
    """
    keys = [file_col] if file_col else []
    seq = df.select(*keys, F.col(order_col).cast("long").alias("_o"), F.col("match_date").alias("_first"),
                    F.col("match_date").alias("_last"), F.lit(0).cast("long").alias("_bad"))
    for _ in range(-(-64 // bits)):
        seq = seq.withColumn("_b", F.shiftright("_o", bits))
        w = Window.partitionBy(*keys, "_b").orderBy("_o")
        cross = F.coalesce((F.col("_first") < F.lag("_last").over(w)).cast("long"), F.lit(0))
        seq = (seq.withColumn("_bad", F.col("_bad") + cross).groupBy(*keys, "_b")
               .agg(F.min_by("_first", "_o").alias("_first"), F.max_by("_last", "_o").alias("_last"), F.sum("_bad").alias("_bad"))
               .withColumnRenamed("_b", "_o"))
    return seq.agg(F.coalesce(F.sum("_bad"), F.lit(0)).cast("long").alias("unordered"))


def duplicates(df: DataFrame, keys=("match_date", "home_team", "away_team")) -> DataFrame:
    """V5 detail: every duplicated key with its number of extra copies."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1).withColumn("extra", F.col("copies") - 1))


def dedup(df: DataFrame, keys=("match_date", "home_team", "away_team"), order_col: str = "match_id") -> DataFrame:
    """Keep the first copy (lowest ``order_col``) of every key.

    ``row_number() = 1`` is planned with a partial group limit, so every map task sends at most one row of a
    key, even if copies of it are a third of the table."""
    w = Window.partitionBy(*keys).orderBy(order_col)
    return df.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= 1).drop("_copy")


def target_distribution(df: DataFrame, target: str = "ftr") -> DataFrame:
    """V8: count and share of each result."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / total))


PROBABILITIES = ["prob_home_win", "prob_draw", "prob_away_win", "odds_prob_home", "odds_prob_draw", "odds_prob_away"]


def _broken(df: DataFrame):
    """The names of the contract rules that a row breaks; rules of absent columns do not apply."""
    cols = set(df.columns)
    rules = [
        ("goals_negative", (F.col("fthg") < 0) | (F.col("ftag") < 0)),
        ("goals_missing", F.col("fthg").isNull() | F.col("ftag").isNull()),
        ("result_pattern", ~F.coalesce(F.col("ftr").rlike("^[HDA]$"), F.lit(False))),
    ]
    if {"b365h", "b365d", "b365a"} <= cols:
        rules.append(("price_not_above_1", (F.col("b365h") <= 1) | (F.col("b365d") <= 1) | (F.col("b365a") <= 1)))
    rules += [(f"{c}_outside_0_1", (F.col(c) < 0) | (F.col(c) > 1) | F.isnan(c)) for c in PROBABILITIES if c in cols]
    return F.filter(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())


def contract_violations(df: DataFrame) -> DataFrame:
    """Rows breaking the record contract, with the list of broken rules."""
    return df.withColumn("violations", _broken(df)).where(F.size("violations") > 0)


def contract_valid(df: DataFrame) -> DataFrame:
    """Rows that keep the record contract (the same rules, no join)."""
    return df.where(F.size(_broken(df)) == 0)
