"""Per-season raw files (S1–S7) and the wide standings file.

Raw history arrives as one CSV folder per season whose header set drifts between seasons. A
single ``spark.read.csv(all files)`` binds columns by *position* and silently swaps them when
headers differ, so the scan:

1. lists the files on the driver (metadata only) and keeps season folders whose label starts
   with two digits and does not name a standings/final/test file (S1's naming rule);
2. reads the header line of each file in one distributed job and groups files by header;
3. issues one ``spark.read.schema(...).csv(paths)`` per header group with an explicit schema,
   tags rows with the season taken from the file path (S2), and
4. ``unionByName(allowMissingColumns=True)`` the groups (S3).

The files themselves are written by Spark from the driver's tables (``write_season_files``),
so the scan's work grows with them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path

# Column types of known raw columns; anything else is read as text.
KNOWN_TYPES = {
    "match_id": T.LongType(), "fthg": T.IntegerType(), "ftag": T.IntegerType(),
    "hs": T.IntegerType(), "aws": T.IntegerType(), "hst": T.IntegerType(), "ast": T.IntegerType(),
    "b365h": T.DoubleType(), "b365d": T.DoubleType(), "b365a": T.DoubleType(),
}
EXCLUDE_WORDS = ("Standing", "final", "test")
CORRUPT = "_corrupt"
SEASON_RE = r"season=([^/]+)/"
SHOT_COLS = ["hs", "aws", "hst", "ast"]
PRICE_COLS = ["b365h", "b365d", "b365a"]
DRIFT_BEFORE = "1998"   # seasons starting before this year were recorded without shots and prices


def write_season_files(raw: DataFrame, root: str) -> None:
    """One CSV folder per season; old seasons lack shot and price columns (header drift)."""
    old = raw.where(F.substring("season", 1, 4) < DRIFT_BEFORE).drop(*SHOT_COLS, *PRICE_COLS)
    new = raw.where(F.substring("season", 1, 4) >= DRIFT_BEFORE)
    for part, df in (("a", old), ("b", new)):
        (df.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
           .option("ignoreTrailingWhiteSpace", False).partitionBy("season")
           .csv(f"{root}/{part}"))


def _keep(path: str) -> bool:
    """S1 naming rule on the season label and file name only (not on parent folders)."""
    m = re.search(SEASON_RE, path)
    name = path.rsplit("/", 1)[-1]
    label = m.group(1) if m else name.rsplit(".", 1)[0]
    return label[:2].isdigit() and not any(w in label or w in name for w in EXCLUDE_WORDS)


def header_groups(spark: SparkSession, root: str) -> dict[str, list[str]]:
    """Files by header line. The first line of every file is read by a distributed job (one task per group of
    files); only (header, path) pairs reach the driver, which has to name the paths to read anyway."""
    first = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("wholetext", False).text(root)
             .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                     F.monotonically_increasing_id().alias("n"))
             .where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("header")))
    groups: dict[str, list[str]] = {}
    for r in first.orderBy("path").collect():
        if _keep(r["path"]):
            groups.setdefault(r["header"], []).append(r["path"])
    return groups


def scan_season_files(spark: SparkSession, root: str) -> DataFrame:
    """Schema-drift-safe scan of every season file under ``root``. A line that does not fit the header is
    kept, with the text in ``_corrupt`` (``cleaning_report`` counts such lines)."""
    groups = header_groups(spark, root)
    if not groups:
        raise FileNotFoundError(f"no season files under {root}")
    parts = []
    for header, paths in sorted(groups.items()):
        names = [h.strip() for h in header.split(",")]
        schema = T.StructType([T.StructField(n, KNOWN_TYPES.get(n, T.StringType()), True) for n in names]
                              + [T.StructField(CORRUPT, T.StringType(), True)])
        df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).csv(paths)
              .withColumn("season", F.regexp_extract(F.col("_metadata.file_path"), SEASON_RE, 1)))
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def season_scan(spark: SparkSession, sf_dir: str, raw: DataFrame) -> DataFrame:
    """S7 first half: write ``raw`` as drifting season files and scan them back."""
    root = fresh_path(spark, "seasons")
    write_season_files(raw, root)
    return scan_season_files(spark, root)


# ---------------------------------------------------------------- S4 standings
def final_tables(contests: DataFrame) -> DataFrame:
    """End-of-season position of every team (points, goal difference, goals for, then name)."""
    side = F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("fthg").alias("gf"), F.col("ftag").alias("ga"),
                 F.when(F.col("ftr") == "H", 3).when(F.col("ftr") == "D", 1).otherwise(0).alias("pts")),
        F.struct(F.col("away_team").alias("team"), F.col("ftag").alias("gf"), F.col("fthg").alias("ga"),
                 F.when(F.col("ftr") == "A", 3).when(F.col("ftr") == "D", 1).otherwise(0).alias("pts"))))
    end_year = (F.year("season_start") + 1).cast("string")
    t = (contests.select("div", end_year.alias("season_end"), side.alias("s"))
         .groupBy("div", "season_end", "s.team")
         .agg(F.sum("s.pts").alias("pts"), F.sum(F.col("s.gf") - F.col("s.ga")).alias("gd"), F.sum("s.gf").alias("gf")))
    w = Window.partitionBy("div", "season_end").orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "team")
    return t.withColumn("position", F.row_number().over(w)).select("div", "team", "season_end", "position")


def write_standings(tables: DataFrame, root: str) -> list[str]:
    """Wide file ``Team × season-end year → position`` (one row per team, one column per year)."""
    years = sorted(r[0] for r in tables.select("season_end").distinct().collect())  # one label per season
    wide = tables.groupBy("div", "team").pivot("season_end", years).agg(F.first("position"))
    wide.write.option("header", True).csv(root)
    return years


def standings_long(spark: SparkSession, root: str) -> DataFrame:
    """Wide standings → ``(div, team, season_end, position)``; blanks dropped (D1 rule)."""
    raw = spark.read.option("header", True).csv(root)
    seasons = [c for c in raw.columns if c[:2].isdigit()]
    if not seasons:
        return spark.createDataFrame([], "div string, team string, season_end string, position int")
    long = raw.unpivot(["div", "team"], seasons, "season_end", "position")
    return (long.where(F.col("position").isNotNull() & (F.trim("position") != ""))
            .withColumn("position", F.col("position").cast("int")))


def standings_from_contests(spark: SparkSession, sf_dir: str, contests: DataFrame) -> DataFrame:
    root = fresh_path(spark, "standings")
    write_standings(final_tables(contests), root)
    return standings_long(spark, root)
