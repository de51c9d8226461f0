"""Constants and the small contest fixture that the test modules share."""

import datetime as dt

SF_SMALL = "/root/testdata/sf0.001"

# A 12-row fixture (three teams, shots and prices), in this engine's column names.
SAMPLE = [
    ("2023-08-12", "Arsenal", "Chelsea", 2, 1, "H", 14, 8, 6, 3, 1.80, 3.50, 4.50),
    ("2023-08-19", "Chelsea", "Liverpool", 3, 0, "H", 16, 5, 8, 2, 2.10, 3.40, 3.50),
    ("2023-08-26", "Liverpool", "Arsenal", 1, 1, "D", 10, 12, 4, 5, 2.20, 3.30, 3.30),
    ("2023-09-02", "Arsenal", "Liverpool", 3, 1, "H", 18, 7, 9, 3, 1.70, 3.60, 5.00),
    ("2023-09-16", "Liverpool", "Chelsea", 0, 2, "A", 9, 13, 3, 6, 2.00, 3.50, 3.80),
    ("2023-09-23", "Arsenal", "Chelsea", 1, 1, "D", 11, 10, 4, 4, 1.90, 3.40, 4.20),
    ("2023-10-07", "Liverpool", "Arsenal", 2, 0, "H", 15, 6, 7, 2, 2.30, 3.30, 3.10),
    ("2023-10-21", "Chelsea", "Arsenal", 2, 2, "D", 12, 14, 5, 6, 2.40, 3.30, 3.00),
    ("2023-11-04", "Arsenal", "Liverpool", 1, 0, "H", 13, 9, 5, 4, 1.85, 3.50, 4.30),
    ("2023-11-11", "Liverpool", "Chelsea", 4, 1, "H", 20, 7, 10, 3, 1.90, 3.50, 4.10),
    ("2023-11-25", "Chelsea", "Arsenal", 0, 3, "A", 8, 17, 3, 8, 2.50, 3.30, 2.90),
    ("2023-12-02", "Liverpool", "Arsenal", 2, 1, "H", 14, 11, 6, 5, 2.20, 3.40, 3.20),
]


def sample_contests(spark, extra=()):
    from pyspark.sql import functions as F

    from kickoff.sources.contests import with_season

    rows = [(i + 1, dt.date.fromisoformat(r[0]), "E0", *r[1:]) for i, r in enumerate(list(SAMPLE) + list(extra))]
    df = spark.createDataFrame(rows, "match_id long, match_date date, div string, home_team string, away_team string, "
                               "fthg long, ftag long, ftr string, hs long, aws long, hst long, ast long, "
                               "b365h double, b365d double, b365a double")
    return with_season(df).withColumn("ftr", F.col("ftr"))
