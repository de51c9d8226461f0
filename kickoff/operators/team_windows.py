"""Point-in-time team features over the team-long view (W1–W8 and W7 head-to-head).

Every feature of a row uses only rows of the same key with an earlier date ("strictly prior";
same-day rows never count). All of them come from ONE shuffle on ``(div, team, _blk)``, ONE sort and one vectorised stream over the
sorted rows (``team_sums``) that holds a chunk of rows, not a key:

* every bounded frame "last n rows" is a difference of running sums, O(1) per row, and integer sums stay exact;
* the day's first row sees exactly the rows dated before that day; the other rows of the day take its answer;
* venue form looks at the rows of a key by ``is_home`` and head-to-head by ``opponent`` (a team's
  rows against one opponent are all meetings of that pair, in both orientations, seen from the
  team) — inside the same stream, without a sort or an exchange of their own;
* season-to-date sums and streaks are running values; with several time blocks per key the
  earlier blocks enter through small block tables (``operators.blocked``), so a hot key is
  split across tasks;
* the stream gives integer sums only; ratios and rules are column expressions, computed where they are selected.

Only rest days (W8) keep row-order semantics, like the reference's EDA job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocked import BLOCK, HALO, block_prefix, dealt, single_block, with_block, with_halo
from .team_sums import RUNS, SEASON, raw_columns, team_sums

# Default window sizes and decay (reference defaults).
FORM_WINDOWS = (3, 5, 10)
EXP_DECAY = 0.7
EXP_WINDOW = 5
VENUE_WINDOW = 5
SHOOTING_WINDOW = 10
H2H_WINDOW = 10
SEASON_MIN_PLAYED = 3
SEASON_FALLBACK = 10

GROUPS = ("form", "exp", "venue", "streaks", "season", "shooting", "h2h", "rest")

KEY = ["div", "team"]
TARGET_ROWS = 1_000_000  # rows of a key that one stream takes in turn (it holds a chunk of them)
_UNB = Window.unboundedPreceding
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def exp_weights(decay: float = EXP_DECAY, n: int = EXP_WINDOW) -> list[float]:
    """Weight of the k-th most recent row (k = 1..n) is ``decay ** (k-1)``."""
    return [decay ** (k - 1) for k in range(1, n + 1)]


def _ratio(num: Column, den: Column) -> Column:
    """``num/den`` as double; null when the frame held no rows."""
    return F.when(den > 0, num.cast("double") / den)


def _breaks() -> dict:
    """Row that ends each run: not a win / a loss / not a loss."""
    return {"win_streak": F.col("win") == 0, "unbeaten_streak": F.col("loss") == 1,
            "loss_streak": F.col("loss") == 0}


# The stream order (season_start, match_date, match_id) equals (match_date, match_id), because a
# season start is a monotone function of the date.
SORT = ("season_start", "match_date", "match_id")


def team_features(tl: DataFrame, width: int, groups=GROUPS, form_windows=FORM_WINDOWS,
                  decay: float = EXP_DECAY, inclusive: bool = False) -> DataFrame:
    """Per team-long row, the point-in-time features of the requested ``groups``.

    ``width`` is the block width from :func:`blocked.block_width` (``1 << 20`` = one block).
    ``inclusive=True`` gives instead the state *after* each row (the row itself counts, no day
    propagation) — the input of the as-of lookup for contests that are not in the history.
    """
    groups = set(groups) - ({"rest"} if inclusive else set())
    depth = max([*(form_windows if "form" in groups else ()),
                 EXP_WINDOW if "exp" in groups else 0,
                 SHOOTING_WINDOW if "shooting" in groups else 0,
                 SEASON_FALLBACK if "season" in groups else 0,
                 1 if "rest" in groups else 0, 1])
    streams = {"team": (KEY, depth)}
    if "venue" in groups:
        streams["venue"] = (KEY + ["is_home"], VENUE_WINDOW)
    if "h2h" in groups:
        streams["h2h"] = (KEY + ["opponent"], H2H_WINDOW)

    base = with_block(tl, width)
    full = with_halo(base, streams, width)
    # the one shuffle and the one sort. With one block ``_blk`` is a literal, so it must not be part of the exchange.
    full = full.repartition(*KEY) if single_block(width) else dealt(full, KEY + [BLOCK], tl.count())
    carry = list(base.columns)
    raw = raw_columns(groups, form_windows, SEASON_FALLBACK)
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, _TYPES[t]) for c, t in raw]])
    full = full.sortWithinPartitions(*KEY, BLOCK, *SORT).mapInArrow(
        team_sums(carry, [*KEY, BLOCK], HALO, groups, tuple(form_windows), exp_weights(decay),
                  {"season": SEASON_FALLBACK, "shooting": SHOOTING_WINDOW, "venue": VENUE_WINDOW, "h2h": H2H_WINDOW},
                  {name: n for name, (_, n) in streams.items()}, inclusive), schema)

    out: list[str] = []

    def add(values: dict[str, Column]) -> None:
        nonlocal full
        full = full.withColumns(values)
        out.extend(values)

    def seen(n: int) -> Column:
        return F.least(F.col("_n"), F.lit(n))

    if "form" in groups:
        for n in form_windows:
            cnt, gf, ga = seen(n), F.col(f"_f{n}_gf"), F.col(f"_f{n}_ga")
            add({f"form{n}_points": F.when(cnt > 0, F.col(f"_f{n}_points")), f"form{n}_win_rate": _ratio(F.col(f"_f{n}_win"), cnt),
                 f"form{n}_goal_diff": F.when(cnt > 0, gf - ga), f"form{n}_avg_goals_for": _ratio(gf, cnt),
                 f"form{n}_avg_goals_against": _ratio(ga, cnt)})
    if "exp" in groups:
        out.append("exp_form")
    if "shooting" in groups:
        nv, shots, sot, sotn, goals = (F.col(f"_s_{m}") for m in ("nv", "shots", "sot", "sotn", "goals"))
        add({"avg_shots": _ratio(shots, nv), "avg_sot": F.when(sotn > 0, _ratio(sot, nv)),
             "shot_accuracy": F.when(nv > 0, _ratio(sot, shots)), "shot_conversion": F.when(nv > 0, _ratio(goals, shots))})
    if "rest" in groups:
        # Row-order semantics on purpose: a second contest on the same day has 0 rest days.
        out.append("rest_days")
    if "streaks" in groups:
        full = _streaks(full, base, width)
        out += list(RUNS)
    if "season" in groups:
        full, values = _season(full.withColumn("_fb_n", seen(SEASON_FALLBACK)), base, width, inclusive)
        add(values)
    if "venue" in groups:
        cnt = F.least(F.col("_v_n"), F.lit(VENUE_WINDOW))
        add({"venue_win_rate": _ratio(F.col("_v_win"), cnt), "venue_avg_goals_for": _ratio(F.col("_v_gf"), cnt),
             "venue_avg_goals_against": _ratio(F.col("_v_ga"), cnt), "venue_clean_sheets": _ratio(F.col("_v_clean_sheet"), cnt)})
    if "h2h" in groups:
        cnt = F.least(F.col("_h_n"), F.lit(H2H_WINDOW))
        add({"h2h_played": cnt.cast("long"), "h2h_win_rate": _ratio(F.col("_h_win"), cnt), "h2h_avg_gf": _ratio(F.col("_h_gf"), cnt)})
    return full.select(*tl.columns, *[c for c in out if c not in tl.columns])


def _season(full: DataFrame, base: DataFrame, width: int, raw: bool) -> tuple[DataFrame, dict[str, Column]]:
    """Season-to-date (day values ``_sn_*``) plus earlier blocks of the same season; fewer
    than 3 → the last 10 rows of any season (``_fb_*``). ``raw`` keeps the sums (``sn_*``,
    ``fb_*``) instead, for an as-of lookup that applies the season test at another date."""
    pref = block_prefix(base, KEY + ["season_start"],
                        {"_o_n": F.lit(1), "_o_win": F.col("win"), "_o_pts": F.col("points"), "_o_gf": F.col("gf"),
                         "_o_ga": F.col("ga"), "_o_cs": F.col("clean_sheet")}, width)
    if pref is not None:
        full = full.join(pref, KEY + ["season_start", BLOCK], "left")
        for m in SEASON:
            full = full.withColumn(f"_sn_{m}", F.col(f"_sn_{m}") + F.coalesce(F.col(f"_o_{m}"), F.lit(0)))
    if raw:
        return full, {**{f"sn_{m}": F.col(f"_sn_{m}") for m in SEASON}, **{f"fb_{m}": F.col(f"_fb_{m}") for m in SEASON}}
    s_n = F.col("_sn_n")
    use = s_n >= SEASON_MIN_PLAYED

    def pick(m: str):
        return F.when(use, _ratio(F.col(f"_sn_{m}"), s_n)).otherwise(_ratio(F.col(f"_fb_{m}"), F.col("_fb_n")))

    return full, {"season_played": F.when(use, s_n).otherwise(F.col("_fb_n")).cast("long"),
                  "season_win_rate": pick("win"), "season_ppg": pick("pts"), "season_avg_goals_for": pick("gf"),
                  "season_avg_goals_against": pick("ga"), "season_clean_sheets": pick("cs")}


def _streaks(full: DataFrame, base: DataFrame, width: int) -> DataFrame:
    """Run entering each row: rows of the block since its last breaking row (``_run_*``). With several blocks a row with no break
    earlier in its block (``_open_*``) adds the run carried into the block, from the block table:
    ``carried = rows_before_block - position_of_last_break_before_block``.
    """
    brks = _breaks()
    if single_block(width):
        return full.withColumns({s: F.col("_run_" + s) for s in brks})
    turn = F.row_number().over(Window.partitionBy(*KEY, BLOCK).orderBy(*SORT))
    rows = base.select(*KEY, BLOCK, "win", "loss", turn.alias("_rn_row"))
    blocks = rows.groupBy(*KEY, BLOCK).agg(F.count(F.lit(1)).alias("_c"), *[F.max(F.when(b, F.col("_rn_row"))).alias("_m_" + s) for s, b in brks.items()])
    bw = Window.partitionBy(*KEY).orderBy(BLOCK).rowsBetween(_UNB, -1)
    blocks = blocks.withColumn("_cum", F.coalesce(F.sum("_c").over(bw), F.lit(0)))
    cols = [*KEY, BLOCK]
    for s in brks:
        p = F.last(F.col("_cum") + F.col("_m_" + s), ignorenulls=True).over(bw)
        cols.append((F.col("_cum") - F.coalesce(p, F.lit(0))).alias("_carry_" + s))
    full = full.join(blocks.select(*cols), KEY + [BLOCK], "left")
    return full.withColumns({s: F.col("_run_" + s) + F.when(F.col("_open_" + s), F.coalesce(F.col("_carry_" + s), F.lit(0))).otherwise(F.lit(0)) for s in brks})
