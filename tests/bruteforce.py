"""Slow, obviously-correct per-row implementations of the point-in-time rules (test oracle)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def team_long_pd(c: pd.DataFrame) -> pd.DataFrame:
    h = pd.DataFrame({"match_id": c.match_id, "match_date": c.match_date, "div": c["div"],
                      "team": c.home_team, "opponent": c.away_team, "is_home": True,
                      "gf": c.fthg, "ga": c.ftag, "sf": c.hs, "sot": c.hst, "ftr": c.ftr})
    a = pd.DataFrame({"match_id": c.match_id, "match_date": c.match_date, "div": c["div"],
                      "team": c.away_team, "opponent": c.home_team, "is_home": False,
                      "gf": c.ftag, "ga": c.fthg, "sf": c.aws, "sot": c.ast, "ftr": c.ftr})
    t = pd.concat([h, a], ignore_index=True)
    t["match_date"] = pd.to_datetime(t["match_date"])
    t["result"] = np.where(t.ftr == "D", "D", np.where((t.ftr == "H") == t.is_home, "W", "L"))
    t["points"] = t.result.map({"W": 3, "D": 1, "L": 0})
    return t.sort_values(["div", "team", "match_date", "match_id"]).reset_index(drop=True)


def season_start(d) -> pd.Timestamp:
    d = pd.Timestamp(d)
    return pd.Timestamp(d.year if d.month >= 8 else d.year - 1, 8, 1)


def features_pd(t: pd.DataFrame) -> pd.DataFrame:
    """Per team-long row: form5, exp_form, venue, streaks, season, shooting, h2h."""
    out = []
    for (_, _), g in t.groupby(["div", "team"], sort=False):
        g = g.reset_index(drop=True)
        dates = g.match_date.values
        for i in range(len(g)):
            r = g.iloc[i]
            prior = g[dates < dates[i]]
            f = {"match_id": r.match_id, "team": r.team}
            p5 = prior.tail(5)
            f["form5_points"] = p5.points.sum() if len(p5) else None
            f["form5_win_rate"] = (p5.result == "W").mean() if len(p5) else None
            f["form5_avg_goals_for"] = p5.gf.mean() if len(p5) else None
            if len(p5):
                w = np.array([0.7 ** k for k in range(len(p5) - 1, -1, -1)])
                f["exp_form"] = np.average(p5.points.values, weights=w)
            else:
                f["exp_form"] = None
            v = prior[prior.is_home == r.is_home].tail(5)
            f["venue_win_rate"] = (v.result == "W").mean() if len(v) else None
            f["venue_clean_sheets"] = (v.ga == 0).mean() if len(v) else None
            res = prior.result.values[::-1]
            for name, ok in (("win_streak", {"W"}), ("unbeaten_streak", {"W", "D"}), ("loss_streak", {"L"})):
                n = 0
                for x in res:
                    if x in ok:
                        n += 1
                    else:
                        break
                f[name] = n
            ss = season_start(dates[i])
            sm = prior[prior.match_date >= ss]
            if len(sm) < 3:
                sm = prior.tail(10)
            f["season_played"] = len(sm)
            f["season_ppg"] = sm.points.mean() if len(sm) else None
            f["season_win_rate"] = (sm.result == "W").mean() if len(sm) else None
            p10 = prior.tail(10)
            valid = p10[p10.sf > 0]
            if len(valid):
                f["avg_shots"] = valid.sf.mean()
                f["shot_accuracy"] = valid.sot.sum() / valid.sf.sum()
            else:
                f["avg_shots"] = None
                f["shot_accuracy"] = None
            hh = prior[prior.opponent == r.opponent].tail(10)
            f["h2h_played"] = len(hh)
            f["h2h_win_rate"] = (hh.result == "W").mean() if len(hh) else None
            f["h2h_avg_gf"] = hh.gf.mean() if len(hh) else None
            out.append(f)
    return pd.DataFrame(out)


def compare(a: pd.DataFrame, b: pd.DataFrame, keys, cols, tol=1e-12) -> list[str]:
    m = a.merge(b, on=keys, suffixes=("_a", "_b"))
    assert len(m) == len(a) == len(b), (len(m), len(a), len(b))
    bad = []
    for c in cols:
        x, y = m[c + "_a"], m[c + "_b"]
        for xi, yi in zip(x, y):
            nx = xi is None or (isinstance(xi, float) and math.isnan(xi))
            ny = yi is None or (isinstance(yi, float) and math.isnan(yi))
            if nx and ny:
                continue
            if nx != ny or abs(float(xi) - float(yi)) > tol:
                bad.append(f"{c}: {xi} vs {yi}")
                break
    return bad
