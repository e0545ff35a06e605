"""Rolling form, rest and congestion: the season-local team-day state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import day, points
from pairlab.operators import history as H

ORDER = ("HomeTeam", "AwayTeam")


def team_sides(matches: DataFrame, stats: bool = True) -> DataFrame:
    """One row per team and match, seen from the team: points, and statistics for and against."""
    pairs = {
        "team": (F.col("HomeTeam"), F.col("AwayTeam")),
        "points": (points(F.col("FTR"), "H", "A"), points(F.col("FTR"), "A", "H")),
    }
    if stats:
        for stat in S.ROLLED_STATS:
            source = "FT" if stat == "Goals" else ""
            h, a = (
                (F.col("FTHome"), F.col("FTAway"))
                if source
                else (F.col(f"Home{stat}"), F.col(f"Away{stat}"))
            )
            pairs[f"{stat}_for"] = (h, a)
            pairs[f"{stat}_against"] = (a, h)
    return H.sides(matches, ["Division", "SeasonStartYear", "MatchDate", *ORDER], pairs)


def context_state(matches: DataFrame) -> DataFrame:
    """Per (team, day): days since the last match, matches in the last 14 days, match number."""
    narrow = matches.select("Division", "SeasonStartYear", "MatchDate", "HomeTeam", "AwayTeam")
    teams = H.sides(
        narrow,
        ["Division", "SeasonStartYear", "MatchDate"],
        {"team": (F.col("HomeTeam"), F.col("AwayTeam"))},
    )
    daily = H.day_counts(teams, H.TEAM, "MatchDate")
    before = H.days_before(H.TEAM, "MatchDate")
    recent = H.days_before(H.TEAM, "MatchDate", 13)
    return daily.select(
        *H.TEAM,
        "MatchDate",
        (day(F.col("MatchDate")) - F.max(day(F.col("MatchDate"))).over(before))
        .cast("double")
        .alias("DaysSinceLast"),
        F.coalesce(F.sum("day_n").over(recent), F.lit(0)).cast("bigint").alias("Matches14d"),
        F.coalesce(F.sum("day_n").over(before), F.lit(0)).cast("bigint").alias("TeamMatchNum"),
    )


def tail_state(matches: DataFrame, stats: bool = True, form: bool = True) -> DataFrame:
    """Per (team, day): rolling statistics and points form over the last three and five matches.

    A missing value keeps its place in the window but is left out of the mean.
    """
    rows = team_sides(matches, stats)
    means = {}
    if stats:
        for stat, windows in S.ROLLED_STATS.items():
            for k in windows:
                means[f"{stat}ForAvg{k}"] = (f"{stat}_for", k)
                means[f"{stat}AgainstAvg{k}"] = (f"{stat}_against", k)
    if form:
        means |= {"Form3": ("points", 3), "Form5": ("points", 5)}
    state = H.means_before(rows, H.TEAM, "MatchDate", ORDER, means)
    if not stats:
        return state
    return state.select(
        "*",
        *[
            (F.col(f"GoalsForAvg{k}") - F.col(f"GoalsAgainstAvg{k}")).alias(f"GoalDiffAvg{k}")
            for k in S.ROLLED_STATS["Goals"]
        ],
    )


def expected_matches(table: dict[str, int], division="Division"):
    """Season length of a division, NULL when unknown. The table is a handful of fixed rows."""
    if not table:
        return F.lit(None).cast("int")
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(division))


def context_columns(expected: dict[str, int] = S.EXPECTED_TEAM_MATCHES) -> list:
    """Match-row context features from the joined home and away state."""
    progress = F.col("TeamMatchNum_H") / expected_matches(expected)
    made = {
        "RestDiff_pre": F.col("DaysSinceLast_H") - F.col("DaysSinceLast_A"),
        "SeasonProgress_pre": progress.cast("double"),
        "Form3Home_pre": F.col("Form3_H"),
        "Form5Home_pre": F.col("Form5_H"),
        "Form3Away_pre": F.col("Form3_A"),
        "Form5Away_pre": F.col("Form5_A"),
        "Form5Diff_pre": F.col("Form5_H") - F.col("Form5_A"),
    }
    return [
        (made[c] if c in made else F.col(c.removesuffix("_pre"))).alias(c)
        for c in S.CONTEXT_FEATURES
    ]


def rolling_columns() -> list:
    return [F.col(c.removesuffix("_pre")).alias(c) for c in S.ROLLING_FEATURES]


def add_rolling_features(matches: DataFrame) -> DataFrame:
    """Attach the 36 rolling features."""
    state = tail_state(matches, form=False)
    joined = H.join_sides(matches, state, [b for b, *_ in S.rolling_bases()])
    return joined.select(*matches.columns, *rolling_columns())


def add_context_features(
    matches: DataFrame, expected: dict[str, int] = S.EXPECTED_TEAM_MATCHES
) -> DataFrame:
    """Attach the 13 rest, congestion, progress and points-form features."""
    form = tail_state(matches.drop(*S.COUNT_COLUMNS), stats=False)
    state = context_state(matches).join(form.hint("merge"), [*H.TEAM, "MatchDate"])
    names = ["DaysSinceLast", "Matches14d", "TeamMatchNum", "Form3", "Form5"]
    return H.join_sides(matches, state, names).select(
        *matches.columns, *context_columns(expected)
    )
