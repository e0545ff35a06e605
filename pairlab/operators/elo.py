"""Date-batched Elo ratings.

A rating feeds the next date's expectation through a logistic, so there is no window form: the
dates of one division are inherently sequential, and divisions run in parallel. Rows are sorted by
division and date within tasks and replayed as a stream. A task holds the ratings of one division
and one batch of matches, however many matches the division has.

The output is a state row per (division, season, team, day) that played, holding the rating every
match of that day reads.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.operators import history as H

# Rating parameters.
START = 1500.0
K_FACTOR = 40.0
HOME_ADVANTAGE = 60.0
SEASON_REVERSION = 0.30

STATE = "Division string, SeasonStartYear bigint, MatchDate date, team string, Elo double"


def expected_home_score(home, away, advantage: float = HOME_ADVANTAGE):
    """Expected home score; works on columns, arrays and numbers alike."""
    gap = (away - (home + advantage)) / 400.0
    if isinstance(gap, Column):
        return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), gap))
    return 1.0 / (1.0 + 10.0**gap)


def _replay(start: float, k: float, advantage: float, reversion: float):
    """Replay rows that come sorted by division and date, wherever a batch ends.

    Ratings move only when a date is over: ``moves`` holds what its teams have won and lost so far,
    and a team's first match of a date puts out the rating that all its matches of the date read.
    """

    def run(batches):
        at_division = at_day = at_season = None
        rating: dict[str, float] = {}
        moves: dict[str, float] = {}
        for batch in batches:
            division, season, _, home, away, score = (c.to_pylist() for c in batch.columns)
            days = batch.column(2).cast(pa.int32()).to_pylist()
            rows, teams, ratings = [], [], []
            for i, day in enumerate(days):
                if division[i] != at_division:
                    rating, moves = {}, {}
                    at_division, at_day, at_season = division[i], day, season[i]
                elif day != at_day:
                    for team, move in moves.items():
                        rating[team] += move
                    moves, at_day = {}, day
                    if season[i] != at_season:
                        at_season = season[i]
                        rating = {t: r * (1.0 - reversion) + start * reversion for t, r in rating.items()}
                elif season[i] != at_season:
                    raise ValueError("one division and date spans two seasons")
                for team in (home[i], away[i]):
                    if team not in moves:
                        moves[team] = 0.0
                        rows.append(i)
                        teams.append(team)
                        ratings.append(rating.setdefault(team, start))
                change = k * (score[i] - expected_home_score(rating[home[i]], rating[away[i]], advantage))
                moves[home[i]] += change
                moves[away[i]] -= change
            at = pa.array(rows, pa.int32())
            held = [batch.column(j).take(at) for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array(teams, pa.string()), pa.array(ratings, pa.float64())],
                names=["Division", "SeasonStartYear", "MatchDate", "team", "Elo"],
            )

    return run


def elo_state(
    matches: DataFrame,
    start: float = START,
    k: float = K_FACTOR,
    advantage: float = HOME_ADVANTAGE,
    reversion: float = SEASON_REVERSION,
) -> DataFrame:
    """Pre-match rating per (division, season, team, day)."""
    if not 0.0 <= reversion <= 1.0:
        raise ValueError("season reversion must lie in [0, 1]")
    if k < 0.0:
        raise ValueError("the K factor must not be negative")
    result = F.col("FTR")
    score = (
        F.when(result == "H", 1.0)
        .when(result == "D", 0.5)
        .when(result == "A", 0.0)
        .otherwise(F.raise_error(F.lit("a rated match has a result outside H, D and A")).cast("double"))
    )
    order = ["MatchDate", "HomeTeam", "AwayTeam"]
    games = matches.select(
        "Division", F.col("SeasonStartYear").cast("bigint"), *order, score.alias("score")
    )
    return (
        games.repartition("Division")
        .sortWithinPartitions("Division", *order)
        .mapInArrow(_replay(start, k, advantage, reversion), STATE)
        .select(*H.TEAM, "MatchDate", "Elo")
    )


def add_elo_features(matches: DataFrame, **parameters) -> DataFrame:
    """Attach home rating, away rating and their difference."""
    S.require_columns(matches, [*S.METADATA], "rating source")
    state = elo_state(matches, **parameters)
    return H.join_sides(matches, state, ["Elo"]).select(*matches.columns, *elo_columns())


def elo_columns() -> list:
    home, away = F.col("Elo_H"), F.col("Elo_A")
    return [
        c.alias(n) for c, n in zip((home, away, home - away), S.ELO_FEATURES, strict=True)
    ]
