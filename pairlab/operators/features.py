"""The complete 63-column feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.operators import elo, form
from pairlab.operators import history as H
from pairlab.operators.labels import known_results, label_columns


def team_day_state(matches: DataFrame, **elo_parameters) -> DataFrame:
    """Everything known about a team before a day: one row per (division, season, team, day).

    Each part grows with the matches, so none is broadcast.
    """
    key = [*H.TEAM, "MatchDate"]
    return (
        form.tail_state(matches)
        .join(form.context_state(matches).hint("merge"), key)
        .join(elo.elo_state(matches, **elo_parameters).hint("merge"), key)
    )


def build_feature_table(
    matches: DataFrame,
    expected: dict[str, int] = S.EXPECTED_TEAM_MATCHES,
    **elo_parameters,
) -> DataFrame:
    """Metadata, targets and the 52 pre-match features of every match.

    Team state is computed once and joined to matches twice. Rows come back unordered; the
    partitioned sink sorts them.
    """
    S.require_columns(matches, S.CANONICAL, "match table")
    matches = matches.select(*S.CANONICAL)
    state = team_day_state(matches, **elo_parameters)
    carried = [c for c in state.columns if c not in (*H.TEAM, "MatchDate")]
    labelled = known_results(matches).select(*S.METADATA, *label_columns())
    joined = H.join_sides(labelled, state, carried)
    return joined.select(
        *S.METADATA,
        *S.TARGETS,
        *elo.elo_columns(),
        *form.context_columns(expected),
        *form.rolling_columns(),
    )


def build_feature_table_from_parquet(spark, directory: str, **parameters) -> DataFrame:
    """Features straight from stored match partitions."""
    from pairlab.sources.files import read_canonical

    return build_feature_table(read_canonical(spark, directory), **parameters)
