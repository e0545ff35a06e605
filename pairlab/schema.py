"""Table contracts: column names, types and the fixed values that define them."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, their order and the labels are part of the data contract.
KEY = ("MatchDate", "Division", "HomeTeam", "AwayTeam")
CLASSES = ("H", "D", "A")
IDENTIFIERS = ("MatchDate", "SeasonStartYear", "Division", "HomeTeam", "AwayTeam")
OUTCOMES = ("FTR", "FTHome", "FTAway")
# statistic -> the two windows it is averaged over
ROLLED_STATS = {
    "Goals": (3, 5),
    "Shots": (5,),
    "Target": (5,),
    "Corners": (5,),
    "Fouls": (5,),
    "Yellow": (5,),
    "Red": (5,),
}
PROBABILITIES = ("probability_home", "probability_draw", "probability_away")
TARGETS = ("target_1x2", "target_home_win", "target_draw", "target_away_win", "target_ou25")
ELO_FEATURES = ("HomeElo_pre", "AwayElo_pre", "EloDiff_pre")
CONTEXT_FEATURES = (
    "DaysSinceLast_H_pre",
    "DaysSinceLast_A_pre",
    "RestDiff_pre",
    "Matches14d_H_pre",
    "Matches14d_A_pre",
    "TeamMatchNum_H_pre",
    "TeamMatchNum_A_pre",
    "SeasonProgress_pre",
    "Form3Home_pre",
    "Form5Home_pre",
    "Form3Away_pre",
    "Form5Away_pre",
    "Form5Diff_pre",
)
SOURCE_ALIASES = {
    "Date": "MatchDate",
    "Div": "Division",
    "FTHG": "FTHome",
    "FTAG": "FTAway",
    "HS": "HomeShots",
    "AS": "AwayShots",
    "HST": "HomeTarget",
    "AST": "AwayTarget",
    "HC": "HomeCorners",
    "AC": "AwayCorners",
    "HF": "HomeFouls",
    "AF": "AwayFouls",
    "HY": "HomeYellow",
    "AY": "AwayYellow",
    "HR": "HomeRed",
    "AR": "AwayRed",
}
MARKET_CANDIDATES = {
    "MatchDate": ("MatchDate", "Date"),
    "Division": ("Division", "Div"),
    "HomeTeam": ("HomeTeam",),
    "AwayTeam": ("AwayTeam",),
    "ClosingHomeOdds": ("ClosingHomeOdds", "AvgCH"),
    "ClosingDrawOdds": ("ClosingDrawOdds", "AvgCD"),
    "ClosingAwayOdds": ("ClosingAwayOdds", "AvgCA"),
}
DIVISION_NAMES = {
    "E0": "Premier League",
    "SP1": "La Liga",
    "I1": "Serie A",
    "D1": "Bundesliga",
    "F1": "Ligue 1",
    "B1": "Belgian Pro League",
    "N1": "Eredivisie",
    "E1": "Championship",
    "P1": "Primeira Liga",
}
SEASON_CODES = {
    "1920": 2019,
    "2021": 2020,
    "2122": 2021,
    "2223": 2022,
    "2324": 2023,
    "2425": 2024,
    "2526": 2025,
}
EXPECTED_TEAM_MATCHES = {
    "E0": 38,
    "SP1": 38,
    "I1": 38,
    "D1": 34,
    "F1": 34,
    "N1": 34,
    "P1": 34,
    "E1": 46,
    "B1": 34,
}
XG_DIVISIONS = ("D1", "E0", "F1", "I1", "SP1")
XG_COLUMNS = ("Division", "MatchDate", "HomeTeam", "AwayTeam", "home_xg", "away_xg")
DEVELOPMENT_YEARS = (2022, 2023, 2024)
FINAL_YEAR = 2025
FIXTURE_COLUMNS = (
    "Division",
    "SeasonStartYear",
    "MatchDate",
    "HomeTeam",
    "AwayTeam",
    "game_id",
    "home_club_id",
    "away_club_id",
)
APPEARANCE_COLUMNS = ("game_id", "player_id", "player_club_id", "minutes_played")
LINEUP_COLUMNS = ("game_id", "player_id", "club_id", "type")
VALUATION_COLUMNS = ("player_id", "date", "market_value_in_eur")
LINEUP_ROLES = ("starting_lineup", "substitutes")
AVAILABILITY_BASE = (
    "matches_30d",
    "minutes_7d",
    "minutes_14d",
    "minutes_21d",
    "minutes_30d",
    "days_since_prev_match",
    "unique_players_5",
    "unique_players_10",
    "unique_starters_5",
    "top5_minutes_share_5",
    "top11_minutes_share_5",
    "top11_minutes_share_10",
    "avg_player_minutes_5",
    "starter_overlap_last",
    "starter_jaccard_last",
    "rotation_index_last",
    "avg_starter_changes_5",
    "recent_players_value_sum_5",
    "recent_top11_value_sum_5",
    "last_starters_value_sum",
    "recent_value_coverage_5",
)

# Names that follow from the values above.
MATCH_STATS = tuple(f"{side}{stat}" for stat in list(ROLLED_STATS)[1:] for side in ("Home", "Away"))
COUNT_COLUMNS = ("FTHome", "FTAway", *MATCH_STATS)
CANONICAL = (*IDENTIFIERS, *OUTCOMES, *MATCH_STATS)
METADATA = (*IDENTIFIERS, "FTR")
ODDS = tuple(c for c in MARKET_CANDIDATES if c.endswith("Odds"))
MARKET_COLUMNS = (*KEY, *ODDS)


def rolling_bases() -> list[tuple[str, str, str, int]]:
    """(feature base, statistic, kind, window), kind being For, Against or Diff."""
    out = []
    for stat, windows in ROLLED_STATS.items():
        for k in windows:
            out.append((f"{stat}ForAvg{k}", stat, "For", k))
            out.append((f"{stat}AgainstAvg{k}", stat, "Against", k))
            if stat == "Goals":
                out.append((f"GoalDiffAvg{k}", stat, "Diff", k))
    return out


ROLLING_FEATURES = tuple(f"{base}_{s}_pre" for s in "HA" for base, *_ in rolling_bases())
FEATURES = (*ELO_FEATURES, *CONTEXT_FEATURES, *ROLLING_FEATURES)
FEATURE_TABLE = (*METADATA, *TARGETS, *FEATURES)
COUNT_FEATURES = tuple(c for c in CONTEXT_FEATURES if c.startswith(("Matches14d", "TeamMatchNum")))
PSEUDO_XG_FEATURES = tuple(
    f"{name}{k}_{s}_pxg_pre"
    for s in "HA"
    for k in (5, 10)
    for name in ("PxgForAvg", "PxgAgainstAvg", "GminusPxgForAvg")
)
XG_FEATURES = tuple(
    f"{name}{k}_{s}_xg_pre"
    for s in "HA"
    for k in (5, 10)
    for name in ("XgForAvg", "XgAgainstAvg", "XgDiffAvg", "GminusXgForAvg")
)
AVAILABILITY_FEATURES = tuple(
    f"avail_{s}_{name}_pre" for s in ("H", "A", "diff") for name in AVAILABILITY_BASE
)


def feature_columns() -> tuple[str, ...]:
    """The ordered model inputs."""
    return FEATURES


def feature_output_columns(names=FEATURES) -> tuple[str, ...]:
    """Metadata, labels, then the requested features."""
    return (*METADATA, *TARGETS, *names)


def _field(name: str) -> T.StructField:
    if name == "MatchDate":
        return T.StructField(name, T.DateType())
    if name in ("Division", "HomeTeam", "AwayTeam", "FTR", "target_1x2"):
        return T.StructField(name, T.StringType())
    if name.startswith("target_"):
        return T.StructField(name, T.ByteType())
    if name in COUNT_COLUMNS or name in COUNT_FEATURES or name == "SeasonStartYear":
        return T.StructField(name, T.LongType())
    return T.StructField(name, T.DoubleType())


CANONICAL_SCHEMA = T.StructType([_field(c) for c in CANONICAL])
FEATURE_SCHEMA = T.StructType([_field(c) for c in FEATURE_TABLE])


class ContractError(ValueError):
    """A table does not satisfy its contract."""


class LeakageError(ContractError):
    """A model input could carry information from the event it predicts."""


def require_columns(df, columns, what: str = "table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{what} is missing columns: {', '.join(missing)}")


def require_exact_columns(df, columns, what: str, ordered: bool = False) -> None:
    require_columns(df, columns, what)
    extra = [c for c in df.columns if c not in columns]
    if extra:
        raise ContractError(f"{what} has unexpected columns: {', '.join(extra)}")
    if ordered and tuple(df.columns) != tuple(columns):
        raise ContractError(f"{what} columns are not in the contract order")
