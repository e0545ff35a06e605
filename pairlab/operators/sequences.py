"""Last-ten-match descriptor sequences, team vocabularies and pooled representations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import count_if, day, points, require
from pairlab.operators import history as H
from pairlab.operators.indexing import dense_index

# Descriptor order and scales.
DESCRIPTORS = (
    "was_home",
    "goals_for",
    "goals_against",
    "goal_difference",
    "shots_for",
    "shots_against",
    "shots_on_target_for",
    "shots_on_target_against",
    "corners_for",
    "corners_against",
    "points",
    "log_days_ago",
    "same_season",
)
SCALES = {"goals": 3.0, "shots": 15.0, "shots_on_target": 5.0, "corners": 6.0, "points": 3.0}
DAYS_SCALE = 7.0
LENGTH = 10
SOURCES = {
    "goals": ("FTHome", "FTAway"),
    "shots": ("HomeShots", "AwayShots"),
    "shots_on_target": ("HomeTarget", "AwayTarget"),
    "corners": ("HomeCorners", "AwayCorners"),
}


def descriptor_sides(matches: DataFrame) -> DataFrame:
    """One scaled descriptor per team and match; a missing statistic counts as zero."""

    def scaled(c: str, scale: float) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / scale

    pairs = {
        "team": (F.col("HomeTeam"), F.col("AwayTeam")),
        "was_home": (F.lit(1.0), F.lit(0.0)),
        "points": (
            points(F.col("FTR"), "H", "A") / SCALES["points"],
            points(F.col("FTR"), "A", "H") / SCALES["points"],
        ),
    }
    for stat, (home, away) in SOURCES.items():
        h, a = scaled(home, SCALES[stat]), scaled(away, SCALES[stat])
        pairs[f"{stat}_for"] = (h, a)
        pairs[f"{stat}_against"] = (a, h)
        if stat == "goals":
            pairs["goal_difference"] = (h - a, a - h)
    keep = ["Division", "SeasonStartYear", "MatchDate", "HomeTeam", "AwayTeam"]
    return H.sides(matches, keep, pairs)


def sequence_state(
    matches: DataFrame,
    length: int = LENGTH,
    asked: DataFrame | None = None,
    descriptors: Sequence[str] = DESCRIPTORS,
) -> DataFrame:
    """Per (division, team, day): descriptors of the last matches before it, over all seasons."""
    if length < 1:
        raise ValueError("the sequence length must be positive")
    rows = descriptor_sides(matches).withColumn("played", F.col("MatchDate"))
    read = {"log_days_ago": "played", "same_season": "SeasonStartYear"}
    payload = [read.get(d, d) for d in DESCRIPTORS if d in descriptors]
    daily = H.day_tails(
        rows, H.CAREER, "MatchDate", ("HomeTeam", "AwayTeam"), payload, length
    )
    return H.tails_before(daily, H.CAREER, "MatchDate", length, asked).withColumnRenamed(
        "tail", "past"
    )


def match_sequences(
    targets: DataFrame,
    matches: DataFrame,
    length: int = LENGTH,
    inside: bool = False,
    descriptors: Sequence[str] = DESCRIPTORS,
) -> DataFrame:
    """Home and away sequences of every target, oldest first.

    ``inside`` says that the targets are rows of the history, which saves a step.

    A sequence is as long as the history (its size is the mask); each element holds the 13
    descriptors, the last two relative to the target, or those of ``descriptors``, in the same order.
    Elements are carried through every shuffle, so a caller names the descriptors it reads.
    """
    if not descriptors or not set(descriptors) <= set(DESCRIPTORS):
        raise ValueError("the sequence descriptors must be some of the 13")
    asked = None if inside else H.team_days(targets, season=False)
    state = sequence_state(matches, length, asked, descriptors)
    joined = H.join_sides(
        targets.select(*S.KEY, "SeasonStartYear"), state, ["past"], season=False
    )

    def relative(past: str) -> Column:
        def element(x: Column) -> Column:
            def value(d: str) -> Column:
                if d == "log_days_ago":
                    ago = day(F.col("MatchDate")) - day(x["played"])
                    return F.log1p(ago.cast("double")) / DAYS_SCALE
                if d == "same_season":
                    return (x["SeasonStartYear"] == F.col("SeasonStartYear")).cast("double")
                return x[d]

            return F.struct(*[value(d).alias(d) for d in DESCRIPTORS if d in descriptors])

        return F.transform(F.coalesce(F.col(past), F.array()), element)

    return joined.select(
        *S.KEY,
        "SeasonStartYear",
        relative("past_H").alias("home_sequence"),
        relative("past_A").alias("away_sequence"),
    )


def gather(sequences: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sequences of the wanted keys; a key without one stops the job."""
    found = wanted.select(*S.KEY).join(
        sequences.withColumn("_found", F.lit(True)), list(S.KEY), "left"
    )
    has = F.coalesce("_found", F.lit(False))
    return require(found, has, "a requested match has no sequence").drop("_found")


def teams_of(rows: DataFrame) -> DataFrame:
    return H.sides(
        rows, ["Division"], {"team": (F.col("HomeTeam"), F.col("AwayTeam"))}
    ).select("Division", "team").distinct()


def train_vocabulary(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Team identifiers in (division, team) order, and leagues with their own unknown token.

    Unknown tokens follow the team tokens, one per league in league order.
    """
    teams = dense_index(teams_of(train), ["Division", "team"], "team_id")
    leagues = dense_index(train.select("Division").distinct(), ["Division"], "league_id")
    size = teams.agg(F.count(F.lit(1)).alias("_teams"))
    leagues = leagues.crossJoin(F.broadcast(size)).select(  # a single row
        "Division", "league_id", (F.col("_teams") + F.col("league_id")).alias("unknown_id")
    )
    return teams, leagues


def team_ids(rows: DataFrame, vocabulary: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Home, away and league identifiers; an unseen team gets its league's unknown token.

    A division the training rows never held stops the job.
    """
    return _identified(rows, *vocabulary, ["Division"])


def _identified(rows: DataFrame, teams: DataFrame, leagues: DataFrame, by: list[str]) -> DataFrame:
    out = rows.join(leagues, by, "left")
    for side, column in (("home", "HomeTeam"), ("away", "AwayTeam")):
        lookup = teams.select(*by, F.col("team").alias(column), F.col("team_id").alias(f"_{side}"))
        out = out.join(lookup, [*by, column], "left")
    league = F.when(F.col("league_id").isNotNull(), F.col("league_id")).otherwise(
        F.raise_error(F.lit("division absent from the training vocabulary")).cast("bigint")
    )
    return out.select(
        *rows.columns,
        league.alias("league_id"),
        F.coalesce("_home", "unknown_id").alias("home_id"),
        F.coalesce("_away", "unknown_id").alias("away_id"),
        F.col("_home").isNull().cast("int").alias("home_unseen"),
        F.col("_away").isNull().cast("int").alias("away_unseen"),
    )


def fold_team_ids(folds: DataFrame) -> DataFrame:
    """``team_ids`` of the test rows of every fold, each by the vocabulary of its own training rows."""
    train, test = (folds.where(F.col("part") == part) for part in ("train", "test"))
    known = H.sides(train, ["fold", "Division"], {"team": (F.col("HomeTeam"), F.col("AwayTeam"))})

    def numbered(distinct: DataFrame, order: Sequence[str], name: str) -> DataFrame:
        """Numbers from 0 within each fold: the number over all folds less the fold's first."""
        made = dense_index(distinct, order, name)
        first = made.groupBy("fold").agg(F.min(name).alias("_first"), F.count(F.lit(1)).alias(f"{name}s"))
        # a row a fold
        return made.join(F.broadcast(first), "fold").withColumn(name, F.col(name) - F.col("_first")).drop("_first")

    teams = numbered(known.select("fold", "Division", "team").distinct(), ["fold", "Division", "team"], "team_id")
    leagues = numbered(known.select("fold", "Division").distinct(), ["fold", "Division"], "league_id")
    sizes = teams.select("fold", "team_ids").distinct()
    leagues = leagues.join(F.broadcast(sizes), "fold").select(
        "fold", "Division", "league_id", (F.col("team_ids") + F.col("league_id")).alias("unknown_id")
    )
    return _identified(test, teams.drop("team_ids"), leagues, ["fold", "Division"])


def encoded_rows(rows: DataFrame, column: str = "encoded") -> DataFrame:
    """Rows of one fold with a sparse vector: a place for each training league, and two for unseen teams.

    The vocabulary is that of the rows whose ``part`` is train; a league that it lacks stops the job.
    """
    train = F.col("part") == "train"
    ids = team_ids(rows, train_vocabulary(rows.where(train)))
    league = OneHotEncoder(inputCol="league_id", outputCol="_league", dropLast=False).fit(ids.where(train))
    made = VectorAssembler(inputCols=["_league", "home_unseen", "away_unseen"], outputCol=column).transform(
        league.transform(ids)
    )
    return made.select(*rows.columns, column)


FIRST_SEASONS = ("home_since", "away_since")


def with_first_seasons(rows: DataFrame) -> DataFrame:
    """Rows with the first season of the home and the away team in its division.

    A team is unseen by all folds up to its first season, so one join serves every fold's vocabulary.
    """
    since = H.sides(
        rows.select("Division", "SeasonStartYear", "HomeTeam", "AwayTeam"),
        ["Division", "SeasonStartYear"],
        {"team": (F.col("HomeTeam"), F.col("AwayTeam"))},
    ).groupBy("Division", "team").agg(F.min("SeasonStartYear").alias("since"))
    out = rows
    for team, name in zip(("HomeTeam", "AwayTeam"), FIRST_SEASONS, strict=True):
        out = out.join(since.select("Division", F.col("team").alias(team), F.col("since").alias(name)), ["Division", team])
    return out


def encoding(rows: DataFrame) -> Callable[[int], dict[str, Column]]:
    """Inputs of each test year that tell leagues and unseen teams, as its training seasons know them.

    ``rows`` hold the teams' first seasons. The inputs are those of ``encoded_rows``; a league that the
    training seasons lack stops the job.
    """
    firsts = rows.groupBy("Division").agg(F.min("SeasonStartYear").alias("since")).orderBy("Division").collect()
    season = F.col("SeasonStartYear")

    def inputs(year: int) -> dict[str, Column]:
        known = [r.Division for r in firsts if r.since < year]
        # rows of later seasons are not the fold's
        checked = (season > year) | F.col("Division").isin(known)
        absent = F.raise_error(F.lit("division absent from the training vocabulary")).cast("double")
        made = {f"league_{name}": (F.col("Division") == name).cast("double") for name in known}
        for side, since in zip(("home", "away"), FIRST_SEASONS, strict=True):
            made[f"{side}_unseen_{year}"] = F.when(checked, (F.col(since) >= year).cast("double")).otherwise(absent)
        return made

    return inputs


def oov_counts(folds: DataFrame) -> DataFrame:
    """Per fold: vocabulary size, and home and away test occurrences of teams not trained on."""
    by = ["fold", "Division"]
    known = (
        H.sides(
            folds.where(F.col("part") == "train"),
            by,
            {"team": (F.col("HomeTeam"), F.col("AwayTeam"))},
        )
        .select(*by, "team")
        .distinct()
    )
    test = H.sides(
        folds.where(F.col("part") == "test"),
        by,
        {"team": (F.col("HomeTeam"), F.col("AwayTeam"))},
    )
    # occurrences are folded before the join, so a hot team is one row per side
    seen = test.groupBy(*by, "team").agg(
        count_if(F.col("side") == "H").alias("h"), count_if(F.col("side") == "A").alias("a")
    )
    unseen = seen.join(known, [*by, "team"], "left_anti").groupBy("fold").agg(
        F.sum("h").alias("oov_home"), F.sum("a").alias("oov_away")
    )
    size = known.groupBy("fold").agg(
        F.count(F.lit(1)).alias("team_tokens"),
        F.countDistinct("Division").alias("unknown_tokens"),
    )
    return size.join(unseen, "fold", "left").select(
        "fold",
        "team_tokens",
        "unknown_tokens",
        F.coalesce("oov_home", F.lit(0)).alias("oov_home"),
        F.coalesce("oov_away", F.lit(0)).alias("oov_away"),
    )


def pooled_names() -> list[str]:
    return [
        f"seq_{s}_{pool}_{d}_pre"
        for s in ("H", "A", "diff")
        for pool in ("mean", "recent")
        for d in DESCRIPTORS
    ]


def pooled_representation(sequences: DataFrame, decay: float = 0.8) -> DataFrame:
    """Masked mean and recency-weighted mean of each side's descriptors, and their difference.

    An empty history pools to zero.
    """

    def pooled(sequence: str, d: str, weighted: bool) -> Column:
        n = F.size(sequence)

        def weight(i: Column) -> Column:
            return F.pow(F.lit(decay), (n - 1 - i).cast("double")) if weighted else F.lit(1.0)

        total = F.aggregate(
            F.transform(F.col(sequence), lambda x, i: x[d] * weight(i)),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
        mass = (
            (F.lit(1.0) - F.pow(F.lit(decay), n.cast("double"))) / (1.0 - decay)
            if weighted
            else n.cast("double")
        )
        return F.when(n > 0, total / mass).otherwise(F.lit(0.0))

    sides = []
    for s, sequence in (("H", "home_sequence"), ("A", "away_sequence")):
        for pool in ("mean", "recent"):
            sides += [
                pooled(sequence, d, pool == "recent").alias(f"seq_{s}_{pool}_{d}_pre")
                for d in DESCRIPTORS
            ]
    made = sequences.select(*S.KEY, *sides)
    gaps = [
        (F.col(f"seq_H_{p}_{d}_pre") - F.col(f"seq_A_{p}_{d}_pre")).alias(f"seq_diff_{p}_{d}_pre")
        for p in ("mean", "recent")
        for d in DESCRIPTORS
    ]
    return made.select("*", *gaps).select(*S.KEY, *pooled_names())
