"""Player availability: relation checks and the 21 squad features per team and day.

The pool of a team on a day is the players of its last ten earlier matches of the season. It is
built by expanding each (team, day) to its last ten matches (a fixed fan-out), joining who took
part, and folding to one row per (team, day, player). Players, line-ups and values all read that
one relation; nothing is collected per team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlab import schema as S
from pairlab.functions.scalars import any_of, count_if, day, finite, percentage
from pairlab.operators import history as H
from pairlab.operators.canonical import duplicate_summary
from pairlab.session import durable

# Pool sizes and day windows.
POOL = 10
SHORT = 5
DAYS = (7, 14, 21, 30)
LINEUP_SIZE = 11
TEAM_DAY = (*H.TEAM, "MatchDate")


def relation_quality(
    fixtures: DataFrame, appearances: DataFrame, lineups: DataFrame, valuations: DataFrame
) -> DataFrame:
    """One row with the 16 validation counts, plus null identifiers."""
    S.require_columns(fixtures, S.FIXTURE_COLUMNS, "fixtures")
    S.require_columns(appearances, S.APPEARANCE_COLUMNS, "appearances")
    S.require_columns(lineups, S.LINEUP_COLUMNS, "lineups")
    S.require_columns(valuations, S.VALUATION_COLUMNS, "valuations")
    minutes, value = F.col("minutes_played"), F.col("market_value_in_eur")
    count = F.count(F.lit(1))

    def null_ids(*columns):
        return count_if(any_of(*[F.col(c).isNull() for c in columns]))

    def repeated(df, key, name):
        return duplicate_summary(df, key).select(F.col("duplicate_rows").alias(name))

    def orphans(df, name):
        games = df.select("game_id").distinct()
        known = fixtures.select("game_id").distinct()
        return games.join(known, "game_id", "left_anti").agg(count.alias(name))

    parts = [
        fixtures.agg(
            count.alias("supplied_match_rows"),
            null_ids("SeasonStartYear", "game_id", "home_club_id", "away_club_id", *S.KEY).alias(
                "null_fixture_ids"
            ),
        ),
        appearances.agg(
            count.alias("appearance_rows"),
            F.countDistinct("game_id").alias("appearance_games"),
            count_if(~finite(minutes.cast("double")) | (minutes < 0)).alias(
                "invalid_minutes_rows"
            ),
            null_ids("game_id", "player_id", "player_club_id").alias("null_appearance_ids"),
        ),
        lineups.agg(
            count.alias("lineup_rows"),
            F.countDistinct("game_id").alias("lineup_games"),
            count_if(~F.coalesce(F.col("type").isin(*S.LINEUP_ROLES), F.lit(False))).alias(
                "invalid_role_rows"
            ),
            null_ids("game_id", "player_id", "club_id").alias("null_lineup_ids"),
        ),
        valuations.agg(
            count.alias("valuation_rows"),
            count_if(
                F.col("date").isNull() | ~finite(value.cast("double")) | (value < 0)
            ).alias("invalid_valuation_rows"),
            null_ids("player_id").alias("null_valuation_ids"),
        ),
        repeated(fixtures, S.KEY, "duplicate_match_keys"),
        repeated(fixtures, ["game_id"], "duplicate_game_ids"),
        repeated(appearances, S.APPEARANCE_COLUMNS[:3], "duplicate_appearance_rows"),
        repeated(lineups, S.LINEUP_COLUMNS, "duplicate_lineup_rows"),
        repeated(valuations, S.VALUATION_COLUMNS[:2], "duplicate_valuation_rows"),
        orphans(appearances, "unmatched_appearance_games"),
        orphans(lineups, "unmatched_lineup_games"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # each part is a single row
    return out


ALLOWED = (
    "supplied_match_rows",
    "appearance_rows",
    "lineup_rows",
    "valuation_rows",
    "appearance_games",
    "lineup_games",
)


def validate_relations(fixtures, appearances, lineups, valuations) -> None:
    row = relation_quality(fixtures, appearances, lineups, valuations).first().asDict()
    wrong = {k: v for k, v in row.items() if v and k not in ALLOWED}
    if wrong:
        raise S.ContractError(f"player relations violate their contract: {wrong}")


def participation(appearances: DataFrame, lineups: DataFrame) -> DataFrame:
    """One row per (game, club, player): minutes, started, benched.

    Minutes are NULL for a player who was listed but has no appearance.
    """
    played = appearances.select(
        "game_id",
        F.col("player_club_id").alias("club_id"),
        "player_id",
        F.col("minutes_played").cast("double").alias("minutes"),
        F.lit(0).alias("started"),
        F.lit(0).alias("benched"),
    )
    listed = lineups.select(
        "game_id",
        "club_id",
        "player_id",
        F.lit(None).cast("double").alias("minutes"),
        (F.col("type") == "starting_lineup").cast("int").alias("started"),
        (F.col("type") == "substitutes").cast("int").alias("benched"),
    )
    return (
        played.unionByName(listed)
        .groupBy("game_id", "club_id", "player_id")
        .agg(
            F.sum("minutes").alias("minutes"),
            F.max("started").alias("started"),
            F.max("benched").alias("benched"),
        )
    )


def fixture_sides(fixtures: DataFrame) -> DataFrame:
    return H.sides(
        fixtures,
        ["Division", "SeasonStartYear", "MatchDate", "game_id"],
        {
            "team": (F.col("HomeTeam"), F.col("AwayTeam")),
            "club_id": (F.col("home_club_id"), F.col("away_club_id")),
        },
    )


def game_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("game_id", "club_id").agg(
        F.sum("minutes").alias("game_minutes"), F.sum("started").cast("bigint").alias("starters")
    )


def load_state(fixtures: DataFrame, parts: DataFrame) -> DataFrame:
    """Matches and minutes of the last 7 to 30 days (day N included), and rest."""
    totals = game_totals(parts).select("game_id", "club_id", "game_minutes")
    rows = fixture_sides(fixtures).join(totals, ["game_id", "club_id"], "left")
    daily = H.day_counts(
        rows, H.TEAM, "MatchDate", day_minutes=F.sum(F.coalesce("game_minutes", F.lit(0.0)))
    )
    before = H.days_before(H.TEAM, "MatchDate")

    def recent(c: str, days: int):
        return F.sum(c).over(H.days_before(H.TEAM, "MatchDate", days))

    known = F.max(day(F.col("MatchDate"))).over(before).isNotNull()
    return daily.select(
        *TEAM_DAY,
        F.when(known, F.coalesce(recent("day_n", 30), F.lit(0)).cast("double")).alias(
            "matches_30d"
        ),
        *[
            F.when(known, F.coalesce(recent("day_minutes", d), F.lit(0.0))).alias(f"minutes_{d}d")
            for d in DAYS
        ],
        (day(F.col("MatchDate")) - F.max(day(F.col("MatchDate"))).over(before))
        .cast("double")
        .alias("days_since_prev_match"),
    )


def recent_games(fixtures: DataFrame, k: int = POOL) -> DataFrame:
    """Per (team, day): each of its last ``k`` earlier games with ``back`` = 1 for the latest."""
    daily = H.day_tails(
        fixture_sides(fixtures), H.TEAM, "MatchDate", ("game_id", "side"), ("game_id", "club_id"), k
    )
    tails = daily.select(*TEAM_DAY, H.prior_tail(H.TEAM, "MatchDate", k).alias("tail"))
    return tails.select(
        *TEAM_DAY, F.size("tail").alias("_n"), F.posexplode("tail").alias("_at", "_g")
    ).select(
        *TEAM_DAY,
        (F.col("_n") - F.col("_at")).alias("back"),
        F.col("_g.game_id").alias("game_id"),
        F.col("_g.club_id").alias("club_id"),
    )


def player_pool(recent: DataFrame, parts: DataFrame) -> DataFrame:
    """Per (team, day, player) of the last ten games: minutes, starts and first appearance."""
    back = F.col("back")
    short = back <= SHORT
    played = F.col("minutes").isNotNull()
    started = F.col("started") == 1
    return (
        recent.join(parts, ["game_id", "club_id"])
        .groupBy(*TEAM_DAY, "player_id")
        .agg(
            F.sum(F.when(short, F.col("minutes"))).alias("m5"),
            F.sum("minutes").alias("m10"),
            # the further back a player first shows up in the window, the earlier they rank
            F.max(F.when(short & played, back)).alias("first5"),
            F.max(F.when(played, back)).alias("first10"),
            F.max(F.when(short & started, 1)).alias("start5"),
            F.max(F.when((back == 1) & started, 1)).alias("start1"),
        )
    )


def value_as_of(lookups: DataFrame, valuations: DataFrame) -> DataFrame:
    """Latest valuation strictly before each (player, day).

    Both inputs hold at most one row per player and day, so a window group is bounded by the
    calendar. There is no inequality join.
    """
    asked = lookups.select(
        "player_id",
        F.col("MatchDate").alias("d"),
        F.lit(None).cast("double").alias("v"),
        F.lit(1).alias("ask"),
    ).distinct()
    known = valuations.select(
        "player_id",
        F.col("date").alias("d"),
        F.col("market_value_in_eur").cast("double").alias("v"),
        F.lit(0).alias("ask"),
    )
    earlier = Window.partitionBy("player_id").orderBy(day(F.col("d"))).rangeBetween(
        Window.unboundedPreceding, -1
    )
    return (
        asked.unionByName(known)
        .withColumn("value", F.last("v", ignorenulls=True).over(earlier))
        .where(F.col("ask") == 1)
        .select("player_id", F.col("d").alias("MatchDate"), "value")
    )


def _rank(minutes: str, first: str):
    """Place among those who appeared: most minutes, then first appearance, then identifier."""
    order = Window.partitionBy(*TEAM_DAY).orderBy(
        F.col(first).isNull(), F.col(minutes).desc(), F.col(first).desc(), F.col("player_id")
    )
    return F.when(F.col(first).isNotNull(), F.row_number().over(order))


def pool_state(recent: DataFrame, parts: DataFrame, valuations: DataFrame) -> DataFrame:
    """Pool sizes, minutes shares, distinct starters and squad values per (team, day).

    A pool holds the squad rows of at most ten games, so it fits a window group. Both rankings and
    all sums come from one exchange by team and day.
    """
    pool = durable(player_pool(recent, parts))
    wanted = pool.where(F.col("first5").isNotNull() | F.col("start1").isNotNull())
    values = value_as_of(wanted, valuations)
    ranked = pool.join(values, ["player_id", "MatchDate"], "left").withColumns(
        {"r5": _rank("m5", "first5"), "r10": _rank("m10", "first10")}
    )
    in5, value = F.col("first5").isNotNull(), F.col("value")

    def total(column: str, condition):
        return F.sum(F.when(condition, F.col(column)))

    joined = ranked.groupBy(*TEAM_DAY).agg(
        count_if(in5).alias("u5"),
        F.count("first10").alias("u10"),
        total("m5", in5).alias("t5"),
        F.sum("m10").alias("t10"),
        F.count("start5").alias("s5"),
        total("value", in5).alias("recent_players_value_sum_5"),
        total("value", F.col("start1") == 1).alias("last_starters_value_sum"),
        F.avg(F.when(in5, value.isNotNull().cast("double"))).alias("recent_value_coverage_5"),
        total("m5", F.col("r5") <= 5).alias("a5"),
        total("m5", F.col("r5") <= LINEUP_SIZE).alias("a11"),
        total("value", F.col("r5") <= LINEUP_SIZE).alias("recent_top11_value_sum_5"),
        total("m10", F.col("r10") <= LINEUP_SIZE).alias("b11"),
    )
    return joined.select(
        *TEAM_DAY,
        F.col("u5").cast("double").alias("unique_players_5"),
        F.col("u10").cast("double").alias("unique_players_10"),
        F.when(F.col("s5") > 0, F.col("s5").cast("double")).alias("unique_starters_5"),
        F.when(F.col("t5") > 0, F.col("a5") / F.col("t5")).alias("top5_minutes_share_5"),
        F.when(F.col("t5") > 0, F.col("a11") / F.col("t5")).alias("top11_minutes_share_5"),
        F.when(F.col("t10") > 0, F.col("b11") / F.col("t10")).alias("top11_minutes_share_10"),
        F.when(F.col("u5") > 0, F.col("t5") / F.col("u5")).alias("avg_player_minutes_5"),
        "recent_players_value_sum_5",
        "recent_top11_value_sum_5",
        "last_starters_value_sum",
        "recent_value_coverage_5",
    )


def lineup_state(recent: DataFrame, parts: DataFrame) -> DataFrame:
    """Continuity between consecutive known line-ups among the last five games.

    Each pair of consecutive line-ups is compared once, by a join on the player, and the result
    is shared by every day whose window contains the pair.
    """
    starters = parts.where(F.col("started") == 1).select("game_id", "club_id", "player_id")
    sizes = starters.groupBy("game_id", "club_id").agg(F.count(F.lit(1)).alias("size"))
    games = recent.where(F.col("back") <= SHORT).join(sizes, ["game_id", "club_id"])
    # at most five entries per (team, day), latest first
    known = games.groupBy(*TEAM_DAY).agg(
        F.sort_array(F.collect_list(F.struct("back", "game_id", "club_id", "size"))).alias("g")
    )
    pairs = known.where(F.size("g") >= 2).select(
        *TEAM_DAY,
        F.posexplode(
            F.zip_with(
                F.slice(F.col("g"), F.lit(1), F.size("g") - 1),
                F.slice(F.col("g"), F.lit(2), F.size("g") - 1),
                lambda now, before: F.struct(now.alias("now"), before.alias("before")),
            )
        ).alias("at", "p"),
    )
    pairs = pairs.select(
        *TEAM_DAY,
        "at",
        F.col("p.now.game_id").alias("game"),
        F.col("p.now.club_id").alias("club"),
        F.col("p.now.size").alias("size"),
        F.col("p.before.game_id").alias("old_game"),
        F.col("p.before.club_id").alias("old_club"),
        F.col("p.before.size").alias("old_size"),
    )
    link = ["game", "club", "old_game", "old_club"]
    now = starters.select(
        F.col("game_id").alias("game"), F.col("club_id").alias("club"), "player_id"
    )
    before = starters.select(
        F.col("game_id").alias("old_game"), F.col("club_id").alias("old_club"), "player_id"
    )
    shared = (
        pairs.select(*link)
        .distinct()
        .join(now, ["game", "club"])
        .join(before, ["old_game", "old_club", "player_id"])
        .groupBy(*link)
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    scored = pairs.join(shared, link, "left").withColumn(
        "shared", F.coalesce("shared", F.lit(0)).cast("double")
    )
    last = F.col("at") == 0
    overlap = F.col("shared") / float(LINEUP_SIZE)
    return scored.groupBy(*TEAM_DAY).agg(
        F.max(F.when(last, overlap)).alias("starter_overlap_last"),
        F.max(
            F.when(last, F.col("shared") / (F.col("size") + F.col("old_size") - F.col("shared")))
        ).alias("starter_jaccard_last"),
        F.max(F.when(last, F.lit(1.0) - overlap)).alias("rotation_index_last"),
        F.avg(F.lit(float(LINEUP_SIZE)) - F.lit(float(LINEUP_SIZE)) * overlap).alias(
            "avg_starter_changes_5"
        ),
    )


def availability_state(
    fixtures: DataFrame, appearances: DataFrame, lineups: DataFrame, valuations: DataFrame
) -> DataFrame:
    """All 21 features per (team, day); NULL throughout when the team has no earlier match."""
    # each is read by two or three of the states below
    parts = durable(participation(appearances, lineups))
    recent = durable(recent_games(fixtures))
    key = list(TEAM_DAY)
    load = load_state(fixtures, parts)
    state = load.join(pool_state(recent, parts, valuations), key, "left").join(
        lineup_state(recent, parts), key, "left"
    )
    seen = F.col("days_since_prev_match").isNotNull()
    zero_if_seen = ("unique_players_5", "unique_players_10")
    return state.select(
        *key,
        *[
            (
                F.when(seen, F.coalesce(F.col(c), F.lit(0.0))) if c in zero_if_seen else F.col(c)
            ).alias(c)
            for c in S.AVAILABILITY_BASE
        ],
    )


def side_columns(names) -> list:
    """H, A and difference columns of each feature; a difference needs both sides."""
    out = []
    for s in ("H", "A"):
        out += [F.col(f"{n}_{s}").alias(f"avail_{s}_{n}_pre") for n in names]
    return out + [(F.col(f"{n}_H") - F.col(f"{n}_A")).alias(f"avail_diff_{n}_pre") for n in names]


def availability_features(
    fixtures: DataFrame, appearances: DataFrame, lineups: DataFrame, valuations: DataFrame
) -> DataFrame:
    """The 63 availability features of every fixture."""
    state = availability_state(fixtures, appearances, lineups, valuations)
    keys = fixtures.select(*S.KEY, "SeasonStartYear", "game_id")
    joined = H.join_sides(keys, state, S.AVAILABILITY_BASE)
    return joined.select(
        *S.KEY, "SeasonStartYear", "game_id", *side_columns(S.AVAILABILITY_BASE)
    )


def scope_coverage(features: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Base and covered rows overall, per division and per season, with unmatched fixtures."""
    base = features.select(*S.KEY, "SeasonStartYear", F.lit(1).alias("_b"))
    theirs = fixtures.select(
        *S.KEY, F.col("SeasonStartYear").alias("_season"), F.lit(1).alias("_f")
    )
    both = base.join(theirs, list(S.KEY), "full_outer").withColumn(
        "SeasonStartYear", F.coalesce("SeasonStartYear", "_season")
    )
    sets = [["Division"], ["SeasonStartYear"], []]
    columns = ("Division", "SeasonStartYear")
    covered = count_if((F.col("_b") == 1) & (F.col("_f") == 1))
    return both.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]
    ).agg(
        F.count("_b").alias("base_rows"),
        covered.alias("covered_rows"),
        count_if(F.col("_b").isNull()).alias("unmatched_supplied_matches"),
        (percentage(covered, F.count("_b")) / 100.0).alias("covered_share"),
    )


def cell_completeness(features: DataFrame, columns=S.AVAILABILITY_FEATURES) -> DataFrame:
    """Share of present feature cells per division, per season and overall, in one pass."""
    present = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    sets = [["Division"], ["SeasonStartYear"], []]
    rows = features.select("Division", "SeasonStartYear", present.alias("_p"))
    n = F.count(F.lit(1))
    return rows.groupingSets(
        [[F.col(c) for c in s] for s in sets], F.col("Division"), F.col("SeasonStartYear")
    ).agg(
        n.alias("rows"),
        F.sum("_p").cast("bigint").alias("present_cells"),
        (F.sum("_p") / (n * float(len(columns)))).alias("cell_share"),
        (count_if(F.col("_p") > 0).cast("double") / n).alias("any_present_share"),
    )
