"""External expected goals: schema audit, normalised-key alignment, quality gates, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.names import TEAM_ALIASES, team_name_udf
from pairlab.functions.scalars import any_of, count_if, finite, number, parse_date, share, strip
from pairlab.operators import history as H
from pairlab.operators.canonical import duplicate_summary

# Quality thresholds.
MIN_COVERAGE = 0.98
XG_RANGE = (0.0, 10.0)
SIDE_MEAN_RANGE = (0.7, 2.3)
CORRELATION_RANGE = (0.45, 0.95)
MIN_CORRELATION_ROWS = 100
WINDOWS = (5, 10)
JOIN_KEY = ("MatchDate", "Division", "_home", "_away")


def normalise_external(raw: DataFrame, aliases: dict[str, str] = TEAM_ALIASES) -> DataFrame:
    """Closed external schema with normalised names, dates and numbers (malformed -> NULL)."""
    S.require_exact_columns(raw, S.XG_COLUMNS, "external xG")
    name = team_name_udf(aliases)
    typed = dict(raw.dtypes)
    date = F.col("MatchDate")
    date = parse_date(date) if typed["MatchDate"] == "string" else date.cast("date")

    def value(c: str):
        return number(F.col(c)) if typed[c] == "string" else F.col(c).cast("double")

    return raw.select(
        strip(F.col("Division").cast("string")).alias("Division"),
        date.alias("MatchDate"),
        F.coalesce(name("HomeTeam"), F.lit("")).alias("HomeTeam"),
        F.coalesce(name("AwayTeam"), F.lit("")).alias("AwayTeam"),
        value("home_xg").alias("home_xg"),
        value("away_xg").alias("away_xg"),
    )


def external_audit(
    normal: DataFrame, divisions: Sequence[str] = S.XG_DIVISIONS
) -> DataFrame:
    """One row of counts over normalised external rows.

    Rows are folded by key first, so a repeated key is seen without a window over its copies.
    """
    bad_key = any_of(
        F.col("MatchDate").isNull(),
        F.col("Division").isNull() | (F.col("Division") == ""),
        F.col("HomeTeam") == "",
        F.col("AwayTeam") == "",
        F.col("HomeTeam") == F.col("AwayTeam"),
    )
    wrong = {c: ~(finite(F.col(c)) & (F.col(c) >= 0)) for c in ("home_xg", "away_xg")}
    bad_xg = F.coalesce(any_of(*wrong.values()), F.lit(True))
    foreign = ~F.coalesce(F.col("Division").isin(*divisions), F.lit(False))
    fine = ~(F.coalesce(bad_key, F.lit(False)) | bad_xg | foreign)
    cells = sum((F.coalesce(w, F.lit(True)).cast("int") for w in wrong.values()), F.lit(0))
    per_key = normal.groupBy(*S.KEY).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(bad_key).alias("key"),
        count_if(bad_xg).alias("xg"),
        F.sum(cells).alias("cells"),
        count_if(foreign).alias("foreign"),
        count_if(fine).alias("fine"),
    )
    repeated = F.col("n") > 1

    def total(c, when=None):
        value = F.col(c) if when is None else F.when(when, F.col(c))
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return per_key.agg(
        total("n").alias("supplied_rows"),
        total("fine", ~repeated).alias("valid_rows"),
        total("key").alias("invalid_key_rows"),
        total("xg").alias("invalid_xg_rows"),
        total("cells").alias("invalid_xg_values"),
        total("foreign").alias("unsupported_division_rows"),
        count_if(repeated).alias("duplicate_keys"),
        total("n", repeated).alias("duplicate_rows"),
    ).withColumn(
        "passed",
        (F.col("supplied_rows") > 0) & (F.col("valid_rows") == F.col("supplied_rows")),
    )


def validate_external(
    raw: DataFrame,
    divisions: Sequence[str] = S.XG_DIVISIONS,
    aliases: dict[str, str] = TEAM_ALIASES,
) -> DataFrame:
    """Normalised external rows, or an error with the audit counts."""
    normal = normalise_external(raw, aliases)
    row = external_audit(normal, divisions).first()
    if not row.passed:
        raise S.ContractError(f"external xG schema failed: {row.asDict()}")
    return normal


def align_external_xg(
    matches: DataFrame, normal: DataFrame, aliases: dict[str, str] = TEAM_ALIASES
) -> DataFrame:
    """Matches of the covered divisions, left-joined to external xG on normalised names.

    ``aligned`` is 1 where an external row exists; unmatched matches stay as missing slots.
    """
    name = team_name_udf(aliases)
    covered = normal.select("Division").distinct()
    ours = matches.join(covered, "Division", "left_semi").select(
        *S.KEY,
        "SeasonStartYear",
        "FTHome",
        "FTAway",
        name("HomeTeam").alias("_home"),
        name("AwayTeam").alias("_away"),
    )
    theirs = normal.select(
        "MatchDate",
        "Division",
        F.col("HomeTeam").alias("_home"),
        F.col("AwayTeam").alias("_away"),
        "home_xg",
        "away_xg",
        F.lit(1).alias("aligned"),
    )
    return ours.join(theirs, list(JOIN_KEY), "left").select(
        *S.KEY,
        "SeasonStartYear",
        "FTHome",
        "FTAway",
        "home_xg",
        "away_xg",
        F.coalesce("aligned", F.lit(0)).alias("aligned"),
        "_home",
        "_away",
    )


def check_alias_collapse(aligned: DataFrame) -> None:
    """Two different matches must not fall on one normalised key."""
    if duplicate_summary(aligned, JOIN_KEY).first().duplicate_keys:
        raise S.ContractError("team aliases collapse distinct match keys")


def unmatched_external(
    matches: DataFrame, normal: DataFrame, aliases: dict[str, str] = TEAM_ALIASES
) -> DataFrame:
    """External rows that no match claims."""
    name = team_name_udf(aliases)
    ours = matches.select(
        "MatchDate",
        "Division",
        name("HomeTeam").alias("HomeTeam"),
        name("AwayTeam").alias("AwayTeam"),
    )
    return normal.join(ours, list(S.KEY), "left_anti")


def alignment_coverage(aligned: DataFrame) -> DataFrame:
    """Rows and aligned rows per division, per division and season, per season, and overall."""
    sets = [["Division"], ["Division", "SeasonStartYear"], ["SeasonStartYear"], []]
    columns = ("Division", "SeasonStartYear")
    out = aligned.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return out.agg(
        F.count(F.lit(1)).alias("canonical_rows"),
        F.sum("aligned").cast("bigint").alias("aligned_rows"),
        share(F.sum("aligned"), F.count(F.lit(1))).alias("coverage"),
    )


def quality(aligned: DataFrame) -> DataFrame:
    """One row with the plausibility measures and the verdict of the fixed gates.

    Everything is additive, so rows are folded once per (division, season) and the groups once
    more; correlation comes from sums. A match with xG but without goals leaves the correlation
    undefined, which fails the gate.
    """
    both = F.col("home_xg").isNotNull() & F.col("away_xg").isNotNull()
    goals = F.col("FTHome").isNotNull() & F.col("FTAway").isNotNull()

    def pair(x, y=None):
        """Sum over the home and away side of complete rows of x, or of the product x*y."""
        h, a = x[0].cast("double"), x[1].cast("double")
        if y is not None:
            h, a = h * y[0].cast("double"), a * y[1].cast("double")
        return F.coalesce(F.sum(F.when(both, h + a)), F.lit(0.0))

    xg, g = (F.col("home_xg"), F.col("away_xg")), (F.col("FTHome"), F.col("FTAway"))
    per_season = aligned.groupBy("Division", "SeasonStartYear").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("aligned").alias("m"),
        F.count("home_xg").alias("nh"),
        F.count("away_xg").alias("na"),
        F.least(F.min("home_xg"), F.min("away_xg")).alias("lo"),
        F.greatest(F.max("home_xg"), F.max("away_xg")).alias("hi"),
        F.avg("home_xg").alias("mh"),
        F.avg("away_xg").alias("ma"),
        count_if(both).alias("complete"),
        count_if(both & ~goals).alias("goalless"),
        pair(xg).alias("sx"),
        pair(g).alias("sy"),
        pair(xg, xg).alias("sxx"),
        pair(g, g).alias("syy"),
        pair(xg, g).alias("sxy"),
    )
    claimed = F.col("m") > 0
    n = F.sum("complete") * 2.0
    cov = F.sum("sxy") * n - F.sum("sx") * F.sum("sy")
    vx = F.sum("sxx") * n - F.sum("sx") * F.sum("sx")
    vy = F.sum("syy") * n - F.sum("sy") * F.sum("sy")
    usable = (F.sum("complete") >= MIN_CORRELATION_ROWS) & (F.sum("goalless") == 0)
    row = per_season.agg(
        count_if(claimed).alias("covered_league_seasons"),
        F.coalesce(
            F.min(F.when(claimed, F.col("m").cast("double") / F.col("n"))), F.lit(0.0)
        ).alias("minimum_claimed_league_season_coverage"),
        F.coalesce(
            F.try_divide((F.sum("nh") + F.sum("na")).cast("double"), 2.0 * F.sum("m")),
            F.lit(0.0),
        ).alias("value_coverage"),
        F.min("lo").alias("minimum_xg"),
        F.max("hi").alias("maximum_xg"),
        F.min(F.least("mh", "ma")).alias("minimum_side_mean"),
        F.max(F.greatest("mh", "ma")).alias("maximum_side_mean"),
        F.when(usable & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("goals_correlation"),
    )
    passed = (
        (F.col("covered_league_seasons") > 0)
        & (F.col("minimum_claimed_league_season_coverage") >= MIN_COVERAGE)
        & (F.col("value_coverage") >= MIN_COVERAGE)
        & (F.col("minimum_xg") >= XG_RANGE[0])
        & (F.col("maximum_xg") <= XG_RANGE[1])
        & (F.col("minimum_side_mean") >= SIDE_MEAN_RANGE[0])
        & (F.col("maximum_side_mean") <= SIDE_MEAN_RANGE[1])
        & F.col("goals_correlation").between(*CORRELATION_RANGE)
    )
    return row.withColumn("passed", F.coalesce(passed, F.lit(False)))


def history_issues(aligned: DataFrame) -> DataFrame:
    """Counts of unpaired, non-finite and negative xG in a history table."""
    h, a = F.col("home_xg"), F.col("away_xg")
    return aligned.agg(
        count_if(h.isNull() != a.isNull()).alias("unpaired_rows"),
        count_if((h.isNotNull() & ~finite(h)) | (a.isNotNull() & ~finite(a))).alias(
            "nonfinite_rows"
        ),
        count_if((h < 0) | (a < 0)).alias("negative_rows"),
    )


def history_state(
    rows: DataFrame,
    home: str,
    away: str,
    prefix: str,
    diff: bool,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Per (team, day): means over the last five and ten matches with both values present.

    A match without values keeps its place. Finishing is the mean of goals minus the value, and
    is missing when the goals of any counted match are.
    """
    h, a = F.col(home), F.col(away)
    team = H.sides(
        rows,
        ["Division", "SeasonStartYear", "MatchDate", "HomeTeam", "AwayTeam"],
        {
            "team": (F.col("HomeTeam"), F.col("AwayTeam")),
            "x_for": (h, a),
            "x_against": (a, h),
            "goals": (F.col("FTHome").cast("double"), F.col("FTAway").cast("double")),
        },
    )
    k = max(WINDOWS)
    daily = H.day_tails(
        team, H.TEAM, "MatchDate", ("HomeTeam", "AwayTeam"), ("x_for", "x_against", "goals"), k
    )
    state = H.tails_before(daily, H.TEAM, "MatchDate", k, asked).select(
        *H.TEAM, "MatchDate", *[H.slot("tail", i).alias(f"s{i}") for i in range(1, k + 1)]
    )
    columns = []
    for w in WINDOWS:
        slots = [f"s{i}" for i in range(1, w + 1)]
        used = [F.col(f"{s}.x_for").isNotNull() & F.col(f"{s}.x_against").isNotNull() for s in slots]

        def mean(field, slots=slots, used=used):
            return H.mean_of(
                [F.when(u, F.col(f"{s}.{field}")) for s, u in zip(slots, used, strict=True)]
            )

        gaps = [
            F.when(u, F.col(f"{s}.goals") - F.col(f"{s}.x_for"))
            for s, u in zip(slots, used, strict=True)
        ]
        missing = any_of(
            *[u & F.col(f"{s}.goals").isNull() for s, u in zip(slots, used, strict=True)]
        )
        columns += [
            mean("x_for").alias(f"{prefix}ForAvg{w}"),
            mean("x_against").alias(f"{prefix}AgainstAvg{w}"),
            F.when(~F.coalesce(missing, F.lit(False)), H.mean_of(gaps)).alias(
                f"Gminus{prefix}ForAvg{w}"
            ),
        ]
    out = state.select(*H.TEAM, "MatchDate", *columns)
    if not diff:
        return out
    return out.select(
        "*",
        *[
            (F.col(f"{prefix}ForAvg{w}") - F.col(f"{prefix}AgainstAvg{w}")).alias(
                f"{prefix}DiffAvg{w}"
            )
            for w in WINDOWS
        ],
    )


def on_matches(targets: DataFrame, state: DataFrame, features: Sequence[str], tag: str) -> DataFrame:
    """Attach a history state to targets and name the columns ``{base}_{side}_{tag}_pre``."""
    bases = list(dict.fromkeys(f.split("_")[0] for f in features))
    joined = H.join_sides(
        targets.select(*S.KEY, "SeasonStartYear"),
        state,
        bases,
        home=f"{{}}_H_{tag}_pre",
        away=f"{{}}_A_{tag}_pre",
    )
    return joined.select(*S.KEY, *features)


def xg_features(targets: DataFrame, aligned: DataFrame, inside: bool = False) -> DataFrame:
    """The 16 external-xG features of every target match, NULL where a team has no history.

    ``inside`` says that the targets are rows of the aligned history, which saves a step.
    """
    asked = None if inside else H.team_days(targets)
    state = history_state(aligned, "home_xg", "away_xg", "Xg", diff=True, asked=asked)
    return on_matches(targets, state, S.XG_FEATURES, "xg")
