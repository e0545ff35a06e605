"""Registered queries: each operator run over whole derived tables.

Dates leave as ISO text and doubles rounded, so results compare exactly across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab import schema as S
from pairlab.functions import names
from pairlab.models import classify, goals
from pairlab.operators import (
    availability,
    baselines,
    canonical,
    elo,
    features,
    folds,
    form,
    graph,
    guards,
    history,
    labels,
    market,
    metrics,
    scaling,
    sequences,
    xg,
)
from pairlab.plans import derived, experiments, ledger, report
from pairlab.plans import graph as graph_plan
from pairlab.plans.derived import Tables
from pairlab.session import durable, shared_folder
from pairlab.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Divisions of the derived tables with a known season length; the others stay unknown.
EXPECTED = {f"N{i:02d}": 100 + 10 * i for i in range(20)}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """ISO dates, rounded doubles and plain integers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType)):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return plain(features.build_feature_table(Tables(spark, sf).canonical, EXPECTED), 4)


QUERIES["feature_table"] = feature_table


@query
def rolling_features(spark, sf):
    out = form.add_rolling_features(Tables(spark, sf).canonical)
    return plain(out.select(*S.KEY, *S.ROLLING_FEATURES))


@query
def context_features(spark, sf):
    out = form.add_context_features(Tables(spark, sf).canonical, EXPECTED)
    return plain(out.select(*S.KEY, *S.CONTEXT_FEATURES))


@query
def elo_features(spark, sf):
    out = elo.add_elo_features(Tables(spark, sf).canonical)
    return plain(out.select(*S.KEY, *S.ELO_FEATURES), 4)


@query
def label_targets(spark, sf):
    return plain(labels.add_target_labels(Tables(spark, sf).canonical).select(*S.KEY, *S.TARGETS))


YEARS = (*derived.DEVELOPMENT, derived.FINAL)


def labelled(t: Tables) -> DataFrame:
    return labels.add_target_labels(t.canonical).select(*S.METADATA, *S.TARGETS)


def tagged(t: Tables, df: DataFrame | None = None) -> DataFrame:
    return folds.expanding_folds(df if df is not None else labelled(t), YEARS, derived.FINAL)


def simple_predictions(t: Tables) -> DataFrame:
    """Uniform, prior and market probabilities on the market-covered test rows, which are joined once."""
    t.stored("matches")
    rows = tagged(t)
    covered = market.closing_market_probabilities(market.prepare_closing_market(t.market)[0])
    prior = baselines.training_prior(rows).select("fold", F.struct(*S.PROBABILITIES).alias("prior"))
    # a row a fold on the broadcast side; a fold without training rows has no prior to score
    met = baselines.test_rows(rows).join(covered.hint("merge"), list(S.KEY)).join(F.broadcast(prior), "fold", "left")

    def scored(name, given):
        return F.struct(F.lit(name).alias("model"), *[given(c).alias(c) for c in S.PROBABILITIES])

    known = F.when(F.col("prior").isNotNull(), scored("training_prior", lambda c: F.col(f"prior.{c}")))
    models = F.array(scored("uniform", lambda c: F.lit(1.0 / 3.0)), known, scored("market", F.col))
    kept = [c for c in baselines.PREDICTION if c not in ("model", *S.PROBABILITIES)]
    return met.select(*kept, F.explode(F.array_compact(models)).alias("m")).select(*kept, "m.*").select(*baselines.PREDICTION)


@query
def canonical_rows(spark, sf):
    """Text rows to canonical rows: aliases, dates, seasons, counts, trimming."""
    raw = Tables(spark, sf).raw_csv.withColumnRenamed("AS_", "AS")
    return plain(canonical.normalise(raw).drop("_issues"))


@query
def csv_round_trip(spark, sf):
    """Text files in two encodings and two column orders, read back as canonical rows."""
    folder = shared_folder(spark, "csv")
    raw = Tables(spark, sf).raw_csv.withColumnRenamed("AS_", "AS")
    raw = raw.withColumn("HomeTeam", F.concat(F.lit("É"), F.trim("HomeTeam")))
    parts = (("utf-8", raw.columns, 0), ("iso-8859-1", sorted(raw.columns), 1))
    for encoding, columns, part in parts:
        half = raw.where(F.length("Season") == (4 if part else 9)).select(*columns)
        half.write.option("header", True).option("encoding", encoding).csv(f"{folder}/{encoding}")
    rows = files.scan_source_csv(spark, folder).drop("_season_code", "_division", "_file")
    return plain(canonical.normalise(rows).drop("_issues"))


@query
def path_context(spark, sf):
    """Text files landed by season and division, whose season is that of the path: rows and goals of each."""
    folder = shared_folder(spark, "landed")
    codes, names = sorted(S.SEASON_CODES), sorted(S.DIVISION_NAMES)
    raw = Tables(spark, sf).raw_csv.withColumnRenamed("AS_", "AS")
    season = F.element_at(F.array(*[F.lit(c) for c in codes]), F.substring("Season", 1, 4).cast("int") % len(codes) + 1)
    division = F.element_at(F.array(*[F.lit(c) for c in names]), F.substring("Div", 2, 2).cast("int") % len(names) + 1)
    landed = raw.withColumns({"to_season": season, "to_division": division}).drop("Season")
    files.land_source_csv(landed, folder, "to_season", "to_division")
    rows = files.with_path_season(spark, files.scan_source_csv(spark, folder))
    return rows.groupBy("_season_code", "_division", "_season_start").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("FTHG").cast("bigint")).alias("goals")
    ).toDF("season_code", "division", "season_start", "rows", "goals")


@query
def stored_features(spark, sf):
    """Features of stored partitions, stored in turn; one division written again, the others keep their files."""
    matches, made = shared_folder(spark, "canonical"), shared_folder(spark, "features")
    sinks.write_canonical_partitions(Tables(spark, sf).canonical, matches)
    sinks.write_feature_partitions(features.build_feature_table_from_parquet(spark, matches), made)

    def stored():
        rows = spark.read.schema(S.FEATURE_SCHEMA).parquet(made)
        return rows.groupBy("Division", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))

    before = durable(stored())
    again = spark.read.schema(S.FEATURE_SCHEMA).parquet(made).where(F.col("Division") == "N03")
    sinks.write_feature_partitions(again.select(*S.FEATURE_TABLE), made)
    same = before.select("Division", "file", F.lit(1).alias("kept"))
    return (
        stored().join(same, ["Division", "file"], "left").groupBy("Division")
        .agg(F.sum("n").alias("rows"), F.coalesce(F.max("kept"), F.lit(0)).alias("kept"))
    )


@query
def canonical_round_trip(spark, sf):
    """Canonical rows through the partitioned sink and back."""
    folder = shared_folder(spark, "canonical")
    sinks.write_canonical_partitions(Tables(spark, sf).canonical, folder)
    return plain(files.read_canonical(spark, folder))


@query
def stored_summary(spark, sf):
    """The sink's own summary: folder, files and rows of each division as stored, and all rows."""
    made = sinks.write_canonical_partitions(Tables(spark, sf).canonical, shared_folder(spark, "canonical"))
    folder = F.element_at(F.split("path", "/"), -1)
    return made.withColumn("path", folder).withColumn("files", (F.col("files") > 0).cast("int"))


@query
def key_set_difference(spark, sf):
    """Matches without odds, and odds without a match when a day in ten has no match."""
    t = Tables(spark, sf)
    fewer = t.canonical.where(F.dayofmonth("MatchDate") % 10 != 0)
    return plain(sinks.key_set_difference(fewer, t.market))


@query
def stored_order(spark, sf):
    """Rows of the stored files, and rows that come before their predecessor."""
    folder = shared_folder(spark, "canonical")
    sinks.write_canonical_partitions(Tables(spark, sf).canonical, folder)
    found = sinks.order_check(spark, folder)
    return found.agg(F.sum("rows").alias("rows"), F.sum("out_of_order").alias("out_of_order"))


@query
def stored_sql(spark, sf):
    """Parameterised SQL over the view of stored partitions."""
    folder = shared_folder(spark, "canonical")
    sinks.write_canonical_partitions(Tables(spark, sf).canonical, folder)
    return files.query_canonical(
        spark,
        folder,
        "SELECT Division, FTR, count(*) AS n FROM matches WHERE SeasonStartYear >= :year AND Division <> :without GROUP BY Division, FTR",
        {"year": YEARS[0], "without": "N03"},
    )


@query
def ledger_round_trip(spark, sf):
    """Experiment records through the JSON report sink and back, ranked within their population."""
    folder = shared_folder(spark, "records")
    sinks.write_report(division_records(Tables(spark, sf)), folder)
    back = files.read_experiment_records(spark, folder, lines=True)
    return plain(ledger.rank_raw_within_population(ledger.validate_ledger(back)))


@query
def malformed_rows(spark, sf):
    """Counts and previews of malformed values: dates, seasons and counts made unusable."""
    t = Tables(spark, sf)
    raw = t.matches.selectExpr(
        "Division AS Div",
        "CASE WHEN game_id % 5 = 0 THEN concat('day ', cast(game_id AS string)) ELSE cast(MatchDate AS string) END AS Date",
        "CASE WHEN game_id % 7 = 0 THEN '2324' WHEN game_id % 7 = 1 THEN '1999-2001' ELSE cast(SeasonStartYear AS string) END AS Season",
        "HomeTeam",
        "AwayTeam",
        "FTR",
        "CASE WHEN game_id % 11 = 0 THEN '1.5' ELSE cast(FTHome AS string) END AS FTHG",
        "CASE WHEN game_id % 13 = 0 THEN 'x' ELSE cast(FTAway AS string) END AS FTAG",
        *S.MATCH_STATS,
    )
    out = canonical.bad_row_preview(canonical.normalise(raw))
    return out.withColumn("preview", F.array_join("preview", ","))


def audit_row(audit: DataFrame) -> DataFrame:
    lists = ("issues", "missing_columns")
    joined = [F.array_join(c, "; ").alias(c) for c in lists]
    return plain(audit.select(*[c for c in audit.columns if c not in lists], *joined))


def faulty_rows(t: Tables) -> DataFrame:
    """Match rows with a fault of every kind seeded by number."""
    return t.matches.selectExpr(
        "CASE WHEN game_id % 17 = 0 THEN NULL ELSE MatchDate END AS MatchDate",
        "SeasonStartYear",
        "CASE WHEN game_id % 19 = 0 THEN ' ' ELSE Division END AS Division",
        "HomeTeam",
        "CASE WHEN game_id % 23 = 0 THEN HomeTeam ELSE AwayTeam END AS AwayTeam",
        "CASE WHEN game_id % 29 = 0 THEN 'X' ELSE FTR END AS FTR",
        "CASE WHEN game_id % 31 = 0 THEN -1 ELSE FTHome END AS FTHome",
        "FTAway",
        *S.MATCH_STATS,
    )


@query
def canonical_audit(spark, sf):
    return audit_row(canonical.audit_canonical(Tables(spark, sf).canonical))


@query
def canonical_audit_faults(spark, sf):
    """The audit of rows with seeded faults; every rule's code is among its issues."""
    faulty = faulty_rows(Tables(spark, sf)).withColumn(
        "SeasonStartYear", F.when(F.month("MatchDate") != 7, F.col("SeasonStartYear"))
    )
    return audit_row(canonical.audit_canonical(faulty))


@query
def canonical_issue_counts(spark, sf):
    """The canonical rules counted over rows with seeded faults."""
    return canonical.canonical_issues(faulty_rows(Tables(spark, sf)))


@query
def natural_key_check(spark, sf):
    """Order lines whose (order, line number) repeats."""
    lines = Tables(spark, sf).base("lineitem")
    return canonical.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query
def target_check(spark, sf):
    return guards.target_issues(labelled(Tables(spark, sf)), ("FTR", *S.TARGETS[:4]))


@query
def feature_check(spark, sf):
    """The closed feature-table rules over the complete feature table."""
    return guards.feature_issues(features.build_feature_table(Tables(spark, sf).canonical, EXPECTED))


@query
def feature_check_faults(spark, sf):
    """The same rules over a feature table with faults seeded by day of the month."""
    day = F.dayofmonth("MatchDate")
    made = features.build_feature_table(Tables(spark, sf).canonical, EXPECTED).withColumns(
        {
            "target_draw": F.when(day == 3, 1 - F.col("target_draw")).otherwise(F.col("target_draw")),
            "EloDiff_pre": F.when(day == 4, float("inf")).otherwise(F.col("EloDiff_pre")),
            "target_ou25": F.when(day == 5, 7).otherwise(F.col("target_ou25")),
            "FTR": F.when(day == 6, "X").when(day == 8, None).otherwise(F.col("FTR")),
            "HomeElo_pre": F.when(day == 7, float("nan")).otherwise(F.col("HomeElo_pre")),
            "SeasonStartYear": F.when(day != 9, F.col("SeasonStartYear")),
        }
    )
    return guards.feature_issues(made)


@query
def column_roles(spark, sf):
    """Role and present values of every column of the match table with its labels."""
    t = Tables(spark, sf)
    return guards.column_roles(labels.add_target_labels(t.matches))


@query
def sides_unpivot(spark, sf):
    """Goals per team and season from each team's own perspective."""
    rows = form.team_sides(Tables(spark, sf).canonical)
    return plain(
        rows.groupBy("Division", "SeasonStartYear", "team").agg(
            F.count(F.lit(1)).alias("matches"),
            F.sum("points").alias("points"),
            F.sum("Goals_for").alias("goals_for"),
            F.sum("Goals_against").alias("goals_against"),
        )
    )


@query
def fold_assignment(spark, sf):
    rows = tagged(Tables(spark, sf))
    return plain(rows.select("fold", "fold_role", "part", *S.KEY))


@query
def fold_bounds(spark, sf):
    return plain(folds.fold_bounds(tagged(Tables(spark, sf))))


@query
def inner_time_split(spark, sf):
    train = tagged(Tables(spark, sf)).where(F.col("part") == "train")
    out = folds.inner_time_split(train)
    return plain(
        out.groupBy("fold", "inner_part").agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("MatchDate").alias("first_date"),
            F.max("MatchDate").alias("last_date"),
        )
    )


@query
def date_batches(spark, sf):
    return plain(folds.date_batches(Tables(spark, sf).canonical).select("batch", *S.KEY))


@query
def training_prior(spark, sf):
    return plain(baselines.training_prior(tagged(Tables(spark, sf))))


@query
def devig_market(spark, sf):
    rows = market.prepare_closing_market(Tables(spark, sf).market)[0]
    return plain(market.closing_market_probabilities(rows))


@query
def market_audit(spark, sf):
    return market.market_audit(market.market_rows(Tables(spark, sf).market))


@query
def market_alignment(spark, sf):
    t = Tables(spark, sf)
    return plain(market.align_closing_market(t.canonical, t.market))


@query
def market_coverage(spark, sf):
    t = Tables(spark, sf)
    return plain(market.market_coverage(t.canonical, t.market))


@query
def coverage_slices(spark, sf):
    t = Tables(spark, sf)
    keys = market.prepare_closing_market(t.market)[0]
    return plain(market.coverage_slices(t.canonical, keys))


@query
def probability_sanity(spark, sf):
    """Sanity counts over market probabilities, some of them spoiled."""
    t = Tables(spark, sf)
    rows = market.closing_market_probabilities(
        market.prepare_closing_market(t.market)[0]
    ).withColumn(
        "probability_home",
        F.when(F.dayofmonth("MatchDate") == 1, F.lit(float("nan")))
        .when(F.dayofmonth("MatchDate") == 2, F.col("probability_home") + 1.0)
        .otherwise(F.col("probability_home")),
    )
    return metrics.probability_sanity(rows, ["Division"])


@query
def probability_metrics(spark, sf):
    return plain(metrics.evaluate(simple_predictions(Tables(spark, sf))))


@query
def calibration_bins(spark, sf):
    return plain(metrics.calibration_bins(simple_predictions(Tables(spark, sf))))


def _fold_metrics(spark, sf):
    return metrics.evaluate(simple_predictions(Tables(spark, sf)), ["fold", "fold_role", "model"])


@query
def weighted_views(spark, sf):
    return plain(metrics.weighted_views(_fold_metrics(spark, sf)))


@query
def gate(spark, sf):
    compared = metrics.compare_models(_fold_metrics(spark, sf), "training_prior")
    return plain(metrics.gate(compared))


@query
def report_round_trip(spark, sf):
    """The report of market against prior as one document, stored, read back and laid out again."""
    t = Tables(spark, sf).stored("matches")
    folder = shared_folder(spark, "report")
    coverage = market.market_coverage(t.canonical, t.market)
    made = report.assemble(durable(_fold_metrics(spark, sf)), "closing_market", "training_prior", coverage)
    sinks.write_report(made, folder)
    return plain(report.fold_rows(report.read_reports(spark, folder)))


@query
def best_candidate(spark, sf):
    return plain(metrics.best_candidate(_fold_metrics(spark, sf)))


@query
def identical_rows(spark, sf):
    """Rows of a fold that not every model scored: here the market-less test rows."""
    t = Tables(spark, sf).stored("matches")
    rows = tagged(t)
    uncut = baselines.uniform_predictions(rows).unionByName(
        simple_predictions(t).where(F.col("model") == "market")
    )
    return plain(metrics.rows_not_shared(uncut).groupBy("fold", "models", "rows").count())


# Two teams go by other names in the derived external rows; all others differ by accent and mark.
XG_ALIASES = {"team zero": "t00", "team one": "t01"}
XG_DIVISIONS = tuple(f"N{i:02d}" for i in range(5))


def external(t: Tables, good: bool = False) -> DataFrame:
    return xg.normalise_external(t.external_xg_good if good else t.external_xg, XG_ALIASES)


def aligned_xg(t: Tables, good: bool = False) -> DataFrame:
    source = t.scored if good else t.matches
    return xg.align_external_xg(source, external(t, good), XG_ALIASES)


@query
def team_names(spark, sf):
    """Raw and normalised external names with their number of rows."""
    t = Tables(spark, sf)
    name = names.team_name_udf(XG_ALIASES)
    rows = t.external_xg.select("HomeTeam", name("HomeTeam").alias("normalised"))
    return rows.groupBy("HomeTeam", "normalised").agg(F.count(F.lit(1)).alias("rows"))


@query
def xg_audit(spark, sf):
    """External rows audited with spoiled values, repeated keys and a foreign division."""
    t = Tables(spark, sf)
    base = t.external_xg.withColumn(
        "home_xg",
        F.when(F.dayofmonth("MatchDate") == 3, F.lit(-1.0))
        .when(F.dayofmonth("MatchDate") == 4, F.lit(None))
        .otherwise(F.col("home_xg")),
    )
    again = base.where(F.dayofmonth("MatchDate") == 5)
    normal = xg.normalise_external(base.unionByName(again), XG_ALIASES)
    return plain(xg.external_audit(normal, XG_DIVISIONS[:4]))


@query
def xg_alignment(spark, sf):
    out = aligned_xg(Tables(spark, sf))
    return plain(out.drop("_home", "_away"))


@query
def xg_unmatched(spark, sf):
    """External rows no match claims, when the matches lose one day in ten."""
    t = Tables(spark, sf)
    fewer = t.matches.where(F.dayofmonth("MatchDate") % 10 != 0)
    return plain(xg.unmatched_external(fewer, external(t), XG_ALIASES))


@query
def xg_coverage(spark, sf):
    return plain(xg.alignment_coverage(aligned_xg(Tables(spark, sf))))


@query
def xg_quality(spark, sf):
    """The gates on the failing and on the passing external table."""
    t = Tables(spark, sf)
    rows = [
        xg.quality(aligned_xg(t, good)).withColumn("source", F.lit(n))
        for n, good in (("external_xg", False), ("external_xg_good", True))
    ]
    return plain(rows[0].unionByName(rows[1]))


@query
def xg_rolling(spark, sf):
    aligned = aligned_xg(Tables(spark, sf))
    return plain(xg.xg_features(aligned, aligned, inside=True))


@query
def relation_quality(spark, sf):
    t = Tables(spark, sf).stored("matches", "player_lines")
    return availability.relation_quality(t.fixtures, t.appearances, t.lineups, t.valuations)


@query
def valuation_asof(spark, sf):
    """Latest earlier valuation of every player on every day they appear."""
    t = Tables(spark, sf).stored("matches", "player_lines")
    asked = t.appearances.join(t.fixtures.select("game_id", "MatchDate"), "game_id")
    return plain(availability.value_as_of(asked, t.valuations))


def _sided(spark, sf, names, make):
    t = Tables(spark, sf).stored("matches", "player_lines")
    parts = durable(availability.participation(t.appearances, t.lineups))
    state = make(t, parts)
    joined = history.join_sides(t.fixtures.select(*S.KEY, "SeasonStartYear"), state, names)
    return plain(joined.select(*S.KEY, *availability.side_columns(names)))


@query
def availability_load(spark, sf):
    return _sided(
        spark, sf, S.AVAILABILITY_BASE[:6], lambda t, p: availability.load_state(t.fixtures, p)
    )


POOL_FEATURES = [
    c for c in S.AVAILABILITY_BASE if c.startswith(("top", "avg_player")) or c == "unique_starters_5"
]


@query
def availability_pool(spark, sf):
    return _sided(
        spark,
        sf,
        POOL_FEATURES,
        lambda t, p: availability.pool_state(availability.recent_games(t.fixtures), p, t.valuations),
    )


@query
def availability_value(spark, sf):
    chosen = [c for c in S.AVAILABILITY_BASE if "value" in c]
    return _sided(
        spark, sf, chosen, lambda t, p: availability.pool_state(availability.recent_games(t.fixtures), p, t.valuations)
    )


@query
def availability_lineup(spark, sf):
    chosen = [c for c in S.AVAILABILITY_BASE if c.endswith("_last") or c == "avg_starter_changes_5"]
    return _sided(spark, sf, chosen, lambda t, p: availability.lineup_state(availability.recent_games(t.fixtures), p))


def availability_table(t: Tables) -> DataFrame:
    t.stored("matches", "player_lines")
    return availability.availability_features(t.fixtures, t.appearances, t.lineups, t.valuations)


@query
def availability_features(spark, sf):
    return plain(availability_table(Tables(spark, sf)))


@query
def availability_scope(spark, sf):
    """Coverage of matches by fixtures, when a day in ten has no fixture."""
    t = Tables(spark, sf)
    fewer = t.fixtures.where(F.dayofmonth("MatchDate") % 10 != 0)
    return plain(availability.scope_coverage(labelled(t), fewer))


@query
def availability_completeness(spark, sf):
    return plain(availability.cell_completeness(availability_table(Tables(spark, sf))))


@query
def graph_edges(spark, sf):
    """Training edges of the first fold and the last, log1p weighted."""
    t = Tables(spark, sf).stored("matches", "player_lines")
    edges = graph.season_edges(t.fixtures, durable(graph.side_weights(t.appearances, t.lineups)))
    dims = folds.fold_table(spark, YEARS, derived.FINAL)
    return plain(graph.fold_edges(edges, dims))


@query
def graph_metadata(spark, sf):
    t = Tables(spark, sf).stored("matches", "player_lines")
    edges = graph.season_edges(t.fixtures, durable(graph.side_weights(t.appearances, t.lineups)))
    dims = folds.fold_table(spark, YEARS, derived.FINAL)
    return graph.fold_metadata(t.fixtures, graph.fold_edges(edges, dims), dims)


@query
def graph_pool(spark, sf):
    """Size and weight of each side's player pool over the last ten games."""
    t = Tables(spark, sf).stored("matches", "player_lines")
    weights = durable(graph.side_weights(t.appearances, t.lineups))
    state = graph.pool_summary(graph.recent_pool(t.fixtures, weights))
    joined = history.join_sides(
        t.fixtures.select(*S.KEY, "SeasonStartYear"), state, ["pool_players", "pool_weight"]
    )
    return plain(joined.drop("SeasonStartYear"))


@query
def graph_pool_values(spark, sf):
    """Pool vectors and their comparison; lines stand in as embedding of players with several."""
    t = Tables(spark, sf).stored("matches", "player_lines")
    weights = durable(graph.side_weights(t.appearances, t.lineups))
    values = [F.sqrt(F.max("qty") + i) - F.sqrt(F.min("qty") + 3 * i) for i in range(8)]
    lines = t.player_lines.groupBy("player_id").agg(
        F.array(*values).alias("embedding"), F.count(F.lit(1)).alias("lines")
    )
    stand_in = lines.where("lines > 3").drop("lines")
    pool = graph.recent_pool(t.fixtures, weights)
    made = graph.graph_features(t.fixtures, pool, stand_in, "svd8_recent10")
    return plain(made, 9)


@query
def match_sequences(spark, sf):
    """Every element of every side's last-ten sequence."""
    t = Tables(spark, sf).stored("matches")
    made = sequences.match_sequences(t.canonical, t.canonical, inside=True)
    sides = F.explode(
        F.array(
            F.struct(F.lit("H").alias("side"), F.col("home_sequence").alias("s")),
            F.struct(F.lit("A").alias("side"), F.col("away_sequence").alias("s")),
        )
    ).alias("x")
    flat = made.select(*S.KEY, sides).select(
        *S.KEY, "x.side", F.posexplode("x.s").alias("position", "d")
    )
    return plain(flat.select(*S.KEY, "side", "position", "d.*"))


@query
def gathered_sequences(spark, sf):
    """Sequences gathered for the matches that have odds: their number of matches, and goals scored."""
    t = Tables(spark, sf).stored("matches")
    made = sequences.match_sequences(t.canonical, t.canonical, inside=True, descriptors=("goals_for",))
    wanted = t.canonical.join(t.market.select(*S.KEY), list(S.KEY), "left_semi")
    goals_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["goals_for"])
    sides = ("home_sequence", "away_sequence")
    out = [F.size(c).alias(f"{c}_size") for c in sides] + [goals_of(c).alias(f"{c}_goals") for c in sides]
    return plain(sequences.gather(made, wanted).select(*S.KEY, *out))


@query
def vocabulary_ids(spark, sf):
    """Team tokens of the first fold's training seasons applied to all later matches."""
    t = Tables(spark, sf)
    train = t.canonical.where(F.col("SeasonStartYear") < YEARS[0])
    later = t.canonical.where(F.col("SeasonStartYear") >= YEARS[0]).select(*S.KEY)
    return plain(sequences.team_ids(later, sequences.train_vocabulary(train)))


@query
def sequence_encoding(spark, sf):
    """League and team identifiers of all folds' test rows, each by its own training vocabulary.

    A team is only known by its year of play in every fifth division, so that some are unseen.
    """
    t = Tables(spark, sf)
    yearly = F.when(F.substring("Division", 3, 1).isin("0", "5"), F.date_format("MatchDate", "yyyy")).otherwise("")
    rows = t.canonical.withColumn("HomeTeam", F.concat("HomeTeam", yearly)).select(*S.KEY, "SeasonStartYear")
    made = sequences.fold_team_ids(tagged(t, rows))
    return plain(made.drop("part", "SeasonStartYear", "fold_role"))


@query
def vocabulary_oov(spark, sf):
    """Unseen teams per fold, when a team is only known by its month of play."""
    t = Tables(spark, sf)
    renamed = t.canonical.withColumn(
        "HomeTeam", F.concat("HomeTeam", F.lit("-"), F.date_format("MatchDate", "yyyy"))
    )
    return sequences.oov_counts(tagged(t, renamed))


@query
def scaler_stats(spark, sf):
    """Train-only median, mean and scale of the 52 features in every fold."""
    table = features.build_feature_table(Tables(spark, sf).stored("matches").canonical, EXPECTED)
    names = {folds.fold_name(y): y for y in YEARS}
    return plain(scaling.column_stats(durable(table), S.FEATURES, names), 4)


@query
def goal_counts(spark, sf):
    """Training rows of the goals model, folded to distinct count triples."""
    rows = goals.side_rows(Tables(spark, sf).canonical)
    return rows.groupBy("SeasonStartYear", "goals", "sot", "off").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def pseudo_xg_fixed(spark, sf):
    """Pseudo-xG history features under given season coefficients."""
    t = Tables(spark, sf)
    given = t.canonical.groupBy("SeasonStartYear").agg(
        F.lit(-0.5).alias("b0"),
        (F.lit(0.01) * (F.col("SeasonStartYear") - 1990)).alias("b1"),
        F.lit(-0.02).alias("b2"),
    )
    return plain(goals.pseudo_xg_features(t.canonical, given.where(F.col("SeasonStartYear") > 1995)), 5)


@query
def pseudo_xg(spark, sf):
    """Walk-forward pseudo-xG features with one goals model per season."""
    return plain(goals.pseudo_xg_features(Tables(spark, sf).canonical))


def fitted_features(t: Tables) -> DataFrame:
    t.stored("matches")
    return durable(features.build_feature_table(t.canonical, EXPECTED))


def outcome_rows(outcome, baseline: str = "base52") -> DataFrame:
    """Fold metrics with improvement over the baseline."""
    compared = outcome.comparison(baseline).select(
        "fold", F.col("candidate").alias("model"), "improvement_log_loss"
    )
    return plain(outcome.fold_metrics.join(compared, ["fold", "model"], "left"))


@query
def lr_backtest(spark, sf):
    out = experiments.backtest(fitted_features(Tables(spark, sf)), YEARS, derived.FINAL)
    return plain(out.fold_metrics)


@query
def logistic_score_equations(spark, sf):
    """Largest gradient of every fitted coefficient row at the solution, by fold: zero if it converged."""
    table = fitted_features(Tables(spark, sf))
    out = experiments.backtest(table, YEARS, derived.FINAL)
    parts = []
    for m in out.models:
        gradient = classify.score_equations(m)
        parts.append(gradient.select(F.lit(m.fold).alias("fold"), "feature", "gradient"))
    return plain(experiments.union(parts), 4)


@query
def prediction_equations(spark, sf):
    """Test probabilities of every fold made again of the stored coefficients; rows, and the largest gap."""
    out = experiments.backtest(fitted_features(Tables(spark, sf)), YEARS, derived.FINAL)
    table = durable(classify.coefficient_table(out.models))
    again = classify.recomputed_logistic(out.models, table)
    return plain(classify.recomputed_gap(out.predictions, again), 9)


@query
def network_equations(spark, sf):
    """The same of the layered networks, from their stored layers; every model of every fold it was fitted in."""
    _, out = experiments.capacity_audit(fitted_features(Tables(spark, sf)), YEARS, derived.FINAL)
    networks = [m for m in out.models if m.name in classify.LAYERS]
    again = classify.recomputed_networks(networks, durable(classify.layer_table(networks)))
    made = plain(classify.recomputed_gap(out.predictions, again), 9)
    # which network reaches the final fold is the audit's choice, so the models of a fold are counted
    return made.groupBy("fold").agg(
        F.min("rows").alias("rows"), F.max("rows").alias("most_rows"), F.max("gap").alias("gap")
    )


@query
def poisson_score_equations(spark, sf):
    """The goals model's likelihood equations in every season, relative to its goals."""
    matches = Tables(spark, sf).canonical
    fitted = goals.walk_forward_coefficients(matches)
    first = matches.groupBy("SeasonStartYear").agg(F.min("MatchDate").alias("first"))
    rows = goals.side_rows(matches).drop("SeasonStartYear")
    # one row for each season on the broadcast side
    seen = rows.join(F.broadcast(fitted.join(first, "SeasonStartYear")), F.col("MatchDate") < F.col("first"))
    rest = F.col("goals") - F.exp(F.col("b0") + F.col("b1") * F.col("sot") + F.col("b2") * F.col("off"))
    return plain(
        seen.groupBy("SeasonStartYear").agg(
            (F.sum(rest) / F.sum("goals")).alias("intercept"),
            (F.sum(rest * F.col("sot")) / F.sum(F.col("goals") * F.col("sot"))).alias("sot"),
            (F.sum(rest * F.col("off")) / F.sum(F.col("goals") * F.col("off"))).alias("off"),
        ),
        3,
    )


@query
def market_comparison(spark, sf):
    t = Tables(spark, sf)
    out = experiments.backtest(fitted_features(t), YEARS, derived.FINAL)
    return plain(experiments.compare_with_market(out, t.market)[1])


@query
def pseudo_xg_candidate(spark, sf):
    t = Tables(spark, sf)
    out = experiments.compare_candidate(
        fitted_features(t),
        goals.pseudo_xg_features(t.canonical),
        S.PSEUDO_XG_FEATURES,
        "pseudo_xg",
        YEARS,
        derived.FINAL,
    )
    return outcome_rows(out)


@query
def xg_candidate(spark, sf):
    """External-xG candidate on the covered matches, behind its audit and quality gates."""
    t = Tables(spark, sf)
    divisions = [r[0] for r in t.matches.select("Division").distinct().orderBy("Division").collect()]
    out = experiments.external_xg_comparison(
        fitted_features(t), t.scored, t.external_xg_good, divisions, XG_ALIASES, YEARS, derived.FINAL
    )
    return outcome_rows(out)


@query
def availability_candidate(spark, sf):
    t = Tables(spark, sf).stored("matches", "player_lines", "appearances", "lineups", "valuations")
    out, _ = experiments.availability_comparison(
        fitted_features(t), t.fixtures, t.appearances, t.lineups, t.valuations, YEARS, derived.FINAL
    )
    return outcome_rows(out)


@query
def graph_embedding(spark, sf):
    """Singular values' worth of every fold's player embedding: sign-free summary."""
    t = Tables(spark, sf).stored("matches", "player_lines")
    edges = graph.season_edges(t.fixtures, durable(graph.side_weights(t.appearances, t.lineups)))
    edges = durable(graph.fold_edges(edges, folds.fold_table(spark, YEARS, derived.FINAL)))
    names = [folds.fold_name(y) for y in YEARS]
    made = experiments.side_by_side(
        lambda f: graph.player_embeddings(edges.where(F.col("fold") == f), 8).withColumn("fold", F.lit(f)),
        names,
    )
    return plain(
        experiments.union(made)
        .select("fold", F.posexplode("embedding").alias("axis", "value"))
        .groupBy("fold", "axis")
        .agg(
            F.count(F.lit(1)).alias("players"),
            F.sum(F.col("value") * F.col("value")).alias("squared_length"),
        ),
        4,
    )


@query
def embedding_equations(spark, sf):
    """Orthogonality and singular equations of every fold's player embedding: zero if it is exact."""
    t = Tables(spark, sf).stored("matches", "player_lines")
    edges = graph.season_edges(t.fixtures, durable(graph.side_weights(t.appearances, t.lineups)))
    edges = durable(graph.fold_edges(edges, folds.fold_table(spark, YEARS, derived.FINAL)))

    def residuals(fold):
        own = edges.where(F.col("fold") == fold)
        made = durable(graph.player_embeddings(own, 8))
        return durable(graph.embedding_residuals(own, made).withColumn("fold", F.lit(fold)))

    names = [folds.fold_name(y) for y in YEARS]
    return plain(experiments.union(experiments.side_by_side(residuals, names)), 6)


@query
def graph_candidate(spark, sf):
    return outcome_rows(graph_experiment(spark, sf)[1])


def graph_experiment(spark, sf):
    t = Tables(spark, sf)
    return graph_plan.graph_comparison(
        fitted_features(t), t.fixtures, t.appearances, t.lineups, YEARS, derived.FINAL
    )


@query
def sequence_candidate(spark, sf):
    t = Tables(spark, sf)
    return outcome_rows(experiments.sequence_comparison(fitted_features(t), t.canonical, YEARS, derived.FINAL))


@query
def capacity_audit(spark, sf):
    table = fitted_features(Tables(spark, sf))
    return outcome_rows(experiments.capacity_audit(table, YEARS, derived.FINAL)[1])


def division_records(t: Tables) -> DataFrame:
    """One experiment record per division: the market against the training prior."""
    scored = metrics.evaluate(simple_predictions(t), ["Division", "fold", "fold_role", "model"])
    compared = metrics.compare_models(
        scored.where(F.col("model") != "uniform"),
        "training_prior",
        ["Division", "fold", "fold_role"],
    )
    return ledger.records_from_comparison(compared, "Division")


@query
def candidate_ranking(spark, sf):
    checked = ledger.recheck(division_records(Tables(spark, sf)))
    return plain(ledger.rank_by_improvement(checked))


@query
def population_ranking(spark, sf):
    checked = ledger.recheck(division_records(Tables(spark, sf)))
    return plain(ledger.rank_raw_within_population(checked))


@query
def ledger_checks(spark, sf):
    """Stored improvements spoiled in every third division and caught by the recheck."""
    records = division_records(Tables(spark, sf))
    spoiled = records.withColumn(
        "development",
        F.when(
            F.substring("experiment_id", -2, 2).cast("int") % 3 == 0,
            F.col("development").withField(
                "improvement_log_loss", F.col("development.improvement_log_loss") + 0.5
            ),
        ).otherwise(F.col("development")),
    )
    checked = ledger.recheck(spoiled)
    return plain(
        checked.select(
            "experiment_id",
            "improvement",
            "improving_folds",
            "passed",
            F.array_join("issues", "; ").alias("issues"),
        )
    )
