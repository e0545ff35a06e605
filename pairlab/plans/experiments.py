"""Backtests and candidate comparisons on expanding folds.

A driver loop runs over folds and models (a handful of fits); every row-level step is a Spark
job. Tables read by several fits are cut once with a durable write, and all predictions end in
one long table that is scored in a single aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import percentage, require
from pairlab.models import classify
from pairlab.operators import availability, baselines, folds, guards, market, metrics, sequences, xg
from pairlab.plans import ledger
from pairlab.session import durable

BASELINE = "base52"
PARALLEL_FITS = 6


@dataclass
class Spec:
    """A model to fit in every fold: its name, its columns, its kind and whether it reads the encoding."""

    name: str
    columns: tuple[str, ...]
    kind: str = "logistic"
    encoded: bool = False

    def wanted(self, design: classify.Design) -> classify.Wanted:
        chosen = self.kind == "selected"
        return classify.Wanted(design, self.columns, self.name, None if chosen else classify.C, chosen, self.encoded)


@dataclass
class Outcome:
    """Everything an experiment reports, as tables."""

    predictions: DataFrame
    fold_metrics: DataFrame
    models: list

    def views(self) -> DataFrame:
        return metrics.weighted_views(self.fold_metrics)

    def comparison(self, baseline: str = BASELINE) -> DataFrame:
        return metrics.compare_models(self.fold_metrics, baseline)

    def gate(self, baseline: str = BASELINE) -> DataFrame:
        return metrics.gate(self.comparison(baseline))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def join_candidate(table: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left one-to-one join of candidate features; a base row without one stops the job."""
    right = features.select(*S.KEY, *columns, F.lit(True).alias("_hit"))
    joined = table.join(right, list(S.KEY), "left")
    found = F.coalesce("_hit", F.lit(False))
    return require(joined, found, "a base row has no candidate features").drop("_hit")


def fold_rows(table: DataFrame, year: int, final: int) -> DataFrame:
    """Train and test rows of one fold; plain season filters, so partitions are pruned."""
    season = F.col("SeasonStartYear")
    role = "historical_final" if year == final else "development"
    return table.where(season <= year).select(
        "*",
        F.lit(folds.fold_name(year)).alias("fold"),
        F.lit(year).cast("bigint").alias("test_year"),
        F.lit(role).alias("fold_role"),
        F.when(season == year, "test").otherwise("train").alias("part"),
    )


def side_by_side(work, tasks: Sequence) -> list:
    """Run independent chains of small jobs a few at a time, in order of ``tasks``."""
    spark = SparkSession.active()
    with ThreadPool(max(1, min(PARALLEL_FITS, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), tasks)


def run_models(
    table: DataFrame | Mapping[int, DataFrame],
    specs: Sequence[Spec],
    years: Sequence[int],
    final: int,
    stats: dict | None = None,
    contract: Sequence[str] = S.FEATURES,
    extra: Callable[[int], dict[str, Column]] | None = None,
) -> tuple[DataFrame, list]:
    """Fit every model in every fold and return the long predictions and the fitted models.

    ``table`` is one stored table for all folds, or one for each test year where features depend on the
    fold. ``contract`` lists the features that the experiment declares; models may take no others.
    ``extra`` gives a test year's inputs that are taken as they are, for models that read the encoding.
    All logistic regressions on a table share each pass over it.
    """
    columns = list(dict.fromkeys(c for s in specs for c in s.columns))
    season = F.col("SeasonStartYear")

    def designs(task):
        source, own_years = task
        own = stats or classify.fold_stats(source, columns, own_years)
        names = {folds.fold_name(y): y for y in own_years}
        parts = {f: fold_rows(source, y, final) for f, y in names.items()}
        more = {f: extra(y) for f, y in names.items()} if extra else None
        return classify.shared_designs(source, parts, {f: season < y for f, y in names.items()}, columns, own, more)

    if isinstance(table, Mapping):
        sources = [(table[y], [y]) for y in years]
    else:
        sources = [(table, list(years))]
    made = side_by_side(designs, sources)
    logistic = [s for s in specs if s.kind != "network"]
    tasks: list = [[(d, s) for d in group for s in logistic] for group in made] if logistic else []
    tasks += [[(d, s)] for group in made for d in group for s in specs if s.kind == "network"]

    def fit(task):
        design, spec = task[0]
        if spec.kind == "network":
            return [classify.fit_network(design, spec.columns, spec.name, contract=contract)]
        return classify.fit_together([s.wanted(d) for d, s in task], contract)

    # the longest fits first
    order = sorted(range(len(tasks)), key=lambda i: -sum(len(s.columns) * d.train_rows for d, s in tasks[i]))
    found = dict(zip(order, side_by_side(fit, [tasks[i] for i in order]), strict=True))
    by_name = {(m.fold, m.name): m for i in range(len(tasks)) for m in found[i]}
    models = [[by_name[d.fold, s.name] for s in specs] for group in made for d in group]
    return union([classify.test_predictions(own) for own in models]), [m for own in models for m in own]


def scored(predictions: DataFrame, models: list) -> Outcome:
    predictions = durable(predictions)
    metrics.assert_identical_rows(predictions)
    by = ["fold", "test_year", "fold_role", "model"]
    return Outcome(predictions, durable(metrics.evaluate(predictions, by)), models)


def prepare(table: DataFrame, columns: Sequence[str], years: Sequence[int], final: int) -> DataFrame:
    """The columns an experiment reads, written once and partitioned by season."""
    kept = durable(
        table.select(*S.METADATA, "target_1x2", *columns), partition_by=("SeasonStartYear",)
    ).withColumn("SeasonStartYear", F.col("SeasonStartYear").cast("bigint"))
    folds.check_folds(folds.expanding_folds(kept, years, final), years)
    return kept


def backtest(
    features: DataFrame, years: Sequence[int] = folds.YEARS, final: int = S.FINAL_YEAR
) -> Outcome:
    """The 52-feature model, the training prior and uniform probabilities on every fold."""
    table = prepare(features, S.FEATURES, years, final)
    fitted, models = run_models(table, [Spec(BASELINE, S.FEATURES)], years, final)
    tagged = folds.expanding_folds(table.select(*S.METADATA, "target_1x2"), years, final)
    simple = baselines.uniform_predictions(tagged).unionByName(baselines.prior_predictions(tagged))
    return scored(fitted.unionByName(simple), models)


def fold_report(outcome: Outcome, features: DataFrame, years, final) -> DataFrame:
    """Fold records: date ranges, row counts, fit iterations and the metrics of each model."""
    bounds = folds.fold_bounds(folds.expanding_folds(features.select(*S.METADATA), years, final))
    iterations = features.sparkSession.createDataFrame(
        [(m.fold, m.name, int(m.iterations), int(m.rows)) for m in outcome.models],
        "fold string, model string, model_iterations bigint, preprocessing_fit_rows bigint",
    )
    shown = outcome.fold_metrics.join(F.broadcast(iterations), ["fold", "model"], "left")
    return bounds.join(F.broadcast(shown.drop("test_year", "fold_role")), "fold")


def compare_with_market(
    outcome: Outcome, raw_market: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fold and view metrics on market-covered test rows next to full-test model metrics.

    Advantage is the model's aligned log loss minus the market's.
    """
    odds = market.closing_market_probabilities(market.prepare_closing_market(raw_market)[0])
    base = outcome.predictions.where(F.col("model") == BASELINE)
    quoted = (
        base.drop(*S.PROBABILITIES)
        .withColumn("model", F.lit("market"))
        .join(odds.drop("market_overround"), list(S.KEY))
        .select(*baselines.PREDICTION)
    )
    covered = outcome.predictions.join(
        quoted.select("fold", *S.KEY), ["fold", *S.KEY], "left_semi"
    )
    aligned = durable(covered.unionByName(quoted))
    metrics.assert_identical_rows(aligned)
    by = ["fold", "test_year", "fold_role", "model"]
    per_fold = metrics.evaluate(aligned, by).unionByName(
        outcome.fold_metrics.where(F.col("model") == BASELINE).withColumn(
            "model", F.lit("full_test_" + BASELINE)
        )
    )
    per_fold = durable(per_fold)
    views = metrics.weighted_views(per_fold)

    def advantage(df, by):
        ll = {m: F.max(F.when(F.col("model") == m, F.col("log_loss"))) for m in (BASELINE, "market")}
        rows = {
            m: F.max(F.when(F.col("model") == m, F.col("n_samples")))
            for m in ("market", "full_test_" + BASELINE)
        }
        return df.groupBy(*by).agg(
            rows["full_test_" + BASELINE].alias("candidate_test_rows"),
            rows["market"].alias("aligned_rows"),
            percentage(rows["market"], rows["full_test_" + BASELINE]).alias("coverage_percentage"),
            (ll[BASELINE] - ll["market"]).alias("market_advantage_log_loss"),
        )

    return (
        per_fold.join(advantage(per_fold, ["fold"]), "fold"),
        views.join(advantage(views, ["view"]), "view"),
    )


def compare_candidate(
    features: DataFrame,
    candidate: DataFrame,
    columns: Sequence[str],
    name: str,
    years: Sequence[int] = folds.YEARS,
    final: int = S.FINAL_YEAR,
) -> Outcome:
    """The 52-feature model against 52 plus the candidate's columns on identical rows."""
    table = prepare(
        join_candidate(features, candidate, columns), [*S.FEATURES, *columns], years, final
    )
    specs = [Spec(BASELINE, S.FEATURES), Spec(name, (*S.FEATURES, *columns))]
    contract = (*S.FEATURES, *columns)
    return scored(*run_models(table, specs, years, final, contract=contract))


def external_xg_comparison(
    features: DataFrame,
    matches: DataFrame,
    raw: DataFrame,
    divisions: Sequence[str],
    aliases: dict[str, str],
    years: Sequence[int] = folds.YEARS,
    final: int = S.FINAL_YEAR,
) -> Outcome:
    """External xG against the 52-feature model on the matches it covers, behind all its gates.

    The external rows must pass their audit, no two matches may fall on one normalised key, the
    aligned history must be sound and the quality gate must hold; each failure is an error.
    """
    external = xg.validate_external(raw, divisions, aliases)
    aligned = durable(xg.align_external_xg(matches, external, aliases))
    xg.check_alias_collapse(aligned)
    issues = {k: v for k, v in xg.history_issues(aligned).first().asDict().items() if v}
    if issues:
        raise S.ContractError(f"the external xG history is unsound: {issues}")
    measured = xg.quality(aligned).first()
    if not measured.passed:
        raise S.ContractError(f"external xG fails its quality gate: {measured.asDict()}")
    covered = features.join(aligned.select(*S.KEY), list(S.KEY), "left_semi")
    made = xg.xg_features(aligned, aligned, inside=True)
    return compare_candidate(covered, made, S.XG_FEATURES, "external_xg", years, final)


def availability_comparison(
    features: DataFrame,
    fixtures: DataFrame,
    appearances: DataFrame,
    lineups: DataFrame,
    valuations: DataFrame,
    years: Sequence[int] = folds.YEARS,
    final: int = S.FINAL_YEAR,
) -> tuple[Outcome, DataFrame]:
    """Player availability against the 52-feature model, and the report of the scope it covers.

    The four relations must pass their validation, none of the candidate's columns may be one that
    the timing policy refuses, and matches without a fixture are left out of both models.
    """
    availability.validate_relations(fixtures, appearances, lineups, valuations)
    refused = guards.timing_violations(S.AVAILABILITY_FEATURES)
    if refused:
        raise S.LeakageError(f"the timing policy refuses {refused}")
    report = durable(availability.scope_coverage(features, fixtures))
    made = durable(
        availability.availability_features(fixtures, appearances, lineups, valuations)
    )
    covered = features.join(fixtures.select(*S.KEY), list(S.KEY), "left_semi")
    outcome = compare_candidate(
        covered, made, S.AVAILABILITY_FEATURES, "availability", years, final
    )
    return outcome, report


def sequence_comparison(
    features: DataFrame,
    matches: DataFrame,
    years: Sequence[int] = folds.YEARS,
    final: int = S.FINAL_YEAR,
) -> Outcome:
    """Pooled last-ten sequences against the 52-feature model.

    The candidate also reads leagues and unseen teams as its own training rows know them, and its
    penalty is chosen on the last training dates.
    """
    names = sequences.pooled_names()
    made = sequences.pooled_representation(sequences.match_sequences(matches, matches, inside=True))
    table = prepare(
        sequences.with_first_seasons(join_candidate(features, made, names)),
        [*S.FEATURES, *names, *sequences.FIRST_SEASONS],
        years,
        final,
    )
    specs = [
        Spec(BASELINE, S.FEATURES),
        Spec("sequences", (*S.FEATURES, *names), "selected", encoded=True),
    ]
    contract = (*S.FEATURES, *names)
    encode = sequences.encoding(table)
    return scored(*run_models(table, specs, years, final, contract=contract, extra=encode))


def select_then_confirm(
    table: DataFrame, specs: Sequence[Spec], years: Sequence[int], final: int
) -> tuple[str, Outcome]:
    """Fit all candidates on development folds, pick one there, and score only it on the final.

    Rows of the final season are not read before the choice is made.
    """
    development = [y for y in years if y != final]
    base = Spec(BASELINE, S.FEATURES)
    early = table.where(F.col("SeasonStartYear") < final)
    dev, models = run_models(early, [base, *specs], development, final)
    dev = durable(dev)
    pooled = metrics.evaluate(dev, ["fold", "test_year", "fold_role", "model"])
    chosen = metrics.best_candidate(pooled.where(F.col("model") != BASELINE)).first().selected
    winner = next(s for s in specs if s.name == chosen)
    last, more = run_models(table, [base, winner], [final], final)
    return chosen, scored(dev.unionByName(last), [*models, *more])


def capacity_audit(
    features: DataFrame, years: Sequence[int] = folds.YEARS, final: int = S.FINAL_YEAR
) -> tuple[str, Outcome]:
    """Two fixed network capacities against the 52-feature model."""
    table = prepare(features, S.FEATURES, years, final)
    specs = [Spec(name, S.FEATURES, "network") for name in classify.LAYERS]
    return select_then_confirm(table, specs, years, final)


def experiment_records(outcome: Outcome) -> DataFrame:
    """One nested record per candidate, in the layout the ledger reads."""
    return ledger.records_from_comparison(outcome.comparison(), "candidate")
