"""Probability checks, log loss, Brier score, calibration error, weighted views and the gate.

Predictions travel as one long table: fold, model, the match key, the label and three
probabilities. Every metric of every fold and model comes out of a single aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import count_if, every, finite, require

# Metric and gate parameters.
EPSILON = 1e-15
SUM_TOLERANCE = 1e-8
BINS = 10
MIN_IMPROVEMENT = 0.005
MIN_FOLDS = 2
DEVELOPMENT_FOLDS = 3

P = S.PROBABILITIES
METRICS = ("log_loss", "brier_score", "ece")
VIEWS = {
    "development": ("development", "all_historical_diagnostic"),
    "historical_final": ("historical_final", "all_historical_diagnostic"),
}


def total() -> Column:
    return F.col(P[0]) + F.col(P[1]) + F.col(P[2])


def probability_sanity(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Violations per rule; probabilities are never clipped or renormalised."""
    ok = every(*[finite(F.col(c)) for c in P])
    inside = every(*[F.col(c).between(0.0, 1.0) for c in P])
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(~ok).alias("not_finite"),
        count_if(ok & ~inside).alias("outside_unit_interval"),
        count_if(ok & (F.abs(total() - 1.0) > SUM_TOLERANCE)).alias("not_summing_to_one"),
    )


def validate_probabilities(df: DataFrame) -> None:
    row = probability_sanity(df).first()
    if row.rows == 0:
        raise S.ContractError("no predictions")
    wrong = {k: v for k, v in row.asDict().items() if v and k != "rows"}
    if wrong:
        raise S.ContractError(f"invalid probabilities: {wrong}")


def usable_predictions(predictions: DataFrame) -> DataFrame:
    """The predictions; a row whose label or probabilities are unusable stops the job."""
    usable = every(
        F.coalesce(F.col("label").isin(*S.CLASSES), F.lit(False)),
        *[finite(F.col(c)) & F.col(c).between(0.0, 1.0) for c in P],
    ) & (F.abs(total() - 1.0) <= SUM_TOLERANCE)
    return require(predictions, usable, "invalid label or probabilities")


def score_columns(bins: int = BINS, epsilon: float = EPSILON) -> list[Column]:
    """Per prediction: log loss, Brier score, confidence, hit and calibration bin."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    hit = [F.col("label") == c for c in S.CLASSES]
    true_p = F.when(hit[0], F.col(P[0])).when(hit[1], F.col(P[1])).otherwise(F.col(P[2]))
    brier = sum(
        ((F.col(p) - h.cast("double")) ** 2 for p, h in zip(P[1:], hit[1:], strict=True)),
        (F.col(P[0]) - hit[0].cast("double")) ** 2,
    )
    best = F.greatest(*[F.col(c) for c in P])
    # ties go to the first class in order
    top = (
        F.when(F.col(P[0]) == best, S.CLASSES[0])
        .when(F.col(P[1]) == best, S.CLASSES[1])
        .otherwise(S.CLASSES[2])
    )
    # right-closed bins over the exact floating-point edges
    edges = np.linspace(0.0, 1.0, bins + 1)[1:]
    above = sum(((best > float(e)).cast("int") for e in edges[1:]), (best > float(edges[0])).cast("int"))
    return [
        (-F.ln(F.greatest(true_p, F.lit(epsilon)))).alias("log_loss"),
        brier.alias("brier_score"),
        best.alias("confidence"),
        (F.col("label") == top).cast("double").alias("hit"),
        F.least(above, F.lit(bins - 1)).alias("bin"),
    ]


def evaluate(predictions: DataFrame, by: Sequence[str] = ("fold", "model"), bins: int = BINS) -> DataFrame:
    """n_samples, log_loss, brier_score and ece per group, in one pass over the predictions."""
    scored = usable_predictions(predictions).select(*by, *score_columns(bins))
    per_bin = scored.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("log_loss").alias("ll"),
        F.sum("brier_score").alias("bs"),
        F.sum("confidence").alias("conf"),
        F.sum("hit").alias("hits"),
    )
    n = F.sum("n")
    return per_bin.groupBy(*by).agg(
        n.alias("n_samples"),
        (F.sum("ll") / n).alias("log_loss"),
        (F.sum("bs") / n).alias("brier_score"),
        (F.sum(F.abs(F.col("hits") - F.col("conf"))) / n).alias("ece"),
    )


def calibration_bins(predictions: DataFrame, by: Sequence[str] = ("fold", "model"), bins: int = BINS) -> DataFrame:
    """Rows, accuracy and mean confidence of every occupied calibration bin."""
    scored = usable_predictions(predictions).select(*by, *score_columns(bins))
    return scored.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("hit").alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
    )


def with_views(folds: DataFrame, role: str = "fold_role") -> DataFrame:
    """Repeat each fold row under every view it counts towards."""
    known = F.when(
        F.col(role) == "historical_final",
        F.array(*[F.lit(v) for v in VIEWS["historical_final"]]),
    ).otherwise(F.array(*[F.lit(v) for v in VIEWS["development"]]))
    return folds.withColumn("view", F.explode(known))


def weighted_views(fold_metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Sample-count-weighted metrics of the development, final and diagnostic views."""
    n = F.sum("n_samples")
    weighted = [(F.sum(F.col(m) * F.col("n_samples")) / n).alias(m) for m in METRICS]
    return (
        with_views(fold_metrics)
        .groupBy(*by, "view")
        .agg(F.count(F.lit(1)).alias("fold_count"), n.alias("n_samples"), *weighted)
    )


def compare_models(
    fold_metrics: DataFrame, baseline: str, by: Sequence[str] = ("fold", "fold_role")
) -> DataFrame:
    """Baseline next to every other model, with improvement = baseline minus candidate log loss."""
    base = fold_metrics.where(F.col("model") == baseline).select(
        *by,
        F.col("n_samples").alias("baseline_n"),
        F.col("log_loss").alias("baseline_log_loss"),
    )
    rest = fold_metrics.where(F.col("model") != baseline)
    return rest.join(base, list(by)).select(
        *by,
        F.col("model").alias("candidate"),
        "n_samples",
        "baseline_n",
        "baseline_log_loss",
        F.col("log_loss").alias("candidate_log_loss"),
        (F.col("baseline_log_loss") - F.col("log_loss")).alias("improvement_log_loss"),
    )


def gate(
    comparison: DataFrame,
    minimum_improvement: float = MIN_IMPROVEMENT,
    minimum_folds: int = MIN_FOLDS,
    development_folds: int = DEVELOPMENT_FOLDS,
) -> DataFrame:
    """The fixed development gate per candidate; the final fold is reported and never rescues."""
    if minimum_improvement <= 0 or not 1 <= minimum_folds <= development_folds:
        raise ValueError("gate thresholds are out of range")
    dev = F.col("fold_role") == "development"
    n, delta = F.col("n_samples"), F.col("improvement_log_loss")

    def weighted(value: Column, part: Column) -> Column:
        rows = F.sum(F.when(part, n))
        return F.sum(F.when(part, value * n)) / rows

    observed = comparison.groupBy("candidate").agg(
        count_if(dev).alias("development_fold_count"),
        (
            weighted(F.col("baseline_log_loss"), dev) - weighted(F.col("candidate_log_loss"), dev)
        ).alias("candidate_improvement_log_loss"),
        count_if(dev & (delta > 0)).alias("improving_fold_count"),
        weighted(delta, ~dev).alias("historical_final_improvement_log_loss"),
    )
    observed = require(
        observed,
        F.col("development_fold_count") == development_folds,
        f"the gate needs {development_folds} development folds",
    )
    passed = (
        (F.col("candidate_improvement_log_loss") >= minimum_improvement)
        & (F.col("improving_fold_count") >= minimum_folds)
    )
    return observed.withColumn("passed", passed).withColumn(
        "verdict", F.when(F.col("passed"), "passed").otherwise("failed")
    )


def rows_not_shared(predictions: DataFrame) -> DataFrame:
    """(fold, key) groups that some model of the fold did not score exactly once."""
    models = predictions.groupBy("fold").agg(F.countDistinct("model").alias("_models"))
    per_key = predictions.groupBy("fold", *S.KEY).agg(
        F.countDistinct("model").alias("models"), F.count(F.lit(1)).alias("rows")
    )
    return (
        per_key.join(F.broadcast(models), "fold")  # one row per fold
        .where((F.col("models") != F.col("_models")) | (F.col("rows") != F.col("_models")))
        .drop("_models")
    )


def assert_identical_rows(predictions: DataFrame) -> None:
    if rows_not_shared(predictions).limit(1).collect():
        raise S.ContractError("models of one fold were not scored on identical rows")


def best_candidate(fold_metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest weighted development log loss, ties by name; the final fold is not looked at."""
    n = F.col("n_samples")
    dev = fold_metrics.where(F.col("fold_role") == "development")
    pooled = dev.groupBy(*by, "model").agg(
        (F.sum(F.col("log_loss") * n) / F.sum(n)).alias("development_log_loss")
    )
    rank = F.struct("development_log_loss", "model")
    return pooled.groupBy(*by).agg(
        F.min_by("model", rank).alias("selected"),
        F.min("development_log_loss").alias("development_log_loss"),
    )


