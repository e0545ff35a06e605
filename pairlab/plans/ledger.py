"""The experiment ledger: stored results re-derived, one gate policy, guarded rankings.

Records are rows of nested values (see ``sources.files.read_experiment_records``). Nothing is
looked up per experiment, so the ledger is the same plan for eight runs or eight million.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import finite, preview
from pairlab.operators.indexing import dense_index
from pairlab.operators.metrics import MIN_FOLDS, MIN_IMPROVEMENT

# Tolerance and roles.
TOLERANCE = 1e-12
ROLES = ("baseline", "external_benchmark", "research_candidate")


def flatten(records: DataFrame) -> DataFrame:
    """One flat row per record, with the values recomputed from the stored folds."""
    def weighted(field: str):
        total = F.aggregate(
            F.transform("folds", lambda f: f["n_samples"].cast("double") * f[field]),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
        return total / rows

    rows = F.aggregate(
        F.transform("folds", lambda f: f["n_samples"].cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    gains = F.filter(
        "folds", lambda f: f["baseline_log_loss"] - f["candidate_log_loss"] > 0.0
    )
    return records.select(
        "schema_version",
        "experiment_id",
        "population_id",
        "role",
        F.col("development.n_samples").alias("development_samples"),
        F.col("development.baseline_log_loss").alias("baseline_log_loss"),
        F.col("development.candidate_log_loss").alias("candidate_log_loss"),
        F.col("development.improvement_log_loss").alias("stored_improvement"),
        F.col("historical_final.improvement_log_loss").alias("stored_final_improvement"),
        (
            F.col("historical_final.baseline_log_loss")
            - F.col("historical_final.candidate_log_loss")
        ).alias("final_improvement"),
        (
            F.col("development.baseline_log_loss") - F.col("development.candidate_log_loss")
        ).alias("improvement"),
        (weighted("baseline_log_loss") - weighted("candidate_log_loss")).alias(
            "fold_improvement"
        ),
        F.size("folds").cast("bigint").alias("fold_count"),
        F.size(gains).cast("bigint").alias("improving_folds"),
        F.col("success_gate.minimum_improvement_log_loss").alias("required_improvement"),
        F.col("success_gate.minimum_improving_folds").alias("required_folds"),
        F.col("success_gate.improving_fold_count").alias("stored_improving_folds"),
        F.col("success_gate.passed").alias("stored_passed"),
        "verdict",
        "disposition",
    )


def recheck(records: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Flat records with the recomputed verdict and the list of rules each one breaks."""
    flat = flatten(records)

    def close(a: str, b: str):
        return F.abs(F.col(a) - F.col(b)) <= tolerance

    passed = (F.col("improvement") >= F.col("required_improvement")) & (
        F.col("improving_folds") >= F.col("required_folds")
    )
    flat = flat.withColumn("passed", passed)
    needed = ("experiment_id", "population_id", "role", "verdict", "disposition")
    numbers = ("baseline_log_loss", "candidate_log_loss", "stored_improvement")
    rules = [
        *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in needed],
        *[F.when(~finite(F.col(c)), F.lit(f"{c} is not finite")) for c in numbers],
        F.when(~F.col("role").isin(*ROLES), F.lit("unknown role")),
        F.when(F.col("development_samples") < 1, F.lit("no development samples")),
        F.when(~close("stored_improvement", "improvement"), F.lit("improvement differs")),
        F.when(~close("fold_improvement", "improvement"), F.lit("folds do not add up")),
        F.when(
            ~close("stored_final_improvement", "final_improvement"),
            F.lit("final improvement differs"),
        ),
        F.when(
            F.col("stored_improving_folds") != F.col("improving_folds"),
            F.lit("improving folds differ"),
        ),
        F.when(F.col("stored_passed") != F.col("passed"), F.lit("gate verdict differs")),
        F.when(
            F.col("verdict") != F.when(F.col("passed"), "passed").otherwise("failed"),
            F.lit("verdict text differs"),
        ),
    ]
    return flat.withColumn("issues", F.array_compact(F.array(*rules)))


def policy_count(checked: DataFrame) -> DataFrame:
    """How many different gate policies the candidates carry; there must be one."""
    candidates = checked.where(F.col("role") == "research_candidate")
    return candidates.agg(
        F.countDistinct("required_improvement", "required_folds", "fold_count").alias("policies"),
        F.countDistinct("population_id").alias("populations"),
        F.countDistinct("experiment_id").alias("experiments"),
        F.count(F.lit(1)).alias("records"),
    )


def validate_ledger(records: DataFrame) -> DataFrame:
    """The checked ledger, or an error that names the first broken records."""
    checked = recheck(records)
    broken = checked.where(F.size("issues") > 0).select("experiment_id", "issues")
    first, more = preview(broken, ["experiment_id"])
    if first:
        raise S.ContractError(f"ledger records are inconsistent: {[tuple(b) for b in first]}{more}")
    row = policy_count(checked).first()
    if row.policies > 1:
        raise S.ContractError("candidates do not share one gate policy")
    if row.experiments != row.records:
        raise S.ContractError("experiment identifiers repeat")
    return checked


def rank_by_improvement(checked: DataFrame) -> DataFrame:
    """Rank of every candidate by improvement over its own baseline, ties by identifier.

    Improvements are comparable across populations.
    """
    candidates = checked.where(F.col("role") == "research_candidate").select(
        "experiment_id", "population_id", "improvement"
    )
    placed = dense_index(candidates, [F.col("improvement").desc(), F.col("experiment_id")], "at")
    return placed.select(
        (F.col("at") + 1).alias("rank"), "experiment_id", "population_id", "improvement"
    )


def rank_raw_within_population(checked: DataFrame) -> DataFrame:
    """Rank by raw log loss, only ever among candidates of one population.

    Positions in one range-sorted order, counted from each population's first.
    """
    candidates = checked.where(F.col("role") == "research_candidate").select(
        "population_id", "candidate_log_loss", "experiment_id"
    )
    placed = dense_index(
        candidates, ["population_id", "candidate_log_loss", "experiment_id"], "at"
    )
    first = placed.groupBy("population_id").agg(F.min("at").alias("_first"))
    return placed.join(first, "population_id").select(
        "population_id",
        (F.col("at") - F.col("_first") + 1).alias("rank"),
        "experiment_id",
        "candidate_log_loss",
    )


def rank_raw(checked: DataFrame) -> DataFrame:
    """Global raw ranking; refused when candidates come from different populations."""
    if policy_count(checked).first().populations != 1:
        raise S.ContractError("raw log loss cannot be ranked across populations")
    return rank_raw_within_population(checked)


def summary(checked: DataFrame) -> DataFrame:
    """Counts per role and verdict, and the best candidate."""
    return checked.groupBy("role", "verdict").agg(
        F.count(F.lit(1)).alias("experiments"),
        F.max("improvement").alias("best_improvement"),
        F.max_by("experiment_id", F.struct("improvement", "experiment_id")).alias("best"),
    )


def records_from_comparison(compared: DataFrame, by: str) -> DataFrame:
    """Nested records from fold comparisons, one per value of ``by``, under the fixed gate."""
    dev = F.col("fold_role") == "development"
    n = F.col("n_samples").cast("double")

    def values(part):
        rows = F.sum(F.when(part, n))
        base = F.sum(F.when(part, n * F.col("baseline_log_loss"))) / rows
        mine = F.sum(F.when(part, n * F.col("candidate_log_loss"))) / rows
        return F.struct(
            rows.cast("bigint").alias("n_samples"),
            base.alias("baseline_log_loss"),
            mine.alias("candidate_log_loss"),
            (base - mine).alias("improvement_log_loss"),
        )

    each = F.struct(
        "fold", "n_samples", "baseline_log_loss", "candidate_log_loss", "improvement_log_loss"
    )
    made = compared.groupBy(by).agg(
        values(dev).alias("development"),
        values(~dev).alias("historical_final"),
        F.sort_array(F.collect_list(F.when(dev, each))).alias("folds"),  # one entry per fold
        F.count_if(dev & (F.col("improvement_log_loss") > 0)).alias("_better"),
    )
    passed = (F.col("development.improvement_log_loss") >= MIN_IMPROVEMENT) & (
        F.col("_better") >= MIN_FOLDS
    )
    return made.select(
        F.lit("1.0").alias("schema_version"),
        F.concat(F.lit("experiment_"), F.col(by)).alias("experiment_id"),
        F.concat(F.lit("population_"), F.col(by)).alias("population_id"),
        F.lit("research_candidate").alias("role"),
        "development",
        "historical_final",
        "folds",
        F.struct(
            F.lit(MIN_IMPROVEMENT).alias("minimum_improvement_log_loss"),
            F.lit(MIN_FOLDS).cast("bigint").alias("minimum_improving_folds"),
            F.col("_better").alias("improving_fold_count"),
            passed.alias("passed"),
        ).alias("success_gate"),
        F.when(passed, "passed").otherwise("failed").alias("verdict"),
        F.when(passed, "CANDIDATE").otherwise("REJECTED_FOR_NOW").alias("disposition"),
    )
