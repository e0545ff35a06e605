"""An experiment's report as one typed document: folds, views, gates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab import schema as S
from pairlab.operators import metrics

DOCUMENT = """experiment string, baseline string,
    folds array<struct<fold: string, fold_role: string, models: array<struct<
        model: string, n_samples: bigint, log_loss: double, brier_score: double, ece: double>>>>,
    views array<struct<model: string, view: string, fold_count: bigint, n_samples: bigint,
        log_loss: double, brier_score: double, ece: double>>,
    gates array<struct<candidate: string, development_fold_count: bigint, candidate_improvement_log_loss: double,
        improving_fold_count: bigint, historical_final_improvement_log_loss: double, passed: boolean, verdict: string>>,
    coverage struct<candidate_match_rows: bigint, aligned_rows: bigint, unmatched_match_keys: bigint,
        unmatched_market_keys: bigint, coverage_percentage: double>"""


def document() -> T.StructType:
    return T.StructType.fromDDL(DOCUMENT)


def _fields(name: str) -> list[str]:
    kind = document()[name].dataType
    return [f.name for f in (kind.elementType if isinstance(kind, T.ArrayType) else kind).fields]


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """All rows in one array, in order: a report has as many as folds, views and models."""
    return rows.agg(F.sort_array(F.collect_list(F.struct(*_fields(name)))).alias(name))


def assemble(fold_metrics: DataFrame, experiment: str, baseline: str, coverage: DataFrame) -> DataFrame:
    """The report of one experiment, one row: metrics of every fold and model, weighted views, the gate
    of every candidate against ``baseline`` and the one-row coverage of its matches."""
    model = [f.name for f in document()["folds"].dataType.elementType["models"].dataType.elementType.fields]
    folds = fold_metrics.groupBy("fold", "fold_role").agg(
        F.sort_array(F.collect_list(F.struct(*model))).alias("models")
    )
    parts = [
        _listed(folds, "folds"),
        _listed(metrics.weighted_views(fold_metrics), "views"),
        _listed(metrics.gate(metrics.compare_models(fold_metrics, baseline)), "gates"),
        coverage.select(F.struct(*_fields("coverage")).alias("coverage")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # single rows
    made = out.select(F.lit(experiment).alias("experiment"), F.lit(baseline).alias("baseline"), *document().names[2:])
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in document()])


def _foreign(found: T.DataType, wanted: T.DataType, path: str) -> list[str]:
    """Fields of a document that the schema does not know."""
    if isinstance(found, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return _foreign(found.elementType, wanted.elementType, path)
    if isinstance(found, T.StructType):
        known = {f.name: f.dataType for f in wanted.fields} if isinstance(wanted, T.StructType) else {}
        out = []
        for f in found.fields:
            here = f"{path}.{f.name}" if path else f.name
            out += _foreign(f.dataType, known[f.name], here) if f.name in known else [here]
        return out
    return []


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents with the schema's types; unknown fields, missing parts and wrong values are refused."""
    found = spark.read.json(path).schema
    foreign = _foreign(found, document(), "")
    missing = [n for n in document().names if n not in found.names]
    if foreign or missing:
        raise S.ContractError(f"report document: unknown fields {foreign}, missing parts {missing}")
    return spark.read.schema(document()).option("mode", "FAILFAST").json(path)


def fold_rows(reports: DataFrame) -> DataFrame:
    """A row for each fold and model of each document, with the model's verdict and the coverage."""
    verdict = F.element_at(
        F.transform(F.filter("gates", lambda g: g["candidate"] == F.col("m.model")), lambda g: g["verdict"]), 1
    )
    found = F.size(F.filter("gates", lambda g: g["candidate"] == F.col("m.model"))) > 0
    return (
        reports.select("experiment", "gates", "coverage", F.explode("folds").alias("f"))
        .select("experiment", "gates", "coverage", "f.fold", "f.fold_role", F.explode("f.models").alias("m"))
        .select(
            "experiment", "fold", "fold_role", "m.*",
            F.when(found, verdict).alias("verdict"),
            "coverage.aligned_rows", "coverage.coverage_percentage",
        )
    )
