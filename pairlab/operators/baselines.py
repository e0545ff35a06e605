"""Uniform and train-prior probabilities, for all folds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import require

PREDICTION = ("fold", "test_year", "fold_role", "model", *S.KEY, "label", *S.PROBABILITIES)


def training_prior(folds: DataFrame, label: str = "target_1x2") -> DataFrame:
    """Class frequencies of every fold's training rows; all three classes must occur."""
    train = folds.where(F.col("part") == "train")
    shares = [F.avg((F.col(label) == c).cast("double")) for c in S.CLASSES]
    present = F.least(*shares) > 0
    known = F.count_if(F.col(label).isin(*S.CLASSES)) == F.count(F.lit(1))
    prior = train.groupBy("fold").agg(
        (present & known).alias("_complete"),
        *[s.alias(n) for s, n in zip(shares, S.PROBABILITIES, strict=True)],
    )
    complete = F.coalesce("_complete", F.lit(False))
    return require(prior, complete, "the prior needs H, D and A in training").drop("_complete")


def test_rows(folds: DataFrame, label: str = "target_1x2") -> DataFrame:
    return folds.where(F.col("part") == "test").select(
        "fold", "test_year", "fold_role", *S.KEY, F.col(label).alias("label")
    )


def uniform_predictions(folds: DataFrame, label: str = "target_1x2") -> DataFrame:
    third = [F.lit(1.0 / 3.0).alias(p) for p in S.PROBABILITIES]
    rows = test_rows(folds, label).select("*", F.lit("uniform").alias("model"), *third)
    return rows.select(*PREDICTION)


def prior_predictions(folds: DataFrame, label: str = "target_1x2") -> DataFrame:
    """The fold's prior repeated on its test rows (the prior table has one row per fold)."""
    rows = test_rows(folds, label).join(F.broadcast(training_prior(folds, label)), "fold")
    return rows.withColumn("model", F.lit("training_prior")).select(*PREDICTION)
