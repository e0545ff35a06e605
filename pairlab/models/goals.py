"""Poisson goals model and the pseudo expected goals derived from it."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.operators import history as H
from pairlab.operators import xg
from pairlab.session import durable

# Poisson configuration.
ALPHA = 1e-6
MAX_ITERATIONS = 300


def side_rows(matches: DataFrame) -> DataFrame:
    """Goals, shots on target and other shots per team and match; unusable rows are dropped."""
    rows = H.sides(
        matches,
        ["MatchDate", "SeasonStartYear"],
        {
            "goals": (F.col("FTHome"), F.col("FTAway")),
            "sot": (F.col("HomeTarget"), F.col("AwayTarget")),
            "off": (
                F.col("HomeShots") - F.col("HomeTarget"),
                F.col("AwayShots") - F.col("AwayTarget"),
            ),
        },
    )
    return rows.where(
        F.col("goals").isNotNull() & (F.col("sot") >= 0) & (F.col("off") >= 0)
    )


def fit_goals(rows: DataFrame) -> tuple[float, float, float]:
    """Intercept and the two slopes of the log-linear goals model.

    Equal (goals, sot, off) rows are folded into one weighted row first, so the fit works on the
    distinct count triples whatever the number of matches.
    """
    folded = rows.groupBy("goals", "sot", "off").agg(F.sum("n").alias("n"))
    data = VectorAssembler(inputCols=["sot", "off"], outputCol="features").transform(
        folded.select(
            F.col("goals").cast("double").alias("goals"),
            F.col("sot").cast("double").alias("sot"),
            F.col("off").cast("double").alias("off"),
            F.col("n").cast("double").alias("n"),
        )
    )
    model = GeneralizedLinearRegression(
        family="poisson",
        link="log",
        labelCol="goals",
        weightCol="n",
        regParam=ALPHA,
        maxIter=MAX_ITERATIONS,
        tol=1e-10,
    ).fit(data)
    if model.summary.numIterations >= MAX_ITERATIONS:
        raise RuntimeError("the goals model did not converge")
    return float(model.intercept), float(model.coefficients[0]), float(model.coefficients[1])


def expected_goals(sot: Column, shots: Column, b0: Column, b1: Column, b2: Column) -> Column:
    """exp(b0 + b1*sot + b2*off); NULL unless both counts are present and sensible."""
    off = shots - sot
    return F.when((sot >= 0) & (off >= 0), F.exp(b0 + b1 * sot + b2 * off))


def walk_forward_coefficients(matches: DataFrame) -> DataFrame:
    """One goals model per season, fitted on the matches before the season's first date.

    The count table per (season, triple) is written once; fits then read a fraction of the data.
    A season with nothing before it has no coefficients.
    """
    spark = matches.sparkSession
    seasons = [
        (r[0], r[1])
        for r in matches.groupBy("SeasonStartYear")
        .agg(F.min("MatchDate").alias("first"))
        .orderBy("SeasonStartYear")
        .collect()
    ]
    counts = durable(
        side_rows(matches)
        .groupBy("MatchDate", "goals", "sot", "off")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    fits = []
    for season, first in seasons:
        before = counts.where(F.col("MatchDate") < F.lit(first))
        if before.limit(1).collect():
            fits.append((season, *fit_goals(before)))
    return spark.createDataFrame(fits, "SeasonStartYear bigint, b0 double, b1 double, b2 double")


def with_pseudo_xg(matches: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Matches with home and away pseudo expected goals under their own season's model."""
    b = (F.col("b0"), F.col("b1"), F.col("b2"))
    # one row per season
    return matches.join(F.broadcast(coefficients), "SeasonStartYear", "left").select(
        *matches.columns,
        expected_goals(F.col("HomeTarget"), F.col("HomeShots"), *b).alias("home_pxg"),
        expected_goals(F.col("AwayTarget"), F.col("AwayShots"), *b).alias("away_pxg"),
    )


def pseudo_xg_features(
    matches: DataFrame,
    coefficients: DataFrame | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """The 12 walk-forward pseudo-xG features of every match, in one window pass.

    Histories are season-local and a season has one model, so every season's features come out
    of the same pass. ``targets`` may name other matches than those of the history.
    """
    if coefficients is None:
        coefficients = walk_forward_coefficients(matches)
    valued = with_pseudo_xg(matches, coefficients)
    asked = None if targets is None else H.team_days(targets)
    state = xg.history_state(valued, "home_pxg", "away_pxg", "Pxg", diff=False, asked=asked)
    wanted = matches if targets is None else targets
    return xg.on_matches(wanted, state, S.PSEUDO_XG_FEATURES, "pxg")
