"""Expanding chronological folds, inner date splits and date batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlab import schema as S

YEARS = (*S.DEVELOPMENT_YEARS, S.FINAL_YEAR)
FOLD_SCHEMA = "fold string, test_year bigint, fold_role string"


def fold_name(test_year: int) -> str:
    return f"train_through_{test_year - 1}_test_{test_year}"


def fold_table(
    spark: SparkSession, years: Sequence[int] = YEARS, final: int = S.FINAL_YEAR
) -> DataFrame:
    """The fold dimension: one row per test year."""
    rows = [(fold_name(y), y, "historical_final" if y == final else "development") for y in years]
    return spark.createDataFrame(rows, FOLD_SCHEMA)


def expanding_folds(
    df: DataFrame, years: Sequence[int] = YEARS, final: int = S.FINAL_YEAR
) -> DataFrame:
    """Every row once per fold it belongs to, tagged with the fold and its train or test part.

    The fold dimension is a fixed handful of rows, so this is a map-side expansion.
    """
    folds = fold_table(df.sparkSession, years, final)
    season = F.col("SeasonStartYear")
    tagged = df.join(F.broadcast(folds), season <= F.col("test_year"))
    part = F.when(season == F.col("test_year"), "test").otherwise("train")
    return tagged.withColumn("part", part)


def fold_bounds(folds: DataFrame) -> DataFrame:
    """Date range and row count of the train and test part of every fold."""
    train, test = F.col("part") == "train", F.col("part") == "test"

    def bound(fn, part):
        return fn(F.when(part, F.col("MatchDate")))

    return folds.groupBy("fold", "test_year", "fold_role").agg(
        bound(F.min, train).alias("train_start_date"),
        bound(F.max, train).alias("train_end_date"),
        bound(F.min, test).alias("test_start_date"),
        bound(F.max, test).alias("test_end_date"),
        F.count_if(train).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
    )


def check_folds(folds: DataFrame, years: Sequence[int]) -> list:
    """Bounds of every fold as rows; an empty part or a broken chronology is an error."""
    rows = {r.test_year: r for r in fold_bounds(folds).collect()}  # one row per fold
    for year in years:
        r = rows.get(year)
        if r is None or not r.train_rows or not r.test_rows:
            raise S.ContractError(f"fold {year} has an empty train or test part")
        if r.train_end_date >= r.test_start_date:
            raise S.ContractError(
                f"fold {year} breaks chronology: {r.train_end_date} is not before {r.test_start_date}"
            )
    return [rows[y] for y in years]


def date_batches(df: DataFrame) -> DataFrame:
    """Rows with the ordinal of their date; a batch is never divided.

    The ordinal is ranked over the distinct dates, which the calendar bounds, not over rows.
    """
    dates = df.select("MatchDate").distinct()
    ranked = dates.select(
        "MatchDate", F.row_number().over(Window.orderBy("MatchDate")).cast("bigint").alias("batch")
    )
    return df.join(F.broadcast(ranked), "MatchDate")


def inner_time_split(
    train: DataFrame, fraction: float = 0.1, by: Sequence[str] = ("fold",)
) -> DataFrame:
    """Tag training rows as fit or validation at a date boundary, separately per group.

    The last ``max(1, floor(fraction * dates))`` distinct dates validate, and at least one date
    is left to fit on.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("the validation fraction must lie between zero and one")
    group = Window.partitionBy(*by)
    dates = train.select(*by, "MatchDate").distinct()
    ranked = dates.select(
        *by,
        "MatchDate",
        F.row_number().over(group.orderBy(F.col("MatchDate").desc())).alias("_back"),
        F.count(F.lit(1)).over(group).alias("_dates"),
    )
    wanted = F.greatest(F.lit(1), F.floor(F.col("_dates") * F.lit(float(fraction))))
    kept = F.least(wanted, F.col("_dates") - 1)
    boundary = ranked.groupBy(*by).agg(
        F.min(F.when(F.col("_back") <= kept, F.col("MatchDate"))).alias("validation_start"),
        F.max("_dates").alias("_dates"),
    )
    start = F.when(F.col("_dates") >= 2, F.col("validation_start")).otherwise(
        F.raise_error(F.lit("an inner split needs two distinct dates")).cast("date")
    )
    boundary = boundary.select(*by, start.alias("validation_start"))
    # one row per group, and groups are folds
    return train.join(F.broadcast(boundary), list(by)).withColumn(
        "inner_part",
        F.when(F.col("MatchDate") < F.col("validation_start"), "fit").otherwise("validation"),
    )
