"""Training targets derived from the result and the goals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import require


def label_columns() -> list:
    result = F.col("FTR")
    hot = {"target_home_win": "H", "target_draw": "D", "target_away_win": "A"}
    goals = F.col("FTHome") + F.col("FTAway")
    over = F.when(goals.isNotNull(), (goals > 2.5).cast("tinyint"))
    return [
        result.alias("target_1x2"),
        *[(result == v).cast("tinyint").alias(c) for c, v in hot.items()],
        over.alias("target_ou25"),
    ]


def known_results(matches: DataFrame) -> DataFrame:
    """The matches; a result outside H/D/A stops the job."""
    known = F.coalesce(F.col("FTR").isin(*S.CLASSES), F.lit(False))
    return require(matches, known, "FTR outside H/D/A")


def add_target_labels(matches: DataFrame) -> DataFrame:
    """Attach the five targets; a result outside H/D/A stops the job."""
    S.require_columns(matches, ["FTR", "FTHome", "FTAway"], "label source")
    return known_results(matches).select("*", *label_columns())


add_labels = add_target_labels
