"""Dense, order-preserving identifiers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlab.session import durable


def dense_index(distinct: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number distinct rows 0, 1, 2, ... in the given order.

    Rows are range-sorted across tasks and written to the shared folder. A row's number is its
    position in its file plus the rows of the files before it; only the list of files, as short
    as the number of tasks, is ever ordered in one place.
    """
    stored = durable(distinct.orderBy(*order))
    placed = stored.select(
        *distinct.columns,
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_at"),
    )
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # by number: as text, part-100000 comes before part-99999
    number = F.regexp_extract("_file", r"part-(\d+)", 1).cast("bigint")
    before = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(F.broadcast(offsets), "_file").select(
        *distinct.columns, (F.col("_offset") + F.col("_at")).cast("bigint").alias(name)
    )
