"""Partitioned, verified output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlab import schema as S
from pairlab.functions.scalars import SAFE_PARTITION
from pairlab.operators.canonical import require_audit
from pairlab.operators.guards import validate_feature_table
from pairlab.session import durable

ROWS_PER_FILE = 5_000_000  # most rows of a stored file
BUCKETS = 4096  # of hashes that two tables are compared by


def _fingerprint(columns: Sequence[str]) -> list:
    """Row count and an order-free checksum of whole rows."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("checksum"),
    ]


def _write(df: DataFrame, destination: str, rows_per_file: int) -> Observation:
    """One layout whatever the size: ranges of division and date, cut into bounded files.

    A range ends where its rows make a fair share of a task, so a large division is spread over
    tasks by date, and small ones share a task, each in files of its own. What is written is counted
    and hashed on its way in the same job.
    """
    unsafe = df.where(~F.col("Division").rlike(SAFE_PARTITION)).agg(F.min("Division")).first()[0]
    if unsafe is not None:
        raise S.ContractError(f"unsafe division partition name: {unsafe!r}")
    written = Observation()
    (
        df.repartitionByRange("Division", "MatchDate")
        .sortWithinPartitions("Division", *S.KEY)
        .observe(written, *_fingerprint(df.columns))
        .write.partitionBy("Division")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(destination)
    )
    return written


def read_back(spark: SparkSession, destination: str, schema, divisions: DataFrame) -> DataFrame:
    """Stored rows of the given divisions, with the file that holds them as ``_file``."""
    stored = spark.read.schema(schema).parquet(destination)
    df = stored.select(*schema.fieldNames(), F.col("_metadata.file_path").alias("_file"))
    # the destination may hold other divisions from earlier writes; a row a division is broadcast
    return df.join(F.broadcast(divisions), "Division", "left_semi").select(*schema.fieldNames(), "_file")


def _differing_buckets(left: DataFrame, right: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """Rows of both sides, as ``_n`` 1 and -1, whose bucket of hashes differs between the sides.

    Only counts and sums of hashes are exchanged for all rows, a row a bucket; equal tables go no
    further.
    """
    sides = []
    for df, n in ((left, 1), (right, -1)):
        h = F.xxhash64(*columns)
        sides.append(df.select(*columns, F.lit(n).alias("_n"), h.alias("_h"), F.pmod(h, F.lit(buckets)).alias("_b")))
    both = sides[0].unionByName(sides[1])
    differing = (
        both.groupBy("_b")
        .agg(F.sum("_n").alias("rows"), F.sum(F.col("_h").cast("decimal(38,0)") * F.col("_n")).alias("sums"))
        .where("rows <> 0 OR sums <> 0")
        .select("_b")
    )
    # at most as many rows as there are buckets
    return both.join(F.broadcast(differing), "_b", "left_semi").select(*columns, "_n")


def key_set_difference(
    left: DataFrame, right: DataFrame, key: Sequence[str] = S.KEY, buckets: int = BUCKETS
) -> DataFrame:
    """Keys that only one table holds: the key, ``missing_left`` and ``missing_right``; NULLs are equal."""
    met = _differing_buckets(left.select(*key).distinct(), right.select(*key).distinct(), key, buckets)
    return (
        met.groupBy(*key)
        .agg(F.sum("_n").alias("_n"))
        .where("_n <> 0")
        .select(*key, (F.col("_n") < 0).alias("missing_left"), (F.col("_n") > 0).alias("missing_right"))
    )


def round_trip_differences(expected: DataFrame, actual: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one table that the other does not hold, from either side, with their multiplicity."""
    columns = expected.columns
    met = _differing_buckets(expected, actual, columns, buckets)
    return met.groupBy(*columns).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)


def verify(expected: DataFrame, actual: DataFrame) -> None:
    if [(f.name, f.dataType) for f in expected.schema] != [
        (f.name, f.dataType) for f in actual.schema
    ]:
        raise S.ContractError("read-back schema differs from what was written")
    if round_trip_differences(expected, actual).limit(1).collect():
        raise S.ContractError("read-back rows differ from what was written")


def write_summary(stored: DataFrame, destination: str, input_rows: int) -> DataFrame:
    """Path, files and stored rows of each division, and the rows of the whole input and output."""
    by_division = stored.groupBy("Division").agg(
        F.sum("files").alias("files"), F.sum("rows").alias("row_count")
    )
    total = stored.agg(F.sum("rows").alias("output_rows"))
    return by_division.crossJoin(F.broadcast(total)).select(  # a single row
        "Division",
        F.concat(F.lit(destination.rstrip("/") + "/Division="), "Division").alias("path"),
        "files",
        "row_count",
        F.lit(input_rows).cast("bigint").alias("input_rows"),
        "output_rows",
    )


def write_canonical_partitions(
    df: DataFrame, destination: str, rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """Audit, write by division, read back and compare; returns the per-division summary."""
    S.require_exact_columns(df, S.CANONICAL, "canonical table")
    df = durable(df.select(*S.CANONICAL))  # the plan behind it runs once
    require_audit(df, keep=())
    return _write_verified(df, destination, S.CANONICAL_SCHEMA, rows_per_file)


def write_feature_partitions(
    df: DataFrame, destination: str, rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """The same sink for the 63-column feature table."""
    df = durable(df)
    validate_feature_table(df)
    return _write_verified(df, destination, S.FEATURE_SCHEMA, rows_per_file)


def _write_verified(df: DataFrame, destination: str, schema, rows_per_file: int) -> DataFrame:
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    written = _write(df, destination, rows_per_file).get
    actual = read_back(df.sparkSession, destination, schema, df.select("Division").distinct())
    stored = durable(
        actual.groupBy("Division", "_file").agg(*_fingerprint(df.columns))
        .groupBy("Division")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("checksum").alias("checksum"))
    )
    found = stored.agg(F.sum("rows").alias("rows"), F.coalesce(F.sum("checksum"), F.lit(0)).alias("checksum")).first()
    if ((found["rows"] or 0), found.checksum) != (written["rows"], written["checksum"]):
        where = round_trip_differences(df, actual.drop("_file")).select("Division").distinct().limit(5).collect()
        raise S.ContractError(f"read-back rows differ from what was written: {sorted(str(r.Division) for r in where)}")
    return write_summary(stored, destination, written["rows"])


def order_check(spark: SparkSession, path: str, key: Sequence[str] = S.KEY) -> DataFrame:
    """Per stored file, the number of rows that come before their predecessor in the key order.

    A DataFrame has no row order, a file has. Files are bounded by the sink, so one window group
    is one file.
    """
    rows = spark.read.parquet(path).select(
        *key,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    previous = F.lag(F.struct(*key)).over(Window.partitionBy("file").orderBy("at"))
    return (
        rows.withColumn("_before", previous)
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("_before") > F.struct(*key)).alias("out_of_order"),
        )
    )


def write_report(report: DataFrame, destination: str) -> None:
    """Store report rows as JSON lines."""
    report.write.mode("overwrite").json(destination)


def report_json(report: DataFrame, name: str = "report") -> DataFrame:
    """One JSON text per report row."""
    return report.select(F.to_json(F.struct(*report.columns)).alias(name))
