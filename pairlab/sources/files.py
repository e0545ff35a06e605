"""Reading landed files: source CSV, stored partitions and experiment records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab import schema as S
from pairlab.functions.scalars import preview
from pairlab.operators.canonical import canonicalise, season_start, supported_division

MATCHES_VIEW = "matches"
PATH_FORM = r"([0-9]{4})/([A-Za-z0-9]+)\.csv$"


def source_csv_path(root: str, season_code: str, division: str) -> str:
    season_start(season_code)
    return f"{str(root).rstrip('/')}/{season_code}/{supported_division(division)}.csv"


def path_context() -> list:
    """Season code and division encoded in where a file lies, and the file itself."""
    path = F.col("_metadata.file_path")
    return [
        F.regexp_extract(path, PATH_FORM, 1).alias("_season_code"),
        F.regexp_extract(path, PATH_FORM, 2).alias("_division"),
        path.alias("_file"),
    ]


def land_source_csv(rows: DataFrame, root: str, season: str, division: str) -> None:
    """Lay rows out as ``root/{season}/{division}.csv``, a file for each pair of supported codes.

    The columns named by ``season`` and ``division`` hold the codes and are not in the files. Files are written by the
    tasks and moved to their names by the driver; the codes, and so the files, are a fixed list.
    """
    spark = rows.sparkSession
    pending = f"{root.rstrip('/')}/_pending"
    (
        rows.repartition(season, division)
        .write.partitionBy(season, division)
        .option("header", True)
        .csv(pending)
    )
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    system = path(pending).getFileSystem(conf)
    for status in system.globStatus(path(f"{pending}/*/*/*.csv")):
        own = status.getPath()
        folders = (own.getParent().getParent().getName(), own.getParent().getName())
        target = path(source_csv_path(root, *(f.split("=", 1)[1] for f in folders)))
        system.mkdirs(target.getParent())
        if not system.rename(own, target):
            raise S.ContractError(f"{target.toString()} holds a file already")
    system.delete(path(pending), True)


def _csv(spark: SparkSession, paths, encoding: str) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", encoding)
    return reader.option("enforceSchema", False).csv(paths)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """Per file its encoding and header line, from its lines.

    Files that are not valid UTF-8 are Latin-1. A file is read in splits, each line is tested on
    its own, and a task sends one row for each file it met. Rows of a split keep their order, so
    the header is the first row of the split at offset 0.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.is_valid_utf8("value").alias("utf8"),
            F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"),
            F.decode(F.rtrim(F.col("value"), F.lit("\r")).cast("binary"), "ISO-8859-1").alias("line"),
        )
    )
    return lines.groupBy("path").agg(
        F.bool_and("utf8").alias("utf8"), F.min_by("line", "at").alias("header")
    )


def scan_source_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text rows of one file or a directory tree, with ``_season_code`` and ``_division``.

    Files are grouped by (encoding, header), so columns are matched by name across files; the
    number of groups is the number of distinct layouts, not of files.
    """
    listed = _headers(spark, path).groupBy("utf8", "header").agg(
        F.collect_list("path").alias("paths")
    )
    out = None
    for group in listed.orderBy("utf8", "header").collect():  # file names only
        encoding = "UTF-8" if group.utf8 else "ISO-8859-1"
        rows = _csv(spark, sorted(group.paths), encoding)
        rows = rows.select(*[F.col(f"`{c}`").cast("string") for c in rows.columns], *path_context())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no source CSV under {path}")
    return out


def with_path_season(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Attach the season of the file path, refusing unsupported seasons and divisions."""
    seasons = spark.createDataFrame(
        list(S.SEASON_CODES.items()), "_season_code string, _season_start bigint"
    )
    divisions = spark.createDataFrame([(d,) for d in S.DIVISION_NAMES], "_division string")
    # both dimensions are fixed lists of a few rows
    unsupported = (
        rows.select("_season_code", "_division", "_file")
        .distinct()
        .join(F.broadcast(seasons), "_season_code", "left")
        .join(F.broadcast(divisions.withColumn("_known", F.lit(1))), "_division", "left")
        .where(F.col("_season_start").isNull() | F.col("_known").isNull())
        .select("_file")
    )
    first, more = preview(unsupported, ["_file"])
    if first:
        names = ", ".join(r["_file"] for r in first)
        raise S.ContractError(f"unsupported season or division: {names}{more}")
    return rows.join(F.broadcast(seasons), "_season_code", "left")


def load_source_csv(
    spark: SparkSession,
    path: str,
    season: int | str | None = None,
    season_code: str | None = None,
    path_season: bool = False,
) -> DataFrame:
    """Canonical rows of landed CSV files.

    With ``path_season`` every file's season comes from ``root/{season}/{division}.csv``.
    """
    rows = scan_source_csv(spark, path)
    if path_season:
        rows = with_path_season(spark, rows)
        return canonicalise(rows, context_column="_season_start")
    return canonicalise(rows, season=season, season_code=season_code)


def read_partitions(spark: SparkSession, directory: str) -> DataFrame:
    """All Parquet files below a directory as one table, united by column name."""
    return spark.read.option("mergeSchema", True).parquet(directory)


def read_canonical(spark: SparkSession, directory: str) -> DataFrame:
    """The canonical columns of stored match partitions; a filter on Division prunes folders."""
    df = read_partitions(spark, directory)
    S.require_columns(df, S.CANONICAL, "stored match table")
    # partition values are inferred from folder names, so "1" would come back as a number
    return df.withColumn("Division", F.col("Division").cast("string")).select(*S.CANONICAL)


def matches_view(spark: SparkSession, directory: str, name: str = MATCHES_VIEW) -> DataFrame:
    df = read_partitions(spark, directory)
    df.createOrReplaceTempView(name)
    return df


def query_canonical(
    spark: SparkSession,
    directory: str,
    sql: str,
    parameters: Sequence | Mapping | None = None,
) -> DataFrame:
    """Run parameterised SQL over the ``matches`` view of a directory."""
    matches_view(spark, directory)
    return spark.sql(sql, args=parameters or None)


_VALUES = T.StructType(
    [
        T.StructField("n_samples", T.LongType()),
        T.StructField("baseline_log_loss", T.DoubleType()),
        T.StructField("candidate_log_loss", T.DoubleType()),
        T.StructField("improvement_log_loss", T.DoubleType()),
    ]
)
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("population_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("development", _VALUES),
        T.StructField("historical_final", _VALUES),
        T.StructField(
            "folds",
            T.ArrayType(
                T.StructType([T.StructField("fold", T.StringType()), *_VALUES.fields])
            ),
        ),
        T.StructField(
            "success_gate",
            T.StructType(
                [
                    T.StructField("minimum_improvement_log_loss", T.DoubleType()),
                    T.StructField("minimum_improving_folds", T.LongType()),
                    T.StructField("improving_fold_count", T.LongType()),
                    T.StructField("passed", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("verdict", T.StringType()),
        T.StructField("disposition", T.StringType()),
    ]
)


def read_experiment_records(
    spark: SparkSession, directory: str, lines: bool = False
) -> DataFrame:
    """Nested experiment records, one JSON document per file or, with ``lines``, per line.

    A malformed document stops the job.
    """
    return (
        spark.read.schema(RECORD_SCHEMA)
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .json(directory)
    )
