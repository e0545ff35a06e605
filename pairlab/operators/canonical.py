"""From source-shaped rows to the canonical match table, and the checks on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlab import schema as S
from pairlab.functions.scalars import (
    any_of,
    count_if,
    is_blank,
    number,
    parse_date,
    parse_season,
    strip,
)

STRINGS = ("Division", "HomeTeam", "AwayTeam", "FTR")


def source_column(columns: Sequence[str], canonical: str) -> str | None:
    """The one source column that supplies a canonical field; two candidates are an error."""
    names = [canonical, *[a for a, c in S.SOURCE_ALIASES.items() if c == canonical]]
    present = [n for n in names if n in columns]
    if len(present) > 1:
        raise S.ContractError(f"ambiguous source columns for {canonical}: {', '.join(present)}")
    return present[0] if present else None


def first_source_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is present."""
    return next((c for c in candidates if c in columns), None)


def season_start(code: str) -> int:
    if code not in S.SEASON_CODES:
        raise S.ContractError(f"unsupported season code {code!r}")
    return S.SEASON_CODES[code]


def season_label(code: str) -> str:
    year = season_start(code)
    return f"{year}-{year + 1}"


def supported_division(division: str) -> str:
    if division not in S.DIVISION_NAMES:
        raise S.ContractError(f"unsupported division {division!r}")
    return division


def _context_season(raw: DataFrame, season, code, context):
    if sum(x is not None for x in (season, code, context)) > 1:
        raise S.ContractError("give one season context: a start year, a season code or a column")
    if code is not None:
        return F.lit(season_start(code)).cast("bigint")
    if season is not None:
        return parse_season(F.lit(season))
    return F.col(context).cast("bigint") if context is not None else None


def normalise(
    raw: DataFrame,
    season: int | str | None = None,
    season_code: str | None = None,
    context_column: str | None = None,
) -> DataFrame:
    """Typed canonical columns plus ``_issues``, one entry per rule, NULL where the row obeys it.

    ``context_column`` names a column that holds the season of the file a row came from.
    Nothing is raised here: malformed values become NULL and are listed.
    """
    found = {c: source_column(raw.columns, c) for c in S.CANONICAL}
    context = _context_season(raw, season, season_code, context_column)
    own = found["SeasonStartYear"] or first_source_column(raw.columns, ["Season"])
    missing = [c for c in S.CANONICAL if found[c] is None]
    if "SeasonStartYear" in missing and (own or context is not None):
        missing.remove("SeasonStartYear")
    if missing:
        raise S.ContractError(f"source rows miss required fields: {', '.join(missing)}")

    def source(c: str):
        return F.col(f"`{found[c]}`")

    is_date = dict(raw.dtypes)[found["MatchDate"]] in ("date", "timestamp", "timestamp_ntz")
    date = source("MatchDate").cast("date") if is_date else parse_date(source("MatchDate"))
    year = parse_season(F.col(f"`{own}`")) if own else context
    numeric = {c: dict(raw.dtypes)[found[c]] != "string" for c in S.COUNT_COLUMNS}
    numbers = {
        c: (source(c) if numeric[c] else number(source(c))).cast("double") for c in S.COUNT_COLUMNS
    }
    blank = {c: source(c).isNull() if numeric[c] else is_blank(source(c)) for c in S.COUNT_COLUMNS}
    # parsed once here, referred to by name below
    parsed = raw.select(
        date.alias("MatchDate"),
        year.alias("SeasonStartYear"),
        *[strip(source(c).cast("string")).alias(c) for c in STRINGS],
        *[v.alias(c) for c, v in numbers.items()],
        *[b.alias(f"_blank_{c}") for c, b in blank.items()],
        (context if context is not None else F.lit(None).cast("bigint")).alias("_context"),
    )
    whole = {c: F.coalesce(F.col(c) % 1 == 0, F.lit(False)) for c in S.COUNT_COLUMNS}
    issues = [
        F.when(F.col("MatchDate").isNull(), F.lit("MatchDate")),
        F.when(F.col("SeasonStartYear").isNull(), F.lit("SeasonStartYear")),
        F.when(
            F.col("SeasonStartYear") != F.col("_context"), F.lit("season conflicts with context")
        ),
        *[F.when(~F.col(f"_blank_{c}") & ~whole[c], F.lit(c)) for c in S.COUNT_COLUMNS],
    ]
    counts = {c: F.when(whole[c], F.col(c)).try_cast("bigint") for c in S.COUNT_COLUMNS}
    return parsed.select(
        *[(counts[c] if c in counts else F.col(c)).alias(c) for c in S.CANONICAL],
        F.array(*issues).alias("_issues"),
    )


def bad_row_preview(normal: DataFrame, limit: int = 5) -> DataFrame:
    """Per issue: how many rows show it and the text of the first few."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in S.KEY])
    # the outer form keeps the planner from pushing a copy of every parsing rule below the scan
    per_issue = normal.select(F.explode_outer("_issues").alias("issue"), text.alias("row")).where(
        F.col("issue").isNotNull()
    )
    counts = per_issue.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("issue").orderBy("row")
    few = per_issue.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit)
    both = counts.select("issue", "n", F.lit(None).cast("string").alias("row")).unionByName(
        few.select("issue", F.lit(None).cast("bigint").alias("n"), "row")
    )
    return both.groupBy("issue").agg(
        F.max("n").alias("bad_rows"),
        F.sort_array(F.collect_list("row")).alias("preview"),
        F.greatest(F.max("n") - limit, F.lit(0)).cast("bigint").alias("more"),
    )


def canonicalise(raw: DataFrame, **context) -> DataFrame:
    """Canonical rows, or an error that counts and previews every kind of malformed value."""
    normal = normalise(raw, **context)
    bad = bad_row_preview(normal).collect()  # one short row per kind of problem
    if bad:
        detail = "; ".join(
            f"{r.issue}: {', '.join(r.preview)}" + (f" (+{r.more} more)" if r.more else "")
            for r in sorted(bad, key=lambda r: r.issue)
        )
        raise S.ContractError(f"malformed source values: {detail}")
    clean = normal.drop("_issues")
    validate_canonical(clean)
    return clean


def duplicate_keys(df: DataFrame, key: Sequence[str] = S.KEY) -> DataFrame:
    """Keys held by more than one row, with their row count (combined map-side)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def duplicate_summary(df: DataFrame, key: Sequence[str] = S.KEY) -> DataFrame:
    return duplicate_keys(df, key).agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def null_cells(columns: Sequence[str]):
    return sum((count_if(F.col(c).isNull()) for c in columns), F.lit(0)).cast("bigint")


def _rules(df: DataFrame) -> dict:
    """Violation counts of the canonical rules that the columns of ``df`` allow to check."""
    types = dict(df.dtypes)
    counts = [c for c in S.COUNT_COLUMNS if c in types]
    broken = [c for c in counts if types[c] != "bigint"]
    date = F.col("MatchDate")
    if types.get("MatchDate", "date") != "date":
        date = parse_date(date)
    rules = {
        "null_dates": (["MatchDate"], lambda: count_if(date.isNull())),
        "null_seasons": (["SeasonStartYear"], lambda: count_if(F.col("SeasonStartYear").isNull())),
        "blank_strings": (
            STRINGS[:3],
            lambda: count_if(any_of(*[is_blank(F.col(c)) for c in STRINGS[:3]])),
        ),
        "same_team_rows": (
            ["HomeTeam", "AwayTeam"],
            lambda: count_if(F.col("HomeTeam") == F.col("AwayTeam")),
        ),
        "invalid_results": (
            ["FTR"],
            lambda: count_if(~F.coalesce(F.col("FTR").isin(*S.CLASSES), F.lit(False))),
        ),
        "negative_counts": (
            [],
            lambda: sum((count_if(F.col(c) < 0) for c in counts), F.lit(0)).cast("bigint"),
        ),
        "fractional_counts": (
            [],
            lambda: sum((count_if(F.col(c) % 1 != 0) for c in broken), F.lit(0)).cast("bigint"),
        ),
        "null_key_cells": ([], lambda: null_cells([c for c in S.KEY if c in types])),
    }
    return {
        code: count() if types.keys() >= set(needs) else F.lit(0).cast("bigint")
        for code, (needs, count) in rules.items()
    }


def canonical_issues(df: DataFrame) -> DataFrame:
    """One row with the number of violations of every canonical rule."""
    return _issues(df, {})


def _issues(df: DataFrame, more: dict) -> DataFrame:
    counted = {"row_count": F.count(F.lit(1)), **_rules(df), **more}
    rules = df.agg(*[c.alias(code) for code, c in counted.items()])
    if not set(S.KEY) <= set(df.columns):
        zero = F.lit(0).cast("bigint")
        return rules.withColumns({"duplicate_keys": zero, "duplicate_rows": zero})
    return rules.crossJoin(F.broadcast(duplicate_summary(df)))  # two one-row aggregates


def validate_canonical(df: DataFrame) -> None:
    """Raise unless every canonical rule holds."""
    S.require_exact_columns(df, S.CANONICAL, "canonical table")
    types = dict(df.dtypes)
    if types["MatchDate"] != "date":
        raise S.ContractError("MatchDate must be a date")
    if types["SeasonStartYear"] not in ("bigint", "int", "smallint"):
        raise S.ContractError("SeasonStartYear must be an integer")
    text = [c for c in S.COUNT_COLUMNS if types[c] == "string"]
    if text:
        raise S.ContractError(f"counts must be numeric: {', '.join(text)}")
    row = canonical_issues(df).first().asDict()
    if row.pop("row_count") == 0:
        raise S.ContractError("canonical table must hold at least one match")
    wrong = {k: v for k, v in row.items() if v}
    if wrong:
        raise S.ContractError(f"canonical table violates its contract: {wrong}")


def assert_natural_key(df: DataFrame, key: Sequence[str] = S.KEY) -> None:
    """Raise when a key column holds a NULL or a key repeats."""
    S.require_columns(df, key)
    nulls = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in key]).first().asDict()
    named = [c for c, n in nulls.items() if n]
    if named:
        raise S.ContractError(f"natural key contains nulls in: {', '.join(named)}")
    copies = duplicate_summary(df, key).first()
    if copies.duplicate_rows:
        raise S.ContractError(f"natural key is not unique; {copies.duplicate_rows} rows repeat")


def sort_canonical(df: DataFrame) -> DataFrame:
    """Validated rows in the stable order; the key is unique, so the order is total."""
    validate_canonical(df)
    return df.orderBy(*S.KEY)


def sort_matches(df: DataFrame) -> DataFrame:
    """Stable chronological order; a NULL in the key stops the job."""
    S.require_columns(df, S.KEY, "match table")
    null = any_of(*[F.col(c).isNull() for c in S.KEY])
    guard = F.when(null, F.raise_error(F.lit("stable ordering key contains nulls")).cast("date"))
    date = guard.otherwise(F.col("MatchDate"))
    return df.withColumn("MatchDate", date).orderBy(*S.KEY)


FAULTS = (
    "null_dates",
    "null_seasons",
    "blank_strings",
    "same_team_rows",
    "invalid_results",
    "negative_counts",
    "fractional_counts",
    "null_key_cells",
    "duplicate_keys",
)


def audit_canonical(df: DataFrame, input_rows: int | None = None) -> DataFrame:
    """The structured audit: one row with the count of every canonical rule, and ``issues``.

    An issue is ``code:count``; ``missing_columns`` and ``lost_rows`` join the rules' codes.
    ``can_be_ordered`` says whether every key is present; the order of stored files is checked by
    ``sources.sinks.order_check``.
    """
    types = dict(df.dtypes)
    missing = [c for c in S.CANONICAL if c not in types]

    def distinct(column: str):
        return F.countDistinct(column) if column in types else F.lit(0).cast("bigint")

    counted = _issues(
        df, {"divisions": distinct("Division"), "seasons": distinct("SeasonStartYear")}
    )
    given = F.col("row_count") if input_rows is None else F.lit(input_rows).cast("bigint")
    counted = counted.withColumns(
        {
            "input_rows": given,
            "lost_rows": given - F.col("row_count"),
            "missing_columns": F.array(*[F.lit(c) for c in missing]).cast("array<string>"),
            "can_be_ordered": (F.col("null_key_cells") == 0) & F.lit(not set(missing) & set(S.KEY)),
        }
    )
    faults = {**{c: F.col(c) for c in FAULTS}, "missing_columns": F.size("missing_columns"), "lost_rows": F.col("lost_rows")}
    issues = [F.when(n != 0, F.concat_ws(":", F.lit(code), n)) for code, n in faults.items()]
    return counted.withColumn("issues", F.array_compact(F.array(*issues))).withColumn(
        "passed", F.size("issues") == 0
    )


def require_audit(df: DataFrame, input_rows: int | None = None, keep: Sequence[str] | None = None):
    """The audit row, or an error with the complete issue list.

    With ``keep`` the row holds only these columns, ``issues`` and ``passed``, and no more is counted.
    """
    audit = audit_canonical(df, input_rows)
    if keep is not None:
        audit = audit.select(*keep, "issues", "passed")
    row = audit.first()
    if not row.passed:
        raise S.ContractError(f"the audit found {', '.join(row.issues)}")
    return row
