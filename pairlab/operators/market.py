"""Closing odds: normalisation, validity, de-vigged probabilities and exact-key alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import (
    any_of,
    count_if,
    every,
    finite,
    is_blank,
    number,
    parse_date,
    percentage,
    strip,
)
from pairlab.operators.canonical import assert_natural_key, duplicate_summary, first_source_column

# Types whose text parses to the double that a cast gives.
EXACT = ("double", "bigint", "int", "smallint", "tinyint")


def market_rows(raw: DataFrame) -> DataFrame:
    """Canonical market columns plus two disjoint flags: incomplete and invalid odds."""
    found = {c: first_source_column(raw.columns, names) for c, names in S.MARKET_CANDIDATES.items()}
    missing = [c for c, s in found.items() if s is None]
    if missing:
        raise S.ContractError(f"missing market fields: {', '.join(missing)}")

    def source(c):
        return F.col(f"`{found[c]}`")

    typed = dict(raw.dtypes)[found["MatchDate"]] in ("date", "timestamp", "timestamp_ntz")
    date = source("MatchDate").cast("date") if typed else parse_date(source("MatchDate"))
    # what is a number already is not written and parsed, which would cost more than all the rest
    plain = {c: dict(raw.dtypes)[found[c]] in EXACT for c in S.ODDS}
    numbers = {c: source(c).cast("double") if plain[c] else number(source(c)) for c in S.ODDS}
    incomplete = any_of(*[source(c).isNull() if plain[c] else is_blank(source(c)) for c in S.ODDS])
    good = every(*[finite(v) & (v > 1.0) for v in numbers.values()])
    return raw.select(
        date.alias("MatchDate"),
        *[strip(source(c).cast("string")).alias(c) for c in ("Division", "HomeTeam", "AwayTeam")],
        *[v.alias(c) for c, v in numbers.items()],
        incomplete.alias("_incomplete"),
        (~incomplete & ~F.coalesce(good, F.lit(False))).alias("_invalid"),
    )


def market_audit(rows: DataFrame) -> DataFrame:
    """One row of validation counts over ``market_rows``."""
    bad_key = any_of(
        F.col("MatchDate").isNull(),
        *[is_blank(F.col(c)) for c in ("Division", "HomeTeam", "AwayTeam")],
    )
    counts = rows.agg(
        F.count(F.lit(1)).alias("supplied_market_rows"),
        count_if(~F.col("_incomplete") & ~F.col("_invalid")).alias("valid_market_rows"),
        count_if(F.col("_incomplete")).alias("incomplete_odds_rows"),
        count_if(F.col("_invalid")).alias("invalid_odds_rows"),
        count_if(bad_key).alias("invalid_key_rows"),
    )
    repeated = duplicate_summary(rows).select(
        F.col("duplicate_keys").alias("duplicate_market_keys")
    )
    return counts.crossJoin(F.broadcast(repeated))  # two one-row aggregates


def _check_keys(audit) -> None:
    if audit.invalid_key_rows:
        raise S.ContractError(f"{audit.invalid_key_rows} market rows have unusable keys")
    if audit.duplicate_market_keys:
        raise S.ContractError(f"{audit.duplicate_market_keys} market keys repeat")


def valid_market(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("_incomplete") & ~F.col("_invalid")).select(*S.MARKET_COLUMNS)


def normalize_closing_market(raw: DataFrame) -> DataFrame:
    """Canonical market rows; any unusable row is an error."""
    rows = market_rows(raw)
    audit = market_audit(rows).first()
    _check_keys(audit)
    if not audit.supplied_market_rows:
        raise S.ContractError("market table must hold at least one row")
    if audit.incomplete_odds_rows or audit.invalid_odds_rows:
        raise S.ContractError(
            f"{audit.incomplete_odds_rows} incomplete and {audit.invalid_odds_rows} invalid odds rows"
        )
    return valid_market(rows)


def prepare_closing_market(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the audit that counts what was left out; repeated keys still fail."""
    rows = market_rows(raw)
    audit = market_audit(rows)
    _check_keys(audit.first())
    return valid_market(rows), audit


def closing_market_probabilities(market: DataFrame) -> DataFrame:
    """Reciprocal odds divided by their row sum; the sum is kept as the overround."""
    implied = [F.lit(1.0) / F.col(c) for c in S.ODDS]
    overround = implied[0] + implied[1] + implied[2]
    return market.select(*S.KEY, *[i.alias(f"_{n}") for n, i in enumerate(implied)],
                         overround.alias("market_overround")).select(
        *S.KEY,
        *[
            (F.col(f"_{n}") / F.col("market_overround")).alias(p)
            for n, p in enumerate(S.PROBABILITIES)
        ],
        "market_overround",
    )


def align_closing_market(matches: DataFrame, raw: DataFrame) -> DataFrame:
    """Market probabilities of the matches that have them, joined one to one on the exact key.

    Repeated keys on either side are an error.
    """
    season = ["SeasonStartYear"] if "SeasonStartYear" in matches.columns else []
    assert_natural_key(matches)
    probabilities = closing_market_probabilities(prepare_closing_market(raw)[0])
    return matches.select(*S.KEY, *season).join(probabilities, list(S.KEY))


def market_coverage(matches: DataFrame, raw: DataFrame) -> DataFrame:
    """One row of alignment counts: a full outer join on the key, aggregated once."""
    rows = market_rows(raw)
    left = matches.select(*S.KEY, F.lit(1).alias("_m"))
    right = valid_market(rows).select(*S.KEY, F.lit(1).alias("_o"))
    both = left.join(right, list(S.KEY), "full_outer").agg(
        F.count("_m").alias("candidate_match_rows"),
        count_if(F.col("_o").isNull()).alias("unmatched_match_keys"),
        count_if(F.col("_m").isNull()).alias("unmatched_market_keys"),
        count_if(F.col("_m").isNotNull() & F.col("_o").isNotNull()).alias("aligned_rows"),
    )
    return both.crossJoin(F.broadcast(market_audit(rows).drop("invalid_key_rows"))).withColumn(
        "coverage_percentage", percentage(F.col("aligned_rows"), F.col("candidate_match_rows"))
    )


def coverage_slices(
    matches: DataFrame, covered_keys: DataFrame, sets=(("Division",), ("SeasonStartYear",), ())
) -> DataFrame:
    """Candidates, aligned rows and percentage for several slicings in one pass."""
    marked = covered_keys.select(*S.KEY, F.lit(1).alias("_covered"))
    dims = list(dict.fromkeys(c for s in sets for c in s))
    joined = matches.select(*dict.fromkeys((*S.KEY, *dims))).join(marked, list(S.KEY), "left")
    sliced = joined.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims])
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in dims])
    kinds = F.array_join(
        F.array_compact(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in dims])), "/"
    )
    return sliced.agg(
        kinds.alias("kind"),
        F.count(F.lit(1)).alias("candidate_match_rows"),
        F.count("_covered").alias("aligned_rows"),
    ).select(
        F.when(F.col("kind") == "", "all").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("kind") == "", "all").otherwise(name).alias("name"),
        "candidate_match_rows",
        "aligned_rows",
        percentage(F.col("aligned_rows"), F.col("candidate_match_rows")).alias(
            "coverage_percentage"
        ),
    )
