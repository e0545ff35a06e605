"""Row-wise column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted text forms.
LONG_SEASON = r"^(\d{4})\s*[-/]\s*(\d{4})$"
SAFE_PARTITION = r"^[A-Za-z0-9_-]+$"
SEASON_RANGE = (1900, 2100)
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.trim(c, F.lit(WHITESPACE))


def parse_date(c: Column) -> Column:
    """ISO, day/month/year and day/month/two-digit-year text to a date; anything else is NULL.

    Two-digit years follow the POSIX pivot: 69-99 are 19xx and 00-68 are 20xx.
    """
    text = strip(c)
    iso = F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")
    )
    long_year = F.when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "d/M/yyyy")
    )
    two = F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 2)
    century = F.when(two >= F.lit("69"), F.lit("19")).otherwise(F.lit("20"))
    short_year = F.when(
        two != "",
        F.try_to_date(
            F.concat(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)", 1), century, two), "d/M/yyyy"
        ),
    )
    return F.coalesce(iso, long_year, short_year)


def parse_season(c: Column) -> Column:
    """Start year from 2023, 2023.0 (as a number), '2023', '2023-2024' or '2023/2024'."""
    value = c.try_cast("double")
    whole = F.when(value == F.floor(value), F.floor(value).cast("string"))
    fractional = F.typeof(c).isin("double", "float") | F.typeof(c).startswith("decimal")
    text = strip(F.when(fractional, whole).otherwise(c.cast("string")))
    start = F.regexp_extract(text, LONG_SEASON, 1).try_cast("bigint")
    end = F.regexp_extract(text, LONG_SEASON, 2).try_cast("bigint")
    year = F.coalesce(
        F.when(text.rlike(r"^\d{4}$"), text.try_cast("bigint")),
        F.when(end == start + 1, start),
    )
    return F.when(year.between(*SEASON_RANGE), year)


def number(c: Column) -> Column:
    """Lenient text-to-double, blank and malformed text becoming NULL.

    A trailing d or f is a Java literal suffix, not part of a number.
    """
    text = strip(c.cast("string"))
    return F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def finite(c: Column) -> Column:
    """TRUE only for a present, ordinary double (NaN compares greater than everything)."""
    return F.coalesce(
        c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)
    )


def day(c: Column) -> Column:
    return F.unix_date(c)


def points(for_result: Column, win: str, loss: str) -> Column:
    return (
        F.when(for_result == win, F.lit(3.0))
        .when(for_result == "D", F.lit(1.0))
        .when(for_result == loss, F.lit(0.0))
    )


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part / whole)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def every(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, but a row that breaks the condition stops the job.

    The guard is a filter: a narrower select cannot prune it, as it would a guarded column.
    """
    broken = F.raise_error(F.lit(message)).cast("boolean")
    return df.where(F.when(condition, F.lit(True)).otherwise(broken))


def preview(df: DataFrame, order: list[str], rows: int = 5) -> tuple[list, str]:
    """The first rows in a fixed order, and a note of how many more there are."""
    first = df.orderBy(*order).limit(rows + 1).collect()
    more = df.count() - rows if len(first) > rows else 0
    return first[:rows], f" (+{more} more)" if more else ""
