"""Strict-prior state: what an entity's past looked like before a given day.

Every feature of this library answers the same question, so it is asked once. Rows are first
folded to one row per (entity, day): a count, and the last ``k`` rows of that day in the stable
order. State is then a window over *days*, never over rows, which gives three properties:

* all rows of a day read the same state and a day becomes visible only as a whole;
* a window group holds at most one row per calendar day, however many rows the entity has, so
  an entity that owns a third of the table is no more work than any other;
* the rows of a busy day are pruned to ``k`` before the shuffle (``row_number() <= k`` becomes a
  window group limit), and counts are combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlab.functions.scalars import day as day_number

TEAM = ("Division", "SeasonStartYear", "team")
CAREER = ("Division", "team")


def sides(
    matches: DataFrame,
    keep: Sequence[str],
    pairs: dict[str, tuple[Column, Column]],
) -> DataFrame:
    """Unpivot each match into a home and an away row in one scan.

    ``pairs`` maps an output column to its (home, away) expressions; ``keep`` is carried as is.
    """
    home = F.struct(F.lit("H").alias("side"), *[h.alias(n) for n, (h, _) in pairs.items()])
    away = F.struct(F.lit("A").alias("side"), *[a.alias(n) for n, (_, a) in pairs.items()])
    return matches.select(*keep, F.explode(F.array(home, away)).alias("_s")).select(
        *keep, "_s.*"
    )


def day_counts(rows: DataFrame, entity: Sequence[str], day: str, **sums: Column) -> DataFrame:
    """Rows per (entity, day), plus any extra aggregates."""
    return rows.groupBy(*entity, day).agg(
        F.count(F.lit(1)).alias("day_n"), *[c.alias(n) for n, c in sums.items()]
    )


def day_rows(
    rows: DataFrame,
    entity: Sequence[str],
    day: str,
    order: Sequence[str],
    payload: Sequence[str],
    k: int,
) -> DataFrame:
    """The last ``k`` rows of every (entity, day), numbered from the latest as ``_back``."""
    within = Window.partitionBy(*entity, day).orderBy(*[F.col(c).desc() for c in order])
    return (
        rows.select(*dict.fromkeys((*entity, day, *order, *payload)))
        .withColumn("_back", F.row_number().over(within))
        .where(F.col("_back") <= k)
    )


def means_before(
    rows: DataFrame,
    entity: Sequence[str],
    day: str,
    order: Sequence[str],
    means: dict[str, tuple[str, int]],
) -> DataFrame:
    """Means over the last rows before each (entity, day); ``means`` maps a name to (column, rows).

    A day keeps its last ``k`` rows, ``k`` the longest mean, so that what precedes its first kept row
    are the last rows of the earlier days. NULLs hold their place and are left out of the mean.
    """
    k = max(n for _, n in means.values())
    kept = day_rows(rows, entity, day, order, [c for c, _ in means.values()], k)
    ordered = Window.partitionBy(*entity).orderBy(day_number(F.col(day)), *order)
    made = {name: F.avg(c).over(ordered.rowsBetween(-n, -1)) for name, (c, n) in means.items()}
    first = ~F.lag(day).over(ordered).eqNullSafe(F.col(day))
    return (
        kept.select(*entity, day, first.alias("_first"), *[m.alias(name) for name, m in made.items()])
        .where("_first")
        .drop("_first")
    )


def day_tails(
    rows: DataFrame,
    entity: Sequence[str],
    day: str,
    order: Sequence[str],
    payload: Sequence[str],
    k: int,
) -> DataFrame:
    """The last ``k`` rows of every (entity, day), oldest first, as an array of structs."""
    last = day_rows(rows, entity, day, order, payload, k)
    entry = F.struct((-F.col("_back")).alias("at"), *payload)
    return last.groupBy(*entity, day).agg(F.sort_array(F.collect_list(entry)).alias("day_tail"))


def over_days(entity: Sequence[str], day: str):
    return Window.partitionBy(*entity).orderBy(day_number(F.col(day)))


def days_before(entity: Sequence[str], day: str, days: int | None = None):
    """Frame over the strictly earlier days, optionally only the last ``days`` of them."""
    start = Window.unboundedPreceding if days is None else -days
    return over_days(entity, day).rangeBetween(start, -1)


def last_rows(tail: Column, k: int) -> Column:
    return F.slice(tail, F.greatest(F.size(tail) - (k - 1), F.lit(1)), F.lit(k))


def prior_tail(entity: Sequence[str], day: str, k: int, tail: str = "day_tail") -> Column:
    """The last ``k`` rows of the strictly earlier days (each day has at least one row)."""
    frame = over_days(entity, day).rowsBetween(-k, -1)
    return last_rows(F.flatten(F.collect_list(tail).over(frame)), k)


def tails_before(
    daily: DataFrame, entity: Sequence[str], day: str, k: int, asked: DataFrame | None = None
) -> DataFrame:
    """``tail``: the last ``k`` rows before each (entity, day).

    Without ``asked`` the days are those of the history itself. With it they are the distinct days
    of ``asked``, which need not occur in the history: each reads the tail the latest earlier
    history day left behind.
    """
    if asked is None:
        return daily.select(*entity, day, prior_tail(entity, day, k).alias("tail"))
    through = over_days(entity, day).rowsBetween(-(k - 1), 0)
    left = last_rows(F.flatten(F.collect_list("day_tail").over(through)), k)
    known = daily.select(*entity, day, left.alias("tail"), F.lit(0).alias("_ask"))
    empty = F.lit(None).cast(known.schema["tail"].dataType)
    wanted = asked.select(*entity, day).distinct().select(
        *entity, day, empty.alias("tail"), F.lit(1).alias("_ask")
    )
    latest = F.last("tail", ignorenulls=True).over(days_before(entity, day))
    return (
        known.unionByName(wanted).withColumn("tail", latest).where(F.col("_ask") == 1).drop("_ask")
    )


def team_days(targets: DataFrame, season: bool = True) -> DataFrame:
    """The (entity, day) pairs that targets ask about."""
    keep = ["Division", *(["SeasonStartYear"] if season else []), "MatchDate"]
    return sides(targets, keep, {"team": (F.col("HomeTeam"), F.col("AwayTeam"))}).drop("side")


def slot(tail: str, back: int) -> Column:
    """The ``back``-th most recent entry of a tail (1 = latest), NULL when there are fewer."""
    return F.get(F.col(tail), F.size(tail) - back)


def mean_of(values: Sequence[Column]) -> Column:
    """Mean of the non-NULL values, NULL when there is none; unrolled so it stays in codegen."""
    n = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    filled = [F.coalesce(v, F.lit(0)).cast("double") for v in values]
    return F.try_divide(sum(filled[1:], filled[0]), n)


def join_sides(
    matches: DataFrame,
    state: DataFrame,
    columns: Sequence[str],
    season: bool = True,
    home: str = "{}_H",
    away: str = "{}_A",
) -> DataFrame:
    """Put an (entity, day) state back on match rows, once per side.

    Both joins read the same shuffled state, and both shuffle matches by (team, day), so a hot
    team is spread over its days. The state grows with the matches and may hold arrays that its
    estimated size does not tell, so it is never broadcast.
    """
    shared = ["Division", "SeasonStartYear", "MatchDate"] if season else ["Division", "MatchDate"]
    out = matches
    for team, form in (("HomeTeam", home), ("AwayTeam", away)):
        side = state.select(
            *shared,
            F.col("team").alias(team),
            *[F.col(c).alias(form.format(c)) for c in columns],
        )
        out = out.join(side.hint("merge"), [*shared, team], "left")
    return out
