import datetime as dt

from pairlab import schema as S

KEY = list(S.KEY)


def match_row(date, home, away, ftr="H", goals=(1, 0), season=None, division="E0", stats=None):
    d = dt.date.fromisoformat(date)
    values = stats or {c: 1 for c in S.MATCH_STATS}
    return (
        d,
        season if season is not None else d.year,
        division,
        home,
        away,
        ftr,
        *goals,
        *[values.get(c) for c in S.MATCH_STATS],
    )


def make(spark, rows):
    return spark.createDataFrame(rows, S.CANONICAL_SCHEMA)


def table(df, columns=None):
    """Rows by match key, doubles rounded."""
    columns = columns or [c for c in df.columns if c not in KEY]
    out = {}
    for r in df.collect():
        out[tuple(r[k] for k in KEY)] = tuple(
            round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns
        )
    return out
