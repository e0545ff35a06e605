import pytest
from helpers import make, match_row
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.scalars import parse_date, parse_season
from pairlab.operators import canonical
from pairlab.sources import files

HEADER = "Div,Date,Season,HomeTeam,AwayTeam,FTR,FTHG,FTAG,HS,AS,HST,AST,HC,AC,HF,AF,HY,AY,HR,AR"
NUMBERS = "2,1,9,8,4,3,5,6,10,11,1,2,0,0"


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2023-08-05", "2023-08-05"),
        (" 05/08/2023 ", "2023-08-05"),
        ("05/08/23", "2023-08-05"),
        ("05/08/69", "1969-08-05"),
        ("05/08/68", "2068-08-05"),
        ("31/02/2023", None),
        ("2023/08/05", None),
        ("", None),
    ],
)
def test_dates(spark, text, want):
    got = one(spark, parse_date, text)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("2023", 2023),
        ("2023-2024", 2023),
        ("2023 / 2024", 2023),
        ("2023-2025", None),
        ("2324", None),
        ("1899", None),
        ("x", None),
    ],
)
def test_seasons(spark, text, want):
    assert one(spark, parse_season, text) == want


def raw(spark, **changes):
    values = dict(zip(HEADER.split(","), f"E0,05/08/23,2023,A,B,H,{NUMBERS}".split(","), strict=True))
    values.update(changes)
    values = {k: v for k, v in values.items() if v is not None}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))


def test_canonical_row(spark):
    row = canonical.canonicalise(raw(spark, HomeTeam=" \tA ", HY="")).first()
    assert row.HomeTeam == "A" and row.HomeYellow is None and row.SeasonStartYear == 2023


def test_missing_and_ambiguous_columns(spark):
    with pytest.raises(S.ContractError, match="FTHome, HomeShots"):
        canonical.normalise(raw(spark, FTHG=None, HS=None))
    with pytest.raises(S.ContractError, match="ambiguous"):
        canonical.normalise(raw(spark, MatchDate="2023-01-01"))


def test_malformed_values_are_named(spark):
    with pytest.raises(S.ContractError, match="FTHome"):
        canonical.canonicalise(raw(spark, FTHG="1.5"))
    with pytest.raises(S.ContractError, match="conflicts"):
        canonical.canonicalise(raw(spark), season=2022)
    with pytest.raises(S.ContractError, match="one season context"):
        canonical.normalise(raw(spark), season=2022, season_code="2324")


@pytest.mark.parametrize(
    "change, word",
    [
        ({"AwayTeam": "A"}, "same_team_rows"),
        ({"FTR": "X"}, "invalid_results"),
        ({"HS": "-1"}, "negative_counts"),
        ({"Div": " "}, "blank_strings"),
    ],
)
def test_rules(spark, change, word):
    with pytest.raises(S.ContractError, match=word):
        canonical.canonicalise(raw(spark, **change))


def test_duplicates_and_audit(spark):
    rows = [match_row("2022-01-01", "a", "b")] * 2 + [match_row("2022-01-01", "c", "c")]
    audit = canonical.audit_canonical(make(spark, rows), input_rows=4).first()
    assert not audit.passed
    assert audit.issues == ["same_team_rows:1", "duplicate_keys:1", "lost_rows:1"]
    short = canonical.audit_canonical(make(spark, rows[:1]).drop("FTR", "MatchDate")).first()
    assert short.issues == ["missing_columns:2"] and not short.can_be_ordered
    bad = make(spark, rows[1:2]).selectExpr(
        *[
            "CAST(-5 AS BIGINT) AS HomeShots" if c == "HomeShots"
            else "CAST(NULL AS BIGINT) AS SeasonStartYear" if c == "SeasonStartYear"
            else "' ' AS HomeTeam" if c == "HomeTeam" else c
            for c in S.CANONICAL
        ]
    )
    assert canonical.audit_canonical(bad).first().issues == [
        "null_seasons:1", "blank_strings:1", "negative_counts:1"
    ]
    with pytest.raises(S.ContractError, match="not unique; 2 rows"):
        canonical.assert_natural_key(make(spark, rows))


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_csv_tree(spark, tmp_path):
    body = "{d},{date},{h},B,H," + NUMBERS
    head = HEADER.replace("Season,", "")
    write(tmp_path / "2324" / "E0.csv", "﻿" + head + "\n" + body.format(d="E0", date="05/08/23", h="A") + "\n")
    extra = head + ",Referee\n" + body.format(d="D1", date="2022-09-01", h="K\xf6ln") + ",Max\n"
    write(tmp_path / "2223" / "D1.csv", extra, "latin-1")
    got = {r.Division: r for r in files.load_source_csv(spark, str(tmp_path), path_season=True).collect()}
    assert got["E0"].SeasonStartYear == 2023 and str(got["E0"].MatchDate) == "2023-08-05"
    assert got["D1"].HomeTeam == "K\xf6ln" and got["D1"].SeasonStartYear == 2022
    assert files.source_csv_path(str(tmp_path), "2324", "E0").endswith("2324/E0.csv")
    write(tmp_path / "2324" / "ZZ.csv", head + "\n" + body.format(d="ZZ", date="05/08/23", h="A") + "\n")
    with pytest.raises(S.ContractError, match="unsupported"):
        files.load_source_csv(spark, str(tmp_path), path_season=True)


def test_single_csv_with_season_code(spark, tmp_path):
    head = HEADER.replace("Season,", "")
    write(tmp_path / "x.csv", head + f"\nE0,05/08/23,A,B,H,{NUMBERS}\n")
    got = files.load_source_csv(spark, str(tmp_path / "x.csv"), season_code="2324").first()
    assert got.SeasonStartYear == 2023
    assert canonical.season_label("2324") == "2023-2024"


def test_numeric_seasons(spark):
    df = spark.createDataFrame([(2023.0, 2023), (2023.5, None), (None, None)], "x double, want bigint")
    assert all(r.got == r.want for r in df.select("want", parse_season(F.col("x")).alias("got")).collect())
    whole = spark.createDataFrame([(2023,)], "x int").select(parse_season(F.col("x"))).first()[0]
    assert whole == 2023
