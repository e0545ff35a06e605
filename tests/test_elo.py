import pytest
from helpers import make, match_row, table

from pairlab.operators import elo


def test_arithmetic(spark):
    rows = [
        match_row("2022-01-01", "a", "b", "H"),
        match_row("2022-01-08", "b", "a", "D"),
        match_row("2023-01-01", "a", "b", "A"),
    ]
    got = {str(r.MatchDate): r for r in elo.add_elo_features(make(spark, rows)).collect()}
    assert got["2022-01-01"].HomeElo_pre == 1500 and got["2022-01-01"].EloDiff_pre == 0
    gain = 40 * (1 - 1 / (1 + 10 ** (-60 / 400)))
    second = got["2022-01-08"]
    assert second.AwayElo_pre == pytest.approx(1500 + gain)
    assert second.HomeElo_pre == pytest.approx(1500 - gain)
    move = 40 * (0.5 - 1 / (1 + 10 ** ((2 * gain - 60) / 400)))
    third = got["2023-01-01"]
    assert third.AwayElo_pre == pytest.approx((1500 - gain + move) * 0.7 + 450)


def test_a_date_is_one_batch(spark):
    rows = [match_row("2022-01-01", "a", "b"), match_row("2022-01-01", "a", "c")]
    got = elo.add_elo_features(make(spark, rows)).collect()
    assert all(r.HomeElo_pre == 1500 for r in got)


def test_dates_that_span_batches(spark, matches):
    some = matches.where("Division <> 'N02' AND MatchDate < '1997-01-01'")
    whole = table(elo.add_elo_features(some), ["HomeElo_pre", "AwayElo_pre"])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        cut = table(elo.add_elo_features(some), ["HomeElo_pre", "AwayElo_pre"])
    finally:
        spark.conf.set(key, before)
    assert cut == whole and len(whole) > 10


def test_invalid_results_stop_the_job(spark):
    for ftr in ("X", None):
        rows = [match_row("2022-01-01", "a", "b"), match_row("2022-01-08", "a", "b", ftr)]
        with pytest.raises(Exception, match="outside H, D and A"):
            elo.add_elo_features(make(spark, rows)).collect()


def test_two_seasons_on_a_date_are_refused(spark):
    rows = [
        match_row("2022-01-01", "a", "b", season=2021),
        match_row("2022-01-01", "c", "d", season=2022),
    ]
    with pytest.raises(Exception, match="two seasons"):
        elo.add_elo_features(make(spark, rows)).collect()


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        elo.elo_state(make(spark, []), reversion=1.5)
