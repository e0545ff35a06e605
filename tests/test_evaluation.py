"""Folds, metrics, market and gate on hand-made cases."""

import datetime as dt
import math

import pytest
from conftest import SF
from helpers import make, match_row
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.operators import baselines, folds, market, metrics
from pairlab.plans import derived, registry


def dated(spark, *rows):
    return make(spark, [match_row(d, h, a, season=s) for d, h, a, s in rows])


def test_folds(spark):
    df = dated(
        spark,
        ("2020-05-01", "a", "b", 2020),
        ("2021-05-01", "a", "b", 2021),
        ("2022-05-01", "a", "b", 2022),
    )
    tagged = folds.expanding_folds(df, [2021, 2022], 2022)
    rows = folds.check_folds(tagged, [2021, 2022])
    assert [(r.train_rows, r.test_rows, r.fold_role) for r in rows] == [
        (1, 1, "development"),
        (2, 1, "historical_final"),
    ]
    with pytest.raises(S.ContractError, match="empty"):
        folds.check_folds(folds.expanding_folds(df, [2020], 2022), [2020])


def test_overlapping_seasons_are_refused(spark):
    df = dated(spark, ("2022-05-01", "a", "b", 2020), ("2021-05-01", "a", "b", 2021))
    with pytest.raises(S.ContractError, match="chronology"):
        folds.check_folds(folds.expanding_folds(df, [2021], 2021), [2021])


def test_inner_split_and_batches(spark):
    rows = [(f"2020-01-{d:02d}", t, "z", 2020) for d in range(1, 12) for t in "ab"]
    df = dated(spark, *rows).withColumn("fold", F.lit("f"))
    split = folds.inner_time_split(df, 0.25)
    late = split.where("inner_part = 'validation'")
    assert late.select("MatchDate").distinct().count() == 2
    assert late.agg(F.min("MatchDate")).first()[0] == dt.date(2020, 1, 10)
    batches = folds.date_batches(df)
    assert batches.agg(F.max("batch")).first()[0] == 11
    with pytest.raises(ValueError):
        folds.inner_time_split(df, 1.0)
    one_day = df.where("MatchDate = '2020-01-01'")
    with pytest.raises(Exception, match="two distinct dates"):
        folds.inner_time_split(one_day).collect()


def predictions(spark, rows, model="m", fold="f"):
    data = [
        (fold, "development", model, dt.date(2022, 1, 1), "E0", f"h{i}", f"a{i}", *r)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "fold string, fold_role string, model string, MatchDate date, Division string, HomeTeam string,"
        " AwayTeam string, label string, probability_home double, probability_draw double,"
        " probability_away double",
    )


def test_metrics(spark):
    df = predictions(spark, [("H", 0.5, 0.3, 0.2), ("A", 0.2, 0.2, 0.6), ("D", 1.0, 0.0, 0.0)])
    row = metrics.evaluate(df).first()
    assert row.n_samples == 3
    want = (-math.log(0.5) - math.log(0.6) - math.log(1e-15)) / 3
    assert row.log_loss == pytest.approx(want, abs=1e-12)
    assert row.brier_score == pytest.approx((0.38 + 0.24 + 2.0) / 3)
    assert row.ece == pytest.approx((0.5 + 0.4 + 1.0) / 3)


def test_bins_are_right_closed_and_ties_go_first(spark):
    df = predictions(spark, [("D", 0.4, 0.4, 0.2), ("H", 0.5, 0.25, 0.25)])
    got = {r["bin"]: r for r in metrics.calibration_bins(df).collect()}
    assert set(got) == {3, 4} and got[3].accuracy == 0.0 and got[4].accuracy == 1.0


@pytest.mark.parametrize("row", [("H", 0.5, 0.6, 0.2), ("X", 0.5, 0.3, 0.2), ("H", 1.2, -0.1, -0.1)])
def test_unusable_predictions_stop_the_job(spark, row):
    with pytest.raises(Exception, match="invalid label or probabilities"):
        metrics.evaluate(predictions(spark, [row])).collect()


def test_sanity(spark):
    df = predictions(spark, [("H", float("nan"), 0.5, 0.5), ("H", 1.5, -0.5, 0.0), ("H", 0.1, 0.1, 0.1)])
    row = metrics.probability_sanity(df).first()
    assert (row.not_finite, row.outside_unit_interval, row.not_summing_to_one) == (1, 1, 1)
    with pytest.raises(S.ContractError):
        metrics.validate_probabilities(df)


def comparison(spark, gains, final=0.5):
    rows = [(f"f{i}", "development", "c", 10 * (i + 1), 1.0, 1.0 - g, g) for i, g in enumerate(gains)]
    rows.append(("f9", "historical_final", "c", 10, 1.0, 1.0 - final, final))
    return spark.createDataFrame(
        rows,
        "fold string, fold_role string, candidate string, n_samples bigint, baseline_log_loss double,"
        " candidate_log_loss double, improvement_log_loss double",
    )


@pytest.mark.parametrize(
    "gains, passed",
    [
        ((0.01, 0.01, 0.01), True),
        ((0.5, -0.001, -0.001), False),  # one fold cannot carry it
        ((0.001, 0.001, 0.001), False),
    ],
)
def test_gate(spark, gains, passed):
    row = metrics.gate(comparison(spark, gains)).first()
    assert row.passed is passed and row.historical_final_improvement_log_loss == pytest.approx(0.5)


def test_gate_needs_all_folds(spark):
    with pytest.raises(Exception, match="3 development folds"):
        metrics.gate(comparison(spark, (0.1, 0.1))).collect()


def test_identical_rows(spark):
    a = predictions(spark, [("H", 0.5, 0.3, 0.2)] * 2, "a")
    b = predictions(spark, [("H", 0.5, 0.3, 0.2)], "b")
    metrics.assert_identical_rows(a)
    with pytest.raises(S.ContractError):
        metrics.assert_identical_rows(a.unionByName(b))


def test_best_candidate_ignores_the_final_fold(spark):
    rows = [
        ("f1", "development", "a", 10, 1.0),
        ("f1", "development", "b", 10, 1.0),
        ("f2", "historical_final", "b", 10, 0.1),
    ]
    df = spark.createDataFrame(rows, "fold string, fold_role string, model string, n_samples bigint, log_loss double")
    assert metrics.best_candidate(df).first().selected == "a"


def test_prior_needs_all_classes(spark):
    rows = [match_row("2020-01-01", "a", "b", "H"), match_row("2021-01-01", "a", "b", "D")]
    tagged = folds.expanding_folds(make(spark, rows), [2021], 2021)
    with pytest.raises(Exception, match="H, D and A"):
        baselines.prior_predictions(tagged, "FTR").collect()


ODDS = "Date string, Div string, HomeTeam string, AwayTeam string, AvgCH string, AvgCD string, AvgCA string"


def test_market(spark):
    rows = [
        ("01/08/22", "E0", " a", "b", "2.0", "4.0", "4.0"),
        ("01/08/22", "E0", "c", "d", "", "4.0", "4.0"),
        ("01/08/22", "E0", "e", "f", "1.0", "4.0", "4.0"),
        ("01/08/22", "E0", "g", "h", "x", "4.0", "4.0"),
        ("01/08/22", "E0", "i", "j", "NaN", "4.0", "4.0"),
    ]
    raw = spark.createDataFrame(rows, ODDS)
    valid, audit = market.prepare_closing_market(raw)
    row = audit.first()
    assert (row.valid_market_rows, row.incomplete_odds_rows, row.invalid_odds_rows) == (1, 1, 3)
    p = market.closing_market_probabilities(valid).first()
    assert p.HomeTeam == "a" and p.probability_home == 0.5 and p.market_overround == 1.0
    with pytest.raises(S.ContractError, match="1 incomplete and 3 invalid"):
        market.normalize_closing_market(raw)
    with pytest.raises(S.ContractError, match="repeat"):
        market.prepare_closing_market(spark.createDataFrame(rows[:1] * 2, ODDS))
    with pytest.raises(S.ContractError, match="ClosingHomeOdds"):
        market.market_rows(raw.drop("AvgCH"))


def test_guards_survive_a_narrow_select(spark):
    rows = [("f", 1, "d", "m", dt.date(2022, 1, 1), "E0", "a", "b", "H", 5.0, -3.0, 0.2)]
    bad = spark.createDataFrame(
        rows,
        "fold string, test_year int, fold_role string, model string, MatchDate date, Division string, HomeTeam string,"
        " AwayTeam string, label string, probability_home double, probability_draw double, probability_away double",
    )
    for made, column in ((metrics.calibration_bins(bad), "n"), (metrics.evaluate(bad), "n_samples")):
        with pytest.raises(Exception, match="invalid label or probabilities"):
            made.select(column).collect()


def test_market_alignment_is_one_to_one(spark, tables):
    raw = tables.market.limit(20)
    with pytest.raises(S.ContractError, match="keys repeat"):
        market.align_closing_market(tables.canonical, raw.unionByName(raw))


def test_numbers_as_odds_are_not_parsed_as_text(spark):
    schema = "MatchDate date, Division string, HomeTeam string, AwayTeam string, AvgCH double, AvgCD double, AvgCA int"
    day = dt.date(2020, 1, 1)
    given = [(2.5, 3.0, 4), (None, 3.0, 4), (float("nan"), 3.0, 4), (1.0, 3.0, 4), (float("inf"), 3.0, 4), (1e-7, 0.1, 2)]
    df = spark.createDataFrame([(day, "E0", f"T{i}", "Z", *odds) for i, odds in enumerate(given)], schema)
    texts = df.select(*df.columns[:4], *[F.col(c).cast("string").alias(c) for c in df.columns[4:]])
    made = market.market_rows(df)
    assert "RLIKE" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert repr(sorted(made.collect())) == repr(sorted(market.market_rows(texts).collect()))


def test_predictions_come_from_stored_matches(spark):
    made = registry.simple_predictions(derived.Tables(spark, SF))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
    assert {r.model for r in made.select("model").distinct().collect()} == {"uniform", "training_prior", "market"}


def test_team_states_are_never_broadcast(spark):
    t = derived.Tables(spark, SF).stored("matches")
    made = registry.history.join_sides(t.fixtures, t.fixtures.select(*S.KEY[:2], "SeasonStartYear", F.col("HomeTeam").alias("team")).distinct(), [])
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
