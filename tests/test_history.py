"""Strict-prior properties of the feature table, and exact small cases."""

import datetime as dt

import pytest
from helpers import KEY, make, match_row, table
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.operators import features, form


@pytest.fixture(scope="module")
def built(matches):
    return table(features.build_feature_table(matches, {"N00": 100}))


@pytest.fixture(scope="module")
def cut(matches):
    dates = [r[0] for r in matches.select("MatchDate").distinct().orderBy("MatchDate").collect()]
    return dates[len(dates) // 2]


def test_columns_and_order(matches):
    df = features.build_feature_table(matches)
    assert tuple(df.columns) == S.FEATURE_TABLE
    assert len(S.FEATURES) == 52 and len(S.FEATURE_TABLE) == 63


def test_truncation_leaves_earlier_rows_alone(matches, built, cut):
    early = table(features.build_feature_table(matches.where(F.col("MatchDate") <= cut), {"N00": 100}))
    assert early and all(built[k] == v for k, v in early.items())


def test_own_and_same_date_results_do_not_matter(matches, built, cut):
    flipped = matches.withColumn(
        "FTHome", F.when(F.col("MatchDate") == cut, 9).otherwise(F.col("FTHome"))
    ).withColumn(
        "FTR", F.when(F.col("MatchDate") == cut, F.lit("A")).otherwise(F.col("FTR"))
    )
    again = table(features.build_feature_table(flipped, {"N00": 100}))
    width = len(S.FEATURES)
    for k, v in again.items():
        if k[0] <= cut:
            assert v[-width:] == built[k][-width:]
    assert any(v[-width:] != built[k][-width:] for k, v in again.items() if k[0] > cut)


def test_row_order_does_not_matter(matches, built):
    assert table(features.build_feature_table(matches.orderBy(F.rand(7)), {"N00": 100})) == built


def test_missing_values_hold_their_slot(spark):
    none = {c: None for c in S.MATCH_STATS}
    rows = [
        match_row("2022-01-01", "a", "b", goals=(1, 0)),
        match_row("2022-01-02", "a", "c", goals=(None, None), stats=none),
        match_row("2022-01-03", "a", "d", goals=(4, 1)),
        match_row("2022-01-04", "a", "e", goals=(7, 2)),
        match_row("2022-01-05", "a", "f", goals=(0, 0)),
    ]
    got = {
        r.MatchDate.day: r for r in form.add_rolling_features(make(spark, rows)).collect()
    }
    assert got[1].GoalsForAvg3_H_pre is None
    assert got[3].GoalsForAvg3_H_pre == 1.0
    assert got[4].GoalsForAvg3_H_pre == 2.5
    assert got[5].GoalsForAvg3_H_pre == 5.5  # of three slots one is empty
    assert got[5].GoalsForAvg5_H_pre == 4.0
    assert got[5].GoalDiffAvg3_H_pre == 4.0


def test_context_edges(spark):
    rows = [
        match_row("2022-01-01", "a", "b", "D"),
        match_row("2022-01-01", "a", "c", "A"),
        match_row("2022-01-15", "a", "d"),
        match_row("2022-01-28", "e", "a"),
        match_row("2023-01-02", "a", "b"),
    ]
    got = {
        (str(r.MatchDate), r.AwayTeam): r
        for r in form.add_context_features(make(spark, rows)).collect()
    }
    first = got["2022-01-01", "c"]
    assert first.TeamMatchNum_H_pre == 0 and first.DaysSinceLast_H_pre is None
    later = got["2022-01-15", "d"]
    assert later.Matches14d_H_pre == 0  # exactly fourteen days ago is out
    assert later.DaysSinceLast_H_pre == 14 and later.TeamMatchNum_H_pre == 2
    assert later.Form3Home_pre == 0.5 and later.SeasonProgress_pre == pytest.approx(2 / 38)
    away = got["2022-01-28", "a"]
    assert away.Matches14d_A_pre == 1 and away.RestDiff_pre is None
    assert got["2023-01-02", "b"].TeamMatchNum_H_pre == 0  # a new season starts over


def test_last_k_is_cut_inside_a_busy_day(spark):
    rows = [match_row("2022-01-01", "a", o, goals=(i, 0)) for i, o in enumerate("bcdefgh")]
    rows.append(match_row("2022-01-02", "a", "z"))
    got = form.add_rolling_features(make(spark, rows)).where(
        F.col("MatchDate") == dt.date(2022, 1, 2)
    )
    row = got.first()
    assert row.GoalsForAvg3_H_pre == 5.0 and row.GoalsForAvg5_H_pre == 4.0
    assert len(KEY) == 4


def test_busy_days_are_pruned_before_the_shuffle(matches, capsys):
    form.tail_state(matches).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan


def test_means_over_busy_days_hold_no_arrays(spark, capsys):
    rows = [match_row("2022-01-01", "a", f"b{i}", goals=(i, 0)) for i in range(7)]
    rows += [match_row("2022-01-02", "a", f"c{i}", goals=(10 * i, 1)) for i in range(2)]
    rows.append(match_row("2022-01-03", "a", "d"))
    state = form.tail_state(make(spark, rows))
    got = {r.MatchDate.day: r for r in state.where("team = 'a'").collect()}
    assert got[1].GoalsForAvg3 is None and got[1].Form5 is None
    assert (got[2].GoalsForAvg3, got[2].GoalsForAvg5) == (5.0, 4.0)
    assert (got[3].GoalsForAvg3, got[3].GoalsForAvg5) == (16 / 3, (4 + 5 + 6 + 0 + 10) / 5)
    assert got[3].GoalsAgainstAvg5 == 2 / 5 and got[3].GoalDiffAvg5 == 5.0 - 2 / 5
    state.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_team_state_is_never_broadcast(matches, capsys):
    features.team_day_state(matches).explain()
    form.add_context_features(matches).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
