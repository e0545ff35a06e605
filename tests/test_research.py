"""Names, expected goals, availability, graph and sequences."""

import numpy as np
import pytest
from helpers import make, match_row, table
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.functions.names import normalize_team_name, team_name_udf
from pairlab.operators import availability, folds, graph, sequences, xg
from pairlab.operators.indexing import dense_index
from pairlab.plans import registry


@pytest.mark.parametrize(
    "name, want",
    [
        ("Saint-\xc9tienne", "st etienne"),
        ("  K\xf6ln ", "fc koln"),
        ("Nott'm  Forest", "nottm forest"),
        ("Hertha BSC", "hertha"),
        ("A.C. Milan", "milan"),
        ("\xbd x", "12 x"),
    ],
)
def test_names(name, want):
    assert normalize_team_name(name) == want


def test_name_udf_keeps_nulls(spark):
    df = spark.createDataFrame([("K\xf6ln",), (None,), ("K\xf6ln",)], "n string")
    got = [r[0] for r in df.select(team_name_udf()("n")).collect()]
    assert got == ["fc koln", None, "fc koln"]


def aligned(spark, rows):
    return spark.createDataFrame(
        rows,
        "MatchDate date, Division string, HomeTeam string, AwayTeam string, SeasonStartYear bigint,"
        " FTHome bigint, FTAway bigint, home_xg double, away_xg double, aligned int",
    )


def test_xg_history(spark):
    import datetime as dt

    def row(day, home, away, hg, hx, ax):
        return (dt.date(2022, 1, day), "E0", home, away, 2022, hg, 0, hx, ax, int(hx is not None))

    history = aligned(
        spark,
        [
            row(1, "a", "b", 2, 1.0, 0.5),
            row(2, "c", "a", 0, None, None),
            row(3, "a", "d", None, 3.0, 1.5),
            row(4, "a", "e", 1, 2.0, 1.0),
        ],
    )
    got = {r.MatchDate.day: r for r in xg.xg_features(history, history).collect()}
    assert got[1].XgForAvg5_H_xg_pre is None
    assert got[3].XgForAvg5_H_xg_pre == 1.0 and got[3].GminusXgForAvg5_H_xg_pre == 1.0
    assert got[4].XgForAvg5_H_xg_pre == 2.0 and got[4].XgDiffAvg10_H_xg_pre == 1.0
    assert got[4].GminusXgForAvg5_H_xg_pre is None  # a counted match has no goals


def test_targets_outside_the_history(spark, matches):
    cut = "1999-06-01"
    past, later = matches.where(F.col("MatchDate") < cut), matches.where(F.col("MatchDate") >= cut)
    made = {k: v for k, v in table(sequences.match_sequences(later, past)).items()}
    assert len(made) == later.count() and any(v[1] for v in made.values())
    for k, v in made.items():
        assert all(x.log_days_ago > 0 for x in v[1])
    whole = table(sequences.match_sequences(matches, matches))
    inside = table(sequences.match_sequences(matches, matches, inside=True))
    assert whole == inside
    # before the first later match of a team, its past is the same with and without later rows
    first = {}
    for k in sorted(made):
        first.setdefault((k[1], k[2]), k)
        first.setdefault((k[1], k[3]), k)
    fresh = [k for k in made if first[k[1], k[2]] == k and first[k[1], k[3]] == k]
    assert fresh and all(made[k] == whole[k] for k in fresh)


def test_external_schema(spark, tables):
    with pytest.raises(S.ContractError, match="unexpected"):
        xg.normalise_external(tables.external_xg.withColumn("x", F.lit(1)))
    with pytest.raises(S.ContractError, match="external xG schema failed"):
        xg.validate_external(tables.external_xg)  # its divisions are not supported ones
    assert xg.history_issues(tables.external_xg.withColumn("home_xg", F.lit(None).cast("double"))).first().unpaired_rows > 0


def test_alias_collapse(spark):
    matches = make(spark, [match_row("2022-01-01", "Koln", "b"), match_row("2022-01-01", "FC Koln", "b")])
    theirs = matches.select(
        "Division", "MatchDate", "HomeTeam", "AwayTeam", F.lit(1.0).alias("home_xg"), F.lit(1.0).alias("away_xg")
    ).limit(1)
    out = xg.align_external_xg(matches, xg.normalise_external(theirs))
    with pytest.raises(S.ContractError, match="collapse"):
        xg.check_alias_collapse(out)


@pytest.fixture(scope="module")
def squad(tables):
    from pairlab.session import durable

    keep = "Division IN ('N00', 'N01')"
    fixtures = durable(tables.fixtures.where(keep))
    games = fixtures.select("game_id")
    appearances = durable(tables.appearances.join(games, "game_id", "left_semi"))
    lineups = durable(tables.lineups.join(games, "game_id", "left_semi"))
    return fixtures, appearances, lineups, durable(tables.valuations)


def test_same_day_and_later_relations_do_not_matter(squad):
    fixtures, appearances, lineups, valuations = squad
    base = table(availability.availability_features(*squad))
    dates = sorted({k[0] for k in base})
    cut = dates[len(dates) // 2]
    late = fixtures.where(F.col("MatchDate") >= cut).select("game_id")
    fewer = (
        appearances.join(late, "game_id", "left_anti"),
        lineups.join(late, "game_id", "left_anti"),
        valuations.where(F.col("date") < cut),
    )
    again = table(availability.availability_features(fixtures, *fewer))
    early = [k for k in base if k[0] <= cut]
    assert early and all(base[k] == again[k] for k in early)


def test_relation_rules(spark, squad):
    fixtures, appearances, lineups, valuations = squad
    availability.validate_relations(*squad)
    for broken, word in (
        ((fixtures, appearances.union(appearances), lineups, valuations), "duplicate_appearance"),
        ((fixtures, appearances, lineups.withColumn("type", F.lit("x")), valuations), "role"),
        ((fixtures.limit(1), appearances, lineups, valuations), "unmatched"),
        (
            (fixtures, appearances.withColumn("minutes_played", F.lit(-1.0)), lineups, valuations),
            "minutes",
        ),
    ):
        with pytest.raises(S.ContractError, match=word):
            availability.validate_relations(*broken)


def test_ties_rank_by_first_appearance_then_player(spark):
    rows = [("E0", 2022, "a", p, m, f) for p, m, f in ((3, 90.0, 1), (2, 90.0, 2), (1, 90.0, 1), (4, 100.0, 1))]
    pool = spark.createDataFrame(
        rows, "Division string, SeasonStartYear bigint, team string, player_id bigint, m5 double, first5 int"
    ).withColumn("MatchDate", F.lit("2022-01-01").cast("date"))
    ranked = (
        pool.withColumn("rank", availability._rank("m5", "first5")).where("rank <= 11").orderBy("rank").collect()
    )
    assert [r.player_id for r in ranked] == [4, 2, 1, 3]


def test_embeddings_match_numpy(spark, squad):
    fixtures, appearances, lineups, _ = squad
    edges = graph.season_edges(fixtures, graph.side_weights(appearances, lineups))
    last = folds.fold_table(spark, [2001], 2001)
    edges = graph.fold_edges(edges, last)
    rows = edges.collect()
    teams = sorted({(r.Division, r.team) for r in rows})
    players = sorted({r.player_id for r in rows})
    m = np.zeros((len(teams), len(players)))
    for r in rows:
        m[teams.index((r.Division, r.team)), players.index(r.player_id)] = r.edge
    _, sigma, vt = np.linalg.svd(m, full_matrices=False)
    want = vt[:4].T * np.sqrt(sigma[:4])
    made = {r.player_id: r.embedding for r in graph.player_embeddings(edges, 4).collect()}
    got = np.array([made[p] for p in players])
    assert np.allclose(np.abs(got.T @ got), np.abs(want.T @ want), atol=1e-6)
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-6)


def test_small_graphs_pad(spark):
    edges = spark.createDataFrame(
        [("f", "E0", "a", 1, 1.0), ("f", "E0", "b", 2, 2.0), ("f", "E0", "b", 1, 0.5)],
        "fold string, Division string, team string, player_id bigint, edge double",
    )
    got = graph.player_embeddings(edges, 8).collect()
    assert all(len(r.embedding) == 8 and r.embedding[1:] == [0.0] * 7 for r in got)


def test_graph_features_without_history(squad):
    fixtures, appearances, lineups, _ = squad
    graph.prepare_relations(fixtures, appearances, lineups)
    weights = graph.side_weights(appearances, lineups)
    none = appearances.select("player_id").distinct().withColumn(
        "embedding", F.array(*[F.lit(1.0)] * 8)
    )
    made = graph.graph_features(fixtures, graph.recent_pool(fixtures, weights), none, "svd8_recent10")
    assert made.columns[6:] == graph.feature_names("svd8_recent10") and len(made.columns) == 46
    first = made.orderBy("MatchDate").first()
    p = "graph_svd8_recent10"
    assert first[f"{p}_cosine_pre"] is None and first[f"{p}_H_pool_players_pre"] == 0.0


def test_sequences(spark):
    rows = [
        match_row("2021-12-31", "a", "b", "H", (3, 0)),
        match_row("2022-01-01", "c", "a", "D", (1, 1)),
        match_row("2022-01-08", "a", "d", "A"),
    ]
    df = make(spark, rows)
    got = {r.MatchDate.day: r for r in sequences.match_sequences(df, df).collect()}
    past = got[8].home_sequence
    assert [x.was_home for x in past] == [1.0, 0.0] and past[0].goals_for == 1.0
    assert [x.same_season for x in past] == [0.0, 1.0]
    assert past[1].log_days_ago == pytest.approx(np.log1p(7) / 7) and past[1].points == pytest.approx(1 / 3)
    assert got[31].home_sequence == []
    made = sequences.match_sequences(df, df)
    assert sequences.gather(made, df.limit(2)).count() == 2
    with pytest.raises(Exception, match="no sequence"):
        sequences.gather(made.where("HomeTeam = 'c'"), df).collect()
    pooled = sequences.pooled_representation(made).where("MatchDate = '2022-01-08'").first()
    assert pooled.seq_H_mean_was_home_pre == 0.5
    assert pooled.seq_H_recent_was_home_pre == pytest.approx(0.8 / 1.8)


def test_vocabulary(spark):
    train = make(spark, [match_row("2022-01-01", "b", "a"), match_row("2022-01-01", "x", "y", division="D1")])
    later = make(spark, [match_row("2022-02-01", "b", "new")])
    vocabulary = sequences.train_vocabulary(train)
    row = sequences.team_ids(later, vocabulary).first()
    assert (row.home_id, row.away_id, row.away_unseen, row.league_id) == (3, 5, 1, 1)
    foreign = make(spark, [match_row("2022-02-01", "b", "a", division="I1")])
    with pytest.raises(Exception, match="absent"):
        sequences.team_ids(foreign, vocabulary).collect()


def test_encoded_rows(spark):
    rows = [
        ("2020-01-01", "E0", "a", "b", "train"), ("2020-01-02", "E1", "c", "d", "train"),
        ("2021-01-01", "E1", "c", "x", "test"), ("2021-01-02", "E0", "c", "a", "test"),
    ]
    df = spark.createDataFrame(rows, "MatchDate string, Division string, HomeTeam string, AwayTeam string, part string")
    got = {r.MatchDate: r.encoded.toArray().tolist() for r in sequences.encoded_rows(df).collect()}
    assert got == {
        "2020-01-01": [1, 0, 0, 0], "2020-01-02": [0, 1, 0, 0], "2021-01-01": [0, 1, 0, 1], "2021-01-02": [1, 0, 1, 0],
    }
    foreign = df.union(spark.createDataFrame([("2021-01-03", "E9", "a", "b", "test")], df.schema))
    with pytest.raises(Exception, match="absent from the training vocabulary"):
        sequences.encoded_rows(foreign).collect()


def test_dense_index_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    rows = dense_index(df, ["v"], "i").collect()
    assert all(r.v == r.i for r in rows) and len(rows) == 1000


def test_external_xg_stands_behind_its_gates(spark, tables):
    from pairlab.plans import experiments, registry

    divisions = [f"N{i:02d}" for i in range(25)]

    def run(raw, matches=tables.matches):
        experiments.external_xg_comparison(
            tables.canonical, matches, raw, divisions, registry.XG_ALIASES, registry.YEARS, 2001
        )

    with pytest.raises(S.ContractError, match="quality gate"):
        run(tables.external_xg)
    with pytest.raises(S.ContractError, match="schema failed"):
        run(tables.external_xg.unionByName(tables.external_xg))
    with pytest.raises(S.ContractError, match="schema failed"):
        run(tables.external_xg.withColumn("Division", F.lit("X1")))


def test_availability_refuses_broken_relations(spark, squad):
    from pairlab.plans import experiments

    fixtures, appearances, lineups, values = squad
    with pytest.raises(S.ContractError, match="player relations"):
        experiments.availability_comparison(
            fixtures, fixtures, appearances.unionByName(appearances), lineups, values
        )


def test_first_seasons_give_every_folds_encoding(spark):
    rows = [
        ("2020-01-01", 2020, "E0", "a", "b"), ("2020-01-02", 2020, "E1", "c", "d"),
        ("2021-01-01", 2021, "E1", "c", "x"), ("2021-01-02", 2021, "E0", "c", "a"),
        ("2022-01-01", 2022, "E0", "c", "b"), ("2022-01-02", 2022, "E1", "y", "x"),
    ]
    df = spark.createDataFrame(rows, "MatchDate string, SeasonStartYear bigint, Division string, HomeTeam string, AwayTeam string")
    known = sequences.with_first_seasons(df)
    encode = sequences.encoding(known)
    for year in (2021, 2022):
        own = known.where(F.col("SeasonStartYear") <= year)
        tagged = own.withColumn("part", F.when(F.col("SeasonStartYear") < year, "train").otherwise("test"))
        want = {r.MatchDate: r.encoded.toArray().tolist() for r in sequences.encoded_rows(tagged).collect()}
        inputs = [c.alias(f"v{i}") for i, c in enumerate(encode(year).values())]
        got = {r[0]: list(r[1:]) for r in own.select("MatchDate", *inputs).collect()}
        assert got == want
    foreign = df.union(spark.createDataFrame([("2021-01-03", 2021, "E9", "a", "b")], df.schema))
    known = sequences.with_first_seasons(foreign)
    inputs = list(sequences.encoding(known)(2021).values())
    with pytest.raises(Exception, match="absent from the training vocabulary"):
        known.select(*inputs).collect()


def test_sequences_carry_the_descriptors_that_are_read(spark, tables, monkeypatch):
    df = make(spark, [match_row("2021-12-31", "a", "b", "H", (3, 0)), match_row("2022-01-08", "a", "d", "A")])
    some = ("goals_for", "log_days_ago")
    whole = table(sequences.match_sequences(df, df), ["home_sequence"])
    part = table(sequences.match_sequences(df, df, descriptors=some), ["home_sequence"])
    assert {k: [tuple(x[d] for d in some) for x in v[0]] for k, v in whole.items()} == {
        k: [tuple(x) for x in v[0]] for k, v in part.items()
    }
    with pytest.raises(ValueError, match="descriptors"):
        sequences.match_sequences(df, df, descriptors=("goals",))
    # the registered query shuffles the goals alone
    made = []
    gather = sequences.gather
    monkeypatch.setattr(sequences, "gather", lambda s, w: made.append(s) or gather(s, w))
    registry.QUERIES["gathered_sequences"](spark, tables.directory)
    assert made[0].schema["home_sequence"].dataType.elementType.names == ["goals_for"]
