import pytest
from conftest import SF
from helpers import make, match_row
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab.operators import canonical, features
from pairlab.plans import ledger, registry, report
from pairlab.sources import files, sinks


def test_partitioned_round_trip(spark, matches, tmp_path):
    out = str(tmp_path / "m")
    summary = {r.Division: r.row_count for r in sinks.write_canonical_partitions(matches, out).collect()}
    want = {r["Division"]: r["count"] for r in matches.groupBy("Division").count().collect()}
    assert summary == want
    back = files.read_canonical(spark, out)
    assert back.exceptAll(matches).count() == 0 and back.count() == matches.count()
    order = sinks.order_check(spark, out).collect()
    assert len(order) == 3 and all(r.out_of_order == 0 for r in order)


def test_large_divisions_are_cut(spark, matches, tmp_path):
    out = str(tmp_path / "m")
    sinks.write_canonical_partitions(matches, out, rows_per_file=20)
    written = sinks.order_check(spark, out).collect()
    assert len(written) > 3 and all(r.rows <= 20 and not r.out_of_order for r in written)
    assert files.read_canonical(spark, out).exceptAll(matches).count() == 0


def test_rewriting_one_division_keeps_the_others(spark, matches, tmp_path):
    out = str(tmp_path / "m")
    sinks.write_canonical_partitions(matches, out)
    sinks.write_canonical_partitions(matches.where("Division = 'N00'"), out)
    assert files.read_canonical(spark, out).count() == matches.count()


def test_unsafe_names_leave_no_output(spark, tmp_path):
    bad = make(spark, [match_row("2022-01-01", "a", "b", division="a/b")])
    with pytest.raises(S.ContractError, match="unsafe"):
        sinks.write_canonical_partitions(bad, str(tmp_path / "m"))
    assert not (tmp_path / "m").exists()


def test_view_and_parameters(spark, matches, tmp_path, capsys):
    out = str(tmp_path / "m")
    sinks.write_canonical_partitions(matches, out)
    got = files.query_canonical(
        spark, out, "SELECT count(*) AS n FROM matches WHERE Division = ? AND FTR = ?", ["N00", "H"]
    )
    want = matches.where("Division = 'N00' AND FTR = 'H'").count()
    assert got.first().n == want
    named = files.query_canonical(
        spark, out, "SELECT count(*) AS n FROM matches WHERE Division = :d", {"d": "N01"}
    )
    named.explain()
    assert "PartitionFilters: [isnotnull(Division" in capsys.readouterr().out
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.read_partitions(spark, str(tmp_path / "none"))


def test_features_from_parquet_and_sink(spark, matches, tmp_path):
    sinks.write_canonical_partitions(matches, str(tmp_path / "m"))
    table = features.build_feature_table_from_parquet(spark, str(tmp_path / "m"))
    sinks.write_feature_partitions(table, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == matches.count() and set(back.columns) == set(S.FEATURE_TABLE)


def test_reading_back_shuffles_no_rows(spark, matches, tmp_path, capsys):
    out = str(tmp_path / "m")
    sinks.write_canonical_partitions(matches, out)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the stored rows lay beyond it
    try:
        sinks.read_back(spark, out, S.CANONICAL_SCHEMA, matches.select("Division").distinct()).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stored_features_stages_the_table_once(spark, monkeypatch):
    staged = []

    def counted(df, *args):
        made = real(df, *args)
        if "EloDiff_pre" in df.columns:
            staged.append(made.count())
        return made

    real = sinks.durable
    monkeypatch.setattr(sinks, "durable", counted)
    monkeypatch.setattr(registry, "durable", counted)
    rows = {r.Division: r for r in registry.stored_features(spark, SF).collect()}
    assert staged == [sum(r.rows for r in rows.values()), rows["N03"].rows]
    assert all(r.kept == (d != "N03") for d, r in rows.items())


def test_differences_are_seen(spark, matches):
    changed = matches.withColumn("FTHome", F.coalesce(F.col("FTHome"), F.lit(0)) + 1)
    with pytest.raises(S.ContractError, match="rows differ"):
        sinks.verify(matches, changed)


def test_a_spoiled_file_is_found(spark, matches, tmp_path, monkeypatch):
    real = sinks.read_back

    def spoiled(*args):
        back = real(*args)
        return back.withColumn("FTHome", F.when(F.col("Division") == "N01", 9).otherwise(F.col("FTHome")))

    monkeypatch.setattr(sinks, "read_back", spoiled)
    with pytest.raises(S.ContractError, match=r"read-back rows differ.*N01'\]"):
        sinks.write_canonical_partitions(matches, str(tmp_path / "m"))
    monkeypatch.undo()
    row = sinks.write_canonical_partitions(matches, str(tmp_path / "m")).where("Division = 'N01'").first()
    assert row.path == f"{tmp_path}/m/Division=N01" and row.files >= 1
    assert row.input_rows == row.output_rows == matches.count()


def test_key_set_difference(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "k int, v string")
    for buckets in (1, 4096):
        got = {tuple(r) for r in sinks.key_set_difference(left, right, ["k", "v"], buckets).collect()}
        assert got == {(3, "c", False, True), (4, "d", True, False)}
    assert sinks.key_set_difference(left, left, ["k", "v"]).collect() == []
    twice = sinks.round_trip_differences(left, left.distinct())
    assert [tuple(r) for r in twice.collect()] == [(1, "a", 1)]


def test_order_check_counts_disorder(spark, matches, tmp_path):
    out = str(tmp_path / "m")
    matches.coalesce(1).sortWithinPartitions(F.col("MatchDate").desc()).write.parquet(out)
    assert sinks.order_check(spark, out).first().out_of_order > 0


def records(spark):
    rows = [
        ("x1", "d1", "f1", "development", 10, 1.0, 0.9),
        ("x1", "d1", "f2", "development", 20, 1.0, 0.95),
        ("x1", "d1", "f3", "development", 30, 1.0, 1.01),
        ("x1", "d1", "f4", "historical_final", 10, 1.0, 0.8),
    ]
    rows += [("x2", *r[1:5], r[5], r[6] + 0.2) for r in rows]
    df = spark.createDataFrame(
        rows, "c string, p string, fold string, fold_role string, n_samples bigint, baseline_log_loss double, candidate_log_loss double"
    ).withColumn("improvement_log_loss", F.col("baseline_log_loss") - F.col("candidate_log_loss"))
    return ledger.records_from_comparison(df, "c")


def test_ledger_round_trip(spark, tmp_path):
    made = records(spark)
    sinks.write_report(made, str(tmp_path / "l"))
    back = files.read_experiment_records(spark, str(tmp_path / "l"), lines=True)
    checked = ledger.validate_ledger(back)
    ranks = ledger.rank_by_improvement(checked).orderBy("rank").collect()
    assert [r.experiment_id for r in ranks] == ["experiment_x1", "experiment_x2"]
    first = checked.where("experiment_id = 'experiment_x1'").first()
    assert first.passed and first.improving_folds == 2
    with pytest.raises(S.ContractError, match="across populations"):
        ledger.rank_raw(checked)
    one_population = checked.withColumn("population_id", F.lit("p"))
    assert ledger.rank_raw(one_population).count() == 2
    assert ledger.summary(checked).count() == 2
    assert sinks.report_json(made).count() == 2


def test_spoiled_records_are_refused(spark, tmp_path):
    spoiled = records(spark).withColumn("verdict", F.lit("passed"))
    with pytest.raises(S.ContractError, match="verdict text differs"):
        ledger.validate_ledger(spoiled)
    (tmp_path / "bad.json").write_text('{"schema_version": ')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        files.read_experiment_records(spark, str(tmp_path)).collect()


def test_sorting(spark):
    rows = [match_row("2022-01-02", "a", "b"), match_row("2022-01-01", "c", "d")]
    got = canonical.sort_canonical(make(spark, rows)).collect()
    assert [r.HomeTeam for r in got] == ["c", "a"]
    broken = make(spark, rows).withColumn("HomeTeam", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="nulls"):
        canonical.sort_matches(broken).collect()


def test_report_documents(spark, tmp_path):
    rows = [
        (f"f{i}", role, m, 10 * (i + 1), 1.0 - 0.1 * (m == "b"), 0.5, 0.01)
        for i, role in enumerate(["development"] * 3 + ["historical_final"])
        for m in ("a", "b")
    ]
    folds = spark.createDataFrame(
        rows, "fold string, fold_role string, model string, n_samples bigint, log_loss double, brier_score double, ece double"
    )
    coverage = spark.range(1).selectExpr(
        "100L AS candidate_match_rows", "90L AS aligned_rows", "10L AS unmatched_match_keys", "0L AS unmatched_market_keys",
        "90D AS coverage_percentage",
    )
    made = report.assemble(folds, "x", "a", coverage)
    sinks.write_report(made, str(tmp_path / "r"))
    back = report.read_reports(spark, str(tmp_path / "r"))
    assert back.schema == report.document() and back.collect() == made.collect()
    got = {(r.fold, r.model): r for r in report.fold_rows(back).collect()}
    assert len(got) == 8 and got["f0", "b"].verdict == "passed" and got["f0", "a"].verdict is None
    for name, change in (
        ("u", made.withColumn("more", F.lit(1))),
        ("m", made.drop("coverage")),
        ("n", made.withColumn("coverage", F.struct("coverage.*", F.lit(1).alias("odd")))),
    ):
        sinks.write_report(change, str(tmp_path / name))
        with pytest.raises(S.ContractError, match="unknown fields"):
            report.read_reports(spark, str(tmp_path / name))
    wrong = made.withColumn("coverage", F.col("coverage").withField("aligned_rows", F.lit("many")))
    sinks.write_report(wrong, str(tmp_path / "w"))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|CONVERT|parse"):
        report.read_reports(spark, str(tmp_path / "w")).collect()
