"""Scaling, logistic and Poisson fits, and the experiment protocol."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab import schema as S
from pairlab import session
from pairlab.models import classify, goals
from pairlab.operators import features, scaling
from pairlab.plans import experiments, ledger
from pairlab.session import durable

COLUMNS = ("aa_pre", "cc_pre")


@pytest.mark.parametrize("digits", [3, 15])
def test_exact_stats(spark, digits):
    rng = np.random.default_rng(3)
    data = []
    for season in (1, 2, 5):
        values = rng.normal(size=(501 + season, 2)).round(digits)
        for i, (x, y) in enumerate(values):
            data.append((season, None if i % 5 == 0 else float(x), 1e6 + float(y), 4.0, None, -0.0 if i % 2 else 0.0))
    df = spark.createDataFrame(data, "SeasonStartYear bigint, a double, b double, c double, d double, e double")
    folds = {"f": 2, "g": 5, "h": 6}
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 1.0)], df.schema)).repartition(7)
    got = {(r.fold, r.feature): r for r in scaling.column_stats(df, list("abcde"), folds).collect()}
    each = {r.fold: r for r in scaling.column_stats(df, ["a"]).collect()}
    assert each.keys() == {"1", "2", "5"} and each["1"].median == got["f", "a"].median
    for fold, year in folds.items():
        for i, c in enumerate("ab", start=1):
            x = np.array([np.nan if r[i] is None else r[i] for r in data if r[0] < year])
            median = np.nanmedian(x)
            filled = np.where(np.isnan(x), median, x)
            row = got[fold, c]
            assert row.median == median
            assert row["mean"] == pytest.approx(filled.mean(), rel=1e-14, abs=1e-12)
            assert row.scale == pytest.approx(filled.std(), rel=1e-8)
            assert (row["rows"], row.present) == (len(x), np.isfinite(x).sum())
        assert got[fold, "c"].scale == 1.0 and got[fold, "c"].median == 4.0
        assert got[fold, "e"].scale == 1.0 and got[fold, "e"].median == 0.0
        empty = got[fold, "d"]
        assert (empty.present, empty.median, empty["mean"], empty.scale) == (0, 0.0, 0.0, 1.0)


def test_bits_keep_the_order():
    values = np.array([-np.inf, -1e300, -2.5, -1e-320, -0.0, 0.0, 1e-320, 1.0, 2.5, 1e300, np.inf])
    bits = scaling.ordered_bits(values)
    assert (bits[:-1] < bits[1:]).all()


def softmax_fit(x, y, n_classes=3):
    """Newton's method on mean log loss + |w|^2 / (2n) with free intercepts."""
    n, d = x.shape
    x1 = np.c_[x, np.ones(n)]
    w = np.zeros((n_classes, d + 1))
    penalty = np.r_[np.ones(d), 0.0]
    onehot = np.eye(n_classes)[y]
    for _ in range(60):
        z = x1 @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - onehot).T @ x1 + w * penalty) / n
        h = np.zeros((n_classes * (d + 1),) * 2)
        for a in range(n_classes):
            for b in range(n_classes):
                weight = p[:, a] * ((a == b) - p[:, b])
                block = (x1 * weight[:, None]).T @ x1
                if a == b:
                    block = block + np.diag(penalty)
                h[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] = block / n
        w -= np.linalg.lstsq(h, g.ravel(), rcond=None)[0].reshape(w.shape)
    return p


def test_logistic_equals_newton(spark, monkeypatch):
    monkeypatch.setattr(classify, "TOLERANCE", 1e-12)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = np.argmax(x @ rng.normal(size=(2, 3)) + rng.gumbel(size=(300, 3)), axis=1)
    rows = [(int(i), float(a), float(b), S.CLASSES[c]) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "i int, aa_pre double, cc_pre double, target_1x2 string")
    stats = {c: (0.0, 0.0, 1.0) for c in COLUMNS}
    df = df.withColumn("part", F.lit("train"))
    made = classify.build_design(df, COLUMNS, stats)
    model = classify.fit_logistic(made, COLUMNS, contract=COLUMNS)
    keyed = df.select(
        "*",
        *[F.lit("x").alias(c) for c in ("fold", "fold_role", "Division", "HomeTeam", "AwayTeam")],
        F.lit(1).alias("test_year"),
        F.current_date().alias("MatchDate"),
    )
    keyed = keyed.withColumn("HomeTeam", F.lpad(F.col("i").cast("string"), 4, "0"))
    got = np.array(
        [[r[p] for p in S.PROBABILITIES] for r in model.predict(keyed).orderBy("HomeTeam").collect()]
    )
    assert np.abs(got - softmax_fit(x, y)).max() < 1e-5
    assert classify.fitted_state([model]).count() == 2
    with pytest.raises(S.ContractError, match="H, D and A"):
        classify.build_design(df.where("target_1x2 <> 'D'"), COLUMNS, stats)
    with pytest.raises(S.LeakageError):
        classify.fit_logistic(classify.build_design(df, ("i",), {"i": (0.0, 0.0, 1.0)}), ("i",))
    with pytest.raises(S.LeakageError, match="outside the contract"):
        classify.fit_logistic(made, COLUMNS)
    half = classify.fit_logistic(made, COLUMNS[1:], contract=COLUMNS)
    alone = classify.fit_logistic(classify.build_design(df, COLUMNS[1:], stats), COLUMNS[1:], contract=COLUMNS)
    assert np.allclose(half.model.coefficientMatrix.toArray(), alone.model.coefficientMatrix.toArray(), atol=1e-9)
    endless = df.withColumn("aa_pre", F.lit(float("inf")))
    with pytest.raises(Exception, match="not finite"):
        classify.build_design(endless, COLUMNS, stats)


def test_logistic_takes_few_passes_on_correlated_inputs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 1)) + rng.normal(size=(3000, 2)) * [1e-3, 1.0]
    y = np.argmax(np.c_[x[:, 0], -x[:, 1], 0 * x[:, 0]] + rng.gumbel(size=(3000, 3)), axis=1)
    rows = [(float(a), float(b), S.CLASSES[c]) for (a, b), c in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "aa_pre double, cc_pre double, target_1x2 string").withColumn("part", F.lit("train"))
    model = classify.fit_logistic(classify.build_design(df, COLUMNS, {c: (0.0, 0.0, 1.0) for c in COLUMNS}), COLUMNS, contract=COLUMNS)
    assert model.iterations <= 10
    assert max(r.gradient for r in classify.score_equations(model).collect()) < 1e-9
    with pytest.raises(RuntimeError, match="no convergence"):
        classify.fit_logistic(model.design, COLUMNS, contract=COLUMNS, max_iterations=2)


def test_goals_model_recovers_its_parameters(spark):
    rng = np.random.default_rng(9)
    sot, off = rng.integers(0, 9, 4000), rng.integers(0, 9, 4000)
    y = rng.poisson(np.exp(-0.4 + 0.15 * sot + 0.02 * off))
    df = spark.createDataFrame(
        [tuple(map(int, r)) for r in zip(y, sot, off, strict=True)], "goals int, sot int, off int"
    ).withColumn("n", F.lit(1))
    beta = np.zeros(3)
    x = np.c_[np.ones(4000), sot, off]
    for _ in range(50):
        mu = np.exp(x @ beta)
        beta += np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu))
    assert goals.fit_goals(df) == pytest.approx(tuple(beta), abs=1e-4)


@pytest.fixture(scope="module")
def some(tables):
    return durable(tables.canonical.where("Division < 'N06'"))


def test_walk_forward_models_do_not_see_their_season(some):
    base = {r.SeasonStartYear: r for r in goals.walk_forward_coefficients(some).collect()}
    assert min(base) > some.agg(F.min("SeasonStartYear")).first()[0]
    changed = some.withColumn(
        "FTHome", F.when(F.col("SeasonStartYear") >= 1999, F.lit(7)).otherwise(F.col("FTHome"))
    )
    again = {r.SeasonStartYear: r for r in goals.walk_forward_coefficients(changed).collect()}
    assert all(base[y] == again[y] for y in base if y <= 1999)
    assert base[2000] != again[2000]


@pytest.fixture(scope="module")
def outcome(some):
    table = durable(features.build_feature_table(some))
    return table, experiments.backtest(table, (1999, 2000, 2001), 2001)


def test_backtest(outcome):
    table, out = outcome
    rows = {(r.fold, r.model): r for r in out.fold_metrics.collect()}
    assert len(rows) == 9
    assert all(r.log_loss == pytest.approx(np.log(3)) for (f, m), r in rows.items() if m == "uniform")
    assert {r.view for r in out.views().collect()} == {
        "development",
        "historical_final",
        "all_historical_diagnostic",
    }
    report = experiments.fold_report(out, table, (1999, 2000, 2001), 2001)
    assert report.count() == 9 and report.where("train_end_date >= test_start_date").count() == 0


def test_final_rows_never_change_development_numbers(outcome):
    table, out = outcome
    spoiled = table.withColumn(
        "HomeElo_pre",
        F.when(F.col("SeasonStartYear") == 2001, 9.0).otherwise(F.col("HomeElo_pre")),
    )
    again = experiments.backtest(spoiled, (1999, 2000, 2001), 2001)
    where = "model = 'base52' AND fold_role = 'development'"

    def values(o):
        return sorted((r.fold, round(r.log_loss, 9)) for r in o.fold_metrics.where(where).collect())

    assert values(out) == values(again)


def test_market_comparison(outcome, tables):
    _, out = outcome
    per_fold, views = experiments.compare_with_market(out, tables.market)
    row = per_fold.where("model = 'base52'").first()
    assert 0 < row.aligned_rows < row.candidate_test_rows
    market = per_fold.where(f"model = 'market' AND fold = '{row.fold}'").first()
    assert row.market_advantage_log_loss == pytest.approx(row.log_loss - market.log_loss)
    assert views.where("view = 'development'").count() == 5


def test_candidate_and_ledger(outcome, some):
    table, _ = outcome
    noise = table.select(*S.KEY, F.lit(0.0).alias("extra_pre"))
    out = experiments.compare_candidate(table, noise, ["extra_pre"], "noise", (1998, 1999, 2000, 2001), 2001)
    gate = out.gate().first()
    assert not gate.passed and abs(gate.candidate_improvement_log_loss) < 1e-4
    checked = ledger.validate_ledger(experiments.experiment_records(out))
    assert checked.first().verdict == "failed"
    with pytest.raises(Exception, match="no candidate features"):
        experiments.join_candidate(table, noise.limit(3), ["extra_pre"]).collect()


def test_networks_stop_by_the_held_back_dates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = np.argmax(x @ np.array([[2.0, 0.0, -2.0], [0.0, 1.5, 0.0]]) + rng.gumbel(size=(400, 3)), axis=1)
    rows = [(int(i % 40), float(a), float(b), S.CLASSES[c]) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "d int, aa_pre double, cc_pre double, target_1x2 string")
    df = df.withColumn("MatchDate", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    stats = {c: (0.0, 0.0, 1.0) for c in COLUMNS}
    made = classify.build_design(df.withColumn("part", F.lit("train")), COLUMNS, stats)
    model = classify.fit_network(made, COLUMNS, "mlp_64", contract=COLUMNS)
    assert 0 < model.iterations < classify.MAX_ITERATIONS and model.rows == 400
    with pytest.raises(RuntimeError, match="held-back loss"):
        classify.fit_network(made, COLUMNS, "mlp_64", contract=COLUMNS, max_iterations=0)


def test_networks_do_not_depend_on_how_rows_meet_tasks(spark, monkeypatch):
    monkeypatch.setattr(classify, "SHARD_ROWS", 300)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = np.argmax(x @ np.array([[2.0, 0.0, -2.0], [0.0, 1.5, 0.0]]) + rng.gumbel(size=(3000, 3)), axis=1)
    rows = [(int(i % 50), float(a), float(b), S.CLASSES[c]) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "d int, aa_pre double, cc_pre double, target_1x2 string")
    df = df.withColumn("MatchDate", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    df = df.withColumn("part", F.lit("train"))
    stats = {c: (0.0, 0.0, 1.0) for c in COLUMNS}
    fits = []
    for parts in (1, 5):
        made = classify.build_design(df.repartition(parts), COLUMNS, stats)
        fits.append(classify.fit_network(made, COLUMNS, "mlp_64", contract=COLUMNS))
    assert fits[0].iterations == fits[1].iterations
    assert np.array_equal(fits[0].model.weights.toArray(), fits[1].model.weights.toArray())
    held = made.features("train", COLUMNS)
    # the loss of the model the labels were drawn from
    z = x @ np.array([[2.0, 0.0, -2.0], [0.0, 1.5, 0.0]])
    known = np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])
    assert classify._mean_loss(fits[0].model, held) < known + 0.02

def test_networks_are_recomputed_as_matrices(spark):
    rng = np.random.default_rng(6)
    sizes = [40, 128, 64, 3]
    flat = rng.normal(size=sum(a * b + b for a, b in zip(sizes, sizes[1:]))) / 4
    names = tuple(f"c{i}_pre" for i in range(sizes[0]))
    keyed = [F.lit("x").alias(c) for c in ("fold_role", "Division", "AwayTeam")]
    df = spark.range(4000).select(
        *[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(names)],
        *keyed,
        F.lit("f").alias("fold"),
        F.lit(1).alias("test_year"),
        F.current_date().alias("MatchDate"),
        F.col("id").cast("string").alias("HomeTeam"),
        F.element_at(F.array(*[F.lit(c) for c in S.CLASSES]), (F.col("id") % 3 + 1).cast("int")).alias("target_1x2"),
        F.when(F.col("id") < 10, "train").otherwise("test").alias("part"),
    )
    made = classify.build_design(df, names, {c: (0.0, 0.0, 1.0) for c in names}, "f")
    model = classify.FittedModel("mlp_128_64", made, names, classify.Network(flat, sizes), 1)
    again = classify.recomputed_networks([model], classify.layer_table([model]))
    row = classify.recomputed_gap(model.predict_test(), again).first()
    assert row.rows == 3990 and row.gap < 1e-12
    # units are no expressions evaluated weight by weight
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "sequence(0" not in plan


def test_folds_and_models_share_the_passes_over_one_table(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 2))
    y = np.argmax(x @ rng.normal(size=(2, 3)) / 3 + rng.gumbel(size=(2000, 3)), axis=1)
    rows = [
        (f"t{i}", 2000 + i % 5, None if i % 7 == 0 else float(a), float(b), S.CLASSES[c])
        for i, ((a, b), c) in enumerate(zip(x, y, strict=True))
    ]
    df = spark.createDataFrame(rows, "HomeTeam string, SeasonStartYear bigint, aa_pre double, cc_pre double, target_1x2 string")
    for c in S.METADATA:
        if c not in df.columns:
            df = df.withColumn(c, F.current_date() if c == "MatchDate" else F.lit("x"))
    table = durable(df)
    specs = [experiments.Spec("both", COLUMNS), experiments.Spec("one", COLUMNS[1:])]
    stored = len(session._MADE[spark.sparkContext.applicationId])
    passes = []
    swept = classify._swept
    monkeypatch.setattr(classify, "_swept", lambda *a: passes.append(1) or swept(*a))
    stats = classify.fold_stats(table, COLUMNS, (2002, 2004))
    counted = len(session._MADE[spark.sparkContext.applicationId])
    predictions, models = experiments.run_models(table, specs, (2002, 2004), 2004, stats, COLUMNS)
    # no fold keeps rows of its own, and four fits take the passes of the slowest
    assert len(session._MADE[spark.sparkContext.applicationId]) == counted >= stored
    assert [(m.fold[-4:], m.name) for m in models] == [("2002", "both"), ("2002", "one"), ("2004", "both"), ("2004", "one")]
    assert len(passes) == max(m.iterations for m in models) <= 10
    for m in models:
        part = F.when(F.col("SeasonStartYear") < int(m.fold[-4:]), "train").otherwise("test")
        own = table.where(F.col("SeasonStartYear") <= int(m.fold[-4:])).withColumn("part", part)
        alone = classify.fit_logistic(classify.build_design(own, COLUMNS, stats[m.fold]), m.columns, contract=COLUMNS)
        assert np.allclose(m.model.weights, alone.model.weights, atol=1e-6)
        assert max(r.gradient for r in classify.score_equations(m).collect()) < 1e-6
        again = classify.recomputed_logistic([m], classify.coefficient_table([m]))
        mine = predictions.where((F.col("fold") == m.fold) & (F.col("model") == m.name))
        row = classify.recomputed_gap(mine, again).first()
        assert row.rows == 400 and row.gap < 1e-12


def test_networks_of_a_fold_share_their_stored_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    y = np.argmax(x @ np.array([[2.0, 0.0, -2.0], [0.0, 1.5, 0.0]]) + rng.gumbel(size=(600, 3)), axis=1)
    rows = [(int(i % 40), float(a), float(b), S.CLASSES[c]) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "d int, aa_pre double, cc_pre double, target_1x2 string")
    df = df.withColumn("MatchDate", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).withColumn("part", F.lit("train"))
    made = classify.build_design(df, COLUMNS, {c: (0.0, 0.0, 1.0) for c in COLUMNS})
    tables = session._MADE[spark.sparkContext.applicationId]
    before = len(tables)
    experiments.side_by_side(lambda name: classify.fit_network(made, COLUMNS, name, contract=COLUMNS), list(classify.LAYERS))
    assert len(tables) == before + 1
