"""Model plans on small tables."""

import pytest
from pyspark.sql import functions as F

from contest_panel.operators import dimension, quality, scaling, sequences
from contest_panel.operators.assign import cell_sample, require_full_cells
from contest_panel.plans import dataset, fixtures as fx, models
from contest_panel.session import materialise

NINE = sequences.SUMMARY_SETS["current_deck_count"]


@pytest.fixture(scope="module")
def stored(spark, parsed):
    return dataset.stored_focal(parsed, fx.card_dimension(spark))


@pytest.fixture(scope="module")
def table(stored):
    return materialise(dataset.sequence_dataset(stored))


@pytest.fixture(scope="module")
def words(spark):
    return models.item_words(fx.card_dimension(spark))


def test_table_is_sound(table):
    quality.assert_empty(quality.split_leaks(table), "leak")
    rules = quality.fold_rules(table).first().asDict()
    assert rules["folds_outside_training"] == rules["training_without_fold"] == rules["uncovered_folds"] == 0
    assert {r["split"] for r in table.select("split").distinct().collect()} == {0, 1, 2}


def test_fold_constants_equal_a_refit(table):
    per_fold = scaling.fit_per_fold(table, "battle").collect()
    for fold in (0, 3):
        alone = {r["feature"]: r for r in scaling.fit(table.filter(F.col("fold") != fold), "battle").collect()}
        for r in per_fold:
            if r["fold"] == fold:
                assert r["n"] == alone[r["feature"]]["n"]
                assert r["mean"] == pytest.approx(alone[r["feature"]]["mean"], rel=1e-9)
                assert r["sd"] == pytest.approx(alone[r["feature"]]["sd"], rel=1e-9)


def test_constant_feature_is_an_error(table):
    flat = table.withColumn("log1p_current_deck_tenure", F.lit(1.0))
    with pytest.raises(ValueError, match="tenure"):
        scaling.check_fit(scaling.fit(flat, "summary", NINE))


def test_scaled_training_rows_are_standard(table):
    training = table.filter("split = 0")
    fitted = {kind: scaling.fit(training, kind, NINE) for kind in ("level", "battle", "summary")}
    scaled = scaling.transform(training, fitted, NINE).select(F.expr("inline(history)"))
    row = scaled.agg(
        F.avg("crown_difference").alias("m"), F.stddev_pop("crown_difference").alias("s"), F.max("trophies_missing").alias("f"),
        F.max(F.when(F.col("trophies_missing") == 1, F.abs("trophies"))).alias("t"),
    ).first()
    assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1) and row["f"] == 1.0 and row["t"] == 0.0


def test_out_of_fold_scores(table, words):
    scores = materialise(models.cross_fitted_scores(table, NINE, words))
    cover = models.oof_cover(table, scores).first()
    assert cover["training_rows"] == cover["scored_once"] > 0
    assert cover["wrong_times"] == cover["scored_elsewhere"] == 0
    aligned = models.align_scores(table, scores)
    rules = quality.fold_rules(aligned, 5, "score").first()
    assert rules["training_without_score"] == rules["scores_outside_training"] == 0


def test_cross_fit_equals_separate_fits(spark, table, words):
    """Same scores as one MLlib fit per fold on the same inputs, in a handful of jobs."""
    from contest_panel.operators.scaling import check_fit, fit_per_fold

    table.count()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs(None))
    scores = materialise(models.cross_fitted_scores(table, NINE, words))
    assert len(jobs(None)) - before <= 40
    got = {r["example_id"]: r for r in scores.collect()}
    training = table.filter("split = 0")
    per_fold = {kind: check_fit(fit_per_fold(training, kind, NINE)) for kind in ("level", "battle", "summary")}
    for fold in (3,):
        constants = {k: models._local(s.filter(F.col("fold") == fold).drop("fold")) for k, s in per_fold.items()}
        shell = models.Fitted(None, constants, NINE, tuple(words), "full")
        fitter = models.logistic("next_switch", max_iterations=500).setTol(1e-12)
        model = fitter.fit(shell.inputs(training.filter(F.col("fold") != fold)))
        alone = models.Fitted(model, constants, NINE, tuple(words), "full").score(training.filter(F.col("fold") == fold))
        rows = alone.select("example_id", "score").collect()
        assert rows and all(got[r["example_id"]]["fold"] == fold for r in rows)
        assert max(abs(got[r["example_id"]]["score"] - r["score"]) for r in rows) < 1e-3


def test_planted_signal_is_found(table, words):
    planted = table.withColumn("next_switch", (F.col("historical_switch_rate") > 0.55).cast("int"))
    fitted = models.fit_model(planted, NINE, words, feature_set="summary")
    from contest_panel.operators.metrics import full_metrics

    scored = fitted.score(planted.filter("split <> 0")).select(F.col("next_switch").alias("label"), "score")
    assert full_metrics(scored).first()["roc_auc"] > 0.9


def test_outcome_model_and_store(spark, table, stored, words, tmp_path):
    fitted = models.fit_outcome(table, NINE, words)
    contexts = materialise(sequences.prebattle_contexts(stored, continuity="all"))
    compared = {r["player_tag"]: r for r in models.compare_actions(fitted, contexts).collect()}
    assert len(compared) == contexts.count()
    for r in compared.values():
        assert 0 <= r["stay_win_probability"] <= 1
        assert r["switch_minus_stay"] == pytest.approx(r["switch_win_probability"] - r["stay_win_probability"])
    models.save_fitted(fitted, spark, str(tmp_path / "m"))
    again = models.compare_actions(models.load_fitted(spark, str(tmp_path / "m")), contexts)
    for r in again.collect():
        assert r["stay_win_probability"] == pytest.approx(compared[r["player_tag"]]["stay_win_probability"])


def test_compact_constants_equal_the_fitted_ones(table):
    """Moments of the compact table give what a pass over all histories gives, for all rows and without a fold."""
    rows = models.compact(table, NINE).filter("split = 0")
    moments = models.training_moments(rows, "fold")
    for left_out in (None, 3):
        shift, scale = models.standard_columns([m for f, m in moments.items() if f != left_out], NINE)
        training = table.filter("split = 0") if left_out is None else table.filter(f"split = 0 AND fold <> {left_out}")
        found = {r["feature"]: r for kind in ("level", "battle", "summary") for r in scaling.fit(training, kind, NINE).collect()}
        places = {n: i for i, n in enumerate(NINE)} | {f: 9 + i for i, f in enumerate(scaling.MODEL_BATTLE_FEATURES) if f in scaling.CONTINUOUS} | {"level": len(shift) - 1}
        for feature, at in places.items():
            assert shift[at] == pytest.approx(found[feature]["mean"], rel=1e-9) and 1 / scale[at] == pytest.approx(found[feature]["sd"], rel=1e-9)


def test_fits_read_histories_once_and_equal_spark_ml(spark, table, words, monkeypatch):
    """A fit takes the compact table, as does a score; beyond the Gram matrix's width Spark ML fits the same model."""
    rows = models.compact(table, NINE)
    assert "history" not in rows.columns
    newton = models.fit_model(rows, NINE, words, label="next_win", action="next_switch")
    monkeypatch.setattr(models.crossfit, "WIDTH_LIMIT", 50)
    sparse = models.fit_model(rows, NINE, words, label="next_win", action="next_switch")
    one, other = ({r["example_id"]: r["score"] for r in f.score(table).collect()} for f in (newton, sparse))
    assert one.keys() == other.keys() and max(abs(one[k] - other[k]) for k in one) < 1e-3


def test_importance_equals_a_score_of_moved_rows(spark, table, words):
    from contest_panel.operators.ranking import hashed_rank

    fitted = models.fit_model(table, NINE, words)
    feature = NINE[0]
    found = {r["feature"]: r for r in models.permutation_importance(fitted, table, NINE).collect()}
    assert set(found) == set(NINE)
    held = table.filter("split = 2")
    left = hashed_rank(held, ["example_id"], "0-rows", name="place")
    given = hashed_rank(held.select("example_id", F.col(feature).alias("given")), ["example_id"], "0-values", name="place").select("place", "given")
    moved = left.join(given, "place").withColumn(feature, F.col("given")).select(*held.columns)
    from contest_panel.operators.metrics import binary_metrics

    loss = lambda rows: binary_metrics(fitted.score(rows).select(F.col("next_switch").alias("label"), "score")).first()["log_loss"]
    assert found[feature]["log_loss"] == pytest.approx(loss(moved), rel=1e-9)
    assert found[feature]["increase"] == pytest.approx(loss(moved) - loss(held), abs=1e-9)


def test_cell_sample(table):
    sample = cell_sample(table, 1)
    require_full_cells(sample, 1, sample.select("next_switch", "next_win").distinct().count())
    assert sample.select("player_tag").distinct().count() == sample.count()
    with pytest.raises(ValueError):
        require_full_cells(sample, 1_000)
