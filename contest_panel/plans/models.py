"""Models over the example table: switch propensity and outcome."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from contest_panel.operators import crossfit, metrics, scaling
from contest_panel.operators.ranking import hashed_rank
from contest_panel.session import materialise, ship, stored

FEATURE_SETS = ("summary", "history", "full")
ITEM_LIMIT = 20_000


def item_words(dimension: DataFrame) -> list[str]:
    """Item ids as vocabulary words (a dimension of checked size)."""
    rows = dimension.select(F.col("id").cast("string")).limit(ITEM_LIMIT + 1).collect()
    if len(rows) > ITEM_LIMIT:
        raise ValueError(f"more than {ITEM_LIMIT} items in the dimension")
    return sorted(r[0] for r in rows)


def _battle_array() -> str:
    return "flatten(transform(history, x -> array(" + ", ".join(f"x.{f}" for f in scaling.MODEL_BATTLE_FEATURES) + ")))"


def with_inputs(
    scaled: DataFrame, names: Sequence[str], words: Sequence[str], feature_set: str = "full", action: str | None = None
) -> DataFrame:
    """Add ``features``: summary, flattened history and pooled deck counts, all JVM-side.

    With ``action`` the vector also holds the action and its products with the summary.
    """
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {FEATURE_SETS}")
    summary = "array(" + ", ".join(names) + ")"
    dense = [summary]
    if feature_set != "summary":
        levels = "transform(history, x -> aggregate(x.levels, 0D, (a, l) -> a + l) / size(x.levels))"
        dense += [_battle_array(), levels]
    if action:
        dense += [f"array(cast({action} AS double))", f"transform({summary}, s -> s * {action})"]
    staged = scaled.withColumn("__dense", array_to_vector(F.expr(f"concat({', '.join(dense)})")))
    if feature_set != "full":
        return staged.withColumnRenamed("__dense", "features")
    staged = staged.withColumn("__items", F.expr("cast(flatten(history.deck) AS array<string>)"))
    counter = CountVectorizerModel.from_vocabulary(list(words), inputCol="__items", outputCol="__counts")
    joined = VectorAssembler(inputCols=["__dense", "__counts"], outputCol="features").transform(counter.transform(staged))
    return joined.drop("__dense", "__items", "__counts")


def logistic(label: str, max_iterations: int = 25, penalty: float = 1e-3, intercept: bool = True) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=max_iterations, regParam=penalty, fitIntercept=intercept
    )


def probability(model, rows: DataFrame, name: str = "score") -> DataFrame:
    """Score rows with a fitted classifier, keeping only the positive-class probability."""
    scored = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction")


@dataclass(frozen=True)
class Fitted:
    """A classifier with the preprocessing fitted on the same training rows."""

    model: object
    constants: Mapping[str, DataFrame]
    names: tuple[str, ...]
    words: tuple[str, ...]
    feature_set: str
    action: str | None = None

    def inputs(self, examples: DataFrame) -> DataFrame:
        scaled = scaling.transform(examples, self.constants, self.names)
        return with_inputs(scaled, self.names, self.words, self.feature_set, self.action)

    def score(self, examples: DataFrame, name: str = "score") -> DataFrame:
        return probability(self.model, self.inputs(examples), name).drop("features")


def _local(stats: DataFrame) -> DataFrame:
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


#: Columns of the examples that the compact table keeps, as far as they are there.
CARRIED = ("example_id", "player_tag", "split", "fold", "next_switch", "next_win")


def design(examples: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raw model inputs in place of the history: :data:`CARRIED`, ``dense`` (summary, features and mean level of each contest),
    ``items``, and number, sum and squares of all levels. A compact table is returned as it is."""
    if "dense" in examples.columns:
        return examples
    carried = [c for c in CARRIED if c in examples.columns]
    # Arrays over the histories of a batch: functions on nested columns would walk every contest of every example alone.
    made = "dense array<double>, items array<bigint>, level_n bigint, level_sum double, level_squares double"
    schema = StructType([*[examples.schema[c] for c in carried], *StructType.fromDDL(made)])
    wanted = to_arrow_schema(schema)
    ship(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *_flat_history(batch.column(len(carried)), batch.columns[len(carried) + 1 :])], schema=wanted)

    return examples.select(*carried, "history", *[F.col(n).cast("double").alias(n) for n in names]).mapInArrow(run, schema)


def _flat_history(history: pa.ListArray, summary: Sequence[pa.Array]) -> list[pa.Array]:
    """Columns of :func:`design` behind the carried ones."""
    contests, size = history.flatten(), len(history)
    numbers = lambda column: column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    # NULL becomes NaN on the way to numpy.
    features = [np.isnan(numbers(contests.field("trophies"))) * 1.0 if f == "trophies_missing" else numbers(contests.field(f)) for f in scaling.MODEL_BATTLE_FEATURES]
    held = contests.field("levels")
    count = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values, at = numbers(held.flatten()), np.repeat(np.arange(len(contests)), count)
    added, squares = (np.bincount(at, weights=v, minlength=len(contests)) for v in (values, values * values))
    mean = np.divide(added, count, out=np.full(len(contests), np.nan), where=count > 0)
    dense = np.hstack([np.column_stack([numbers(c) for c in summary]), np.column_stack(features).reshape(size, -1), mean.reshape(size, -1)])
    of = np.repeat(np.arange(size), history.value_lengths().to_numpy(zero_copy_only=False))
    sums = [np.bincount(of, weights=v, minlength=size) for v in (count, added, squares)]
    decks = contests.field("deck")
    items = np.bincount(of, weights=decks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), minlength=size)
    ends = pa.array(np.arange(size + 1, dtype=np.int32) * dense.shape[1])
    return [
        pa.ListArray.from_arrays(ends, pa.array(dense.ravel(), from_pandas=True)),
        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(items)].astype(np.int32)), decks.flatten().cast(pa.int64())),
        pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:]),
    ]


def compact(examples: DataFrame, names: Sequence[str]) -> DataFrame:
    """:func:`design`, stored once (an action): fits and scores read a few numbers for each contest instead of histories."""
    return examples if "dense" in examples.columns else stored(design(examples, names))


def training_moments(training: DataFrame, fold: str | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By fold (one in all without): count, mean and squared deviations of the dense columns, and number, sum and squares of levels.

    Runs two actions.
    """
    rows = training.withColumn("fold", F.lit(0) if fold is None else F.col(fold).cast("int"))
    dense = crossfit.column_moments(rows)
    levels = rows.groupBy("fold").agg(*[F.sum(c).cast("double") for c in ("level_n", "level_sum", "level_squares")]).collect()
    return {r[0]: (dense[r[0]], np.array(r[1:], np.float64)) for r in levels}


def standard_columns(moments: Sequence[tuple[np.ndarray, np.ndarray]], names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shift and scale of every dense column, by the moments of all given folds together, as ``scaling.fit`` finds them.

    A feature without observations or without variance is an error.
    """
    if not moments:
        raise ValueError("no rows to fit on")
    total, levels = moments[0]
    for dense, more in moments[1:]:
        total, levels = crossfit.merged_moments(total, dense), levels + more
    k, kinds = len(names), len(scaling.MODEL_BATTLE_FEATURES)
    steps = (total.shape[1] - k) // (kinds + 1)
    shift, scale, flat = np.zeros(total.shape[1]), np.ones(total.shape[1]), []

    def use(feature: str, columns: np.ndarray, n: float, mean: float, square: float) -> None:
        sd = np.sqrt(max(square / n, 0.0)) if n else 0.0
        if not sd > 0:
            flat.append(feature)
            return
        shift[columns], scale[columns] = mean, 1 / sd

    for at, name in enumerate(names):
        use(name, np.array([at]), *total[:, at])
    for at, feature in enumerate(scaling.MODEL_BATTLE_FEATURES):
        if feature in scaling.CONTINUOUS and steps:
            columns = k + at + kinds * np.arange(steps)
            together = total[:, columns[0]]
            for c in columns[1:]:
                together = crossfit.merged_moments(together, total[:, c])
            use(feature, columns, *together)
    if steps:
        n, added, squares = levels
        mean = added / max(n, 1.0)
        use("level", k + kinds * steps + np.arange(steps), n, mean, squares - n * mean * mean)
    if flat:
        raise ValueError(f"features without variance in the fitting rows: {flat}")
    return shift, scale


@dataclass(frozen=True)
class FittedLogit:
    """A logistic model with its standardisation, both fitted on the same training rows."""

    model: crossfit.FoldModels
    names: tuple[str, ...]
    words: tuple[str, ...]
    feature_set: str
    action: str | None = None

    def score(self, examples: DataFrame, name: str = "score") -> DataFrame:
        """The columns :data:`CARRIED` of examples (or of their compact table) and the probability."""
        rows = design(examples, self.names)
        keep = [c for c in CARRIED if c in rows.columns]
        return crossfit.model_scores(self._acted(rows), [self.model], keep, [name])

    def _acted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("action", F.col(self.action)) if self.action else rows


def fit_model(
    examples: DataFrame,
    names: Sequence[str],
    words: Sequence[str],
    label: str = "next_switch",
    feature_set: str = "full",
    action: str | None = None,
    moments: Sequence[tuple[np.ndarray, np.ndarray]] | None = None,
) -> FittedLogit:
    """Fit preprocessing and classifier on the training split only, by Newton steps. Runs actions.

    Histories are read once: all passes go over their compact table. ``moments`` of the training rows may be handed over.
    """
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {FEATURE_SETS}")
    training = compact(examples, names).filter("split = 0")
    shift, scale = standard_columns(list(training_moments(training).values()) if moments is None else moments, names)
    wide = len(names) if feature_set == "summary" else len(shift)
    rows = training.select(F.lit(0).alias("fold"), F.col(label).alias("label"), "dense", "items", *([F.col(action).alias("action")] if action else []))
    known = [int(w) for w in words] if feature_set == "full" else []
    products = len(names) if action else 0
    if wide + len(known) + products + 2 > crossfit.WIDTH_LIMIT:
        model = _sparse_fit(rows, shift[:wide], scale[:wide], known, products)
    else:  # no row is in fold -1, so the one model sees all of them
        model = crossfit.fit_fold_models(rows, [-1], shift[None, :wide], scale[None, :wide], known, products=products)
    return FittedLogit(model, tuple(names), tuple(words), feature_set, action)


def _sparse_fit(rows: DataFrame, shift: np.ndarray, scale: np.ndarray, words: Sequence[int], products: int) -> crossfit.FoldModels:
    """The same model by Spark ML on sparse vectors, for more items than a Gram matrix takes. Runs actions."""
    words = sorted(words)
    plain = crossfit.FoldModels((-1,), shift[None], scale[None], np.array(words, np.int64), np.zeros((1, 1)), products=products)
    keep = ["label", "items", *(["action"] if products else [])]
    scaled = crossfit.scaled_rows(rows, plain, keep).withColumn("__items", F.col("items").cast("array<string>"))
    acted = f", array(cast(action AS double)), transform(slice(scaled, 1, {products}), s -> s * action)" if products else ""
    staged = scaled.withColumn("__dense", array_to_vector(F.expr(f"concat(scaled{acted})")))
    counter = CountVectorizerModel.from_vocabulary([str(w) for w in words], inputCol="__items", outputCol="__counts")
    joined = VectorAssembler(inputCols=["__dense", "__counts"], outputCol="features").transform(counter.transform(staged))
    found = logistic("label", max_iterations=500).setTol(1e-9).fit(joined.select("label", "features"))
    return replace(plain, weights=np.append(found.coefficients.toArray(), found.intercept)[None])


def cross_fitted_scores(
    examples: DataFrame, names: Sequence[str], words: Sequence[str], folds: int = 5, label: str = "next_switch"
) -> DataFrame:
    """Out-of-fold scores of the training rows: (example_id, player_tag, fold, label, score). Runs actions.

    Each fold is scored by a model, and standardised by constants, that never saw its participants. Constants of all folds
    come from one pass, and each pass of the fit moves all folds' models; all of them read the compact table.
    """
    training = compact(examples, names).filter("split = 0")
    moments = training_moments(training, "fold")
    columns = [standard_columns([m for other, m in moments.items() if other != fold], names) for fold in range(folds)]
    shift, scale = (np.array(x) for x in zip(*columns))
    rows = training.select("example_id", "player_tag", F.col("fold").cast("int").alias("fold"), F.col(label).alias("label"), "dense", "items")
    fitted = crossfit.fit_fold_models(rows, range(folds), shift, scale, [int(w) for w in words])
    return crossfit.own_fold_scores(rows, fitted, ["example_id", "player_tag", "fold", "label"])


def align_scores(examples: DataFrame, scores: DataFrame) -> DataFrame:
    """Put out-of-fold scores back on the example table (NULL outside training)."""
    return examples.join(scores.select("example_id", "score"), "example_id", "left")


def oof_cover(examples: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts behind "every training row scored once, nothing else scored"."""
    times = scores.groupBy("example_id").agg(F.expr("count(*) AS times"))
    joined = examples.select("example_id", "split").join(times, "example_id", "left")
    return joined.agg(
        F.expr("count_if(split = 0) AS training_rows"),
        F.expr("count_if(split = 0 AND times = 1) AS scored_once"),
        F.expr("count_if(split = 0 AND coalesce(times, 0) <> 1) AS wrong_times"),
        F.expr("count_if(split <> 0 AND times IS NOT NULL) AS scored_elsewhere"),
    )


def fit_outcome(examples: DataFrame, names: Sequence[str], words: Sequence[str]) -> FittedLogit:
    """P(win | context, observed action)."""
    return fit_model(examples, names, words, label="next_win", action="next_switch")


def compare_actions(fitted: FittedLogit, contexts: DataFrame, key: str = "player_tag") -> DataFrame:
    """Win probability of each context under stay and under switch, from one pass; no recommendation."""
    names = ["stay_win_probability", "switch_win_probability"]
    both = crossfit.model_scores(design(contexts, fitted.names), [fitted.model] * 2, [key], names, [0.0, 1.0])
    return both.selectExpr(key, *names, "switch_win_probability - stay_win_probability AS switch_minus_stay")


def ablation(examples: DataFrame, names: Sequence[str], words: Sequence[str], label: str = "next_switch") -> DataFrame:
    """Three nested inputs on the same participant split: metrics per input and held-out split."""
    rows = compact(examples, names)
    moments = list(training_moments(rows.filter("split = 0")).values())
    fitted = [fit_model(rows, names, words, label, feature_set, moments=moments) for feature_set in FEATURE_SETS]
    scored = crossfit.model_scores(rows.filter("split <> 0"), [f.model for f in fitted], ["split", label], FEATURE_SETS)
    heads = ", ".join(f"named_struct('head', '{h}', 'score', {h})" for h in FEATURE_SETS)
    everything = scored.selectExpr("split", f"{label} AS label", f"inline(array({heads}))")
    return metrics.full_metrics(stored(everything), ["head", "split"])


#: Hidden layers of the heads compared by capacity; none is the linear head.
CAPACITIES = {"linear": (), "small": (8,), "large": (32, 16)}


def capacity_ablation(
    examples: DataFrame, names: Sequence[str], words: Sequence[str], label: str = "next_switch", seeds: Sequence[int] = (0, 1)
) -> DataFrame:
    """Heads of growing capacity on the same inputs: mean and deviation over seeds against the linear head.

    Columns: head, metric, baseline, baseline_sd, candidate, candidate_sd, difference, examples (held-out rows of a
    run). Inputs are prepared and stored once; each head and seed is one distributed fit.
    """
    raw = compact(examples, names)
    shift, scale = standard_columns(list(training_moments(raw.filter("split = 0")).values()), names)
    width = len(shift)
    plain = crossfit.FoldModels((-1,), shift[None], scale[None], np.zeros(0, np.int64), np.zeros((1, width + 1)))
    inputs = stored(crossfit.scaled_rows(raw.withColumn("label", F.col(label).cast("double")), plain, ["split", "label"]))
    rows = inputs.select("split", "label", array_to_vector("scaled").alias("features"))
    training, held_out = rows.filter("split = 0"), rows.filter("split <> 0")
    runs = []
    for head, hidden in CAPACITIES.items():
        for seed in seeds:
            if hidden:
                fitter = MultilayerPerceptronClassifier(labelCol="label", layers=[width, *hidden, 2], maxIter=30, seed=seed, blockSize=256)
            else:
                fitter = logistic("label")
            scored = probability(fitter.fit(training), held_out).select(F.col("label").cast("int").alias("label"), "score")
            runs.append(metrics.binary_metrics(scored).select(F.lit(head).alias("head"), F.lit(seed).alias("seed"), "examples", "log_loss", "brier_score", "accuracy"))
    table = runs[0]
    for run in runs[1:]:
        table = table.unionByName(run)
    table = materialise(table)
    each = ", ".join(f"named_struct('metric', '{m}', 'value', {m})" for m in ("log_loss", "brier_score", "accuracy"))
    lines = table.selectExpr("head", "examples", f"inline(array({each}))")
    base = metrics.run_aggregate(lines.filter("head = 'linear'"))
    compared = None
    for head in list(CAPACITIES)[1:]:
        part = metrics.run_compare(base, metrics.run_aggregate(lines.filter(F.col("head") == head))).withColumn("head", F.lit(head))
        compared = part if compared is None else compared.unionByName(part)
    return compared.join(table.groupBy("head").agg(F.max("examples").alias("examples")), "head")


def permutation_importance(
    fitted: FittedLogit, examples: DataFrame, features: Sequence[str], label: str = "next_switch", seed: int = 0
) -> DataFrame:
    """Rise in log loss on held-out rows when one summary feature is shuffled among them. Runs an action.

    The shuffle joins two seeded orders of the same rows on their rank: distributed, no repeated keys. Rows are scored once: a summary
    feature enters the log-odds once, so moving it adds its weight times the difference to the donor's value.
    """
    held_out = design(examples, fitted.names).filter("split = 2").withColumn("label", F.col(label))
    scored = crossfit.scaled_rows(held_out, fitted.model, ["example_id", "label"], logit=True)
    rows = stored(scored.withColumn("scaled", F.slice("scaled", 1, len(fitted.names))))
    # One order of values serves every feature: all of them move together with their donor row.
    donors = hashed_rank(rows.select("example_id", F.col("scaled").alias("given")), ["example_id"], f"{seed}-values", name="__place")
    paired = hashed_rank(rows, ["example_id"], f"{seed}-rows", name="__place").join(donors.select("__place", "given"), "__place")
    place = {f: fitted.names.index(f) for f in features}
    moved = [f"named_struct('feature', '{f}', 'logit', logit + {float(fitted.model.weights[0][i])!r}D * (given[{i}] - scaled[{i}]))" for f, i in place.items()]
    lines = paired.selectExpr("label", f"inline(array(named_struct('feature', 'none', 'logit', logit), {', '.join(moved)}))")
    losses = metrics.binary_metrics(lines.selectExpr("feature", "label", "1 / (1 + exp(-logit)) AS score"), ["feature"]).select("feature", "log_loss")
    found = stored(losses)
    unshuffled = found.filter("feature = 'none'").select("log_loss").scalar()
    return found.filter("feature <> 'none'").select("feature", "log_loss", (F.col("log_loss") - unshuffled).alias("increase"))


def save_fitted(fitted: FittedLogit, spark: SparkSession, path: str) -> None:
    """Store the classifier with its preprocessing as one settings row."""
    model = fitted.model
    arrays = {name: getattr(model, name).tolist() for name in ("shift", "scale", "words", "weights")}
    settings = {
        "names": fitted.names, "words": fitted.words, "feature_set": fitted.feature_set, "action": fitted.action,
        "model": {"folds": model.folds, "products": model.products, **arrays},
    }
    spark.createDataFrame([(json.dumps(settings),)], "settings string").write.mode("overwrite").parquet(f"{path}/settings")


def load_fitted(spark: SparkSession, path: str) -> FittedLogit:
    """Inverse of :func:`save_fitted`; the stored feature names fix the input order."""
    settings = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    model = settings["model"]
    arrays = [np.array(model[name], np.int64 if name == "words" else np.float64) for name in ("shift", "scale", "words", "weights")]
    return FittedLogit(
        crossfit.FoldModels(tuple(model["folds"]), *arrays, products=model["products"]),
        tuple(settings["names"]), tuple(settings["words"]), settings["feature_set"], settings["action"],
    )
