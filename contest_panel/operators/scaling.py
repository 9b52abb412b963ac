"""Train-only standardisation, optionally refit per held-out fold.

Levels in the history are displayed levels. Statistics come from one aggregation; the fitted table has one row per fold (one in all without
folds), so it is joined by broadcast. Undefined values are NULL and skipped by the moments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from contest_panel.operators.sequences import BATTLE_FEATURES

CONTINUOUS = ("crown_difference", "switch_magnitude", "log1p_time_gap_hours", "trophies")
MODEL_BATTLE_FEATURES = BATTLE_FEATURES + ("trophies_missing",)


def _observations(examples: DataFrame, kind: str, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Long or flat observations of a feature family, keeping ``split`` and ``fold``."""
    carried = [c for c in ("split", "fold") if c in examples.columns]
    if kind == "level":
        return examples.selectExpr(*carried, "explode(flatten(history.levels)) AS level"), ["level"]
    if kind == "battle":
        return examples.selectExpr(*carried, "inline(history)").select(*carried, *CONTINUOUS), list(CONTINUOUS)
    if kind == "summary":
        return examples.select(*carried, *names), list(names)
    raise ValueError("kind must be level, battle or summary")


def fit(examples: DataFrame, kind: str, names: Sequence[str] = ()) -> DataFrame:
    """Population mean and deviation over training rows: (feature, n, mean, sd)."""
    rows, features = _observations(examples.filter("split = 0"), kind, names)
    stats = rows.agg(
        *[
            F.struct(F.count(f).alias("n"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("sd")).alias(f)
            for f in features
        ]
    )
    lines = ", ".join(f"named_struct('feature', '{f}', 'n', {f}.n, 'mean', {f}.mean, 'sd', {f}.sd)" for f in features)
    return stats.selectExpr(f"inline(array({lines}))")


def fit_per_fold(examples: DataFrame, kind: str, names: Sequence[str] = ()) -> DataFrame:
    """The same statistics for each fold from training rows outside it: (fold, feature, n, mean, sd).

    One pass collects moments per fold; those of "all but this fold" follow from sums shifted by the
    overall mean, which avoids the cancellation of raw squares. At most 254 folds reach the windows.
    """
    rows, features = _observations(examples.filter("split = 0"), kind, names)
    moments = rows.groupBy("fold").agg(
        *[
            F.struct(F.count(f).alias("n"), F.avg(f).alias("m"), F.var_pop(f).alias("v")).alias(f)
            for f in features
        ]
    )
    lines = ", ".join(
        f"named_struct('feature', '{f}', 'n', {f}.n, 'm', coalesce({f}.m, 0D), 'v', coalesce({f}.v, 0D))"
        for f in features
    )
    per_fold = moments.selectExpr("fold", f"inline(array({lines}))")
    every = Window.partitionBy("feature")
    shifted = per_fold.withColumn("c", F.sum(F.expr("n * m")).over(every) / F.sum("n").over(every)).selectExpr(
        "fold", "feature", "n", "c", "n * (m - c) AS s1", "n * (v + (m - c) * (m - c)) AS s2"
    )
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "s1", "s2")}
    return shifted.select("fold", "feature", "c", *[e.alias(n) for n, e in rest.items()]).selectExpr(
        "fold", "feature", "n", "c + s1 / n AS mean", "sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0D)) AS sd"
    )


def check_fit(stats: DataFrame) -> DataFrame:
    """Raise on a feature without observations or without variance (few rows: features × folds)."""
    bad = stats.filter("n = 0 OR n IS NULL OR sd IS NULL OR sd = 0").limit(10).collect()
    if bad:
        raise ValueError(f"features without variance in the fitting rows: {[tuple(r) for r in bad]}")
    return stats


def _wide(stats: DataFrame, features: Sequence[str], keys: Sequence[str], prefix: str) -> DataFrame:
    columns = []
    for f in features:
        columns.append(F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"{prefix}m_{f}"))
        columns.append(F.max(F.when(F.col("feature") == f, F.col("sd"))).alias(f"{prefix}s_{f}"))
    return stats.groupBy(*keys).agg(*columns)


def attach(examples: DataFrame, fitted: Mapping[str, DataFrame], names: Sequence[str], fold: bool = False) -> DataFrame:
    """Join the fitted constants of all three families to each example (one broadcast row, or one per fold)."""
    result = examples
    families = {"level": ["level"], "battle": list(CONTINUOUS), "summary": list(names)}
    for kind, stats in fitted.items():
        if fold:
            wide = _wide(stats, families[kind], ["fold"], f"__{kind}_")
            result = result.join(F.broadcast(wide), "fold")
        else:
            # One small collected row becomes constants of the projection.
            found = {r["feature"]: (r["mean"], r["sd"]) for r in stats.collect()}
            result = result.withColumns(
                {f"__{kind}_{c}_{f}": F.lit(found[f][i]) for f in families[kind] for i, c in enumerate("ms")}
            )
    return result


def transform(
    examples: DataFrame, fitted: Mapping[str, DataFrame], names: Sequence[str], fold: bool = False
) -> DataFrame:
    """Standardise levels, the four continuous history features and the summary columns.

    Adds ``trophies_missing`` to each history entry; missing trophies and undefined rates become the
    mean, i.e. zero. ``result`` and ``changed_deck`` stay as they are.
    """
    joined = attach(examples, fitted, names, fold)

    def z(kind: str, feature: str, value: str) -> str:
        return f"coalesce(({value} - __{kind}_m_{feature}) / __{kind}_s_{feature}, 0D)"

    scaled = ", ".join(f"'{f}', {z('battle', f, f'x.{f}')}" for f in CONTINUOUS)
    history = f"""transform(history, x -> named_struct(
        'battle_time', x.battle_time, 'deck', x.deck,
        'levels', transform(x.levels, l -> {z('level', 'level', 'l')}),
        'result', cast(x.result AS double), 'changed_deck', cast(x.changed_deck AS double), {scaled},
        'trophies_missing', CASE WHEN x.trophies IS NULL THEN 1D ELSE 0D END))"""
    others = [c for c in examples.columns if c not in names and c != "history"]
    return joined.selectExpr(*others, f"{history} AS history", *[f"{z('summary', n, n)} AS {n}" for n in names])
