"""Distributed evaluation of scores: nothing is collected, nothing is sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from contest_panel.operators.ranking import exact_quantiles, running_sums
from contest_panel.operators.skew import small

_EPS = "1e-15D"
# Reporting levels and windows of the score coverage.
COVERAGE_QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
COVERAGE_WINDOWS = ((0.05, 0.95), (0.10, 0.90), (0.20, 0.80), (0.40, 0.60))
_P = f"greatest({_EPS}, least(1D - {_EPS}, score))"
_LOSS = f"-(label * ln({_P}) + (1 - label) * ln(1 - {_P}))"


def _basic(threshold: str = ">=") -> list:
    return [
        F.expr("count(*) AS examples"),
        F.expr("avg(label) AS positive_rate"),
        F.expr(f"avg({_LOSS}) AS log_loss"),
        F.expr("avg((score - label) * (score - label)) AS brier_score"),
        F.expr(f"avg(CASE WHEN cast(score {threshold} 0.5D AS int) = label THEN 1D ELSE 0D END) AS accuracy"),
    ]


def binary_metrics(scored: DataFrame, by: Sequence[str] = (), threshold: str = ">=") -> DataFrame:
    """Log loss, Brier score and accuracy of ``score`` against 0/1 ``label``."""
    return scored.groupBy(*by).agg(*_basic(threshold))


def ranking_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (tie-corrected) and average precision per group, from one ordered pass.

    Equal scores are counted together first, so a score shared by many rows costs one row. Groups must
    be few (actions, runs). Undefined for a group of one class: NULL. Runs an action.
    """
    by = list(by)
    counted = scored.groupBy(*by, "score").agg(
        F.expr("sum(label) AS pos"), F.expr("count(*) - sum(label) AS neg")
    )
    summed = running_sums(counted, [*by, "score"], {"cpos": "pos", "cneg": "neg"})
    totals = summed.groupBy(*by).agg(
        F.expr("sum(pos) AS all_pos"), F.expr("sum(neg) AS all_neg"),
        F.expr("min(cpos - pos) AS base_pos"), F.expr("min(cneg - neg) AS base_neg"),
    )
    if by:
        joined = summed.join(small(totals), by)
    else:
        joined = summed.join(F.broadcast(totals))  # one row
    parts = joined.selectExpr(
        *by, "all_pos", "all_neg",
        "pos * ((cneg - neg - base_neg) + neg / 2D) AS wins",
        # Ranked from the top: everything at or above this score.
        "pos * (all_pos - (cpos - pos - base_pos)) / "
        "cast(all_pos - (cpos - pos - base_pos) + all_neg - (cneg - neg - base_neg) AS double) AS precision_mass",
    )
    return parts.groupBy(*by).agg(
        F.expr("sum(wins) / nullif(max(cast(all_pos AS double)) * max(all_neg), 0D) AS roc_auc"),
        F.expr("sum(precision_mass) / nullif(max(all_pos), 0) AS average_precision"),
    )


def calibration_table(scored: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean score, observed rate and size per equal-width score bin; the last bin is closed."""
    binned = scored.withColumn("bin", F.expr(f"cast(least(floor(score * {bins}), {bins - 1}) AS int)"))
    return binned.groupBy(*by, "bin").agg(
        F.expr("avg(score) AS mean_score"), F.expr("avg(label) AS observed_rate"), F.expr("count(*) AS examples")
    )


def calibration_error(scored: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Size-weighted absolute gap between mean score and observed rate."""
    return calibration_table(scored, by, bins).groupBy(*by).agg(
        F.expr("sum(examples * abs(mean_score - observed_rate)) / sum(examples) AS calibration_error")
    )


def full_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All six headline metrics; one row per (few) groups. Runs an action."""
    by = list(by)
    if not by:
        only = scored.withColumn("__all", F.lit(0))
        return full_metrics(only, ["__all"]).drop("__all")
    small = [ranking_metrics(scored, by), calibration_error(scored, by)]
    result = binary_metrics(scored, by)
    for part in small:
        # Groups are few, but nothing is broadcast on trust: Spark picks by the sizes it sees.
        result = result.join(part, by)
    return result


def with_overall(scored: DataFrame, action: str = "action") -> DataFrame:
    """Each row under ``overall`` and under its action's name."""
    return scored.selectExpr(
        "*", f"explode(array('overall', CASE WHEN {action} = 1 THEN 'switch' ELSE 'stay' END)) AS segment"
    )


def factual_metrics(scored: DataFrame, action: str = "action", basic: bool = False) -> DataFrame:
    """Metrics overall and by observed action."""
    doubled = with_overall(scored, action)
    return binary_metrics(doubled, ["segment"]) if basic else full_metrics(doubled, ["segment"])


def require_actions(report: DataFrame) -> DataFrame:
    """Raise when an action was never observed (three rows at most)."""
    present = {r["segment"] for r in report.select("segment").collect()}
    if present != {"overall", "stay", "switch"}:
        raise ValueError(f"evaluation rows lack an action: found {sorted(present)}")
    return report


def score_quantiles(scored: DataFrame) -> DataFrame:
    """Exact score quantiles at the reporting levels. Runs an action."""
    return exact_quantiles(scored, ["score"], COVERAGE_QUANTILES).selectExpr(
        "concat('q', format_string('%.2f', probability)) AS measure", "value"
    )


def propensity_coverage(scored: DataFrame) -> DataFrame:
    """Score quantiles and the share of rows inside each closed window, in long form. Runs an action."""
    shares = ", ".join(
        f"named_struct('measure', 'within {lo:.2f}-{hi:.2f}', "
        f"'value', avg(CASE WHEN score BETWEEN {lo}D AND {hi}D THEN 1D ELSE 0D END))"
        for lo, hi in COVERAGE_WINDOWS
    )
    windows = scored.agg(F.expr(f"array({shares}) AS w")).selectExpr("inline(w)")
    return score_quantiles(scored).unionByName(windows)


def overlap_diagnostics(scored: DataFrame, action: str = "action") -> DataFrame:
    """Score range, inverse-propensity weights and effective sample size by observed action."""
    weight = f"CASE WHEN {action} = 1 THEN 1 / {_P} ELSE 1 / (1 - {_P}) END"
    return scored.withColumn("__w", F.expr(weight)).groupBy(action).agg(
        F.expr("count(*) AS examples"),
        F.expr("min(score) AS lowest"),
        F.expr("avg(score) AS mean_score"),
        F.expr("max(score) AS highest"),
        F.expr("min(__w) AS lowest_weight"),
        F.expr("max(__w) AS highest_weight"),
        F.expr("sum(__w) * sum(__w) / sum(__w * __w) AS effective_size"),
    )


def long_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One line per metric."""
    lines = ", ".join(f"named_struct('metric', '{m}', 'value', cast({m} AS double))" for m in metrics)
    return wide.selectExpr(*keys, f"inline(array({lines}))")


def run_aggregate(lines: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean and sample deviation over runs; the deviation of a single run is 0."""
    return lines.groupBy(*by).agg(
        F.expr("avg(value) AS mean"), F.expr("coalesce(stddev_samp(value), 0D) AS sd"), F.expr("count(*) AS runs")
    )


def run_compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Aggregated runs side by side."""
    left = baseline.selectExpr("metric", "mean AS baseline", "sd AS baseline_sd")
    right = candidate.selectExpr("metric", "mean AS candidate", "sd AS candidate_sd")
    return left.join(right, "metric").withColumn("difference", F.expr("candidate - baseline"))


def variance_shares(components: DataFrame, names: Sequence[str], transitive: str, cyclic: str) -> DataFrame:
    """Sample variance of each score component, its share, and the split of the deck effect."""
    variances = components.agg(*[F.var_samp(n).alias(n) for n in names])
    total = " + ".join(names)
    lines = ", ".join(
        f"named_struct('component', '{n}', 'variance', {n}, 'share', {n} / nullif({total}, 0D), 'deck_share', "
        + (f"{n} / nullif({transitive} + {cyclic}, 0D)" if n in (transitive, cyclic) else "cast(NULL AS double)")
        + ")"
        for n in names
    )
    return variances.selectExpr(f"inline(array({lines}))")
