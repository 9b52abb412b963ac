"""Scalar expressions on keys, times, levels and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The three ladder modes and the outcome-independent binning limits.
LADDER_MODES = (72000006, 72000201, 72000044)
ADVANTAGE_LIMIT = 40
BAND_WIDTH = 100
BAND_COUNT = 80
LEVEL_BINS = 16
TROPHY_DIFFERENCE_LIMIT = 200
TROPHY_CEILING = 14_000
LOG_PAGE = 30

# Timestamp layout of raw battle logs.
BATTLE_TIME_FORMAT = "yyyyMMdd'T'HHmmss[.SSSSSS][.SSS]X"


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def battle_timestamp(text: str | Column) -> Column:
    """UTC timestamp of a raw battle time; NULL when it does not parse."""
    return F.try_to_timestamp(as_column(text), F.lit(BATTLE_TIME_FORMAT))


def normalised_tag(tag: str | Column) -> Column:
    """Trimmed, upper-case tag with a leading ``#``."""
    clean = F.upper(F.trim(as_column(tag)))
    return F.when(clean.startswith("#"), clean).otherwise(F.concat(F.lit("#"), clean))


def contest_key(time_text: str | Column, *participants: Column) -> Column:
    """Mirror-proof key: raw time plus every participant tag in sorted order."""
    tags = F.concat(*[side["tag"] for side in participants])
    known = F.sort_array(F.transform(tags, lambda tag: F.coalesce(tag, F.lit(""))))
    return F.concat_ws("|", F.coalesce(as_column(time_text), F.lit("")), F.array_join(known, "|"))


def seeded_digest(seed: int | str, *parts: str | Column) -> Column:
    """md5 of ``seed|part|…``: an order that depends on the data, not on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_column(p).cast("string") for p in parts]))


def fair_coin(seed: int | str, *parts: str | Column) -> Column:
    """Boolean coin per key, equal on every run and for every partitioning."""
    head = F.conv(F.substring(seeded_digest(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return head % 2 == 1


def clipped(value: str | Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_column(value)))


def minute_of(ts: str | Column) -> Column:
    return F.floor(F.unix_micros(as_column(ts)) / F.lit(60_000_000)).cast("bigint")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def sigmoid(logit: str | Column) -> Column:
    """Probability of a logit clipped to ±30."""
    return 1.0 / (1.0 + F.exp(-clipped(logit, -30.0, 30.0)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL for an empty denominator."""
    return F.when(denominator != 0, numerator / denominator)


def equal_width_band(value: str | Column, bands: int, ceiling: float = TROPHY_CEILING) -> Column:
    """Band 0..bands-1 of equal width; values at or above the ceiling close into the last."""
    return clipped(F.floor(as_column(value) * F.lit(float(bands)) / F.lit(float(ceiling))), 0, bands - 1).cast("int")
