"""Recommendation score and its four parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.fixed_values import (
    DEFAULT_WEIGHTS, FULL_HOUSE_SCREENINGS, LOG10_MAX_VOTES, MEDALS)


def rating_component(score: Column) -> Column:
    """0-10 rating on a 0-100 scale, not capped; 0 when there is no rating."""
    return F.coalesce(score / F.lit(10.0) * F.lit(100.0), F.lit(0.0))


def votes_component(votes: Column) -> Column:
    """Logarithm of the votes; ten million votes give 100, more give more."""
    known = F.coalesce(votes, F.lit(0))
    return F.when(known != 0, F.log10(known + F.lit(1)) / F.lit(LOG10_MAX_VOTES) * F.lit(100.0)).otherwise(
        F.lit(0.0))


def screens_component(screening_count: Column) -> Column:
    """Share of a full house of showings, capped at 100."""
    return F.least(F.coalesce(screening_count, F.lit(0)) / F.lit(FULL_HOUSE_SCREENINGS),
                   F.lit(1.0)) * F.lit(100.0)


def new_component(is_new_release: Column) -> Column:
    return F.when(F.coalesce(is_new_release, F.lit(False)), F.lit(100.0)).otherwise(F.lit(0.0))


def rec_score(score: Column, votes: Column, screening_count: Column, is_new_release: Column,
              weights: dict[str, float] | None = None) -> Column:
    """Weighted sum, two decimals. Missing weights take their default, unknown names are refused; no re-scaling."""
    if unknown := set(weights or {}) - set(DEFAULT_WEIGHTS):
        raise ValueError(f"weights not known: {sorted(unknown)}; these are: {sorted(DEFAULT_WEIGHTS)}")
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    total = (
        F.lit(float(w["rating_score_weight"])) * rating_component(score)
        + F.lit(float(w["rating_votes_weight"])) * votes_component(votes)
        + F.lit(float(w["screening_count_weight"])) * screens_component(screening_count)
        + F.lit(float(w["new_release_weight"])) * new_component(is_new_release)
    )
    return F.round(total, 2)


def rank_label(rank: Column) -> Column:
    """Medal for the first three places, then the number."""
    label = rank.cast("string")
    for place, medal in reversed(list(enumerate(MEDALS, 1))):
        label = F.when(rank == place, F.lit(medal)).otherwise(label)
    return label
