"""Distances to similarities in [0, 1]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp.operators.stats import quantiles

from .metrics import get_metric

#: name -> builder(distance, largest distance): the transformed distance, and whether it is stretched to [0, 1] afterwards.
SCALINGS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {}


def register_scaling(name: str, stretched: bool = False):
    def add(builder):
        SCALINGS[name] = (builder, stretched)
        return builder

    return add


@register_scaling("linear")
def linear(d: Column, largest: Column) -> Column:
    return F.when(d.isNotNull(), F.when(F.coalesce(largest, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(d / largest))


@register_scaling("sigmoid", stretched=True)
def sigmoid(d: Column, largest: Column) -> Column:
    return 1 / (1 + F.exp(-10.0 * (d / F.nullif(largest, F.lit(0.0)) - 0.5)))


@register_scaling("exponential", stretched=True)
def exponential(d: Column, largest: Column) -> Column:
    """Decreases with the distance, so the nearest pair ends at scaled distance 1 and similarity 0."""
    return F.exp(-1.0 * d / F.nullif(largest, F.lit(0.0)))


def cutoff_of(pairs: DataFrame, percentile: float = 99.0) -> tuple[float | None, float | None]:
    """The cut-off and the largest of the valid distances."""
    return tuple(quantiles(pairs, "distance_raw", [percentile / 100, 1.0]).get(None, [None, None]))


def scale_pairs(pairs: DataFrame, metric: str, scaling: str = "linear", percentile: float | None = 99.0, ends: tuple[float | None, float | None] | None = None) -> DataFrame:
    """pairs with distance_scaled, distance_scaled_structure and similarity.

    A metric with a known bound is divided by it. Otherwise distances are clipped at the given
    percentile of the valid ones (which are read for it) and transformed; those above become 1. Without a percentile
    the distance stays as it is. Excluded pairs get a structural distance only, by the same
    cut-off, and only for linear scaling; null where that is undefined. `ends` is what cutoff_of() gives, for some of the
    pairs it was taken of.
    """
    bound = get_metric(metric).upper_bound
    raw, structure = F.col("distance_raw"), F.col("distance_structure")
    if percentile is None:
        return _finish(pairs, raw, structure)
    if bound is not None:
        # least and greatest pass over nulls, so a missing distance is kept apart
        clip = lambda d: F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(0.0)), F.lit(bound)) / bound)
        return _finish(pairs, clip(raw), clip(structure))
    if scaling not in SCALINGS:
        raise ValueError(f"unknown scaling {scaling!r}; known: {', '.join(sorted(SCALINGS))}")
    builder, stretched = SCALINGS[scaling]
    cutoff, furthest = ends or cutoff_of(pairs, percentile)
    held = pairs.withColumn("_cutoff", F.lit(cutoff).cast("double"))
    clipped = F.when(raw.isNotNull(), F.least(raw, F.col("_cutoff")))
    largest = F.lit(None if cutoff is None else min(cutoff, furthest)).cast("double")
    value = builder(clipped, largest)
    if stretched:
        lo, hi = (F.lit(x).cast("double") for x in held.agg(F.min(value), F.max(value)).first())
        value = F.when((hi - lo == 0) & raw.isNotNull(), F.lit(0.0)).otherwise((value - lo) / (hi - lo))
    scaled = F.when(raw > F.col("_cutoff"), F.lit(1.0)).otherwise(value)
    cut = F.col("_cutoff")
    excluded = F.when(structure > cut, F.lit(1.0)).otherwise(structure / F.nullif(cut, F.lit(0.0))) if scaling == "linear" else F.lit(None).cast("double")
    return _finish(held, scaled, F.when(F.col("status") == "excluded", excluded).otherwise(scaled)).select(*pairs.columns, "distance_scaled", "distance_scaled_structure", "similarity")


def _finish(pairs: DataFrame, scaled: Column, structure: Column) -> DataFrame:
    return pairs.withColumns({"distance_scaled": scaled, "distance_scaled_structure": structure}).withColumn("similarity", 1 - F.col("distance_scaled"))
