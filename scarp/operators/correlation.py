"""How activity differences go with similarity: slopes, bins, subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarp.functions.special import t_two_sided

from . import stats
from .pairs import is_cliff, valid

REGULARIZATION = 0.01
#: The tail thresholds and the similarity bins of the log-slope table.
TAILS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
SLOPE_BINS = ((0.0, 0.5), (0.5, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 1.0))


def lipschitz(regularization: float = REGULARIZATION) -> Column:
    """log_ratio over the distance 1 - similarity, the latter kept away from 0."""
    return F.col("log_ratio") / F.greatest(1 - F.col("similarity"), F.lit(regularization))


def with_lipschitz(pairs: DataFrame, regularization: float = REGULARIZATION) -> DataFrame:
    fine = F.col("similarity").isNotNull() & F.col("log_ratio").isNotNull()
    return pairs.withColumn("regularized_lipschitz", F.when(fine, lipschitz(regularization)))


def lipschitz_stats(pairs: DataFrame) -> DataFrame:
    return stats.summary(valid(with_lipschitz(pairs)), "regularized_lipschitz", (25, 75, 90, 95, 99))


def lipschitz_histogram(pairs: DataFrame, bins: int = 100) -> DataFrame:
    """Of the values up to their 99th percentile."""
    return stats.histogram(stats.truncated(valid(with_lipschitz(pairs)), "regularized_lipschitz"), "regularized_lipschitz", bins)


def cliff_probability(pairs: DataFrame, threshold: float = 1.0, width: float = 0.05) -> DataFrame:
    counts = [F.count("*").alias("n_pairs"), F.count_if(is_cliff(threshold)).alias("n_cliffs")]
    out = stats.binned(pairs, stats.bin_edges(width), counts).fillna(0, ["n_pairs", "n_cliffs"])
    share = F.when(F.col("n_pairs") > 0, F.col("n_cliffs") / F.col("n_pairs")).otherwise(0.0)
    return out.select("bin_lower", "bin_upper", ((F.col("bin_lower") + F.col("bin_upper")) / 2).alias("bin_center"), "n_pairs", "n_cliffs", share.alias("cliff_probability"))


def binned_pearson(pairs: DataFrame, width: float = 0.05) -> DataFrame:
    """Correlation of similarity and log_ratio in each bin of three pairs or more that vary."""
    aggregates = [
        F.count("*").alias("n_pairs"),
        F.covar_pop("similarity", "log_ratio").alias("cov"),
        F.avg("similarity").alias("ms"),
        F.avg("log_ratio").alias("ml"),
        F.stddev_pop("similarity").alias("ss"),
        F.stddev_pop("log_ratio").alias("sl"),
    ]
    out = stats.binned(pairs, stats.bin_edges(width), aggregates).fillna(0, ["n_pairs"])
    enough = F.col("n_pairs") >= 3
    return out.select(
        "bin_lower", "bin_upper", ((F.col("bin_lower") + F.col("bin_upper")) / 2).alias("bin_center"), "n_pairs",
        F.when(enough & (F.col("ss") > 1e-10) & (F.col("sl") > 1e-10), F.col("cov") / F.nullif(F.col("ss") * F.col("sl"), F.lit(0.0))).alias("pearson_r"),
        F.when(enough, F.col("ms")).alias("mean_similarity"), F.when(enough, F.col("ml")).alias("mean_log_ratio"),
    )


def with_p_values(binned: DataFrame) -> DataFrame:
    """The binned correlations (a row per bin) with two-sided p values."""
    rows = binned.collect()
    p = [(x["bin_lower"], None if x["pearson_r"] is None else float(t_two_sided(x["pearson_r"], x["n_pairs"]))) for x in rows]
    return binned.join(F.broadcast(binned.sparkSession.createDataFrame(p, "bin_lower double, p_value double")), "bin_lower")


def zero_percent(pairs: DataFrame) -> DataFrame:
    """n_zero, n_valid, p0_percent: the share of valid pairs at structural distance 0."""
    zero = F.count_if(F.col("distance_raw") == 0)
    return valid(pairs).agg(zero.alias("n_zero"), F.count("*").alias("n_valid"), (100.0 * zero / F.nullif(F.count("*"), F.lit(0))).alias("p0_percent"))


def pearson_summary(binned: DataFrame) -> DataFrame:
    return binned.agg(F.avg("pearson_r").alias("mean_r"), F.stddev_samp("pearson_r").alias("std_r"), F.min("pearson_r").alias("min_r"), F.max("pearson_r").alias("max_r"), F.count("pearson_r").alias("n_bins"))


def conditional_probability(pairs: DataFrame, threshold: float = 1.0, intervals: Sequence[tuple[float, float]] | None = None, tails: Sequence[float] = TAILS) -> DataFrame:
    """Cliff probability, moments and tails of log_ratio in each similarity interval."""
    intervals = intervals or [(i * 0.1, (i + 1) * 0.1) for i in range(10)]
    aggregates = [
        F.count("*").alias("n_pairs"), F.count_if(is_cliff(threshold)).alias("n_cliffs"), F.avg("log_ratio").alias("mean_log_ratio"),
        F.var_pop("log_ratio").alias("variance_log_ratio"), F.stddev_pop("log_ratio").alias("std_log_ratio"),
        *[F.avg((F.col("log_ratio") >= t).cast("double")).alias(f"tail_prob_{t:.1f}".replace(".", "_")) for t in tails],
    ]
    out = stats.binned(pairs, intervals, aggregates, median=("log_ratio", "median_log_ratio")).fillna(0, ["n_pairs", "n_cliffs"])
    share = F.when(F.col("n_pairs") > 0, F.col("n_cliffs") / F.col("n_pairs")).otherwise(0.0)
    return out.withColumn("conditional_probability", share).withColumnsRenamed({"bin_lower": "interval_lower", "bin_upper": "interval_upper"}).drop("bin")


def conditional_by_width(pairs: DataFrame, threshold: float = 1.0, widths: Sequence[float] = (0.05, 0.1, 0.2)) -> DataFrame:
    out = None
    for w in widths:
        own = conditional_probability(pairs, threshold, stats.bin_edges(w)).withColumn("width", F.lit(w))
        out = own if out is None else out.unionByName(own)
    return out


def subset_stats(subset: DataFrame) -> DataFrame:
    """Statistics of similarity, log_ratio and slope over a curated subset of pairs."""
    return stats.describe(with_lipschitz(subset), ["similarity", "log_ratio", "regularized_lipschitz"], (90, 95, 99))


def zero_fraction(subset: DataFrame) -> DataFrame:
    """How many pairs of a subset have scaled distance 0."""
    zero = F.count_if(F.col("distance_scaled") == 0)
    return subset.filter("distance_scaled IS NOT NULL").agg(F.count("*").alias("n_pairs"), zero.alias("n_zero"), F.when(F.count("*") > 0, zero / F.count("*")).otherwise(0.0).alias("zero_fraction"))


def log_lipschitz(pairs: DataFrame, bins: Sequence[tuple[float, float]] = SLOPE_BINS) -> DataFrame:
    """Mean, median and deviation of the log slope of positive slopes in five similarity bins."""
    held = valid(with_lipschitz(pairs)).filter("regularized_lipschitz > 0").withColumn("log_slope", F.ln("regularized_lipschitz"))
    aggregates = [F.count("*").alias("n_pairs"), F.avg("log_slope").alias("mean_log"), F.stddev_pop("log_slope").alias("std_log")]
    return stats.binned(held, bins, aggregates, "similarity IS NOT NULL", ("log_slope", "median_log"), ("log_slope",)).fillna(0, ["n_pairs"]).drop("bin")
