"""The compound table: order, identity, activity on a log scale, censoring, embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is added to -log10(activity) for each unit.
UNIT_SHIFTS = {"nM": 9, "uM": 6, "mM": 3, "M": 0}


def _log10(x: float | None) -> float | None:
    return None if x is None or x <= 0 else math.log10(x)


def log_activity(activity: Column, unit: str) -> Column:
    """Null where the activity is null or not positive.

    The logarithm is that of the C library, which SQL engines use: the JVM's differs in the last bit of some values, so
    activities that are ten times each other would differ by a little less than 1.
    """
    if unit not in UNIT_SHIFTS:
        raise ValueError(f"unknown unit {unit!r}; known: {', '.join(UNIT_SHIFTS)}")
    return -F.udf(_log10, "double")(activity.cast("double")) + F.lit(float(UNIT_SHIFTS[unit]))


def censored(activity: Column, threshold: float | None) -> Column:
    """A missing activity is not censored, nor is anything without a threshold."""
    return F.lit(False) if threshold is None else F.coalesce(activity >= threshold, F.lit(False))


def with_activity(compounds: DataFrame, unit: str = "nM", threshold: float | None = None) -> DataFrame:
    return compounds.withColumn("log_activity", log_activity(F.col("activity"), unit)).withColumn("censored", censored(F.col("activity"), threshold))


def keep_first(compounds: DataFrame) -> DataFrame:
    """The first row, by pos, of each compound_id."""
    order = Window.partitionBy("compound_id").orderBy("pos")
    return compounds.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def head(compounds: DataFrame, n: int) -> DataFrame:
    """The first n rows in input order, where pos counts from 0."""
    return compounds.filter(F.col("pos") < n)


def group_key(compound_id: Column) -> Column:
    return F.substring_index(compound_id, "-", 1)


def stackable() -> Column:
    """Aggregate: whether all embeddings have one length."""
    return F.min(F.size("embedding")) == F.max(F.size("embedding"))


def coordinate_means(compounds: DataFrame) -> DataFrame:
    """i, mean of each coordinate."""
    return compounds.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"))


def trim(compounds: DataFrame, k: int) -> DataFrame:
    """Set the k coordinates with the largest means to 0; among equal means those of higher index."""
    order = F.struct((-F.col("mean")).alias("m"), (-F.col("i")).alias("i"))
    largest = coordinate_means(compounds).agg(F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, k), lambda s: (-s["i"]).cast("int")).alias("_zero"))
    cut = F.transform("embedding", lambda x, i: F.when(F.array_contains("_zero", i), 0.0).otherwise(x))
    return compounds.join(F.broadcast(largest)).withColumn("embedding", cut).drop("_zero")  # one row


def center(compounds: DataFrame) -> DataFrame:
    """Subtract each coordinate's mean."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "mean")))
    means = coordinate_means(compounds).agg(F.transform(ordered, lambda s: s["mean"]).alias("_means"))
    return compounds.join(F.broadcast(means)).withColumn("embedding", F.zip_with("embedding", "_means", lambda x, m: x - m)).drop("_means")


def projection(compounds: DataFrame, dims: int = 2) -> DataFrame:
    """compound_id, pc: the vectors on their first principal components. The driver holds a matrix of the coordinates only."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = center(compounds).select("compound_id", array_to_vector("embedding").alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="p").fit(v).transform(v).select("compound_id", vector_to_array("p").alias("pc"))
