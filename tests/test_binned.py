"""Bins are found without an expression that grows with them."""

import numpy as np
from pyspark.sql import functions as F

from scarp.operators import stats


def test_many_bins_keep_the_plan_short_and_the_counts_right(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.random(500), [0.0, 0.05, 0.15000000000000002, 1.0, -0.1, 1.1, np.nan]))
    df = spark.createDataFrame([(float(v), float(i), "correct") for i, v in enumerate(x)], "similarity double, log_ratio double, status string").repartition(3)
    bins = stats.bin_edges(0.05)
    found = stats.binned(df, bins, [F.count("*").alias("n"), F.sum("log_ratio").alias("s")])
    assert found._jdf.queryExecution().optimizedPlan().toString().upper().count("CASE WHEN") < len(bins)
    got = {r["bin"]: (r["n"] or 0, r["s"] or 0.0) for r in found.collect()}
    for i, (a, b) in enumerate(bins):
        inside = (x >= a) & ((x < b) | ((b == 1.0) & (x == 1.0)))
        assert got[i] == (int(inside.sum()), float(np.flatnonzero(inside).sum()))
