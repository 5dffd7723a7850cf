"""Infinite logarithms in differences, histograms and fits: as the SQL has them."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from scarp.operators import stats
from scarp.operators.differences import Differences
from scarp.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["17", "17, 44"])
def where(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("infinite")
    os.symlink(f"{SF}/embeddings.parquet", folder / "embeddings.parquet")
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id IN ({request.param}) THEN 0.0 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["log_ratio_stats", "plot_log_ratios", "plot_log_slopes", "plot_group_panels", "fit_residuals"])
def test_query_equals_sql(spark, where, name):
    duck = duckdb.connect()
    for t in ("embeddings", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    tidy = lambda f: f[sorted(f.columns)].sort_values(sorted(f.columns), kind="stable").reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(queries.QUERIES[name](spark, where).toPandas()), tidy(duck.execute(queries.SQL[name]).df()), check_dtype=False, rtol=0, atol=1e-9)


def test_infinite_values_bring_no_pairs_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr("scarp.operators.differences.KEEP", 10)
    values = [0.0, 1.0, 3.0, float("inf"), float("inf")]
    d = Differences(spark.createDataFrame([(v,) for v in values], "v double"), "v", 2)
    assert (d.pairs, d.finite, d.undefined) == (10, 3, 1)
    assert d.order_statistics([0, 1, 2, 3, 8]) == [1.0, 2.0, 3.0, np.inf, np.inf] and np.isnan(d.order_statistics([9])[0])


def test_histogram_of_infinite_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, "inf")], "v double")
    assert [r["n"] for r in stats.histogram(df, "v", 4).orderBy("bin").collect()] == [3, 0, 0, 1]
