"""Quantiles of values that are counted where they are made."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scarp.operators import pairs, plotdata, stats
from scarp.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fetch", [100, 200_000])
def test_made_values_give_the_quantiles_of_a_column(spark, monkeypatch, fetch):
    monkeypatch.setattr(stats, "_FETCH", fetch)
    points = [0.0, 0.001, 0.3, 0.5, 0.99, 1.0]

    def make(batches):
        for batch in batches:
            x = np.sqrt(batch.column("id").to_numpy() % 997) - 3
            yield pa.RecordBatch.from_arrays([pa.array(x)], ["v"])

    got = stats.made_quantiles(spark.range(3000).repartition(3), make, points)
    assert got == stats.quantiles(spark.range(3000), F.sqrt(F.col("id") % 997) - 3, points)[None]
    assert np.allclose(got, np.quantile(np.sqrt(np.arange(3000) % 997) - 3, points), atol=1e-12)
    assert stats.made_quantiles(spark.range(0), make, points) == [None] * 6


@pytest.mark.parametrize("name", ["plot_distance_cdf", "plot_normal_quantiles"])
def test_no_pair_becomes_a_row(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("pairs were made as rows")

    monkeypatch.setattr(queries, "KEPT_PAIRS", 0)
    monkeypatch.setattr(pairs, "pair_facts", refused)
    monkeypatch.setattr(pairs, "block_pairs", refused)
    monkeypatch.setattr(pairs, "BLOCK", 64)
    monkeypatch.setattr(stats, "_FETCH", 5000)
    queries.release()
    duck = duckdb.connect()
    for t in ("embeddings", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    tidy = lambda f: f[sorted(f.columns)].sort_values(sorted(f.columns), kind="stable").reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(queries.QUERIES[name](spark, SF).toPandas()), tidy(duck.execute(queries.SQL[name]).df()), check_dtype=False, rtol=0, atol=1e-9)
    queries.release()


def test_unknown_infinite_and_censored_activities(spark):
    rng = np.random.default_rng(5)
    la = [None if i % 11 == 0 else float("inf") if i % 13 == 0 else float(rng.integers(0, 40)) / 10 for i in range(120)]
    rows = [(i, f"c{i}", "g", la[i], i % 7 == 0, rng.random(5).tolist()) for i in range(120)]
    compounds = spark.createDataFrame(rows, "pos long, compound_id string, group_key string, log_activity double, censored boolean, embedding array<double>")
    want = plotdata.normal_quantiles(pairs.pair_table(compounds, "cosine"), "log_ratio").toPandas()
    for vectors in (True, False):
        got = plotdata.normal_quantiles_by_blocks(pairs.met_blocks(compounds, ("log_activity", "censored"), 50, vectors)).toPandas()
        pd.testing.assert_frame_equal(got, want)
