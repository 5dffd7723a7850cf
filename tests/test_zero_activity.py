"""An activity of 0 has an infinite logarithm, as in the queries' SQL."""

import os

import duckdb
import pandas as pd
import pytest

from scarp.operators import stats
from scarp.plans import queries

SF = "/root/testdata/sf0.001"
NAMES = (
    "binned_cliff_probability", "binned_pearson", "binned_pearson_p", "binned_pearson_summary", "cliff_fractions", "cliff_pairs_top5pct", "cliff_rank", "cliff_sets_by_rank",
    "cliff_sets_by_threshold", "compounds_dedup_first", "compounds_log_activity", "conditional_probability", "fit_exponential_weibull", "fit_mixture",
)


@pytest.fixture(scope="module")
def where(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zero")
    os.symlink(f"{SF}/embeddings.parquet", folder / "embeddings.parquet")
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id IN (17, 44) THEN 0.0 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_with_activities_of_zero(spark, where, name):
    duck = duckdb.connect()
    for t in ("embeddings", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    tidy = lambda f: f[sorted(f.columns)].sort_values(sorted(f.columns), kind="stable").reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(queries.QUERIES[name](spark, where).toPandas()), tidy(duck.execute(queries.SQL[name]).df()), check_dtype=False, rtol=0, atol=1e-9)


def test_quantiles_put_nan_last_and_keep_infinity(spark, monkeypatch):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, float("nan"), 2, float("inf"), -0.0, float("-inf")]], "v double").repartition(3)
    for fetch in (100, 1):
        monkeypatch.setattr(stats, "_FETCH", fetch)
        assert stats.order_statistics(df, "v", [1, 2, 3, 4, 5, 6]) == [float("-inf"), 0.0, 1.0, 2.0, 3.0, float("inf")]
        assert stats.order_statistics(df, "v", [7])[0] != stats.order_statistics(df, "v", [7])[0]
