"""What is dealt out over tasks must give what a single one would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.operators import fitted, graph, pairs, stats


@pytest.mark.parametrize(("accuracy", "fetch"), [(10_000, 200_000), (100, 50)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, fetch):
    """The second time with coarse sketches, so that brackets have to narrow."""
    monkeypatch.setattr(stats, "_ACCURACY", accuracy)
    monkeypatch.setattr(stats, "_STEPS", accuracy // 10)
    monkeypatch.setattr(stats, "_FETCH", fetch)
    rng = np.random.default_rng(4)
    values = {"a": rng.lognormal(0, 3, 3000), "b": np.repeat([1.0, 2.0, 7.5], [900, 40, 900]), "c": np.array([5.0]), "d": rng.integers(0, 4, 2000) * 1.0}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = [0.0, 0.05, 0.5, 0.99, 1.0]
    got = stats.quantiles(df, "v", points, "g")
    assert got.keys() == values.keys()
    for g, v in values.items():
        assert got[g] == pytest.approx(np.quantile(v, points).tolist(), rel=1e-12)
    every = np.sort(np.concatenate(list(values.values())))
    assert stats.order_statistics(df, "v", [1, 17, 3000, 10**9]) == [every[0], every[16], every[2999], every[-1]]
    assert stats.quantiles(df.filter("v IS NULL"), "v", [0.5]) == {} and stats.order_statistics(df.limit(0), "v", [1]) == []


def test_summary_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert stats.summary(df, "x").first()["median"] is None and stats.summary(df, "x").first()["n"] == 0
    assert stats.summary(spark.createDataFrame([(2.0,)], "x double"), "x").first()["q99"] == 2.0
    assert stats.truncated(df, "x").count() == 0


def compounds(spark, n=70):
    rng = np.random.default_rng(1)
    rows = [(i, f"c{i:03}", "g", float(a), False, v.tolist()) for i, (a, v) in enumerate(zip(rng.normal(size=n), rng.normal(size=(n, 3)), strict=True))]
    return spark.createDataFrame(rows, "pos long, compound_id string, group_key string, log_activity double, censored boolean, embedding array<double>")


def test_log_ratios_by_blocks(spark):
    c = compounds(spark)
    a = np.array([r["log_activity"] for r in c.orderBy("pos").collect()])
    want = sorted(abs(x - y) for i, x in enumerate(a) for y in a[:i])
    got = sorted(r["lr"] for r in pairs.log_ratios(c, block=16).collect())
    assert got == pytest.approx(want) and pairs.log_ratios(c.limit(0)).count() == 0


def test_missing_pairs_by_blocks(spark):
    c = compounds(spark)
    p = pairs.pair_table(c, "l2")
    assert pairs.missing_pairs(c, p, block=16).count() == 0
    part = p.filter("pos1 % 7 <> 3 OR pos2 < 40")
    want = {(r["pos1"], r["pos2"]) for r in p.select("pos1", "pos2").exceptAll(part.select("pos1", "pos2")).collect()}
    got = {tuple(r) for r in pairs.missing_pairs(c, part.unionByName(part), block=16).collect()}
    assert want and got == want


def test_forest_of_parts_is_the_forest(spark, monkeypatch):
    p = pairs.pair_table(compounds(spark), "l2").withColumns({"distance_scaled": F.round("distance_raw", 1), "distance_scaled_structure": F.lit(None).cast("double")})
    e = graph.edges(p).persist()
    rows = [(r["a"], r["b"], r["dist"]) for r in e.collect()]
    a, b, d = (np.array(x) for x in zip(*rows, strict=True))
    want = sorted(zip(*(x.tolist() for x in graph._kruskal(a, b, d)), strict=True))
    assert sorted(tuple(r) for r in graph.spanning_forest(e.repartition(7)).collect()) == want and len(want) == 69
    assert graph.spanning_forest(e.limit(0)).count() == 0


def test_fine_bins_fit_like_the_values(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(5, 0.3, 3000), rng.uniform(2, 9, 1000)))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    from scarp.functions import fits

    one, two = fitted.mixture(df, "v"), fits.mixture_fit(x)
    assert all(one[k] == pytest.approx(two[k], rel=1e-4) for k in two)
    one, two = fitted.weibull(df, "v"), fits.weibull_fit(np.log(x))
    assert all(one[k] == pytest.approx(two[k], rel=1e-6) for k in two)
    assert fitted.mixture(df.limit(0), "v") is None and fitted.beta_distance(df.limit(1), "v") is None


def test_dip_sample_is_bounded_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(fitted, "DIP_VALUES", 500)
    p = pairs.pair_table(compounds(spark), "l2").withColumn("distance_scaled", F.col("distance_raw"))
    one, two = fitted.dip(p, trials=5), fitted.dip(p.repartition(3), trials=5)
    assert one == two and one["n_values"] == 500
