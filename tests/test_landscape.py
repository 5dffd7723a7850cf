"""Micro-fixtures with answers worked out by hand, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.functions.scaling import scale_pairs
from scarp.operators import cliffs, compounds, correlation, geometry, graph, pairs, runs, stats

COMPOUNDS = [(0, "a-1", 1.0, [1.0, 0.0]), (1, "a-2", 1000.0, [1.0, 0.0]), (2, "b-1", 5000.0, [0.0, 1.0]), (3, "b-2", 9000.0, [0.0, 0.0]), (4, "c-1", None, [1.0, 1.0]), (5, "c-2", 0.0, [1.0, 2.0])]


def table(spark, threshold=5000.0):
    df = spark.createDataFrame(COMPOUNDS, "pos long, compound_id string, activity double, embedding array<double>")
    return compounds.with_activity(df.withColumn("group_key", compounds.group_key(F.col("compound_id"))), "nM", threshold)


def made(spark, rows, schema="pos1 long, pos2 long, id1 string, id2 string, similarity double, log_ratio double, status string"):
    return spark.createDataFrame(rows, schema)


def curve(spark, sims, ratios):
    rows = [(i, i + 1000, f"a{i}", f"b{i}", s, r, "correct") for i, (s, r) in enumerate(zip(sims, ratios))]
    return made(spark, rows)


def test_activity_rules(spark):
    got = {r["compound_id"]: r for r in table(spark).collect()}
    assert got["a-1"]["log_activity"] == 9.0 and got["a-2"]["log_activity"] == pytest.approx(6.0)
    assert got["b-1"]["censored"] and not got["a-2"]["censored"]  # at the threshold counts
    assert got["c-1"]["log_activity"] is None and not got["c-1"]["censored"] and got["c-2"]["log_activity"] is None
    with pytest.raises(ValueError):
        compounds.log_activity(F.col("x"), "pM")


def test_status_and_excluded_pairs(spark):
    p = {(r["pos1"], r["pos2"]): r for r in scale_pairs(pairs.pair_table(table(spark), "cosine"), "cosine").collect()}
    assert len(p) == 15
    assert p[2, 3]["status"] == "excluded" and p[2, 3]["distance_raw"] is None and p[2, 3]["log_ratio"] is None
    assert p[2, 3]["distance_structure"] == 1.0 and p[2, 3]["similarity"] is None and p[2, 3]["distance_scaled_structure"] == 0.5
    assert p[0, 2]["status"] == "censored" and p[0, 1]["status"] == "correct" and p[0, 1]["distance_raw"] == 0 and p[0, 1]["similarity"] == 1
    assert p[0, 1]["log_ratio"] == pytest.approx(3) and p[0, 1]["activity_difference"] == pytest.approx(999e-9)


def test_both_kernels_and_block_sizes_agree(spark):
    for metric in ("euclidean", "tanimoto"):
        want = {(r["pos1"], r["pos2"]): r["distance_structure"] for r in pairs.expression_pairs(table(spark), metric).collect()}
        for block in (1, 2, 4, 256):
            got = {(r["pos1"], r["pos2"]): r["distance_structure"] for r in pairs.block_pairs(table(spark), metric, block).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_percentile_scaling(spark):
    rows = [(i, 100 + i, float(d), float(d), "correct") for i, d in enumerate(range(1, 101))] + [(500, 501, None, 200.0, "excluded"), (502, 503, None, 50.0, "excluded")]
    p = spark.createDataFrame(rows, "pos1 long, pos2 long, distance_raw double, distance_structure double, status string")
    cut = float(np.percentile(np.arange(1, 101), 90))
    got = {r["pos1"]: r for r in scale_pairs(p, "euclidean", "linear", 90.0).collect()}
    assert got[9]["distance_scaled"] == pytest.approx(10 / cut) and got[99]["distance_scaled"] == 1 and got[500]["distance_scaled_structure"] == 1
    assert got[500]["distance_scaled"] is None and got[502]["distance_scaled_structure"] == pytest.approx(50 / cut)
    for name in ("sigmoid", "exponential"):
        s = [r for r in scale_pairs(p, "euclidean", name, 90.0).collect() if r["status"] != "excluded"]
        assert (min(r["distance_scaled"] for r in s) == pytest.approx(0, abs=1e-12) or name == "exponential") and max(r["distance_scaled"] for r in s) == 1
    nearest = [r for r in scale_pairs(p, "euclidean", "exponential", 90.0).collect() if r["pos1"] == 0][0]
    assert nearest["distance_scaled"] == 1  # the decreasing scaling puts the nearest pair farthest
    raw = scale_pairs(p, "euclidean", "linear", None).filter("pos1 = 9").first()
    assert raw["distance_scaled"] == 10 and raw["similarity"] == -9


def test_thresholds_bins_and_equal_values(spark):
    sims = [round(0.05 * k, 2) for k in range(21)]
    p = curve(spark, sims, [1.0] * 10 + [0.999] * 11)
    got = {r["similarity_threshold"]: r for r in cliffs.cliff_fractions(p).collect()}
    assert [got[t]["n_pairs"] for t in sims] == list(range(21, 0, -1))
    assert got[0.0]["n_cliffs"] == 10 and got[0.5]["n_cliffs"] == 0 and got[0.0]["cliff_fraction"] == 10 / 21
    bins = {round(r["bin_lower"], 2): r["n_pairs"] for r in correlation.cliff_probability(p).collect()}
    assert sum(bins.values()) == 21 and bins[0.95] == 1 and bins[0.9] == 2  # 19 * 0.05 is above 0.95; 1.0 is in the last bin


def test_pearson_needs_three_pairs_that_vary(spark):
    p = curve(spark, [0.01, 0.02, 0.11, 0.12, 0.13, 0.21, 0.22, 0.23], [1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0])
    got = {round(r["bin_lower"], 2): r for r in correlation.binned_pearson(p).collect()}
    assert got[0.0]["pearson_r"] is None and got[0.0]["mean_log_ratio"] is None and got[0.0]["n_pairs"] == 2
    assert got[0.1]["pearson_r"] is None and got[0.1]["mean_log_ratio"] == 1.0
    assert got[0.2]["pearson_r"] == pytest.approx(1) and got[0.5]["n_pairs"] == 0


def test_ranks_keep_pair_order_in_ties(spark):
    p = made(spark, [(3, 4, "c", "d", 0.5, 2.0, "correct"), (0, 2, "a", "c", 0.5, 0.0, "correct"), (0, 1, "a", "b", 0.5, 2.0, "censored"), (1, 2, "b", "c", 0.9, 0.0, "correct"), (5, 6, "e", "f", None, 1.0, "excluded")])
    got = [(r["pos1"], r["pos2"]) for r in cliffs.ranked(p).orderBy("rank").collect()]
    assert got == [(1, 2), (0, 1), (0, 2), (3, 4)]
    rows = {r["percent_rank"]: r for r in cliffs.rank_curve(p).collect()}
    assert rows[1]["n_pairs"] == 1 and rows[30]["n_pairs"] == 2 and rows[100]["cumulative_fraction"] == 1.0 and rows[50]["cumulative_fraction"] == 0.5


def test_curves_are_monotone(spark):
    rng = np.random.default_rng(0)
    p = curve(spark, rng.random(500).tolist(), (2 * rng.random(500)).tolist())
    n = [r["n_pairs"] for r in cliffs.cliff_fractions(p).orderBy("similarity_threshold").collect()]
    assert n == sorted(n, reverse=True)
    f = [r["cumulative_fraction"] for r in cliffs.rank_curve(p).orderBy("percent_rank").collect()]
    assert f == sorted(f) and f[-1] == 1


def test_lists_and_missing_pairs(spark):
    c = table(spark)
    p = pairs.pair_table(c, "cosine")
    assert pairs.missing_pairs(c, p.filter("pos1 <> 0 OR pos2 <> 3")).collect()[0].asDict() == {"pos1": 0, "pos2": 3}
    listed = spark.createDataFrame([("a-2", "a-1"), ("a-1", "a-2"), ("zz", "a-1"), (None, "a-1")], "id1 string, id2 string")
    assert pairs.listed_pairs(p, listed).count() == 1
    assert [(r["pos1"], r["pos2"]) for r in pairs.group_pairs(p).collect()] == [(0, 1)]


def test_trim_and_center(spark):
    rows = [(0, [5.0, 1.0, 5.0]), (1, [7.0, 1.0, 7.0])]
    df = spark.createDataFrame(rows, "pos long, embedding array<double>")
    assert [r["embedding"] for r in compounds.trim(df, 1).orderBy("pos").collect()] == [[5.0, 1.0, 0.0], [7.0, 1.0, 0.0]]
    assert [r["embedding"] for r in compounds.center(df).orderBy("pos").collect()] == [[-1.0, 0.0, -1.0], [1.0, 0.0, 1.0]]
    twice = df.unionByName(df.withColumn("pos", F.col("pos") + 10)).withColumn("compound_id", (F.col("pos") % 10).cast("string"))
    assert sorted(r["pos"] for r in compounds.keep_first(twice).collect()) == [0, 1]


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 2, 3, 4, 4)], "x double")
    got = stats.histogram(df, "x", 4).orderBy("bin").collect()
    want, edges = np.histogram([0, 0, 1, 2, 3, 4, 4], 4)
    assert [r["n"] for r in got] == want.tolist() and [r["lower"] for r in got] == edges[:-1].tolist()
    one = stats.histogram(df.filter("x = 1"), "x", 2).orderBy("bin").collect()
    assert [r["n"] for r in one] == np.histogram([1.0], 2)[0].tolist()


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "a int, b int, dist float, dpa float")


PATH = [(0, 1, 0.1, 0.4), (1, 2, 0.1, 0.4), (2, 3, 0.1, 0.4), (0, 3, 0.1, 1.2)]


def test_a_path_of_small_steps_makes_a_cliff_reducible(spark):
    got = {r["level"]: r for r in graph.irreducibility(edge_table(spark, PATH), 4, degrees=(2.0,)).collect()}
    assert got[1.0]["n_cliffs"] == 1 and got[1.0]["fraction"] == 0 and got[0.3]["fraction"] == 1
    broken = graph.irreducibility(edge_table(spark, [PATH[0], *PATH[2:]]), 4, degrees=(2.0,)).filter("level = 1").first()
    assert broken["fraction"] == 1


def test_both_curves_agree(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, j, float(np.float32(rng.random())), float(np.float32(2 * rng.random()))) for i in range(14) for j in range(i + 1, 14)]
    e = edge_table(spark, rows)
    n = 0

    def keep(df):
        nonlocal n
        n += 1
        df.write.parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    found = [sorted(map(tuple, t.select("degree_target", "level", "n_pairs", "n_cliffs", "degree", "fraction").collect()), key=str) for t in (graph.irreducibility(e, 14, degrees=(1.0, 3.0, 6.0)), graph.irreducibility_large(e, 14, keep, degrees=(1.0, 3.0, 6.0)))]
    assert found[0] == found[1] and len(found[0]) == 9


def test_levels_compare_as_floats(spark):
    e = edge_table(spark, [(0, 1, 0.1, 0.7), (1, 2, 0.1, 0.7), (0, 2, 0.1, 2.0)])
    got = graph.irreducibility(e, 3, degrees=(2.0,), levels=(0.7,)).filter("level = 0.7").first()
    assert got["fraction"] == 1  # 0.7 is not below 0.7


def test_forests_agree_and_persistence(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, j, float(np.float32(round(rng.random(), 1))), 0.5) for i in range(12) for j in range(i + 1, 12) if (i < 6) == (j < 6)]
    e = edge_table(spark, rows)
    n = 0

    def keep(df):
        nonlocal n
        n += 1
        df.write.parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    one = sorted(r["dist"] for r in graph.spanning_forest(e).collect())
    two = sorted(r["dist"] for r in graph.forest_rounds(e, keep).collect())
    assert one == two and len(one) == 10
    d = graph.persistence(graph.spanning_forest(e), 12).collect()
    assert sum(math.isinf(r["death"]) for r in d) == 2 and sum(not math.isinf(r["death"]) for r in d) == sum(x > 0 for x in one)
    betti = graph.betti_curve(graph.spanning_forest(e), 12, spark.createDataFrame([(0.0,), (2.0,)], "scale float")).collect()
    assert {r["scale"]: r["n_components"] for r in betti}[2.0] == 2


def test_degrees_round_half_even(spark):
    e = edge_table(spark, [(0, i, i / 10, 0.1) for i in range(1, 8)])
    got = {round(r["scale"], 3): r["degree_target"] for r in graph.degree_scales(e, 5, (1.0, 1.4, 0.1)).collect()}
    assert got == {0.2: 1.0, 0.4: 1.4, 0.1: 0.1}  # 2.5 edges round to 2


def test_half_crossing(spark):
    schema = "level double, degree double, scale double, fraction double"
    rows = [(1.0, 1.0, 0.1, 1.0), (1.0, 100.0, 0.3, 0.0), (0.5, 1.0, 0.1, 0.9), (0.5, 2.0, 0.2, 0.8), (0.3, 1.0, 0.1, 0.1), (0.3, 2.0, 0.2, 0.0), (0.2, 1.0, 0.1, 0.5), (0.2, 2.0, 0.2, 0.4), (0.1, 1.0, 0.1, 0.7)]
    got = {r["level"]: r for r in graph.half_dissolution(spark.createDataFrame(rows, schema)).collect()}
    assert got[1.0]["degree"] == pytest.approx(10) and got[1.0]["scale"] == pytest.approx(0.2) and got[1.0]["outside"] is None
    assert got[0.5]["outside"] == "above" and got[0.3]["outside"] == "below" and got[0.2]["degree"] == 1.0 and 0.1 not in got


def test_dice_and_best(spark):
    empty = made(spark, [])
    assert runs.dice(empty, empty).first()["dice"] is None
    a = made(spark, [(0, 1, "x", "y", 1.0, 1.0, "correct"), (0, 2, "x", "z", 1.0, 1.0, "correct")])
    b = made(spark, [(1, 0, "y", "x", 1.0, 1.0, "correct")])
    assert runs.dice(a, b).first()["dice"] == pytest.approx(2 / 3)
    m = spark.createDataFrame([("p", 0, "kww_b", 1.0), ("q", 1, "kww_b", 1.0), ("p", 0, "fraction_c", 2.0), ("q", 1, "fraction_c", 1.0)], "run string, run_order int, category string, value double")
    best = {r["category"]: (r["best"], r["worst"]) for r in runs.best_and_worst(m).collect()}
    assert best == {"kww_b": ("p", "p"), "fraction_c": ("q", "p")}
    assert {r["run"]: (r["n_best"], r["n_worst"]) for r in runs.win_counts(runs.best_and_worst(m)).collect()} == {"p": (1, 2), "q": (1, 0)}


def test_hubs(spark):
    rows = [(i, j, f"n{i}", f"n{j}", abs(i - j) / 10) for i in range(5) for j in range(i + 1, 5)]
    p = spark.createDataFrame(rows, "pos1 long, pos2 long, id1 string, id2 string, distance_scaled double")
    got = {r["compound_id"]: r["in_degree"] for r in geometry.hubs(p, 1).collect()}
    assert got == {"n0": 1, "n1": 2, "n2": 1, "n3": 1, "n4": 0}  # ties go to the smaller id
