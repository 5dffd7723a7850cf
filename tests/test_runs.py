import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.functions.featurizers import check_reuse, featurize
from scarp.operators import plotdata, probe
from scarp.plans import pipelines, queries
from scarp.sources import datasets, sinks

SF = "/root/testdata/sf0.001"


def csv(tmp_path, n=300):
    path = tmp_path / "molecules.csv"
    rows = [f"C{'CN'[i % 2] * (i % 9)}O{i % 13},{'' if i == 5 else 'x' if i == 6 else 1 + i % 90}" for i in range(n)]
    path.write_text("smiles,activity\n" + "\n".join(rows) + "\n")
    return path, rows


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    path, rows = csv(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = datasets.read_compounds(spark, datasets.resolve({"dataset": str(path)})).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["pos"] for r in got] == list(range(len(rows))) and [r["structure"] for r in got] == [x.split(",")[0] for x in rows]
    assert got[5]["activity"] is None and got[6]["activity"] is None and got[7]["log_activity"] is not None


def test_resolution():
    known = {"D": {"activity": "a.csv", "mmp": "m.csv", "unit": "uM", "censor_threshold": 99, "smiles_column": "S"}}
    got = datasets.resolve({"dataset": "D"}, known)
    assert (got.path, got.listed_path, got.unit, got.censor_threshold, got.structure_column) == ("a.csv", "m.csv", "uM", 99, "S")
    assert datasets.resolve({"dataset": "D", "censor_threshold": None, "mmp_file": ""}, known).censor_threshold is None
    with pytest.raises(ValueError):
        datasets.resolve({"dataset": "D", "unit": None}, known)
    with pytest.raises(ValueError):
        datasets.resolve({})
    assert datasets.dataset_name("x/y.csv") == "y"
    assert datasets.raw_url("https://github.com/a/b/blob/c/d.csv") == "https://raw.githubusercontent.com/a/b/c/d.csv" and datasets.raw_url("x") == "x"


def test_lists_in_both_spellings(spark, tmp_path):
    for a, b in (("smiles1", "smiles2"), ("smiles_1", "smiles_2")):
        (tmp_path / f"{a}.csv").write_text(f"{a},{b},x\nC, N ,1\n,C,2\n")
        assert [tuple(r) for r in datasets.read_listed(spark, str(tmp_path / f"{a}.csv")).collect()] == [("C", "N")]
    with pytest.raises(ValueError):
        datasets.read_listed(spark, str(csv(tmp_path)[0]))


def test_json_and_identity(tmp_path):
    sinks.write_json(tmp_path / "x" / "y.json", {"a": float("nan"), "b": [float("inf"), 1]})
    assert json.loads((tmp_path / "x" / "y.json").read_text()) == {"a": None, "b": [None, 1]}
    assert sinks.run_id({"a": 1, "b": 2}) == sinks.run_id({"b": 2, "a": 1}) and len(sinks.run_id({})) == 8


def test_reuse_of_vectors():
    assert check_reuse(["morgan"], {"n_bits": 1024}, "morgan", {"n_bits": 1024}) and not check_reuse([], {}, "morgan", {})
    assert check_reuse(["maccs"], {"n_bits": 1}, "maccs", {"n_bits": 2})
    with pytest.raises(ValueError):
        check_reuse(["morgan"], {"n_bits": 1024}, "morgan", {"n_bits": 2048})


def test_embed_analyze_compare(spark, tmp_path):
    path, _ = csv(tmp_path, 120)
    base = {"dataset": str(path), "embedding_method": "hashed_ngrams", "n_bits": 64, "output_dir": str(tmp_path / "out"), "censor_threshold": 80, "mmp_file": str(tmp_path / "none.csv")}
    stored = pipelines.embed(spark, base | {"methods": ["hashed_ngrams"], "umap": False, "output_file": str(tmp_path / "e.parquet")})
    assert spark.read.parquet(stored).count() > 50
    embedded = json.loads(Path(f"{stored}.summary.json").read_text())
    assert {"mixture", "log_ratio", "log_ratio_kww", "hashed_ngrams"} <= embedded.keys() and len(spark.read.parquet(f"{stored}.plots/hashed_ngrams/pca2").first()["pc"]) == 2
    folders = [pipelines.analyze(spark, base | {"distance_metric": m}) for m in ("tanimoto", "hamming")]
    folders.append(pipelines.analyze(spark, base | {"distance_metric": "cosine", "embeddings_file": stored, "center": True, "large_coords_to_trim": 2}))
    for f in folders:
        s = json.loads(Path(f, "summary.json").read_text())
        assert sum(s["status"].values()) == s["n_compounds"] * (s["n_compounds"] - 1) // 2 and Path(f, "report.md").read_text().startswith("# molecules")
        assert s["universe"]["n_compounds"] == s["n_compounds"] and s["dip"]["label"] in ("unimodal", "multimodal") and s["zero"]["n_valid"] > 0
        assert {"n_total_pairs", "fraction_cliffs", "kww_fit", "zero_fraction"} <= s["subsets"]["group"].keys() and s["subsets"]["listed"]["error"] == "file_not_found"
        assert {p.name for p in Path(f, "plots").iterdir()} >= {"cliff_fractions", "slope_density", "slope_heatmap", "log_slopes", "distance_models", "group_panels"}
        keys = json.loads(Path(f, "matrices", "matrix_keys.json").read_text())
        assert np.load(Path(f, "matrices", "similarity.npy")).shape == (len(keys), len(keys)) == (s["n_compounds"],) * 2
        ranks = spark.read.parquet(f"{f}/cliffs_by_rank").filter("percent_rank <= 5").count()
        assert ranks == spark.read.parquet(f"{f}/top_cliffs").count()
    best = pipelines.compare(spark, [*folders, str(tmp_path / "nothing")], str(tmp_path / "cmp"))
    assert best.count() >= 8 and spark.read.parquet(f"{tmp_path}/cmp/dice_top5pct").count() == 3
    for name in ("configurations", "structure", "cliffs", "cliffs_best", "correlation", "subset_group", "subset_listed", "irreducibility", "landscape_norms"):
        assert spark.read.parquet(f"{tmp_path}/cmp/{name}").count() >= 3, name
    assert len({r["run"] for r in spark.read.parquet(f"{tmp_path}/cmp/structure").collect()}) == 3
    assert "## structure" in Path(tmp_path, "cmp", "report.md").read_text()
    with pytest.raises(ValueError):
        pipelines.analyze(spark, base | {"distance_metric": "tanimoto", "similarity_threshold": 1.5})


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError):
        featurize(spark.createDataFrame([("C",)], "structure string"), ["nope"])


def test_plot_tables(spark):
    p = queries.pair_table(spark, SF)
    assert plotdata.distance_histogram(p).count() == 50 and plotdata.heatmap_limit(p).first()["limit"] > 0
    cdf = [r["value"] for r in plotdata.empirical_cdf(p, "similarity").orderBy("quantile").collect()]
    assert cdf == sorted(cdf) and plotdata.normal_quantiles(p, "log_ratio").count() == 200 and plotdata.histogram_bins(30) == 10


def test_pair_classifier(spark):
    vectors = probe.reduced(queries.compound_table(spark, SF), 4)
    p = queries.pair_table(spark, SF).filter(F.col("pos2") < 120)
    got = probe.auc(probe.pair_features(p, vectors))
    assert set(got) == {"logistic", "perceptron", "nearest", "control_neighbour_rate", "control_permuted"} and all(0 <= v <= 1 for v in got.values())
    assert len(probe.pair_features(p, vectors, half="sum").first()["features"]) == 4
    assert set(probe.auc(probe.pair_features(p.filter("log_ratio < 1"), vectors)).values()) == {None}


def test_nearest_pairs_decide(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(f"a{i}", f"b{i}", Vectors.dense([float(i % 2), 0.1 * i]), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, ["id1", "id2", "features", "label"])
    got = probe.nearest(df, df, k=1).collect()
    assert len(got) == 40 and all(r["rawPrediction"] == r["label"] for r in got)


def test_downloads_are_kept(tmp_path, monkeypatch):
    source = tmp_path / "a b.csv"
    source.write_text("x")
    got = datasets._download(source.as_uri(), tmp_path / "data")
    source.write_text("y")
    assert got.read_text() == "x" and datasets._download(source.as_uri(), tmp_path / "data") == got and got.read_text() == "x"
    assert datasets.fetched("local.csv") == "local.csv" and not list((tmp_path / "data").glob("*.part"))


def test_encoders_load_once_and_optional_ones_keep_rows(spark, monkeypatch):
    from scarp.functions import featurizers

    monkeypatch.setattr(featurizers, "FEATURIZERS", dict(featurizers.FEATURIZERS))
    monkeypatch.setattr(featurizers, "OPTIONAL", {"maybe"})
    for name in ("sure", "maybe"):
        featurizers.register_encoder(name, lambda: lambda texts: [None if t == "bad" else [len(t), 1] for t in texts])
    df = spark.createDataFrame([("abc",), ("bad",), (None,)], "structure string")
    assert [r["sure"] for r in featurizers.featurize(df, ["sure"]).collect() if r["structure"]] == [[3.0, 1.0]]
    assert featurizers.featurize(df, ["maybe"]).count() == 3


def test_stored_vectors_are_reused_by_their_options(spark, tmp_path, monkeypatch):
    path, _ = csv(tmp_path, 30)
    monkeypatch.setattr(pipelines, "EMBEDDINGS", str(tmp_path))
    base = {"dataset": str(path), "embedding_method": "hashed_ngrams", "n_bits": 16}
    pipelines.embed(spark, base | {"methods": ["hashed_ngrams"]})
    assert len(pipelines.load(spark, base | {"n_bits": 32})[0].first()["embedding"]) == 16  # only circular fingerprints depend on them
    with pytest.raises(ValueError):
        pipelines.load(spark, base | {"embeddings_file": f"{tmp_path}/molecules.parquet", "embedding_method": "morgan"})


def test_a_pair_list_is_read_or_its_fault_recorded(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert pipelines._listed(spark, str(tmp_path / "bad.csv"))[1]["error"] == "missing_columns" and pipelines._listed(spark, None) == (None, None)


def test_landscapes(spark):
    from scarp.operators import graph

    diagram = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0), (0.0, 0.5), (0.0, float("inf"))], "birth double, death double")
    got = {(r["layer"], round(r["t"], 6)): r["value"] for r in graph.landscape(diagram, steps=5, layers=3).collect()}
    assert [got[1, t] for t in (0, 0.25, 0.5, 0.75, 1)] == [0, 0.25, 0.5, 0.25, 0] == [got[2, t] for t in (0, 0.25, 0.5, 0.75, 1)]
    assert [got[3, t] for t in (0, 0.25, 0.5)] == [0, 0.25, 0]
    two = spark.createDataFrame([(r, k, t, v * f) for r, f in (("a", 1.0), ("b", 3.0)) for (k, t), v in got.items()], "run string, layer int, t double, value double")
    norms = {r["run"]: r["norm"] for r in graph.landscape_norms(two).collect()}
    assert norms["b"] == pytest.approx(3 * norms["a"])
    assert graph.landscape_distances(two).first()["distance"] == pytest.approx(2 * sum(v * v for v in got.values()) ** 0.5)


def test_embed_fits_the_mixture_to_all_values(spark, tmp_path):
    path = tmp_path / "many.csv"
    n = 100_500
    path.write_text("smiles,activity\n" + "\n".join(f"C{i},{1 + i % 90}" for i in range(n)) + "\n")
    stored = pipelines.embed(spark, {"dataset": str(path), "methods": ["hashed_ngrams"], "n_bits": 8, "output_file": str(tmp_path / "e.parquet"), "log_ratios": False, "umap": False})
    assert json.loads(Path(f"{stored}.summary.json").read_text())["mixture"]["n_values"] == n


def test_matrices_of_any_size_are_filled_by_tasks(spark, tmp_path):
    from scarp.sources import sinks

    rows = [(f"c{i:03d}", f"c{j:03d}", float(i * 100 + j), None if (i + j) % 7 == 0 else i - j + 0.5) for i in range(70) for j in range(i + 1, 70) if (i, j) != (3, 9)]
    pairs = spark.createDataFrame([(b, a, x, y) if k % 3 == 0 else (a, b, x, y) for k, (a, b, x, y) in enumerate(rows)], "id1 string, id2 string, d double, s double").repartition(6)
    ids = sinks.write_matrices(pairs, f"file://{tmp_path}/m", {"distance": "d", "similarity": "s"}, band=8)
    d, s = (np.load(tmp_path / "m" / f"{k}.npy", mmap_mode="r") for k in ("distance", "similarity"))
    assert isinstance(d, np.memmap) and d.shape == s.shape == (70, 70) and json.loads((tmp_path / "m" / "matrix_keys.json").read_text()) == ids == sorted(ids)
    want = np.full((2, 70, 70), np.nan)
    for k in (0, 1):
        np.fill_diagonal(want[k], 0)
    for a, b, x, y in rows:
        i, j = int(a[1:]), int(b[1:])
        want[0, i, j] = want[0, j, i] = x
        want[1, i, j] = want[1, j, i] = np.nan if y is None else y
    np.testing.assert_array_equal(d, want[0])
    np.testing.assert_array_equal(s, want[1])
    assert not list(tmp_path.glob("m/*.part"))
    assert sinks.write_matrices(pairs.limit(0), tmp_path / "e", {"distance": "d"}) == [] and np.load(tmp_path / "e" / "distance.npy").shape == (0, 0)
