import xml.etree.ElementTree as ET

from scarp.sources import figures

SVG = "{http://www.w3.org/2000/svg}"


def marks(svg, kind):
    return [e for e in ET.fromstring(svg).iter() if e.get("class") == kind]


def test_points_and_curves():
    svg = figures.draw([{"x": 0.0, "y": 1.0, "fitted": 1.5}, {"x": 1.0, "y": 3.0, "fitted": None}, {"x": 2.0, "y": None, "fitted": 2.5}], "points", "x", "y", None, "a < b")
    points, (curve,) = marks(svg, "point"), marks(svg, "curve")
    assert [(p.get("cx"), p.get("cy")) for p in points] == [("56.0", "364.0"), ("342.0", "28.0")]
    assert curve.get("points") == "56.0 280.0 628.0 112.0" and marks(svg, "name")[0].text == "fitted" and "a &lt; b" in svg


def test_bars_in_panels():
    rows = [{"measure": m, "lower": float(i), "upper": i + 1.0, "n": i * k} for k, m in enumerate("ab", 1) for i in range(4)]
    svg = figures.draw(rows, "bars", "lower", "n", "measure")
    bars = marks(svg, "bar")
    assert len(bars) == 8 and len(marks(svg, "axis")) == 2 and [float(b.get("height")) for b in bars[:4]] == [0, 112, 224, 336]


def test_grid_counts_and_means(spark):
    rows = [(0.0, 0.0, 2.0), (0.1, 0.1, 4.0), (9.9, 9.9, 1.0), (10.0, 10.0, None), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, v double")
    got = {(r["a"], r["b"]): r["shade"] for r in figures.on_grid(df, "a", "b", None, 10).collect()}
    assert got == {(0.0, 0.0): 2.0, (9.0, 9.0): 2.0}
    cells = [r.asDict() for r in figures.on_grid(df, "a", "b", "v", 10).collect()]
    assert {(r["a"], r["shade"]) for r in cells} == {(0.0, 3.0), (9.0, 1.0)}
    assert len(marks(figures.draw(cells, "grid", "a", "b"), "cell")) == 2
    assert figures.on_grid(df.limit(0), "a", "b", None).count() == 0


def test_nothing_to_draw_and_ticks():
    assert marks(figures.draw([], "bars", "lower", "n"), "bar") == [] and marks(figures.draw([{"x": 1.0, "y": 1.0}], "line", "x", "y"), "curve")
    assert figures.ticks(0, 1) == [0, 0.2, 0.4, 0.6, 0.8, 1.0] and figures.ticks(3, 3) == [3] and figures.ticks(-12, 47) == [0, 20, 40]
    assert figures.ticks(0.13, 0.27) == [0.15, 0.2, 0.25]


def test_files_for_each_known_table(spark, tmp_path):
    spark.createDataFrame([(0.1, 0.2), (0.4, 0.9)], "quantile double, value double").write.parquet(str(tmp_path / "distance_cdf"))
    spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.7)], "pos1 long, pos2 long, slope double").write.parquet(str(tmp_path / "slope_heatmap"))
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "unknown"))
    assert figures.write_figures(spark, tmp_path) == ["distance_cdf", "slope_heatmap"]
    assert len(marks((tmp_path / "slope_heatmap.svg").read_text(), "cell")) == 2 and not (tmp_path / "unknown.svg").exists()
