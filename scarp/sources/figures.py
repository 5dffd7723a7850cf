"""Drawings of plot tables as SVG files.

Curves, points and bars have few rows whatever the number of pairs. A table of pairs is first
counted on a grid of fixed size by Spark, so a drawing never holds more than that.
"""

from __future__ import annotations

import math
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT, MARGIN, GRID = 640, 420, 56, 64
#: Colours of series, one after the other, that remain apart for most colour-blind readers.
COLOURS = ("#0072b2", "#d55e00", "#009e73", "#cc79a7", "#e69f00", "#56b4e9", "#000000")
#: What each plot table shows: how it is drawn, x, y (further numeric columns are curves), and what parts it into panels.
SHOWN = {
    "cliff_fractions": ("points", "x", "y", None), "cumulative_share": ("points", "x", "y", None), "slope_density": ("points", "x", "y", None), "log_ratio": ("points", "x", "y", None),
    "distance_models": ("points", "center", "density", None), "distance_beta": ("points", "center", "density", None), "log_slope_quantiles": ("points", "theory", "sample", None),
    "activity_quantiles": ("points", "theory", "sample", None), "distance_cdf": ("line", "value", "quantile", None), "threshold_accuracy": ("line", "similarity_threshold", "accuracy", None),
    "distance_histogram": ("bars", "lower", "n", None), "activity": ("bars", "lower", "n", None), "log_ratio_histogram": ("bars", "lower", "n", None), "log_slopes": ("bars", "lower", "n", "bin_lower"),
    "group_panels": ("bars", "lower", "n", "measure"), "listed_panels": ("bars", "lower", "n", "measure"), "slope_heatmap": ("grid", "pos1", "pos2", "slope"),
    "similarity_and_ratio": ("grid", "similarity", "log_ratio", None), "umap": ("grid", "x", "y", "log_activity"),
}


def ticks(low: float, high: float, about: int = 5) -> list[float]:
    """Round numbers from low to high."""
    if not high > low:
        return [low]
    step = 10 ** math.floor(math.log10((high - low) / about))
    step *= next(m for m in (1, 2, 5, 10) if (high - low) / (step * m) <= about)
    first = math.ceil(low / step - 1e-9)
    return [round(k * step, 12) for k in range(first, math.floor(high / step + 1e-9) + 1)]


class _Panel:
    """One pair of axes; data places become places in the drawing."""

    def __init__(self, left: float, width: float, xs: list[float], ys: list[float]):
        self.box = (left + MARGIN, MARGIN / 2, left + width - 12, HEIGHT - MARGIN)
        self.x, self.y = ((min(v), max(v)) if v else (0.0, 1.0) for v in (xs, ys))
        self.x, self.y = ((a - 0.5, b + 0.5) if a == b else (a, b) for a, b in (self.x, self.y))
        self.marks: list[str] = []

    def at(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d = self.box
        return round(a + (x - self.x[0]) / (self.x[1] - self.x[0]) * (c - a), 2), round(d - (y - self.y[0]) / (self.y[1] - self.y[0]) * (d - b), 2)

    def axes(self, x_name: str, y_name: str, title: str) -> list[str]:
        a, b, c, d = self.box
        out = [f'<path class="axis" d="M{a} {b}V{d}H{c}" fill="none" stroke="#333"/>']
        for v in ticks(*self.x):
            p = self.at(v, self.y[0])[0]
            out.append(f'<path d="M{p} {d}v4" stroke="#333"/><text x="{p}" y="{d + 16}" text-anchor="middle">{v:g}</text>')
        for v in ticks(*self.y):
            p = self.at(self.x[0], v)[1]
            out.append(f'<path d="M{a} {p}h-4" stroke="#333"/><text x="{a - 7}" y="{p + 4}" text-anchor="end">{v:g}</text>')
        out.append(f'<text x="{(a + c) / 2}" y="{d + 34}" text-anchor="middle">{escape(x_name)}</text><text x="{a}" y="{b - 8}">{escape(f"{title} {y_name}".strip())}</text>')
        return out


def _fine(*values) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


def _curve(panel: _Panel, rows: list[tuple[float, float]], colour: str) -> str:
    places = " ".join("{} {}".format(*panel.at(x, y)) for x, y in sorted(rows))
    return f'<polyline class="curve" points="{places}" fill="none" stroke="{colour}" stroke-width="1.5"/>' if rows else ""


def draw(rows: list[dict], kind: str, x: str, y: str, part: str | None = None, title: str = "") -> str:
    """An SVG drawing of a plot table's rows; rows without a number to show have no mark.

    points: y over x as circles and every further numeric column as a curve; line: y over x; bars: y from each lower to its upper end;
    grid: cells (x, y, each as wide as dx, dy) in a shade of `part`. points and bars make a panel for each value of `part`.
    """
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[part] if part and kind != "grid" else None, []).append(r)
    groups = groups or {None: []}
    body, width = [], WIDTH / len(groups) if len(groups) < 3 else WIDTH / 2
    for i, (name, own) in enumerate(sorted(groups.items(), key=lambda g: str(g[0]))):
        more = [c for c in (own[0] if own else {}) if kind == "points" and c not in (x, y, part) and not isinstance(own[0][c], str)]
        xs = [r[c] for r in own for c in ((x, "upper") if kind == "bars" else (x,)) if _fine(r[c])]
        ys = [r[c] for r in own for c in (y, *more) if _fine(r[c])] + ([0.0] if kind == "bars" else [])
        if kind == "grid":
            xs, ys = xs + [r[x] + r["dx"] for r in own], ys + [r[y] + r["dy"] for r in own]
        p = _Panel(i * width, width, xs, ys)
        if kind == "grid":
            shades = [r["shade"] for r in own if _fine(r["shade"])]
            low, high = (min(shades), max(shades)) if shades else (0.0, 1.0)
            for r in own:
                if _fine(r["shade"]):
                    (a, b), (c, d) = p.at(r[x], r[y] + r["dy"]), p.at(r[x] + r["dx"], r[y])
                    light = 92 - 70 * ((r["shade"] - low) / (high - low) if high > low else 1.0)
                    p.marks.append(f'<rect class="cell" x="{a}" y="{b}" width="{c - a:.2f}" height="{d - b:.2f}" fill="hsl(205,70%,{light:.0f}%)"/>')
        elif kind == "bars":
            for r in own:
                if _fine(r[x], r["upper"], r[y]):
                    (a, b), (c, d) = p.at(r[x], r[y]), p.at(r["upper"], 0.0)
                    p.marks.append(f'<rect class="bar" x="{a}" y="{b}" width="{max(c - a - 0.5, 0.1):.2f}" height="{d - b:.2f}" fill="{COLOURS[0]}"/>')
        elif kind == "line":
            p.marks.append(_curve(p, [(r[x], r[y]) for r in own if _fine(r[x], r[y])], COLOURS[0]))
        else:
            p.marks += ['<circle class="point" cx="{}" cy="{}" r="2.5" fill="{}"/>'.format(*p.at(r[x], r[y]), COLOURS[0]) for r in own if _fine(r[x], r[y])]
            for k, c in enumerate(more):
                colour = COLOURS[1 + k % (len(COLOURS) - 1)]
                p.marks.append(_curve(p, [(r[x], r[c]) for r in own if _fine(r[x], r[c])], colour))
                p.marks.append(f'<text class="name" x="{p.box[2]}" y="{p.box[1] + 14 * (k + 1)}" text-anchor="end" fill="{colour}">{escape(c)}</text>')
        body += p.axes(x, y, str(name) if name is not None else title) + p.marks
    total = max(WIDTH, round(width * len(groups)))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{total}" height="{HEIGHT}" viewBox="0 0 {total} {HEIGHT}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<rect width="{total}" height="{HEIGHT}" fill="white"/>', *[b for b in body if b], "</svg>"])


def on_grid(df: DataFrame, x: str, y: str, shade: str | None, cells: int = GRID) -> DataFrame:
    """x, y (lower ends), dx, dy, shade: the mean of a column (or the number of rows) in each of cells x cells that holds rows."""
    held = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(shade).cast("double") if shade else F.lit(1.0)).alias("s")).filter("x IS NOT NULL AND y IS NOT NULL")
    ends = held.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("a", F.min), ("b", F.max))])
    width = lambda c: F.when(F.col(f"b{c}") > F.col(f"a{c}"), (F.col(f"b{c}") - F.col(f"a{c}")) / cells).otherwise(1.0)
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"a{c}")) / width(c)), F.lit(cells - 1))
    placed = held.crossJoin(F.broadcast(ends)).select((F.col("ax") + cell("x") * width("x")).alias(x), (F.col("ay") + cell("y") * width("y")).alias(y), width("x").alias("dx"), width("y").alias("dy"), "s")  # one row
    return placed.groupBy(x, y, "dx", "dy").agg((F.avg("s") if shade else F.count("*").cast("double")).alias("shade"))


def write_figures(spark: SparkSession, folder: str | Path) -> list[str]:
    """An SVG file beside each plot table of a folder that SHOWN knows; the names of those drawn."""
    drawn = []
    for path in sorted(Path(folder).iterdir()):
        if path.is_dir() and path.name in SHOWN:
            kind, x, y, part = SHOWN[path.name]
            df = spark.read.parquet(str(path))
            rows = [r.asDict() for r in (on_grid(df, x, y, part) if kind == "grid" else df).collect()]  # of a size that the plot table's kind fixes
            path.with_suffix(".svg").write_text(draw(rows, kind, x, y, part, path.name.replace("_", " ")))
            drawn.append(path.name)
    return drawn
