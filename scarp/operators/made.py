"""Statistics of all valid pairs where these are made: tasks sum up what their pairs of blocks hold, and no pair becomes a row.

`ValidPairs` yields the pairs of pairs.met_blocks() as arrays; the tables that come of it are those of the operators of the same
names on a pair table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp.functions import fits
from scarp.functions.metrics import get_metric

from . import correlation, stats
from .pairs import valid_tiles

#: Log ratios are summed up less this, so that squares do not cancel.
_ABOUT = 0.5


class Tile(NamedTuple):
    """The valid pairs of some compounds with some others, as scale_pairs() has them; who is that of valid_tiles()."""

    raw: np.ndarray
    scaled: np.ndarray
    similarity: np.ndarray
    ratio: np.ndarray
    who: tuple


def slope(t: Tile) -> np.ndarray:
    """As correlation.lipschitz()."""
    return t.ratio / np.maximum(1 - t.similarity, correlation.REGULARIZATION)


def similarities(t: Tile) -> np.ndarray:
    return t.similarity


def scaled(t: Tile) -> np.ndarray:
    return t.scaled


def raw(t: Tile) -> np.ndarray:
    return t.raw


class ValidPairs:
    """The valid pairs of met_blocks(); all activities are known. `ends` is what scaling.cutoff_of() gives, for metrics without a bound."""

    def __init__(self, met: DataFrame, metric: str, ends: tuple[float, float] | None = None):
        self.met, self.metric, self.ends, self.bound = met, metric, ends, get_metric(metric).upper_bound

    def tiles(self) -> Callable[..., Iterator[Tile]]:
        """Batches to tiles."""
        metric, bound, ends = self.metric, self.bound, self.ends

        def run(batches):
            for d, ratio, who in valid_tiles(batches, metric):
                if not len(d):
                    continue
                if bound is not None:
                    x = np.minimum(np.maximum(d, 0.0), bound) / bound
                else:
                    largest = min(ends)
                    x = np.where(d > ends[0], 1.0, np.minimum(d, ends[0]) / largest if largest else 0.0)
                yield Tile(d, x, 1 - x, ratio, who)

        return run

    def values(self, of: Callable) -> Callable:
        """Batches to batches of v: `of` each tile."""
        tiles = self.tiles()

        def run(batches):
            for t in tiles(batches):
                yield pa.RecordBatch.from_arrays([pa.array(of(t))], ["v"])

        return run

    def quantiles(self, of: Callable, points: Sequence[float]) -> list[float | None]:
        return stats.made_quantiles(self.met, self.values(of), points)

    def summed(self, rows: int, add: Callable, columns: int) -> np.ndarray:
        """The sum over all tasks of a table of `rows` and `columns`, to which `add(table, tile)` adds a tile."""
        tiles = self.tiles()

        def run(batches):
            total = np.zeros((rows, columns))
            with np.errstate(invalid="ignore"):
                for t in tiles(batches):
                    add(total, t)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["t"])

        found = self.met.mapInArrow(run, "t array<double>")
        out = np.zeros((rows, columns))
        with np.errstate(invalid="ignore"):
            for r in found.collect():  # a row for each task
                out += np.array(r["t"]).reshape(rows, columns)
        return out


def _edges(bins: Sequence[tuple[float, float]]) -> np.ndarray:
    if any(a[1] != b[0] for a, b in zip(bins, bins[1:], strict=False)):
        raise ValueError("bins must follow each other")
    return np.array([bins[0][0], *[b for _, b in bins]])


def _places(similarity: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of the bin of each similarity, from 1 on; 0 and len(edges) are without. As stats.in_bin()."""
    place = np.searchsorted(edges, similarity, side="right")
    if edges[-1] == 1.0:
        place[similarity == 1.0] = len(edges) - 1
    return place


def bin_sums(pairs: ValidPairs, bins: Sequence[tuple[float, float]], value: Callable | None = None, tails: Sequence[float] = (), threshold: float = 1.0) -> dict[str, np.ndarray]:
    """For each bin: n, cliffs, the moments of the similarity (ms, ss) and of the log ratio (ml, vl), their covariance, and a share for each tail.

    `value(tile)` tells which pairs count and what stands for their log ratios.
    """
    edges = _edges(bins)
    middle = np.array([0.0, *[(a + b) / 2 for a, b in bins], 0.0])

    def add(total, t):
        similarity, ratio = t.similarity, t.ratio
        if value is not None:
            held, ratio = value(t)
            similarity = similarity[held]
        place = _places(similarity, edges)
        s, x = similarity - middle[place], ratio - _ABOUT
        size = len(middle)
        weights = (s, s * s, x, x * x, s * x)
        total[:, 0] += np.bincount(place, minlength=size)
        for k, w in enumerate(weights, 1):
            total[:, k] += np.bincount(place, w, minlength=size)
        for k, t in enumerate((threshold, *tails), 6):
            total[:, k] += np.bincount(place[~(ratio < t)], minlength=size)  # NaN is above all numbers

    t = pairs.summed(len(middle), add, 7 + len(tails))[1:-1]
    n = t[:, 0]
    with np.errstate(invalid="ignore", divide="ignore"):
        s, s2, x, x2, sx = (t[:, k] / n for k in range(1, 6))
        spread = lambda two, one: np.where(np.isnan(two - one * one), np.nan, np.maximum(two - one * one, 0.0))
        return {
            "n": n.astype(np.int64), "cliffs": t[:, 6].astype(np.int64), "ms": s + middle[1:-1], "ss": np.sqrt(spread(s2, s)), "ml": x + _ABOUT, "vl": spread(x2, x), "cov": sx - s * x,
            **{f"tail{k}": t[:, 7 + k] / n for k in range(len(tails))},
        }


def _medians(pairs: ValidPairs, many: Sequence[Sequence[tuple[float, float]]], value: Callable | None = None) -> dict[int, float]:
    """The median of the log ratio (or `value`) in each bin of several lists of bins, numbered one after the other."""
    edges = [_edges(bins) for bins in many]
    first = np.cumsum([0, *[len(bins) for bins in many]])
    tiles = pairs.tiles()

    def run(batches):
        for t in tiles(batches):
            similarity, ratio = t.similarity, t.ratio
            if value is not None:
                with np.errstate(invalid="ignore", divide="ignore"):
                    held, ratio = value(t)
                similarity = similarity[held]
            for own, start in zip(edges, first.tolist(), strict=False):
                place = _places(similarity, own)
                held = (place > 0) & (place < len(own))
                whole = held.all()
                yield pa.RecordBatch.from_arrays([pa.array((place if whole else place[held]) + (start - 1)), pa.array(ratio if whole else ratio[held])], ["g", "v"])

    return stats.made_group_quantiles(pairs.met, run, 0.5)


def _number(x) -> float | None:
    return None if x is None else float(x)


def binned_pearson(pairs: ValidPairs, width: float = 0.05) -> DataFrame:
    bins = stats.bin_edges(width)
    t, rows = bin_sums(pairs, bins), []
    for i, (a, b) in enumerate(bins):
        n, ss, sl = int(t["n"][i]), t["ss"][i], np.sqrt(t["vl"][i])
        r = float(t["cov"][i] / (ss * sl)) if n >= 3 and ss > 1e-10 and not sl <= 1e-10 else None
        rows.append((a, b, (a + b) / 2, n, r, *(float(t[c][i]) if n >= 3 else None for c in ("ms", "ml"))))
    return pairs.met.sparkSession.createDataFrame(rows, "bin_lower double, bin_upper double, bin_center double, n_pairs long, pearson_r double, mean_similarity double, mean_log_ratio double")


def cliff_probability(pairs: ValidPairs, threshold: float = 1.0, width: float = 0.05) -> DataFrame:
    edges = _edges(bins := stats.bin_edges(width))

    def add(total, t):
        place = _places(t.similarity, edges)
        total[:, 0] += np.bincount(place, minlength=len(total))
        total[:, 1] += np.bincount(place[~(t.ratio < threshold)], minlength=len(total))

    t = pairs.summed(len(edges) + 1, add, 2)[1:-1].astype(np.int64).tolist()
    rows = [(a, b, (a + b) / 2, n, c, c / n if n else 0.0) for (a, b), (n, c) in zip(bins, t, strict=True)]
    return pairs.met.sparkSession.createDataFrame(rows, "bin_lower double, bin_upper double, bin_center double, n_pairs long, n_cliffs long, cliff_probability double")


def conditional(pairs: ValidPairs, widths: Sequence[float], threshold: float = 1.0, tails: Sequence[float] = correlation.TAILS) -> DataFrame:
    """The rows of correlation.conditional_by_width(); all widths share one count of medians."""
    many = [stats.bin_edges(w) for w in widths]
    medians, rows, g = _medians(pairs, many), [], 0
    for w, bins in zip(widths, many, strict=True):
        t = bin_sums(pairs, bins, None, tails, threshold)
        for i, (a, b) in enumerate(bins):
            n, cliffs = int(t["n"][i]), int(t["cliffs"][i])
            moments = [float(x) if n else None for x in (t["ml"][i], t["vl"][i], np.sqrt(t["vl"][i]), *(t[f"tail{k}"][i] for k in range(len(tails))))]
            rows.append((w, a, b, n, cliffs, *moments, _number(medians.get(g)), cliffs / n if n else 0.0))
            g += 1
    names = ", ".join(f"{c} double" for c in ("mean_log_ratio", "variance_log_ratio", "std_log_ratio", *[f"tail_prob_{t:.1f}".replace(".", "_") for t in tails], "median_log_ratio", "conditional_probability"))
    return pairs.met.sparkSession.createDataFrame(rows, f"width double, interval_lower double, interval_upper double, n_pairs long, n_cliffs long, {names}")


def log_slope(t: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Which slopes are positive (NaN, above all numbers, is), and their logarithms."""
    x = slope(t)
    held = ~(x <= 0)
    return held, np.log(x[held])


def log_lipschitz(pairs: ValidPairs, bins: Sequence[tuple[float, float]] = correlation.SLOPE_BINS) -> DataFrame:
    t, medians, rows = bin_sums(pairs, bins, log_slope), _medians(pairs, [bins], log_slope), []
    for i, (a, b) in enumerate(bins):
        n = int(t["n"][i])
        rows.append((a, b, n, *(float(x) if n else None for x in (t["ml"][i], np.sqrt(t["vl"][i]))), _number(medians.get(i))))
    return pairs.met.sparkSession.createDataFrame(rows, "bin_lower double, bin_upper double, n_pairs long, mean_log double, std_log double, median_log double")


def _within(bound: float | None, of: Callable) -> Callable:
    """`of` a tile, values up to a bound only; NaN is above all numbers."""

    def run(t):
        v = of(t)
        return v if bound is None or np.isnan(bound) else v[v <= bound]

    return run


def ends_of(pairs: ValidPairs, of: Callable) -> tuple[float, float, int] | None:
    """Least, greatest (NaN above all numbers) and number of values; None without any."""
    make = pairs.values(of)

    def run(batches):
        lo, hi, n = np.inf, -np.inf, 0
        for batch in make(batches):
            v = batch.column(0).to_numpy()
            if len(v):
                lo, hi, n = float(np.fmin(lo, np.fmin.reduce(v))), float(np.maximum(hi, v.max())), n + len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (lo, hi, n)], ["lo", "hi", "n"])

    rows = pairs.met.mapInArrow(run, "lo double, hi double, n long").collect()  # a row for each task
    return (min(r["lo"] for r in rows), float(np.max([r["hi"] for r in rows])), sum(r["n"] for r in rows)) if rows else None


def histogram(pairs: ValidPairs, of: Callable, bins: int) -> list[tuple[int, float, float, int]]:
    """The rows of stats.histogram(): bin, lower, upper, n."""
    found = ends_of(pairs, of)
    if found is None:
        return []
    lo, hi, _ = found
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)

    def add(total, t):
        share = (of(t) - lo) / (hi - lo) * bins
        place = np.where(np.isnan(share), bins - 1, np.minimum(np.floor(share), bins - 1)).astype(np.int64)
        total[:, 0] += np.bincount(place, minlength=bins)

    n, width = pairs.summed(bins, add, 1)[:, 0].astype(np.int64).tolist(), (hi - lo) / bins
    return [(k, lo + k * width, lo + (k + 1) * width, n[k]) for k in range(bins)]


HISTOGRAM = "bin long, lower double, upper double, n long"


def density(pairs: ValidPairs, of: Callable, bins: int, q: float = 0.99) -> tuple[list[float], list[float], int]:
    """(centers, densities of the bins that hold something, number) of the values up to their q-quantile."""
    held = _within(pairs.quantiles(of, [q])[0], of)
    rows = histogram(pairs, held, bins)
    total = sum(r[3] for r in rows)
    return [(a + b) / 2 for _, a, b, n in rows if n], [n / total / (b - a) for _, a, b, n in rows if n], total


def rank_sums(pairs: ValidPairs, percents: Sequence[int], threshold: float = 1.0) -> tuple[int, list[float], dict]:
    """(number of pairs, the similarity at each percentage, counts around these) for cliffs.rank_curve()."""
    found = stats.made_ranks(pairs.met, pairs.values(similarities), lambda n: [n - math.ceil(n * p / 100.0) for p in percents])
    if found is None:
        return 0, [], {}
    levels = np.array(sorted(set(found[1])))

    def add(total, t):
        place = np.searchsorted(levels, t.similarity, side="left") + np.searchsorted(levels, t.similarity, side="right")
        total[:, 0] += np.bincount(place, minlength=len(total))
        total[:, 1] += np.bincount(place[~(t.ratio < threshold)], minlength=len(total))

    t = pairs.summed(2 * len(levels) + 1, add, 2).astype(np.int64).tolist()
    return found[0], found[1], {k: {"n": n, "cliffs": c} for k, (n, c) in enumerate(t)}


def beta_distance(pairs: ValidPairs, of: Callable, cut: float, bins: int = 100) -> dict | None:
    """As fitted.beta_distance()."""
    held = _within(pairs.quantiles(of, [cut])[0], of)
    lo, hi, n = ends_of(pairs, held) or (0.0, 0.0, 0)
    if n < 3 or lo == hi:
        return None

    def add(total, t):
        u = np.minimum(np.maximum((held(t) - lo) / (hi - lo), 1e-9), 1 - 1e-9)
        total[0] += [u.sum(), (u * u).sum(), np.log(u).sum(), np.log(1 - u).sum()]

    mean, square, log, log1m = (pairs.summed(1, add, 4)[0] / n).tolist()
    h = histogram(pairs, held, bins)
    edges = np.array([h[0][1], *[r[2] for r in h]])
    return fits.beta_distance(*fits.beta_fit(mean, square - mean * mean, log, log1m), lo, hi, n, np.array([r[3] for r in h]), edges)


def linked(pairs: ValidPairs, keep: Callable) -> tuple[int, int, int]:
    """(pairs, those that `keep(tile)` marks, compounds in one of these)."""
    tiles = pairs.tiles()

    def run(batches):
        seen: list[np.ndarray] = []
        n = kept = 0
        for t in tiles(batches):
            low, high, valid, *_ = t.who
            marked = keep(t)
            n, kept = n + len(marked), kept + int(marked.sum())
            if valid is None:
                both = marked.reshape(len(low), len(high))
            else:
                both = np.zeros(valid.shape, bool)
                both[valid] = marked
            seen += [low[both.any(axis=1)], high[both.any(axis=0)]]
            if len(seen) > 1000:
                seen = [np.unique(np.concatenate(seen))]
        pos = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
        for a in range(0, max(1, len(pos)), 1 << 16):
            part = pos[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([n if a == 0 else 0]), pa.array([kept if a == 0 else 0]), pa.array([part], pa.list_(pa.int64()))], ["n", "kept", "pos"])

    found = pairs.met.mapInArrow(run, "n long, kept long, pos array<long>").persist()
    n, kept = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kept"), F.lit(0))).first()
    compounds = found.select(F.explode("pos").alias("p")).distinct().count()
    found.unpersist()
    return n, kept, compounds


def scaled_by_status(pairs: ValidPairs, censored: int) -> DataFrame:
    """status, n, mean_scaled, min_similarity, max_similarity, mean_similarity, also of the excluded pairs of `censored` compounds, which have none."""
    tiles = pairs.tiles()

    def run(batches):
        out = {k: [0, 0.0, 0.0, np.inf, -np.inf] for k in (False, True)}
        for t in tiles(batches):
            _, _, valid, ca, cb, *_ = t.who
            some = (ca[:, None] | cb[None]) if valid is None else (ca[:, None] | cb[None])[valid]
            some = some.ravel()
            for k, x, s in ((False, t.scaled[~some], t.similarity[~some]), (True, t.scaled[some], t.similarity[some])):
                if len(x):
                    n, sx, ss, lo, hi = out[k]
                    out[k] = [n + len(x), sx + x.sum(), ss + s.sum(), min(lo, s.min()), max(hi, s.max())]
        for k, (n, sx, ss, lo, hi) in out.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in ("censored" if k else "correct", n, float(sx), float(ss), float(lo), float(hi))], ["status", "n", "sx", "ss", "lo", "hi"])

    found = pairs.met.mapInArrow(run, "status string, n long, sx double, ss double, lo double, hi double").groupBy("status")
    n = F.sum("n")
    got = found.agg(n.alias("n"), (F.sum("sx") / n).alias("mean_scaled"), F.min("lo").alias("min_similarity"), F.max("hi").alias("max_similarity"), (F.sum("ss") / n).alias("mean_similarity"))
    none = [("excluded", 0, None, None, None, None)] if censored > 1 else []
    return got.unionByName(pairs.met.sparkSession.createDataFrame(none, "status string, n long, mean_scaled double, min_similarity double, max_similarity double, mean_similarity double"))


def _group_cliffs(t: Tile, threshold: float = 1.0) -> np.ndarray:
    """Which pairs are cliffs within a group."""
    *_, valid, _, _, ga, gb = t.who
    same = ga[:, None] == gb[None]
    return (same.ravel() if valid is None else same[valid]) & ~(t.ratio < threshold)


def _group_similarities(t: Tile) -> np.ndarray:
    return t.similarity[_group_cliffs(t)]


def measures(pairs: ValidPairs) -> dict[str, float]:
    """What runs.measures() counts of all pairs."""

    def add(total, t):
        near = _group_similarities(t)
        total[0] += [(t.raw == 0).sum(), ((t.similarity >= 0.9) & ~(t.ratio < 1.0)).sum(), len(near), near.sum()]

    same, close, n, sims = pairs.summed(1, add, 4)[0].tolist()
    found = {"identical_pairs": same, "cliffs_at_similarity_0_9": close, "lipschitz_p99": pairs.quantiles(slope, [0.99])[0]}
    return found | ({"group_mean": sims / n, "group_p99": pairs.quantiles(_group_similarities, [0.99])[0]} if n else {})


def extra_measures(pairs: ValidPairs) -> tuple[float | None, float | None]:
    """(lipschitz_p90, group_std) of runs.extra_measures()."""

    def add(total, t):
        near = _group_similarities(t) - 0.5
        total[0] += [len(near), near.sum(), (near * near).sum()]

    n, one, two = pairs.summed(1, add, 3)[0].tolist()
    return pairs.quantiles(slope, [0.9])[0], math.sqrt(max(0.0, two / n - (one / n) ** 2)) if n else None


def _among(t: Tile, cut: dict, threshold: float = 1.0) -> np.ndarray:
    """Which pairs are cliffs among the first, as cliffs.top_set() has them."""
    held = t.similarity >= cut["similarity"]
    if cut["end"] is not None:
        low, high, valid, *_ = t.who
        p, q = (np.broadcast_to(x, (len(low), len(high))) for x in (low[:, None], high[None]))
        p, q = (p.ravel(), q.ravel()) if valid is None else (p[valid], q[valid])
        first, last = cut["end"]
        held &= (t.similarity > cut["similarity"]) | (p < first) | ((p == first) & (q <= last))
    return held & ~(t.ratio < threshold)


def shared(one: ValidPairs, two: ValidPairs, cuts: tuple[dict, dict]) -> DataFrame:
    """n_one, n_two, n_both, dice of the top cliffs of two runs on the same compounds, as runs.dice() of their sets."""
    tiles = one.tiles(), two.tiles()

    def run(batches):
        n = np.zeros(3, np.int64)
        for batch in batches:
            for a, b in zip(tiles[0]([batch]), tiles[1]([batch]), strict=True):
                x, y = _among(a, cuts[0]), _among(b, cuts[1])
                n += [x.sum(), y.sum(), (x & y).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(k)]) for k in n], ["x", "y", "z"])

    sums = one.met.mapInArrow(run, "x long, y long, z long").agg(F.sum("x").alias("n_one"), F.sum("y").alias("n_two"), F.sum("z").alias("n_both"))
    return sums.withColumn("dice", 2 * F.col("n_both") / F.nullif(F.col("n_one") + F.col("n_two"), F.lit(0)))
