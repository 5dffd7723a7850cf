"""Vector metrics: Column expressions for single pairs and numpy kernels for blocks of pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    """A registered metric. `block` maps (n x d, m x d) to an n x m matrix of distances."""

    name: str
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    column: Callable[[Column, Column], Column] | None = None
    similarity: bool = False
    upper_bound: float | None = None
    nested: bool = False


METRICS: dict[str, Metric] = {}


def register_metric(name: str, block, column=None, similarity: bool = False, upper_bound: float | None = None, nested: bool = False) -> Metric:
    """Add a metric. `block` and `column` give similarities if `similarity`, which become distances 1 - s."""
    if similarity:
        plain, plain_column = block, column
        block = lambda a, b: 1.0 - plain(a, b)
        column = (lambda u, v: F.lit(1.0) - plain_column(u, v)) if plain_column else None
    METRICS[name] = Metric(name, block, column, similarity, upper_bound, nested)
    return METRICS[name]


def get_metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[name]


def _fold(u: Column, v: Column, of: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(u, v, of), F.lit(0.0), lambda s, x: s + x)


def dot(u: Column, v: Column) -> Column:
    return _fold(u, v, lambda a, b: a * b)


def norm(u: Column) -> Column:
    """Euclidean length of a vector column."""
    return F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x))


def _squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """top / bottom, and 1 where bottom is 0."""
    return np.divide(top, bottom, out=np.ones_like(top), where=bottom != 0)


def _tanimoto(a, b):
    ab = a @ b.T
    return _ratio(ab, _squares(a)[:, None] + _squares(b)[None] - ab)


def _tanimoto_column(u, v):
    ab = dot(u, v)
    bottom = dot(u, u) + dot(v, v) - ab
    return F.when(bottom == 0, F.lit(1.0)).otherwise(ab / bottom)


def _dice(a, b):
    return _ratio(2 * (a @ b.T), _squares(a)[:, None] + _squares(b)[None])


def _dice_column(u, v):
    bottom = dot(u, u) + dot(v, v)
    return F.when(bottom == 0, F.lit(1.0)).otherwise(2 * dot(u, v) / bottom)


def _cosine(a, b):
    la, lb = np.sqrt(_squares(a)), np.sqrt(_squares(b))
    out = np.divide(a @ b.T, la[:, None] * lb[None], out=np.zeros((len(a), len(b))), where=(la[:, None] * lb[None]) != 0)
    out[np.ix_(la == 0, lb == 0)] = 1.0
    return out


def _cosine_column(u, v):
    lu, lv = norm(u), norm(v)
    return F.when((lu == 0) & (lv == 0), 1.0).when((lu == 0) | (lv == 0), 0.0).otherwise(dot(u, v) / (lu * lv))


def _by_rows(reduce):
    """Differences row by row: exact zeros survive, and memory stays at one row against a block."""

    def block(a, b):
        return np.stack([reduce(row[None] - b) for row in a]) if len(a) else np.zeros((0, len(b)))

    return block


def _euclidean(a, b):
    """By products; where these would cancel, as for equal vectors, by differences."""
    whole = _squares(a)[:, None] + _squares(b)[None]
    out = whole - 2 * (a @ b.T)
    i, j = np.nonzero(~(out > 0.01 * whole))
    for at in range(0, len(i), 1 << 16):
        gap = a[i[at : at + (1 << 16)]] - b[j[at : at + (1 << 16)]]
        out[i[at : at + (1 << 16)], j[at : at + (1 << 16)]] = _squares(gap)
    return np.sqrt(out)


def _sokal_michener(a, b):
    p, q = a.astype(bool).astype(float), b.astype(bool).astype(float)
    return (p @ q.T + (1 - p) @ (1 - q).T) / max(1, a.shape[1])


def _mean_power(x: np.ndarray, y: np.ndarray, power: float) -> float:
    """The mean power of the distances of all rows of two sets, 512 against 512 at a time."""
    if not len(x) or not len(y):
        return float("nan")
    total = 0.0
    for i in range(0, len(x), 512):
        for j in range(0, len(y), 512):
            d = _euclidean(x[i : i + 512], y[j : j + 512])
            total += float((np.sqrt(d) if power == 0.5 else d**power).sum())
    return total / (len(x) * len(y))


def tensor_distance(x: np.ndarray, y: np.ndarray, power: float = 0.5) -> float:
    """Energy distance of two sets of row vectors."""
    gap = 2 * _mean_power(x, y, power) - _mean_power(x, x, power) - _mean_power(y, y, power)
    return float(np.sqrt(max(0.0, gap)))


def _tensor(a, b, power: float = 0.5):
    own_a = [_mean_power(x, x, power) for x in a]
    own_b = [_mean_power(y, y, power) for y in b]
    return np.array([[np.sqrt(max(0.0, 2 * _mean_power(x, y, power) - sx - sy)) for y, sy in zip(b, own_b, strict=True)] for x, sx in zip(a, own_a, strict=True)])


register_metric("tanimoto", _tanimoto, _tanimoto_column, similarity=True, upper_bound=1.0)
register_metric("dice", _dice, _dice_column, similarity=True, upper_bound=1.0)
register_metric("cosine", _cosine, _cosine_column, similarity=True, upper_bound=2.0)
register_metric("euclidean", _euclidean, lambda u, v: F.sqrt(_fold(u, v, lambda a, b: (a - b) * (a - b))))
register_metric("manhattan", _by_rows(lambda d: np.abs(d).sum(axis=1)), lambda u, v: _fold(u, v, lambda a, b: F.abs(a - b)))
register_metric("hamming", _by_rows(lambda d: (d != 0).mean(axis=1)), lambda u, v: _fold(u, v, lambda a, b: (a != b).cast("double")) / F.size(u))
register_metric(
    "sokal_michener", _sokal_michener, lambda u, v: _fold(u, v, lambda a, b: ((a != 0) == (b != 0)).cast("double")) / F.size(u), similarity=True
)
register_metric("tensor", _tensor, nested=True)
METRICS["l2"], METRICS["l1"] = METRICS["euclidean"], METRICS["manhattan"]


def distance(u: Column, v: Column, metric: str) -> Column:
    """The distance of two vector columns as an expression, for few pairs."""
    found = get_metric(metric)
    if found.column is None:
        raise ValueError(f"metric {metric!r} has no Column form")
    return found.column(u, v)


def bits(u: Column) -> Column:
    """1.0 where a coordinate is positive, else 0.0."""
    return F.transform(u, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
