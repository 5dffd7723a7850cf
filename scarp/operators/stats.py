"""Summary statistics, exact quantiles and histograms by aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kept for callers that set it; steps in which values are counted in one pass, and how many values are brought to the driver.
_ACCURACY, _STEPS, _FETCH = 10_000, 1 << 17, 200_000
#: Bits that the first count leaves out, and values that are counted at once.
_PREFIX, _AT_ONCE = 42, 1 << 19


def quantile(c: str | Column, q: float) -> Column:
    """Exact, with linear interpolation, as an aggregate: for groups of a size that one task can sort."""
    return F.percentile(c, F.lit(q))


def quantiles(df: DataFrame, c: str | Column, points: Sequence[float], by: str | Column | None = None) -> dict[Hashable, list[float | None]]:
    """Exact quantiles with linear interpolation of each of a few groups (without `by`: of the group None); nulls are left out.

    The table is read two times or more, so it should be written or persisted.
    """
    out = {}
    for g, (n, values) in _select(df, c, by, lambda n: [f(p * (n - 1)) for p in points for f in (math.floor, math.ceil)]).items():
        parts = [p * (n - 1) - math.floor(p * (n - 1)) for p in points]
        out[g] = [lo if t == 0 or lo == hi else lo + (hi - lo) * t for lo, hi, t in zip(values[::2], values[1::2], parts, strict=True)]
    return out


def order_statistics(df: DataFrame, c: str | Column, ranks: Sequence[int]) -> list[float]:
    """The values at the given ranks, from 1 on; nulls are left out, and a rank beyond the values gives the last one."""
    found = _select(df, c, None, lambda n: [min(max(r, 1), n) - 1 for r in ranks])
    return found[None][1] if found else []


def quantile_ranks(df: DataFrame, c: str | Column, ranks_of: Callable[[int], list[int]]) -> tuple[int, list[float]] | None:
    """(n, the values at the ranks, from 0 on, that `ranks_of` gives for n values); None without values."""
    return _select(df, c, None, ranks_of).get(None)


def made_quantiles(source: DataFrame, make: Callable, points: Sequence[float]) -> list[float | None]:
    """As quantiles() of the values (batches of a column v without nulls) that `make` yields for batches of `source`; they are counted where they are made."""
    found = _select(source, "v", None, lambda n: [f(p * (n - 1)) for p in points for f in (math.floor, math.ceil)], make).get(None)
    if not found:
        return [None] * len(points)
    parts = [p * (found[0] - 1) - math.floor(p * (found[0] - 1)) for p in points]
    return [lo if t == 0 or lo == hi else lo + (hi - lo) * t for lo, hi, t in zip(found[1][::2], found[1][1::2], parts, strict=True)]


def made_ranks(source: DataFrame, make: Callable, ranks_of: Callable[[int], list[int]]) -> tuple[int, list[float]] | None:
    """As quantile_ranks() of the values that `make` yields, see made_quantiles()."""
    return _select(source, "v", None, ranks_of, make).get(None)


def made_group_quantiles(source: DataFrame, make: Callable, point: float) -> dict[int, float]:
    """A quantile of each group of the values (batches of g, a small whole number, and v) that `make` yields, see made_quantiles()."""
    out = {}
    for g, (n, (lo, hi)) in _select(source, "v", "g", lambda n: [f(point * (n - 1)) for f in (math.floor, math.ceil)], make).items():
        t = point * (n - 1) - math.floor(point * (n - 1))
        out[g] = lo if t == 0 or lo == hi else lo + (hi - lo) * t
    return out


def _select(df: DataFrame, c: str | Column, by: str | Column | None, ranks_of: Callable[[int], list[int]], make: Callable | None = None) -> dict[Hashable, tuple[int, list[float]]]:
    """For each of a few groups (n, its values at ranks from 0 on); NaN is above all numbers. `make` is that of made_quantiles().

    No task sees all values and none is moved: the bits of a double, read as a whole number, keep its order, and
    tasks count their values in equal steps of these numbers. Only the steps that hold a wanted rank are
    looked at again, in finer steps, all ranks in one pass, until the values left there are few.
    """
    source = df
    if make is not None:
        df = df.mapInArrow(make, "v double" if by is None else "g long, v double")
    group = F.lit(None).cast("string") if by is None else F.col(by) if isinstance(by, str) else by
    values = df.select(group.alias("g"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")).filter("v IS NOT NULL")
    kind = values.schema["g"].dataType.simpleString()
    sent = values.select("v") if by is None else values
    counted = sent.mapInArrow if make is None else lambda count, schema: source.mapInArrow(lambda batches: count(make(batches)), schema)
    first = counted(_count_prefixes, f"g {kind}, prefix long, n long").groupBy("g", "prefix").agg(F.sum("n").alias("n")).collect()
    sizes: dict[Hashable, int] = {}
    for r in first:
        sizes[r["g"]] = sizes.get(r["g"], 0) + r["n"]
    if sum(sizes.values()) <= _FETCH:
        rows: dict[Hashable, list[tuple[float, int]]] = {}
        for r in values.groupBy("g", "v").agg(F.count("*").alias("n")).collect():
            rows.setdefault(r["g"], []).append((r["v"], r["n"]))
        out = {}
        for g, own in rows.items():
            v, k = np.array([x for x, _ in own]), np.array([n for _, n in own])
            order = np.argsort(v)  # NaN last
            upto = np.cumsum(k[order])
            out[g] = (int(upto[-1]), v[order][np.searchsorted(upto, ranks_of(int(upto[-1])), side="right")].tolist())
        return out
    ranks = {g: ranks_of(n) for g, n in sizes.items()}
    # (group, first and last number of a stretch): how many of the group's values are below it, and the wanted ranks in it
    open_: dict[tuple, tuple[int, list[int]]] = {}
    for g in sizes:
        own = sorted((r["prefix"], r["n"]) for r in first if r["g"] == g)
        upto = np.cumsum([n for _, n in own])
        for k in sorted(set(ranks[g])):
            j = int(np.searchsorted(upto, k, side="right"))
            start = own[j][0] << _PREFIX
            open_.setdefault((g, start, start + (1 << _PREFIX) - 1), (int(upto[j - 1]) if j else 0, []))[1].append(k)
    at: dict[tuple, float] = {}
    while open_:
        steps = max(2, _STEPS // len(open_))
        listed = sorted(open_, key=lambda x: (str(x[0]), x[1]))
        widths = [-(-(hi - lo + 1) // steps) for _, lo, hi in listed]
        found = counted(_count_steps(listed, widths, steps), "stretch long, step long, n long").groupBy("stretch", "step").agg(F.sum("n").alias("n")).toArrow()
        stretch, step, n = (found.column(x).to_numpy() for x in ("stretch", "step", "n"))
        order = np.lexsort((step, stretch))
        stretch, step, n = stretch[order], step[order], n[order]
        finer, left = {}, 0
        for i, (g, lo, hi) in enumerate(listed):
            below, wanted = open_[g, lo, hi]
            first, last = np.searchsorted(stretch, [i, i + 1])
            upto = below + np.cumsum(n[first:last])
            for k in wanted:
                j = int(np.searchsorted(upto, k, side="right"))
                start = lo + int(step[first + j]) * widths[i]
                stop = min(start + widths[i] - 1, hi)
                if start == stop:
                    at[g, k] = float(_from_bits(start))
                    continue
                key = (g, start, stop)
                if key not in finer:
                    finer[key] = (int(upto[j - 1]) if j else below, [])
                    left += int(n[first + j])
                finer[key][1].append(k)
        open_ = finer
        if open_ and left <= _FETCH:
            listed = sorted(open_, key=lambda x: (str(x[0]), x[1]))
            found = counted(_values_within(listed), "stretch long, v double").groupBy("stretch", "v").agg(F.count("*").alias("n")).toArrow()
            stretch, v, n = (found.column(x).to_numpy() for x in ("stretch", "v", "n"))
            order = np.lexsort((_ordered_bits(v), stretch))
            stretch, v, n = stretch[order], v[order], n[order]
            for i, key in enumerate(listed):
                below, wanted = open_[key]
                first, last = np.searchsorted(stretch, [i, i + 1])
                upto = below + np.cumsum(n[first:last])
                for k in wanted:
                    at[key[0], k] = float(v[first + int(np.searchsorted(upto, k, side="right"))])
            break
    return {g: (n, [at[g, k] for k in ranks[g]]) for g, n in sizes.items()}


_SIGN, _ALL = np.uint64(1 << 63), np.uint64((1 << 64) - 1)


def _ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; 0.0 and -0.0 are one, NaN is the largest."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)
    bits = np.ascontiguousarray(v).view(np.uint64)
    return np.where(bits & _SIGN, bits ^ _ALL, bits | _SIGN)


def _from_bits(bits: int) -> float:
    x = np.array([bits], np.uint64)
    return np.where(x & _SIGN, x ^ _SIGN, x ^ _ALL).view(np.float64)[0]


def _places(listed: list[tuple]):
    """(g, v) of a batch to (numbers of the values, the stretch of each): only of those within a stretch of their group."""
    groups: dict[Hashable, tuple[int, np.ndarray, np.ndarray]] = {}
    some = np.zeros(1 << (64 - _PREFIX), bool)  # leading bits that some stretch has
    for g in dict.fromkeys(x[0] for x in listed):
        own = [i for i, x in enumerate(listed) if x[0] == g]
        groups[g] = (own[0], np.array([listed[i][1] for i in own], np.uint64), np.array([listed[i][2] for i in own], np.uint64))
        for i in own:
            some[listed[i][1] >> _PREFIX : (listed[i][2] >> _PREFIX) + 1] = True

    def find(batch: pa.RecordBatch):
        bits = _ordered_bits(batch.column("v").to_numpy())
        for g, of in _groups_of(batch):
            if g not in groups:
                continue
            first, lo, hi = groups[g]
            own = bits[of]
            own = own[some[own >> np.uint64(_PREFIX)]]
            i = np.searchsorted(lo, own, side="right") - 1
            inside = (i >= 0) & (own <= hi[i])
            yield first + i[inside], own[inside]

    return find


def _groups_of(batch: pa.RecordBatch):
    """(group, which rows are its own); without a column g all rows are of the group None."""
    if "g" not in batch.schema.names:
        yield None, slice(None)
        return
    keys = batch.column("g").dictionary_encode()
    code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(code.astype(np.int16) if len(keys.dictionary) < 1 << 15 else code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(-1, len(keys.dictionary) + 1))
    for g, a, b in zip([None, *keys.dictionary.to_pylist()], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield g, order[a:b]


def _gathered(batches):
    """Batches put together, as numpy is slow on few values."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= _AT_ONCE:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0] if table.num_rows else held[0]


def _count_prefixes(batches):
    """How many values of each group share their leading bits."""
    counts: dict[Hashable, dict[int, int]] = {}
    kind = pa.string()
    for batch in _gathered(batches):
        kind = batch.schema.field("g").type if "g" in batch.schema.names else kind
        prefix = (_ordered_bits(batch.column("v").to_numpy()) >> np.uint64(_PREFIX)).astype(np.int64)
        for g, of in _groups_of(batch):
            own = prefix[of]
            if not len(own):
                continue
            low = int(own.min())
            n = np.bincount(own - low)
            at = np.flatnonzero(n)
            held = counts.setdefault(g, {})
            for k, m in zip((at + low).tolist(), n[at].tolist(), strict=True):
                held[k] = held.get(k, 0) + m
    rows = [(g, k, n) for g, own in counts.items() for k, n in own.items()]
    for a in range(0, max(1, len(rows)), 100_000):
        part = rows[a : a + 100_000]
        if not part:
            return
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), *(pa.array([r[i] for r in part], pa.int64()) for i in (1, 2))], ["g", "prefix", "n"])


def _count_steps(listed: list[tuple], widths: list[int], steps: int):
    def run(batches):
        find, low, width = _places(listed), np.array([x[1] for x in listed], np.uint64), np.array(widths, np.uint64)
        counts = np.zeros(len(listed) * steps, np.int64)
        for batch in _gathered(batches):
            for stretch, bits in find(batch):
                counts += np.bincount(stretch * steps + ((bits - low[stretch]) // width[stretch]).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some // steps), pa.array(some % steps), pa.array(counts[some])], ["stretch", "step", "n"])

    return run


def _values_within(listed: list[tuple]):
    def run(batches):
        find = _places(listed)
        for batch in _gathered(batches):
            for stretch, bits in find(batch):
                v = np.where(bits & _SIGN, bits ^ _SIGN, bits ^ _ALL).view(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(stretch), pa.array(v)], ["stretch", "v"])

    return run


def quantile_table(df: DataFrame, c: str | Column, points: dict[str, float], by: str) -> DataFrame:
    """`by` and a column for each named quantile, for a few groups."""
    found = quantiles(df, c, list(points.values()), by)
    kind = df.schema[by].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, *v) for g, v in found.items()], f"{by} {kind}, " + ", ".join(f"{n} double" for n in points))


def _named(points: Sequence[int]) -> dict[str, float]:
    return {"median": 0.5} | {f"q{q}": q / 100 for q in points}


def _moments(c: str) -> list[Column]:
    return [F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")]


def _ordered(points: Sequence[int]) -> list[str]:
    return ["n", "min", "max", "mean", "median", "std", *[f"q{q}" for q in points]]


def summary(df: DataFrame, c: str, points: Sequence[int] = (25, 75, 90, 99)) -> DataFrame:
    """One row: n, min, max, mean, median, std (population) and percentiles of a column; nulls are left out."""
    named = _named(points)
    found = quantiles(df, c, list(named.values())).get(None, [None] * len(named))
    own = df.agg(*_moments(c)).withColumns({k: F.lit(v).cast("double") for k, v in zip(named, found, strict=True)})
    return own.select(*_ordered(points))


def describe(df: DataFrame, columns: Sequence[str], points: Sequence[int] = (25, 75, 90, 99)) -> DataFrame:
    """One row per column, named in `measure`."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select("m.*")
    own = long.groupBy("measure").agg(*_moments("v"))
    return own.join(F.broadcast(quantile_table(long, "v", _named(points), "measure")), "measure", "left").select("measure", *_ordered(points))


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """bin, lower, upper, n over [min, max] in equal steps, the last bin closed; empty bins count 0."""
    values = df.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins  # NaN, above all numbers, of infinite values
    place = F.when(F.isnan(share), F.lit(bins - 1)).otherwise(F.least(F.floor(share), F.lit(bins - 1))).cast("long")
    counts = values.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row
    frame = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    edge = lambda k: F.col("lo") + k * width
    return frame.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"), F.coalesce("n", F.lit(0)).alias("n")).filter("lower IS NOT NULL")


def truncated(df: DataFrame, c: str, q: float = 0.99) -> DataFrame:
    """Rows up to the q-quantile of a column; without the nulls."""
    cut = quantiles(df, c, [q]).get(None, [None])[0]
    return df.filter(F.col(c) <= F.lit(cut).cast("double"))


def density(df: DataFrame, c: str, bins: int) -> DataFrame:
    """center, density of the bins that hold something."""
    h = histogram(df, c, bins)
    total = h.agg(F.sum("n").alias("total"))
    return h.join(F.broadcast(total)).filter("n > 0").select("bin", ((F.col("lower") + F.col("upper")) / 2).alias("center"), (F.col("n") / F.col("total") / (F.col("upper") - F.col("lower"))).alias("density"))


def bin_edges(width: float) -> list[tuple[float, float]]:
    """int(1 / width) bins of [0, 1] in double arithmetic; a width that does not divide 1 loses the top."""
    return [(i * width, (i + 1) * width) for i in range(int(1.0 / width))]


def in_bin(value: Column, lower: Column, upper: Column) -> Column:
    """[lower, upper), but closed where upper is 1."""
    return (value >= lower) & ((value < upper) | ((upper == 1.0) & (value == 1.0)))


def _in_bins(bins: Sequence[tuple[float, float]]):
    """Rows with the number of the first bin that holds their similarity; the others are left out."""

    def run(batches):
        for batch in batches:
            x = batch.column("similarity").to_numpy()
            place = np.full(len(x), -1)
            for i, (a, b) in reversed(list(enumerate(bins))):
                place[(x >= a) & ((x < b) | ((b == 1.0) & (x == 1.0)))] = i
            held = batch.filter(pa.array(place >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(place[place >= 0]), *held.columns], ["bin", *held.schema.names])

    return run


def binned(
    pairs: DataFrame, bins: Sequence[tuple[float, float]], aggregates: Sequence[Column], need: str = "similarity IS NOT NULL AND log_ratio IS NOT NULL", median: tuple[str, str] | None = None,
    columns: Sequence[str] = ("log_ratio",),
) -> DataFrame:
    """bin, bin_lower, bin_upper and aggregates (of similarity and `columns`, doubles) of the valid pairs by similarity; every bin has a row.

    `median` names a column and what its median is called.

    The bin is found in numpy: an expression with all edges is too long for the JVM to compile, and pairs are scanned once.
    """
    held = pairs.filter("status <> 'excluded'").filter(need).select("similarity", *columns)
    held = held.mapInArrow(_in_bins(bins), "bin long, " + ", ".join(f"{c} double" for c in held.columns))
    grouped = held.groupBy("bin").agg(*aggregates)
    if median:
        grouped = grouped.join(F.broadcast(quantile_table(held, median[0], {median[1]: 0.5}, "bin")), "bin", "left")  # a row per bin
    frame = pairs.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bins)], "bin long, bin_lower double, bin_upper double")
    return frame.join(grouped, "bin", "left")
