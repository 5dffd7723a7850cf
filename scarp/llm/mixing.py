"""Mixing sources to target weights by entropy balancing.

Among all document rates r with r <= cap and, for every source, sum(r * size) = target, take the
one nearest to rate 1 in relative entropy. Its convex dual has one multiplier per source, and
the solution tilts the rates exponentially: r = min(cap, exp(lambda * size / mean size)).
Newton iterations solve the dual; each is one aggregation by source over the distributed
histogram of (source, size). The rates are then rounded into whole copies by sequential
Poisson sampling, so that each source's total ends within a document of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialize

#: A word is a run of anything but space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_BUCKETS = 4096
#: What mix() adds.
NEW = ("size", "source_size", "target", "rate", "copies")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target for a table (source, source_size) with one row per source.

    Sources in code-point order, null last, take `weights` in turn. Together they get `share` of
    all sizes; a target stops at `cap` times its source's size and the excess goes to the
    others by weight, until none is above. The fixed point is target = min(cap * size, mu *
    weight): with sources in order of cap * size / weight, those before the first whose ratio
    reaches mu are the ones that stop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    options = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.get(options, F.col("rank") % len(weights)))
    limit = F.col("source_size") * F.lit(float(cap))
    by_ratio = Window.orderBy("ratio", "rank")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumn("limit", limit).withColumn("ratio", limit / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / open_weight)
    mu = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank"))).over(every)
    target = F.least("limit", F.coalesce(mu, F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _totals(histogram: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """Per source the dual's gradient and second derivative at the present multiplier."""
    x = F.col("h.size") / F.col("s.mean_size")
    tilt = F.exp(F.least(F.col("s.lam") * x, F.lit(700.0)))
    mass = F.col("h.n") * F.col("h.size")
    joined = histogram.alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
    return joined.groupBy(*[F.col(f"s.{c}") for c in state.columns]).agg(
        F.sum(mass * F.least(tilt, F.lit(cap))).alias("total"),
        F.sum(F.when(tilt < cap, mass * x * tilt).otherwise(0.0)).alias("slope"),
    )


def balance(histogram: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-6, rounds: int = 60) -> DataFrame:
    """targets with the multiplier `lam` and `mean_size` of each source.

    histogram: source, size, n. Each source's root is kept in a bracket [lo, hi]; a Newton step
    that leaves it is replaced by its middle, so every round makes progress. A source whose
    target is its limit gets rate `cap` throughout (the multiplier at which the smallest
    document reaches the cap).
    """
    facts = histogram.filter("size > 0").groupBy("source").agg(
        F.min("size").alias("least"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size")
    )
    state = targets.join(facts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    state = state.withColumn("mean_size", F.coalesce("mean_size", F.lit(1.0))).withColumn("least", F.coalesce(F.col("least") / F.col("mean_size"), F.lit(1.0)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    full = ratio >= cap * (1 - 1e-12)
    top = F.log(F.lit(cap)) * (1 + 1e-9) / F.col("least")
    bottom = F.log(F.greatest(ratio, F.lit(1e-300))) / F.col("least")
    state = (
        state.withColumn("lo", F.when(full, top).when(ratio >= 1, 0.0).otherwise(bottom))
        .withColumn("hi", F.when(full | (ratio > 1), top).otherwise(0.0))
        .withColumn("lam", F.when(full, top).otherwise(0.0))
        .withColumn("off", F.lit(None).cast("double"))
        .drop("least")
    )
    state = materialize(state, "balance")
    for _ in range(rounds):
        t = _totals(histogram, state, cap)
        gap = F.col("total") - F.col("target")
        t = t.withColumn("off", F.abs(gap) / F.greatest(F.col("target"), F.lit(1e-300)))
        t = t.withColumn("lo", F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
        t = t.withColumn("hi", F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
        step = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        done = (F.col("off") <= tolerance) | (F.col("lo") >= F.col("hi"))
        lam = F.when(done, F.col("lam")).when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = t.withColumn("was", F.col("lam")).withColumn("lam", lam)
        state = materialize(moved.withColumn("open", ~done & (F.abs(F.col("lam") - F.col("was")) > 1e-15 * F.abs(F.col("lam")))).select(*state.columns, "open"), "balance")
        still = state.filter("open").limit(1).count()
        state = state.drop("open")
        if not still:
            break
    return state.select("source", "source_size", "target", "lam", "mean_size")


def _rate(cap: float) -> Column:
    """A size of 0 and a missing source give rate 1."""
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean_size"), F.lit(700.0)))
    return F.least(tilt, F.lit(cap))


def _priority(rate: Column) -> Column:
    """u / (rate's fraction), mapped into [0, 1); null where no further copy can be drawn.

    u is uniform by document. Among equal fractions the smallest u come first, so taking the
    documents in this order until the remainder is used up rounds each rate without bias.
    """
    u = (F.shiftrightunsigned("_hash", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    part = rate - F.floor(rate)
    return F.when(part > 0, u / (u + part))


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """documents with size, source_size, target, rate (double) and copies (long).

    documents: doc_id, text, source and any other columns; those named like the new ones are
    replaced. Null texts have size 0 and null sources form the last source. Sizes of 0 keep
    rate 1. Equal rows get equal copies. An empty table gives no rows. Each source's copies
    differ from its target by about a small document (and those that tie with it), no document
    gets more than `cap` copies rounded up, and reruns agree, as all draws are hashes.
    """
    names = [c for c in documents.columns if c not in NEW]
    plain, held, _ = carried(documents.select(*[F.col(f"`{c}`") for c in names]), F.col("doc_id"), F.col("text"), F.col("source"))
    sized = plain.withColumn("size", word_count(F.col("text"))).withColumn("_hash", F.xxhash64("doc_id", "text"))
    weighed = materialize(sized.select("source", "size", "_hash"), "sizes")
    histogram = materialize(weighed.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = balance(histogram, materialize(source_targets(sources, weights, share, cap), "targets"), cap)
    cuts = materialize(_cuts(weighed, state, cap), "cuts")
    joined = sized.join(cuts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    joined = joined.withColumn("rate", _rate(cap)).withColumn("_at", _priority(F.col("rate")))
    late = F.coalesce((F.col("size") <= F.col("_gap")) & (F.col("_at") <= F.col("_gap_cut")), F.lit(False))
    joined = joined.withColumn("copies", F.floor("rate").cast("long") + (_first_extra() | late).cast("long"))
    return joined.select(*held, *NEW).toDF(*names, *NEW)


def _cuts(weighed: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """state with `_cut`, `_small_cut` and `_gap_cut`, the last priorities that get one more copy.

    Documents above a quarter of their source's mean size are rounded first, towards their own
    expected total; the smaller ones then make up what is missing, and any document without
    one more copy that still fits into the gap may close it.
    """
    side = state.withColumnRenamed("source", "_source")
    drawn = weighed.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", _rate(cap))
    drawn = drawn.withColumn("_at", _priority(F.col("rate"))).withColumn("_small", _is_small())
    extra = (F.col("rate") - F.floor("rate")) * F.col("size")
    sums = materialize(
        drawn.groupBy(*state.columns).agg(F.sum(F.floor("rate") * F.col("size")).alias("sure"), F.sum(F.when(~F.col("_small"), extra)).alias("large")),
        "sums",
    )
    rest = sums.select("source", F.coalesce("large", F.lit(0.0)).alias("rest"))
    large = _cut(drawn.filter("NOT _small"), rest).withColumnsRenamed({"_cut": "_large_cut", "_took": "_large_took"})
    both = sums.join(large.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    both = materialize(both, "large")
    rest = both.select("source", (F.col("target") - F.col("sure") - F.coalesce("_large_took", F.lit(0))).alias("rest"))
    small = _cut(drawn.filter("_small"), rest).withColumnRenamed("_cut", "_small_cut")
    both = both.join(small.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    gap = F.col("target") - F.col("sure") - F.coalesce("_large_took", F.lit(0)) - F.coalesce("_took", F.lit(0))
    both = both.select(*state.columns, F.col("_large_cut").alias("_cut"), "_small_cut", gap.alias("_gap"))
    both = materialize(both, "small")
    side = both.select(F.col("source").alias("_source"), "_cut", "_small_cut", "_gap")
    left = drawn.drop("_source").join(side, F.col("source").eqNullSafe(F.col("_source"))).filter(~_first_extra() & (F.col("size") <= F.col("_gap")))
    last = _cut(left, both.select("source", F.col("_gap").alias("rest"))).select(F.col("source").alias("_source"), F.col("_cut").alias("_gap_cut"))
    return both.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _first_extra() -> Column:
    cut = F.when(_is_small(), F.col("_small_cut")).otherwise(F.col("_cut"))
    return F.coalesce(F.col("_at") <= cut, F.lit(False))


def _is_small() -> Column:
    return F.col("size") <= F.col("mean_size") / 4


def _cut(drawn: DataFrame, rest: DataFrame) -> DataFrame:
    """source, _cut, _took: taking priorities up to _cut gives sizes that sum to _took, near `rest`.

    Sums over buckets of the priority find the bucket in which `rest` is used up; only that
    bucket's documents are put in order.
    """
    bucket = F.least(F.floor(F.col("_at") * _BUCKETS), F.lit(_BUCKETS - 1)).cast("int")
    drawn = drawn.filter("_at IS NOT NULL").select("source", bucket.alias("_bucket"), "_at", "_hash", "size")
    same = F.col("source").eqNullSafe(F.col("_source"))
    sums = drawn.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sums.withColumn("before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
    reached = ordered.join(rest.withColumnRenamed("source", "_source"), same).filter("before < rest")
    last = reached.groupBy("source", "rest").agg(F.max("_bucket").alias("_bucket"), F.max("before").alias("before"))
    last = materialize(last.withColumnsRenamed({"source": "_source", "_bucket": "_b"}), "last")
    inside = drawn.join(last, same & (F.col("_bucket") == F.col("_b")))
    order = Window.partitionBy("source").orderBy("_at", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.col("before") + F.sum("size").over(order)
    chosen = inside.withColumn("_filled", filled).withColumn("_fits", F.col("_filled") - F.col("size") / 2 <= F.col("rest"))
    floor = F.first("_b") / F.lit(float(_BUCKETS)) - F.lit(1e-12)
    return chosen.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("_fits"), F.col("_at"))), floor).alias("_cut"),
        F.coalesce(F.max(F.when(F.col("_fits"), F.col("_filled"))), F.first("before")).alias("_took"),
    )


def copies_of(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`columns` of each document as often as the mix takes it; documents with 0 copies go, equal rows are repeated alike."""
    repeated = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return mixed.select(*columns, repeated.alias("_again")).drop("_again")


def take(documents: DataFrame, **options) -> DataFrame:
    """documents as often as mix() with these options takes them, with their own columns, whatever these are called."""
    own, held, names = carried(documents, F.col("doc_id"), F.col("text"), F.col("source"))
    return copies_of(mix(own, **options), held).toDF(*names)
