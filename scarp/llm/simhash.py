"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into SEGMENTS on a ring. If two fingerprints differ in at most
DISTANCE bits, then from some segment on every chain of l segments has at most
floor(l * DISTANCE / SEGMENTS) differing bits. The first two of seven segments must then be equal, which
makes an equi-join key of 18 bits; the longer chains prune before the full count of bits.
Only different fingerprints are compared, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, chunks, map_batches, materialize, texts_of
from .graph import components

DISTANCE = 3
SEGMENTS = 7
#: Fingerprints with one key that a task compares at once. A key with more is dealt out in pairs of blocks.
BLOCK = 2048


def fingerprint(words: list[bytes], k: int) -> int:
    """The SimHash of k-word shingles, as an unsigned number; 0 without words."""
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else (b" ".join(words),)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(s, 42) for s in shingles], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def _fingerprints(k: int):
    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            out = np.zeros(len(texts), np.uint64)
            for a, b in chunks(texts):
                out[a:b] = [fingerprint(t.lower().split(), k) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(out.view(np.int64))], ["doc_id", "hash", "fp"])

    return run


def fingerprints(documents: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, hash (of the text), fp (signed 64 bits) for every document."""
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), F.col("text").cast("string"))
    return map_batches(rows, _fingerprints(k), "doc_id long, hash long, fp long")


def segment_shifts() -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _keys(fp: Column) -> Column:
    """For each starting segment a number made of it, its bits and those of the next one."""
    cut = segment_shifts()

    def bits(i: int) -> Column:
        first, width = cut[i % SEGMENTS]
        return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))

    return F.array(*[F.lit(s).cast("long") * (1 << 40) + bits(s) * (1 << 20) + bits(s + 1) for s in range(SEGMENTS)])


def _chains(start: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """Whether the differences keep every chain's budget from the segments in `start` on."""
    cut = segment_shifts()
    masks = np.array([((1 << w) - 1) << a for a, w in cut], np.uint64)
    fits = np.ones(len(diff), bool)
    total = np.zeros(len(diff), np.int64)
    for length in range(1, SEGMENTS + 1):
        total += np.bitwise_count(diff & masks[(start + length - 1) % SEGMENTS])
        fits &= total <= length * DISTANCE // SEGMENTS
    return fits


class _Forest:
    """Links that join what was not joined yet."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        apart = self.label[a] != self.label[b]
        one, two = [], []
        parent = {}

        def root(x):
            while x in parent:
                x = parent[x]
            return x

        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = root(int(self.label[x])), root(int(self.label[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                one.append(x)
                two.append(y)
        if parent:
            names = np.fromiter(parent, np.int64, len(parent))
            to = np.arange(len(self.label))
            to[names] = [root(x) for x in names.tolist()]
            self.label = to[self.label]
        return one, two


def links_within(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in runs of equal keys, links (positions) that connect what lies within DISTANCE."""
    forest, one, two = _Forest(len(fp)), [], []
    start = key >> 40
    index = np.arange(len(fp) - 1)
    d = 1
    while len(index):
        index = index[: np.searchsorted(index, len(fp) - d)]
        index = index[key[index] == key[index + d]]
        diff = fp[index] ^ fp[index + d]
        near = _chains(start[index], diff) if len(index) else np.zeros(0, bool)
        near[near] = np.bitwise_count(diff[near]) <= DISTANCE
        if near.any():
            a, b = forest.add(index[near], index[near] + d)
            one += a
            two += b
        d += 1
    return np.array(one, np.int64), np.array(two, np.int64)


def _link(batches):
    held: list[np.ndarray] | None = None

    def found(key, fp):
        a, b = links_within(key, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    for batch in batches:
        new = [batch.column(c).to_numpy() for c in ("key", "i", "j", "fp")]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        key, i, j, fp = held
        last = int(np.argmax((key == key[-1]) & (i == i[-1]) & (j == j[-1])))  # the last run may go on
        if last:
            yield found(*_runs(key[:last], i[:last], j[:last], fp[:last]))
            held = [x[last:] for x in held]
    if held is not None:
        yield found(*_runs(*held))


def _runs(key, i, j, fp):
    """A number for each run of equal (key, i, j) that keeps the starting segment in its high bits."""
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    return (key >> 40 << 40) + np.cumsum(new), fp


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links between different fingerprints that connect all pairs within DISTANCE.

    distinct: fp, one row each. A key with more than `block` fingerprints is dealt out by hash
    into blocks, and each pair of blocks is compared in a group of its own; a group emits fewer
    links than it has rows.
    """
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = materialize(hot.select(F.col("key").alias("_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    dealt = keyed.join(hot, F.col("key") == F.col("_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return map_batches(ordered, _link, "a long, b long")


def near_duplicates(documents: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, hash, fp, component_id, keeper_id, keeper_hash: one row for each document.

    Documents whose fingerprints are connected by steps of at most DISTANCE bits share a
    component; component_id is its smallest doc_id. The keeper is the document to retain, that
    with the smallest doc_id, then text hash. Texts without words (null or empty) have
    fingerprint 0 and link like any other. Null doc_ids count as largest, so a component of
    null ids alone has a null component_id. Equal rows stay as often as they occur.
    """
    marked = materialize(fingerprints(documents, k), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    classes = materialize(marked.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    roots = components(links(classes.select("fp"), block))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = rooted.filter("root <> fp").select("root").distinct().withColumnRenamed("root", "_root")
    several = rooted.join(joined, F.col("root") == F.col("_root"))
    keepers = several.groupBy("root").agg(F.min("first").alias("keeper")).withColumnRenamed("root", "_root")
    of_class = rooted.join(keepers, F.col("root") == F.col("_root"), "left").select(F.col("fp").alias("_fp"), F.coalesce("keeper", "first").alias("keeper"))
    of_class = materialize(of_class, "keepers")
    out = marked.join(of_class, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", "hash", "fp", F.col("keeper.doc_id").alias("component_id"), F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.hash").alias("keeper_hash"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(documents: DataFrame, k: int = 3) -> DataFrame:
    """documents with one of each component; which columns there are does not matter.

    Of rows with the keeper's doc_id and text, that with the smallest hash of all columns stays. Null and
    empty texts are alike, so one of them stays; an empty table gives no rows.
    """
    kept = near_duplicates(documents, k).filter("doc_id <=> keeper_id AND hash = keeper_hash").select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash")).distinct()
    kept = materialize(kept, "kept")
    plain = [c for c, t in documents.dtypes if "map<" not in t and "variant" not in t]
    own, held, names = carried(documents, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text_hash"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("_all"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))
    order = Window.partitionBy("_id", "_text_hash").orderBy("_all")
    once = own.join(kept, same, "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return once.select(*held).toDF(*names)
