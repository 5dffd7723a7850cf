"""Benchmark decontamination by winnowing.

Of every w consecutive k-gram hashes the smallest is kept, so any two texts that share
k + w - 1 words in a row share a kept fingerprint at the same place of it. With k + w - 1 = the
window length, looking up the kept fingerprints of a document among those of the benchmark finds
every place where a window of an item may occur; each hit is then extended to the windows
around it and compared whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, grams, map_batches, materialize, mix, texts_of

WINDOW = 10
K = 5
#: Benchmark windows that one pass over the documents looks for; more take further passes.
PASS_WINDOWS = 1_000_000
#: What belongs to a word, namely digits, lower-case letters and every byte from 0x80 on.
_IN_WORD = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_TABLE = bytes(c if c in _IN_WORD else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


def _hashed(lists: list[list[bytes]]) -> tuple[Words, np.ndarray]:
    words = Words(lists)
    hashes = np.fromiter([xxhash.xxh64_intdigest(w, 7) for w in words.unique], np.uint64, len(words.unique))
    return words, hashes[words.ids] if len(words.ids) else np.empty(0, np.uint64)


def winnow(values: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some w consecutive values (all of them where fewer)."""
    n = len(values)
    if n <= w:
        return np.flatnonzero(values == values.min()) if n else np.empty(0, np.int64)
    least = values[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, values[i : n - w + 1 + i], out=least)
    most = np.zeros(n, np.uint64)  # the largest of the minima of the windows that hold a position
    for i in range(w):
        np.maximum(most[i : n - w + 1 + i], least, out=most[i : n - w + 1 + i])
    return np.flatnonzero(most == values)


def _item_windows(window: int):
    def run(batches):
        for batch in batches:
            items, sizes, hashes, prints, where = [], [], [], [], []
            ids = batch.column("item_id").to_pylist()
            texts = texts_of(batch)
            for a, b in chunks(texts):
                words, values = _hashed([words_of(t) for t in texts[a:b]])
                for item, lo, hi in zip(ids[a:b], words.bounds[:-1], words.bounds[1:], strict=True):
                    own = values[lo:hi]
                    size = min(window, len(own))
                    if not size:
                        continue
                    whole = grams(own, size)
                    k = min(K, size)
                    first = grams(own, k)
                    w = size - k + 1
                    for p in range(len(whole)):
                        items.append(item)
                        sizes.append(size)
                        hashes.append(int(whole[p].view(np.int64)))
                        least = int(np.argmin(first[p : p + w]))
                        prints.append(int(first[p + least].view(np.int64)))
                        where.append(least)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.int64()), pa.array(prints, pa.int64()), pa.array(where, pa.int32())],
                ["item_id", "size", "hash", "print", "place"],
            )

    return run


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, hash (of a window's words), print (its least k-gram), place (of that in the window)."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, _item_windows(window), "item_id long, size int, hash long, print long, place int")


class _Index:
    """Windows to look for, by size: short items have windows of their own lengths."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray, prints: np.ndarray):
        self.by_size = []
        for size in np.unique(sizes).tolist():
            own = sizes == size
            self.by_size.append((size, np.unique(prints[own]), np.unique(hashes[own])))

    def hits(self, values: np.ndarray, owner: np.ndarray):
        """(size, start, hash) of each occurrence of a window, for words of texts laid end to end."""
        for size, prints, hashes in self.by_size:
            k = min(K, size)
            first = grams(values, k)
            kept = winnow(first, size - k + 1)
            kept = kept[_among(first[kept], prints)]
            if not len(kept):
                continue
            starts = np.unique((kept[:, None] - np.arange(size - k + 1)).ravel())
            starts = starts[(starts >= 0) & (starts + size <= len(values))]
            starts = starts[owner[starts] == owner[starts + size - 1]]
            if not len(starts):
                continue
            whole = np.zeros(len(starts), np.uint64)
            for i in range(size):
                whole *= np.uint64(0x9E3779B97F4A7C15)
                whole += values[starts + i]
            whole = mix(whole)
            found = _among(whole, hashes)
            yield size, starts[found], whole[found]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _hits(index):
    def run(batches):
        looked = _Index(*index.value)
        for batch in batches:
            texts = texts_of(batch)
            n_words = np.zeros(len(texts), np.int64)
            spans: list[list] = [[] for _ in texts]
            found: list[list] = [[] for _ in texts]
            for a, b in chunks(texts):
                words, values = _hashed([words_of(t) for t in texts[a:b]])
                n_words[a:b] = words.lengths
                owner = words.owner()
                cover = np.zeros(len(values) + 1, np.int64)
                hit = []
                for size, starts, hashes in looked.hits(values, owner):
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + size, -1)
                    hit.append((owner[starts], hashes.view(np.int64)))
                if not hit:
                    continue
                for t, h in np.unique(np.concatenate([np.stack(x, axis=1) for x in hit]), axis=0).tolist():
                    found[a + t].append(h)
                inside = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
                for lo, hi in edge.reshape(-1, 2).tolist():
                    while lo < hi:  # a run may go from one text into the next
                        t = int(owner[lo])
                        stop = min(hi, int(words.bounds[t + 1]))
                        spans[a + t].append({"start": lo - int(words.bounds[t]), "stop": stop - int(words.bounds[t])})
                        lo = stop
            kind = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            out = {c: batch.column(c) for c in batch.schema.names}
            old_spans, old_found = batch.column("_spans").to_pylist(), batch.column("_windows").to_pylist()
            out["_n_words"] = pa.array(n_words)
            out["_spans"] = pa.array([x + y for x, y in zip(old_spans, spans, strict=True)], pa.list_(kind))
            out["_windows"] = pa.array([x + y for x, y in zip(old_found, found, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([out[c] for c in batch.schema.names], batch.schema.names)

    return run


def find_windows(documents: DataFrame, windows: DataFrame, columns: Sequence[str], pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """`columns` of documents with _n_words, _spans (hit words, by pass) and _windows (hashes found).

    windows: size, hash, print; different ones. At most `pass_windows` of them, 20 bytes each, are sent to the
    tasks at a time; a larger benchmark takes further passes over the documents.
    """
    spark = documents.sparkSession
    n = windows.count()
    passes = max(1, -(-n // pass_windows))
    state = documents.select(
        *columns,
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("_n_words"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("_spans"),
        F.array().cast("array<long>").alias("_windows"),
    )
    for i in range(passes):
        own = windows.filter(F.pmod(F.xxhash64("hash", "size"), F.lit(passes)) == i).toArrow()
        size, whole, first = (own.column(c).to_numpy().astype(np.int64) for c in ("size", "hash", "print"))
        index = spark.sparkContext.broadcast((size, whole.view(np.uint64), first.view(np.uint64)))
        state = map_batches(state, _hits(index), state.schema)
    return state.drop("text")


def contamination(documents: DataFrame, benchmark: DataFrame, columns: Sequence[str] = ("doc_id",), window: int = WINDOW, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """`columns` of documents with n_words, n_hit, n_items, item_ids, spans and contaminated.

    A window is `window` consecutive words of an item; an item with fewer words, but not none,
    is one window. A word of a document is hit if it lies in an occurrence of a window; `spans`
    (start, stop) are the hit words by number. item_ids are the items with occurring windows,
    as sorted strings. Null texts have no words and null item_ids are left out of the lists.
    One row for each row of documents; an empty benchmark hits nothing.
    """
    windows = materialize(item_windows(benchmark, window), "windows")
    distinct = windows.select("size", "hash", "print").distinct()
    held = [f"_column{i}" for i in range(len(columns))]
    rows = documents.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(columns, held, strict=True)], F.col("text").cast("string").alias("text"))
    marked = find_windows(rows, distinct, held, pass_windows)
    spans = F.array_sort("_spans")
    union = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["stop"] - F.greatest(s["end"], x["start"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end")
        ),
    )["n"]
    marked = marked.select(*held, F.col("_n_words").alias("n_words"), union.alias("n_hit"), spans.alias("spans"), F.array_sort(F.array_distinct("_windows")).alias("_windows"))
    marked = materialize(marked, "marked")
    sets = marked.filter("size(_windows) > 0").select("_windows").distinct().withColumn("_set", F.sha2(F.array_join("_windows", ","), 256))
    pairs = sets.select("_set", F.explode("_windows").alias("_hash"))
    named = windows.select("item_id", "hash").distinct()
    items = pairs.join(named, F.col("_hash") == F.col("hash")).select("_set", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("_set").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    items = materialize(items.withColumnRenamed("_set", "_of"), "items")
    hit = marked.filter("size(_windows) > 0").withColumn("_set", F.sha2(F.array_join("_windows", ","), 256))
    hit = hit.join(items, F.col("_set") == F.col("_of"), "left").drop("_set", "_of")
    clean = marked.filter("size(_windows) = 0").withColumn("item_ids", F.lit(None).cast("array<string>"))
    out = hit.unionByName(clean).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    out = out.select(*held, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans", (F.col("n_hit") > 0).alias("contaminated"))
    return out.toDF(*columns, *out.columns[len(held) :])


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """documents without those that hold a benchmark window; null texts and equal rows stay, an empty benchmark drops nothing."""
    distinct = item_windows(benchmark, window).select("size", "hash", "print").distinct()
    names = documents.columns
    held = [f"_column{i}" for i in range(len(names))]
    carried = documents.select(*[F.col(f"`{n}`").alias(h) for n, h in zip(names, held, strict=True)], F.col("text").cast("string").alias("text"))
    marked = find_windows(carried, materialize(distinct, "windows"), held, pass_windows)
    return marked.filter("size(_windows) = 0").select(*[F.col(h).alias(n) for n, h in zip(names, held, strict=True)])
