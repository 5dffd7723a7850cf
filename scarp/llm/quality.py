"""Quality rules: boosted trees over document statistics.

Statistics of whole texts are counted in numpy on Arrow batches. Gradient-boosted trees for the
logistic loss are grown on a bounded sample of labelled documents, with monotonic constraints (more symbols,
repetition, capitals or cries never raise the score), and flattened into node arrays, so that
scoring a batch walks all its documents down each tree at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, grams, map_batches, mix, texts_of

#: The most labelled documents that the trees are grown on, drawn by a hash of the doc_id.
TRAIN_ROWS = 20_000
REPEAT = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Each feature with the direction in which it may move the score: 0 is free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": -1, "digits": 0,
    "cries": -1, "bars": -1, "distinct": 0, "stops": 0, "wide": 0, "lines": 0, "quotes": 0,
}
_CLASSES = {
    "space": b" \t\n\x0b\x0c\r", "symbols": b"#*$%&|<>", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "cries": b"!?",
    "bars": b"|", "stops": b".,;:", "wide": bytes(range(0xC0, 0x100)), "tail": bytes(range(0x80, 0xC0)), "lines": b"\n", "quotes": b"\"'()[]{}=_/\\",
}


def _repeated(words: Words) -> np.ndarray:
    """For each word, whether it lies in a window of REPEAT words that its text holds again."""
    owner = words.owner()
    inside = np.zeros(len(words.ids) + 1, np.int64)
    n = len(words.ids) - REPEAT + 1
    if n > 0:
        at = np.flatnonzero(owner[:n] == owner[REPEAT - 1 :])
        key = mix(grams(words.ids.astype(np.uint64) + np.uint64(1), REPEAT)[at] + owner[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        a, b = at[same], at[same + 1]
        exact = owner[a] == owner[b]
        for i in range(REPEAT):
            exact &= words.ids[a + i] == words.ids[b + i]
        starts = np.unique(np.concatenate((a[exact], b[exact])))
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + REPEAT, -1)
    return np.cumsum(inside)[:-1] > 0


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x COUNTS) and (texts x FEATURES)."""
    counts, features = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for a, b in chunks(texts):
        own = texts[a:b]
        words = Words([t.split() for t in own])
        ends = np.cumsum([len(t) for t in own], dtype=np.int64)
        data = np.frombuffer(b"".join(own), np.uint8)
        per = {}
        for name, members in _CLASSES.items():
            flag = np.zeros(256, np.int32)
            flag[list(members)] = 1
            total = np.concatenate(([0], np.cumsum(flag[data], dtype=np.int64)))
            per[name] = np.diff(total[np.concatenate(([0], ends))])
        n_bytes = np.diff(np.concatenate(([0], ends)))
        n_words = words.lengths
        word_chars = n_bytes - per["tail"] - per["space"]
        dup, lines = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for i, t in enumerate(own):
            full = [x for x in t.split(b"\n") if x.strip()]
            lines[i] = len(full)
            dup[i] = len(full) - len(set(full))
        flags = np.concatenate(([0], np.cumsum(_repeated(words))))
        repeats = np.diff(flags[words.bounds])
        owner = words.owner()
        first = np.unique(owner * len(words.unique) + words.ids) // max(1, len(words.unique)) if len(words.ids) else np.empty(0, np.int64)
        distinct = np.bincount(first, minlength=len(own))
        w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
        counts.append(np.stack([n_words, word_chars, per["symbols"], dup, repeats], axis=1))
        features.append(
            np.stack(
                [
                    np.log1p(n_words), word_chars / w, per["symbols"] / w, dup / np.maximum(lines, 1), repeats / w, per["capitals"] / c, per["digits"] / c,
                    per["cries"] / w, per["bars"] / w, distinct / w, per["stops"] / w, per["wide"] / c, per["lines"] / w, per["quotes"] / w,
                ],
                axis=1,
            )
        )
    return np.concatenate(counts), np.concatenate(features)


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own left and right."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def grow(x: np.ndarray, y: np.ndarray, directions: Sequence[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 1.0) -> Trees | None:
    """Boost trees for y in {0, 1}; None if y has fewer than two values."""
    if len(np.unique(y)) < 2:
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def node() -> int:
        n = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", n), ("right", n), ("value", 0.0)):
            nodes[k].append(v)
        return n

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        level = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
        leaves = []
        for _ in range(depth):
            following = []
            for n, rows, low, high in level:
                found = _split(binned[rows], g[rows], h[rows], cuts, directions, low, high, penalty, least)
                if found is None:
                    leaves.append((n, rows, low, high))
                    continue
                j, k, vl, vr = found
                goes = binned[rows, j] <= k
                a, b = node(), node()
                nodes["feature"][n], nodes["threshold"][n], nodes["left"][n], nodes["right"][n] = j, cuts[j][k], a, b
                middle = (vl + vr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[j]]
                following += [(a, rows[goes], *bounds[0]), (b, rows[~goes], *bounds[1])]
            level = following
        for n, rows, low, high in leaves + level:
            v = float(np.clip(g[rows].sum() / (h[rows].sum() + penalty), low, high)) * rate
            nodes["value"][n] = v
            f[rows] += v
    return Trees(
        np.array(nodes["feature"], np.int64), np.array(nodes["threshold"]), np.array(nodes["left"], np.int64),
        np.array(nodes["right"], np.int64), np.array(nodes["value"]), np.array(roots, np.int64), depth, base,
    )


def _split(binned, g, h, cuts, directions, low, high, penalty, least):
    """(feature, bin, left value, right value) of the best allowed split."""
    best, found = 1e-6, None
    total_g, total_h = g.sum(), h.sum()
    own = np.clip(total_g / (total_h + penalty), low, high)
    before = own * total_g - 0.5 * own * own * (total_h + penalty)
    for j, direction in enumerate(directions):
        size = len(cuts[j]) + 1
        if size < 2:
            continue
        gl = np.cumsum(np.bincount(binned[:, j], g, size))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], h, size))[:-1]
        gr, hr = total_g - gl, total_h - hl
        vl, vr = np.clip(gl / (hl + penalty), low, high), np.clip(gr / (hr + penalty), low, high)
        gain = vl * gl - 0.5 * vl * vl * (hl + penalty) + vr * gr - 0.5 * vr * vr * (hr + penalty) - before
        gain[(hl < least) | (hr < least) | ((vr - vl) * direction < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (j, k, float(vl[k]), float(vr[k]))
    return found


_COUNT_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Grow the trees from labels (doc_id, quality 0 or 1); null labels and ids are left out.

    At most `rows` labelled documents are used, those with the smallest hash of the doc_id. Without
    both kinds of labels there is no model, and assess() then goes by the base rule alone.
    """
    sample = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").cast("long").alias("_good"))
    sample = sample.orderBy(F.xxhash64("_doc"), "_doc").limit(rows)
    held = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_doc"))
    # of rows with one doc_id that with the smallest hash of the text, so there are at most `rows`
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    held = held.groupBy(F.col("_doc").alias("doc_id"), "_good").agg(first["text"].alias("text"))
    schema = "doc_id long, good long, features array<double>"

    def run(batches):
        for batch in batches:
            _, x = statistics(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_good"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "good", "features"])

    found = map_batches(held.select(F.col("doc_id").cast("long"), "_good", "text"), run, schema).toPandas()
    if found.empty:
        return None
    x = np.stack(found["features"].to_list())
    order = np.lexsort([*x.T, found["doc_id"].to_numpy()])  # sums do not depend on the order of arrival
    return grow(x[order], found["good"].to_numpy()[order].astype(float), list(FEATURES.values()))


def assess(documents: DataFrame, model: Trees | None, columns: Sequence[str] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """`columns` of documents with COUNTS, base_failed, score and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of eight; such
    documents are not kept. The others are kept if the trees' probability of good quality is
    at least `threshold` (always, without a model; score is then null). Null texts have no
    words. One row for each row of documents, which may hold anything else besides.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    given = [F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)]
    own = "text" not in columns  # a text that is returned anyway is not sent twice
    text = "_text" if own else names[list(columns).index("text")]
    rows = documents.select(*given, *[F.col("text").cast("string").alias("_text")] * own)
    limit = float(np.log(threshold / (1 - threshold)))

    def run(batches):
        for batch in batches:
            counts, x = statistics(texts_of(batch, text))
            failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
            score = model.score(x) if model else None
            kept = ~failed & (score >= limit) if model else ~failed
            out = [batch.column(n) for n in names] + [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            out += [pa.array(failed), pa.array(score, pa.float64()) if model else pa.nulls(len(x), pa.float64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(out, [*names, *COUNTS, "base_failed", "score", "kept"])

    fields = rows.drop("_text").schema
    for part in f"{_COUNT_SCHEMA}, base_failed boolean, score double, kept boolean".split(", "):
        fields = fields.add(*part.split(" "))
    return map_batches(rows, run, fields).toDF(*columns, *fields.names[len(columns) :])


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns; null and short texts go, equal rows share their fate, an empty table gives none."""
    kept = assess(documents, train(documents, labels), documents.columns)
    names = documents.columns
    held = [f"_d{i}" for i in range(len(names))]  # the table may have columns named like the statistics
    marked = kept.toDF(*held, *COUNTS, "base_failed", "score", "kept").filter("kept")
    return marked.select(*[F.col(h).alias(c) for h, c in zip(held, names, strict=True)])
