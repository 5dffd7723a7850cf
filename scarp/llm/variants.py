"""Grouping the spelling variants of a vocabulary without writing down pairs of words.

Words are ranked by frequency (ties by code points), so the best of some words is the one of the lowest rank.
Every word enters the wildcard groups (position, prefix, suffix), one for each place: two words of a group
differ by one replaced code point, so a group's size and its two lowest ranks tell every member how many words
are near to it there and which of them is best. Every deletion of a word enters the group of
the shortened string, which counts only if the vocabulary has that string: the word itself is then near to
all that lead to it. A group holds at most as many words as there are letters at one place, times
the places, whatever the size of the corpus. Keys are 128-bit hashes, so a long word costs no more than its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, mix, sorted_groups

MIN_LENGTH, MIN_COUNT = 7, 2
#: A near word is a word's form if it occurs so many times as often.
RATIO = 10
#: One in so many runs of letters, by a hash of document and run, loses a code point: the planted misspellings.
EVERY = 31
#: Words that a task counts before it hands its counts on, and characters of a text whose words are listed at once.
_HELD, _AT_ONCE = 300_000, 1 << 23
_WORD, _DELETION, _WILDCARD = 0, 1, 2
_RANK = (1 << 60) - 1
#: Odd multipliers of the two lanes of a key.
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _count(min_length: int, every: int):
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def flush(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not raw:
                    continue
                text, begin = raw.lower().decode(errors="replace"), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                found = Counter(letters.findall(text) if len(text) <= _AT_ONCE else (m.group() for m in letters.finditer(text)))
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), begin)
                    if every and not h % every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) >= _HELD:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    return run


def vocabulary(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """rank, word, n of the words of all texts, by falling n and rising code points.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, their A-Z lower-cased; if `every`
    divides h, the crc32 of `<doc_id>:<run>` (nothing stands for a null doc_id), the run loses its code
    point h % length (0 for every: none does). Null texts have no words, equal rows count each.
    """
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_batches(texts, _count(min_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counted.filter(F.col("n") >= min_count), "words")
    order = [F.col("n").desc(), F.col("word")]
    # the partition and the row within it, whose counts give each partition its first rank
    placed = materialize(words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row per partition
    bases, total = [], 0
    for row in sizes:
        bases.append((row["part"], total))
        total += row["count"]
    base = F.broadcast(placed.sparkSession.createDataFrame(bases, "part long, base long"))
    return materialize(placed.join(base, part == F.col("part")).select((F.col("base") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("rank"), "word", "n"), "ranked")


def _keys(min_length: int):
    """The keys of all groups that a word enters: of itself, of what its deletions leave, of its wildcards."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            rank = batch.column("rank").to_numpy().astype(np.int64)
            points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
            size = np.fromiter(map(len, words), np.int64, len(words))
            begin = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(words)), size)
            place = np.arange(len(points)) - begin[owner]
            wild, gone, own = [], [], []
            for lane in _LANES:
                # sums of random numbers of (code point, place): one of the string as it is, one of its letters moved left by one
                here = mix((points << np.uint64(32) | place.astype(np.uint64)) * lane)
                left = mix((points << np.uint64(32) | np.maximum(place - 1, 0).astype(np.uint64)) * lane)
                upto, left_upto = np.cumsum(here), np.cumsum(left)
                before = upto - here
                prefix = before - before[begin][owner]
                whole = upto[begin + size - 1] - before[begin]
                suffix = whole[owner] - prefix - here
                left_suffix = left_upto[begin + size - 1][owner] - left_upto
                length = size.astype(np.uint64)
                wild.append(mix(prefix * lane + mix(suffix + lane) + mix(length[owner] << np.uint64(32) | place.astype(np.uint64))))
                gone.append(mix(prefix + left_suffix + (length - np.uint64(1))[owner] * lane))
                own.append(mix(whole + length * lane))
            # deleting either of two equal neighbours leaves the same string
            fresh = np.concatenate((np.ones(1, bool), points[1:] != points[:-1])) | (place == 0)
            fresh &= (size > min_length)[owner]
            k1, k2 = (np.concatenate((o, g[fresh], w)).view(np.int64) for o, g, w in zip(own, gone, wild, strict=True))
            entry = np.concatenate((rank + (_WORD << 60), rank[owner[fresh]] + (_DELETION << 60), rank[owner] + (_WILDCARD << 60)))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(entry)], ["k1", "k2", "entry"])

    return run


def _groups(batches):
    """What a group tells each of its members: how many words are near to it there and the lowest of their ranks."""
    for k1, k2, entry in sorted_groups(batches, ["k1", "k2", "entry"], ("k1", "k2")):
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        size = np.diff(np.append(first, len(k1)))
        kind = entry[first] >> 60
        useful = (size > 1) & (kind != _DELETION)
        first, size, kind = first[useful], size[useful], kind[useful]
        if not len(first):
            continue
        rank = entry & _RANK
        group = np.repeat(np.arange(len(first)), size)
        rows = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + first[group]
        head = rows == first[group]
        best = np.where(head, rank[first + 1][group], rank[first][group])
        near = np.where(head | (kind[group] == _WILDCARD), size[group] - 1, 1)
        yield pa.RecordBatch.from_arrays([pa.array(rank[rows]), pa.array(near), pa.array(best)], ["rank", "near", "best"])


def near_words(ranked: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """rank, n_near, best: for each word with near words their number and the lowest rank."""
    keys = map_batches(ranked.select("rank", "word"), _keys(min_length), "k1 long, k2 long, entry long")
    dealt = keys.repartition("k1").sortWithinPartitions("k1", "k2", "entry")
    told = map_batches(dealt, _groups, "rank long, near long, best long")
    return told.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _follow(steps: DataFrame) -> DataFrame:
    """rank, root of steps (rank, to): where following them ends; each round doubles the steps that are followed."""
    while True:
        ahead = steps.select(F.col("rank").alias("to"), F.col("to").alias("beyond"))
        moved = materialize(steps.join(ahead, "to", "left").select("rank", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if not moved.agg(F.max("moved")).first()[0]:
            return moved.select("rank", F.col("to").alias("root"))
        steps = moved.select("rank", "to")


def group_variants(documents: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `vocabulary`.

    Words are near if they differ by one inserted, deleted or replaced code point. form: the near
    word of the largest n (ties: the first in code points), if that is at least ratio (over 1) times the word's; root:
    the last of the forms of forms, the word itself if it has none. Words of few occurrences or code
    points are in no group; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, else forms could go round in circles")
    ranked = vocabulary(documents, min_length, min_count, every)
    named = ranked.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    joined = ranked.join(near_words(ranked, min_length), "rank", "left").join(named, "best", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    found = materialize(
        joined.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("to"), F.when(has, F.col("best_word")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms"
    )
    roots = _follow(found.filter("to IS NOT NULL").select("rank", "to"))
    named = ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    return found.join(roots, "rank", "left").join(named, "root", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
