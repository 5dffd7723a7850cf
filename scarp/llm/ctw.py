"""Language-model scoring by context-tree weighting.

A text is its lower-cased words, joined by single spaces and ended by a line feed, as bytes. Each
byte is decomposed into eight binary decisions. A decision (the bits of the byte so far) has a tree of
contexts: the preceding 0 to DEPTH bytes. Every node predicts with the Krichevsky-Trofimov
estimate of its training counts, and the tree's weights mix the estimates of all depths:

    P_w = P_e / 2 + (product of the children's P_w) / 2,    and P_w = P_e at a leaf.

Every context that occurs in training is a node, so the trees grow with the corpus. They stay tables:
the grams (a byte after DEPTH others) of all texts are counted, dealt out by their latest bytes and
weighed from the leaves up, a few depths at a time; what the shallower contexts mix to is handed
back down, and each gram gets its one log probability. A gram that only held-out texts have meets
nodes without counts, which predict 1/2. The texts then add up their grams: the most
frequent FREQUENT_GRAMS are sent to all tasks, every other one is joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_batches, materialize, mix, sorted_groups, texts_of

DEPTH = 6
#: Grams and words that are sent to all tasks at most: 16 bytes each. All others are joined.
FREQUENT_GRAMS, FREQUENT_WORDS = 1 << 21, 1 << 18
_WORD, _GRAM, _END = 0, 1, 2
#: Occurrences that are gathered before they are counted, and counts that are held before they are handed on.
_GATHER, _FLUSH = 4_000_000, 3_000_000
#: Counts are compared in 16 steps for each doubling when the most frequent ones are chosen.
_STEPS = 16


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


class Stream:
    """Padded byte streams of some texts laid end to end.

    gram: for each byte its `depth` predecessors, the latest highest, and the byte itself lowest;
    owner: the number of its text. word, word_owner: a 64-bit hash and the text of each word.
    """

    def __init__(self, streams: list[bytes], depth: int = DEPTH):
        pad = bytes(depth)
        data = np.frombuffer(b"".join(x for s in streams for x in (pad, s)), np.uint8)
        sizes = np.fromiter(map(len, streams), np.int64, len(streams))
        starts = np.concatenate(([0], np.cumsum(sizes + depth)))[:-1]
        wide = data.astype(np.uint64)
        gram = wide[depth:].copy()
        for j in range(1, depth + 1):
            gram |= wide[depth - j : len(data) - j] << np.uint64(8 * (depth - j + 1))
        real = np.ones(len(data), bool)
        real[(starts[:, None] + np.arange(depth)).ravel()] = False
        self.gram = gram[real[depth:]]
        self.owner = np.repeat(np.arange(len(streams), dtype=np.int32), sizes)
        ends = np.flatnonzero(real & ((data == 32) | (data == 10)))
        last = np.concatenate(([True], data[ends[:-1]] == 10))
        begins = np.concatenate(([0], ends[:-1] + 1)) + depth * last
        full = ends > begins
        begins, ends = begins[full], ends[full]
        # a word's hash is the sum of its bytes' random numbers times powers of an odd number, one for each place
        if len(begins):
            size = ends - begins
            place = np.zeros(len(data), np.int32)
            place[begins] = begins
            place = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(place)
            powers = np.cumprod(np.full(int(size.max()), _ODD, np.uint64))
            terms = _RANDOM[data]
            terms *= powers[np.minimum(place, len(powers) - 1)]
            self.word = mix(np.add.reduceat(terms, np.stack((begins, ends), axis=1).ravel())[::2] + size.astype(np.uint64) * _RANDOM[0])
        else:
            self.word = np.empty(0, np.uint64)
        self.word_owner = np.repeat(np.arange(len(streams), dtype=np.int32), np.diff(np.searchsorted(begins, np.append(starts, len(data)))))


#: An odd multiplier; the random numbers of the bytes follow from it.
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = mix(mix(np.arange(1, 257, dtype=np.uint64) * _ODD))


class Tally:
    """Occurrences of 64-bit values, counted a few million at a time."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.raw.append(values)
        self.size += len(values)
        if self.size >= _GATHER:
            self.pack()

    def pack(self) -> None:
        if not self.size:
            return
        new = np.concatenate(self.raw)
        self.raw, self.size = [], 0
        new.sort()
        first = _starts(new)
        keys, counts = new[first], np.diff(np.append(first, len(new)))
        del new
        if len(self.keys):
            keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = _starts(keys)
            keys, counts = keys[first], np.add.reduceat(counts, first)
        self.keys, self.counts = keys, counts

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.pack()
        out = self.keys, self.counts
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def _count(depth: int):
    def run(batches):
        held = {(kind, out): Tally() for kind in (_WORD, _GRAM) for out in (False, True)}
        ends = 0

        def rows(kind, out):
            keys, n = held[kind, out].take()
            none = np.zeros(len(n), np.int64)
            columns = [np.full(len(keys), kind, np.int32), keys.view(np.int64), none if out else n, n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "n", "seen"])

        for batch in batches:
            texts, outs = texts_of(batch), batch.column("held_out").to_pylist()
            ends += len(texts) - sum(outs)
            for out in (False, True):
                some = [t for t, o in zip(texts, outs, strict=True) if o == out]
                for a, b in chunks(some):
                    own = Stream([stream(t.lower().split()) for t in some[a:b]], depth)
                    held[_GRAM, out].add(own.gram)
                    if not out:
                        held[_WORD, out].add(own.word)
                    del own
                    for key, tally in held.items():
                        if len(tally.keys) > _FLUSH:
                            yield rows(*key)
        for key in held:
            yield rows(*key)
        if ends:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([_END], pa.int32()), "key": [0], "n": [ends], "seen": [ends]})

    return run


def held_out(documents: DataFrame) -> DataFrame:
    """doc_id, text, held_out: whether crc32 of the doc_id as text leaves 1 when divided by 5. Null ids do not."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(crc % 5 == 1, F.lit(False)).alias("held_out"))


def count(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n, seen: how often each word and end occurs in training texts, and each byte gram there and in all texts."""
    found = map_batches(rows.select("text", "held_out"), _count(depth), "kind int, key long, n long, seen long")
    # tasks have counted already, so counts meet at their keys without another round of it
    return materialize(found.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "counts")


_TABLE = 1 << 13
#: log gamma of half the index.
_LOG_GAMMA = np.array([np.inf, *(math.lgamma(i / 2) for i in range(1, _TABLE))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For whole and half numbers above 0: a table, and Stirling's series beyond it."""
    out = _LOG_GAMMA[np.minimum((2 * x).astype(np.int64), _TABLE - 1)]
    large = np.flatnonzero(x >= _TABLE / 2)
    if len(large):
        z = x[large]
        out[large] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - math.log(math.pi) - _log_gamma(n0 + n1 + 1.0)


class Level:
    """The nodes of one depth: name (context * 256 + the bits so far after a 1), zeros, ones and log P_w.

    mixed and left describe the contexts above a node: the mixture of their estimates of a 1, and the
    weight that is left for deeper ones.
    """

    def __init__(self, name, n0, n1, below=None):
        self.name, self.n0, self.n1 = name, n0, n1
        estimate = _log_kt(n0, n1)
        if below is None:
            self.total, self.weight = estimate, np.ones(len(name))
        else:
            self.total = np.logaddexp(estimate, below) - math.log(2)
            self.weight = np.exp(estimate - math.log(2) - self.total)

    @classmethod
    def known(cls, name, n0, n1, total):
        """Nodes whose P_w has been found from their children elsewhere."""
        own = cls(name, n0, n1)
        own.weight, own.total = np.exp(own.total - math.log(2) - total), total
        return own

    def parents(self) -> Level:
        """The nodes without the earliest byte; `self.up` then holds the place of each node's parent."""
        names, self.up = np.unique(_shorter(self.name), return_inverse=True)
        return Level(names, *(np.bincount(self.up, x, len(names)) for x in (self.n0, self.n1, self.total)))

    def enter(self, mixed, left):
        self.mixed, self.left = mixed, left

    def passed(self):
        """What a child of each node enters with."""
        own = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)
        return self.mixed + self.left * self.weight * own, self.left * (1 - self.weight)


def _shorter(name):
    return ((name >> 16) << 8) | (name & 255)


def _rise(level: Level, steps: int) -> list[Level]:
    levels = [level]
    for _ in range(steps):
        levels.append(levels[-1].parents())
    return levels


def _descend(levels: list[Level]) -> None:
    """Hand what the last (shallowest) level has been entered with down to the first."""
    for lower, upper in zip(levels[-2::-1], levels[:0:-1], strict=True):
        mixed, left = upper.passed()
        lower.enter(mixed[lower.up], left[lower.up])


class Leaves:
    """The deepest nodes of sorted grams with training counts; at[k]: the node of each gram's bit k."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.byte = gram & 255
        names, zeros, ones, self.at = [], [], [], []
        size = 0
        for k in range(8):
            name = ((gram >> 8) << 8) | (1 << k) | (self.byte >> (8 - k))
            first = _starts(name)
            bit = (self.byte >> (7 - k)) & 1
            names.append(name[first])
            zeros.append(np.add.reduceat(np.where(bit, 0.0, n), first))
            ones.append(np.add.reduceat(np.where(bit, n, 0.0), first))
            at = np.zeros(len(gram), np.int64)
            at[first[1:]] = 1
            self.at.append(np.cumsum(at) + size)
            size += len(first)
        self.level = Level(*(np.concatenate(x) for x in (names, zeros, ones)))

    def scores(self) -> np.ndarray:
        """log10 of the probability of each gram's byte after its context."""
        one, _ = self.level.passed()
        out = np.zeros(len(self.byte))
        for k, at in enumerate(self.at):
            out += np.log10(np.where((self.byte >> (7 - k)) & 1, one[at], 1 - one[at]))
        return out


def _nodes(*columns, names=("name", "n0", "n1", "total")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(names))


_NODES = "name long, n0 double, n1 double, total double"


def _rise_from_grams(steps: int):
    def run(batches):
        for _, gram, n in sorted_groups(batches, ["part", "key", "n"], "part"):
            top = _rise(Leaves(gram, n).level, steps)[-1]
            yield _nodes(top.name, top.n0, top.n1, top.total)

    return run


def _rise_from_nodes(steps: int):
    def run(batches):
        for _, *node in sorted_groups(batches, ["part", "name", "n0", "n1", "total"], "part"):
            top = _rise(Level.known(*node), steps)[-1]
            yield _nodes(top.name, top.n0, top.n1, top.total)

    return run


def _through_nodes(steps: int, top):
    """What each node is entered with; `top` tells what the parents of the shallowest ones hand down."""

    def run(batches):
        names, mixed, left = top.value
        for _, *node in sorted_groups(batches, ["part", "name", "n0", "n1", "total"], "part"):
            levels = _rise(Level.known(*node), steps)
            at = np.searchsorted(names, _shorter(levels[-1].name))
            levels[-1].enter(mixed[at], left[at])
            _descend(levels)
            yield _nodes(levels[0].name, levels[0].mixed, levels[0].left, names=("name", "mixed", "left"))

    return run


def _score_grams(steps: int):
    """Rows of both kinds come by part: first what its shallowest nodes are entered with, then its grams."""

    def run(batches):
        for _, kind, key, a, b in sorted_groups(batches, ["part", "kind", "key", "a", "b"], "part"):
            entered, grams = kind == 0, kind == 1
            gram = key[grams]
            if not len(gram):
                continue
            leaves = Leaves(gram, a[grams])
            levels = _rise(leaves.level, steps)
            at = np.searchsorted(key[entered], levels[-1].name)
            levels[-1].enter(a[entered][at], b[entered][at])
            _descend(levels)
            yield _nodes(gram, b[grams].astype(np.int64), leaves.scores(), names=("key", "seen", "value"))

    return run


def _top(nodes: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """names, mixed, left that nodes of the given depth (0 or 1, at most 65,280) hand down, from the nodes below them."""
    up = F.shiftleft(F.shiftright("name", 16), 8) + F.col("name").bitwiseAND(F.lit(255).cast("long"))
    found = nodes.groupBy(up.alias("name")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("below")).orderBy("name").toArrow()
    levels = _rise(Level(*(found.column(c).to_numpy() for c in ("name", "n0", "n1", "below"))), depth)
    levels[-1].enter(np.zeros(len(levels[-1].name)), np.ones(len(levels[-1].name)))
    _descend(levels)
    return levels[0].name, *levels[0].passed()


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, seen, value: the log10 probability of each gram's byte after its context.

    counts: key (gram), n (in training), seen (anywhere). Grams are dealt out by the latest `low`
    bytes of their contexts, the nodes of that depth by the latest `high`, and what is left are at most
    65,280 nodes of depth 1 and 255 of depth 0, which the driver weighs.
    """
    low = max(1, depth - 2)
    high = min(2, low)
    grams = counts.select(F.shiftright("key", 8 * (depth - low + 1)).alias("part"), "key", "n", "seen")
    dealt = grams.select("part", "key", "n").repartition("part").sortWithinPartitions("part", "key")
    nodes = materialize(map_batches(dealt, _rise_from_grams(depth - low), _NODES), "nodes")
    shared = nodes.select(F.shiftright("name", 8 * (low - high + 1)).alias("part"), *nodes.columns).repartition("part").sortWithinPartitions("part", "name")
    risen = nodes if low == high else materialize(map_batches(shared, _rise_from_nodes(low - high), _NODES), "nodes")
    top = counts.sparkSession.sparkContext.broadcast(_top(risen, high - 1))
    entered = materialize(map_batches(shared, _through_nodes(low - high, top), "name long, mixed double, left double"), "entered")
    both = entered.select(F.shiftright("name", 8).alias("part"), F.lit(0).alias("kind"), F.col("name").alias("key"), F.col("mixed").alias("a"), F.col("left").alias("b")).unionByName(
        grams.select("part", F.lit(1).alias("kind"), "key", F.col("n").cast("double").alias("a"), F.col("seen").cast("double").alias("b"))
    )
    ordered = both.repartition("part").sortWithinPartitions("part", "kind", "key")
    return materialize(map_batches(ordered, _score_grams(depth - low), "key long, seen long, value double"), "gram_scores")


class Sent:
    """The values of some keys, sent to all tasks: looked up by their mixed bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = mix(keys.view(np.uint64))
        order = np.argsort(mixed)
        last = np.uint64(2**64 - 1)
        self.mixed = np.append(mixed[order], last)
        self.values = np.append(values[order], 0.0)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.mixed[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 for those not sent; whether they were)."""
        wanted = mix(keys)
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        found = self.mixed[at]
        late = np.flatnonzero(found < wanted)
        while len(late):
            at[late] += 1
            found[late] = self.mixed[at[late]]
            late = late[found[late] < wanted[late]]
        hit = (found == wanted) & (at < len(self.mixed) - 1)
        return np.where(hit, self.values[at], 0.0), hit


def _bucket(column: str):
    return F.floor(F.log2(F.col(column).cast("double")) * _STEPS).cast("int")


def send(table: DataFrame, most: int) -> tuple[Sent, DataFrame]:
    """(the values of the most frequent keys, at most `most`; the other rows) of key, seen, value."""
    steps = sorted(table.groupBy(_bucket("seen").alias("step")).count().collect(), reverse=True)
    least, taken = None, 0
    for r in steps:
        if taken + r["count"] > most:
            break
        least, taken = r["step"], taken + r["count"]
    if least is None:
        return Sent(np.empty(0, np.int64), np.empty(0)), table
    found = table.filter(_bucket("seen") >= least).select("key", "value").toArrow()
    return Sent(found.column("key").to_numpy(), found.column("value").to_numpy()), table.filter(_bucket("seen") < least)


def _by_text(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, times) of equal keys of a text."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.empty(0, np.int64)
    return owner[first].astype(np.int64), keys[first], np.diff(np.append(first, len(keys)))


def _score(depth: int, grams, words):
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = texts_of(batch)
            n = len(texts)
            tokens, known, n_bytes = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            score, base = np.zeros(n), np.zeros(n)
            rare: dict[int, list] = {_WORD: [], _GRAM: []}
            for a, b in chunks(texts):
                own = Stream([stream(t.lower().split()) for t in texts[a:b]], depth)
                size = b - a
                n_bytes[a:b] = np.bincount(own.owner, minlength=size)
                tokens[a:b] = np.bincount(own.word_owner, minlength=size) + 1
                value, hit = grams.value.find(own.gram)
                score[a:b] = np.bincount(own.owner, value, size)
                where, *rest = _by_text(own.gram[~hit], own.owner[~hit])
                rare[_GRAM].append((where + a, *rest))
                value, hit = words.value.find(own.word)
                base[a:b] = np.bincount(own.word_owner, value, size)
                known[a:b] = np.bincount(own.word_owner, hit, size).astype(np.int64)
                where, *rest = _by_text(own.word[~hit], own.word_owner[~hit])
                rare[_WORD].append((where + a, *rest))
                del own, value, hit
            columns = {
                "row": pa.array(row + np.arange(n)), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_bytes": pa.array(n_bytes),
                "n_tokens": pa.array(tokens), "known": pa.array(known), "base": pa.array(base), "score": pa.array(score),
            }
            for kind, name in ((_WORD, "words"), (_GRAM, "grams")):
                where, keys, times = (np.concatenate(x) for x in zip(*rare[kind], strict=True)) if rare[kind] else (np.empty(0, np.int64),) * 3
                bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(where, minlength=n)))).astype(np.int32))
                columns[name] = pa.ListArray.from_arrays(bounds, pa.array(keys.view(np.int64)))
                columns[f"{name}_times"] = pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32)))
            row += n
            yield pa.RecordBatch.from_pydict(columns)

    return run


_SCORED = (
    "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, score double, "
    "words array<long>, words_times array<int>, grams array<long>, grams_times array<int>"
)


def score(documents: DataFrame, depth: int = DEPTH, frequent: tuple[int, int] = (FREQUENT_GRAMS, FREQUENT_WORDS)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the documents that are not held out and scores all, one row for each row; equal rows
    get equal scores, and other columns are not read. doc_ids must be numbers or null.
    Tokens are the lower-cased (A-Z) words between ASCII white space, then one end.
    base_score is the log10 probability under smoothed word frequencies; score that of the
    byte stream under the context trees and bits_per_byte the same as a code length. A null or
    empty text is the end alone. An empty table gives no rows. Without any training document every bit has probability 1/2.
    """
    spark = documents.sparkSession
    rows = held_out(documents)
    counts = count(rows, depth)
    facts = {r["kind"]: r for r in counts.filter("n > 0").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    total = sum(facts[k]["n"] for k in (_WORD, _END) if k in facts)
    distinct = sum(facts[k]["v"] for k in (_WORD, _END) if k in facts)
    ends = facts[_END]["n"] if _END in facts else 0
    grams, rare_grams = send(gram_scores(counts.filter(F.col("kind") == _GRAM).drop("kind"), depth), frequent[0])
    of_words = counts.filter(F.col("kind") == _WORD).select("key", "seen", F.log10(F.col("n") + F.lit(0.5)).alias("value"))
    words, rare_words = send(of_words, frequent[1])
    sent = [spark.sparkContext.broadcast(x) for x in (grams, words)]
    scored = materialize(map_batches(rows, _score(depth, *sent), _SCORED), "scored")

    def listed(kind, name):
        return scored.select("row", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(name).alias("key"), F.col(f"{name}_times").alias("times"))).alias("r")).select("row", "kind", "r.key", "r.times")

    values = rare_words.select(F.lit(_WORD).alias("kind"), "key", "value").unionByName(rare_grams.select(F.lit(_GRAM).alias("kind"), "key", "value"))
    value, word = F.col("times") * F.coalesce("value", F.lit(math.log10(0.5))), F.col("kind") == _WORD
    rare = listed(_WORD, "words").unionByName(listed(_GRAM, "grams")).join(values, ["kind", "key"], "left")
    more = rare.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(word, value)).alias("more_base"), F.sum(F.when(~word, value)).alias("more_score"), F.sum(F.when(word & F.col("value").isNotNull(), F.col("times"))).alias("more_known")
    )
    out = scored.join(more, F.col("row") == F.col("_row"), "left")
    norm = math.log10(total + 0.5 * (distinct + 1))
    end_score = math.log10(ends + 0.5)
    score_ = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + F.lit(end_score) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        score_.alias("score"),
        "n_bytes",
        (-score_ / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
