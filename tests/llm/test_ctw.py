import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from scarp.llm import ctw


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


class Brute:
    """Context-tree weighting by recursion over dictionaries of byte contexts."""

    def __init__(self, streams, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.children, self.memo = defaultdict(set), {}
        for s in streams:
            data = bytes(depth) + s
            for i in range(depth, len(data)):
                x = data[i]
                for d in range(depth + 1):
                    for k in range(8):
                        self.counts[data[i - d : i], (1 << k) | (x >> (8 - k))][x >> (7 - k) & 1] += 1
        for context, prefix in self.counts:
            if context:
                self.children[context[1:], prefix].add((context, prefix))

    def weighted(self, node):
        if node not in self.memo:
            self.memo[node] = own = kt(*self.counts[node])
            if self.children[node]:
                below = sum(self.weighted(c) for c in self.children[node])
                top = max(own, below)
                self.memo[node] = top + math.log((math.exp(own - top) + math.exp(below - top)) / 2)
        return self.memo[node]

    def one(self, past, prefix, d=0):
        node = past[len(past) - d :], prefix
        if node not in self.counts:
            return 0.5
        n0, n1 = self.counts[node]
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == self.depth:
            return own
        w = math.exp(kt(n0, n1) - math.log(2) - self.weighted(node))
        return w * own + (1 - w) * self.one(past, prefix, d + 1)

    def score(self, s):
        data, total = bytes(self.depth) + s, 0.0
        for i in range(self.depth, len(data)):
            for k in range(8):
                p = self.one(data[i - self.depth : i], (1 << k) | (data[i] >> (8 - k)))
                total += math.log10(p if data[i] >> (7 - k) & 1 else 1 - p)
        return total


def corpus(n=40):
    rng = random.Random(4)
    words = ["the", "Thing", "an", "é", "ñandú", "x1", "中"]
    return [(i, " ".join(rng.choices(words + [f"u{rng.randrange(50)}"], k=rng.randrange(12)))) for i in range(n)] + [(1000, None), (1001, ""), (1002, "zzz qqq\n zzz")]


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize(("n", "depth", "frequent"), [(40, 1, 1 << 20), (40, 2, 0), (40, 3, 100), (5, 6, 1 << 20), (40, 6, 0), (300, 6, 300), (300, 4, 1 << 20), (40, 5, 20)])
def test_scores_equal_a_recursive_tree(spark, n, depth, frequent):
    """With all, some or none of the grams sent to the tasks, at several sizes of the corpus."""
    docs = corpus(n)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    streams = {i: ctw.stream((t or "").encode().lower().split()) for i, t in docs}
    tree = Brute([s for i, s in streams.items() if not is_held(i)], depth)
    for r in ctw.score(df, depth, (frequent, frequent)).collect():
        assert math.isclose(r["score"], tree.score(streams[r["doc_id"]]), rel_tol=1e-9)


def test_small_chunks_change_nothing(spark, monkeypatch):
    """Counts and trees that are handled a few rows at a time."""
    import numpy as np

    streams = [ctw.stream((t or "").encode().lower().split()) for _, t in corpus()]
    tally = ctw.Tally()
    monkeypatch.setattr(ctw, "_GATHER", 7)
    for s in streams:
        tally.add(ctw.Stream([s], 4).gram)
    keys, counts = tally.take()
    want, n = np.unique(ctw.Stream(streams, 4).gram, return_counts=True)
    assert keys.tolist() == want.tolist() and counts.tolist() == n.tolist()
    part = (keys >> np.uint64(16)).astype(np.int64)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"part": part[i : i + 5], "key": keys[i : i + 5].view(np.int64)}) for i in range(0, len(keys), 5)]
    groups = list(ctw.sorted_groups(batches, ["part", "key"], "part", 12))
    assert len(groups) > 5 and np.concatenate([g[1] for g in groups]).tolist() == keys.tolist()
    assert all(a[0][-1] < b[0][0] for a, b in zip(groups, groups[1:], strict=False))


def test_sent_values_are_found():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 56, n))
        sent = ctw.Sent(keys, keys * 0.5)
        asked = np.concatenate((keys, keys + 1, [0, 5])).view(np.uint64)
        value, hit = sent.find(asked)
        assert hit.tolist() == np.isin(asked.view(np.int64), keys).tolist()
        assert (value == np.where(hit, asked.view(np.int64) * 0.5, 0.0)).all()


def test_base_scores_and_counts(spark):
    docs = corpus()
    c = Counter()
    for i, t in docs:
        if not is_held(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    for frequent in ((1 << 20, 1 << 20), (5, 5)):  # all words sent out, or most of them joined
        for r in ctw.score(spark.createDataFrame(docs, "doc_id long, text string"), frequent=frequent).collect():
            w = [*(dict(docs)[r["doc_id"]] or "").encode().lower().split(), None]
            assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, is_held(r["doc_id"]))


def test_predictions_add_up_to_one(spark):
    import numpy as np

    streams = [ctw.stream((t or "").encode().lower().split()) for _, t in corpus()]
    unique, n = np.unique(ctw.Stream(streams, 3).gram, return_counts=True)
    counts = dict(zip(unique.tolist(), n.tolist(), strict=True))
    contexts = (b"eht", bytes(3), b"\xffqq")  # the latest byte first
    asked = {(int.from_bytes(c, "big") << 8) | b for c in contexts for b in range(256)}
    rows = [(g, counts.get(g, 0), 1) for g in asked | counts.keys()]
    got = {r["key"]: r["value"] for r in ctw.gram_scores(spark.createDataFrame(rows, "key long, n long, seen long"), 3).collect()}
    assert len(got) == len(rows)
    for c in contexts:
        assert abs(sum(10 ** got[(int.from_bytes(c, "big") << 8) | b] for b in range(256)) - 1) < 1e-9


def test_word_hashes_tell_words_apart():
    import numpy as np

    texts = [b"", b"a b a", b"\xc3\xa9 ab ba a\0b", b"a" * 3000, b"a" * 2999]
    got = ctw.Stream([ctw.stream(t.split()) for t in texts], 4)
    words = [w for t in texts for w in t.split()]
    assert got.word_owner.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    same = {}
    assert all(same.setdefault(w, h) == h for w, h in zip(words, got.word.tolist(), strict=True)) and len(np.unique(got.word)) == len(set(words))


def test_about_as_good_as_word_frequencies_on_a_small_corpus(spark):
    """On two million bytes the two are level; the tree gains with the corpus (README)."""
    from scarp.llm import queries

    got = queries.op10_context_tree(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert got.score.sum() > 1.01 * got.base_score.sum()


def test_rare_contexts_stay_in_a_large_corpus(spark):
    rng = random.Random(8)
    rare = " ".join("".join(rng.choices("cdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40))
    training = [i for i in range(60) if not is_held(i)][:43]
    held = next(i for i in range(100, 200) if is_held(i))
    rows = [(i, "ab " * 18_000) for i in training[3:]] + [(i, rare) for i in training[:3]] + [(held, rare)]
    assert sum(len(t) for _, t in rows) > 4 << 19  # three occurrences are fewer than 1 / 2^19 of it
    got = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held] < 3
