import random
from collections import Counter

import numpy as np

from scarp.llm import quality

TABLE = "/root/testdata/sf0.01"


def brute(text):
    raw = (text or "").encode()
    words = raw.split()
    chars = sum(len(w.decode()) for w in words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return [len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)]


def texts():
    rng = random.Random(1)
    vocabulary = ["a", "bb", "é", "中文", "x|", "#$", "don't", "A\x0bB", " "]
    out = [None, "", " ", "\n\n"]
    for n in (1, 7, 8, 9, 30, 300):
        out += [rng.choice([" ", "\n", "\t ", "\r\n"]).join(rng.choices(vocabulary, k=n)) for _ in range(6)]
    out += ["a b c d e f g h " * 3, "one line\none line\n one line\n"]
    return out


def test_counts_equal_brute_force():
    all_texts = texts()
    counts, _ = quality.statistics([(t or "").encode() for t in all_texts])
    assert counts.tolist() == [brute(t) for t in all_texts]


def test_query_counts_on_the_table(spark):
    from scarp.llm import queries

    got = queries.op2_quality_rules(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want, have = brute(r["text"]), got.loc[r["doc_id"]]
        assert [have[c] for c in quality.COUNTS] == want
        assert have["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (have["base_failed"] and have["kept"])


def test_flat_trees_equal_a_recursive_walk_and_keep_directions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(3000) > 0).astype(float)
    trees = quality.grow(x, y, [1, -1, 0, 0], trees=30)

    def walk(row, n):
        while trees.left[n] != n:
            n = trees.left[n] if row[trees.feature[n]] <= trees.threshold[n] else trees.right[n]
        return trees.value[n]

    assert np.allclose(trees.score(x[:50]), [trees.base + sum(walk(r, n) for n in trees.roots) for r in x[:50]])
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((50, 1, 4)), 40, axis=1)
        grid[:, :, j] = np.linspace(0, 1, 40)
        steps = np.diff(trees.score(grid.reshape(-1, 4)).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{TABLE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.assess(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    good = got[got.quality == 1]
    assert good.kept.mean() > 0.95
    assert (~got[got.quality == 0].kept).mean() > 0.85
