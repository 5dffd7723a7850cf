import random

import numpy as np

from scarp.llm import simhash


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(fps))]


def near(rng, base, n):
    out = []
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randrange(6)):
            x ^= 1 << b
        out.append(x)
    return out


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    fps = sorted({x for _ in range(30) for x in near(rng, rng.getrandbits(64), 20)} | {rng.getrandbits(64) for _ in range(300)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for block in (4, 64, 2048):
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block).collect()
        at = {x: i for i, x in enumerate(signed)}
        parent = list(range(len(fps)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in ((at[r["a"]], at[r["b"]]) for r in found):
            assert int(fps[a] ^ fps[b]).bit_count() <= 3
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        assert [root(i) for i in range(len(fps))] == brute_components(np.array(fps, np.uint64), list(range(len(fps))))


def test_every_pair_within_distance_passes_a_chain():
    rng = random.Random(1)
    for _ in range(3000):
        x = np.uint64(sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
        assert any(simhash._chains(np.array([s]), np.array([x]))[0] for s in range(simhash.SEGMENTS))


def test_components_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    fps = np.array([simhash.fingerprint((texts[i] or "").encode().lower().split(), 3) for i in got.doc_id], np.uint64)
    assert (fps.view(np.int64) == got.fp.to_numpy()).all()
    assert brute_components(fps, got.doc_id.tolist()) == got.component_id.tolist()


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint([], 3) == 0
    assert simhash.fingerprint([b"a", b"b"], 3) == xxhash.xxh64_intdigest(b"a b", 42)


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long), (9, long + " x"), (1, "other words here"), (1, "other words here"), (None, None), (7, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) in ([1, 3, 7], [1, 3, 7, 9])
