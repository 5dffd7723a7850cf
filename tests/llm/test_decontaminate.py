import random
import re

from scarp.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    wanted = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    found |= wanted[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(map(str, found))))
    return sorted(out)


def table():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("a b c d e f é Zed 12 x-y".split()) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(1, 40) if i % 6] + [(100, None), (101, "a rare sentence of eleven words that nobody else would write")]
    items = [(i, t) for i, t in items if len(WORD.findall(t or "")) != 1 or i < 0]
    docs = [(i, say(rng.choice([0, 5, 40, 200]))) for i in range(60)] + [(90, None), (91, "Before. " + items[-1][1].upper() + "! after")]
    return docs, items


def test_equal_to_brute_force(spark):
    docs, items = table()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 40):  # one pass, and several
        got = decontaminate.contamination(d, b, pass_windows=limit).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got) == brute(docs, items)


def test_spans_are_the_hit_words(spark):
    docs, items = table()
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    for r in got.collect():
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_hit"] and r["contaminated"] == (r["n_hit"] > 0)


def test_clean_documents_stay(spark):
    docs, items = table()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = decontaminate.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {x[0] for x in brute(docs, items) if not x[2]}


def test_empty_benchmark(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination(d, spark.createDataFrame([], "item_id long, text string")).first()["n_hit"] == 0
