import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scarp.llm import queries, variants

SF = "/root/testdata/sf0.001"


def brute(rows, min_length=7, min_count=2, ratio=10, every=31):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    found = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        found[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    out = {}
    for w, (form, n, n_near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (form, root, n, n_near, counts.get(form))
    return out


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def as_dict(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(queries.SQL["op12_spelling_variants"]).df()
    got = queries.op12_spelling_variants(spark, SF).toPandas()
    tidy = lambda df: df[sorted(df.columns)].sort_values("word").reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)
    assert got.form.notna().sum() > 0


@pytest.mark.parametrize("seed", range(3))
def test_crowded_words_equal_brute_force(spark, seed):
    r = random.Random(seed)
    base = ["aaaaaaa", "abababa", "éaaaaaaÿ", "zzzzzzzz", "aaaaaaab"]
    words = set(base)
    for _ in range(250):
        w = r.choice(sorted(words))
        i = r.randrange(len(w))
        words.add(r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("abé") + w[i:], w[:i] + r.choice("abÀ") + w[i + 1 :])))
    rows = [(d, " ".join(w for w in sorted(words) for _ in range(r.choice((0, 1, 1, 3, 40)) if r.random() < 0.9 else 900))) for d in range(6)]
    got = as_dict(variants.group_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = brute(rows)
    assert got == want and any(w[0] for w in want.values()) and any(w[1] not in (k, w[0]) for k, w in want.items())


def test_hard_rows(spark):
    long = "ab" * 60_000
    rows = [(1, None), (None, "Wörterbuch wörterbuch Wörterbuch"), (2, ""), (3, long), (4, long), (4, long[:-1] + "c"), (4, long[:-1] + "c"), (5, "nothing_here123again—twice\0twicetwice"), (5, "TWICETWICE×x twicetwice×x"), (6, " " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit(1), "word": F.lit("x"), "n": F.lit(2), "a.b": F.lit(3)})
    got, want = as_dict(variants.group_variants(d, every=0)), brute(rows, every=0)
    assert got == want and got[long][3] == 1
    assert variants.group_variants(d.limit(0)).count() == 0
    assert variants.group_variants(d.filter("doc_id = 1")).count() == 0


def test_no_group_needs_pairs(spark):
    """A thousand words that differ in one place give a row of keys for each place, not for each pair."""
    words = [f"wort{chr(0xC0 + i % 23)}{chr(0xE0 + i // 23)}x" for i in range(500)]
    d = spark.createDataFrame([(1, " ".join(words * 2))], "doc_id long, text string")
    ranked = variants.vocabulary(d, every=0)
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(500))
    assert variants.near_words(ranked).agg(F.count("*"), F.max("n_near")).first() == (500, 22 + 21)
