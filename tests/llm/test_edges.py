"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from scarp.llm import chat, ctw, decontaminate, lines, mixing, passages, quality, queries, secrets, simhash, tokens
from scarp.llm.common import new_path

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ROWS = [
    (0, None, "a"), (1, "", "a"), (2, "one", None), (3, "one two", "b"), (4, LONG, "b"), (5, LONG, "c"), (5, LONG, "c"), (6, "   \n\t ", "a"),
    (None, "no id at all here", "a"), (None, None, None), (7, "x" * 100_000, "b"), (8, "same line\nsame line\nother", "c"), (9, "é ñ ü 中文 x y", "a"), (9, "another text, same id", "a"),
]
EXTRA = {"size": 1, "rate": 2.0, "hash": 3, "fp": 4, "kept": 5, "rest": "x", "copies": 7, "cleaned": "y", "n_words": 8, "seed": 9, "tid": 10, "_text": "z", "key": 1, "row": 2, "score": 3, "meta.url": "u"}


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "w1 w2 w3")], "item_id long, text string").withColumn("size", F.lit(1)).withColumn("hash", F.lit(2))


def labels(spark, rows=((1, 1), (4, 0), (4, 0), (None, 1), (8, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality long").withColumn("kept", F.lit(1))


def words(spark):
    return spark.createDataFrame([("word",)], "word string")


OPERATORS = {
    "quality": lambda s, d: quality.assess(d, quality.train(d, labels(s))),
    "keep_good": lambda s, d: quality.keep_good(d, labels(s)),
    "secrets": lambda s, d: secrets.scan(d, ["1.0D"], words(s)),
    "mixing": lambda s, d: mixing.mix(d),
    "passages": lambda s, d: passages.report(d),
    "lines": lambda s, d: lines.remove_boilerplate(d, min_sites=2),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "keep_one": lambda s, d: simhash.keep_one(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "drop_contaminated": lambda s, d: decontaminate.drop_contaminated(d, benchmark(s)),
    "ctw": lambda s, d: ctw.score(d),
}
ONE_ROW_EACH = ("quality", "mixing", "lines", "simhash", "decontaminate", "ctw")
SAME_COLUMNS = ("keep_good", "keep_one", "drop_contaminated")


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(spark, name):
    d = documents(spark)
    got = OPERATORS[name](spark, d)
    if name in SAME_COLUMNS:
        assert got.columns == d.columns
    n = got.count()
    if name in ONE_ROW_EACH:
        assert n == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).count() == 0


def test_tokens_hard_rows(spark):
    path = new_path(spark, "edge")
    tokens.write_tokens(documents(spark), path, queries.tokenizer_path())
    got = tokens.read_tokens(spark, path).toPandas()
    assert len(got) == len(ROWS) and got.doc_id.isna().sum() == 2
    got = got.sort_values("start")
    assert (got.start + got.n_tokens).iloc[:-1].tolist() == got.start.iloc[1:].tolist()
    assert got.doc_id.dropna().is_monotonic_increasing and got.doc_id.iloc[:2].isna().all()


def test_tokens_empty_table(spark):
    path = new_path(spark, "edge")
    tokens.write_tokens(documents(spark, []), path, queries.tokenizer_path())
    assert tokens.read_tokens(spark, path).count() == 0


def test_chat_hard_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "a\nb", "<|im_end|>"), (2, 1, "<|x|>", ""), (3, 0, "assistant", "y" * 200_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit(1), "block": F.lit(2), "start": F.lit(3)})
    got = {r["conv_id"]: r for r in chat.format_chat(d).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", "x"), ("user", ""), ("user", "")]
    assert [tuple(t) for t in got[None]["turns"]] == [("a\nb", "<|im_end|>")] and len(got) == 4
    assert chat.format_chat(d.limit(0)).count() == 0


def test_no_labels_keeps_by_the_base_rule(spark):
    d = documents(spark)
    assert quality.train(d, labels(spark, [])) is None
    assert quality.train(d, labels(spark, [(4, 1)])) is None
    more = d.limit(0).select("doc_id", "text").unionByName(spark.createDataFrame([(50, " ".join(f"v{i}" for i in range(25)))], "doc_id long, text string"))
    got = quality.assess(d.select("doc_id", "text").unionByName(more), None)
    assert got.filter("kept").count() == 1 and got.filter("kept = base_failed OR score IS NOT NULL").count() == 0


def test_everything_held_out(spark):
    import zlib

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    d = spark.createDataFrame([(i, "a b", "s") for i in ids], "doc_id long, text string, source string")
    got = ctw.score(d).collect()
    assert all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["bits_per_byte"] - 8) < 1e-9 for r in got)


#: Names that the operators use themselves.
CLASHES = ("_doc", "_hash", "_id", "_text", "_source", "_column0", "_c0", "lam", "mean_size", "_at", "_cut", "_gap", "size", "rate", "target", "copies", "source_size", "_places", "_text_hash", "h1", "fp", "_n", "_all", "kept", "score")


def clashing(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def own_values_stay(df, replaced=()):
    row = df.first()
    assert all(row[c] == f"own {c}" for c in CLASHES if c not in replaced)


def test_clashing_columns_keep_their_values(spark):
    d = clashing(spark)
    got = lines.remove_boilerplate(d, min_sites=2)
    own_values_stay(got)
    cleaned = {(r["doc_id"], r["source"]): (r["cleaned"], r["n_lines"], r["n_removed"]) for r in got.collect()}
    assert cleaned[0, "a"] == (None, 0, 0) and cleaned[8, "c"] == ("same line\nsame line\nother", 3, 0) and cleaned[5, "c"] == ("", 1, 1)
    own_values_stay(simhash.keep_one(d))
    own_values_stay(mixing.mix(d), mixing.NEW)
    taken = mixing.take(d)
    assert taken.columns == d.columns
    own_values_stay(taken)
    found = decontaminate.contamination(d, benchmark(spark), ["doc_id", "text", "_column0", "n_hit"] if "n_hit" in d.columns else ["doc_id", "text", "_column0"])
    assert {(r["doc_id"], r["text"]) for r in found.filter("contaminated").collect() if r["doc_id"] == 3} == {(3, "one two")} and found.first()["_column0"] == "own _column0"
    own_values_stay(decontaminate.drop_contaminated(d, benchmark(spark)))


def test_of_rows_that_differ_elsewhere_the_same_one_stays(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = simhash.keep_one(df).collect()
    assert len(one) == 1 and all(simhash.keep_one(df.repartition(n)).collect() == one for n in (1, 2, 3))


def test_repeated_labelled_documents_train_on_one_text(spark):
    texts = [(i % 30, " ".join(f"w{(i * 7 + j) % (9 if i % 2 else 400)}" for j in range(60))) for i in range(90)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality long")
    one, two = (quality.assess(d.repartition(n), quality.train(d.repartition(n), marks)).select("doc_id", "score") for n in (1, 4))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    marks, items = labels(spark).select("doc_id", "quality"), benchmark(spark).select("item_id", "text")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"quality_rules": {4, 5}, "simhash_near_dedup": {0, 2, 3, 4, 7, 8, 9, None}, "benchmark_decontamination": {0, 1, 2, 6, 7, 8, 9, None}, "source_mixing": {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None}}
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, clashing(spark), str(tmp_path)), stage(spark, clashing(spark, []), str(tmp_path))
        assert none.count() == 0
        if name == "token_output":
            assert got.count() == len(ROWS)
            continue
        assert got.columns == clashing(spark).columns and none.columns == got.columns
        ids = {r["doc_id"] for r in got.collect()}
        if ids:
            own_values_stay(got)
        assert ids <= want[name] and (ids == want[name] or name in ("quality_rules", "source_mixing", "simhash_near_dedup")), (name, ids)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from scarp.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(session)
