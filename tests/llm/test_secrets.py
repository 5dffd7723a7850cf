import re

from scarp.llm import queries, secrets


def forest(spark):
    words = spark.createDataFrame([("release",), ("notes",), ("share",), ("data",)], "word string")
    return secrets.train(secrets.example_findings(spark, 2000), words), words


def test_held_out_findings(spark):
    trees, words = forest(spark)
    from pyspark.sql import functions as F

    fresh = secrets.example_findings(spark, 4000).filter(F.length("candidate") > 0).limit(4000).subtract(secrets.example_findings(spark, 2000))
    judged = secrets.features(fresh, words)
    mean = sum((F.expr(t) for t in trees), F.lit(0.0)) / len(trees)
    got = judged.select("label", (mean >= 0.5).cast("int").alias("said")).toPandas()
    assert (got.label == got.said).mean() > 0.97


def test_candidates_and_context(spark):
    text = "say token = \"" + "0a1b" * 10 + "\" end\nnext 1234567890123456 and abcdefghijklmnopqrstuvwx\n" + "k" * 60 + " 9" + "z" * 20
    got = secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("place").collect()
    run = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
    want = [m for m in run.finditer(text) if re.search("[0-9]", m.group())]
    assert [r["candidate"] for r in got] == [m.group() for m in want]
    for r, m in zip(got, want):
        line = text[: m.start()].rsplit("\n", 1)[-1]
        assert r["before"] == line[-40:] and r["after"] == text[m.end() : m.end() + 16].split("\n")[0]


def test_query_finds_assigned_keys_and_leaves_numbers(spark):
    got = queries.op3_secrets(spark, "/root/testdata/sf0.01").toPandas()
    keys = got.before.str.contains('token = "$')
    assert keys.sum() > 5 and got[keys].is_secret.all() and not got[got.candidate.str.fullmatch("[0-9]+")].is_secret.any()


def test_scoring_is_native(spark):
    trees, words = forest(spark)
    docs = spark.createDataFrame([(1, "token = \"" + "0a1b" * 10 + "\"")], "doc_id long, text string")
    plan = secrets.scan(docs, trees, words)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_assigned_secrets_of_any_length_and_sign(spark):
    trees, words = forest(spark)
    wanted = ["Tr0ub4dor&3!", "hunter2", "abcdefghijklmnopqrstuvwx"]
    texts = ['x password = "Tr0ub4dor&3!" y', "db_password: hunter2, next", "API_KEY='abcdefghijklmnopqrstuvwx'", "the password: required by all", "a token of 12 and the time: 10:30"]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trees, words).collect()}
    assert [got[i]["candidate"] for i in range(3)] == wanted and set(got) == {0, 1, 2, 3}
    assert got[0]["is_secret"] and not got[3]["is_secret"]
