import hashlib

from scarp.llm import lines, queries


def brute(docs, min_sites):
    sites = {}
    for _, text, source in docs:
        for x in (text or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(x, set()).update([source] if source is not None else [])
    out = {}
    for i, text, _ in docs:
        all_ = (text or "").split("\n")
        gone = [x for x in all_ if x.strip(" \t\n\x0b\x0c\r") and len(sites[x]) >= min_sites]
        out[i] = (len(gone), "\n".join(x for x in all_ if x not in gone))
    return out


def test_equal_to_brute_force_at_every_threshold(spark):
    docs = [(i, "\n".join([f"only {i}", "everywhere", f"some {i % 7}", " ", f"pair {i // 2}"]), None if i % 11 == 0 else f"s{i % 30}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for least in (2, 5, 30):
        got = {r["doc_id"]: (r["n_removed"], r["cleaned"]) for r in lines.remove_boilerplate(df, min_sites=least).collect()}
        assert got == brute(docs, least)


def test_query_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    want = brute(docs, lines.MIN_SITES)
    for r in queries.op6_site_lines(spark, "/root/testdata/sf0.001").collect():
        assert (r["n_removed"], r["cleaned_sha256"]) == (want[r["doc_id"]][0], hashlib.sha256(want[r["doc_id"]][1].encode()).hexdigest())
