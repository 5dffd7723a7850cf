import math
import re

from pyspark.sql import functions as F

from scarp.llm import mixing, queries

TABLE = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """Sources in order with their sizes; the excess is reshared until none is above."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    left, open_, target = 1.5 * sum(sizes.values()), dict(sizes), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_targets_sizes_and_totals(spark):
    got = queries.op4_mixing(spark, TABLE).toPandas()
    docs = spark.read.parquet(f"{TABLE}/documents.parquet").toPandas()
    docs["want"] = docs.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    m = got.merge(docs, on="doc_id")
    assert (m["size"] == m.want).all() and (m.taken <= 2 * m["size"]).all()
    sizes = m.groupby("source")["size"].sum().sort_index().to_dict()
    want = brute_targets(sizes)
    for s, own in m.groupby("source"):
        assert math.isclose(own.target.iloc[0], want[s], rel_tol=1e-9) and own.source_size.iloc[0] == sizes[s]
        assert abs((own.rate * own["size"]).sum() - want[s]) < 1e-5 * want[s]  # the dual is solved
        assert abs(own.taken.sum() - want[s]) < 0.03 * want[s]
    again = queries.op4_mixing(spark, TABLE).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert again.equals(got.sort_values("doc_id").reset_index(drop=True))


def test_rates_are_exponential_tilts(spark):
    got = queries.op4_mixing(spark, TABLE).join(spark.read.parquet(f"{TABLE}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    for _, own in got[(got.rate < 2) & (got["size"] > 0)].groupby("source"):
        slope = [math.log(r) / n for r, n in zip(own.rate, own["size"])]
        assert max(slope) - min(slope) < 1e-9 + 1e-6 * abs(slope[0])


def test_one_hot_source_and_null(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot") for i in range(3000)] + [(5000 + i, "w w w", None) for i in range(900)] + [(9000, "w", "tiny")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(d).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("took")).collect()
    assert all(abs(r["took"] - r["t"]) <= max(50, 0.02 * r["t"]) for r in m) and len(m) == 3


def test_copies(spark):
    d = spark.createDataFrame([(1, "a", 2), (2, "b", 0), (3, "c", 1)], "doc_id long, text string, copies long")
    assert sorted(r["doc_id"] for r in mixing.copies_of(d, ["doc_id"]).collect()) == [1, 1, 3]
