import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scarp.llm import merkle, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
        i //= 16
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"]), r["text"], r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, (known, doc_id, own, text, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            path = way(trees[k], i) + way(top, j)
            if text is not None and known and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = brute_leaf(r, text)
            for left, right in path:
                folded = digest(left + folded + right)
            root = top[-1][0]
            out.append((doc_id if known else None, own, trees[k][-1][0], root, digest("".join(x for p in path for x in p)), folded, folded == root))
    return out


def rows_of(found):
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_query_equals_brute_force(spark):
    where = "/root/testdata/sf0.001"
    got = queries.op13_merkle_manifest(spark, where).collect()
    assert rows_of(got) == rows_of(brute(spark.read.parquet(f"{where}/documents.parquet").collect()))
    assert 0 < sum(r["verified"] for r in got) < len(got)


@pytest.mark.parametrize("sizes,parts", [((1,), 3), ((16, 17, 1, 0, 255, 256, 257, 2), 5), ((4096, 40, 4113), 13), ((66_000, 3), 9)])
def test_group_sizes_and_partitions(spark, sizes, parts, tmp_path):
    names = [None, "", "é", "z", "B", "a|b", "0", "ab"]
    rows = [(i * 7 + g, names[g], "en", None if i % 5 else i, f"Text {i % 11}") for g, n in enumerate(sizes) for i in range(n)]
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.op13_merkle_manifest(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    assert rows_of(got) == rows_of(brute([dict(zip(names, r, strict=True)) for r in rows]))


def test_hard_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a", "-", 0, ""), (None, None, "x", 5, "é" * 100_000), (2, "a", "1:", -3, "\0<\n"), (2, "a", None, 1, "other text, same id"), (3, "a", "en", 2, "ALL")]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"place": F.lit(1), "leaf": F.lit("x"), "_group": F.lit(2), "a.b": F.lit(3)})
    got = merkle.verify(merkle.manifest(d, also={"x.y": F.col("`a.b`")})).collect()
    names = ("doc_id", "source", "lang", "n_chars", "text")
    want = brute([dict(zip(names, r, strict=True)) for r in rows])
    assert sorted(r["leaf"] for r in got) == sorted(w[1] for w in want) and {r["root"] for r in got} == {want[0][3]}
    assert all(r["verified"] and r["x.y"] == 3 for r in got)
    assert sorted((r["source"] or "", r["place"]) for r in got) == [("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    assert merkle.verify(merkle.manifest(d.limit(0))).count() == 0


def test_any_change_of_a_path_or_leaf_is_found(spark):
    d = spark.createDataFrame([(i, f"s{i % 3}", "en", i, f"t{i}") for i in range(60)], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.manifest(d).filter("doc_id = 31").first()
    assert merkle.fold(r["leaf"], r["path"]) == r["root"] != merkle.fold(r["leaf"][::-1], r["path"])
    path = bytearray(r["path"])
    path[5] ^= 1
    assert merkle.fold(r["leaf"], bytes(path)) != r["root"]
