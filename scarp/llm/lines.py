"""Removing boilerplate lines by the number of sites that show them.

HyperLogLog sketches of the sites, one for each line hash, merge by aggregation. Where an estimate
lies within BAND of the threshold, the line's sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, materialize

MIN_SITES = 10
#: log2 of a sketch's registers; its standard error is 1.04 / sqrt(2 ** LG_K), 1.6 %.
LG_K = 12
BAND = 0.25


def _lines(documents: DataFrame, *columns: Column) -> DataFrame:
    """columns, place, line for each line with a word; the key of a line is 128 bits of hashes."""
    split = documents.select(*columns, F.posexplode(F.split("text", "\n")).alias("place", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return split.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def boilerplate(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines shown by at least min_sites different sites (null sites do not count)."""
    lines = _lines(documents, F.col(site).cast("string").alias("site")).select("site", "h1", "h2")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    sites = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - BAND))
    sites = materialize(sites, "sites")
    sure = sites.filter(F.col("sites") > min_sites * (1 + BAND)).select("h1", "h2")
    near = sites.filter(F.col("sites") <= min_sites * (1 + BAND)).select("h1", "h2")
    pairs = lines.filter("site IS NOT NULL").join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").count()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("h1", "h2")
    return materialize(sure.unionByName(exact), "boilerplate")


def remove_boilerplate(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """documents with cleaned, n_lines, n_removed and removed_chars (input columns of these names are replaced).

    Lines end at \\n and count if they hold a word (anything but ASCII white space). Every such line that at
    least min_sites sites show is removed; the others stay, joined by \\n. Null texts stay
    null and have no lines; equal rows get equal results; an empty table gives no rows.
    """
    new = ("cleaned", "n_lines", "n_removed", "removed_chars")
    rest = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c not in new])
    own, held, names = carried(rest, F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_text_hash"))
    found = _lines(own, F.col("_id").alias("_doc"), F.col("_text_hash").alias("_hash")).join(boilerplate(documents, site, min_sites), ["h1", "h2"], "left_semi")
    places = found.groupBy("_doc", "_hash").agg(F.collect_set("place").alias("_places"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))
    joined = own.join(places, same, "left")
    lines = F.split("text", "\n")
    gone = F.coalesce("_places", F.array().cast("array<int>"))
    kept = F.filter(lines, lambda line, i: ~F.array_contains(gone, i))
    removed = F.filter(lines, lambda line, i: F.array_contains(gone, i))
    counted = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("_places").isNull(), F.lit(0)).otherwise(F.aggregate(removed, F.lit(0), lambda n, line: n + F.length(line)))
    values = {
        "cleaned": F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.coalesce(F.size(counted), F.lit(0))).cast("long"),
        "n_removed": F.size(gone).cast("long"), "removed_chars": size.cast("long"),
    }
    return joined.select(*held, *[values[c].alias(f"_new{i}") for i, c in enumerate(new)]).toDF(*names, *new)
