"""Writing run tables and small JSON results."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(value):
    """For JSON: numpy scalars as Python numbers; NaN and infinities as null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(path: str | Path, value) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(plain(value), indent=2))


def run_id(settings: dict) -> str:
    """Eight hex digits that identify a run's settings."""
    return hashlib.sha256(json.dumps(plain(settings), sort_keys=True).encode()).hexdigest()[:8]


def write_table(df: DataFrame, folder: str, name: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).options(**({"header": True} if form == "csv" else {})).save(f"{folder}/{name}")


def coordinates(pairs: DataFrame, value: str) -> DataFrame:
    """The symmetric matrix of a pair column as i, j, value; absent entries are missing, the diagonal is 0."""
    return pairs.filter(f"{value} IS NOT NULL").selectExpr("id1 AS i", "id2 AS j", f"{value} AS value")


def write_matrices(pairs: DataFrame, folder: str | Path, values: dict[str, str], band: int = 256) -> list[str]:
    """Each named pair column as a dense symmetric .npy matrix, and the order of its ids as JSON; returns the ids.

    Of any size: the files are laid out at their full size first, each task fills bands of rows at their places, one row
    in memory at a time, and a file gets its name when all rows are there. A task that runs again writes the same bytes.
    The folder must be one that driver and executors mount. Pairs without a value are NaN, the diagonal is 0.
    """
    ids = [r["id"] for r in pairs.selectExpr("explode(array(id1, id2)) AS id").distinct().orderBy("id").collect()]  # the keys file's own content
    target, n = Path(str(folder).removeprefix("file://")), len(ids)
    target.mkdir(parents=True, exist_ok=True)
    names, columns = list(values), [f"v{k}" for k in range(len(values))]
    for name in names:
        np.lib.format.open_memmap(target / f"{name}.npy.part", "w+", np.float64, (n, n)).flush()
    index = pairs.sparkSession.createDataFrame(list(enumerate(ids)), "at long, id string")
    one, two = (index.select(F.col("id").alias(f"id{k}"), F.col("at").alias(x)) for k, x in ((1, "i"), (2, "j")))
    found = pairs.select("id1", "id2", *[F.col(c).cast("double").alias(x) for c, x in zip(values.values(), columns, strict=True)]).join(one, "id1").join(two, "id2").select("i", "j", *columns)
    both = found.unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j"), *columns))
    diagonal = index.select(F.col("at").alias("i"), F.col("at").alias("j"), *[F.lit(0.0).alias(x) for x in columns])
    rows = both.unionByName(diagonal).withColumn("band", F.floor(F.col("i") / band))

    def fill(batches):
        files = [np.load(target / f"{name}.npy.part", mmap_mode="r+") for name in names]
        held = np.full((len(names), n), np.nan)
        now = -1

        def put():
            for file, row in zip(files, held, strict=True):
                file[now] = row
            held[:] = np.nan

        count = 0
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            data = [batch.column(x).to_numpy(zero_copy_only=False) for x in columns]
            cuts = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if i[a] != now:
                    if now >= 0:
                        put()
                    now, count = int(i[a]), count + 1
                for row, x in zip(held, data, strict=True):
                    row[j[a:b]] = x[a:b]
        if now >= 0:
            put()
        for file in files:
            file.flush()
        yield pa.RecordBatch.from_arrays([pa.array([count])], ["n"])

    done = rows.repartition("band").sortWithinPartitions("i", "j").drop("band").mapInArrow(fill, "n long").agg(F.sum("n")).first()[0] or 0
    if done != n:
        raise RuntimeError(f"{done} of {n} rows of the matrices were written")
    for name in names:
        (target / f"{name}.npy.part").replace(target / f"{name}.npy")
    write_json(target / "matrix_keys.json", ids)
    return ids
