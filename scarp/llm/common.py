"""What several corpus operators share: the shared folder, written tables and batches of words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes apart at once; a longer text is taken alone.
CHUNK_BYTES = 4 << 20
#: Rows of an Arrow batch, fewer than Spark's own 10,000, as a row may be a long text.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a temporary folder is made and set if all runs in one local process (as
    in tests); on a cluster it must be given.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scarp-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_remove, spark, path)
    return path


_OWN: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a session's folder, if the session still runs when Python ends."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors: a later stage rereads
    files instead of recomputing, and the planner knows their size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(documents: DataFrame, *more: str | Column) -> tuple[DataFrame, list[str], list[str]]:
    """(documents under private column names and what `more` adds, the private names, the own names): no own name can clash then."""
    names = documents.columns
    held = [f"_column{i}" for i in range(len(names))]
    return documents.select(*[F.col(f"`{n}`").alias(h) for n, h in zip(names, held, strict=True)], *more), held, names


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with small batches (the session's setting is lowered for it); a worker gives unused memory back when a task ends.

    Workers serve many tasks of all kinds, and what one has freed would else add to what the
    next one needs.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(tidy, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """(first, last + 1) of runs of texts with about `limit` bytes each."""
    first = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield first, i
            first, size = i, 0
        size += len(x)
    if first < len(texts):
        yield first, len(texts)


def sorted_groups(batches, columns: list[str], key: str | tuple[str, ...], least: int = 200_000):
    """Columns of rows that come sorted by `key`, whole groups of equal keys at a time, `least` rows or more."""
    keys = [columns.index(k) for k in ((key,) if isinstance(key, str) else key)]
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in columns])
        size += batch.num_rows
        if size < least:
            continue
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        last = int(np.argmax(np.logical_and.reduce([whole[k] == whole[k][-1] for k in keys])))
        if last:
            yield [c[:last] for c in whole]
        held, size = [[c[last:] for c in whole]], size - last
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


class Words:
    """The words of some texts as numbers: text t has ids[bounds[t]:bounds[t + 1]]."""

    def __init__(self, lists: list[list[bytes]]):
        flat = list(chain.from_iterable(lists))
        self.unique = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        self.ids = np.fromiter(map(self.unique.__getitem__, flat), np.int64, len(flat))
        self.lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.bounds = np.concatenate(([0], np.cumsum(self.lengths)))

    def owner(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def windows(words: Words, k: int) -> np.ndarray:
    """Positions in `ids` at which k words of one text begin."""
    room = np.repeat(words.bounds[1:], words.lengths) - np.arange(len(words.ids))
    return np.flatnonzero(room >= k)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of k consecutive values, mixed; one for each start."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += values[i : i + n]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))
