"""A Merkle manifest of a table: digests of rows, of groups and of the whole, with a proof for each row.

Rows are range-sorted by group and order and numbered within their stretch of a partition. The counts of
the stretches, a few numbers for each partition, give every partition the place at which its
first group goes on. Then each task builds the complete aligned subtrees of its rows alone; only
their tops, most of them ragged ends of partitions, are shuffled by coordinate (group, level,
place) and finished level by level. The proofs go the same way down: those of the tops are joined to their
subtrees, and a task extends them to the leaves.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: Levels above the leaves that a task builds by itself, and those of a pack, which is one row while proofs go down.
LOCAL, PACK = 4, 2
_LEAVES = FAN**LOCAL


def leaf(columns: list[str | Column]) -> Column:
    """The digest of a row: `-` for a null, else the UTF-8 byte count, `:` and the value, of one column after the other."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in parts]), 256)


def _digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _number(batches):
    """Adds part (the range partition), run (the number of the group in it), pos (the row's place in that run) and last (of the run)."""
    from pyspark import TaskContext

    part, run, pos, name, held = TaskContext.get().partitionId(), -1, 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
        for i, other in enumerate(batch.column("_group").to_pylist()):
            if run < 0 or other != name:
                run, pos, name = run + 1, 0, other
            runs[i], places[i] = run, pos
            pos += 1
        if held:
            yield _marked(*held, runs[0])
        held = (batch, part, runs, places)
    if held:
        yield _marked(*held, -1)


def _marked(batch, part, runs, places, following):
    last = np.append(runs[1:], following) != runs
    more = [pa.array(np.full(len(runs), part, np.int32)), pa.array(runs), pa.array(places), pa.array(last)]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_part", "_run", "_pos", "_last"])


def _offsets(ordered: DataFrame) -> tuple[dict[int, tuple[int, int]], int]:
    """For each partition how many rows of its first group stand before it and the run that goes on after it (or -1); the largest group's size."""
    ends = ordered.filter("_last").select("_part", "_run", F.struct("_run", F.sha2("_group", 256).alias("name"), (F.col("_pos") + 1).alias("n")).alias("end"))
    rows = ends.groupBy("_part").agg(F.min("end").alias("first"), F.max("end").alias("last"), F.max("end.n").alias("most")).orderBy("_part").collect()  # a row per partition
    found, before, longest = {}, 0, 0
    open_part = open_run = name = None
    for row in rows:
        first, last = row["first"], row["last"]
        goes_on = open_part is not None and first["name"] == name
        offset = before if goes_on else 0
        if goes_on:
            found[open_part] = (found[open_part][0], open_run)
        found[row["_part"]] = (offset, -1)
        before = (offset if last["_run"] == 0 else 0) + last["n"]
        longest = max(longest, row["most"], offset + first["n"], before)
        name, open_part, open_run = last["name"], row["_part"], last["_run"]
    return found, longest


def _parents(lo: int, nodes: list[str], ended: bool) -> tuple[int, int]:
    """The parents, from the first to before the last, all whose children are among nodes (places lo and after); ended: no node comes after them."""
    hi = lo + len(nodes)
    return -(-lo // FAN), (-(-hi // FAN) if ended else hi // FAN)


def _step(run_first: int, nodes: list[str], lo: int, at: int) -> bytes:
    """A step of a path: a node's place among its run, the number of siblings, their digests."""
    siblings = [d for i, d in enumerate(nodes[run_first - lo : run_first - lo + FAN], run_first) if i != at]
    return bytes([at - run_first, len(siblings)]) + bytes.fromhex("".join(siblings))


def _subtrees(lo: int, leaves: list[str], ended: bool):
    """(levels, tops) of consecutive leaves: levels[k] is (place of the first, digests) of the nodes that can be
    built from them alone, tops are (level, place) of those without a parent among them."""
    levels, tops = [(lo, leaves)], []
    for level in range(LOCAL):
        lo, nodes = levels[-1]
        if ended and lo == 0 and len(nodes) == 1:
            break
        first, last = _parents(lo, nodes, ended)
        if first >= last:
            break
        tops += [(level, i) for i in range(lo, lo + len(nodes)) if not first <= i // FAN < last]
        levels.append((first, [_digest(nodes[max(0, p * FAN - lo) : (p + 1) * FAN - lo]) for p in range(first, last)]))
    lo, nodes = levels[-1]
    return levels, tops + [(len(levels) - 1, i) for i in range(lo, lo + len(nodes))]


def _build(offsets: dict[int, tuple[int, int]], row_type: pa.StructType):
    """Rows in order to packs: up to FAN ** PACK leaves below one node, with the way up to the top of its local subtree."""

    def packs(pieces: list[pa.RecordBatch], lo: int, ended: bool):
        table = pa.Table.from_batches(pieces).combine_chunks()
        rows = pa.StructArray.from_arrays([pa.concat_arrays(table.column(f.name).chunks) if table.num_rows else pa.array([], f.type) for f in row_type], fields=list(row_type))
        name = table.column("_group")[0].as_py()
        levels, tops = _subtrees(lo, [x.hex() for x in table.column("_leaf").to_pylist()], ended)
        out, sizes, picked = [], [], []
        for level, place in tops:
            depth = min(level, PACK)
            width = FAN**depth
            for own in range(place * FAN ** (level - depth), (place + 1) * FAN ** (level - depth)):
                a, b = max(own * width, lo), min((own + 1) * width, lo + table.num_rows)
                if a >= b:
                    break
                path, at = b"", own
                for k in range(depth, level):
                    path += _step(at // FAN * FAN, levels[k][1], levels[k][0], at)
                    at //= FAN
                digest = bytes.fromhex(levels[level][1][place - levels[level][0]])
                out.append((name, level, place, digest, ended and b == lo + table.num_rows, own == place * FAN ** (level - depth), depth, a, path))
                sizes.append(b - a)
                picked.append(np.arange(a - lo, b - lo))
        # the last pack of a top tells that its group ends with it; the top's own row is its first pack
        closing = {(x[1], x[2]) for x in out if x[4]}
        columns = list(zip(*out, strict=True))
        columns[4] = tuple((x[1], x[2]) in closing for x in out)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), rows.take(pa.array(np.concatenate(picked))))
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], lists], _PACK_NAMES)

    def run(batches):
        held: list[pa.RecordBatch] = []
        begin = following = -1
        now = (-1, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            part, runs, pos, last = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_run", "_pos", "_last"))
            place = pos + np.array([offsets[p][0] if r == 0 else 0 for p, r in zip(part.tolist(), runs.tolist(), strict=True)], np.int64)
            new = (np.diff(part) != 0) | (np.diff(runs) != 0) | (np.diff(place) != 1) | (place[1:] % _LEAVES == 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = (int(part[a]), int(runs[a]))
                if held and (key != now or place[a] != following or place[a] % _LEAVES == 0):
                    yield packs(held, begin, False)
                    held = []
                if not held:
                    begin, now = int(place[a]), key
                held.append(batch.slice(a, b - a))
                following = int(place[b - 1]) + 1
                if last[b - 1] and offsets[key[0]][1] != key[1]:
                    yield packs(held, begin, True)
                    held = []
        if held:
            yield packs(held, begin, False)

    return run


_PACK_NAMES = ["_group", "level", "place", "digest", "tail", "lead", "depth", "first", "path", "rows"]
_NODE = ("_group", "level", "place", "digest", "tail")


def _grow(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(packs, roots, parents) of rows with _group, _key (their order), _leaf, and whatever is carried.

    roots: the top node of each group. parents[k]: the nodes of level k + 1 that the packs' tops lead
    to, with their children (run).
    """
    carried = [c for c in rows.columns if c != "_group"]
    rows = materialize(rows.withColumn("_spread", F.monotonically_increasing_id()), "leaves")
    # equal rows may fill many partitions: their order is that in which they were read
    order = ["_group", "_key", "_leaf", "_spread"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_spread")
    numbers = [T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("_pos", T.LongType()), T.StructField("_last", T.BooleanType())]
    ordered = materialize(map_batches(ordered, _number, T.StructType([*ordered.schema.fields, *numbers])), "ordered")
    offsets, longest = _offsets(ordered)
    row_type = T.StructType([ordered.schema[c] for c in carried])
    head = T._parse_datatype_string("_group string, level int, place long, digest binary, tail boolean, lead boolean, depth int, first long, path binary")
    from pyspark.sql.pandas.types import to_arrow_type

    packs = materialize(map_batches(ordered, _build(offsets, to_arrow_type(row_type)), T.StructType([*head.fields, T.StructField("rows", T.ArrayType(row_type))])), "packs")
    whole = (F.col("place") == 0) & F.col("tail")
    nodes = packs.filter("lead").select(*_NODE)
    roots, parents, up, level = nodes.filter(whole), [], None, 0
    while FAN**level < longest:
        here = nodes.filter(F.col("level") == level)
        here = (here if up is None else here.unionByName(up.select(*_NODE))).filter(~whole)
        runs = here.groupBy("_group", (F.floor(F.col("place") / FAN)).alias("place")).agg(F.array_sort(F.collect_list(F.struct((F.col("place") % FAN).cast("int").alias("at"), "digest"))).alias("run"), F.max("tail").alias("tail"))
        joined = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["digest"]))), "")
        level += 1
        up = materialize(runs.select("_group", F.lit(level).alias("level"), "place", F.unhex(F.sha2(joined, 256)).alias("digest"), "tail", "run"), "nodes")
        roots = roots.unionByName(up.filter(whole).select(*_NODE))
        parents.append(up)
    return packs, materialize(roots, "roots"), parents


def _path_step(run: Column, at: Column) -> Column:
    """As _step, of a run of children given as structs."""
    siblings = F.filter(run, lambda x: x["at"] != at)
    head = F.concat(F.lpad(F.hex(at), 2, "0"), F.lpad(F.hex(F.size(siblings)), 2, "0"))
    return F.unhex(F.concat(head, F.array_join(F.transform(siblings, lambda x: F.hex(x["digest"])), "")))


def _hand_down(packs: DataFrame, tops: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """The rows of packs, each with place, its path to the last root, and the subroot and root of its group's row in tops."""
    nodes = ["_group", "level", "place", "above", "subroot", "root"]
    tops = tops.select(*nodes)
    given, below = [], None
    for level in range(len(parents), -1, -1):
        here = tops.filter(F.col("level") == level)
        here = here if below is None else here.unionByName(below)
        given.append(here)
        if level:
            found = here.alias("h").join(parents[level - 1].select("_group", "place", "run").alias("p"), F.col("h._group").eqNullSafe(F.col("p._group")) & (F.col("h.place") == F.col("p.place")))
            children = found.select("h.*", "run", F.explode("run").alias("child"))
            child = F.concat(_path_step(F.col("run"), F.col("child.at")), F.col("above"))
            below = materialize(children.select("_group", F.lit(level - 1).alias("level"), (F.col("place") * FAN + F.col("child.at")).alias("place"), child.alias("above"), "subroot", "root"), "paths")
    every = given[0]
    for more in given[1:]:
        every = every.unionByName(more)
    same = F.col("k._group").eqNullSafe(F.col("g._group")) & (F.col("k.level") == F.col("g.level")) & (F.col("k.place") == F.col("g.place"))
    joined = packs.alias("k").join(every.alias("g"), same).select("k._group", "depth", "first", "path", "rows", "above", "subroot", "root")
    kept = packs.schema["rows"].dataType.elementType.fields
    more = T._parse_datatype_string("place long, path binary, subroot string, root string")
    return map_batches(joined, _spread([f.name for f in kept]), T.StructType([packs.schema["_group"], *kept, *more.fields]))


def _spread(kept: list[str]):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                group, depth, first, path, above, subroot, root = (batch.column(c)[i].as_py() for c in ("_group", "depth", "first", "path", "above", "subroot", "root"))
                rows = batch.column("rows").slice(i, 1).flatten()
                n, above = len(rows), path + above
                paths = [b""] * n
                lo, nodes, width = first, [x.hex() for x in rows.field("_leaf").to_pylist()], 1
                for _ in range(depth):
                    begin = lo // FAN * FAN
                    steps = [_step(at // FAN * FAN, nodes, lo, at) for at in range(lo, lo + len(nodes))]
                    for j in range(n):
                        paths[j] += steps[(first + j) // width - lo]
                    nodes = [_digest(nodes[p - lo : p - lo + FAN]) for p in range(begin, lo + len(nodes), FAN)]
                    lo, width = lo // FAN, width * FAN
                whole = [p + above for p in paths]
                fixed = [pa.array([x] * n, pa.string()) for x in (group, subroot, root)]
                yield pa.RecordBatch.from_arrays(
                    [fixed[0], *[rows.field(k) for k in kept], pa.array(np.arange(first, first + n)), pa.array(whole, pa.binary()), fixed[1], fixed[2]],
                    ["_group", *kept, "place", "path", "subroot", "root"],
                )

    return run


def manifest(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """order, group, place, leaf, subroot, root, path (and `also`) for each row: what a manifest stores and what proves a row.

    A leaf is the digest of the row's `columns`. In each group the leaves ascend by `order` (nulls
    first, ties by leaf), and every FAN consecutive nodes become the digest of their digests until one
    is left, the subroot; the subroots by ascending group (null first, bytewise) become the root in
    the same way. path has a step for each level up to the root: the node's place in its run, the number of
    its siblings (a byte each), their digests from left to right (32 bytes each). Null and empty
    texts differ; equal rows have the same leaf and a place each; an empty table gives no
    rows. `also` names further columns of a row that are carried along.
    """
    also = also or {}
    quoted = [F.col(f"`{c}`") for c in columns]
    own = {f"_also{i}": c for i, c in enumerate(also.values())}
    rows = documents.select(F.col(f"`{group}`").cast("string").alias("_group"), F.col(f"`{order}`").alias("_key"), F.unhex(leaf(quoted)).alias("_leaf"), *[c.alias(n) for n, c in own.items()])
    packs, roots, parents = _grow(rows)
    groups = roots.select(F.lit(None).cast("string").alias("_group"), F.col("_group").alias("_key"), F.col("digest").alias("_leaf"), "level")
    upper, top, above = _grow(groups)
    no_path = F.unhex(F.lit(""))
    hexed = F.lower(F.hex("digest"))
    tops = _hand_down(upper, top.select("_group", "level", "place", no_path.alias("above"), hexed.alias("subroot"), hexed.alias("root")), above)
    tops = tops.select(F.col("_key").alias("_group"), "level", F.lit(0).cast("long").alias("place"), F.col("path").alias("above"), F.lower(F.hex("_leaf")).alias("subroot"), "root")
    found = _hand_down(packs, materialize(tops, "subroots"), parents)
    return found.select(F.col("_key").alias(order), F.col("_group").alias(group), "place", F.lower(F.hex("_leaf")).alias("leaf"), "subroot", "root", "path", *[F.col(n).alias(k) for n, k in zip(own, also, strict=True)])


def steps(path: bytes):
    """(place, siblings' digests in one hex text) of each step of a path."""
    at = 0
    while at < len(path):
        end = at + 2 + 32 * path[at + 1]
        yield path[at], path[at + 2 : end].hex()
        at = end


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its path lead to."""
    for place, siblings in steps(path):
        leaf = _digest((siblings[: 64 * place], leaf, siblings[64 * place :]))
    return leaf


def _verify(leaf_at: int, path_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            leaves, paths = batch.column(leaf_at).to_pylist(), batch.column(path_at).to_pylist()
            folded = [None if x is None else fold(x, p) for x, p in zip(leaves, paths, strict=True)]
            proofs = [_digest(s for _, s in steps(p)) for p in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string()), pa.array(proofs, pa.string())], names)

    return run


def verify(found: DataFrame, column: str = "leaf") -> DataFrame:
    """A manifest with folded_root (from the digest in `column` and the row's path), proof_sha256 and verified.

    Whoever keeps the root alone can check a row so: recompute its leaf and fold it. A null digest
    folds to null and is not verified; an empty table gives no rows.
    """
    names, new = found.columns, ("folded_root", "proof_sha256")
    held = found.toDF(*[f"_column{i}" for i in range(len(names))])
    schema = T.StructType([*held.schema.fields, *[T.StructField(n, T.StringType()) for n in new]])
    done = map_batches(held, _verify(names.index(column), names.index("path"), schema.names), schema).toDF(*names, *new)
    return done.withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))
