"""Token ids in flat binary files.

A range partition of the documents becomes three files: `part-N.ids` (unsigned 16-bit where the
vocabulary allows it, else 32-bit), `part-N.offsets` (64-bit, one more than documents, counted
from the partition's first id) and `part-N.docs` (64-bit document ids). `index.json` names the
partitions with their bases, which are prefix sums of their lengths.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, map_batches

#: Pieces whose ids a worker remembers; beyond that it forgets those that were not met since the last time.
CACHE_ENTRIES = 800_000
_STOPS = ".,;:!?"
#: Words of Latin and Cyrillic letters, which every version of the Unicode tables takes for letters.
_LETTERS = "^\0?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f]+$"
#: Byte-level tokenizers write a byte that is a printable character as itself and the others, in order, from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: 0x100 + i for i, b in enumerate(sorted(set(range(1, 256)) - set(_PRINTED), key=int), 1)}


def piecewise(path: str) -> bool:
    """Whether a tokenizer file's texts may be cut at spaces: byte-level pre-tokens of the texts as they are."""
    with open(path) as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"] or {}
    plain = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    return plain and not spec["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]


class Encoder:
    """Whole texts to ids with the tokenizers library, piece by piece.

    A byte-level pre-tokenizer always begins a token at a space between two characters that are
    not white space, and a line feed between two such characters is a token of its own. So a
    text's ids are those of the pieces cut there. Pieces recur: Arrow cuts a batch of texts and finds its
    different pieces, only the unknown ones are encoded, and a worker remembers those of
    late. Texts in which white space meets white space, or that begin or end with it, those that hold the string of a special
    token, and all texts of other kinds of tokenizers go to the library as they are. A special token's string in a
    text is that token, as the library has it; with plain_specials it is ordinary text.
    """

    def __init__(self, path: str, dtype: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = "|".join(map(re.escape, specials))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype, self.piecewise = np.dtype(dtype), piecewise(path)
        # byte-level tokenizers write a space as U+0120 and a line feed as U+010A
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins = {mark: np.array([t.startswith(mark) for t in names]) for mark in "\u0120\u010a"}
        self.tails: dict[str, bytes] = {}
        self._forget(np.empty(0, np.int64))

    def _forget(self, keep: np.ndarray) -> None:
        """Remember only the pieces with these numbers; the first is the line feed."""
        if not len(keep):
            self.names = pa.array(["\n"], pa.large_string())
            self.ids = self._library(["\n"])[0]
            self.sizes = np.array([len(self.ids)])
        else:
            first = (np.cumsum(self.sizes) - self.sizes)[keep]
            self.names, self.sizes = self.names.take(pa.array(keep)), self.sizes[keep]
            self.ids = self.ids[_spread(first, self.sizes)]
        self.used = np.zeros(len(self.sizes), bool)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces without white space, encoded in one text; those marked by a "\\0" have no space before them."""
        found: dict[str, bytes] = {}
        for mark, between, some in (("\u0120", " ", [p for p in pieces if p[0] != "\0"]), ("\u010a", "\n", [p for p in pieces if p[0] == "\0"])):
            if not some:
                continue
            plain = between.join(some) if between == " " else between.join([p[1:] for p in some])
            ids = self._library([between + plain])[0]
            first = np.flatnonzero(self.begins[mark][ids])
            if len(first) != len(some) or first[0]:
                raise ValueError("the tokenizer does not cut texts at single spaces and line feeds")
            found.update(zip(some, _slices(ids, first if between == " " else first + 1, np.append(first[1:], len(ids))), strict=True))
        return found

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, which are one pre-token with or without the space before, from the library's model alone."""
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(_VISIBLE) for w in words]
        plain = ["\u0120" + w if w[0] != "\0" else w[1:] for w in shown]
        found = [[t.id for t in tokens] for tokens in map(self.model.tokenize, plain)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes)
        return _slices(np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), ends - sizes, ends)

    def _learn(self, pieces: pa.Array) -> None:
        """Remember new pieces. Letters and the stops after them are different pre-tokens, so each is encoded once."""
        cores = pc.utf8_rtrim(pieces, _STOPS)
        simple = pc.match_substring_regex(cores, _LETTERS)
        lettered, own = pieces.filter(simple), cores.filter(simple).dictionary_encode()
        of_core = self._letters(_listed(own.dictionary))
        names, at = _listed(lettered), own.indices.to_numpy().tolist()
        sizes = pc.subtract(pc.binary_length(lettered), pc.binary_length(cores.filter(simple))).to_numpy().tolist()
        tails = [name[len(name) - n :] if n else "" for name, n in zip(names, sizes, strict=True)]
        new = [t for t in dict.fromkeys(tails) if t and t not in self.tails]
        self.tails.update(zip(new, [x.tobytes() for x in self._library(new)], strict=True))
        self.tails[""] = b""
        values = [of_core[i] + self.tails[t] for i, t in zip(at, tails, strict=True)]
        bare = [(p, p.strip("\0")) for p in _listed(pieces.filter(pc.invert(simple)))]
        rest = [p for p, b in bare if b and b.strip() == b]
        joined = self._joined(rest)
        names += joined
        values += joined.values()
        self.names = pa.concat_arrays([self.names, pa.array(names, pa.large_string())])
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(values), self.dtype)))
        self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize))
        self.used = np.concatenate((self.used, np.zeros(len(values), bool)))

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of remembered pieces; -1 for those that are not."""
        return pc.index_in(pieces, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def _pieces(self, pieces: pa.Array) -> np.ndarray:
        """Their numbers; -1 for white space other than a line feed by itself."""
        if len(self.sizes) > CACHE_ENTRIES:
            kept = np.flatnonzero(self.used)
            kept = kept[kept > 0]
            self._forget(np.concatenate(([0], kept)) if len(kept) <= CACHE_ENTRIES // 2 else np.empty(0, np.int64))
        at = self._find(pieces)
        self.used[at[at >= 0]] = True
        missing = at < 0
        if missing.any():
            new = pieces.filter(pa.array(missing))
            self._learn(new)
            at[missing] = self._find(new)
        return at

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; how many each has). Null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        end = np.array([end_id], self.dtype)
        if not self.piecewise:
            found = [np.append(x, end) for x in self._library(texts.to_pylist())]
            return np.concatenate([end[:0], *found]), np.fromiter(map(len, found), np.int64, len(found))
        if not len(texts):
            return end[:0], np.empty(0, np.int64)
        given, special = texts, np.zeros(len(texts), bool)
        if self.specials:
            special = pc.match_substring_regex(texts, self.specials).to_numpy(zero_copy_only=False)
            texts = pc.if_else(pa.array(special), pa.scalar("", texts.type), texts) if special.any() else texts
        # "\0" marks what no space precedes: the first piece of each line
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar("\0", texts.type)), "\n", " \n \0")
        cut = pc.split_pattern(lines, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        codes = self._pieces(coded.dictionary)[coded.indices.to_numpy()]
        odd = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False) | (np.minimum.reduceat(codes, bounds[:-1]) < 0) | special
        whole = np.flatnonzero(odd)
        others = [end, *(self._library([t])[0] if marked else self._odd(t) for t, marked in zip(given.take(pa.array(whole)).to_pylist(), special[whole].tolist(), strict=True))]
        stop = len(self.sizes)
        ids = np.concatenate((self.ids, *others))
        sizes = np.concatenate((self.sizes, [len(x) for x in others]))
        # an odd text is one piece of its own; the end comes after each text
        where = np.repeat(odd, np.diff(bounds))
        place = np.concatenate(([0], np.cumsum(~where)))[bounds]
        order = np.argsort(np.concatenate((2 * whole, 2 * np.arange(len(texts)) + 1)))
        place, new = np.concatenate((place[whole], place[1:])), np.concatenate((np.arange(stop + 1, len(sizes)), np.full(len(texts), stop)))
        codes = np.insert(codes[~where], place[order], new[order])
        n = sizes[codes]
        ends = np.cumsum(n)[codes == stop]
        return ids[_spread((np.cumsum(sizes) - sizes)[codes], n)], np.diff(np.concatenate(([0], ends)))

    def _odd(self, text: str) -> np.ndarray:
        """A text in which white space meets a space, or that begins or ends with one."""
        first, *rest = _BETWEEN.split(text)
        return np.concatenate(self._library([first, *(" " + p for p in rest)]))


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] numbers), first[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(first - before, sizes)


def _listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def _slices(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    data, width = ids.tobytes(), ids.itemsize
    return [data[i:j] for i, j in zip((starts * width).tolist(), (stops * width).tolist(), strict=True)]


_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, dtype: str, plain_specials: bool = False) -> Encoder:
    """This worker process's own, so that tasks share what it remembers."""
    key = (path, dtype, plain_specials)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _write(path: str, tokenizer: str, end_id: int, dtype: str, plain_specials: bool):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        where, base = _open(path)
        trial = f"{base}/trial-{part}-{task.taskAttemptId()}"
        encode = encoder(tokenizer, dtype, plain_specials)
        lengths, docs, nulls = [], [], 0
        with where.open_output_stream(f"{trial}.ids") as out:
            for batch in batches:
                texts, ids = batch.column("text"), batch.column("doc_id")
                size = max(1, batch.num_rows * CHUNK_BYTES // max(1, texts.nbytes))
                for i in range(0, batch.num_rows, size):
                    found, sizes = encode(texts.slice(i, size), end_id)
                    lengths.append(sizes)
                    out.write(found)
                nulls += ids.null_count
                docs.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.empty(0, np.int64), *lengths])))).astype("<u8")
        for kind, data in (("offsets", offsets.tobytes()), ("docs", b"".join(x.tobytes() for x in docs))):
            with where.open_output_stream(f"{trial}.{kind}") as out:
                out.write(data)
        for kind in ("ids", "offsets", "docs"):  # a file appears whole or not at all; a repeated task writes the same
            final = f"{base}/part-{part:06d}.{kind}"
            if where.type_name != "local" and where.get_file_info(final).type != fs.FileType.NotFound:
                where.delete_file(final)
            where.move(f"{trial}.{kind}", final)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(offsets) - 1], "nulls": [nulls], "ids": [int(offsets[-1])]})

    return run


def vocabulary_of(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int | None = None, plain_specials: bool = False) -> dict:
    """Encode doc_id, text in ascending doc_id order into files below `path`; returns the index.

    Null texts are empty, so they have the end id alone. Null doc_ids come first; documents with
    the same doc_id (which must be numbers) are ordered by a hash of the text, then the text, and may lie in
    several partitions; equal rows stay. Other columns are not read. An empty table gives an index
    without documents. `path` is a URI that executors and driver share. Ids take 16 bits if the
    vocabulary (by default the tokenizer file's) allows it, else 32. The string of a special token in a text becomes that
    token, unless plain_specials asks for ordinary text.
    """
    dtype = "<u2" if (vocabulary or vocabulary_of(tokenizer)) <= 1 << 16 else "<u4"
    where, base = _open(path)
    where.create_dir(base, recursive=True)
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    ordered = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    written = map_batches(ordered, _write(path, tokenizer, end_id, dtype, plain_specials), "part long, docs long, nulls long, ids long")
    parts, base_ids = [], 0
    for row in sorted(written.collect()):  # a row per partition
        parts.append({"part": row["part"], "docs": row["docs"], "nulls": row["nulls"], "ids": row["ids"], "base": base_ids})
        base_ids += row["ids"]
    index = {"dtype": dtype, "end_id": end_id, "ids": base_ids, "parts": parts}
    with where.open_output_stream(f"{base}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def load(path: str, part: int, kind: str, dtype: str) -> np.ndarray:
    """One file as an array: memory-mapped where it is local, else read; empty if the partition has no rows."""
    where, base = _open(path)
    name = f"{base}/part-{part:06d}.{kind}"
    if where.get_file_info(name).size == 0:
        return np.empty(0, dtype)
    if where.type_name == "local":
        return np.memmap(name, dtype, "r")
    with where.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def _read(path: str, dtype: str, rows: int = 20_000):
    def run(batches):
        for batch in batches:
            for part, base, nulls in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "nulls")), strict=True):
                offsets = load(path, part, "offsets", "<u8").astype(np.int64)
                if len(offsets) < 2:
                    continue
                ids, docs = load(path, part, "ids", dtype), load(path, part, "docs", "<i8")
                for i in range(0, len(docs), rows):
                    bounds = offsets[i : i + rows + 1]
                    own = docs[i : i + rows]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=np.arange(i, i + len(own)) < nulls),
                            pa.array(bounds[:-1] + base, pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    An empty or null text has its end id; an index without documents gives no rows.
    """
    where, base = _open(path)
    with where.open_input_file(f"{base}/index.json") as f:
        index = json.loads(f.read())
    rows = [(p["part"], p["base"], p["nulls"]) for p in index["parts"]]
    parts = spark.createDataFrame(rows, "part long, base long, nulls long").repartition(max(1, len(rows)), "part")
    return map_batches(parts, _read(path, index["dtype"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
