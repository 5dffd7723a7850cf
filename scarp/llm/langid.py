"""Language identification by unigrams of pieces, summed over all segmentations.

A text is its words, lower-cased maximal runs of letters. A word (a space and its UTF-8 bytes) can be cut into pieces of a fixed
public vocabulary in many ways; each language has a probability for each piece, and a word's
probability is the sum over all ways of the product of their pieces, by the forward algorithm. Piece
probabilities are learned by expectation-maximization: the words of all training texts are counted by
language, and each round adds up the expected counts of pieces over all segmentations (forwards and
backwards). A text's score adds up its words. The model has a number for each piece and
language, so its size does not depend on the corpus.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, map_batches, materialize, mix, texts_of

ROUNDS = 3
#: Bytes of the longest piece that is used.
MAX_PIECE = 16
#: Expected pieces that a language borrows from all languages together, and those from the uniform distribution.
BORROWED, UNIFORM = 20.0, 1000.0
UNKNOWN = "und"
#: Words that a task counts before it hands them on, that a worker remembers, and whose lattices are built at once.
_HELD, _REMEMBERED, _AT_ONCE = 300_000, 400_000, 20_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = np.uint64(20)
_ODD = re.compile(r"(?![^\W\d_])[^\x00-\x7F]")
#: Every byte that is no ASCII letter becomes a space; those of other characters stay.
_BREAKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, each with a space before it; of a text without letters none."""
    if not text.isascii():
        text = _ODD.sub(" ", text.decode(errors="replace").lower()).encode()
        found = text.translate(_BREAKS).split()
        if not any(w.isascii() for w in found) and not any(c.isalpha() for c in text.decode()):
            return []
    else:
        found = text.lower().translate(_BREAKS).split()
    return [b" " + w for w in found]


def read_pieces(path: str, longest: int = MAX_PIECE) -> list[bytes]:
    """The pieces of a rank file (base64 and rank in each line) that can stand in a word, and all single bytes."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    inside = re.compile(rb" ?[a-z\x80-\xff]+")
    return sorted({t for t in tokens if len(t) <= longest and inside.fullmatch(t)} | {bytes([b]) for b in range(256)})


class Lattice:
    """Where pieces stand in words."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for b in p:
                h = (h * int(_MULTIPLIER) + b + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = h
        keys = mix(keys)
        self.ids = np.argsort(keys)
        self.keys = keys[self.ids]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.maybe = np.zeros(1 << int(_FILTER_BITS), bool)
        self.maybe[self.keys >> (np.uint64(64) - _FILTER_BITS)] = True

    def arcs(self, words: list[bytes]):
        """(word, first node, last node, place of the first in its word, length, piece) of every piece; a word of n bytes has n + 1 nodes, all words' one after the other."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(words)), size)
        room = (begin + size)[owner] - np.arange(len(data))
        at, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        starts, lengths, ids = [], [], []
        for m in range(1, self.longest + 1):
            fits = room[at] >= m
            at, h = at[fits], h[fits] * _MULTIPLIER + data[at[fits] + (m - 1)] + np.uint64(1)
            if not len(at):
                break
            key = mix(h)
            likely = np.flatnonzero(self.maybe[key >> (np.uint64(64) - _FILTER_BITS)])
            found = np.searchsorted(self.keys, key[likely])
            real = self.keys[np.minimum(found, len(self.keys) - 1)] == key[likely]
            starts.append(at[likely[real]])
            ids.append(self.ids[found[real]])
            lengths.append(np.full(len(ids[-1]), m))
        start, length, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, lengths, ids))
        word = owner[start]
        return word, start + word, start + word + length, start - begin[word], length, piece, begin + np.arange(len(words)), size


def _sweep(step: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, value: np.ndarray) -> None:
    """value[target] becomes the log of the sum of exp(value[source] + weight) over a target's arcs, for one step after the other."""
    order = np.lexsort((target, step))
    source, target, step = source[order], target[order], step[order]
    weight = weight[order]
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(step)])) if len(step) else np.zeros(1, int)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        to = target[a:b]
        first = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1))
        v = value[source[a:b]] + weight[a:b]
        top = np.maximum.reduceat(v, first, axis=0)
        total = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(first, b - a)), axis=0)), first, axis=0)
        value[to[first]] = top + np.log(total)


def log_probabilities(lattice: Lattice, log_p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """For each word and language the log of the sum over all segmentations."""
    word, source, target, place, length, piece, node, size = lattice.arcs(words)
    value = np.full((int(size.sum()) + len(words), log_p.shape[1]), -np.inf)
    value[node] = 0
    _sweep(place + length, source, target, log_p[piece], value)
    return value[node + size]


def expected_counts(lattice: Lattice, log_p: np.ndarray, words: list[bytes], lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pieces by languages: how often each piece is expected in n times each word, over all its segmentations."""
    word, source, target, place, length, piece, node, size = lattice.arcs(words)
    weight = log_p[piece, lang[word]]
    ahead, back = np.full((2, int(size.sum()) + len(words)), -np.inf)
    ahead[node] = 0
    back[node + size] = 0
    _sweep(place + length, source, target, weight, ahead)
    _sweep(-place, target, source, weight, back)
    share = np.exp(ahead[source] + weight + back[target] - ahead[node + size][word]) * n[word]
    return np.bincount(piece * log_p.shape[1] + lang[word], share, log_p.size).reshape(log_p.shape)


def _count(batches):
    """lang, word, n of a task's texts; the empty word counts the texts that have words."""
    held: dict[str, defaultdict] = {}

    def flush():
        rows = [(lang, w, n) for lang, own in held.items() for w, n in own.items()]
        held.clear()
        lang, word, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), texts_of(batch)
        for a, b in chunks(texts):
            by_lang = defaultdict(list)
            for lang, text in zip(langs[a:b], texts[a:b], strict=True):
                by_lang[lang].append(words_of(text))
            for lang, lists in by_lang.items():
                words, own = Words(lists), held.setdefault(lang, defaultdict(int))
                for w, n in zip(words.unique, np.bincount(words.ids, minlength=len(words.unique)).tolist(), strict=True):
                    own[w] += n
                own[b""] += int((words.lengths > 0).sum())
            if sum(map(len, held.values())) >= _HELD:
                yield flush()
    if held:
        yield flush()


def _expect(lattice_of, log_p: np.ndarray, langs: dict[str, int]):
    """The expected counts of a task's words, one row for each piece and language that has any."""

    def run(batches):
        lattice, total = lattice_of(), np.zeros(log_p.shape)
        held: list[pa.RecordBatch] = []

        def add():
            words, lang, n = (list(chain.from_iterable(b.column(c).to_pylist() for b in held)) for c in ("word", "lang", "n"))
            total[:] += expected_counts(lattice, log_p, words, np.array([langs[x] for x in lang]), np.array(n, float))
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _AT_ONCE:
                add()
        if held:
            add()
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    return run


def _log_p(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces by language, smoothed by those of all languages and these by uniform ones."""
    every = counts.sum(1)
    shared = (every + UNIFORM / len(every)) / (every.sum() + UNIFORM)
    return np.log((counts + BORROWED * shared[:, None]) / (counts.sum(0) + BORROWED))


@dataclass
class Model:
    """Learned languages (ascending), log priors, pieces, and log_p[piece, language]."""

    langs: list[str]
    log_prior: np.ndarray
    pieces: list[bytes]
    log_p: np.ndarray


def train(documents: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> Model:
    """A model of the texts of `documents` with their lang; `vocabulary` names a rank file.

    All texts count, whole. Null texts and texts without letters add nothing, rows without a lang are not read, equal
    rows count each; a lang none of whose texts has a letter is not learned; an empty table gives a model without
    languages, which calls every text UNKNOWN. The driver holds the model: a number for each piece and language.
    """
    spark = documents.sparkSession
    pieces = read_pieces(vocabulary)
    texts = documents.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = materialize(map_batches(texts, _count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    empty = F.octet_length("word") == 0
    texts_by_lang = sorted((r["lang"], r["n"]) for r in words.filter(empty).filter("n > 0").select("lang", "n").collect())  # a row per language
    langs = [lang for lang, _ in texts_by_lang]
    n = np.array([n for _, n in texts_by_lang], float)
    log_p = np.full((len(pieces), len(langs)), -np.log(len(pieces)))
    at = {lang: i for i, lang in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        sums = map_batches(words.filter(~empty), _expect(lambda: Lattice(pieces), log_p, at), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        found = sums.toPandas()
        counts = np.zeros(log_p.shape)
        counts[found["piece"], found["lang"]] = found["n"]
        log_p = _log_p(counts)
    return Model(langs, np.log(n / n.sum()) if langs else n, pieces, log_p)


class Scorer:
    """Words to log probabilities; a worker remembers those of late."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.empty((0, len(self.model.langs)))

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) + len(words) > max(_REMEMBERED, len(words)):
            self._forget()
        new = [w for w in words if w not in self.at]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        parts = [log_probabilities(self.lattice, self.model.log_p, new[i : i + _AT_ONCE]) for i in range(0, len(new), _AT_ONCE)]
        self.rows = np.concatenate((self.rows, *parts))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of the likeliest language, the first of equals (-1: no letter), and its probability."""
        words = Words([words_of(t) for t in texts])
        if not self.model.langs or not len(words.ids):
            return np.full(len(texts), -1), np.zeros(len(texts))
        table, owner = self.words(list(words.unique)), words.owner()
        total = np.stack([np.bincount(owner, table[:, k][words.ids], len(texts)) for k in range(len(self.model.langs))], axis=1) + self.model.log_prior
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        known = words.lengths > 0
        return np.where(known, best, -1), np.where(known, share, 0.0)


def _predict(model: Model, column: str):
    def run(batches):
        scorer = Scorer(model)
        names = pa.array([*model.langs, UNKNOWN], pa.string())
        for batch in batches:
            texts = texts_of(batch, column)
            found = [scorer.texts(texts[a:b]) for a, b in chunks(texts)]
            best = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
            score = np.concatenate([f[1] for f in found]) if found else np.empty(0)
            rest = [i for i, name in enumerate(batch.schema.names) if name != column]
            out = [*[batch.column(i) for i in rest], names.take(pa.array(best % len(names))), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, [*[batch.schema.names[i] for i in rest], "_lang_pred", "_score"])

    return run


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (by default all) with lang_pred and score (input columns of these names are replaced).

    lang_pred is the likeliest language for the whole text, priors included (of equal ones the first by name), score its
    probability among the learned languages, from 0 to 1. UNKNOWN with score 0 if the text is null or has no letter, or if no
    language was learned. Equal texts get equal results, every row stays; an empty table gives no rows.
    """
    new = ("lang_pred", "score")
    names = [c for c in (documents.columns if keep is None else keep) if c not in new]
    held = [f"_column{i}" for i in range(len(names))]
    own = documents.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(names, held, strict=True)], F.col("text").cast("string").alias("_text"))
    more = [T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType())]
    return map_batches(own, _predict(model, "_text"), T.StructType([*[own.schema[h] for h in held], *more])).toDF(*names, *new)
