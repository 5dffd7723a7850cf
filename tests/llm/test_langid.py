import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarp.llm import langid, queries

SF = "/root/testdata/sf0.01"
PIECES = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba", b" ab"]


def segmentations(word, pieces):
    if not word:
        yield []
    for p in pieces:
        if word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces):
                yield [p, *rest]


@pytest.fixture
def toy():
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES), 3))
    return langid.Lattice(PIECES), np.log(p / p.sum(0))


def test_forward_sums_all_segmentations(toy):
    lattice, log_p = toy
    words = [b" a", b" abab", b" b", b" bbabaab", b" aaaa"]
    got = langid.log_probabilities(lattice, log_p, words)
    for w, row in zip(words, got, strict=True):
        for k in range(3):
            want = sum(math.prod(math.exp(log_p[PIECES.index(p), k]) for p in cut) for cut in segmentations(w, PIECES))
            assert abs(row[k] - math.log(want)) < 1e-9


def test_expected_counts_are_those_of_all_segmentations(toy):
    lattice, log_p = toy
    words, lang, n = [b" abab", b" bba", b" ab"], np.array([0, 2, 0]), np.array([3.0, 1.0, 2.0])
    want = np.zeros(log_p.shape)
    for w, k, c in zip(words, lang, n, strict=True):
        cuts = [(cut, math.prod(math.exp(log_p[PIECES.index(p), k]) for p in cut)) for cut in segmentations(w, PIECES)]
        for cut, p in cuts:
            for piece in cut:
                want[PIECES.index(piece), k] += c * p / sum(q for _, q in cuts)
    np.testing.assert_allclose(langid.expected_counts(lattice, log_p, words, lang, n), want, atol=1e-9)


def test_rounds_raise_the_likelihood(toy):
    lattice, _ = toy
    words, n = [b" abab", b" ab", b" ba", b" aba"], np.array([3.0, 5.0, 1.0, 2.0])
    log_p, last = np.full((len(PIECES), 1), -np.log(len(PIECES))), -np.inf
    for _ in range(6):
        now = float(langid.log_probabilities(lattice, log_p, words)[:, 0] @ n)
        assert now >= last - 1e-9
        last = now
        counts = langid.expected_counts(lattice, log_p, words, np.zeros(4, int), n)
        log_p = np.log(np.maximum(counts, 1e-300) / counts.sum())


def test_long_words_do_not_underflow(toy):
    lattice, log_p = toy
    word = b" " + b"ab" * 20_000
    got = langid.log_probabilities(lattice, log_p, [word, b" ab"])
    assert np.isfinite(got).all() and (got[0] < -5_000).all()


def test_words():
    assert langid.words_of("Été, l'ÎLE d\0x 中文—Ǆ_1a²".encode()) == ["".join((" ", w)).encode() for w in ("été", "l", "île", "d", "x", "中文", "ǆ", "a²")]
    assert langid.words_of("1 ² — ½ 3!".encode()) == [] == langid.words_of(b"") == langid.words_of("² —".encode())
    assert langid.words_of(b"A b") == [b" a", b" b"]


def test_held_out_documents_are_recognised(spark):
    got = queries.op11_language_id(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas(), on="doc_id")
    assert len(got) == 1000 and (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert 200 < len(held) < 300 and (held.lang_pred == held.lang).mean() > 0.98
    assert (held[held.n_chars > 200].lang_pred == held[held.n_chars > 200].lang).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_hard_rows(spark):
    long = "the word and other words " * 20_000
    rows = [(1, None, "en"), (2, "", "en"), (3, "the and of", "en"), (3, "the and of", "en"), (4, "der die das und", "de"), (5, "12 ?! — ²", "de"), (None, "der und die", "de"), (6, "no lang", None), (7, long, "en"), (8, "x" * 100_000, "de"), (9, "中文 é", "zh")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({"score": F.lit(9), "lang_pred": F.lit("q"), "_text": F.lit(1), "a.b": F.lit(3), "word": F.lit(2)})
    model = langid.train(d, queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    assert model.langs == ["de", "en", "zh"]
    got = langid.predict(d, model)
    assert got.columns == [*[c for c in d.columns if c not in ("score", "lang_pred")], "lang_pred", "score"]
    rows = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in got.collect()))
    assert len(rows) == 11
    assert [r[1] for r in rows if r[0] in (1, 2, 5)] == ["und"] * 3 and all(r[2] == 0 for r in rows if r[1] == "und")
    assert [r[1] for r in rows if r[0] in (0, 3, 4, 7)] == ["de", "en", "en", "de", "en"]
    assert langid.predict(d.limit(0), model).count() == 0
    none = langid.train(d.limit(0), queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    assert none.langs == [] and {(r["lang_pred"], r["score"]) for r in langid.predict(d, none).collect()} == {("und", 0.0)}
    only = langid.train(d.filter("doc_id IN (1, 2, 5)"), queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    assert only.langs == []
