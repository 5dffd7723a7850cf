import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scarp.llm import queries, tokens
from scarp.llm.common import new_path

ODD = [
    "", " ", "a", " a b", "a  b", "a\n b c", "a b ", "x  y z", "été. où, ñandú; Ça! don't word... a1. ǅ ʰx. 中文, 한국어.", "<|endoftext|> a <|endoftext|>", "\n", "a\n\nb  \n c d",
    "a\0 b", "\0", "b \0a", "it's we'll 12,5 x", "tab\tb c\td", "A B\u0085 C", "é ́x", "ab\x1f cd ef", "　x  y", "word.\nNext, line", "a .b , ,c",
]


def by_text(e, texts):
    ids, sizes = e(pa.array(texts, pa.string()), 0)
    ends = np.cumsum(sizes)
    assert (ids[ends - 1] == 0).all() and ends[-1] == len(ids)
    return [ids[b - n : b - 1].tolist() for b, n in zip(ends, sizes, strict=True)]


def test_pieces_give_the_ids_of_whole_texts():
    e = tokens.Encoder(queries.tokenizer_path(), "<u2")
    for _ in range(2):  # the second time from memory
        for text, got in zip(ODD, by_text(e, ODD), strict=True):
            assert got == e.tokenizer.encode(text, add_special_tokens=False).ids, text
        for text in ODD:
            assert by_text(e, [text]) == [e.tokenizer.encode(text, add_special_tokens=False).ids]
    assert by_text(e, ["x\ny", None, "x y"])[1] == []


def test_small_memory_changes_nothing(monkeypatch, spark):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    e = tokens.Encoder(queries.tokenizer_path(), "<u2")
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for i in range(0, len(texts), 7):
        for text, got in zip(texts[i : i + 7], by_text(e, texts[i : i + 7]), strict=True):
            assert got == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 .,'\n\t\u3000é中\0<|\u0120\u0301"), max_size=12), max_size=6))
def test_any_texts(texts):
    e = tokens.encoder(queries.tokenizer_path(), "<u2")
    assert by_text(e, [*texts, ""]) == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_files_hold_every_document_in_order(spark):
    got = queries.op7_token_files(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id")
    e = tokens.Encoder(queries.tokenizer_path(), "<u2")
    start = 0
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r["doc_id"])
    for r, row in zip(docs, got.itertuples(), strict=True):
        ids = [*e.tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_wide_ids_and_other_tokenizers(spark):
    path = new_path(spark, "wide")
    docs = spark.createDataFrame([(2, "Hello  there"), (1, "A b")], "doc_id long, text string")
    index = tokens.write_tokens(docs, path, queries.tokenizer_path("word_bpe_49k.json"), end_id=49407, vocabulary=1 << 20)
    part = [tokens.load(path, p["part"], "ids", index["dtype"]) for p in index["parts"]]
    assert index["dtype"] == "<u4" and sum(map(len, part)) == index["ids"] and sum(int((p == 49407).sum()) for p in part) == 2


def test_special_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["<|endoftext|> a <|endoftext|>", "x<|endoftext|>y", "a  <|endoftext|>\n b", "<|endoftext", *ODD]
    assert by_text(tokens.Encoder(queries.tokenizer_path(), "<u2"), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert library.encode(texts[0], add_special_tokens=False).ids.count(50256) == 2
    path = new_path(spark, "plain")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write_tokens(docs, path, queries.tokenizer_path(), plain_specials=True)
    library.encode_special_tokens = True
    want = [zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts]
    assert [r["ids_crc32"] for r in tokens.read_tokens(spark, path).orderBy("doc_id").collect()] == want
