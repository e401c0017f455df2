import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkprobe.llm import bitplane, tokens
from inkprobe.llm.tokens import WordEncoder, default_vocabulary

TEXTS = [
    "", " \n\t ", "Plain words, and more. words", "É J̌ á <|ENDOFTEXT|> <|endoftext|>x", "don't it's 'S x y\u0085z",
    "İı ſK Σς", "a.b, c... d.,", "́a ̀", "한국어 日本 \U0001f600 ﬁ 12,3.4", "word " * 5000,
]


@pytest.fixture(scope="module")
def library():
    return WordEncoder(default_vocabulary())


def test_words_give_the_library_s_ids(library):
    want = [np.array(library.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in TEXTS]
    assert list(library.encode([t.encode() for t in TEXTS])) == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_gives_the_library_s_ids(library, text):
    want = np.array(library.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert list(library.encode([text.encode()])) == [want]


def test_a_run_of_letters_is_learned_once_whatever_stands_around_it():
    fresh = WordEncoder(default_vocabulary())
    list(fresh.encode(["Word word, word$$$ (WORD) word7 7.word WÉß wéß! don't".encode()]))
    assert set(fresh.known) == {b"word", b",", b"$$$", b"(", b")", b"7", b".", "wéß".encode(), b"!", b"don't"}


#: What the vocabulary's rules keep apart or bind, and what composes or folds.
EDGES = st.sampled_from([*"aéÉßÞþÿ×÷st'.,!$<|> \n5½²ª\u0301\u0338\u0331\u05b0\u0085\u00a0\u3000\x00\x1cKİſΣ日\u037e", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(EDGES, max_size=12).map("".join), max_size=4))
def test_words_cut_into_pieces_give_the_library_s_ids(library, texts):
    want = [np.array(library.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert list(library.encode([t.encode() for t in texts])) == want


@pytest.mark.parametrize("block", [1, 2, 7, 100])
def test_blocks_end_between_words(library, monkeypatch, block):
    want = [np.array(library.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in TEXTS]
    monkeypatch.setattr(tokens, "BLOCK", block)
    assert list(library.encode([t.encode() for t in TEXTS])) == want
    assert list(library.encode([])) == [] and list(library.encode([b"", b" ", b""])) == [b""] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=6), st.sampled_from(["bit", "byte"]), st.integers(1, 50))
def test_segments_round_trip(documents, unit, chunk):
    raw = [np.array(d, dtype="<u4").tobytes() for d in documents]
    assert bitplane.unpack(bitplane.pack(raw, chunk, unit)) == raw


def test_a_damaged_segment_is_noticed():
    segment = bytearray(bitplane.pack([np.arange(1000, dtype="<u4").tobytes()]))
    segment[60] ^= 255
    with pytest.raises(Exception):
        bitplane.unpack(bytes(segment))


def test_archive_against_brute_force(spark, tmp_path, library):
    rows = [(5, "b c"), (1, None), (9, ""), (5, "a"), (None, "last"), (3, "Long text. " * 300), (2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    docs = docs.selectExpr("*", "1 as ids", "'c' as payload")
    bitplane.token_archive(docs.repartition(3), f"file://{tmp_path}/a", ranges=3)
    got = sorted((r.start, r.id, bytes(r.ids)) for r in bitplane.read_planes(spark, f"file://{tmp_path}/a").collect())
    want = []
    for i, t in rows:
        ids = [*library.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i is None, i or 0, np.array(ids, dtype="<u4").tobytes(), i))
    start, expected = 0, []
    for _, _, ids, i in sorted(want):
        expected.append((start, i, ids))
        start += len(ids) // 4
    assert got == expected


def test_a_hot_id_is_dealt_to_many_ranges(spark, tmp_path, library):
    """A third of the rows hold one id, another third none."""
    rows = [(7, f"seven {k}") for k in range(300)] + [(None, f"none {k}") for k in range(300)] + [(k, "other") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = bitplane.id_ranges(docs, "doc_id", 12)
    assert len(ranges) >= 10 and max(ranges.parts) >= 3
    bitplane.token_archive(docs, f"file://{tmp_path}/h", ranges=12)
    dealt = {r.range_no: r.n for r in spark.read.parquet(f"file://{tmp_path}/h").selectExpr("range_no", "size(doc_ids) as m").groupBy("range_no").agg(F.sum("m").alias("n")).collect()}
    assert max(dealt.values()) <= 250 and sum(dealt.values()) == 900
    got = sorted((r.start, r.id, bytes(r.ids)) for r in bitplane.read_planes(spark, f"file://{tmp_path}/h").collect())
    assert [g[1] for g in got] == sorted([r[0] for r in rows if r[0] is not None]) + [None] * 300
    assert [g[0] for g in got] == np.cumsum([0] + [len(g[2]) // 4 for g in got[:-1]]).tolist()
    want = [(i, np.array([*library.tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, t in rows]
    assert sorted((g[1:] for g in got), key=str) == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bitplane.token_archive(docs, f"file://{tmp_path}/e")
    assert bitplane.read_planes(spark, f"file://{tmp_path}/e").collect() == []


def test_query_matches_a_plain_loop(spark, library):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitplane.op1_bitplane(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for i, text in sorted(zip(t["doc_id"], t["text"])):
        ids = np.array([*library.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
