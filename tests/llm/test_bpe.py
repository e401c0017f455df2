import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkprobe.llm import bpe
from inkprobe.llm.tokens import default_vocabulary

TEXTS = [
    "", " \n ", "Plain words, and more. words", "É J̌ á <|ENDOFTEXT|> <|endoftext|>x", "don't it's 'S x y\u0085z", "İı ſK Σς",
    "a.b, c... d.,", "한국어 日本 \U0001f600 ﬁ 12,3.4", "a" * 200, "the" * 700, "aaa aaaa aaaaa",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def want(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()


def test_texts(library):
    assert list(bpe.tokenizer(default_vocabulary()).encode_decode([t.encode() for t in TEXTS])) == [want(library, t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50) | st.text("abcdethinors", max_size=30))
def test_any_text(library, text):
    assert list(bpe.tokenizer(default_vocabulary()).encode_decode([text.encode()])) == [want(library, text)]


def merge_by_rank(word, merges):
    """BPE as it is usually put: the first merge in the list that applies, leftmost, again and again."""
    rank, parts = {m: k for k, m in enumerate(merges)}, list(word)
    while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_small_automata_against_merging():
    rng = random.Random(7)
    for _ in range(200):
        merges, tokens = [], list("abc")
        for _ in range(rng.randint(1, 12)):
            m = (rng.choice(tokens), rng.choice(tokens))
            if m[0] + m[1] in tokens:
                continue
            merges.append(m)
            tokens.append(m[0] + m[1])
        vocab = {t: k for k, t in enumerate(tokens)}
        try:
            a = bpe.Automaton(vocab, merges)
        except ValueError:
            continue  # a merge that can't take place
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert [a.label[t] for t in a.encode(word)] == merge_by_rank(word, merges), (merges, word)


def test_improper_merges_are_refused():
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "aab": 3}, [("a", "ab"), ("a", "b")])


def test_query(spark, library):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, "/root/testdata/sf0.001").collect()}
    for i, text in zip(t["doc_id"], t["text"]):
        ids, decoded = want(library, text or "")
        assert got[i] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())


def test_odd_tables(spark, library):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id long, text string, decoded int")
    got = [(r.id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode_texts(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, b"", b""), (1, b"", b""), (None, *want(library, "a b"))], key=str)
    assert bpe.encode_texts(docs.limit(0)).collect() == []
    rows = bpe.encode_column(docs).collect()
    assert [r.token_ids for r in rows if r.doc_id is None] == [library.encode("a b", add_special_tokens=False).ids]
