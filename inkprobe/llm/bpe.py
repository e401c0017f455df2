"""BPE by a tokenization automaton: merges compiled by successive merge gadgets, encoding by table-driven transitions,
decoding by emitting arc labels.

Construction. The automaton reads tokens and accepts exactly the sequences that the merges can leave. It begins with
one state that every symbol leads back to. For each merge (u, v), in order, a gadget is applied: let q be the state that
u leads to, r the state that v leads to from q. A copy of q without its v arc is made, every u arc now leads to the copy,
and wherever a u arc leaves a state, an arc labelled uv to r is added beside it. All arcs of one label lead to one
state, so the targets are one table by token. Copies share their arcs: a state keeps its parent and the label it lost,
and whether an arc exists is found by going up from the later of state and token, to the state's parent or to the
token's left part, whose arc the added arc stands beside. The copies made for one label u form a chain; the labels lost
along it are one table, and the copy that was the latest at some merge is found by bisection, so going up takes as many
steps as tokens have parts. Tables: ``target``, ``left`` and ``born`` by token, ``made`` and ``chain`` by state, and by chain
its states, when each was made, when each label was lost, and the state before the first.

Encoding. A pre-split word is read from left to right. At each position the vocabulary's tokens that begin there are
tried from longest to shortest; a token is taken if the automaton has its arc from the present state. The accepted
sequence of a word is unique, so a dead end means that an earlier token was too long, and the next shorter is tried;
positions found dead are remembered by state.

The merges must be in proper order (each part of a merge is a symbol or made by an earlier merge), else the automaton
would stand for other merges than the list; the compiler checks this.
"""

from __future__ import annotations

import hashlib
import json
import struct
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table, text_or_empty
from .tokens import MARKS, byte_letters, default_vocabulary, folded, joined, latin_letters, looked_up, word_table

#: Words and arcs that a worker remembers.
REMEMBERED = 200_000
ARCS = 150_000


class Automaton:
    """Deterministic automaton over tokens, compiled from a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        n = max(vocab.values()) + 1
        made_by = {vocab[a + b]: k for k, (a, b) in enumerate(merges, 1)}
        self.target, self.left, self.born = [0] * n, [-1] * n, [0] * n
        self.made, self.chain = [0], [-1]
        self.chain_states: dict[int, list[int]] = {}
        self.chain_made: dict[int, list[int]] = {}
        self.chain_lost: dict[int, dict[int, int]] = {}
        self.chain_base: dict[int, int] = {}
        self.live = [True] * n
        for t, k in made_by.items():
            self.live[t] = False
        memo: dict[tuple[int, int], bool] = {}
        self._memo = memo
        for k, (a, b) in enumerate(merges, 1):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if not (self.live[u] and self.live[v]) or made_by[uv] != k:
                raise ValueError(f"merge {k} ({a}, {b}) is out of order")
            q = self.target[u]
            if not self.has_arc(q, v):
                raise ValueError(f"merge {k} ({a}, {b}) can't take place")
            r = self.target[v]
            if u not in self.chain_states:
                self.chain_states[u], self.chain_made[u], self.chain_lost[u], self.chain_base[u] = [], [], {}, q
            new = len(self.made)
            self.made.append(k)
            self.chain.append(u)
            self.chain_states[u].append(new)
            self.chain_made[u].append(k)
            self.chain_lost[u][v] = k
            self.target[u] = new
            self.target[uv], self.left[uv], self.born[uv], self.live[uv] = r, u, k, True
        memo.clear()
        # labels by spelling, for looking up what begins at a position; tokens that end a word are spelled without the end mark
        self.inner = {s: t for s, t in vocab.items() if self.live[t] and not (word_end and s.endswith(word_end))}
        self.final = {s[: len(s) - len(word_end)]: t for s, t in vocab.items() if self.live[t] and s.endswith(word_end)} if word_end else self.inner
        self.begun = {s[:k] for s in self.inner for k in range(1, len(s) + 1)}  # what some token begins with
        self.shorter = {}  # the longest token that begins each token, itself excluded
        for s in self.inner:
            self.shorter[s] = next((s[:k] for k in range(len(s) - 1, 0, -1) if s[:k] in self.inner), "")
        self.label = {t: s for s, t in vocab.items()}

    def has_arc(self, state: int, token: int) -> bool:
        """Whether an arc labelled token leaves the state."""
        made, left, born = self.made, self.left, self.born
        while True:
            b = born[token]
            if b and b >= made[state]:
                token = left[token]  # added beside its left part's arc, after the state of the same merge was made
                continue
            if state == 0:
                return True
            u = self.chain[state]
            lost = self.chain_lost[u].get(token)
            if lost is not None and lost <= made[state]:
                return False
            # up to the copy that was there when the token was made
            i = bisect_right(self.chain_made[u], b)
            state = self.chain_states[u][i - 1] if i else self.chain_base[u]

    def encode(self, word: str) -> list[int]:
        """The tokens of one pre-split word, spelled in the vocabulary's symbols."""
        n, inner, final, target, memo = len(word), self.inner, self.final, self.target, self._memo
        whole = final.get(word)
        if whole is not None:  # from the first state every label has an arc
            return [whole]
        if len(memo) > ARCS:
            memo.clear()
        begun, shorter, split_end = self.begun, self.shorter, final is not inner
        path: list[int] = []
        back: list[tuple[int, int, str]] = []  # at each token of the path: where it began, the state before, its spelling
        dead: set[tuple[int, int]] = set()
        at, state, tried = 0, 0, None
        while at < n:
            token = -1
            if tried is None:
                end = at + 1
                tried = ""
                while end <= n - split_end and (part := word[at:end]) in begun:
                    if part in inner:
                        tried = part
                    end += 1
                t = final.get(word[at:]) if split_end else None
                if t is not None:
                    ok = memo.get(key := state << 20 | t)
                    if ok is None:
                        ok = memo[key] = self.has_arc(state, t)
                    if ok:
                        path.append(t)
                        return path
            while tried:
                t = inner[tried]
                ok = memo.get(key := state << 20 | t)
                if ok is None:
                    ok = memo[key] = self.has_arc(state, t)
                if ok and not (dead and (at + len(tried), target[t]) in dead):
                    token = t
                    break
                tried = shorter[tried]
            if token < 0:
                if not path:
                    raise ValueError(f"no tokens for {word!r}")
                dead.add((at, state))
                path.pop()
                at, state, tried = back.pop()
                tried = shorter[tried]
                continue
            path.append(token)
            back.append((at, state, tried))
            at, state, tried = at + len(tried), target[token], None
        return path


class AutomatonTokenizer:
    """A vocabulary file's whole way from text to ids and back, with the automaton in the middle.

    The file's own normaliser and pre-tokenizer split the words that aren't plain runs of letters.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = self.automaton.label | {i: s for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalise, self.presplit = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.spelled = byte_letters()
        self.known: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.folds = "Lowercase" in str(library.normalizer)
        self.marks = {m: self._pair(self.word_ids(m.decode())) for m in MARKS} if self.folds else {}

    def spell(self, piece: str) -> str:
        return "".join(map(self.spelled.__getitem__, piece.encode("utf-8")))

    def word_ids(self, text: str) -> list[int]:
        """The ids of a text; the general way, for one word or many."""
        ids: list[int] = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece, _ in self.presplit(self.normalise(part)):
                    ids += self.automaton.encode(piece)
        return ids

    def learn(self, words: list[bytes]) -> None:
        """Remember of each word its ids and its labels, each with a space before it."""
        known, older = self.known, self.older
        for w in words:
            mark = self.marks.get(w[-1:])
            stem = w[:-1] if mark else w
            low = (stem if stem.isalpha() and stem.islower() else latin_letters(stem)) if self.folds and stem else None
            if low is None:
                known[w] = self._pair(self.word_ids(w.decode("utf-8", "replace")))
                continue
            pair = known.get(low) or older.get(low) or self._pair(self.automaton.encode(low.decode("ascii") if low.isascii() else self.spell(low.decode("utf-8"))))
            known[low] = pair
            if low is not w:
                known[w] = (pair[0] + mark[0], pair[1] + mark[1]) if mark else pair

    def _pair(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), b"".join([b" " + self.label[i].encode("utf-8") for i in ids])

    def decode(self, ids) -> str:
        """The labels of the arcs taken, with a space between, as the library joins tokens where a file names no decoder."""
        return " ".join([self.label[i] for i in ids])

    def encode_decode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        words, places, offsets = word_table(folded(texts) if self.folds else texts)
        pairs = looked_up(self, words, REMEMBERED)
        return zip(joined([x[0] for x in pairs], places, offsets), joined([x[1] for x in pairs], places, offsets, skip=1))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        words, places, offsets = word_table(folded(texts) if self.folds else texts)
        return joined([x[0] for x in looked_up(self, words, REMEMBERED)], places, offsets)


_TOKENIZERS: dict[str, AutomatonTokenizer] = {}


def tokenizer(path: str) -> AutomatonTokenizer:
    """This worker's tokenizer for a vocabulary, compiled once."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = AutomatonTokenizer(path)
    return _TOKENIZERS[path]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids, decoded) of every row: ids as binary, little-endian unsigned 32-bit; decoded as binary, UTF-8.

    Null and empty texts have no ids and decode to nothing. Rows stay as they are, ties and repeats included; only the
    two named columns are read.
    """
    path = vocabulary or default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        both = tokenizer(path).encode_decode
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids, decoded = zip(*both(part.column(1).to_pylist()))
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text")).mapInArrow(run, "id long, ids binary, decoded binary")


def encode_column(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with a column ``token_ids`` (array of int) after its own; a column of that name is replaced."""
    path = vocabulary or default_vocabulary()
    keep = [c for c in docs.columns if c != "token_ids"]
    schema = docs.select(*keep).schema.add("token_ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = tokenizer(path).encode
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [(t or "").encode("utf-8") for t in part.column(text_col).to_pylist()]
                ids = [np.frombuffer(x, dtype="<i4") for x in encode(texts)]
                values = pa.array(np.concatenate(ids) if ids else np.array([], dtype="<i4"), pa.int32())
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(offsets, values)], names=[*keep, "token_ids"])

    return docs.select(*keep).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sha = lambda c: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in c], pa.string())
        for b in batches:
            n = pa.array([len(x.as_buffer()) // 4 for x in b.column(1)], pa.int64())
            yield pa.record_batch([b.column(0), n, sha(b.column(1)), sha(b.column(2))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_texts(table(spark, sf_dir, "documents")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
