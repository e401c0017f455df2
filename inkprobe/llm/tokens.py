"""Token ids by the tokenizers library, word by word and remembered.

The vocabulary's normaliser and pre-tokenizer never join text across white space, so a text's ids are the ids of its
white-space-separated words, in order. Where the rules are those of RULES, words are cut further into pieces that these rules
always keep apart: runs of Latin letters, digits, and runs of other ASCII characters. A worker remembers the ids of words or
pieces it has met, up to a fixed number, and hands only unknown ones to the library: runs of Latin letters many at a time to
its merge model, where the vocabulary marks each word's last token, and anything else to the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

#: Words a worker remembers: two generations of half as many; a word met again moves to the younger one.
REMEMBERED = 300_000
#: First bytes in UTF-8 of the combining marks that compose with ASCII letters.
COMBINING = (b"\xcc", b"\xcd")
#: What is split from the letters before it whatever follows.
MARKS = (b".", b",")
#: Words that the merge model takes in one text.
TOGETHER = 500
#: The normaliser and pre-tokenizer, as the library spells them, of vocabularies whose words are cut into pieces.
RULES = (
    r'''Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])''',
    r'''Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])''',
)
#: Kinds of bytes. A word that holds an odd one stays whole: an apostrophe binds what follows, "<" may begin a special token,
#: capitals are left in texts that aren't folded, and what isn't ASCII may compose, or be a space.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
#: Bytes cut into pieces at a time, and what ends a block.
BLOCK = 1 << 18
GAP = re.compile(rb"[ \t-\r]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies spell each byte: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


def folded(texts: list[bytes]) -> list[bytes]:
    """The texts with ASCII letters in lower case, for a vocabulary that folds case: but for texts in which that could change
    what composes, or make a special token's name."""
    return [t if b"<|" in t or COMBINING[0] in t or COMBINING[1] in t else t.lower() for t in texts]


def latin_letters(word: bytes) -> bytes | None:
    """The word in lower case if it is a run of Latin letters, which normalise and split to themselves; else None."""
    if word.isalpha():  # of bytes: ASCII letters
        return word.lower()
    try:
        text = word.decode("utf-8").lower()
    except UnicodeDecodeError:
        return None
    return text.encode("utf-8") if text.isalpha() and max(text) < "ɐ" else None


def word_table(texts: list[bytes]):
    """The words of texts, those between ASCII white space: (each distinct word; the place there of every word in
    order; per text the count of words before it, and at last of all). Arrow splits and numbers them. Texts that begin or end
    in white space have the empty word there."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = pa.array(texts, pa.binary())
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), raw.null_count, raw.offset))
    coded = split.values.dictionary_encode()
    words = coded.dictionary
    words = pa.Array.from_buffers(pa.binary(), len(words), words.buffers()).to_pylist()
    return words, coded.indices, split.offsets.to_numpy().astype(np.int64)


def kinds() -> bytes:
    """The kind of each byte by itself."""
    kind = bytearray([ODD]) * 256
    for b in range(0x21, 0x7F):
        kind[b] = LETTER if 0x61 <= b <= 0x7A else DIGIT if 0x30 <= b <= 0x39 else ODD if b in b"'<" or 0x41 <= b <= 0x5A else OTHER
    for b in b" \t\n\x0b\f\r":
        kind[b] = SPACE
    return bytes(kind)


def pieces(data):
    """Where the pieces of bytes begin, their sizes, and their bytes together. ``data`` ends in white space and is changed."""
    import numpy as np

    kind = np.frombuffer(kinds(), np.uint8)[data]
    lead = np.flatnonzero(data == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        ends = np.flatnonzero(kind == SPACE)
        of = np.unique(np.searchsorted(ends, odd))
        inside = np.zeros(len(data), np.int8)
        inside[np.where(of > 0, ends[of - 1] + 1, 0)] = 1
        inside[ends[of]] -= 1
        kind[np.cumsum(inside, dtype=np.int8).view(bool)] = ODD
        lead = lead[kind[lead] == LETTER]
    data[lead[data[lead + 1] < 0x9F] + 1] += 0x20  # below U+00DF; that is ß, which has no capital there
    begins = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    word = kind != SPACE
    starts = np.flatnonzero(begins & word)
    return starts, (np.flatnonzero(begins[1:] & word[:-1]) + 1 - starts).astype(np.int32), data[word].tobytes()


def piece_table(texts: list[bytes]):
    """word_table() of the pieces of texts that are folded() and whose vocabulary has the RULES: a change of kind inside a word,
    or a digit, begins a piece. Letters are a-z and U+00C0 to U+00FF, these in lower case afterwards; words with an odd byte stay
    whole and as they are. Bytes are cut a block of whole words at a time, so a long text takes little more than its words."""
    import numpy as np
    import pyarrow as pa

    raw = bytearray(b"\n".join([*texts, b""]))
    of_texts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    sizes, kept, before, n, at = [np.zeros(1, np.int32)], [], [], 0, 0
    while at < len(raw):
        gap = GAP.search(raw, at + BLOCK)
        end = gap.end() if gap else len(raw)
        starts, size, own = pieces(np.frombuffer(raw, np.uint8, end - at, at))
        begin = of_texts[np.searchsorted(of_texts, at) : np.searchsorted(of_texts, end)]
        before.append(n + np.searchsorted(starts, begin - at))
        sizes.append(size)
        kept.append(own)
        n, at = n + len(size), end
    del raw
    ends = np.cumsum(np.concatenate(sizes), dtype=np.int32)
    coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(kept))]).dictionary_encode()
    if not n:
        return [], coded.indices, np.zeros(len(texts) + 1, np.int64)
    distinct = coded.dictionary
    ends = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist()
    own = distinct.buffers()[2].to_pybytes()
    return [own[a:b] for a, b in zip(ends, ends[1:])], coded.indices, np.concatenate([*before, [n]])


def joined(of_words: list[bytes], places, offsets, skip: int = 0) -> Iterator[bytes]:
    """Per text what stands for its words, one after the other, but for the first ``skip`` bytes."""
    import numpy as np
    import pyarrow as pa

    long = pa.array(of_words, pa.large_binary()).take(places)
    ends = np.frombuffer(long.buffers()[1], np.int64, len(long) + 1)[offsets].tolist()
    data = memoryview(long.buffers()[2] or b"").cast("B")
    for a, b in zip(ends, ends[1:]):
        yield bytes(data[a + skip : b])


def looked_up(memory, words: list[bytes], most: int = REMEMBERED) -> list:
    """Age a memory whose younger generation is full, learn the words that neither generation knows, and move to the younger
    one what only the older knows."""
    if len(memory.known) > most // 2:
        memory.older, memory.known = memory.known, {}
    known, older, new = memory.known, memory.older, []
    found = list(map(known.get, words))
    missing = [i for i, x in enumerate(found) if x is None]
    for i in missing:
        w = words[i]
        if w in older:
            known[w] = older[w]
        else:
            new.append(w)
    if new:
        memory.learn(new)
    for i in missing:
        found[i] = known[words[i]]
    return found


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.words = None
        if suffix and (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)) == RULES:
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for s, i in vocabulary.items() if s.endswith(suffix)]] = True
            self.spelled = {b: s for b, s in enumerate(byte_letters()) if chr(b) != s and b != 0x20}

    def _ids(self, texts: Iterable[bytes]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of runs of Latin letters in lower case, by the library's merge model."""
        import numpy as np

        texts = [b" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        texts = [t.decode("ascii") if t.isascii() else t.decode("latin-1").translate(self.spelled) for t in texts]
        out: list[bytes] = []
        for k, found in enumerate(self.words.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != min(TOGETHER, len(words) - k * TOGETHER):
                raise ValueError("a word has no last token")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def learn(self, words: list[bytes]) -> None:
        """Have the ids of these words, or pieces, from the library."""
        plain, latin, other = [], [], words  # runs of ASCII letters, of any Latin letters, and the rest
        if self.words is not None:
            other = []
            for w in words:
                (plain if w.isalpha() and w.islower() else latin if latin_letters(w) == w else other).append(w)
        for new, ids in ((plain, self._letters), (latin, self._letters), (other, self._ids)):
            if new:
                self.known.update(zip(new, ids(new)))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text. Words are bytes between ASCII white space; other white space stays inside a word."""
        words, places, offsets = word_table(texts) if self.words is None else piece_table(folded(texts))
        return joined(looked_up(self, words), places, offsets)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
