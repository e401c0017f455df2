"""Substring dedup by super-k-mer partitioning.

A window is K consecutive words. Its minimiser is the M-word run in it with the smallest hash. Consecutive windows that
share a minimiser form a super-k-mer: their words travel once, as one packed string, to the bucket that the minimiser
names, so equal windows of any two documents meet in one bucket. There the words get exact numbers, the windows are sorted
and equal ones counted, and each window learns the smallest document that it starts in.

Before anything is sent, a batch of documents is reduced: of equal super-k-mers in a batch only the one in the smallest
document needs the bucket's verdict. The others repeat that one whatever the bucket finds and are marked at once. So a
passage that a third of all documents share is sent once per batch, not once per document.

What a batch sends to a bucket is one compressed string: its distinct words once, in the order they come, and numbers for
those that come again. Words are split, numbered and looked up as arrays, a batch or a bucket at a time, since a Python
object per word or super-k-mer took most of the time and memory. Marks, and the texts they belong to, meet by document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, table, text_or_empty

K = 13
M = 2
#: Bytes of text that a task reduces together.
BATCH = 8 << 20
#: Windows of a bucket that are sorted together, about.
SORTED = 1 << 20
NO_ID = (1 << 63) - 1
#: Of a bucket's string: how many super-k-mers, places, distinct words and words.
HEAD = struct.Struct("<IIII")
#: Of each place of a super-k-mer: its document, the document's check, its first window, its entry.
PLACE = ("<i8", "<i4", "<i4", "<i4")


def mixed(x):
    """A bijection of 64-bit numbers that leaves no order of the words' hashes."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def planes(x, kind: str) -> bytes:
    """Numbers as bytes: all first bytes, then all second ones, and so on."""
    import numpy as np

    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw: bytes, n: int, at: int, kind: str):
    import numpy as np

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def steps(x):
    """Differences of numbers; their running sum gives the numbers back."""
    y = x.copy()
    y[1:] -= x[:-1]
    return y


def flat(begins, lengths):
    """The positions of all ranges, one after the other."""
    import numpy as np

    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def super_kmers(hashes, counts, k: int = K, m: int = M):
    """(first word, windows, minimiser) of each super-k-mer of documents that follow each other, from their words' hashes;
    ``counts``: how many words each document has."""
    import numpy as np

    n = len(hashes) - k + 1
    if n <= 0:
        none = np.array([], np.int64)
        return none, none, none.view(np.uint64)
    runs = hashes[: len(hashes) - m + 1].copy()
    for j in range(1, m):
        runs = runs * np.uint64(0x100000001B3) + hashes[j : len(hashes) - m + 1 + j]
    runs = mixed(runs)
    # the least of k - m + 1 runs, by doubling
    width, least = 1, runs
    while width * 2 <= k - m + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = k - m + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    # no window reaches into the next document
    ends = np.cumsum(counts)
    inside = np.repeat(ends, counts)[:n] - np.arange(n) >= k
    new = np.concatenate(([True], least[1:] != least[:-1]))
    starts = ends - counts
    new[starts[starts < n]] = True
    begin = inside & (new | ~np.concatenate(([False], inside[:-1])))
    first = np.flatnonzero(begin)
    last = np.flatnonzero(inside & np.concatenate((begin[1:] | ~inside[1:], [True])))
    return first, last - first + 1, least[first]


class Batch:
    """Documents reduced together: marks that are certain, and what each bucket is sent."""

    def __init__(self, buckets: int, k: int, m: int):
        self.buckets, self.k, self.m = buckets, k, m
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.docs, self.checks, self.counts, self.words, self.hashes = [], [], [], [], []
        #: Arrays of documents, checks, first windows and windows; known once packed() has begun.
        self.marks = None

    def add(self, doc: int, check: int, words: list[bytes], hashes=None) -> None:
        """One document; ``hashes`` replace those of its words, for all documents of the batch or for none."""
        import numpy as np
        import pyarrow as pa

        if hashes is not None:
            self.hashes.append(np.asarray(hashes, np.uint64))
        self.extend([doc], [check], pa.array(words, pa.binary()), [len(words)])

    def extend(self, docs, checks, words, counts) -> None:
        """Documents whose words (an Arrow array) follow each other, ``counts`` of them in each."""
        import numpy as np

        self.docs.append(np.asarray(docs, np.int64))
        self.checks.append(np.asarray(checks, np.int64))
        self.counts.append(np.asarray(counts, np.int64))
        self.words.append(words)
        self.bytes += words.nbytes

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, compressed super-k-mers); when they are read, the batch is empty again but for its marks."""
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        if not self.words:
            return
        words = pa.concat_arrays(self.words).dictionary_encode()
        known, ids = words.dictionary, words.indices.to_numpy()
        if self.hashes:
            hashes = np.concatenate(self.hashes)
        else:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known.to_pylist()), np.uint64, len(known))[ids]
        docs, checks, counts = np.concatenate(self.docs), np.concatenate(self.checks), np.concatenate(self.counts)
        self.clear()
        first, windows, least = super_kmers(hashes, counts, self.k, self.m)
        if not len(first):
            return
        lengths = windows + self.k - 1
        ends = np.cumsum(counts)
        row = np.searchsorted(ends, first, "right")
        doc, check, at = docs[row], checks[row], first - (ends - counts)[row]
        # Equal super-k-mers have equal sums of hashes; whether those with equal sums are equal, their words tell.
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
        sums = sums[first + lengths] - sums[first]
        del hashes
        order = np.argsort(sums)
        same = sums[order[1:]] == sums[order[:-1]]
        maybe = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
        head, held = np.arange(len(first)), {}
        for i, a, n in zip(maybe.tolist(), first[maybe].tolist(), lengths[maybe].tolist()):
            head[i] = held.setdefault(ids[a : a + n].tobytes(), i)
        del sums, order, same, held
        smallest = doc.copy()
        np.minimum.at(smallest, head[maybe], doc[maybe])
        lost = doc > smallest[head]
        # runs of lost super-k-mers within a document
        edge = np.concatenate(([True], row[1:] != row[:-1]))
        begin = np.flatnonzero(lost & (edge | ~np.concatenate(([False], lost[:-1]))))
        end = np.flatnonzero(lost & np.concatenate((edge[1:] | ~lost[1:], [True])))
        self.marks = doc[begin], check[begin], at[begin], at[end] + windows[end] - at[begin]
        # each bucket's entries, their places, and the words in them, numbered anew
        squeeze = zstandard.ZstdCompressor(level=3).compress
        bucket = (least % np.uint64(self.buckets)).astype(np.int64)
        heads, places = np.flatnonzero(head == np.arange(len(head))), np.flatnonzero(~lost)
        heads = heads[np.argsort(bucket[heads], kind="stable")]
        places = places[np.argsort(bucket[places], kind="stable")]
        used = np.unique(bucket[heads])
        heads = np.split(heads, np.searchsorted(bucket[heads], used[1:]))
        places = np.split(places, np.searchsorted(bucket[places], used[1:]))
        entry, number = np.empty(len(first), np.int64), np.empty(len(known), np.int32)
        for b, h, p in zip(used.tolist(), heads, places):
            entry[h] = np.arange(len(h))
            own = ids[flat(first[h], lengths[h])]
            count = np.arange(len(own), dtype=np.int32)
            number[own[::-1]] = count[::-1]  # where a word comes first: of equal places the last one written stays
            new = number[own] == count
            distinct = own[new]
            number[distinct] = count[: len(distinct)]
            text = known.take(pa.array(distinct))
            offsets = np.frombuffer(text.buffers()[1], "<i4", len(text) + 1, 4 * text.offset)
            numbers = zip((doc[p], check[p], at[p], entry[head[p]]), PLACE)
            yield b, squeeze(b"".join([
                HEAD.pack(len(h), len(p), len(distinct), len(own)),
                planes(windows[h], "<i4"),
                *[planes(steps(x), t) for x, t in numbers],
                planes(np.diff(offsets), "<i4"),
                np.packbits(new).tobytes(),
                planes(number[own[~new]], id_kind(len(distinct))),
                memoryview(text.buffers()[2])[offsets[0] : offsets[-1]],
            ]))


def id_kind(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def unpacked(blobs: list[bytes]):
    """(windows of each entry, its words' numbers, all entries' one after the other; the places' numbers as PLACE has them)."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    sizes, numbers, ids, known, entries, distinct = [], [], [], [], 0, 0
    for blob in blobs:
        raw = expand(blob)
        n, places, new, words = HEAD.unpack_from(raw)
        at, own = HEAD.size, []
        mask = (words + 7) // 8, "u1"
        for count, kind in ((n, "<i4"), *((places, t) for t in PLACE), (new, "<i4"), mask, (words - new, id_kind(new))):
            own.append(from_planes(raw, count, at, kind))
            at += own[-1].nbytes
        sizes.append(own[0].astype(np.int64))
        place = [np.cumsum(x, dtype=x.dtype).astype(np.int64) for x in own[1:5]]
        place[3] += entries
        numbers.append(place)
        offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(own[5], dtype=np.int32)))
        known.append(pa.BinaryArray.from_buffers(pa.binary(), new, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at:])]))
        first = np.unpackbits(own[6], count=words).astype(bool)
        ids.append(np.empty(words, np.int32))
        ids[-1][first], ids[-1][~first] = np.arange(new), own[7]
        ids[-1] += distinct
        entries += n
        distinct += new
    # equal words of different strings get one number
    same = pa.concat_arrays(known).dictionary_encode().indices.to_numpy()
    return np.concatenate(sizes), same[np.concatenate(ids)], [np.concatenate(x) for x in zip(*numbers)]


def judge(blobs: list[bytes], k: int = K):
    """The marks of one bucket: (doc, check, first window, windows) rows of windows that a smaller document also starts."""
    import numpy as np

    sizes, ids, (doc, check, first, entry) = unpacked(blobs)
    lengths = sizes + k - 1
    begins = np.cumsum(lengths) - lengths
    # every window's place, entry and document; one document for an entry
    owner = np.empty(len(sizes), np.int64)
    owner[entry] = doc
    which = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = flat(begins, sizes)
    spread = mixed(np.arange(1, ids.max() + 2, dtype=np.uint64))[ids]
    code = spread[: len(ids) - k + 1].copy()
    for j in range(1, k):
        code *= np.uint64(0xD6E8FEB86659FD93)
        code += spread[j : len(ids) - k + 1 + j]
    code = code[place]
    del spread
    # equal windows have equal codes, so each share of the codes is judged by itself
    repeated = np.zeros(len(place), bool)
    shares = 1 + len(place) // SORTED
    for share in range(shares):
        order = np.flatnonzero(code % np.uint64(shares) == share) if shares > 1 else np.arange(len(place))
        if not len(order):
            continue
        order = order[np.argsort(code[order])]
        new = np.concatenate(([True], code[order[1:]] != code[order[:-1]]))
        # equal codes are verified word by word; the rare stranger gets a group of its own by exact sorting
        later = np.flatnonzero(~new)
        strange = np.zeros(len(later), bool)
        for j in range(k):
            strange |= ids[place[order[later]] + j] != ids[place[order[later - 1]] + j]
        if strange.any():
            whole = np.stack([ids[place[order] + j] for j in range(k)], axis=1)
            _, group = np.unique(whole, axis=0, return_inverse=True)
            by = np.argsort(group.reshape(-1), kind="stable")
            order, new = order[by], np.concatenate(([True], np.diff(group.reshape(-1)[by]) != 0))
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(owner[which[order]], heads)
        least = np.repeat(least, np.diff(np.append(heads, len(order))))
        repeated[order] = least < owner[which[order]]
    # runs of repeated windows within an entry
    edge = np.concatenate(([True], which[1:] != which[:-1]))
    begin = np.flatnonzero(repeated & (edge | ~np.concatenate(([False], repeated[:-1]))))
    end = np.flatnonzero(repeated & np.concatenate((edge[1:] | ~repeated[1:], [True]))) + 1
    run_entry, run_first, run_n = which[begin], place[begin] - begins[which[begin]], end - begin
    # an entry's runs hold for each of its places
    by = np.argsort(entry, kind="stable")
    left, right = np.searchsorted(entry[by], run_entry, "left"), np.searchsorted(entry[by], run_entry, "right")
    times = right - left
    p = by[np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    return doc[p], check[p], first[p] + np.repeat(run_first, times), np.repeat(run_n, times)


def repeated_windows(docs: DataFrame, k: int = K, m: int = M, buckets: int | None = None) -> DataFrame:
    """(id, check, first, n): runs of windows in each document that also start in a document with a smaller id.

    ``docs``: id (long, not null), check (long, tells rows apart that repeat an id), text (binary, UTF-8).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # no more than partitions, since the more strings a batch is cut into, the worse they compress
    buckets = buckets or shuffle_partitions(spark)

    def reduce_(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["bucket", "id", "check", "first", "n", "blob"]

        def rows(bucket, marks, blobs):
            n = len(bucket)
            return pa.record_batch([pa.array(bucket, pa.int32()), *(pa.array(c, pa.int64()) for c in marks or [pa.nulls(n)] * 4), pa.array(blobs or [None] * n, pa.binary())], names=names)

        def flush():
            held, size = [], 0
            for b, blob in batch.packed():
                held.append((b, blob))
                size += len(blob)
                if size > 4 << 20:
                    yield rows([x[0] for x in held], None, [x[1] for x in held])
                    held, size = [], 0
            if held:
                yield rows([x[0] for x in held], None, [x[1] for x in held])
            for i in range(0, len(batch.marks[0]) if batch.marks else 0, 5000):
                part = [x[i : i + 5000] for x in batch.marks]
                yield rows(part[0] % buckets, part, None)
            batch.clear()

        batch = Batch(buckets, k, m)
        for b in batches:
            # cut where the texts so far fill a batch
            full = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH
            cuts = [0, *(np.flatnonzero(full[1:] != full[:-1]) + 1).tolist(), b.num_rows]
            for part in (b.slice(x, y - x) for x, y in zip(cuts, cuts[1:])):
                split = pc.ascii_split_whitespace(part.column(2).view(pa.string()))
                words, counts = split.flatten().view(pa.binary()), pc.list_value_length(split).to_numpy(zero_copy_only=False)
                full = pc.binary_length(words).to_numpy() > 0
                if not full.all():  # white space at a text's ends leaves empty words
                    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
                    words = words.filter(pa.array(full))
                batch.extend(part.column(0), part.column(1), words, counts)
                if batch.bytes > BATCH:
                    yield from flush()
        yield from flush()

    def judge_(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["id", "check", "first", "n"]

        def verdict(blobs):
            found = judge(blobs, k)
            for i in range(0, len(found[0]), 10_000):
                yield pa.record_batch([pa.array(c[i : i + 10_000]) for c in found], names=names)

        now, blobs = None, []
        for b in batches:
            import pyarrow.compute as pc

            marks = b.filter(pc.is_null(b.column("blob")))
            if marks.num_rows:
                yield pa.record_batch([marks.column(c) for c in names], names=names)
            sent = b.filter(pc.is_valid(b.column("blob")))
            for bucket, blob in zip(sent.column("bucket").to_pylist(), sent.column("blob").to_pylist()):
                if bucket != now and blobs:
                    yield from verdict(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from verdict(blobs)

    sent = docs.select("id", "check", "text").mapInArrow(reduce_, "bucket int, id long, check long, first long, n long, blob binary")
    # by number, not by hash, which would give some tasks several buckets and others none
    parts = shuffle_partitions(spark)
    dealt = sent.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    return dealt.mapInArrow(judge_, "id long, check long, first long, n long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; kept (binary, UTF-8) are the words left, joined by single spaces.

    A word goes when a window over it also starts in a row with a smaller id; windows are judged on the input. Null text
    has no words. A null id counts as larger than any other. Rows that repeat an id never remove each other's words.
    """
    text = F.encode(text_or_empty(text_col), "utf-8")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_or_empty(text_col)).bitwiseAND(0x7FFFFFFF).alias("check"), text.alias("text"), F.col(id_col).isNull().alias("null_id"))
    marks = repeated_windows(rows, k, m)
    # a document's own marks, of which there are no more than it has windows
    marks = marks.groupBy("id", "check").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    joined = rows.join(marks, ["id", "check"], "left").select("id", "text", "null_id", F.col("runs.first").alias("firsts"), F.col("runs.n").alias("ns"))

    def remove(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["id", "n_words", "n_removed", "kept"]
        for b in batches:
            ids, out = [], []
            for doc, text, null_id, firsts, ns in zip(*(c.to_pylist() for c in b.columns)):
                words = text.split()
                n, gone = len(words), 0
                if firsts:
                    change = np.zeros(n + 1, np.int64)
                    first, last = np.array(firsts, np.int64), np.array(firsts, np.int64) + np.array(ns, np.int64) + k - 1
                    np.add.at(change, first, 1)
                    np.add.at(change, last, -1)
                    stay = np.cumsum(change[:n]) == 0
                    gone = n - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                ids.append(None if null_id else doc)
                out.append((n, gone, b" ".join(words)))
            cols = zip(*out) if out else ([], [], [])
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary())))], names=names)

    return joined.mapInArrow(remove, "id long, n_words long, n_removed long, kept binary")


def op10_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r
), p AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d
), k AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i
  WHERE gone.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
