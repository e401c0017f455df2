"""Token ids in files of bit planes.

A segment is one binary value that holds whole documents and can be read by itself:

    magic "IPB1"; then as little-endian unsigned 32-bit: documents, ids per chunk, chunks, planes; ids as unsigned 64-bit
    per document: ids as unsigned 32-bit
    chunk index, per chunk: ids, crc32 of the ids as unsigned 32-bit integers, and per plane its bytes
    the planes of each chunk in order

A chunk's ids are transposed: plane k holds bit k of every id, eight ids a byte, and each plane is compressed with
zstandard by itself. ``planes`` is the number of bits in the segment's largest id. With ``unit="byte"``, the
default because it packs ids of words tighter and four times as fast, a plane holds byte k of every id instead.

Documents are dealt to ranges of ids, whose number grows with the table; a range is sorted by id and written as
consecutive segments, with the count of the ids before it in the range. Segments are rows of a table in shared storage, so writing survives lost executors and
needs no file system but Spark's.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, delete_at_exit, shared_dir, shuffle_partitions, table, text_or_empty
from .tokens import default_vocabulary, encoder

CHUNK = 1 << 16
SEGMENT = 1 << 19
#: Bytes of a table, as stored, for which there is one range of ids.
RANGE_BYTES = 128 << 20
#: What Spark says of tables whose size it doesn't know is this or more.
UNKNOWN_SIZE = 1 << 60
END_ID = 2
MAGIC = b"IPB1"
HEAD = struct.Struct("<4sIIIIQ")


def to_planes(ids, planes: int, unit: str) -> list[bytes]:
    """The planes of one chunk, not compressed."""
    import numpy as np

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [raw[:, k].tobytes() for k in range(planes)]
    width = (planes + 7) // 8
    bits = np.unpackbits(raw[:, :width], axis=1, bitorder="little")[:, :planes]
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1)]


def from_planes(parts: list[bytes], n: int, unit: str):
    import numpy as np

    raw = np.zeros((n, 4), dtype=np.uint8)
    if unit == "byte":
        for k, p in enumerate(parts):
            raw[:, k] = np.frombuffer(p, dtype=np.uint8)
    elif parts and n:
        bits = np.unpackbits(np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(len(parts), -1), axis=1, count=n)
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        raw[:, : packed.shape[1]] = packed
    return raw.view("<u4").reshape(-1)


def pack(documents: list[bytes], chunk: int = CHUNK, unit: str = "byte", level: int = 3) -> bytes:
    """One segment of documents, each given as its ids in little-endian unsigned 32-bit integers."""
    import numpy as np
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
    ids = np.frombuffer(b"".join(documents), dtype="<u4")
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, (top.bit_length() + 7) // 8 if unit == "byte" else top.bit_length())
    index, body = [], []
    for at in range(0, len(ids), chunk):
        own = ids[at : at + chunk]
        parts = [squeeze(p) for p in to_planes(own, planes, unit)]
        index.append(struct.pack(f"<II{planes}I", len(own), zlib.crc32(own.tobytes()), *map(len, parts)))
        body += parts
    head = HEAD.pack(MAGIC, len(documents), chunk, len(index), planes | (unit == "byte") << 31, len(ids))
    return b"".join([head, np.array([len(d) // 4 for d in documents], dtype="<u4").tobytes(), *index, *body])


def unpack(segment: bytes) -> list[bytes]:
    """The documents of a segment; a chunk that doesn't match its checksum is an error."""
    import zstandard

    magic, n_docs, _, n_chunks, planes, n_ids = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment")
    unit, planes = ("byte" if planes >> 31 else "bit"), planes & 0x7FFFFFFF
    expand = zstandard.ZstdDecompressor().decompress
    lengths = struct.unpack_from(f"<{n_docs}I", segment, at := HEAD.size)
    row = struct.Struct(f"<II{planes}I")
    at += 4 * n_docs
    body, out = at + n_chunks * row.size, []
    for k in range(n_chunks):
        n, crc, *sizes = row.unpack_from(segment, at + k * row.size)
        parts = []
        for s in sizes:
            parts.append(expand(segment[body : body + s]))
            body += s
        ids = from_planes(parts, n, unit).tobytes()
        if zlib.crc32(ids) != crc:
            raise ValueError(f"chunk {k} is damaged")
        out.append(ids)
    ids, documents, at = b"".join(out), [], 0
    if len(ids) != 4 * n_ids:
        raise ValueError("ids are missing")
    for n in lengths:
        documents.append(ids[at : at + 4 * n])
        at += 4 * n
    return documents


class Ranges:
    """How ids are dealt to numbered ranges, in order of id, null ids last.

    ``begins``: ascending ids, ``parts``: into how many ranges each id interval goes, the first being that below all
    ``begins`` and the last that of null ids. An interval of more than one range is one id's, and its rows are dealt by the
    crc32 of their ids, so rows that repeat an id are not all one task's.
    """

    def __init__(self, begins: list[int], parts: list[int]):
        self.begins, self.parts = begins, parts

    def __len__(self) -> int:
        return sum(self.parts)

    def numbers(self, ids, rows: list[bytes]):
        """Each row's range, of an Arrow array of ids and the rows' own ids."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts = np.array(self.parts, np.int64)
        place = np.searchsorted(np.array(self.begins, np.int64), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "right")
        place[ids.is_null().to_numpy(zero_copy_only=False)] = len(parts) - 1
        first = np.cumsum(parts) - parts
        share = np.zeros(len(place), np.int64)
        for i in np.flatnonzero(parts[place] > 1).tolist():
            share[i] = zlib.crc32(rows[i])
        return pa.array(first[place] + share % parts[place], pa.int32())


def encode_documents(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, ranges: Ranges) -> DataFrame:
    """(id, ids, range_no): each whole text's ids and the end id."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [x + end for x in encode(part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), ranges.numbers(part.column(0), ids)], names=["id", "ids", "range_no"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text")).mapInArrow(run, "id long, ids binary, range_no int")


def write_planes(encoded: DataFrame, path: str, ranges: int, unit: str = "byte", chunk: int = CHUNK, segment: int = SEGMENT) -> None:
    """Write (id, ids, range_no) rows, range by range in ascending order of id, null ids last, as segments below ``path``.
    A segment ends with the document that fills it."""
    dealt = encoded.repartitionById(max(1, ranges), "range_no").sortWithinPartitions("range_no", F.col("id").asc_nulls_last(), "ids")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["range_no", "seq", "first", "n_ids", "doc_ids", "payload"]
        now, seq, first, ids, data, size = None, 0, 0, [], [], 0

        def flush():
            nonlocal seq, first, ids, data, size
            n = size // 4
            row = [pa.array([now], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(data, chunk, unit)], pa.binary())]
            seq, first, ids, data, size = seq + 1, first + n, [], [], 0
            return pa.record_batch(row, names=names)

        for b in batches:
            for doc, raw, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if r != now:
                    if ids:
                        yield flush()
                    now, seq, first = r, 0, 0
                ids.append(doc)
                data.append(raw)
                size += len(raw)
                if size >= 4 * segment:
                    yield flush()
        if ids:
            yield flush()

    dealt.mapInArrow(run, "range_no int, seq long, first long, n_ids long, doc_ids array<long>, payload binary").write.parquet(path)


def read_planes(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids) of every document below ``path``; start counts the ids of all documents before it.

    With ``digest``, ids_crc32 stands in the place of ids: their unsigned crc32.
    """
    bounded_batches(spark)
    segments = spark.read.parquet(path)
    # one row per range, of which there is one for some 128 MB of the table
    totals = segments.groupBy("range_no").agg(F.sum("n_ids").alias("n")).collect()
    base, at = [], 0
    for r in sorted(totals, key=lambda r: r["range_no"]):
        base.append((r["range_no"], at))
        at += r["n"]
    base = spark.createDataFrame(base, "range_no int, base long")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                documents = unpack(b.column(2)[k].as_buffer())
                n = [len(d) // 4 for d in documents]
                starts, start = [], b.column(1)[k].as_py()
                for x in n:
                    starts.append(start)
                    start += x
                last = pa.array([zlib.crc32(d) for d in documents], pa.int64()) if digest else pa.array(documents, pa.binary())
                yield pa.record_batch([b.column(0)[k].values, pa.array(starts, pa.int64()), pa.array(n, pa.int64()), last], names=["id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    placed = segments.join(F.broadcast(base), "range_no").select("doc_ids", (F.col("first") + F.col("base")).alias("start"), "payload")
    return placed.mapInArrow(run, "id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def id_ranges(docs: DataFrame, id_col: str, least: int, range_bytes: int = RANGE_BYTES) -> Ranges:
    """Ranges of about equal numbers of rows: ``least`` or, of a larger table, one for ``range_bytes`` of it as stored."""
    row = docs.select(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"), F.count("id").alias("known")).first()
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    want = min(max(least, size // range_bytes if size < UNKNOWN_SIZE else 0), row["n"])
    if want < 2:
        return Ranges([], [1, 1])
    nulls = max(1, want * (row["n"] - row["known"]) // row["n"])
    at = F.percentile_approx(F.col(id_col).cast("long"), [k / want for k in range(1, want)], max(10_000, 2 * want))
    cuts = docs.select(at.alias("c")).first()["c"] or []
    # an id that is more than one quantile is a range by itself, and dealt to as many as it is quantiles
    times = Counter(cuts)
    parts = dict.fromkeys(times, 1)
    for c, n in times.items():
        if n > 1:
            parts[c] = n
            parts.setdefault(c + 1, 1)
    begins = sorted(c for c in parts if c < 1 << 63)
    return Ranges(begins, [1, *[parts[c] for c in begins], nulls])


def token_archive(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, unit: str = "byte", ranges: int | None = None) -> None:
    """Encode every whole text and write the ids in ascending order of id.

    Null text is empty: its document is the end id alone. Rows that repeat an id are written one after the other, in
    order of their ids' crc32 or bytes; null ids come last. An empty table makes an archive without segments.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    dealt = id_ranges(docs, id_col, ranges or shuffle_partitions(spark))
    write_planes(encode_documents(docs, id_col, text_col, vocabulary or default_vocabulary(), end_id, dealt), path, len(dealt), unit)


def op1_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    delete_at_exit(spark, path)
    token_archive(table(spark, sf_dir, "documents"), path)
    return read_planes(spark, path, digest=True).withColumnRenamed("id", "doc_id")
