"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints. A text's 64-bit fingerprint has a bit set where more than half of its 4-word shingles' XXH64 have it.

Index. Distinct fingerprints link at ``RADIUS`` differing bits or fewer. Any such pair agrees on one of RADIUS + 1
blocks of bits, so every fingerprint goes to one index per block, keyed by the block's value; an index's root is that
shared masked pattern. Below it fingerprints lie in order of their Gray rank, so that neighbours differ in few bits, and
every ``FAN_OUT`` nodes in a row get a parent that factors out the bits they share (a mask and a pattern). The index is
searched against itself from the roots down: for two nodes, the bits shared by both and set differently are a lower
bound of the differences of all pairs below, so a pair of nodes above the radius is pruned with its whole groups; so is
one whose members are already known to be in one component, which keeps a group of many thousands of near copies from
being compared pair by pair. All node pairs of a level are handled together in numpy, a bounded number at a time.

Large indexes. A key with more than ``MOST`` fingerprints is dealt into chunks by hash, and every pair of chunks is an
index of its own, so one block value that a third of all fingerprints share is spread over many tasks and no pair is
left out.

Groups. Each task yields, for its fingerprints, the links of a spanning forest of what it found; connected components
over those links run as joins in shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, shuffle_partitions, stored, table, text_or_empty, whole_row

SHINGLE = 4
RADIUS = 4
FAN_OUT = 8
MOST = 20_000
#: Node pairs that a task expands at a time.
PAIRS = 1 << 14
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8; without words, zero."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    hashed = xxhash.xxh64_digest
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    digests = np.frombuffer(b"".join([hashed(joined[a:b], SEED) for a, b in spans]), dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), 1 << 14):
        counts += np.unpackbits(digests[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp as a signed long. Null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text")).mapInArrow(run, "id long, fp long")


def gray_rank(fp):
    """The place of each code word in the binary reflected Gray code: the prefix parity of its bits."""
    import numpy as np

    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _expand(a, b, first, last, same):
    """All child pairs of node pairs (a, b); of a pair with itself each unordered pair once."""
    import numpy as np

    na, nb = last[a] - first[a], last[b] - first[b]
    n = na * nb
    row = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    x, y = first[a][row] + k // nb[row], first[b][row] + k % nb[row]
    keep = ~same[row] | (x <= y)
    return x[keep], y[keep]


class GrayIndex:
    """The hierarchy over fingerprints that share a key, for all keys of one task together."""

    def __init__(self, keys, fps):
        import numpy as np

        order = np.lexsort((gray_rank(fps), keys))
        self.keys, self.fps = keys[order], fps[order]
        n = len(fps)
        # level 0 are the fingerprints themselves: all bits shared
        self.levels = [{"mask": np.full(n, ~np.uint64(0)), "bits": self.fps, "key": self.keys, "lo": np.arange(n), "hi": np.arange(1, n + 1)}]
        while True:
            below = self.levels[-1]
            key = below["key"]
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.array([], bool)
            starts = np.flatnonzero(new)
            if len(starts) == len(key):
                break
            place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
            first = np.flatnonzero(place % FAN_OUT == 0)
            last = np.append(first[1:], len(key))
            ones = np.bitwise_and.reduceat(below["bits"] & below["mask"], first)
            zeros = np.bitwise_and.reduceat(~below["bits"] & below["mask"], first)
            self.levels.append({"mask": ones | zeros, "bits": ones, "key": key[first], "first": first, "last": last, "lo": below["lo"][first], "hi": below["hi"][last - 1]})

    def components(self, radius: int):
        """For each fingerprint (in the index's order) the smallest position it is linked with, through any others."""
        import numpy as np

        label = np.arange(len(self.fps))
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["key"]))
        stack = [(top, roots[i : i + PAIRS], roots[i : i + PAIRS]) for i in range(0, len(roots), PAIRS)]
        version, spans = 0, {}
        while stack:
            level, a, b = stack.pop()
            node = self.levels[level]
            if level == 0:
                near = np.bitwise_count(node["bits"][a] ^ node["bits"][b]) <= radius
                near &= a != b
                a, b = a[near], b[near]
                if len(a):
                    before = label.copy()
                    self._union(label, a, b)
                    version += not np.array_equal(before, label)
                continue
            # whole groups that are one component already need no further look
            if (level, version) not in spans:
                spans[level, version] = (np.minimum.reduceat(label, node["lo"]), np.maximum.reduceat(label, node["lo"]))
                for old in [k for k in spans if k[1] != version]:
                    del spans[old]
            low, high = spans[level, version]
            open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[open_], b[open_]
            below = self.levels[level - 1]
            x, y = _expand(a, b, node["first"], node["last"], a == b)
            bound = np.bitwise_count(below["mask"][x] & below["mask"][y] & (below["bits"][x] ^ below["bits"][y]))
            near = bound <= radius
            x, y = x[near], y[near]
            # of what is expanded, neighbours come first: they make the components that prune the rest
            for i in range((len(x) - 1) // PAIRS * PAIRS if len(x) else -1, -1, -PAIRS):
                stack.append((level - 1, x[i : i + PAIRS], y[i : i + PAIRS]))
        return label

    @staticmethod
    def _union(label, a, b) -> None:
        import numpy as np

        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def links_of(keys, fps, radius: int = RADIUS):
    """(fp, root) links that join all fingerprints within the radius under equal keys, directly or through others."""
    index = GrayIndex(keys, fps)
    label = index.components(radius)
    import numpy as np

    linked = label != np.arange(len(label))
    return index.fps[linked], index.fps[label[linked]]


def near_links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) that connect whatever lies within the radius."""
    spark = distinct.sparkSession
    blocks = radius + 1
    cut = [64 * k // blocks for k in range(blocks + 1)]
    value = [F.shiftrightunsigned("fp", 64 - cut[k + 1]).bitwiseAND((1 << (cut[k + 1] - cut[k])) - 1) for k in range(blocks)]
    keyed = distinct.select("fp", F.posexplode(F.array(*value)).alias("block", "value"))
    keyed = keyed.select("fp", (F.col("block").cast("long") * (1 << 16) + F.col("value")).alias("key"))
    # keys above the limit: their number of chunks, and each fingerprint's row in every pair of chunks it belongs to
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") * 2 / most).cast("int").alias("chunks"))
    dealt = keyed.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("other", other)
    cell = F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")
    dealt = dealt.select("fp", F.col("key"), cell.cast("long").alias("cell"))
    dealt = dealt.repartition(shuffle_partitions(spark), "key", "cell")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        # a task holds its rows of 24 bytes; keys are handled together, each below its own root
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        fp, key, cell = (np.concatenate(x) for x in zip(*got))
        a, b = links_of(key << 40 | cell, fp.view(np.uint64))
        for i in range(0, len(a), 10_000):
            yield pa.record_batch([pa.array(a[i : i + 10_000].view(np.int64)), pa.array(b[i : i + 10_000].view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long), component_id, the smallest id reachable by links, itself included.

    Null, empty and wordless texts have fingerprint zero and link like any other. Null ids take part and never are a
    component's id unless all of its ids are null. Rows that repeat an id stay as they are.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    own = stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_links(own.select("fp"), radius))
    placed = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: bool = False, **options) -> DataFrame:
    """Of each group the document with the smallest id, with all its columns.

    Groups are those of ``near_groups``; with ``alike``, of ``near_copies.near_groups``: the index's links verified on 5-word
    shingles, completed to all pairs 4/5 alike. An id names a document: rows that repeat one stay or go together, and stay if
    any of them is the first of its group. Rows without an id stay as they are. An empty table gives an empty one.
    """
    from . import near_copies

    groups = (near_copies.near_groups if alike else near_groups)(docs, id_col, text_col, **options)
    kept = groups.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("__id")).distinct()
    rows = docs.select(whole_row(docs).alias("__row"), F.col(id_col).cast("long").alias("__doc"))
    return rows.join(kept, F.col("__doc") == F.col("__id"), "left_semi").unionByName(rows.where(F.col("__doc").isNull())).select("__row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
