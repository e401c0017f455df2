"""Near copies by SimHash, completed to all that share 4/5 of their word shingles.

Rule. Two texts are near copies where the Jaccard similarity of their sets of 5-word shingles is 4/5 or more; groups are
what such pairs connect. Every pair that reaches the rule is found, and every link is verified on the whole sets.

Candidates. Fingerprints of the shingle sets go through the Gray-order index of ``simhash``, which links what differs in few
bits. Texts 4/5 alike differ in some 10 bits of 64, and up to 13; no index by blocks of bits serves that radius, so the
rest comes from the sets themselves: in any one order of all shingles, a set of n shingles and a set 4/5 alike share one
of the first n - ceil(4n/5) + 1 of each (prefix filter). Each text is listed under those only. The order is by hash, with
shingles that are common in a sample of the texts last, so that few texts meet under a line that many texts hold; the
sample decides how many candidates there are and never which pairs are found. Sizes and places in the order leave out pairs
under a shingle that can't reach the rule there.

Links. First the index's links and, under its first ``FIRST_KEYS`` shingles, each text and the ``NEIGHBOURS`` before it,
in an order that differs by shingle, are compared, which connects large groups by few comparisons. Then all remaining pairs under a shingle whose texts are not yet in one
component are compared. A sketch bounds what two sets share: bit k of it is the parity of the number of shingles whose hash
is k modulo ``BITS``, so two sets differ in no fewer shingles than their sketches in bits. Pairs that the bound leaves are
compared by the shared shingles of their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, shuffles_deleted, stored, text_or_empty, union_all
from .simhash import near_links

SHINGLE = 5
SEED = 42
#: One text in so many is looked at for common shingles; what so many of those hold is common, the most common first.
SAMPLE, COMMON, MOST_COMMON = 16, 4, 100_000
#: Bits of a sketch, and the longs that hold them.
BITS = 1024
LONGS = BITS // 64
#: Differing bits of fingerprints up to which the index proposes a link.
RADIUS = 4
#: What a text is compared with first: under so many of its shingles, so many neighbours.
FIRST_KEYS, NEIGHBOURS = 6, 2
#: Bits of a shingle's hash that a row under it carries; shingles that agree in them only add candidates.
KEY_BITS = 40


def shingle_set(text: bytes):
    """The sorted hashes (signed) of a text's shingles; a text of fewer words is one shingle."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    joined = b" ".join(words)
    hashed = xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        digests = hashed(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        digests = b"".join([hashed(joined[a:b], SEED) for a, b in zip(begins[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())])
    return np.unique(np.frombuffer(digests, dtype=">i8").astype(np.int64))


def node_of(shingles) -> int:
    """What stands for a set: equal sets are one node."""
    import numpy as np
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def prefix(shingles, common):
    """The shingles a set is listed under, in the order of all shingles; ``common`` is sorted."""
    import numpy as np

    n = len(shingles)
    last = np.zeros(n, bool)
    if len(common):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    return np.concatenate((shingles[~last], shingles[last]))[: n - (4 * n + 4) // 5 + 1]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))


def _kept(df: DataFrame) -> DataFrame:
    """As stored(); what was shuffled on the way is deleted once the rows are written."""
    with shuffles_deleted(df.sparkSession):
        return stored(df)


def _few(df: DataFrame) -> DataFrame:
    """As _kept(), for the little that joins leave: files by its size, not one for each of the joins' tasks."""
    return _kept(df.hint("rebalance"))


def common_shingles(texts: DataFrame):
    """Sorted hashes of shingles that are common in a sample of the texts."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for t in b.column(1).to_pylist():
                yield pa.record_batch([pa.array(shingle_set(t))], names=["h"])

    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], dtype=np.int64))


def fingerprint_of(shingles) -> int:
    """The SimHash fingerprint of a set, as a signed long: a bit is set where more than half of the hashes have it."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        counts += np.unpackbits(shingles[at : at + (1 << 14)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big", signed=True)


def sketch_of(shingles):
    """A set's sketch as ``LONGS`` longs."""
    import numpy as np

    odd = np.bincount(shingles & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view("<i8")


def listed(texts: DataFrame, common) -> DataFrame:
    """(id, node, size, fp, sketch, keys) of every row: its set, the set's size, fingerprint and sketch, and the shingles it is
    listed under."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            keys = pa.array([prefix(s, common) & ((1 << KEY_BITS) - 1) for s in sets], pa.list_(pa.int64()))
            sketches = pa.array([sketch_of(s) for s in sets], pa.list_(pa.int64()))
            numbers = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array([fingerprint_of(s) for s in sets], pa.int64())]
            yield pa.record_batch([b.column(0), *numbers, sketches, keys], names=["id", "node", "size", "fp", "sketch", "keys"])

    return texts.mapInArrow(run, "id long, node long, size int, fp long, sketch array<long>, keys array<long>")


def _may_reach(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two sets that first meet at these places of their orders can share enough shingles."""
    most = F.least(a["size"] - a["pos"], b["size"] - b["pos"])
    return (a["node"] != b["node"]) & (9 * most.cast("long") >= 4 * (a["size"] + b["size"]).cast("long"))


def _may_be_alike(s: Column, t: Column, sizes: Column) -> Column:
    """Whether sets of these sketches, ``sizes`` shingles together, can be 4/5 alike: then they differ in 1/9 of them at most."""
    differ = sum((F.bit_count(F.get(s, F.lit(k)).bitwiseXOR(F.get(t, F.lit(k)))) for k in range(1, LONGS)), F.bit_count(F.get(s, F.lit(0)).bitwiseXOR(F.get(t, F.lit(0)))))
    return 9 * differ.cast("long") <= sizes.cast("long")


def links(docs: DataFrame, rows: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those (a, b) of ``pairs`` of nodes (stored, distinct) whose sets are 4/5 alike; not stored, as connected_components() stores them."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = rows.select("id", "node").join(nodes, "node", "left_semi").select(F.col("id").alias("__id")).distinct()
    named = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    read = named.join(ids, F.col("__doc").cast("long") == ids["__id"], "left_semi").unionByName(named.where(F.col("__doc").isNull()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([pa.array([node_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    sets = _kept(_texts(read, "__doc", "__text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    return both.where(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b")


def _bounded(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` of nodes whose sketches allow 4/5, each once; stored."""
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c, s, n: own.select(F.col("node").alias(c), F.col("sketch").alias(s), F.col("size").alias(n))
    both = pairs.join(side("a", "s", "m"), "a").join(side("b", "t", "n"), "b")
    return _few(both.where(_may_be_alike(F.col("s"), F.col("t"), F.col("m") + F.col("n"))).select("a", "b"))


def _by_fingerprint(own: DataFrame) -> DataFrame:
    """(a, b) of nodes that the Gray-order index links: of one fingerprint, or of near ones."""
    first = _kept(own.groupBy("fp").agg(F.min("node").alias("first")))
    same = own.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c))
    near = near_links(first.select("fp"), RADIUS).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    return same.unionByName(near.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, node, component_id, the smallest id that links reach, itself included.

    Null, empty and wordless texts are alike. Null ids take part and never are a component's id unless all of its ids are
    null. Rows that repeat an id stay as they are.
    """
    texts = _texts(docs, id_col, text_col)
    rows = _kept(listed(texts, common_shingles(texts)))
    own = _kept(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    keyed = rows.select("node", "size", F.posexplode("keys").alias("pos", "h"))
    # dealt before the order is made, so that its hashes aren't moved
    order = Window.partitionBy("h").orderBy(F.xxhash64("node", "h"), "node")
    one = {c: F.col(c) for c in ("node", "size", "pos")}
    met = keyed.repartition("h").withColumns({f"back{k}": F.lag(F.struct("node", "size", "pos"), k).over(order) for k in range(1, NEIGHBOURS + 1)} | {"next": F.lead("node").over(order)})
    met = met.where(F.col("back1").isNotNull() | F.col("next").isNotNull())
    back = lambda k: F.when((F.col("pos") < FIRST_KEYS) & _may_reach(one, {c: F.col(f"back{k}.{c}") for c in one}), F.col(f"back{k}.node"))
    met = _kept(met.select("h", *one, F.array_compact(F.array(*[back(k) for k in range(1, NEIGHBOURS + 1)])).alias("back")))
    pairs = [met.where(F.col("pos") < FIRST_KEYS).select(F.col("node").alias("a"), F.explode("back").alias("b"))]
    pairs = _bounded(union_all([_by_fingerprint(own), *pairs]), own)
    roots = connected_components(links(docs, rows, pairs, id_col, text_col), _kept)

    placed = met.select("h", *one).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("q")).where("r != q").select("h")
    left = _kept(placed.join(mixed, "h", "left_semi").join(own.select("node", "sketch"), "node"))
    x, y = left.alias("x"), left.alias("y")
    side = lambda k: {c: F.col(f"{k}.{c}") for c in one}
    apart = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    alike = _may_be_alike(F.col("x.sketch"), F.col("y.sketch"), F.col("x.size") + F.col("y.size"))
    rest = x.join(y, apart & _may_reach(side("x"), side("y")) & alike)
    rest = _kept(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    more = links(docs, rows, rest, id_col, text_col)
    roots = connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), _kept)

    own = own.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    own = _few(own)
    named = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return rows.select("id", "node").join(named, "node").select("id", "node", "component_id")
