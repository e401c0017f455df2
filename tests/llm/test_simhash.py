import random

import numpy as np
import pyarrow.parquet as pq
import xxhash

from inkprobe.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=4):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for t in ["", " \n", "One", "one Two three", "A b c D", "a b c d e É É", "x y z", "word " * 999 + "end\x0bof it", "AÉÀ ß"]:
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def test_gray_order():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def near_fingerprints(rng, n):
    out = [rng.getrandbits(64) for _ in range(n // 3 + 1)]
    while len(out) < n:
        f = rng.choice(out)
        for _ in range(rng.randint(0, 6)):
            f ^= 1 << rng.randrange(64)
        out.append(f)
    return sorted(set(out))


def test_index_links_all_within_the_radius(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 64)
    rng = random.Random(3)
    for n in (1, 2, 9, 200, 700):
        fps = near_fingerprints(rng, n)
        a, b = simhash.links_of(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
        at = {f: i for i, f in enumerate(fps)}
        label = list(range(len(fps)))
        for x, y in zip(a.tolist(), b.tolist()):
            old, new = label[at[x]], label[at[y]]
            label = [min(old, new) if v in (old, new) else v for v in label]
        assert label == slow_components(fps)


def test_links_across_blocks_and_chunks(spark):
    rng = random.Random(5)
    fps = near_fingerprints(rng, 900)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    from inkprobe.llm.common import connected_components

    want = slow_components(fps)
    for most in (20_000, 3):
        roots = {r.node: r.root for r in connected_components(simhash.near_links(distinct, most=most)).collect()}
        groups = {}
        for f, w in zip(signed, want):
            groups.setdefault(w, set()).add(roots.get(f, f))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    ids, fps = zip(*sorted((i, slow_fingerprint(x or "")) for i, x in zip(t["doc_id"], t["text"])))
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, slow_components(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_odd_tables(spark):
    rows = [(4, None), (2, ""), (9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (7, "q " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 id", "3 component_id")
    got = sorted((r.id or -1, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == [(-1, 9), (2, 2), (4, 2), (7, 7), (9, 9), (9, 9)]
    assert simhash.near_groups(docs.limit(0)).collect() == []
    assert sorted(r.doc_id or -1 for r in simhash.keep_first(docs).collect()) == [-1, 2, 7, 9, 9]
