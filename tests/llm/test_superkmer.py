import random
import sys

import numpy as np
import pyarrow.parquet as pq

from inkprobe.llm import superkmer


def slow(rows, k=13):
    """rows: (id, text); for each the words left."""
    order = lambda i: superkmer.NO_ID if i is None else i
    split = [(order(i), (t or "").split()) for i, t in rows]
    least = {}
    for i, w in split:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < i:
                gone |= set(range(a, a + k))
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as kept").repartition(parts)
    got = sorted(((r.id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in superkmer.without_repeats(docs).collect()), key=str)
    want = sorted(((i, *x) for (i, _), x in zip(rows, slow(rows))), key=str)
    assert got == want


def test_random_passages(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "BATCH", 3000)
    rng = random.Random(11)
    vocab = ["the", "of", "a"] + [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(12, 70))) for _ in range(8)]
    rows = []
    for i in rng.sample(range(1000), 120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    check(spark, rows)


def test_odd_rows(spark):
    p = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(5, p), (5, p), (3, None), (4, ""), (None, p + " more"), (None, p), (7, "x\n" + p.replace(" ", "\t") + "  y"), (9, "same " * 3000), (8, "same " * 20), (10, p[4:])]
    check(spark, rows)
    check(spark, [(1, None)])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert superkmer.without_repeats(docs).collect() == []


def test_colliding_codes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(superkmer, "mixed", lambda x: np.zeros_like(x))  # every window has the same code
    batch = superkmer.Batch(1, 13, 2)
    texts = [" ".join(f"w{i + j}" for j in range(15)) for i in (0, 1, 50)]
    for doc, t in enumerate(texts):
        w = t.encode().split()
        batch.add(doc, 0, w, np.arange(len(w), dtype=np.uint64))
    doc, _, first, n = superkmer.judge([blob for _, blob in batch.packed()])
    assert list(zip(doc.tolist(), first.tolist(), n.tolist())) == [(1, 0, 2)]


def marked(rows, k, m, buckets, batches):
    """(doc, check, window) of all marks, from rows (doc, check, words) dealt to batches."""
    made = [superkmer.Batch(buckets, k, m) for _ in range(batches)]
    for i, row in enumerate(rows):
        made[i % batches].add(*row)
    blobs, found = {}, []
    for batch in made:
        for b, blob in batch.packed():
            blobs.setdefault(b, []).append(blob)
        found += [batch.marks] if batch.marks else []
    found += [superkmer.judge(x, k) for x in blobs.values()]
    return {(d, c, a + i) for x in found for d, c, a, n in zip(*(y.tolist() for y in x)) for i in range(n)}


def test_marks_of_all_sizes_equal_brute_force(monkeypatch):
    for seed in range(100):
        rng = random.Random(seed)
        monkeypatch.setattr(superkmer, "SORTED", rng.choice([10, 100, 1 << 20]))
        k = rng.choice([1, 2, 3, 5, 13])
        vocab = [b"%d" % i for i in range(rng.choice([1, 2, 5, 40]))]
        passages = [[rng.choice(vocab) for _ in range(rng.randint(1, 30))] for _ in range(4)]
        rows = []
        for check in range(rng.randint(1, 25)):
            parts = [rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(0, 20))] for _ in range(rng.randint(0, 4))]
            rows.append((rng.choice([rng.randint(-5, 20), superkmer.NO_ID]), check, sum(parts, [])))
        windows = [(d, c, a, tuple(w[a : a + k])) for d, c, w in rows for a in range(len(w) - k + 1)]
        least = {}
        for d, _, _, w in windows:
            least[w] = min(d, least.get(w, d))
        got = marked(rows, k, rng.randint(1, min(k, 3)), rng.choice([1, 2, 7, 40]), rng.randint(1, 3))
        assert got == {(d, c, a) for d, c, a, w in windows if least[w] < d}


def test_a_copy_in_a_batch_is_one_mark():
    words = [b"w%d" % i for i in range(500)]
    batch = superkmer.Batch(4, 13, 2)
    for doc in (3, 1, 2):
        batch.add(doc, 0, words)
    sent = list(batch.packed())
    assert sorted(zip(*(x.tolist() for x in batch.marks))) == [(2, 0, 0, 488), (3, 0, 0, 488)]
    assert all(not len(superkmer.judge([blob])[0]) for _, blob in sent)


def test_calls_do_not_grow_with_the_words():
    def calls(n):
        count = 0

        def counted(frame, event, arg):
            nonlocal count
            count += event in ("call", "c_call")

        batch = superkmer.Batch(1, 13, 2)
        words, hashes = [b"w%d" % i for i in range(n)], np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sys.setprofile(counted)
        try:
            batch.add(1, 0, words, hashes)
            superkmer.judge([blob for _, blob in batch.packed()])
        finally:
            sys.setprofile(None)
        return count

    calls(2000)  # imports
    assert calls(20_000) < 1.1 * calls(2000)


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    import hashlib

    want = {i: (a, b, hashlib.sha256(c.encode()).hexdigest()) for (i, _), (a, b, c) in zip(rows, slow(rows))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmer.op10_superkmer(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
