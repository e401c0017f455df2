import math
import re

import pyarrow.parquet as pq
import pytest
import xxhash

from inkprobe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def h1(word, seed=42):
    return signed(xxhash.xxh64(word.encode(), seed=seed & (2**64 - 1)).intdigest())


def slow_base(text):
    words = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n)


def slow_scores(texts, trusted):
    grams = []
    for t in texts:
        w = WORD.findall(t)
        grams.append([h1(x) % quality.BUCKETS for x in w] + [h1(b, h1(a)) % quality.BUCKETS for a, b in zip(w, w[1:])])
    raw, target = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    for g, good in zip(grams, trusted):
        for b in g:
            raw[b] += 1
            target[b] += good
    weight = [math.log((t + 1) / (sum(target) + quality.BUCKETS)) - math.log((r + 1) / (sum(raw) + quality.BUCKETS)) for r, t in zip(raw, target)]
    return [sum(weight[b] for b in g) / len(g) if g else None for g in grams]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    t = pq.read_table(f"{d}/documents.parquet").to_pydict()
    lab = pq.read_table(f"{d}/labels.parquet").to_pydict()
    good = {i for i, q, x in zip(lab["doc_id"], lab["quality"], lab["toxic"]) if q == 1 and not x}
    texts = [x or "" for x in t["text"]]
    scores = slow_scores(texts, [i in good for i in t["doc_id"]])
    base = [slow_base(x) for x in texts]
    fit = [s for s, b, i in zip(scores, base, t["doc_id"]) if i in good and not b[5]]
    mean = sum(fit) / len(fit)
    least = mean - quality.DEVIATIONS * math.sqrt(sum((s - mean) ** 2 for s in fit) / len(fit))
    got = {r.doc_id: r for r in quality.op2_quality(spark, d).collect()}
    assert len(got) == len(texts)
    for i, s, b in zip(t["doc_id"], scores, base):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == b
        assert r.score == pytest.approx(s, abs=1e-9)
        assert r.kept == (not b[5] and s >= least)


def test_held_out_labels(spark):
    """Documents labelled bad go, good ones stay, also where their labels took no part in the fit."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = quality.judged(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    rows = found.join(labels.where("doc_id % 2 = 1"), found["id"] == labels["doc_id"]).where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c a b c"), (5, "x\ny\n x\nx\n\n"), (5, "x\ny\n x\nx\n\n"), (6, "a b " * 40_000), (7, "one two three " + " ".join(f"w{i}" for i in range(60)) + " one two three"), (8, "é#\U0001f600 |<>| b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as id", "3 as score")
    labels = spark.createDataFrame([(7, 1, None), (7, 1, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    key = lambda r: str((r[0], r[1]))
    assert sorted(((r.id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got), key=key) == sorted(((i, slow_base(t or "")) for i, t in rows), key=key)
    assert [r.kept for r in got if r.id == 7] == [True]
    assert all(r.kept is False for r in got if r.base_failed)
    assert quality.judged(docs.limit(0), labels).collect() == []
    assert len(quality.judged(docs, labels.limit(0)).collect()) == len(rows)


def test_every_trusted_document_counts(spark):
    """More trusted documents than any sample would hold: counts and threshold are those of all of them."""
    n, good = 20_600, 20_400
    texts = [" ".join(f"w{k * j % 997}" for j in range(1, 61)) if k % 50 == 0 else f"a{k % 700} b{k % 90}" for k in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.range(n).selectExpr("id as doc_id", f"cast(id < {good} as int) as quality", "0 as toxic")
    scores = slow_scores(texts, [k < good for k in range(n)])
    fit = [s for k, s in enumerate(scores[:good]) if not slow_base(texts[k])[5]]
    got = quality.judged(docs, labels, deviations=0.0).collect()
    assert len(got) == n
    assert max(abs(r.score - scores[r.id]) for r in got) < 1e-9
    mean = sum(fit) / len(fit)
    assert any(s > mean for s in fit) and any(s < mean for s in fit)
    assert all(r.kept == (not r.base_failed and scores[r.id] >= mean) for r in got if abs(scores[r.id] - mean) > 1e-7)


def test_null_and_repeated_ids_count_as_brute_force(spark):
    rows = [(1, "a b " * 40), (None, "c d"), (2, None), (2, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(60))), (3, " ".join(f"v{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, None), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    scores = slow_scores([t or "" for _, t in rows], [i == 2 for i, _ in rows])
    key = lambda x: str((x[0], x[1] is None, x[1]))
    got = sorted(((r.id, None if r.score is None else round(r.score, 9)) for r in quality.judged(docs, labels).collect()), key=key)
    assert got == sorted(((i, None if s is None else round(s, 9)) for (i, _), s in zip(rows, scores)), key=key)
