import random

import corpus_pipeline
import pyarrow.parquet as pq
import pytest

from inkprobe.llm import near_copies, simhash

SPACE = str.maketrans({c: " " for c in "\t\n\x0b\f\r"})


def slow_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(SPACE).split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_groups(rows):
    """The smallest id of each row's group, every pair compared."""
    sets, label = [slow_set(t) for _, t in rows], {i: i for i, _ in rows}
    for x, (i, _) in enumerate(rows):
        for y in range(x):
            j, same = rows[y][0], len(sets[x] & sets[y])
            if label[i] != label[j] and 5 * same >= 4 * (len(sets[x]) + len(sets[y]) - same):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("common", [4, 1])
def test_groups_against_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    rng, rows = random.Random(7), []
    line = "this very line stands in every single one of the texts here"
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        for k in range(8):
            rows.append((len(rows), edited(rng, words, rng.randint(0, max(1, len(words) // 25))) + (" " + line if k % 2 else "")))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", " \n", "One", "one two three four five", "ONE two three  four five", "a b c d e f", line])]
    got = {r.id: r.component_id for r in near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_groups(rows)


def test_the_stage_drops_what_is_alike_beyond_four_bits(spark):
    """Two texts 4/5 alike whose fingerprints differ in more than 4 bits, and two that are less alike."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    near, far = edited(rng, words, 3), edited(rng, words, 12)
    rows = [(1, " ".join(words)), (2, near), (3, far)]
    assert slow_groups(rows) == {1: 1, 2: 1, 3: 3}
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(near.encode())).bit_count() > 4
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [1, 3]


def test_odd_tables(spark):
    rows = [(4, None), (2, ""), (9, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (7, "q " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 node", "2 id", "3 component_id")
    got = sorted((r.id or -1, r.component_id) for r in near_copies.near_groups(docs).collect())
    assert got == [(-1, 9), (2, 2), (4, 2), (7, 7), (9, 9), (9, 9)]
    assert near_copies.near_groups(docs.limit(0)).collect() == []
    assert sorted(r.doc_id or -1 for r in simhash.keep_first(docs, alike=True).collect()) == [-1, 2, 7, 9, 9]


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = sorted(zip(t["doc_id"], t["text"]))
    got = {r.id: r.component_id for r in near_copies.near_groups(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == slow_groups(rows)


def test_few_pairs_are_few_files(spark, monkeypatch):
    """What joins leave is written in files by its size."""
    from pathlib import Path

    from inkprobe.llm import common

    rng, rows = random.Random(3), []
    for k in range(64):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, edited(rng, words, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.coalescePartitions.minPartitionSize": "1", "adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        monkeypatch.setattr(common, "MADE", [])
        got = {r.id: r.component_id for r in near_copies.near_groups(docs).collect()}
    finally:
        for k in conf:
            spark.conf.unset(f"spark.sql.{k}")
    assert got == {i: i // 2 * 2 for i, _ in rows}
    made = [(spark.read.parquet(p).columns, len(list(Path(p.removeprefix("file://")).glob("*.parquet")))) for p in common.MADE]
    assert next(n for columns, n in made if columns == ["a", "b"]) == 1
    assert next(n for columns, n in made if columns == ["node", "least", "root"]) == 1
