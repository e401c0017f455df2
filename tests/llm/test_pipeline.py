import importlib.util

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from inkprobe.llm import exact_dedup, mixing, quality  # noqa: E402
from inkprobe.llm.tokens import default_vocabulary  # noqa: E402

from test_quality import slow_base, slow_scores  # noqa: E402
from test_near_copies import slow_groups  # noqa: E402

D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def slow_stages():
    """The pipeline's first three stages by brute force: (doc_id, text) kept after each."""
    import math
    import re

    t = pq.read_table(f"{D}/documents.parquet").to_pydict()
    lab = pq.read_table(f"{D}/labels.parquet").to_pydict()
    good = {i for i, q, x in zip(lab["doc_id"], lab["quality"], lab["toxic"]) if q == 1 and not x}
    rows = sorted(zip(t["doc_id"], [x or "" for x in t["text"]], t["source"]))
    scores = slow_scores([r[1] for r in rows], [r[0] in good for r in rows])
    failed = [slow_base(r[1])[5] for r in rows]
    fit = [s for s, f, r in zip(scores, failed, rows) if r[0] in good and not f]
    mean = sum(fit) / len(fit)
    from inkprobe.llm.quality import DEVIATIONS

    least = mean - DEVIATIONS * math.sqrt(sum((s - mean) ** 2 for s in fit) / len(fit))
    first = [r for r, s, f in zip(rows, scores, failed) if not f and s >= least]
    seen, second = set(), []
    for r in first:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1])
        if key not in seen:
            seen.add(key)
            second.append(r)
    groups = slow_groups([(r[0], r[1]) for r in second])
    third = [r for r in second if groups[r[0]] == r[0]]
    return first, second, third


def test_stages_against_brute_force(spark):
    from inkprobe.llm.common import stored

    docs, kept = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, D))
        assert docs.columns[:5] == COLUMNS
        kept.append(docs)
    want = slow_stages()
    for got, rows in zip(kept, want):
        assert sorted(r.doc_id for r in got.collect()) == [r[0] for r in rows]
    # the mix: as often as the operator says, sources near their targets
    m = {r.id: r for r in mixing.mix(kept[2]).collect()}
    copies = {}
    for r in kept[3].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, r in m.items() if (n := r.whole + (r.size > 0 and 2 * r.part >= r.size))}
    assert all(n <= 3 for n in copies.values())
    by_source = {}
    texts = {r.doc_id: r.source for r in kept[2].collect()}
    for i, r in m.items():
        at = by_source.setdefault(texts[i], [0, r.target])
        at[0] += r.taken
    assert all(abs(taken - target) <= 1 for taken, target in by_source.values())
    library = Tokenizer.from_file(default_vocabulary())
    for r in kept[4].collect():
        assert r.token_ids == library.encode(r.text, add_special_tokens=False).ids


def test_entry_lists_the_pipeline():
    spec = importlib.util.find_spec("__spark_entry__")
    assert spec is not None
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("fan_in_bits", [1, 4])
def test_exact_groups(spark, fan_in_bits):
    rows = [(9, "a  b"), (3, "a\tb"), (3, "a\tb"), (None, "a b"), (5, None), (4, ""), (7, " a b"), (8, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as digest", "3 as run").repartition(5)
    got = sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df, fan_in_bits=fan_in_bits).collect()), key=str)
    want = [(9, 3, 4, False), (3, 3, 4, False), (3, 3, 4, True), (None, 3, 4, False), (5, 4, 2, False), (4, 4, 2, True), (7, 7, 1, True), (8, 8, 1, True)]
    assert got == sorted(want, key=str)
    assert sorted(r.doc_id for r in exact_dedup.keep_first(df).collect()) == [3, 4, 7, 8]
    assert exact_dedup.keep_first(df).columns == df.columns
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


def clashing(spark, rows):
    """Rows with columns whose names the operators use themselves, and one with a dot."""
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'d' as __digest", "'k' as __id", "'r' as __row", "7 as __n", "8 as `a.b`", "9 as run", "1.5 as score")


def test_stages_keep_columns_as_they_are(spark):
    """Each stage's rows are rows of its input, whatever its columns are called; empty tables stay empty."""
    from inkprobe.llm import simhash

    text = " ".join(f"word{k}" for k in range(60))
    docs = clashing(spark, [(1, text, "x"), (2, text, "x"), (2, text, "x"), (None, text, "y"), (4, text + " more", "x"), (5, None, None), (6, "", "y")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for stage, ids in (
        (lambda d: quality.keep_good(d, labels), [None, 1, 2, 2, 4]), (exact_dedup.keep_first, [1, 4, 5]), (lambda d: simhash.keep_first(d, alike=True), [None, 1, 5]),
        (simhash.keep_first, None), (mixing.mixed, None),
    ):
        got = stage(docs)
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        rows = got.collect()
        assert set(rows) <= set(docs.collect())
        if ids is not None:
            assert sorted((r.doc_id for r in rows), key=str) == sorted(ids, key=str)
        assert stage(docs.limit(0)).collect() == []


def test_mixed_by_another_id(spark):
    docs = spark.createDataFrame([(k, "a b c d", "s") for k in range(8)], "name long, text string, source string")
    assert sorted(r.name for r in mixing.mixed(docs, id_col="name").collect()) == list(range(8))


def test_a_hot_text_meets_itself_by_run(spark):
    """A third of the rows hold one text; one stays, and each run sends one entry for it."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('t', id)) as text").repartition(12)
    assert exact_dedup.keep_first(docs).count() == 2001
    groups = exact_dedup.exact_groups(docs)
    assert groups.where("group_size = 1000 and keep_id = 0").count() == 1000


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, "y"), (3, "", "x"), (4, "w " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as slot")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    assert sum({(r.source, r.target) for r in got} and {r.source: r.target for r in got}.values()) == pytest.approx(total)
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(df.where("doc_id = 2")).collect()] == [0]


def test_shares_are_those_of_the_rounds(spark):
    """The water level against clamping and handing on, round by round."""
    import random

    rng = random.Random(2)
    for _ in range(5):
        sizes = {f"s{k:02d}": rng.choice([0, 5, 40, 300, 5000]) for k in range(rng.randint(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        total, full = sum(sizes.values()), set()
        while True:
            left = total - sum(3 * sizes[s] for s in full)
            open_ = [s for s in sizes if s not in full]
            share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * sizes[s]}
            if not over:
                break
            full |= over
        want = {s: share.get(s, 3 * sizes[s]) for s in sizes}
        assert got == pytest.approx(want)
