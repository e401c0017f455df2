import pytest
from pyspark.sql import functions as F

from inkprobe.operators import joins, numeric
from inkprobe.plans import knowledge, report, scoring
from inkprobe.streaming import incremental

ROWS = "paper_id string, seq int, check_id string, check_name string, level string, verdict string, confidence double, needs_human boolean, page int, excerpt string, evidence array<string>"


def risk(spark, *rows):
    made = [("p", k, c, c, level, "v", conf, True, page, text, []) for k, (c, level, conf, page, text) in enumerate(rows)]
    return scoring.paper_risk(spark.createDataFrame(made, ROWS)).first()


GREEN = [("stats.fallacies", "green", 1.0, -1, "")] * 10


def test_veto(spark):
    r = risk(spark, ("numbers.grim", "red", 0.95, 1, "x"), *GREEN)
    assert (r.veto, r.risk_score, r.overall_level, r.contributions) == (True, 100.0, "red", [])
    assert not risk(spark, ("numbers.grim", "red", 0.8, 1, "x")).veto


def test_correlation(spark):
    text = "mean of group alpha beta"
    near = risk(spark, ("numbers.grim", "red", 0.8, 1, text), ("numbers.statcheck", "red", 0.9, 1, text))
    assert [c.correlation for c in near.contributions] == [1.5, 1.5]
    far = risk(spark, ("numbers.grim", "red", 0.8, 3, text), ("numbers.statcheck", "red", 0.9, 8, text))
    assert [c.correlation for c in far.contributions] == [1.0, 1.0]
    three = risk(spark, *[("numbers.statcheck", "red", 0.9, 1, text)] * 3)
    assert three.cluster_bonus == 10


def test_weights_floor_and_levels(spark):
    r = risk(spark, ("stats.p_hacking", "orange", 0.8, 2, "one"), ("text.blacklist", "yellow", 0.7, 9, "two"))
    assert sum(c.contribution for c in r.contributions) == pytest.approx(12 * 0.5 + 5 * 0.3)
    r = risk(spark, ("text.blacklist", "red", 0.7, 1, "x"), *GREEN)
    assert (r.risk_score, r.overall_level, r.floor_applied) == (51.0, "red", True)
    r = risk(spark, ("text.blacklist", "orange", 0.7, 1, "x"), *GREEN)
    assert (r.risk_score, r.overall_level) == (31.0, "orange")
    # last digits have no weight of their own
    assert risk(spark, ("numbers.digit_pref", "orange", 0.8, 1, "x")).contributions[0].contribution == 6.0


def test_leaderboard(spark):
    df = spark.createDataFrame([("a", 1, 0, 0, 3), ("b", 1, 0, 0, 3), ("c", 2, 0, 0, 3), ("d", 0, 0, 0, 0)], "paper_id string, n_red int, n_orange int, n_yellow int, n_checks int")
    want = [("c", 1), ("a", 2), ("b", 3), ("d", 4)]
    assert sorted(((r.paper_id, r["rank"]) for r in scoring.leaderboard(df).collect()), key=lambda x: x[1]) == want
    assert [(r.paper_id, r["rank"]) for r in scoring.leaderboard(df, 2).orderBy("rank").collect()] == want[:2]


def test_reports(spark):
    rows = spark.createDataFrame([("p", 0, "text.blacklist", "Overstatement", "yellow", "3 hits", 0.7, True, 1, "x", ["e"])], ROWS)
    r = scoring.paper_risk(rows)
    text = report.json_reports(r, rows).first().report
    assert '"check_id":"text.blacklist"' in text
    assert "**Overstatement**: 3 hits" in report.markdown(r.first(), rows.collect())


POSTS = "source_id string, title string, url string, date string, content string, source string"


def test_knowledge_loop(spark):
    posts = spark.createDataFrame([("1", "A word", "u1", "2", "c"), ("2", "B", "u2", "1", "more word")], "source_id string, title string, url string, date string, content string")
    answer = lambda t: '```json\n{"patterns": [{"category": "other", "technique": "t", "detection_hint": "h", "pattern": "p+"}, {"technique": ""}]}\n```'
    learned = knowledge.learn(posts, answer)
    assert [(r.category, r.pattern) for r in learned.collect()] == [("blacklist", "p+")] * 2
    store = spark.createDataFrame([], "post_id string, category string, technique string, detection_hint string, pattern string, severity string, reviewed int, pattern_id long")
    patterns = knowledge.with_ids(store, learned)
    assert sorted(r.pattern_id for r in patterns.collect()) == [1, 2]
    assert [r.pattern_id for r in knowledge.pending(patterns, posts).collect()] == [2, 1]
    patterns = knowledge.reviewed(patterns, 1, True)
    known = spark.createDataFrame([("overclaim", "novel")], "category string, pattern string")
    assert {r.pattern for r in knowledge.approved_rules(patterns, known).collect()} == {"novel", "p+"}
    assert [r.source_id for r in knowledge.unlearned(posts, patterns.where("post_id = '1'")).collect()] == ["2"]
    assert [r.source_id for r in knowledge.search(posts, "WORD").orderBy("source_id").collect()] == ["1", "2"]
    assert knowledge.new_posts(posts.unionByName(posts), posts.where("source_id = '1'")).count() == 1


def test_stream_adds_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 5), i) for i in range(10)], "source_id string, v int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = incremental.read_files(spark, f"{tmp_path}/in", rows.schema, per_trigger=1)
    for k in range(2):
        incremental.insert_if_absent(stream, f"{tmp_path}/out", f"{tmp_path}/state{k}").awaitTermination()
    assert sorted(r.source_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list("01234")


def test_nearby_pairs_cross_buckets(spark):
    a = spark.createDataFrame([(1, 499), (1, 2000)], "k int, pos int")
    b = spark.createDataFrame([(1, 501), (1, 998), (1, 2600), (2, 500)], "k int, pos int")
    assert [(r.pos, r.other_pos) for r in joins.first_nearby(a, b, "k", 500).collect()] == [(499, 501)]


def test_rectangles(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 55.0, 0.0, 60.0, 10.0), (1, 300.0, 300.0, 310.0, 310.0), (2, 0.0, 0.0, 1.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in joins.merged_rectangles(df).collect())
    assert got == [(1, 0.0, 0.0, 60.0, 10.0), (1, 300.0, 300.0, 310.0, 310.0), (2, 0.0, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame([(1, -5.0, 2.0, 5.0, 4.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    r = joins.boxes_in_figures(df.where("x0 = 0 and page = 1"), boxes).first()
    assert (r.t_x0, r.t_y0, r.t_x1, r.t_y1) == (0.0, 2.0, 5.0, 4.0)


def test_sequences_and_cells(spark):
    v = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 8.0)] + [("b", x) for x in (1.0, 2.0, 3.0)] + [("c", x) for x in (1.0, 5.0, 6.0)] + [("d", 1.0), ("d", 2.0)], "k string, value double")
    assert {r.k: r.is_sequence for r in numeric.is_sequence(v, ["k"]).collect()} == {"a": True, "b": True, "c": False, "d": False}
    grid = [("s", r, c, 7.123 if (r, c) in ((0, 0), (3, 1)) else r * 31.7 + c * 11.3 + (r * c) ** 2) for r in range(6) for c in range(3)]
    found = numeric.repeated_cells(spark.createDataFrame(grid, "sheet string, row int, col int, value double"))
    assert [(r.value, r.n) for r in found.collect()] == [(7.123, 2)]


def test_first_digits(spark):
    df = spark.createDataFrame([("x", 0.5), ("x", 1.0), ("x", 950.0), ("x", float("nan")), ("x", float("inf")), ("x", -3.0), ("x", 1e20)], "column string, value double")
    assert {r.digit: r.n for r in numeric.first_digit_histogram(df).where(F.col("digit").isNotNull()).collect()} == {1: 2, 9: 1}
