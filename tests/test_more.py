import numpy as np
from pyspark.sql import functions as F

from inkprobe import cli
from inkprobe.operators import extract, images
from inkprobe.plans import review
from test_sources import docx


def test_evidence_and_fallbacks(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    text = "intro\n\nwe used mice here\n\nnothing\n\n" + "cells " * 100
    assert value(extract.evidence_paragraphs(F.lit(text), 300)) == ("we used mice here\n\n" + "cells " * 100)[: 300] + "..."
    assert value(extract.evidence_paragraphs(F.lit(text), 100)) == "we used mice here"
    assert value(extract.experiment_types(F.lit("HeLa cells and patients"))) == ["in vitro", "clinical"]
    assert value(extract.experiment_types(F.lit("nothing"))) == ["unknown"]
    refs = value(extract.image_refs(F.array(F.lit("[a.png] pairs → out.png"), F.lit("[b.jpg] none"))))
    assert (refs.outputs, refs.sources) == (["out.png"], ["a.png", "b.jpg"])
    assert value(extract.page_key(F.lit("page10_fig"))) == 10
    long = "An opening paragraph. " * 12
    assert value(extract.abstract_or_head(F.lit("Title\n\n" + long), F.lit(""), F.lit(""), F.lit(None).cast("int"))) == long.strip()
    assert value(extract.abstract_or_head(F.lit("x" * 150 + "Intro begins"), F.lit(""), F.lit("Intro begins"), F.lit(None).cast("int"))) == "x" * 150
    assert value(extract.abstract_or_head(F.lit("t"), F.lit("own"), F.lit(""), F.lit(1))) == "own"


def test_captions(spark):
    pages = spark.createDataFrame([("p", 1, "text\nFigure 1. First\nmore\nFig. 2 | Second " + "x" * 400), ("p", 2, "see Figure 3")], "paper_id string, page int, text string")
    rows = extract.figure_captions(pages).collect()
    assert [(r.page, r.figure, len(r.caption)) for r in rows] == [(1, "2", 300)]


def test_images(spark):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (96, 96), dtype=np.uint8)
    grey[32:48, 48:64] = grey[0:16, 0:16]
    grey[64:80, 64:80] = 200
    df = spark.createDataFrame([("i", 96, 96, bytearray(grey.tobytes()))], "image string, height int, width int, pixels binary")
    assert [(r.x1, r.y1, r.x2, r.y2) for r in images.clones(df, 16).collect()] == [(0, 0, 48, 32)]
    again = grey.copy()
    again[0:32, 0:32] ^= 64
    both = df.withColumn("again", F.lit(bytearray(again.tobytes())))
    r = images.error_levels(both).first()
    assert (r.max, r.suspicious) == (64.0, False)


def test_review(spark):
    papers = spark.createDataFrame([("p", "T", "n = 3 mice")], "paper_id string, title string, full_text string")
    results = spark.createDataFrame([("p", "text.blacklist", "yellow", "3 hits"), ("p", "numbers.grim", "green", "")], "paper_id string, check_id string, level string, verdict string")
    asked = review.prompts(papers, results)
    assert "yellow text.blacklist: 3 hits" in asked.first().prompt and "grim" not in asked.first().prompt
    assert review.review(asked, lambda p: 'Here: {"severity_score": 99, "assessment": "a"}').first().review.severity_score == 10.0
    assert review.review(asked, lambda p: "no").first().review is None
    assert review.review(asked, None).count() == 0


def test_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = lambda s: (s, "Heading1", False, None)
    plain = lambda s: (s, "", False, None)
    (tmp_path / "in" / "a.docx").write_bytes(docx([head("Results"), plain("M = 4.37 ± 0.82, n = 12")]))
    (tmp_path / "in" / "b.docx").write_bytes(docx([head("Results"), plain("M = 3.50 ± 0.50 (n = 12)")]))
    out = f"file://{tmp_path}/out"
    cli.batch(spark, f"file://{tmp_path}/in", out)
    ranks = {r.paper_id[-6]: r["rank"] for r in spark.read.json(f"{out}/ranking").collect()}
    assert ranks == {"a": 1, "b": 2}
    risks = {r.paper_id[-6]: r for r in spark.read.parquet(f"{out}/risks").collect()}
    assert risks["a"].risk_score == 100.0 and risks["a"].veto
    paper = risks["a"].paper_id
    assert "Possible means" in cli.show(spark, out, paper)


def test_column_letters_of_any_number(spark):
    def slow(i):
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    numbers = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254, 12356629, 12356630, 10**12, 2**53 + 1, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in [*numbers, -1, None]], "n long")
    from inkprobe.operators import extract

    got = {r.n: r.s for r in df.select("n", extract.column_letters(df["n"]).alias("s")).collect()}
    assert got == {n: slow(n) for n in numbers} | {-1: None, None: None}


def test_a_broken_store_is_no_empty_store(spark, tmp_path):
    import pytest

    from inkprobe.streaming import incremental

    spark.createDataFrame([("a", 1)], "source_id string, v int").write.parquet(f"{tmp_path}/in")
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_bytes(b"not a table")
    stream = incremental.read_files(spark, f"{tmp_path}/in", "source_id string, v int")
    with pytest.raises(Exception):
        incremental.insert_if_absent(stream, f"{tmp_path}/store", f"{tmp_path}/state").awaitTermination()
