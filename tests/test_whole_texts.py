"""Checks read a text to its end, however long."""

from inkprobe.operators import checks as c

FILLER = "Nothing of note is said here. " * 17_000
COLUMNS = ["title", "abstract", "methods", "results", "discussion", "full_text"]
END = "Data were normally distributed. There was no significant difference, therefore it is safe. A t-test gave t(22) = 3.10, p = 0.90. "
HYPE = "a groundbreaking, unprecedented, revolutionary, novel and remarkable finding, paradigm shift, for the first time. "


def levels(spark, text):
    papers = spark.createDataFrame([("p", *[text] * 6)], ", ".join(f"{n} string" for n in ["paper_id", *COLUMNS]))
    only = ["text.blacklist", "stats.normality_claim", "stats.fallacies", "numbers.statcheck"]
    return {r.check_id: (r.level, r.verdict) for r in c.run_checks(papers, only).collect()}


def test_hits_after_half_a_million_characters(spark):
    assert len(FILLER) > 500_000
    at_the_end, alone = levels(spark, FILLER + END + HYPE), levels(spark, END + HYPE)
    assert alone["stats.normality_claim"][0] == alone["stats.fallacies"][0] == alone["numbers.statcheck"][0] == "red"
    assert alone["text.blacklist"][0] in ("yellow", "orange")
    # the two joined sections of stats.fallacies hold each hit twice, in both texts
    assert at_the_end == alone


def test_first_digits_of_the_whole_text():
    numbers = " ".join(f"{d}{k}.5 kg" for d in (9,) for k in range(10, 99)) + " " + " ".join(f"{9}{k}.25 g" for k in range(10, 99))
    assert c._benford_ladder(FILLER + numbers, "", "") == c._benford_ladder(numbers + " " * 500, "", "")
