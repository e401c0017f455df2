"""Facts about the checks: input and expected level or number."""

import pytest
from pyspark.sql import functions as F

from inkprobe.functions import stats
from inkprobe.functions.spans import find_spans
from inkprobe.operators import checks as c
from inkprobe.operators.registry import CHECKS, check


@pytest.mark.parametrize("t, df, low, high", [(3.10, 22, 0.004, 0.006), (0.0, 5, 1, 1), (1.96, 1e6, 0.0499, 0.0501)])
def test_t_tail(t, df, low, high):
    assert low <= stats.t_two_sided(t, df) <= high


def test_other_tails():
    assert stats.chi2_upper(stats.CRITICAL_CHI2_DF9_05, 9) == pytest.approx(0.05, abs=1e-10)
    assert stats.chi2_upper(stats.CRITICAL_CHI2_DF8_01, 8) == pytest.approx(0.01, abs=1e-10)
    assert stats.f_upper(3.1**2, 1, 22) == pytest.approx(stats.t_two_sided(3.1, 22), rel=1e-10)
    assert stats.z_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-10)
    assert 0.8 < stats.critical_d(12) < 0.9 and stats.critical_d(1) == float("inf")
    assert stats.p_value("r", 1.0, 10, None) is None and stats.p_value("t", None, 10, None) is None


@pytest.mark.parametrize("mean, n, fits", [(3.47, 12, False), (3.50, 12, True), (5.00, 20, True), (3.47, 50, True), (4.37, 12, False)])
def test_grim(mean, n, fits):
    assert c.grim_consistent(mean, n) is fits


@pytest.mark.parametrize(
    "text, level",
    [("t(22) = 3.10, p = 0.005; F(1, 28) = 5.32, p = 0.029", "green"), ("t(22) = 3.10, p = 0.830", "red"), ("nothing here", "green"), ("", "error"), ("t(22) = 3.10, p < 0.05", "green"), ("Z = 1.00, p < 0.05", "red")],
)
def test_statcheck(text, level):
    assert c.statcheck_ladder(text)[0] == level


@pytest.mark.parametrize("text, level", [("M = 4.37 ± 0.82, n = 12", "red"), ("M = 3.50 ± 0.50 (n=12), M = 5.00 ± 0.80 (n=20)", "green"), ("", "error"), ("n = 12, mean = 3.47", "red")])
def test_grim_ladder(text, level):
    assert c.grim_ladder(text)[0] == level


def test_ratios():
    assert c.ratio_cv([1, 2, 3, 4, 5], [1.5, 3, 4.5, 6, 7.5])["suspicious"]
    assert not c.ratio_cv([1, 2, 3], [1.5, 3, 4.5])["suspicious"]
    assert not c.ratio_cv([1, 2, 3, 4, 5], [2, 3, 9, 4, 11])["suspicious"]


def test_digits():
    assert not c.digit_preference([i + j / 10 for i in range(4) for j in range(10)])["suspicious"]
    assert c.digit_preference([i + 0.5 for i in range(40)])["suspicious"]
    assert not c.decimal_consistency([1.2, 2.34, 3.456, 4.5, 5.678])["consistent"]
    assert c.decimal_consistency([1.25, 2.34, 3.46])["consistent"]


def test_benford_needs_expected_counts():
    """Between 50 and 109 digits the rarest digit is expected too seldom: no verdict, and no error."""
    assert c.benford([1] * 80)["p"] is None
    assert c.benford([1] * 200)["p"] < 0.01


def test_p_hacking():
    assert c._p_hacking_ladder(" ".join(f"p = 0.04{i}" for i in range(1, 10)) + " p = 0.045")[0] in ("red", "yellow")
    assert c._p_hacking_ladder(" ".join(["p < 0.05"] * 10))[0] == "yellow"
    assert c._p_hacking_ladder("p < 0.05")[0] == "green"


def test_sample_size():
    assert c._sample_ladder("n = 2 mice per group were used.", "n = 2 mice per group were used.")[0] == "red"
    assert "technical replicates" in c._sample_ladder("performed in triplicate. n = 3.", "performed in triplicate. n = 3.")[1]
    assert c._sample_ladder("", "")[0] == "error"


def test_spans_once():
    import re

    both = [re.compile("ab"), re.compile("a.")]
    assert [s[:3] for s in find_spans("ab ac", both, 5, 5)] == [(0, 0, 2), (1, 3, 5)]
    assert len(find_spans("ab ac", both, 5, 5, once=False)) == 3


PAPER = "paper_id string, title string, abstract string, methods string, results string, discussion string, full_text string"


def level(spark, check_id, **texts):
    names = [x.split(" ")[0] for x in PAPER.split(", ")]
    row = ["p", *[texts.get(n) for n in names[1:]]]
    return CHECKS[check_id](spark.createDataFrame([row], PAPER)).first()


@pytest.mark.parametrize(
    "check_id, texts, want",
    [
        ("text.blacklist", {"discussion": "This novel, unprecedented, remarkable, excellent and outstanding breakthrough is certainly, absolutely fantastic."}, "orange"),
        ("text.blacklist", {"discussion": "A novel and excellent breakthrough."}, "yellow"),
        ("text.blacklist", {"discussion": "A plain text."}, "green"),
        ("text.pvalue_camouflage", {"results": "It was marginally significant."}, "orange"),
        ("text.pvalue_camouflage", {"results": "It was marginally significant and approached significance.", "discussion": "borderline significant"}, "red"),
        ("stats.normality_claim", {"methods": "All data were normally distributed."}, "red"),
        ("stats.normality_claim", {"methods": "A normality test was performed."}, "yellow"),
        ("stats.fallacies", {"results": "There was no significant difference, therefore the drug works."}, "red"),
        ("stats.fallacies", {"results": "The results show no effect."}, "yellow"),
        ("text.title_conclusion_gap", {"title": "X enhances repair", "results": "There was no significant difference."}, "red"),
        ("text.title_conclusion_gap", {"title": "X enhances repair", "results": "It was comparable between groups in viral load."}, "yellow"),
        ("text.title_conclusion_gap", {"title": "X of repair", "results": "no significant difference"}, "green"),
        ("bioinfo.western_blot", {"full_text": "Western blot on PVDF with ECL."}, "red"),
        ("bioinfo.western_blot", {"full_text": "Western blot.", "methods": "GAPDH"}, "green"),
        ("bioinfo.western_blot", {"full_text": "No such thing."}, "green"),
        ("stats.method_misuse", {"full_text": "Three groups were compared by t-test."}, "red"),
        ("stats.method_misuse", {"full_text": "Two arms. ANOVA with Tukey."}, "green"),
    ],
)
def test_levels(spark, check_id, texts, want):
    assert level(spark, check_id, **texts).level == want


@pytest.mark.parametrize("check_id", sorted(CHECKS))
def test_no_text_is_an_error(spark, check_id):
    assert level(spark, check_id).level == "error"


def test_one_bad_paper_leaves_the_others(spark):
    def ladder(text):
        if text == "bad":
            raise ValueError("broken")
        return "green", "", [], 1.0, False

    df = spark.createDataFrame([("a", "bad"), ("b", "good")], "paper_id string, t string")
    got = {r.paper_id: r.r.level for r in df.select("paper_id", c._python(ladder)(F.col("t")).alias("r")).collect()}
    assert got == {"a": "error", "b": "green"}


def test_plug_in(spark):
    @check("own.check", weight=0.2)
    def own(papers):
        return c._result(papers, "own.check", "Own", F.lit(None).cast(c.FOUND))

    try:
        assert "own.check" in CHECKS
    finally:
        del CHECKS["own.check"]


def test_cells_and_identical_values():
    far = " filler" * 900
    text = f"alpha weight 3.217 units{far} beta height 3.217 units{far} gamma depth 3.217 units " + " ".join(f"{i}.{i}7" for i in range(11, 22))
    assert c._identical_ladder(text)[0] == "yellow"
    assert c.identical_level([], 5)[0] == "red" and c.identical_level([], 2)[0] == "orange" and c.identical_level([], 0)[0] == "green"
