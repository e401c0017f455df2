"""All checks of a paper run in one pass over its texts, dealt out to all cores."""

from inkprobe.operators import checks as c
from inkprobe.operators.registry import CHECKS
from inkprobe.plans.corpus import papers

SMALL = "/root/testdata/sf0.001"


def test_one_python_stage_dealt_out(spark):
    plan = c.run_checks(papers(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert papers(spark, SMALL).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_together_as_alone(spark):
    few = papers(spark, SMALL).limit(60).localCheckpoint()
    together = sorted(map(str, c.run_checks(few).collect()))
    alone = sorted(str(r) for k in c.TOGETHER for r in CHECKS[k](few).collect())
    assert together == alone and len(together) == 60 * 16


def test_starts_of_lines_and_clauses():
    text = "x n = 3 p < 0.01. n = 2, p < 0.001; n = 4 mice, P ≤ 0.01\nn = 1 (p < 0.01), n = 2."
    hits = [m.span() for m in c._AtStarts().finditer(text)]
    assert hits and hits == [m.span() for m in c._AtStarts.line.finditer(text)]
