"""Reports: one JSON document a paper, Markdown for one paper, the batch's leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def json_reports(risk: DataFrame, results: DataFrame) -> DataFrame:
    """(paper_id, report): summary and checks of each paper as one JSON text."""
    checks = results.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("check_id", "check_name", "level", "verdict", "evidence", "confidence", "needs_human"))).alias("checks"))
    summary = F.struct(*[F.round(c, 1).alias(c) if c == "risk_score" else F.col(c) for c in risk.columns if c != "paper_id"])
    return risk.select("paper_id", summary.alias("summary")).join(checks, "paper_id", "left").select("paper_id", F.to_json(F.struct("summary", "checks")).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def markdown(risk: Row, checks: list[Row]) -> str:
    """The report of one paper."""
    lines = [f"# Report on {risk['paper_id']}", "", f"Risk {risk['risk_score']:.1f} ({risk['overall_level']})", "", "| level | results |", "|-|-|"]
    lines += [f"| {x} | {risk[f'n_{x}']} |" for x in ("red", "orange", "yellow", "green", "error")]
    for level in ("red", "orange", "yellow", "green", "error"):
        own = [c for c in checks if c["level"] == level]
        if own:
            lines += ["", f"## {level}"]
            for c in own:
                lines += [f"- **{c['check_name']}**: {c['verdict']}", *[f"  - {e}" for e in (c["evidence"] or [])[:5]]]
    return "\n".join(lines) + "\n"
