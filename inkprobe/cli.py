"""Command line: ``python -m inkprobe.cli batch DOCX_FOLDER OUT`` checks every document of a folder and writes results, risks and
the ranking; ``report OUT PAPER`` prints one paper's report."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.checks import run_checks
from .operators.registry import EXTRA_WEIGHTS
from .plans import report, scoring
from .sources import files


def scored(results: DataFrame) -> DataFrame:
    """Risks of check results."""
    first = F.get("source_locations", F.lit(0))
    seq = F.xxhash64("check_id")
    rows = results.withColumn("page", F.coalesce(first["page"], F.lit(-1))).withColumn("excerpt", F.coalesce(first["excerpt"], F.lit(""))).withColumn("seq", seq)
    return scoring.paper_risk(rows, EXTRA_WEIGHTS)


def batch(spark: SparkSession, source: str, out: str) -> None:
    papers = files.papers_from_docx(files.read_docx(spark, source))
    papers.write.mode("overwrite").parquet(f"{out}/papers")
    run_checks(spark.read.parquet(f"{out}/papers")).write.mode("overwrite").parquet(f"{out}/results")
    results = spark.read.parquet(f"{out}/results")
    scored(results).write.mode("overwrite").parquet(f"{out}/risks")
    risks = spark.read.parquet(f"{out}/risks")
    report.write_reports(report.json_reports(risks, results), f"{out}/reports")
    scoring.leaderboard(risks.select("paper_id", "n_red", "n_orange", "n_yellow", "n_checks")).write.mode("overwrite").json(f"{out}/ranking")


def show(spark: SparkSession, out: str, paper: str) -> str:
    risk = spark.read.parquet(f"{out}/risks").where(F.col("paper_id") == paper).first()
    checks = spark.read.parquet(f"{out}/results").where(F.col("paper_id") == paper).collect()
    return report.markdown(risk, checks) if risk else f"no paper {paper}\n"


def main() -> None:
    parser = argparse.ArgumentParser(prog="inkprobe")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in (("batch", ("source", "out")), ("report", ("out", "paper"))):
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a)
    given = parser.parse_args()
    spark = SparkSession.builder.appName("inkprobe").getOrCreate()
    if given.command == "batch":
        batch(spark, given.source, given.out)
    else:
        print(show(spark, given.out, given.paper))


if __name__ == "__main__":
    main()
