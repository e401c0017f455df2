"""Review by a language model: a prompt a paper, a provider of your own, a reply read with tolerance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import evidence_paragraphs, tolerant_json

REPLY = "assessment string, severity_score double, signal_reviews array<struct<check_id:string,is_true_positive:boolean,reasoning:string,severity:string>>, draft string"


def prompts(papers: DataFrame, results: DataFrame) -> DataFrame:
    """(paper_id, prompt): title, the signals found, and the paragraphs that bear on them."""
    signals = results.where(F.col("level").isin("red", "orange", "yellow"))
    lines = signals.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "level", F.lit(" "), "check_id", F.lit(": "), "verdict"))).alias("lines"))
    rows = papers.select(F.col("paper_id").cast("string").alias("paper_id"), "title", evidence_paragraphs(F.coalesce("full_text", F.lit(""))).alias("evidence")).join(lines, "paper_id")
    ask = F.lit("Say for each signal whether it is real, and how severe the whole is from 0 to 10. Answer in JSON with assessment, severity_score, signal_reviews and draft.")
    return rows.select("paper_id", F.concat_ws("\n\n", F.concat(F.lit("Paper: "), F.coalesce("title", F.lit(""))), F.array_join("lines", "\n"), "evidence", ask).alias("prompt"))


def review(asked: DataFrame, answer: Callable[[str], str] | None) -> DataFrame:
    """(paper_id, review): the reply as a record, its severity between 0 and 10; null where it can't be read. Without a provider
    nothing is asked."""
    if answer is None:
        return asked.limit(0).select("paper_id", F.from_json("prompt", REPLY).alias("review"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(reply=[answer(p) for p in pdf.prompt])[["paper_id", "reply"]]

    replies = asked.mapInPandas(run, "paper_id string, reply string").select("paper_id", tolerant_json(F.col("reply"), REPLY).alias("review"))
    clamped = F.col("review").withField("severity_score", F.least(F.greatest(F.col("review.severity_score"), F.lit(0.0)), F.lit(10.0)))
    return replies.select("paper_id", F.when(F.col("review").isNotNull(), clamped).alias("review"))
