"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, tokens. Each stage is a function
(spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next stage's docs."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from inkprobe.llm import bpe, common, exact_dedup, mixing, quality, simhash
from inkprobe.llm.common import stored, table


_OLD: list[str] = []


def stage(f):
    """A stage whose temporary tables are deleted when the next stage begins, for then its rows are written; and what a query
    has shuffled, once its rows are. Texts would else lie on disk several times until the session ends."""

    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        while _OLD:
            common.delete(spark, _OLD.pop())
        n = len(common.MADE)
        out = f(spark, docs, sf_dir)
        _OLD.extend(common.MADE[n:])
        return out

    return begin


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the likelihood ratio reject, with the columns of documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.keep_first(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (4/5 of their 5-word shingles alike, or more) the document with the smallest id."""
    return simhash.keep_first(docs, alike=True)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; ids repeat where a document is taken more than once."""
    return mixing.mixed(docs)


@stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and token_ids, array of int."""
    return bpe.encode_column(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("simhash", near_copies), ("mixing", mix_sources), ("bpe", tokenise)]

#: The quality stage's hashes have no counterpart in DuckDB; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
