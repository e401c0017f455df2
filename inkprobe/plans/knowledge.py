"""The learning loop as tables: posts come in once, patterns are learned, reviewed and become rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import tolerant_json

ANSWER = "patterns array<struct<category:string,technique:string,detection_hint:string,pattern:string,severity:string>>"


def new_posts(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """Posts whose source_id the store lacks, each once."""
    return incoming.join(store.select("source_id"), "source_id", "left_anti").dropDuplicates(["source_id"])


def unlearned(posts: DataFrame, processed: DataFrame, most: int | None = 20) -> DataFrame:
    """Posts not processed yet, latest first; ``processed`` also lists posts that gave no pattern, so none is sent forever."""
    rows = posts.join(processed.select(F.col("post_id").alias("source_id")).distinct(), "source_id", "left_anti").orderBy(F.desc("date"), "source_id")
    return rows if most is None else rows.limit(most)


def learn(posts: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """Patterns of posts. ``answer`` maps a post's text to a model's reply; it runs beside the data, batch by batch."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(reply=[answer(t or "") for t in pdf.content])[["post_id", "reply"]]

    replies = posts.select(F.col("source_id").alias("post_id"), "content").mapInPandas(run, "post_id string, reply string")
    each = replies.select("post_id", F.explode(tolerant_json(F.col("reply"), ANSWER)["patterns"]).alias("p")).select("post_id", "p.*")
    kept = each.where((F.coalesce("technique", F.lit("")) != "") & (F.coalesce("detection_hint", F.lit("")) != ""))
    return kept.withColumn("category", F.when(F.col("category").isin("blacklist", "camouflage"), F.col("category")).otherwise("blacklist")).withColumn("reviewed", F.lit(0))


def pending(patterns: DataFrame, posts: DataFrame) -> DataFrame:
    """Patterns awaiting review beside their posts, latest first."""
    p = posts.select(F.col("source_id").alias("post_id"), F.col("title").alias("post_title"), F.col("url").alias("post_url"))
    return patterns.where("reviewed = 0").join(p, "post_id", "left").orderBy(F.desc("pattern_id"))


def search(posts: DataFrame, words: str) -> DataFrame:
    """Posts that hold every word in title or content."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "content")), F.lit(r"(?U)(\w+)"), F.lit(1)))
    wanted = F.array(*[F.lit(w) for w in words.lower().split()])
    return posts.where(F.size(F.array_except(wanted, held)) == 0)


def reviewed(patterns: DataFrame, pattern_id: int, approved: bool) -> DataFrame:
    return patterns.withColumn("reviewed", F.when(F.col("pattern_id") == pattern_id, 1 if approved else -1).otherwise(F.col("reviewed")))


def with_ids(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """``patterns`` with new rows appended under the next ids."""
    from pyspark.sql import Window

    last = patterns.agg(F.coalesce(F.max("pattern_id"), F.lit(0)).alias("last")).first()["last"]
    numbered = new.withColumn("pattern_id", F.lit(last) + F.row_number().over(Window.orderBy("post_id", "technique", "detection_hint")))
    return patterns.unionByName(numbered)


def approved_rules(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with what was approved, each expression once; a pattern without an expression of its own uses its hint."""
    new = patterns.where("reviewed = 1").select("category", F.coalesce(F.nullif("pattern", F.lit("")), F.col("detection_hint")).alias("pattern"))
    return rules.select("category", "pattern").unionByName(new).dropDuplicates(["pattern"])


def statistics(posts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(measure, source, n): posts in all and by source, and patterns that wait for review; one pass over each table."""
    by_source = posts.rollup("source").agg(F.count("*").alias("n"), F.grouping("source").alias("g"))
    counts = by_source.select(F.when(F.col("g") == 1, "posts").otherwise("posts_of_source").alias("measure"), "source", "n")
    waiting = patterns.agg(F.count_if(F.col("reviewed") == 0).alias("n")).select(F.lit("pending").alias("measure"), F.lit(None).cast("string").alias("source"), "n")
    return counts.unionByName(waiting)
