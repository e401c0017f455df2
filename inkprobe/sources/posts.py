"""Posts from feeds, pages and search replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import article_text, dois, pmids
from ..schema import POSTS

ITEM = "guid string, title string, link string, pubDate string, `dc:creator` string, `content:encoded` string, description string"
REPLY = "publications array<struct<id:string,title:string,url:string,authors:string,created:string,content:string>>"


def _post(rows: DataFrame, source: str) -> DataFrame:
    text = F.concat_ws(" ", "title", "content")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        F.lit(source).alias("source"), *[empty(c) for c in ("source_id", "title", "url", "author", "date", "content")], dois(text).alias("dois"), pmids(text).alias("pmids"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
    ).to(spark_schema(rows.sparkSession))


def spark_schema(spark: SparkSession):
    return spark.createDataFrame([], POSTS).schema


def read_feed(spark: SparkSession, path: str, source: str = "feed") -> DataFrame:
    """Posts of RSS 2.0 files; the date stays as it is written, and the whole content goes before the description."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    content = article_text(F.coalesce(F.col("`content:encoded`"), F.col("description"), F.lit("")))
    return _post(items.select(F.coalesce("guid", "link").alias("source_id"), "title", F.col("link").alias("url"), F.col("`dc:creator`").alias("author"), F.col("pubDate").alias("date"), content.alias("content")), source)


def read_replies(spark: SparkSession, path: str, source: str = "search", most: int = 50) -> DataFrame:
    """Posts of saved JSON replies of a search, at most so many a reply."""
    each = spark.read.schema(REPLY).option("multiLine", "true").json(path).select(F.explode(F.slice("publications", 1, most)).alias("p"))
    return _post(each.select(F.col("p.id").alias("source_id"), "p.title", "p.url", F.col("p.authors").alias("author"), F.col("p.created").alias("date"), "p.content"), source)


def with_full_text(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Posts with their pages' text (url, html) where there is a page."""
    text = pages.select("url", article_text(F.col("html")).alias("__text"))
    return posts.join(text, "url", "left").withColumn("content", F.coalesce(F.nullif("__text", F.lit("")), "content")).select(*posts.columns)
