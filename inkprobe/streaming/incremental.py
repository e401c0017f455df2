"""Incremental ingestion: a stream of posts into a table that holds each source_id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.knowledge import new_posts


def read_files(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, as Spark's file systems see it; any other failure to look is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def insert_if_absent(stream: DataFrame, table_path: str, checkpoint: str, key: str = "source_id") -> StreamingQuery:
    """Append each batch's unknown rows. State is the table itself, met by an anti join, not an ever-growing state store; a
    batch that is run again after a failure finds its rows and adds none twice. Only a missing table counts as empty: one
    that can't be read fails the batch."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        store = spark.read.schema(batch.schema).parquet(table_path) if exists(spark, table_path) else batch.limit(0)
        fresh = new_posts(batch.withColumnRenamed(key, "source_id"), store.withColumnRenamed(key, "source_id"))
        fresh.withColumnRenamed("source_id", key).select(*batch.columns).write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
