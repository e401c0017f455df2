"""What the operators of this subpackage share: tables, words, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, for trim() and translate().
SPACES = " \t\n\x0b\f\r"
#: The same as a Java regular expression.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns])


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, JVM-side; an empty array where there is none. Only texts with other white space than single spaces
    and line ends pay for a regular expression."""
    others = [c for c in SPACES if c not in " \n"]
    even = lambda s: F.when(reduce(Column.__or__, [s.contains(c) for c in ["  ", *others]]), F.trim(F.regexp_replace(s, SPACE_RUN, " "))).otherwise(s)
    split = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))
    return let(let(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), even), split)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir. Only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkprobe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/inkprobe/{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


#: Folders of the tables that stored() has written, in order.
MADE: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to shared storage and read back: it cuts lineage, survives lost executors and
    is computed once however often it is used."""
    spark = df.sparkSession
    path = shared_dir(spark)
    delete_at_exit(spark, path)
    MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What queries in here have shuffled is deleted once their rows are written, instead of when the driver collects garbage."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of at most 1,000 rows and 8 MB, since texts may be long; set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, store=stored) -> DataFrame:
    """(a, b) links to (node, root), root the smallest node reachable; nodes without a link are not listed. ``store`` writes a
    round's links, and the given ones first, so these needn't be stored before.

    Alternating large-star and small-star rounds, each a join and an aggregate over the links, stored in shared
    storage; nothing but the number of changed links comes to the driver. A hub's rows meet one row of its
    minimum in a join whose large side Spark can split. The rounds end: each that changes a link gives some node a smaller
    neighbour, and they are O(log^2 n) for n nodes.
    """
    a, b = F.col("a"), F.col("b")
    edges = store(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        both = edges.select("a", "b").unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        # Links from a local minimum to itself are none; each node keeps its link to the minimum around it.
        large = large.unionByName(low.select("a", F.col("m").alias("b"))).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where(a != b).distinct()
        after = store(small)
        # Each star's links point at its root: done when no root has a link of its own and no node has two.
        n = after.agg(F.count("*").alias("n"), F.count_distinct("a").alias("d")).first()
        roots_linked = after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi").limit(1).count()
        edges = after
        if n["n"] == n["d"] and not roots_linked:
            return edges.select(a.alias("node"), b.alias("root"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
