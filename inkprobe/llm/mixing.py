"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Shares: sources, ordered by name in code points with the null source last, weigh ``weights`` in turn. All sources
together hand out the total size. A source stops at ``max_epochs`` times its own size; what it can't take is handed to
the others in proportion to their weights, until none is above its cap. That end state is computed directly: with
sources in order of cap / weight, the first k are full, where k is the least number for which the water level of the
rest, (total - their caps) / (weights left), does not exceed the next ratio.

Sampling: a source's documents are put in a seeded order, by md5 of seed and id. Each is taken whole as often as the
target holds the whole source; the fraction that is left is taken once more from the documents at the head of that
order, the last of them in part, so each source's taken words are its target rounded down. The order's running sums
are formed per hash prefix first, so a source that holds a third of all rows is spread over ``2 ** 12`` groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty, whole_row, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source, so one task is enough."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", (max_epochs * F.col("source_size")).cast("long"))
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / weight_left.cast("double")
    levelled = ranked.withColumn("level", level)
    # ratios ascend, so the first level that fits under its own ratio is the water level
    water = F.min(F.struct(F.when(F.col("level") <= F.col("ratio"), F.col("ratio")).isNull(), "ratio", "level")).over(everyone)["level"]
    return levelled.withColumn("water", water).select(
        "source", "source_size", F.when(F.col("ratio") <= F.col("water"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, whole (repetitions), part (words of one more), taken.

    Null and empty texts have size 0 and nothing is taken. A null id takes part like any other; rows that repeat an id
    are ordered by size and then arbitrarily, which changes no sum. An empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(text_or_empty(text_col))).cast("long").alias("size"), key.alias("h")))
    rows = rows.withColumn("slot", F.substring("h", 1, 3))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    targets = source_targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("slot_start", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0)))
    targets = targets.withColumnRenamed("source", "t_source")
    slots = slots.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    slots = slots.withColumnsRenamed({"source": "s_source", "slot": "s_slot"})
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slot") == F.col("s_slot"))).drop("s_source", "s_slot")
    inside = Window.partitionBy("source", "slot").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("slot_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return rows.withColumn("part", part).select("id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix as rows of ``docs``: each as often as taken, a part counting as one more when it is half the text or more.

    Ids that occur more than once in ``docs`` must have equal texts, as after dedup; then each row stands for itself. A null
    id is one such id. Null and empty texts are never taken; an empty table gives an empty one.
    """
    m = mix(docs, id_col, **options)
    copies = m.where("size > 0").select(F.col("id").alias("__id"), (F.col("whole") + (2 * F.col("part") >= F.col("size")).cast("long")).cast("int").alias("__copies")).where("__copies > 0")
    copies = copies.groupBy("__id").agg(F.max("__copies").alias("__copies"))
    rows = docs.select(whole_row(docs).alias("__row"), F.col(id_col).alias("__doc"))
    found = rows.join(copies, F.col("__doc").eqNullSafe(F.col("__id")))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight, 3 * source_size AS cap FROM s
), r AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= water THEN CAST(cap AS DOUBLE) ELSE water * weight END AS target
  FROM (SELECT *, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1) AS water FROM l)
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), p AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole,
         CAST(floor(u.target) AS BIGINT) - u.whole * u.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM p
"""
