"""Exact dedup by a tree-merge of sorted digest runs. DataFrame operations only.

Each input partition makes one run: its digests, sorted, with the smallest row of each. Runs then merge in binomial
rounds: in every round the runs whose numbers agree but for the lowest bits meet (``fan_in`` at a time), are merged by
a sort-based aggregate, and each digest keeps its smallest row and its count. A digest that a third of all rows share
enters a round once per run, not once per row. The way back goes down the same tree, so no join has a hot key either:
a parent's entry meets ``fan_in`` children at most, and a run's entry meets the rows of its own partition.

Entries are equal when SHA-256, byte length and XXH64 of the normalised text all agree; that is the verification made
at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, stored, table, text_or_empty, whole_row

KEY = ["digest", "bytes", "check"]
FAN_IN_BITS = 4


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Texts of single spaces only, the usual case, skip the regex."""
    odd = text.contains("  ") | (F.translate(text, SPACES[1:], "") != text)
    return F.when(odd, F.regexp_replace(text, SPACE_RUN, " ")).otherwise(text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, rid, run, digest, bytes, check) of every row: rid names the row, run its partition; with ``whole``, also row."""
    rid = F.monotonically_increasing_id()
    row = [whole_row(docs).alias("row")] if whole else []
    return (
        docs.select(*row, F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("norm"))
        .select(*(["row"] if whole else []), "id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("bytes"), F.xxhash64("norm").alias("check"), rid.alias("rid"))
        .withColumn("run", F.shiftright("rid", 33))
    )


def _merge(runs: DataFrame, bits: int) -> DataFrame:
    """One round: runs that agree above their ``bits`` lowest bits become one, each digest with its smallest row."""
    return (
        runs.groupBy(F.shiftright("run", bits).alias("run"), *KEY)
        .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        .sortWithinPartitions("run", *KEY)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per row of ``docs``: id, digest (binary), keep_id, group_size, kept, row_of_id.

    Null text is empty text. Of equal texts the row with the smallest id stays, null ids last; of rows that tie even
    there, exactly one. ``docs`` may have any other columns and may be empty; only the two named are read.
    """
    found, rows = _verdicts(docs, id_col, text_col, fan_in_bits)
    out = rows.withColumnRenamed("run", "up").join(found, ["up", *KEY])
    return out.select("id", "digest", "bytes", "check", F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, fan_in_bits: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(up, digest, bytes, check, keep, group_size): what each run's entries learn from the root; and the rows, stored."""
    rows = stored(digests(docs, id_col, text_col, whole))
    best = F.struct(F.col("id").isNull().alias("null_id"), F.col("id"), F.col("rid"))
    runs = rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n")).sortWithinPartitions("run", *KEY)
    levels = []
    top = rows.agg(F.max("run")).first()[0] or 0
    while top:
        levels.append(stored(runs))
        runs = _merge(levels[-1], fan_in_bits)
        top >>= fan_in_bits
    # the root's verdict goes down again: each entry learns it from its parent, each row from its run
    found = runs.select(F.col("run").alias("up"), *KEY, F.col("best").alias("keep"), F.col("n").alias("group_size"))
    for level in reversed(levels):
        child = level.select("run", *KEY, F.shiftright("run", fan_in_bits).alias("up"))
        found = child.join(found, ["up", *KEY]).select(F.col("run").alias("up"), *KEY, "keep", "group_size")
    return found, rows


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others: of equal texts the row with the smallest id, null
    ids last, of rows that tie even there exactly one. Null text is empty text; an empty table gives an empty one. Rows are
    stored whole and learn from the tree whether they stay, so no key but a run's digest brings them together."""
    found, rows = _verdicts(docs, id_col, text_col, FAN_IN_BITS, whole=True)
    out = rows.withColumnRenamed("run", "up").join(found, ["up", *KEY])
    return out.where(F.col("rid") == F.col("keep.rid")).select("row.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    g = exact_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
