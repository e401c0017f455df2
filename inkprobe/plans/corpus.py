"""A corpus of papers written out of the orders table, for the checks' queries: the driver's documents hold none of what the
checks look for. Every text is made of whole numbers only, so Spark and DuckDB write the same bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One statement for both engines.
PAPERS_SQL = r"""
SELECT paper_id, title, abstract, methods, results, discussion,
       concat('Abstract', chr(10), abstract, chr(10), 'Methods', chr(10), methods, chr(10), 'Results', chr(10), results, chr(10), 'Discussion', chr(10), discussion) AS full_text
FROM (
  SELECT o_orderkey AS paper_id,
    concat('Compound ', cast(o_custkey % 50 AS string), CASE o_orderkey % 5 WHEN 0 THEN ' enhances repair' WHEN 1 THEN ' improves outcome' WHEN 2 THEN ' reduces load' ELSE ' in a model of disease' END) AS title,
    concat('We studied dose ', cast(1 + o_custkey % 9 AS string), '. ', CASE WHEN o_orderkey % 4 = 0 THEN 'It improved the response. ' ELSE 'It had effects. ' END, 'See 10.1234/abc', cast(o_custkey AS string), ' and 2', lpad(cast(o_custkey AS string), 7, '0'), '.') AS abstract,
    concat('Cells were cultured. n = ', cast(2 + o_orderkey % 9 AS string), ' mice per group. ',
      CASE WHEN o_orderkey % 6 = 0 THEN 'Western blot on PVDF membranes was done. ' ELSE '' END, CASE WHEN o_orderkey % 12 = 0 THEN 'GAPDH was the loading control. ' ELSE '' END,
      CASE o_orderkey % 10 WHEN 0 THEN 'All data were normally distributed. ' WHEN 3 THEN 'A normality test was performed. ' ELSE '' END,
      CASE WHEN o_orderkey % 7 < 3 THEN 'Means were compared by t-test. ' ELSE 'ANOVA was used. ' END, repeat('Samples were kept cold. ', cast(o_custkey % 40 AS int)),
      CASE WHEN o_orderkey % 3 = 0 THEN 'There were four groups. ' ELSE 'There were two arms. ' END) AS methods,
    concat('Group A: M = ', cast(1 + o_orderkey % 9 AS string), '.', lpad(cast((o_orderkey * 37) % 100 AS string), 2, '0'), ' ± 0.', lpad(cast(10 + o_custkey % 80 AS string), 2, '0'), ' (n = ', cast(3 + o_orderkey % 60 AS string), '). t(',
      cast(5 + o_orderkey % 30 AS string), ') = ', cast(cast(floor((o_custkey % 500) / 100) AS bigint) AS string), '.', lpad(cast((o_custkey % 500) % 100 AS string), 2, '0'), ', p = 0.', lpad(cast(1 + o_custkey % 999 AS string), 3, '0'), '. ',
      CASE WHEN o_orderkey % 3 = 0 THEN 'There was no significant difference in load (P > 0.05), therefore the dose is safe. ' ELSE '' END,
      CASE WHEN o_orderkey % 2 = 0 THEN concat('p = 0.04', cast(o_custkey % 10 AS string), ', p = 0.04', cast(o_orderkey % 10 AS string), ', p < 0.01, p < 0.05, p = 0.0', cast(1 + o_custkey % 8 AS string), '. ') ELSE '' END,
      CASE WHEN o_orderkey % 7 = 0 THEN 'It was marginally significant. ' ELSE '' END, CASE WHEN o_orderkey % 14 = 0 THEN 'Others approached significance. ' ELSE '' END) AS results,
    concat(CASE WHEN o_orderkey % 5 = 0 THEN 'This novel and remarkable work is a breakthrough. ' ELSE 'This work agrees with others. ' END,
      CASE WHEN o_orderkey % 15 = 0 THEN 'It is an unprecedented, outstanding, game-changing result. ' ELSE '' END, CASE WHEN o_orderkey % 11 = 0 THEN 'The results show no effect of age. ' ELSE '' END) AS discussion
  FROM orders
) made
"""

#: Check results written out of lineitem: one paper an order, one check a line. One statement for both engines.
CHECKS_SQL = r"""
SELECT l_orderkey AS paper_id, l_linenumber AS seq,
  CASE l_linenumber WHEN 1 THEN 'numbers.grim' WHEN 2 THEN 'numbers.statcheck' WHEN 3 THEN 'stats.p_hacking' WHEN 4 THEN 'text.blacklist' WHEN 5 THEN 'numbers.digit_pref' WHEN 6 THEN 'stats.sample_size' ELSE 'bioinfo.western_blot' END AS check_id,
  CASE l_partkey % 7 WHEN 0 THEN 'red' WHEN 1 THEN 'orange' WHEN 2 THEN 'yellow' WHEN 3 THEN 'error' ELSE 'green' END AS level,
  CASE WHEN l_suppkey % 3 = 0 THEN 0.95E0 ELSE 0.8E0 END AS confidence,
  CASE WHEN l_suppkey % 10 = 0 THEN -1 ELSE cast(1 + l_suppkey % 3 AS int) END AS page,
  CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE concat('mean of group g', cast(l_suppkey % 4 AS string), ' dose d', cast(l_partkey % 5 AS string), ' values v', cast(l_partkey % 2 AS string)) END AS excerpt,
  l_partkey % 7 IN (0, 1) AS needs_human
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) one
"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper an order. A text is hundreds of times an order's two numbers, so these are dealt out anew before: a file of a
    few MB would be one task otherwise."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = int(str(orders._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(2 * spark.sparkContext.defaultParallelism, size >> 20)
    return spark.sql(PAPERS_SQL.replace("FROM orders", "FROM {source}"), source=orders.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey"))


def check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHECKS_SQL.replace("FROM lineitem", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
