"""Wording rules as a table: the built-in ones, YAML files, and what the learning loop approved."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P

RULES = "kind string, category string, pattern string, rule_order int"


def built_in(spark: SparkSession) -> DataFrame:
    rows = [("hype", c, p) for c, p in P.HYPE] + [("camouflage", "camouflage", p) for p in P.CAMOUFLAGE]
    rows += [("fallacy", c, p) for c, p in P.FALLACIES] + [("normality", c, p) for c, p in P.NORMALITY]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], RULES)


def from_yaml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rules of a YAML file, by category or as a list of patterns; learned camouflage phrases are taken literally."""
    import yaml

    held = yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) or {}
    rows = []
    for category, items in held.items():
        for item in items or []:
            if isinstance(item, str):
                rows.append((category, item))
            elif "regex" in item:
                rows.append((category, item["regex"]))
            elif item.get("pattern"):
                rows.append((item.get("category", category), re.escape(item["pattern"]) if kind == "camouflage" else item["pattern"]))
    return spark.createDataFrame([(kind, c, p, 1000 + k) for k, (c, p) in enumerate(rows)], RULES)


def union(*parts: DataFrame) -> DataFrame:
    """All rules, each expression of a kind once: the earliest."""
    from functools import reduce

    from pyspark.sql import functions as F

    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("kind", "pattern").agg(F.min_by("category", "rule_order").alias("category"), F.min("rule_order").alias("rule_order")).select("kind", "category", "pattern", "rule_order")
