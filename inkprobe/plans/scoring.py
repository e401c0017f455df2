"""From check results to a paper's risk: veto, correlation of signals, weights, cap and floor, ranking, leaderboard.

Everything groups by paper, whose results are about twenty rows: the correlation of signals is computed inside a paper's
array, so one shuffle by paper serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.joins import jaccard, tokens

SIGNALS = tuple(P.SCORES)


def ordinal(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P.LEVELS.items() for x in kv]), level), F.lit(0))


def weight(check_id: Column, extra: dict[str, float] | None = None) -> Column:
    known = P.WEIGHTS | (extra or {})
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), check_id), F.lit(P.DEFAULT_WEIGHT))


def score(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P.SCORES.items() for x in kv]), level), F.lit(0))


def level_counts(results: DataFrame) -> DataFrame:
    """One row per paper with the number of results of each level."""
    return results.groupBy("paper_id").agg(*[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in P.LEVELS], F.count("*").alias("n_checks"))


def level_of(total: Column) -> Column:
    return F.when(total >= 51, "red").when(total >= 31, "orange").when(total >= 16, "yellow").otherwise("green")


def paper_risk(results: DataFrame, extra_weights: dict[str, float] | None = None) -> DataFrame:
    """One row per paper: level counts, risk_score, overall_level, veto, cluster_bonus, floor_applied, contributions.

    ``results``: paper_id, check_id, level, confidence, page (int, -1 where unknown), excerpt (text, empty where unknown),
    seq (the order of results). A paper is one group of some twenty results.
    """
    signal = F.col("level").isin(*SIGNALS)
    row = F.struct("seq", "check_id", "level", "page", tokens(F.col("excerpt")).alias("words"), weight(F.col("check_id"), extra_weights).alias("w"), score(F.col("level")).alias("s"))
    veto = F.col("check_id").isin(*P.VETO) & (F.col("level") == "red") & (F.col("confidence") >= 0.9)
    counts = [F.count_if(F.col("level") == x).alias(f"n_{x}") for x in P.LEVELS]
    grouped = results.groupBy("paper_id").agg(*counts, F.count("*").alias("n_checks"), F.max(veto).alias("veto"), F.array_sort(F.collect_list(F.when(signal, row))).alias("signals"))

    def correlated(x, i):
        others = F.filter("signals", lambda y, j: (j != i) & (F.abs(y["page"] - x["page"]) <= 1))
        same = lambda y: (y["page"] == x["page"]) & (jaccard(x["words"], y["words"]) >= 0.3)
        near = lambda y: jaccard(x["words"], y["words"]) >= 0.15
        return F.when(F.exists(others, same), 1.5).when(F.exists(others, near), 1.2).otherwise(1.0)

    def contribution(x, i):
        c = correlated(x, i)
        return F.struct(x["check_id"].alias("check_id"), x["level"].alias("level"), c.alias("correlation"), F.round(x["s"] * x["w"] * c, 2).alias("contribution"))

    with_c = grouped.withColumn("contributions", F.when(F.col("veto"), F.array()).otherwise(F.transform("signals", contribution)).cast("array<struct<check_id:string,level:string,correlation:double,contribution:double>>"))
    clustered = F.size(F.filter("contributions", lambda c: c["correlation"] > 1))
    bonus = F.when(clustered >= 5, 20).when(clustered >= 3, 10).otherwise(0)
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["contribution"]) + bonus
    capped = F.least(total, F.lit(100.0))
    floor = F.when(F.col("n_red") > 0, 51.0).when(F.col("n_orange") > 0, 31.0).otherwise(0.0)
    risk = F.when(F.col("veto"), 100.0).otherwise(F.greatest(capped, floor))
    return with_c.withColumn("cluster_bonus", F.when(F.col("veto"), 0).otherwise(bonus)).withColumn("floor_applied", ~F.col("veto") & (capped < floor)).withColumn("risk_score", F.round(risk, 2)).withColumn(
        "overall_level", F.when(F.col("veto"), "red").otherwise(level_of(risk))
    ).drop("signals")


def human_review(results: DataFrame, extra_weights: dict[str, float] | None = None) -> DataFrame:
    """The results that need a person, ranked within a paper by what they weigh; results that are no signal score 5."""
    base = F.when(score(F.col("level")) == 0, 5).otherwise(score(F.col("level")))
    rows = results.where("needs_human").withColumn("contribution", F.round(base * weight(F.col("check_id"), extra_weights), 2))
    return rows.withColumn("review_rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("contribution"), "seq")))


def leaderboard(counts: DataFrame, most: int | None = None) -> DataFrame:
    """Papers by their number of red, then orange, then yellow results; failures last; the paper's id breaks ties.

    With ``most`` it is a top-k report, taken without a global sort. Without, the papers of equal counts are ranked among
    themselves and then behind all groups before theirs; the largest group of equal counts is one task's.
    """
    order = [F.col("failed"), F.desc("n_red"), F.desc("n_orange"), F.desc("n_yellow"), F.col("paper_id")]
    rows = counts.withColumn("failed", F.coalesce(F.col("n_checks"), F.lit(0)) == 0)
    if most is not None:
        top = rows.orderBy(*order).limit(most)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("failed")
    # equal triples are one group: the number of papers before a group, then the place within it
    triple = ["failed", "n_red", "n_orange", "n_yellow"]
    groups = rows.groupBy(*triple).agg(F.count("*").alias("k"))
    before = Window.orderBy("failed", F.desc("n_red"), F.desc("n_orange"), F.desc("n_yellow")).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("ahead", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    inside = Window.partitionBy(*triple).orderBy("paper_id")
    return rows.withColumn("place", F.row_number().over(inside)).join(groups, triple).withColumn("rank", F.col("ahead") + F.col("place")).drop("ahead", "place", "failed")
