"""Screening of numbers in tables, over whole corpora: histograms, tests against expected distributions, repeated cells,
constant ratios. All JVM-side; every aggregate combines before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def long_form(df: DataFrame, columns: list[str], value: str = "value", name: str = "column") -> DataFrame:
    """(column, value) rows of numeric columns: one pass over the table."""
    return df.unpivot([], columns, name, value).where(F.col(value).isNotNull())


def first_digit(value: Column) -> Column:
    """The first digit of a finite value of 1 or more, else null."""
    whole = F.when(value < 2.0**53, F.floor(value).cast("string")).otherwise(value.try_cast("decimal(38,0)").cast("string"))
    return F.when((value >= 1) & (value < 1e37), F.substring(whole, 1, 1).cast("int"))


def first_digit_histogram(values: DataFrame, by: str = "column") -> DataFrame:
    return values.select(by, first_digit(F.col("value")).alias("digit")).where("digit is not null").groupBy(by, "digit").agg(F.count("*").alias("n"))


def benford_test(values: DataFrame, by: str = "column") -> DataFrame:
    """Per group: n, chi2 against Benford's shares, largest deviation, and whether p is below .01."""
    counts = first_digit_histogram(values, by).groupBy(by).pivot("digit", list(range(1, 10))).agg(F.first("n"))
    n_of = [F.coalesce(F.col(str(d)), F.lit(0)) for d in range(1, 10)]
    n = sum(n_of[1:], n_of[0])
    with_n = counts.select(by, n.alias("n"), *[c.alias(f"c{d}") for d, c in enumerate(n_of, 1)])
    share = [F.lit(_log10(1 + 1 / d)) for d in range(1, 10)]
    expected = [F.col("n") * s for s in share]
    chi2 = sum(((F.col(f"c{d}") - expected[d - 1]) * (F.col(f"c{d}") - expected[d - 1]) / expected[d - 1] for d in range(2, 10)), (F.col("c1") - expected[0]) * (F.col("c1") - expected[0]) / expected[0])
    deviation = F.greatest(*[F.abs(F.col(f"c{d}") / F.col("n") - share[d - 1]) for d in range(1, 10)])
    return with_n.select(by, "n", chi2.alias("chi2"), deviation.alias("max_deviation")).withColumn("suspicious", F.col("chi2") > stats.CRITICAL_CHI2_DF8_01)


def _log10(x: float) -> float:
    import math

    return math.log10(x)


def last_digit_test(digits: DataFrame, by: str) -> DataFrame:
    """(by, digit) to chi2 of last digits against the uniform distribution, the share of 0 and 5, and the verdict."""
    counts = digits.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(10)])
    e = F.col("n") / 10
    terms = [(F.col(f"d{d}") - e) * (F.col(f"d{d}") - e) / e for d in range(10)]
    chi2 = sum(terms[1:], terms[0])
    share = (F.col("d0") + F.col("d5")) * 100.0 / F.col("n")
    enough = F.col("n") >= 20
    return counts.select(by, "n", F.when(enough, chi2).alias("chi2"), F.when(enough, share).alias("zero_five_pct")).withColumn(
        "suspicious", F.coalesce((F.col("chi2") > stats.CRITICAL_CHI2_DF9_05) | (F.col("zero_five_pct") > 35), F.lit(False))
    )


def decimals_of_scaled(scaled: Column, places: int) -> Column:
    """The decimals of a value given as a whole number of 10 ** -places, trailing zeros dropped."""
    out = F.lit(0)
    for k in range(1, places + 1):
        out = F.when(scaled % 10 ** (places - k + 1) != 0, k).otherwise(out)
    return out


def decimal_mode(decimals: DataFrame, by: str) -> DataFrame:
    """(by, decimals) to the most common number of decimals (ties: the least), its share, and whether that is 80%."""
    counts = decimals.groupBy(by, "decimals").agg(F.count("*").alias("k"))
    top = counts.groupBy(by).agg(F.sum("k").alias("n"), F.max(F.struct(F.col("k"), (-F.col("decimals")).alias("m"))).alias("t"))
    share = F.col("t.k") / F.col("n")
    return top.select(by, "n", (-F.col("t.m")).alias("mode_decimals"), share.alias("mode_share"), (share >= 0.8).alias("consistent"))


def ratio_pairs(columns: DataFrame, by: str, name: str, position: str, value: str) -> DataFrame:
    """All pairs of columns within a group whose index-aligned ratio hardly varies.

    A pair's rows meet on (group, position); pairs are formed there and aggregated, so a group's work is its columns
    squared times its rows, as the check asks, and no task sees more than a group's rows at one position at a time.
    """
    a = columns.select(by, F.col(name).alias("left_column"), F.col(position).alias("pos"), F.col(value).alias("x"))
    b = columns.select(by, F.col(name).alias("right_column"), F.col(position).alias("pos"), F.col(value).alias("y"))
    pairs = a.join(b, [by, "pos"]).where((F.col("left_column") < F.col("right_column")) & (F.col("x") != 0))
    r = F.col("y") / F.col("x")
    out = pairs.groupBy(by, "left_column", "right_column").agg(F.count("*").alias("n"), F.avg(r).alias("mean_ratio"), F.stddev_samp(r).alias("sd_ratio")).where("n >= 3")
    cv = F.col("sd_ratio") / F.abs("mean_ratio")
    return out.withColumn("cv", cv).withColumn("suspicious", (F.col("cv") < 0.01) & (F.col("n") >= 5)).drop("sd_ratio")


def identical_values(values: DataFrame, by: str, context: str, value: str = "value") -> DataFrame:
    """Values that occur in two contexts or more: grouped at 2, 3 and 4 decimals, each value at its highest precision."""
    keyed = values.select(by, F.col(context).alias("context"), F.col(value).alias("value"), F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("precision"))
    keyed = keyed.withColumn("key", F.rint(F.col("value") * F.pow(F.lit(10.0), F.col("precision"))).cast("long"))
    found = keyed.groupBy(by, "precision", "key").agg(F.count("*").alias("occurrences"), F.count_distinct("context").alias("contexts"), F.min("value").alias("value")).where("occurrences >= 2 and contexts >= 2")
    best = Window.partitionBy(by, "value").orderBy(F.desc("precision"))
    return found.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn", "key")


def is_sequence(values: DataFrame, keys: list[str], value: str = "value", tolerance: float = 0.05, short: bool = False) -> DataFrame:
    """(keys, is_sequence): three distinct values or more whose steps, as ratios or as differences, all lie within the
    tolerance of their mean. A zero ends the ratios, and what came before counts. ``short``: keys have few values each, which
    then move once instead of twice."""
    distinct = values.select(*keys, F.col(value).alias("v"))
    distinct = (distinct.repartition(*keys) if short else distinct).distinct()
    w = Window.partitionBy(*keys).orderBy("v")
    steps = distinct.withColumn("p", F.lag("v").over(w))
    zero = F.max((F.col("p") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("d", F.col("v") - F.col("p")).withColumn("r", F.when(F.coalesce(zero, F.lit(0)) == 0, F.col("v") / F.col("p")))
    stat = steps.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("d", "r") for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("k", F.count))])

    def steady(c):
        mean = F.col(f"mean_{c}")
        room = F.abs(mean) * tolerance
        return (F.col(f"k_{c}") >= 2) & (mean != 0) & (F.col(f"hi_{c}") - mean <= room) & (mean - F.col(f"lo_{c}") <= room)

    return stat.select(*keys, ((F.col("n") >= 3) & F.coalesce(steady("r") | steady("d"), F.lit(False))).alias("is_sequence"))


def repeated_cells(cells: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Values that repeat over rows and columns of a sheet, after what repeats for good reason is left out.

    Left out are: values next to zero; values as often as the sheet's template repeats (a count that holds for more than
    60% of values, above 100); values in more than 8 rows or in one column only; values in a column or row that is a
    sequence of parameters. ``cells``: sheet, row, col, value.
    """
    held = cells.where(F.col("value").isNotNull() & ((F.col("value") == 0) | (F.abs("value") >= 1e-10))).select(sheet, "value", "row", "col")
    # a value's rows are dealt out by value and an eighth of the rows, so that they meet without a second move and a value
    # that fills a sheet isn't one task's; what each eighth counts is added up then
    dealt = held.withColumn("part", F.hash(sheet, "value", F.pmod(F.hash("row"), F.lit(8)))).repartition("part")
    by_row = dealt.groupBy("part", sheet, "value", "row").agg(F.count("*").alias("n"), F.min("col").alias("low"), F.max("col").alias("high"))
    groups = by_row.groupBy(sheet, "value").agg(F.sum("n").alias("n"), F.count("row").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high")).where("n >= 2")
    # true of all groups: both uses need the same columns then, and Spark counts once; so it does only while no join adds a
    # filter to one of them
    groups = groups.where("n_rows >= 0 and (low <= high or low is null)")
    often = groups.groupBy(sheet, "n").agg(F.count("*").alias("k"))
    template = often.groupBy(sheet).agg(F.sum("k").alias("all"), F.max(F.struct("k", "n")).alias("t")).where((F.col("t.k") > 0.6 * F.col("all")) & (F.col("t.n") > 100)).select(F.col(sheet).alias("__sheet"), F.col("t.n").alias("__n"))
    repeats = F.col(sheet).isNotNull() & F.col(sheet).eqNullSafe(F.col("__sheet")) & (F.col("n") == F.col("__n"))
    # two columns or more where the least isn't the greatest; they are counted once few rows are left
    found = groups.where("n_rows <= 8 and low < high").join(template, repeats, "left_anti").select(F.col(sheet).alias("__sheet"), F.col("value").alias("__value"), "n", "n_rows")
    rounded = held.select(sheet, "row", "col", F.round("value", 4).alias("value"))
    columns = is_sequence(rounded, [sheet, "col"]).where("is_sequence").select(sheet, "col", F.lit(True).alias("in_column"))
    rows = is_sequence(rounded, [sheet, "row"], short=True).where("is_sequence").select(sheet, "row", F.lit(True).alias("in_row"))
    places = held.join(found, F.col(sheet).eqNullSafe(F.col("__sheet")) & (F.col("value") == F.col("__value"))).drop("__sheet", "__value")
    places = places.join(columns, [sheet, "col"], "left").join(rows, [sheet, "row"], "left")
    excused = F.max(F.coalesce("in_column", "in_row", F.lit(False)))
    out = places.groupBy(sheet, "value", "n", "n_rows").agg(F.size(F.collect_set("col")).cast("long").alias("n_cols"), excused.alias("excused"))
    return out.where("not excused").drop("excused")
