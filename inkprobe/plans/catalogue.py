"""The registered queries of the checks and operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import stats
from ..operators import checks, extract, joins, numeric
from ..streaming import incremental
from . import knowledge, scoring
from .corpus import CHECKS_SQL, PAPERS_SQL, check_rows, papers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WITH_PAPERS = f"WITH papers AS ({PAPERS_SQL})"
WITH_CHECKS = f"WITH checks AS ({CHECKS_SQL})"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- numbers in tables ---------------------------------------------------------------------------------------------


def amounts(spark, sf_dir) -> DataFrame:
    parts = [("lineitem", "l_extendedprice"), ("orders", "o_totalprice"), ("events", "value")]
    out = None
    for t, c in parts:
        rows = table(spark, sf_dir, t).select(F.lit(c).alias("column"), F.col(c).alias("value")).where("value is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


AMOUNTS = "amounts AS (SELECT 'l_extendedprice' AS col, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders UNION ALL SELECT 'value', value FROM events WHERE value IS NOT NULL)"
DIGITS = "digits AS (SELECT col, CAST(substr(CAST(CAST(floor(value) AS HUGEINT) AS VARCHAR), 1, 1) AS INTEGER) AS digit FROM amounts WHERE value >= 1)"


@query(f'WITH {AMOUNTS}, {DIGITS} SELECT col AS "column", digit, count(*) AS n FROM digits GROUP BY ALL')
def first_digit_histogram(spark, sf_dir):
    """First digits of amounts."""
    return numeric.first_digit_histogram(amounts(spark, sf_dir))


@query(
    f"""WITH {AMOUNTS}, {DIGITS}, c AS (SELECT col, digit, count(*) AS k FROM digits GROUP BY ALL), t AS (SELECT col, sum(k) AS n FROM c GROUP BY col),
    g AS (SELECT t.col, t.n, r.d, coalesce(c.k, 0) AS k, t.n * log10(1 + 1.0 / r.d) AS e FROM t CROSS JOIN (SELECT unnest(range(1, 10)) AS d) r LEFT JOIN c ON c.col = t.col AND c.digit = r.d)
    SELECT col AS "column", CAST(n AS BIGINT) AS n, round(sum((k - e) * (k - e) / e), 6) AS chi2, round(max(abs(k - e) / n), 9) AS max_deviation, sum((k - e) * (k - e) / e) > {stats.CRITICAL_CHI2_DF8_01!r} AS suspicious FROM g GROUP BY col, n"""
)
def benford_by_column(spark, sf_dir):
    """A4: first digits of each column against Benford's law."""
    return numeric.benford_test(amounts(spark, sf_dir)).withColumn("chi2", F.round("chi2", 6)).withColumn("max_deviation", F.round("max_deviation", 9))


CENTS = "SELECT l_returnflag AS grp, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem"


def _cents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


@query(
    f"""WITH c AS (SELECT grp, CASE WHEN cents % 10 <> 0 THEN cents % 10 WHEN cents % 100 <> 0 THEN CAST(floor(cents / 10) AS BIGINT) % 10 ELSE CAST(floor(cents / 100) AS BIGINT) % 10 END AS digit FROM ({CENTS})),
    d AS (SELECT grp, digit, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT grp, sum(k) AS n FROM d GROUP BY grp),
    g AS (SELECT t.grp, t.n, r.x, coalesce(d.k, 0) AS k, t.n / 10.0 AS e FROM t CROSS JOIN (SELECT unnest(range(0, 10)) AS x) r LEFT JOIN d ON d.grp = t.grp AND d.digit = r.x),
    s AS (SELECT grp, n, sum((k - e) * (k - e) / e) AS chi2, sum(CASE WHEN x IN (0, 5) THEN k ELSE 0 END) * 100.0 / n AS share FROM g GROUP BY grp, n)
    SELECT grp, CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2, round(share, 6) AS zero_five_pct, chi2 > {stats.CRITICAL_CHI2_DF9_05!r} OR share > 35 AS suspicious FROM s"""
)
def last_digit_preference(spark, sf_dir):
    """A2: last digits that remain when trailing zeros are dropped."""
    c = F.col("cents")
    digit = F.when(c % 10 != 0, c % 10).when(c % 100 != 0, F.floor(c / 10) % 10).otherwise(F.floor(c / 100) % 10)
    out = numeric.last_digit_test(_cents(spark, sf_dir).select("grp", digit.alias("digit")), "grp")
    return out.withColumn("chi2", F.round("chi2", 6)).withColumn("zero_five_pct", F.round("zero_five_pct", 6))


@query(
    f"""WITH d AS (SELECT grp, CASE WHEN cents % 10 <> 0 THEN 2 WHEN cents % 100 <> 0 THEN 1 ELSE 0 END AS decimals FROM ({CENTS})), c AS (SELECT grp, decimals, count(*) AS k FROM d GROUP BY ALL),
    t AS (SELECT grp, CAST(sum(k) AS BIGINT) AS n, arg_max(decimals, k * 10 - decimals) AS mode_decimals, max(k) AS top FROM c GROUP BY grp)
    SELECT grp, n, mode_decimals, CAST(top AS DOUBLE) / n AS mode_share, CAST(top AS DOUBLE) / n >= 0.8 AS consistent FROM t"""
)
def decimal_consistency(spark, sf_dir):
    """A3: the most common number of decimals and its share."""
    return numeric.decimal_mode(_cents(spark, sf_dir).select("grp", numeric.decimals_of_scaled(F.col("cents"), 2).alias("decimals")), "grp")


@query(
    """WITH s AS (SELECT l_suppkey AS grp, l_linenumber AS col, month(l_shipdate) AS pos, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
    p AS (SELECT a.grp, a.col AS left_column, b.col AS right_column, b.v / a.v AS r FROM s a JOIN s b ON a.grp = b.grp AND a.pos = b.pos AND a.col < b.col WHERE a.v <> 0),
    g AS (SELECT grp, left_column, right_column, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM p GROUP BY ALL HAVING count(*) >= 3)
    SELECT grp, left_column, right_column, n, round(m, 6) AS mean_ratio, round(sd / abs(m), 6) AS cv, sd / abs(m) < 0.01 AND n >= 5 AS suspicious FROM g"""
)
def ratio_cv_pairs(spark, sf_dir):
    """Index-aligned ratios of all pairs of a supplier's monthly series."""
    li = table(spark, sf_dir, "lineitem")
    series = li.groupBy(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("col"), F.month("l_shipdate").alias("pos")).agg(F.sum("l_quantity").alias("v"))
    return numeric.ratio_pairs(series, "grp", "col", "pos", "v").withColumn("mean_ratio", F.round("mean_ratio", 6)).withColumn("cv", F.round("cv", 6))


@query(
    """WITH v AS (SELECT o_orderpriority AS grp, o_orderstatus AS context, CAST(o_custkey % 1000 AS DOUBLE) / 8 AS value FROM orders),
    k AS (SELECT grp, context, value, p AS precision, round_even(value * pow(10.0, p), 0) AS key FROM v, (SELECT unnest([2, 3, 4]) AS p)),
    g AS (SELECT grp, precision, key, count(*) AS occurrences, count(DISTINCT context) AS contexts, min(value) AS value FROM k GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT context) >= 2)
    SELECT grp, CAST(precision AS INTEGER) AS precision, occurrences, contexts, value FROM g QUALIFY row_number() OVER (PARTITION BY grp, value ORDER BY precision DESC) = 1"""
)
def identical_values_precision(spark, sf_dir):
    """Values that occur in several contexts, at their highest precision."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("context"), ((F.col("o_custkey") % 1000).cast("double") / 8).alias("value"))
    return numeric.identical_values(rows, "grp", "context")


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 40).alias("sheet"), F.col("l_orderkey").alias("row"),
        F.explode(F.array(F.struct(F.lit(1).alias("col"), ((F.col("l_partkey") * 7919 + F.col("l_linenumber")) % 100003).cast("double").alias("value")), F.struct(F.lit(2).alias("col"), ((F.col("l_suppkey") * 104729 + F.col("l_partkey")) % 100003).cast("double").alias("value")))).alias("c"),
    ).select("sheet", "row", "c.col", "c.value")


CELLS = """cells AS (SELECT l_orderkey % 40 AS sheet, l_orderkey AS row, c AS col, CAST(CASE c WHEN 1 THEN (l_partkey * 7919 + l_linenumber) % 100003 ELSE (l_suppkey * 104729 + l_partkey) % 100003 END AS DOUBLE) AS value
  FROM lineitem, (SELECT unnest([1, 2]) AS c))"""
STEPS = """d_{k} AS (SELECT DISTINCT sheet, {k} AS key, value AS v FROM cells), s_{k} AS (SELECT sheet, key, v, lag(v) OVER w AS p FROM d_{k} WINDOW w AS (PARTITION BY sheet, key ORDER BY v)),
r_{k} AS (SELECT sheet, key, v - p AS d, CASE WHEN coalesce(max(CASE WHEN p = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet, key ORDER BY v ROWS UNBOUNDED PRECEDING), 0) = 0 THEN v / p END AS r FROM s_{k}),
seq_{k} AS (SELECT sheet, key FROM r_{k} GROUP BY sheet, key HAVING count(*) >= 3 AND (
  coalesce(count(r) >= 2 AND avg(r) <> 0 AND max(r) - avg(r) <= abs(avg(r)) * 0.05 AND avg(r) - min(r) <= abs(avg(r)) * 0.05, false)
  OR coalesce(count(d) >= 2 AND avg(d) <> 0 AND max(d) - avg(d) <= abs(avg(d)) * 0.05 AND avg(d) - min(d) <= abs(avg(d)) * 0.05, false)))"""


@query(
    f"""WITH {CELLS}, g AS (SELECT sheet, value, count(*) AS n, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols FROM cells GROUP BY ALL HAVING count(*) >= 2),
    o AS (SELECT sheet, n, count(*) AS k FROM g GROUP BY ALL), t AS (SELECT sheet, n FROM o QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY k DESC, n DESC) = 1 AND k > 0.6 * sum(k) OVER (PARTITION BY sheet) AND n > 100),
    {STEPS.format(k="col")}, {STEPS.format(k="row")},
    f AS (SELECT g.* FROM g LEFT JOIN t ON g.sheet = t.sheet AND g.n = t.n WHERE t.n IS NULL AND n_rows <= 8 AND n_cols >= 2)
    SELECT sheet, value, n, n_rows, n_cols FROM f WHERE NOT EXISTS (SELECT 1 FROM cells c JOIN seq_col q ON q.sheet = c.sheet AND q.key = c.col WHERE c.sheet = f.sheet AND c.value = f.value)
    AND NOT EXISTS (SELECT 1 FROM cells c JOIN seq_row q ON q.sheet = c.sheet AND q.key = c.row WHERE c.sheet = f.sheet AND c.value = f.value)"""
)
def cell_duplicates_filtered(spark, sf_dir):
    """Cells that repeat over rows and columns, after what repeats for good reason is left out."""
    return numeric.repeated_cells(_cells(spark, sf_dir)).select("sheet", "value", "n", "n_rows", "n_cols")


@query(
    f"""WITH cells AS (SELECT p_brand AS sheet, p_size AS col, CAST(CASE WHEN p_size % 3 = 0 THEN p_partkey % 6 * p_size ELSE p_retailprice END AS DOUBLE) AS value FROM part), {STEPS.format(k="col")}
    SELECT DISTINCT c.sheet, c.col, q.key IS NOT NULL AS is_sequence FROM cells c LEFT JOIN seq_col q ON q.sheet = c.sheet AND q.key = c.col"""
)
def sequence_columns(spark, sf_dir):
    """Columns whose distinct values go up in even steps."""
    v = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey") % 6 * F.col("p_size")).otherwise(F.col("p_retailprice")).cast("double")
    return numeric.is_sequence(table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), F.col("p_size").alias("col"), v.alias("value")), ["sheet", "col"])


# --- papers --------------------------------------------------------------------------------------------------------


@query(
    WITH_PAPERS + r""", f AS (SELECT paper_id, CAST(regexp_extract(results, 'M = ([0-9]+[.][0-9]+) ±', 1) AS DOUBLE) AS mean, CAST(regexp_extract(results, 'n = ([0-9]+)[)]', 1) AS INTEGER) AS n FROM papers)
    SELECT paper_id, mean, n, abs(mean * n - round_even(mean * n, 0)) <= greatest(CAST(0.01 AS DOUBLE) * n, CAST(0.01 AS DOUBLE)) AS consistent FROM f"""
)
def grim_check(spark, sf_dir):
    """Whether a mean is possible for its n."""
    rows = papers(spark, sf_dir).select("paper_id", F.regexp_extract("results", r"M = ([0-9]+[.][0-9]+) ±", 1).cast("double").alias("mean"), F.regexp_extract("results", r"n = ([0-9]+)[)]", 1).cast("int").alias("n"))
    return rows.withColumn("consistent", checks.grim_column(F.col("mean"), F.col("n")))


@query(WITH_PAPERS + r" SELECT paper_id, t[1] AS df1, t[2] AS value, t[3] AS comparison, t[4] AS p FROM (SELECT paper_id, regexp_extract(results, 't[(]([0-9]+)[)] = ([0-9]+[.]?[0-9]*), p ([<>=]) ([0-9.]+[0-9])', ['a', 'b', 'c', 'd']) AS m FROM papers) x, (SELECT 1) y, LATERAL (SELECT [m.a, m.b, m.c, m.d] AS t)")
def statcheck_extract(spark, sf_dir):
    """P10: reported t statistics."""
    pattern = r"t[(]([0-9]+)[)] = ([0-9]+[.]?[0-9]*), p ([<>=]) ([0-9.]+[0-9])"
    return papers(spark, sf_dir).select("paper_id", *[F.regexp_extract("results", pattern, k).alias(a) for k, a in enumerate(("df1", "value", "comparison", "p"), 1)])


@query(WITH_PAPERS + r" SELECT paper_id, substr(x, 1, 1) AS comparison, regexp_extract(x, '[0-9]+[.][0-9]+') AS p FROM (SELECT paper_id, unnest(list_transform(regexp_extract_all(full_text, '[pP]\s*[<>=≤≥]\s*[0-9]+[.][0-9]+'), lambda m: trim(substr(m, 2)))) AS x FROM papers)")
def pvalue_extract(spark, sf_dir):
    """P-values with their comparison."""
    return papers(spark, sf_dir).select("paper_id", F.explode(extract.p_values(F.col("full_text"))).alias("x")).select("paper_id", "x.comparison", "x.p")


@query(
    WITH_PAPERS + r""", e AS (SELECT paper_id, list_transform(regexp_extract_all(full_text, '[pP]\s*=\s*([0-9]+[.][0-9]+)', 1), lambda x: CAST(x AS DOUBLE)) AS v, len(regexp_extract_all(full_text, '[pP]\s*[<≤]\s*[0-9]+[.][0-9]+')) AS n_below FROM papers)
    SELECT paper_id, n_below, CAST(len(v) AS BIGINT) AS n_exact, CAST(len(list_filter(v, lambda x: x < 0.001)) AS BIGINT) AS below_001, CAST(len(list_filter(v, lambda x: x >= 0.01 AND x < 0.04)) AS BIGINT) AS from_01_to_04,
    CAST(len(list_filter(v, lambda x: x >= 0.04 AND x < 0.05)) AS BIGINT) AS from_04_to_05, CAST(len(list_filter(v, lambda x: x >= 0.05 AND x < 0.06)) AS BIGINT) AS from_05_to_06, CAST(len(list_filter(v, lambda x: x >= 0.06)) AS BIGINT) AS above_06 FROM e"""
)
def p_curve(spark, sf_dir):
    """A10: exact p-values along the curve."""
    rows = papers(spark, sf_dir).select("paper_id", extract.p_values(F.col("full_text")).alias("x"))
    rows = rows.select("paper_id", F.size(F.filter("x", lambda x: x["comparison"].isin("<", "≤"))).cast("long").alias("n_below"), F.transform(F.filter("x", lambda x: x["comparison"] == "="), lambda x: x["p"].cast("double")).alias("v"))
    inside = lambda low, high: F.size(F.filter("v", lambda x: (x >= low) & (x < high))).cast("long")
    return rows.select(
        "paper_id", "n_below", F.size("v").cast("long").alias("n_exact"), inside(-1, 0.001).alias("below_001"), inside(0.01, 0.04).alias("from_01_to_04"), inside(0.04, 0.05).alias("from_04_to_05"), inside(0.05, 0.06).alias("from_05_to_06"),
        inside(0.06, 1e300).alias("above_06"),
    )


@query(
    WITH_PAPERS + r""", e AS (SELECT paper_id, unnest(list_transform(regexp_extract_all(full_text, '[pP]\s*=\s*([0-9]+[.][0-9]+)', 1), lambda x: CAST(round(CAST(x AS DECIMAL(9, 6)) * 100) AS INTEGER))) AS hundredths FROM papers),
    c AS (SELECT paper_id, hundredths, count(*) AS k FROM e GROUP BY ALL) SELECT paper_id, hundredths, k, row_number() OVER (PARTITION BY paper_id ORDER BY k DESC, hundredths) AS place FROM c QUALIFY place <= 3"""
)
def p_value_modes(spark, sf_dir):
    """The three most common p-values of a paper, rounded to two decimals."""
    from pyspark.sql import Window

    each = papers(spark, sf_dir).select("paper_id", F.explode(F.regexp_extract_all("full_text", F.lit(r"[pP]\s*=\s*([0-9]+[.][0-9]+)"), F.lit(1))).alias("p"))
    counts = each.groupBy("paper_id", F.round(F.col("p").cast("decimal(9,6)") * 100).cast("int").alias("hundredths")).agg(F.count("*").alias("k"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("k"), "hundredths")).cast("long")).where("place <= 3")


def _hits(spark, sf_dir, text, rules):
    n = sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in rules[1:]), F.regexp_count(text, F.lit(f"(?i){rules[0]}")))
    return papers(spark, sf_dir).select("paper_id", n.cast("long").alias("hits"))


def _sql_hits(text: str, rules: list[str]) -> str:
    return " + ".join("len(regexp_extract_all({}, '(?i){}'))".format(text, p.replace("'", "''").replace("\\'", "'")) for p in rules)


HYPE = [rf"\b{p}\b" for _, p in P.HYPE]


@query(f"{WITH_PAPERS}, h AS (SELECT paper_id, {_sql_hits('discussion', HYPE)} AS hits FROM papers) SELECT paper_id, hits, CASE WHEN hits >= 5 THEN 'orange' WHEN hits >= 3 THEN 'yellow' ELSE 'green' END AS level FROM h")
def blacklist_hits(spark, sf_dir):
    """C11: words of overstatement."""
    return _hits(spark, sf_dir, F.col("discussion"), HYPE).withColumn("level", F.when(F.col("hits") >= 5, "orange").when(F.col("hits") >= 3, "yellow").otherwise("green"))


@query(f"{WITH_PAPERS}, h AS (SELECT paper_id, {_sql_hits('(results || chr(10) || discussion)', P.CAMOUFLAGE)} AS hits FROM papers) SELECT paper_id, hits, CASE WHEN hits >= 2 THEN 'red' WHEN hits >= 1 THEN 'orange' ELSE 'green' END AS level FROM h")
def camouflage_hits(spark, sf_dir):
    """Phrases that dress up a p-value."""
    return _hits(spark, sf_dir, F.concat_ws("\n", "results", "discussion"), P.CAMOUFLAGE).withColumn("level", F.when(F.col("hits") >= 2, "red").when(F.col("hits") >= 1, "orange").otherwise("green"))


def _worst(spark, sf_dir, text, rules):
    level = F.lit("green")
    for name in ("yellow", "orange", "red"):
        for p in [p for x, p in rules if x == name]:
            level = F.when(text.rlike(f"(?i){p}"), name).otherwise(level)
    return papers(spark, sf_dir).select("paper_id", level.alias("level"))


def _sql_worst(text: str, rules) -> str:
    ranked = sorted(rules, key=lambda r: -P.LEVELS[r[0]])
    return "CASE " + " ".join("WHEN regexp_matches({}, '(?i){}') THEN '{}'".format(text, p.replace("\\'", "'").replace("'", "''"), x) for x, p in ranked) + " ELSE 'green' END"


@query(f"{WITH_PAPERS} SELECT paper_id, {_sql_worst('(results || chr(10) || discussion)', P.FALLACIES)} AS level FROM papers")
def fallacy_hits(spark, sf_dir):
    """Absence of evidence taken as evidence of absence."""
    return _worst(spark, sf_dir, F.concat_ws("\n", "results", "discussion"), P.FALLACIES)


@query(f"{WITH_PAPERS} SELECT paper_id, {_sql_worst('methods', P.NORMALITY)} AS level FROM papers")
def normality_hits(spark, sf_dir):
    """C14: claims that data are normal."""
    return _worst(spark, sf_dir, F.col("methods"), P.NORMALITY)


@query(WITH_PAPERS + " SELECT paper_id, CASE WHEN NOT regexp_matches(methods, '(?i)western\\s*blot|PVDF|immunoblot') THEN 'green' WHEN regexp_matches(methods, '(?i)GAPDH|loading\\s*control|actin') THEN 'green' ELSE 'red' END AS level FROM papers")
def western_blot_control(spark, sf_dir):
    """Blots without a loading control."""
    return checks.western_blot(papers(spark, sf_dir)).select(F.col("paper_id").cast("long").alias("paper_id"), "level")


@query(
    WITH_PAPERS + r""", g AS (SELECT paper_id, regexp_matches(title, '(?i)\b(enhance[sd]?|enhancing|improve[sd]?|improving|overcome[sd]?|overcoming|synergi(ze[sd]?|stic|sm))\b') AS t, regexp_matches(abstract, '(?i)\b(enhance[sd]?|enhancing|improve[sd]?|improving|overcome[sd]?|overcoming|synergi(ze[sd]?|stic|sm))\b') AS a,
    CASE WHEN regexp_matches(results, '(?i)no\s+significant\s+difference') THEN 3 ELSE 0 END AS nulls FROM papers)
    SELECT paper_id, CASE WHEN (t AND nulls > 0) OR (a AND nulls > 0) THEN 'red' ELSE 'green' END AS level FROM g"""
)
def title_conclusion_gap(spark, sf_dir):
    """Claims of effect beside null results."""
    return checks.title_conclusion_gap(papers(spark, sf_dir)).select(F.col("paper_id").cast("long").alias("paper_id"), "level")


@query(
    WITH_PAPERS + """, h AS (SELECT paper_id, full_text, unnest([{'s': 'abstract', 'm': 'Abstract'}, {'s': 'methods', 'm': 'Methods'}, {'s': 'results', 'm': 'Results'}, {'s': 'discussion', 'm': 'Discussion'}]) AS x FROM papers),
    p AS (SELECT paper_id, full_text, x.s AS section, strpos(chr(10) || full_text, chr(10) || x.m || chr(10)) AS pos, length(x.m) AS n FROM h),
    e AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY paper_id ORDER BY pos), length(full_text) + 1) AS until FROM p WHERE pos > 0)
    SELECT paper_id, section, CAST(pos - 1 AS INTEGER) AS start, md5(trim(substr(full_text, pos + n + 1, until - pos - n - 1), ' ' || chr(10))) AS body_md5 FROM e"""
)
def section_segments(spark, sf_dir):
    """Sections by their headings, each up to the next."""
    return extract.sections(papers(spark, sf_dir)).select("paper_id", "section", F.col("start").cast("int").alias("start"), F.md5(F.btrim("body", F.lit(" \n"))).alias("body_md5"))


@query(
    WITH_PAPERS + """, a AS (SELECT paper_id, strpos(methods, 't-test') AS pos FROM papers WHERE strpos(methods, 't-test') > 0), b AS (SELECT paper_id, strpos(methods, 'four groups') AS pos FROM papers WHERE strpos(methods, 'four groups') > 0)
    SELECT a.paper_id, CAST(a.pos AS INTEGER) AS pos, CAST(min(b.pos) AS INTEGER) AS other_pos FROM a JOIN b ON a.paper_id = b.paper_id AND abs(a.pos - b.pos) < 500 GROUP BY a.paper_id, a.pos"""
)
def method_misuse_proximity(spark, sf_dir):
    """A t-test and several groups within 500 characters."""
    p = papers(spark, sf_dir)
    at = lambda s: p.select("paper_id", F.instr("methods", s).alias("pos")).where("pos > 0")
    return joins.first_nearby(at("t-test"), at("four groups"), "paper_id", 500)


@query(WITH_PAPERS + r" SELECT paper_id, regexp_extract(abstract, '10[.][0-9]{4,}/[a-z0-9]+') AS doi, regexp_extract(abstract, ' ([0-9]{8})[.]', 1) AS pmid FROM papers")
def doi_pmid_extract(spark, sf_dir):
    """Identifiers."""
    return papers(spark, sf_dir).select("paper_id", F.element_at(extract.dois(F.col("abstract")), 1).alias("doi"), F.element_at(extract.pmids(F.col("abstract")), 1).alias("pmid"))


@query()
def statcheck_recomputed(spark, sf_dir):
    """The check of reported against recomputed p-values."""
    return checks.statcheck(papers(spark, sf_dir)).select("paper_id", "level", "verdict")


@query()
def sample_size_critical_d(spark, sf_dir):
    """Sample sizes with the least difference they can show."""

    @F.pandas_udf("double")
    def critical(n):
        return n.map(stats.critical_d)

    n = papers(spark, sf_dir).select("paper_id", F.regexp_extract("methods", r"n = (\d+)", 1).cast("int").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("papers")).withColumn("critical_d", critical("n"))


@query()
def all_checks(spark, sf_dir):
    """Every check of every paper of the written corpus."""
    return checks.run_checks(papers(spark, sf_dir)).select("paper_id", "check_id", "level", "verdict", "confidence", "needs_human")


# --- scores --------------------------------------------------------------------------------------------------------

LEVELS_SQL = ", ".join(f"count_if(level = '{x}') AS n_{x}" for x in P.LEVELS)
WEIGHT_SQL = "CASE check_id " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in P.WEIGHTS.items()) + f" ELSE CAST({P.DEFAULT_WEIGHT} AS DOUBLE) END"
SCORE_SQL = "CASE level WHEN 'red' THEN 25 WHEN 'orange' THEN 12 WHEN 'yellow' THEN 5 ELSE 0 END"
STOP_SQL = ", ".join(f"'{w}'" for w in P.STOPWORDS)


@query(f"{WITH_CHECKS} SELECT paper_id, {LEVELS_SQL.replace('count_if', 'count_if')}, count(*) AS n_checks FROM checks GROUP BY paper_id")
def level_pivot(spark, sf_dir):
    """A1: results by level."""
    return scoring.level_counts(check_rows(spark, sf_dir))


@query(
    f"""{WITH_CHECKS}, w AS (SELECT *, {WEIGHT_SQL} AS wt, {SCORE_SQL} AS sc, list_distinct(list_filter(regexp_extract_all(lower(excerpt), '[\\w.]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP_SQL}))) AS words FROM checks),
    s AS (SELECT * FROM w WHERE sc > 0), v AS (SELECT paper_id, max(check_id IN ('numbers.grim', 'numbers.arithmetic') AND level = 'red' AND confidence >= 0.9) AS veto, {LEVELS_SQL}, count(*) AS n_checks FROM checks GROUP BY paper_id),
    p AS (SELECT x.paper_id, x.seq, max(CASE WHEN y.seq IS NULL OR len(x.words) = 0 OR len(y.words) = 0 THEN 1.0 WHEN x.page = y.page AND len(list_intersect(x.words, y.words)) / CAST(len(list_distinct(list_concat(x.words, y.words))) AS DOUBLE) >= 0.3 THEN 1.5
      WHEN len(list_intersect(x.words, y.words)) / CAST(len(list_distinct(list_concat(x.words, y.words))) AS DOUBLE) >= 0.15 THEN 1.2 ELSE 1.0 END) AS corr
      FROM s x LEFT JOIN s y ON x.paper_id = y.paper_id AND x.seq <> y.seq AND abs(x.page - y.page) <= 1 GROUP BY ALL),
    c AS (SELECT s.paper_id, sum(round(s.sc * s.wt * CAST(p.corr AS DOUBLE), 2)) AS total, count_if(p.corr > 1) AS k FROM s JOIN p ON s.paper_id = p.paper_id AND s.seq = p.seq GROUP BY s.paper_id),
    r AS (SELECT v.*, CASE WHEN veto THEN 0 WHEN coalesce(k, 0) >= 5 THEN 20 WHEN coalesce(k, 0) >= 3 THEN 10 ELSE 0 END AS cluster_bonus, coalesce(total, 0) AS total, CASE WHEN n_red > 0 THEN 51.0 WHEN n_orange > 0 THEN 31.0 ELSE 0.0 END AS fl FROM v LEFT JOIN c ON v.paper_id = c.paper_id),
    z AS (SELECT *, CASE WHEN veto THEN 100.0 ELSE greatest(least(total + cluster_bonus, 100.0), fl) END AS risk FROM r)
    SELECT paper_id, veto, cluster_bonus, NOT veto AND least(total + cluster_bonus, 100.0) < fl AS floor_applied, CAST(round(risk, 2) AS DOUBLE) AS risk_score, CASE WHEN veto OR risk >= 51 THEN 'red' WHEN risk >= 31 THEN 'orange' WHEN risk >= 16 THEN 'yellow' ELSE 'green' END AS overall_level FROM z"""
)
def risk_score(spark, sf_dir):
    """Veto, correlation, weights, cap and floor."""
    return scoring.paper_risk(check_rows(spark, sf_dir)).select("paper_id", "veto", "cluster_bonus", "floor_applied", "risk_score", "overall_level")


@query(
    f"""{WITH_CHECKS}, c AS (SELECT paper_id, seq, check_id, level, round((CASE WHEN {SCORE_SQL} = 0 THEN 5 ELSE {SCORE_SQL} END) * {WEIGHT_SQL}, 2) AS contribution FROM checks WHERE needs_human)
    SELECT paper_id, check_id, level, contribution, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY contribution DESC, seq) AS INTEGER) AS review_rank FROM c"""
)
def human_review_rank(spark, sf_dir):
    """What a person should look at first."""
    return scoring.human_review(check_rows(spark, sf_dir)).select("paper_id", "check_id", "level", "contribution", "review_rank")


@query(f"{WITH_CHECKS}, c AS (SELECT paper_id, {LEVELS_SQL}, count(*) AS n_checks FROM checks GROUP BY paper_id) SELECT paper_id, n_red, n_orange, n_yellow, row_number() OVER (ORDER BY n_red DESC, n_orange DESC, n_yellow DESC, paper_id) AS rank FROM c")
def corpus_leaderboard(spark, sf_dir):
    """Papers by their red, orange and yellow results."""
    return scoring.leaderboard(scoring.level_counts(check_rows(spark, sf_dir))).select("paper_id", "n_red", "n_orange", "n_yellow", F.col("rank").cast("long").alias("rank"))


@query(
    f"""{WITH_CHECKS}, w AS (SELECT paper_id, seq, list_distinct(list_filter(regexp_extract_all(lower(excerpt), '[\\w.]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP_SQL}))) AS words FROM checks WHERE excerpt <> '')
    SELECT a.paper_id, a.seq AS seq_a, b.seq AS seq_b, round(len(list_intersect(a.words, b.words)) / CAST(len(list_distinct(list_concat(a.words, b.words))) AS DOUBLE), 6) AS similarity FROM w a JOIN w b ON a.paper_id = b.paper_id AND a.seq < b.seq"""
)
def excerpt_jaccard_pairs(spark, sf_dir):
    """How alike the excerpts of a paper's results are."""
    return joins.excerpt_pairs(check_rows(spark, sf_dir).where("excerpt <> ''"))


# --- posts and pages -----------------------------------------------------------------------------------------------


def _posts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("source_id"), F.substring("text", 1, 40).alias("title"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"), F.col("source"), F.lpad(F.col("n_chars").cast("string"), 9, "0").alias("date"), F.col("text").alias("content"))


POSTS = "posts AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, substr(text, 1, 40) AS title, 'http://x/' || doc_id AS url, source, lpad(CAST(n_chars AS VARCHAR), 9, '0') AS date, text AS content FROM documents)"


def _patterns(spark, sf_dir):
    r = table(spark, sf_dir, "labels")
    return r.select(F.col("doc_id").alias("pattern_id"), (F.col("doc_id") * 2).cast("string").alias("post_id"), (F.col("quality") - F.col("toxic")).cast("int").alias("reviewed"))


PATTERNS = "patterns AS (SELECT doc_id AS pattern_id, CAST(doc_id * 2 AS VARCHAR) AS post_id, CAST(quality - toxic AS INTEGER) AS reviewed FROM labels)"


@query(f"WITH {POSTS}, {PATTERNS} SELECT p.pattern_id, p.post_id, o.title AS post_title, o.url AS post_url FROM patterns p LEFT JOIN posts o ON p.post_id = o.source_id WHERE reviewed = 0")
def posts_pending_leftjoin(spark, sf_dir):
    """Patterns that wait for review, beside their posts."""
    return knowledge.pending(_patterns(spark, sf_dir), _posts(spark, sf_dir)).select("pattern_id", "post_id", "post_title", "post_url")


@query(f"WITH {POSTS}, {PATTERNS} SELECT source_id, date FROM posts WHERE source_id NOT IN (SELECT DISTINCT post_id FROM patterns WHERE post_id IS NOT NULL)")
def posts_unlearned_antijoin(spark, sf_dir):
    """Posts that nothing was learned from yet."""
    return knowledge.unlearned(_posts(spark, sf_dir), _patterns(spark, sf_dir), most=None).select("source_id", "date")


@query(f"WITH {POSTS} SELECT source_id, date FROM posts WHERE source_id NOT IN (SELECT CAST(doc_id * 2 AS VARCHAR) FROM labels) ORDER BY date DESC, source_id LIMIT 20")
def posts_unlearned_latest(spark, sf_dir):
    """The 20 latest of them, as a learning run takes them."""
    return knowledge.unlearned(_posts(spark, sf_dir), _patterns(spark, sf_dir)).select("source_id", "date")


@query(f"WITH {POSTS} SELECT source_id FROM posts WHERE regexp_matches(lower(title || ' ' || content), '(^|[^a-z0-9_à-ÿ])the([^a-z0-9_à-ÿ]|$)') AND regexp_matches(lower(title || ' ' || content), '(^|[^a-z0-9_à-ÿ])and([^a-z0-9_à-ÿ]|$)')")
def posts_search_semi(spark, sf_dir):
    """Posts that hold all words of a search."""
    return knowledge.search(_posts(spark, sf_dir), "the and").select("source_id")


@query(f"WITH {POSTS}, {PATTERNS} SELECT 'posts_of_source' AS measure, source, count(*) AS n FROM posts GROUP BY source UNION ALL SELECT 'posts', NULL, count(*) FROM posts UNION ALL SELECT 'pending', NULL, count(*) FROM patterns WHERE reviewed = 0")
def store_statistics(spark, sf_dir):
    """The store in numbers."""
    return knowledge.statistics(_posts(spark, sf_dir), _patterns(spark, sf_dir))


@query("SELECT CAST(event_id AS VARCHAR) AS source_id, event_type FROM events WHERE event_id % 2 = 1")
def insert_if_absent(spark, sf_dir):
    """K6: rows that the store (here: events of even number) lacks."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source_id"), "event_id", "event_type")
    return knowledge.new_posts(e, e.where("event_id % 2 = 0")).select("source_id", "event_type")


@query("SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_tolerant_parse(spark, sf_dir):
    """A record from a reply with text around it."""
    reply = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\n"))).otherwise(F.concat(F.lit("It is "), F.col("props"), F.lit(" as asked")))
    return table(spark, sf_dir, "events").select("event_id", extract.tolerant_json(reply, "page string")["page"].alias("page"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS a, html FROM pages),
    s AS (SELECT page_id, regexp_replace(CASE WHEN a = '' THEN html ELSE a END, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g') AS s FROM a),
    t AS (SELECT page_id, regexp_replace(s, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g') AS t FROM s),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS e FROM t)
    SELECT page_id, md5(trim(regexp_replace(e, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS text_md5 FROM e"""
)
def html_article_text(spark, sf_dir):
    """The text of a page's article."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(extract.article_text(F.col("html"))).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 12000 THEN md5(substr(text, 1, 8400) || chr(10) || '...' || chr(10) || right(text, 3600)) ELSE md5(text) END AS cut_md5 FROM documents")
def long_text_cut(spark, sf_dir):
    """Head and tail of a text that is too long for a prompt."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(extract.head_and_tail(F.col("text"))).alias("cut_md5"))


@query(
    """WITH k AS (SELECT p_partkey, CASE WHEN p_partkey < 26 THEN 1 WHEN p_partkey < 702 THEN 2 WHEN p_partkey < 18278 THEN 3 WHEN p_partkey < 475254 THEN 4 WHEN p_partkey < 12356630 THEN 5 ELSE 6 END AS k FROM part)
    SELECT p_partkey, array_to_string(list_transform(range(k), lambda j: chr(CAST(65 + (p_partkey - [0, 26, 702, 18278, 475254, 12356630][k]) // CAST(power(26, k - 1 - j) AS BIGINT) % 26 AS INTEGER))), '') AS letters FROM k"""
)
def spreadsheet_letters(spark, sf_dir):
    """The letters of a spreadsheet's columns."""
    return table(spark, sf_dir, "part").select("p_partkey", extract.column_letters(F.col("p_partkey")).alias("letters"))


# --- images --------------------------------------------------------------------------------------------------------


def _blocks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20 * 10 + F.col("l_linenumber")).alias("image"), (F.col("l_partkey") % 40 * 16).cast("int").alias("x"), (F.col("l_suppkey") % 30 * 16).cast("int").alias("y"), (F.col("l_partkey") % 97 * 31 + F.col("l_orderkey") % 7).alias("hash")).distinct()


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey % 20 * 10 + l_linenumber AS image, CAST(l_partkey % 40 * 16 AS INTEGER) AS x, CAST(l_suppkey % 30 * 16 AS INTEGER) AS y, l_partkey % 97 * 31 + l_orderkey % 7 AS hash FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY image, hash ORDER BY y, x) AS rn FROM b QUALIFY rn <= 100),
    p AS (SELECT a.image, a.x AS x1, a.y AS y1, c.x AS x2, c.y AS y2 FROM k a JOIN k c ON a.image = c.image AND a.hash = c.hash AND a.rn < c.rn WHERE abs(a.x - c.x) >= 16 OR abs(a.y - c.y) >= 16),
    g AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image, x1 // 32, y1 // 32, x2 // 32, y2 // 32 ORDER BY y1, x1, y2, x2) = 1)
    SELECT image, x1, y1, x2, y2 FROM g QUALIFY row_number() OVER (PARTITION BY image ORDER BY y1, x1, y2, x2) <= 50"""
)
def clone_hash_pairs(spark, sf_dir):
    """Blocks of an image with one hash."""
    return joins.equal_hash_pairs(_blocks(spark, sf_dir), "image", 16).select("image", "x1", "y1", "x2", "y2")


@query()
def figure_rect_merge(spark, sf_dir):
    """Rectangles of a page merged until none touch."""
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") * 7 % 800
    rects = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000 * 10 + F.col("l_linenumber")).alias("page"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 60).cast("double").alias("x1"), (y + 60).cast("double").alias("y1"))
    return joins.merged_rectangles(rects)


# --- streaming -----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def incremental_posts_stream(spark, sf_dir):
    """K6 as a stream: each user's first event, kept once however often files come in."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = shared_folder(spark)
    firsts = source.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("event_type")).select(F.col("user_id").cast("string").alias("source_id"), "event_type")
    firsts.write.parquet(f"{base}/incoming")
    stream = incremental.read_files(spark, f"{base}/incoming", firsts.schema)
    for k in range(2):  # the second run finds nothing new
        incremental.insert_if_absent(stream, f"{base}/store", f"{base}/state{k}").awaitTermination()
    return spark.read.schema(firsts.schema).parquet(f"{base}/store")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when Spark ends; a local session may do without the setting."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkprobe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
