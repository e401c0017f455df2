"""Secret scans with corpus-wide ownership frequency. DataFrame operations only.

Candidates are spans of a text that look like secrets, in four kinds:

- ``assign``: a name such as password or api_key, a separator and a value of 6 characters or more;
- ``access``: AKIA and capital letters and digits, 20 characters or more;
- ``hex``: 24 lower-case hex digits or more;
- ``issued``: forms that issuers give their keys (prefixes of public services, signed web tokens, private key heads).

The first three are the base: they are always reported. ``issued`` candidates are what the method adds, by ownership: each
candidate's value is hashed, and over the corpus its distinct repositories and distinct owners are counted, first per
(value, owner) and then per value, so that a value which a third of all documents hold is reduced before it moves. A
value held by more than ``MAX_OWNERS`` owners, or by more than one and over ``MAX_REPOSITORIES`` repositories, is a widely
copied example; any other is specific to its owner and looks live, however often its owner repeats it. Added spans are only
the live-looking ones; for base spans the verdict is told beside, as counts of copied and owner-specific candidates.

Positions come from the regular expression engine without a user function: splitting a text at a pattern gives the gaps
between its matches, and the running sum of gaps and matches is each match's place. Texts without a match pay one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty

#: Fixed patterns (Java). In ``assign`` the value is what the base rule measures.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "issued": r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----",
}
KINDS = tuple(PATTERNS)
BASE = KINDS[:3]
#: Of an ``assign`` match, all that stands before its value.
BEFORE_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
MIN_VALUE = 6
MAX_OWNERS = 2
MAX_REPOSITORIES = 20
SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def spans(text: Column, kind: str) -> Column:
    """The spans of one kind: leftmost, not overlapping, in code points, end exclusive."""
    pattern, no = PATTERNS[kind], KINDS.index(kind)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(F.split(text, pattern), 1, 1_000_000_000).alias("g"))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, p):
        start = acc["at"] + F.length(p["g"])
        end = start + F.coalesce(F.length(p["m"]), F.lit(0))
        value = F.regexp_replace(p["m"], BEFORE_VALUE, "") if kind == "assign" else p["m"]
        span = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(no).alias("kind"), value.alias("value")))
        fits = p["m"].isNotNull() & ((F.length(value) >= MIN_VALUE) if kind == "assign" else F.lit(True))
        return F.struct(end.cast("bigint").alias("at"), F.when(fits, F.concat(acc["out"], span)).otherwise(acc["out"]).cast(SPAN).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, begin, step)["out"]).otherwise(F.array().cast(SPAN))


def shown(of: Column) -> Column:
    """kind:start:end of spans, comma-joined, by start and then kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    by_place = F.array_sort(F.transform(of, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(by_place, lambda s: F.concat(kinds[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(rid, id, repository, owner, found): every row's candidates, values hashed; stored, as the texts are read once."""
    text = text_or_empty(text_col)
    each = F.concat(*[spans(F.col("text"), k) for k in KINDS])
    hidden = F.transform(each, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.unhex(F.sha2(s["value"], 256)).alias("value")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    return stored(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "repository", "owner", hidden.alias("found")))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, repositories, owners) of (value, repository, owner) rows; null counts as a name of its own."""
    known = candidates.select("value", F.coalesce("repository", F.lit("\0")).alias("repository"), F.coalesce("owner", F.lit("\0")).alias("owner")).distinct()
    by_repository = known.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    by_owner = known.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    return by_repository.join(by_owner, "value")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row of ``docs``: id, found (all candidates), spans (reported: base and live-looking added ones), n_copied.

    ``found`` and ``spans`` are arrays of (start, end, kind, value): kind by its place in KINDS, value a SHA-256. ``n_copied``
    counts candidates whose value is widely copied. Null texts are empty and a null owner is an owner; rows that repeat an id count
    as one repository; an empty table gives an empty one. Of ``docs`` only the named columns are read.
    """
    rows = scan(docs, id_col, text_col, repository_col, owner_col)
    single = rows.where(F.size("found") > 0).select("rid", "repository", "owner", F.explode("found").alias("s"))
    single = single.select("rid", "repository", "owner", "s", F.col("s.value").alias("value"))
    frequency = ownership(single).select("value", ((F.col("owners") > max_owners) | ((F.col("owners") > 1) & (F.col("repositories") > max_repositories))).alias("copied"))
    judged = single.join(frequency, "value")
    reported = (F.col("s.kind") < len(BASE)) | ~F.col("copied")
    # a row's own candidates, no more than its text holds
    by_row = judged.groupBy("rid").agg(F.collect_list(F.when(reported, F.col("s"))).alias("spans"), F.count_if("copied").alias("n_copied"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,value:binary>>")
    return rows.join(by_row, "rid", "left").select("id", "found", F.coalesce("spans", empty).alias("spans"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def is_kind(kind: str):
    no = KINDS.index(kind)
    return lambda s: s["kind"] == no


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = [F.size(F.filter("found", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("id").alias("doc_id"), *count, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), "n_copied", (F.size("found") - F.col("n_copied")).cast("long").alias("n_specific"))


def _found_sql(kind: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    return f"SELECT doc_id, source, {KINDS.index(kind)} AS no, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM t WHERE regexp_matches(text, '{pattern}')"


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(map(_found_sql, KINDS))}),
each AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found),
placed AS (
  SELECT doc_id, source, no, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start FROM each
),
spans AS (
  SELECT doc_id, source, no, start, start + length(m) AS until, CASE WHEN no = 0 THEN regexp_replace(m, '{BEFORE_VALUE.replace("'", "''")}', '') ELSE m END AS value FROM placed
),
kept AS (SELECT * FROM spans WHERE no <> 0 OR length(value) >= {MIN_VALUE}),
owned AS (
  SELECT value, owners > {MAX_OWNERS} OR (owners > 1 AND repositories > {MAX_REPOSITORIES}) AS copied
  FROM (SELECT value, count(DISTINCT doc_id) AS repositories, count(DISTINCT source) + CAST(count(*) > count(source) AS INT) AS owners FROM kept GROUP BY value)
),
shown AS (
  SELECT k.*, [{", ".join(f"'{k}'" for k in KINDS)}][no + 1] || ':' || start || ':' || until AS s, no < {len(BASE)} AS base, copied FROM kept k JOIN owned o ON k.value = o.value
)
SELECT t.doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, no) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, no) FILTER (base OR NOT copied), '') AS spans,
       count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT copied) AS n_specific
FROM t LEFT JOIN shown ON t.doc_id = shown.doc_id GROUP BY t.doc_id
"""
