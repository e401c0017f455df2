"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text. DataFrame operations only.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Over all documents of the corpus their counts
make the raw multinomial; over all trusted documents, the target multinomial. The weight of a bucket is
log(target share / raw share), both smoothed. A document's score is the mean weight of its n-grams, so its length doesn't
matter, and it is rejected where the score lies more than ``DEVIATIONS`` standard deviations of the trusted documents'
scores below their mean. Everything is a function of the tables' rows, so reruns agree.

Trusted are all documents labelled good and not toxic; none is left out of the counts or the threshold. The ``BUCKETS``
weights are sent to every task; the trusted ids, whose number grows with the corpus, are not. They meet the texts by an exchange
on the id, once, for the counts, and the scores by another; the scores' pass and the threshold move no text.

Before the method, base rules reject texts of few words and texts that mostly repeat themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, stored, table, text_or_empty, whole_row, words_of

BUCKETS = 1 << 14
SCALE = 1 << 30
DEVIATIONS = 6.0
SMOOTHING = 1.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # of 100 words
WINDOW = 3


def _tail(array: Column, at: int) -> Column:
    """The array from its ``at``-th element (from 1)."""
    return F.slice(array, at, F.greatest(F.size(array) - (at - 1), F.lit(0)))


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (words) with pairs: the hash of each word and its next one. Stages are projections of their own, since an
    array that an expression names twice would be made twice."""
    rows = rows.withColumn("pairs", F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1))))
    return rows.withColumn("pairs", F.slice("pairs", 1, F.greatest(F.size("pairs") - 1, F.lit(0))))


def bucket(h: Column, buckets: int) -> Column:
    """The bucket of a hash; ``buckets`` is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def repeated_words(rows: DataFrame) -> DataFrame:
    """``rows`` (words, pairs) with n_repeat_words: the words in 3-word windows that occur twice or more in the text."""
    # two pairs that follow each other are a window; the last pair begins none
    rows = rows.withColumn("__h", F.transform("pairs", lambda h, i: F.xxhash64(h, F.get(F.col("pairs"), i + 1))))
    rows = rows.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("__h") - 1, F.lit(0))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__p", F.when(F.size(F.array_distinct("__h")) == F.size("__h"), none).otherwise(placed))
    # neighbours in order of hash that are equal: both places
    both = F.zip_with("__p", _tail(F.col("__p"), 2), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("__q", F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))))
    # each place covers three words, less what the next one covers too
    covers = F.zip_with("__q", _tail(F.col("__q"), 2), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return rows.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0), lambda acc, x: acc + x).cast("long")).drop("__h", "__p", "__q")


def repeated_lines(text: Column) -> Column:
    """The number of lines with a word that equal an earlier line."""
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda s: F.btrim(s, F.lit(SPACES)) != "")
    some = F.contains(text, F.lit("\n")) & (F.size(F.array_distinct(lines)) < F.size(lines))
    return F.when(some, F.size(full) - F.size(F.array_distinct(full))).otherwise(0).cast("long")


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (text not null, words, pairs) with the base rules' columns."""
    text, words = F.col("text"), F.col("words")
    symbol = "[" + SYMBOLS.replace("&", r"\&") + "]"
    out = rows.withColumns(
        {
            "n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.when(text.rlike(symbol), F.regexp_count(text, F.lit(symbol))).otherwise(0).cast("long"), "n_dup_lines": repeated_lines(text),
        }
    )
    out = repeated_words(out)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id) of all labelled-good, not toxic documents, each once."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("id")).distinct()


def ngram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Each bucket's log(target share / raw share), from all documents; ``buckets`` numbers, whatever the corpus holds."""
    # the ids are hashed, so the texts need no sort; words are made after the join, since an exchange would carry them as arrays
    ids = trusted.select(F.col("id").alias("t_id")).hint("shuffle_hash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # null ids match nothing; the second equality, true of all others, deals them by text instead of to one task
    rows = rows.join(ids, (F.col("id") == F.col("t_id")) & (F.coalesce("id", F.xxhash64("text")) == F.col("t_id")), "left")
    rows = rows.select(words_of(text_or_empty("text")).alias("words"), F.col("t_id").isNotNull().cast("int").alias("target"))
    # rows of a word and the next one: hashing and counting them is compiled code, unlike functions of an array's elements
    pairs = F.arrays_zip(F.col("words").alias("w"), _tail(F.col("words"), 2).alias("next"))
    each = rows.select("target", F.inline(pairs)).select("target", F.array(bucket(F.xxhash64("w"), buckets), F.when(F.col("next").isNotNull(), bucket(F.xxhash64("w", "next"), buckets))).alias("grams"))
    counts = each.select("target", F.explode("grams").alias("bucket")).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():  # at most `buckets` rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    from math import log

    all_raw, all_target = sum(raw) + SMOOTHING * buckets, sum(target) + SMOOTHING * buckets
    return [log((t + SMOOTHING) / all_target) - log((r + SMOOTHING) / all_raw) for r, t in zip(raw, target)]


def with_score(rows: DataFrame, weights: list[float]) -> DataFrame:
    """``rows`` (words, pairs) with score, the mean weight of a text's n-grams; null without any."""
    known = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")  # folded to one literal when planned
    weight = lambda h: F.get(known, bucket(h, len(weights)))
    total = F.aggregate("words", F.lit(0.0), lambda acc, w: acc + weight(F.xxhash64(w))) + F.aggregate("pairs", F.lit(0.0), lambda acc, h: acc + weight(h))
    n = F.size("words") + F.size("pairs")
    return rows.withColumn("score", F.when(n > 0, total / n))


def threshold(rows: DataFrame, trusted: DataFrame, deviations: float) -> float:
    """The score from which on a document is kept, from the trusted ones among ``rows`` (id, base_failed, score). Sums are
    of scores as whole numbers of 2 ** -30, so they are the same in any order of the rows."""
    scaled = F.round(F.col("score") * F.lit(float(SCALE))).cast("long")
    good = rows.where(~F.col("base_failed")).join(trusted.hint("shuffle_hash"), "id", "left_semi").select(scaled.cast("decimal(19,0)").alias("s"))
    got = good.agg(F.count("s").alias("n"), F.sum("s").alias("sum"), F.sum(F.col("s") * F.col("s")).alias("squares")).first()
    if not got["n"]:
        return float("-inf")
    n, total, squares = got["n"], int(got["sum"]), int(got["squares"])
    return (total / n - deviations * (n * squares - total * total) ** 0.5 / n) / SCALE


def verdict(rows: DataFrame, trusted: DataFrame, deviations: float) -> DataFrame:
    """``rows`` (id, base_failed, score; stored) with kept."""
    least = threshold(rows, trusted, deviations)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= F.lit(least)))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", deviations: float = DEVIATIONS) -> DataFrame:
    """One row per row of ``docs``: id, the base columns, base_failed, score, kept.

    Null text has no words and fails the base rules. Without any trusted document the method rejects nothing. Null ids are
    never trusted; rows that repeat stay as they are, each judged alike.
    """
    trusted = stored(trusted_ids(labels))
    weights = ngram_weights(docs, trusted, id_col, text_col)
    # partitions as they come: no text is moved to be scored
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = with_score(features(hashed(rows.withColumn("words", words_of(F.col("text"))))), weights)
    return verdict(stored(rows.drop("text", "words", "pairs")), trusted, deviations)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", deviations: float = DEVIATIONS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and no others. The rows that pass the base rules are
    stored with their scores until the threshold is known; texts move between tasks only to be counted. Those that fail are emptied
    rather than filtered out, since a filter would be pushed below the arrays' projections and make each array anew. Null, empty
    and wordless texts go, as do texts of few words; rows that repeat are judged alike; an empty table gives an empty one."""
    trusted = stored(trusted_ids(labels))
    weights = ngram_weights(docs, trusted, id_col, text_col)
    whole = whole_row(docs).alias("__row")
    rows = docs.select(whole, F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = with_score(features(hashed(rows.withColumn("words", words_of(F.col("text"))))), weights)
    rows = stored(rows.select(F.when(~F.col("base_failed"), F.col("__row")).alias("__row"), "id", "base_failed", "score"))
    return verdict(rows, trusted, deviations).where("kept").select("__row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
