"""Projections of text to facts: sections, identifiers, p-values, names. JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def sections(papers: DataFrame, text: str = "full_text", names=P.SECTIONS) -> DataFrame:
    """One row per section found: (paper_id, section, start, body). A section begins at the first line that is its name,
    ends where the next one begins; places count characters from 0."""
    heads = F.array(*[F.struct(F.regexp_instr(F.col(text), F.lit(rf"(?im)^[ \t]*{n}[ \t]*:?[ \t]*$")).alias("at"), F.lit(n).alias("section")) for n in names])
    found = papers.select("paper_id", F.col(text).alias("t"), F.array_sort(F.filter(heads, lambda h: h["at"] > 0)).alias("h"))
    one = found.select("paper_id", "t", F.posexplode("h").alias("k", "head"), "h")
    end = F.coalesce(F.get("h", F.col("k") + 1)["at"], F.length("t") + 1)
    body = F.substring(F.col("t"), F.col("head.at"), end - F.col("head.at"))
    return one.select("paper_id", "head.section", (F.col("head.at") - 1).alias("start"), F.trim(F.regexp_replace(body, r"^[^\n]*\n?", "")).alias("body"))


def p_values(text: Column) -> Column:
    """An array of (comparison, p)."""
    pattern = F.lit(P.P_VALUE)
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("comparison"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("p"))


def dois(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(P.DOI), F.lit(0)))


def pmids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(P.PMID), F.lit(0)))


def article_text(html: Column) -> Column:
    """The text of a page's first article, else of the whole page: without scripts and styles, tags as spaces, white space
    collapsed."""
    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(article == "", html).otherwise(article)
    plain = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(plain, r"[ \t\n\x0b\f\r]+", " "))


def head_and_tail(text: Column, most: int = 12_000) -> Column:
    """The first 70% and the last 30% of what is allowed, of a text that is longer."""
    head, tail = most * 7 // 10, most * 3 // 10
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail)))).otherwise(text)


def safe_name(title: Column) -> Column:
    """A title as a file name."""
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", "_"), F.lit("_.")), 1, 80)


def column_letters(index: Column) -> Column:
    """The letters of a spreadsheet column, from 0: A, Z, AA. Null for null and below 0."""
    start = F.struct(index.cast("bigint").alias("n"), F.lit("").alias("s"))

    # digits of base 26 without a zero, from the last one; 14 of them hold any bigint
    def step(acc, _):
        n = acc["n"]
        left = F.floor(n.cast("decimal(20,0)") / 26).cast("bigint") - 1
        return F.when(n < 0, acc).otherwise(F.struct(left.alias("n"), F.concat(F.char(n % 26 + 65), acc["s"]).alias("s")))

    return F.nullif(F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["s"], F.lit(""))


def tolerant_json(text: Column, schema: str) -> Column:
    """A record from text that should be JSON: as it is, else a fenced block, else from the first brace to the last."""
    parse = lambda c: F.from_json(F.when(F.btrim(c).startswith("{"), c), schema)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(parse(text), parse(fenced), parse(braced))


#: What makes a paragraph worth showing to a reviewer. Fixed values.
EVIDENCE_WORDS = ("n=", "n =", "p<", "p <", "p=", "p =", "p>", "p >", "mice", "cells", "patients", "triplicate", "sd", "sem", "western", "loading", "biological", "independent", "experiment", "replicate")


def evidence_paragraphs(text: Column, most: int = 3000, words=EVIDENCE_WORDS) -> Column:
    """The paragraphs that hold one of the words, in order, as far as a budget of characters goes: a running sum over them.
    What is left of the budget, if above 200, goes to a part of the first paragraph that does not fit."""
    any_word = "|".join(w.replace("(", r"\(") for w in words)
    held = F.transform(F.filter(F.split(text, "\n\n"), lambda p: F.lower(p).rlike(any_word)), lambda p: F.btrim(p, F.lit(" \t\n\r")))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc, p):
        left = most - F.length(acc["out"])
        fits = F.length(p) + 2 <= left
        part = F.when(left > 200, F.concat(acc["out"], F.substring(p, F.lit(1), left), F.lit("..."))).otherwise(acc["out"])
        out = F.when(acc["full"], acc["out"]).when(fits, F.concat(acc["out"], p, F.lit("\n\n"))).otherwise(part)
        return F.struct(out.alias("out"), (acc["full"] | ~fits).alias("full"))

    return F.btrim(F.aggregate(held, start, step)["out"], F.lit(" \t\n\r"))


def experiment_types(text: Column) -> Column:
    """The kinds of experiment a text speaks of; 'unknown' where there is none."""
    found = F.array_compact(F.array(*[F.when(text.rlike(P.native(p)), F.lit(name)) for name, p in P.EXPERIMENTS]))
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def figure_captions(pages: DataFrame) -> DataFrame:
    """(paper_id, page, figure, caption) of pages (paper_id, page, text): at most 300 characters, a page's last caption."""
    pattern = F.lit(r"(?im)^\s*(?:Figure|Fig)\.?\s*(\d+)\b\.?[ \t]*([^\n]+)")
    last = lambda k: F.element_at(F.regexp_extract_all("text", pattern, F.lit(k)), -1)
    found = pages.where(F.regexp_like("text", pattern))
    return found.select("paper_id", "page", last(1).alias("figure"), F.btrim(F.substring(F.btrim(last(2), F.lit(" |")), 1, 300)).alias("caption"))


def image_refs(evidence: Column) -> Column:
    """Names of images in lines of evidence: those made (after an arrow) and those looked at (in brackets)."""
    made = F.filter(F.transform(evidence, lambda e: F.regexp_extract(e, r"→\s*(\S+\.png)", 1)), lambda x: x != "")
    seen = F.flatten(F.transform(evidence, lambda e: F.regexp_extract_all(e, F.lit(r"\[([^\]]+\.(?:png|jpg|jpeg|tiff?))\]"), F.lit(1))))
    return F.struct(made.alias("outputs"), seen.alias("sources"))


def page_key(name: Column) -> Column:
    """A key by which page10 comes after page2."""
    return F.coalesce(F.regexp_extract(name, r"page[_-]?(\d+)", 1).try_cast("int"), F.lit(2**31 - 1))


def abstract_or_head(text: Column, abstract: Column, introduction: Column, first_heading: Column) -> Column:
    """The abstract; without one, what stands before the introduction (its last 2,000 characters), or else the first paragraph
    above 150 characters before the first heading and what follows it (3,000 at most, if above 200)."""
    at = F.position(F.substring(introduction, 1, 50), text) - 1
    before = F.right(F.btrim(F.substring(text, F.lit(1), at), F.lit(" \t\n\r")), F.lit(2000))
    end = F.coalesce(first_heading, F.length(text))
    head = F.substring(text, F.lit(1), end)
    long = F.get(F.filter(F.transform(F.split(head, "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\r"))), lambda p: F.length(p) > 150), F.lit(0))
    begin = F.when(long.isNotNull(), F.position(long, head) - 1).otherwise(F.least(F.lit(400), F.floor(end / 2)))
    body = F.btrim(F.substring(head, begin.cast("int") + 1, end), F.lit(" \t\n\r"))
    fallback = F.when(F.length(body) > 200, F.substring(body, 1, 3000)).otherwise("")
    return F.when(F.coalesce(abstract, F.lit("")) != "", abstract).when((F.coalesce(introduction, F.lit("")) != "") & (at > 100), before).otherwise(fallback)
