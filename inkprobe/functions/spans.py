"""Matches with their places. The JVM's functions tell neither a match's place nor what stands around it, so this is one
Arrow function per set of patterns; texts come in batches and a paper's hits come back as one array."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("rule", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()),
        T.StructField("context", T.StringType()), T.StructField("groups", T.ArrayType(T.StringType())),
    ]
)


def find_spans(text: str | None, compiled: Sequence[re.Pattern], before: int, after: int, once: bool = True) -> list[tuple]:
    """All matches of all patterns in order of pattern and place; with ``once``, a span that an earlier pattern has is left out."""
    if not text:
        return []
    out, seen = [], set()
    for rule, pattern in enumerate(compiled):
        for m in pattern.finditer(text):
            at = m.span()
            if once and at in seen:
                continue
            seen.add(at)
            context = text[max(0, at[0] - before) : at[1] + after].replace("\n", " ").strip()
            out.append((rule, at[0], at[1], m.group(0), context, list(m.groups())))
    return out


def spans(text: Column, patterns: Sequence[str], before: int = 50, after: int = 50, flags: int = re.IGNORECASE, once: bool = True) -> Column:
    """An array of matches: rule (the pattern's number), start, end, text, context, groups. Null text has none."""
    patterns = list(patterns)

    @F.pandas_udf(T.ArrayType(SPAN))
    def found(texts: pd.Series) -> pd.Series:
        compiled = [re.compile(p, flags) for p in patterns]
        return texts.map(lambda t: find_spans(t, compiled, before, after, once))

    return found(text)


def folded(text: str) -> str:
    """A text in lower case in which a plain lower-case word stands wherever ``re.IGNORECASE`` takes one to stand."""
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


def first_of(*texts: Column) -> Column:
    """The first text that isn't empty, whole; empty where there is none."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))
