"""The checks of a paper: each a projection of ``papers`` to one check result a row, without any shuffle.

A paper without text gets level ``error``. Levels follow fixed ladders; verdicts are one line of English.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import stats
from ..functions.spans import find_spans, first_of, folded
from ..schema import LOCATION
from .registry import check

FOUND = T.StructType([T.StructField("level", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("evidence", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("needs_human", T.BooleanType())])


def _result(papers: DataFrame, check_id: str | Column, name: str | Column, found: Column) -> DataFrame:
    """Check result rows from a struct of level, verdict, evidence, confidence, needs_human."""
    check_id, name = [x if isinstance(x, Column) else F.lit(x) for x in (check_id, name)]
    rows = papers.select(F.col("paper_id").cast("string").alias("paper_id"), check_id.alias("check_id"), name.alias("check_name"), found.alias("r"))
    place = F.transform("r.evidence", lambda e: F.struct(F.lit(1).alias("page"), F.lit(None).cast("string").alias("figure_number"), F.lit(None).cast("string").alias("paragraph"), e.alias("excerpt")))
    return rows.select(
        "paper_id", "check_id", "check_name", "r.level", "r.verdict", "r.evidence",
        F.when(F.col("r.level").isin("red", "orange", "yellow"), place).otherwise(F.array()).cast(f"array<{LOCATION}>").alias("source_locations"),
        "r.confidence", "r.needs_human", F.when(F.col("r.needs_human"), F.lit("Compare the excerpts with the source.")).otherwise("").alias("human_instruction"),
    )


def _found(level: Column, verdict: Column, evidence: Column, confidence: Column | float, needs_human: Column) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(level.alias("level"), verdict.alias("verdict"), evidence.cast("array<string>").alias("evidence"), conf.cast("double").alias("confidence"), needs_human.alias("needs_human"))


NO_TEXT = ("error", "no text", [], 1.0, False)


def _python(function) -> Column:
    """A ladder over a paper's text that needs Python: text(s) to (level, verdict, evidence, confidence, needs_human).
    One that raises makes an error row and leaves the other papers alone."""

    @F.pandas_udf(FOUND)
    def run(*texts: pd.Series) -> pd.DataFrame:
        rows = [_guarded(function, *[t or "" for t in row]) for row in zip(*texts)]
        return pd.DataFrame(rows, columns=["level", "verdict", "evidence", "confidence", "needs_human"])

    return run


def _guarded(function, *texts: str) -> tuple:
    try:
        return function(*texts)
    except Exception as e:  # noqa: BLE001
        return "error", f"{type(e).__name__}: {e}"[:200], [], 1.0, False


def col(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- numbers -------------------------------------------------------------------------------------------------------


def number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


_STATISTICS = [(kind, re.compile(p, re.I)) for kind, p in P.STATISTICS]
_REPORTED_P = re.compile(P.REPORTED_P, re.I)


def reported_statistics(text: str) -> list[dict]:
    """Test statistics reported in a text, each with its reported and its recomputed p-value and what is wrong with it."""
    out = []
    for kind, pattern in _STATISTICS:
        for m in pattern.finditer(text):
            g = m.groupdict()
            value, df1, df2 = number(g.get("value")), number(g.get("df1")), number(g.get("df2"))
            row = {"test": kind, "df1": df1, "df2": df2, "n": number(g.get("n")), "value": value, "comparison": None, "reported_p": None, "start": m.start(), "raw": m.group(0).strip()}
            if g.get("p") and (p := _REPORTED_P.search(g["p"])):
                row["comparison"], row["reported_p"] = p["comp"], number(p["value"])
            row["recalculated_p"] = stats.p_value(kind, value, df1, df2)
            row["error"] = inconsistency(row["comparison"], row["reported_p"], row["recalculated_p"])
            out.append(row)
    return out


def inconsistency(comparison: str | None, reported: float | None, recalculated: float | None) -> str:
    """'decision_error' where the two disagree on significance, 'gross_mismatch' where they are a hundredfold apart."""
    if reported is None or recalculated is None:
        return ""
    claimed = reported <= 0.05 if comparison == "<" else comparison == "=" and reported < 0.05
    if claimed != (recalculated < 0.05):
        return "decision_error"
    if reported > 0 and recalculated > 0 and max(reported, recalculated) / (min(reported, recalculated) + 1e-10) > 100:
        return "gross_mismatch"
    return ""


def statcheck_ladder(text: str):
    if not text:
        return NO_TEXT
    found = reported_statistics(text)
    wrong = [s for s in found if s["error"]]
    if not found:
        return "green", "no reported statistics", [], 1.0, False
    if not wrong:
        return "green", f"{len(found)} statistics, all consistent", [], 0.85, False
    shown = [f"{s['raw']}: p is {s['recalculated_p']:.4g} ({s['error']})" for s in wrong]
    return "red", f"{len(wrong)} of {len(found)} statistics do not fit their p-value", shown, 0.9, True


@check("numbers.statcheck")
def statcheck(papers: DataFrame) -> DataFrame:
    return _result(papers, "numbers.statcheck", "Recomputed p-values", _python(statcheck_ladder)(first_of(F.col("results"), F.col("full_text"))))


_MEAN_N = [re.compile(P.MEAN_N, re.I), re.compile(P.N_MEAN, re.I)]


def mean_n_pairs(text: str) -> list[dict]:
    """Means with the n they rest on; a pair that the second form finds and the first has already counts once."""
    out = []
    for k, pattern in enumerate(_MEAN_N):
        for m in pattern.finditer(text):
            row = {"mean": float(m["mean"]), "n": int(m["n"]), "sd": float(m["sd"]) if k == 0 else None, "raw": m.group(0).strip()}
            if row not in out or k == 0:
                out.append(row)
    return out


def grim_consistent(mean: float, n: int, tolerance: float = 0.01) -> bool:
    """Whether n whole numbers can have this mean, to the tolerance a rounded mean allows."""
    if n <= 0:
        return True
    total = mean * n
    return abs(total - round(total)) <= max(tolerance * n, 0.01)


def grim_column(mean: Column, n: Column) -> Column:
    """The same as a column expression."""
    return F.abs(mean * n - F.rint(mean * n)) <= F.greatest(0.01 * n, F.lit(0.01))


def grim_ladder(text: str):
    if not text:
        return NO_TEXT
    pairs = mean_n_pairs(text)
    if not pairs:
        return "green", "no means with n", [], 1.0, False
    bad = [p for p in pairs if not grim_consistent(p["mean"], p["n"])]
    if not bad:
        return "green", f"{len(pairs)} means, all possible", [], 0.9, False
    return "red", f"{len(bad)} of {len(pairs)} means are impossible for their n", [p["raw"] for p in bad], 0.95, True


@check("numbers.grim")
def grim(papers: DataFrame) -> DataFrame:
    return _result(papers, "numbers.grim", "Possible means", _python(grim_ladder)(first_of(F.col("results"), F.col("full_text"))))


_DECIMAL = re.compile(P.DECIMAL)


def last_digit(value: float) -> int | None:
    shown = f"{value:.10f}".rstrip("0").rstrip(".")
    return int(shown[-1]) if shown and shown[-1].isdigit() else None


def digit_preference(values: list[float]) -> dict:
    """Last digits against the uniform distribution; trailing zeros are lost, as numbers and not their spelling are read."""
    counts = Counter(d for d in map(last_digit, values) if d is not None)
    n = sum(counts.values())
    if n < 20:
        return {"n": n, "suspicious": False, "chi2": None, "zero_five": None}
    chi2 = sum((counts[d] - n / 10) ** 2 / (n / 10) for d in range(10))
    share = (counts[0] + counts[5]) / n * 100
    return {"n": n, "chi2": chi2, "zero_five": share, "suspicious": chi2 > stats.CRITICAL_CHI2_DF9_05 or share > 35}


def decimal_places(value: float) -> int:
    shown = f"{value:.10f}".rstrip("0")
    return len(shown.split(".")[1]) if "." in shown else 0


def decimal_consistency(values: list[float]) -> dict:
    counts = Counter(map(decimal_places, values))
    if not counts:
        return {"mode": None, "share": None, "consistent": True}
    mode, n = counts.most_common(1)[0]
    return {"mode": mode, "share": n / len(values), "consistent": n / len(values) >= 0.8}


def _digit_ladder(text: str):
    if not text:
        return NO_TEXT
    values = [float(x) for x in _DECIMAL.findall(text)]
    if len(values) < 10:
        return "error", "too few decimal numbers", [], 1.0, False
    d = digit_preference(values)
    if d["chi2"] is None:
        return "green", "too few digits", [], 0.5, False
    said = f"last digits of {d['n']} numbers: chi-square {d['chi2']:.1f}, {d['zero_five']:.0f}% end in 0 or 5"
    return ("orange" if d["suspicious"] else "green"), said, [said] if d["suspicious"] else [], 0.85, d["suspicious"]


def _decimals_ladder(text: str):
    if not text:
        return NO_TEXT
    values = [float(x) for x in _DECIMAL.findall(text)]
    if len(values) < 10:
        return "error", "too few decimal numbers", [], 1.0, False
    d = decimal_consistency(values)
    said = f"{d['share'] * 100:.0f}% have {d['mode']} decimals"
    return ("green" if d["consistent"] else "yellow"), said, [] if d["consistent"] else [said], 0.7, False


@check("numbers.digit_pref")
def digit_pref(papers: DataFrame) -> DataFrame:
    return _result(papers, "numbers.digit_pref", "Last digits", _python(_digit_ladder)(first_of(F.col("results"), F.col("full_text"))))


@check("numbers.decimal_cons")
def decimal_cons(papers: DataFrame) -> DataFrame:
    return _result(papers, "numbers.decimal_cons", "Number of decimals", _python(_decimals_ladder)(first_of(F.col("results"), F.col("full_text"))))


_COLUMN = re.compile(P.COLUMN, re.I)


def valid_header(header: str) -> bool:
    parts = [p.strip() for p in header.split("\n") if p.strip()]
    return 3 <= len(header) <= 80 and header.count("\n") <= 2 and re.search("[A-Za-z]", header) is not None and not (len(parts) >= 3 and len(set(parts)) < len(parts))


def table_columns(text: str) -> list[tuple[str, list[float]]]:
    """Headers followed by three numbers or more. Numbers after ± count as values."""
    out = []
    for m in _COLUMN.finditer(text):
        header, values = m["header"].strip(), [float(x) for x in re.findall(r"\d+\.?\d*", m["numbers"])]
        if valid_header(header) and len(values) >= 3:
            out.append((header, values))
    return out


def ratio_cv(a: list[float], b: list[float]) -> dict:
    """How constant the ratio of two columns is, pairs whose left value is zero left out."""
    ratios = [y / x for x, y in zip(a, b) if x != 0]
    if len(ratios) < 3:
        return {"n": len(ratios), "mean": None, "cv": None, "suspicious": False}
    mean = sum(ratios) / len(ratios)
    sd = math.sqrt(sum((r - mean) ** 2 for r in ratios) / (len(ratios) - 1))
    cv = sd / abs(mean) if mean else math.inf
    return {"n": len(ratios), "mean": mean, "cv": cv, "suspicious": cv < 0.01 and len(ratios) >= 5}


def _arithmetic_ladder(text: str):
    if not text:
        return NO_TEXT
    columns = table_columns(text)
    if len(columns) < 2:
        return "green", "fewer than two columns", [], 0.75, False
    bad = []
    for i, (h, a) in enumerate(columns):
        for g, b in columns[i + 1 :]:
            r = ratio_cv(a, b)
            if r["suspicious"]:
                bad.append(f"{h} and {g}: ratio {r['mean']:.4g}, variation {r['cv']:.4%}")
    return ("orange" if bad else "green"), f"{len(bad)} pairs of {len(columns)} columns have a constant ratio", bad, 0.8 if bad else 0.75, bool(bad)


@check("numbers.arithmetic")
def arithmetic(papers: DataFrame) -> DataFrame:
    return _result(papers, "numbers.arithmetic", "Constant ratios", _python(_arithmetic_ladder)(first_of(F.col("results"), F.col("full_text"))))


_METADATA = [re.compile(p) for p in P.METADATA]
_NUMBER = re.compile(r"\d+\.\d+|\d+")


def first_digits(text: str) -> list[int]:
    """First digits of measurements in a text: not of years, identifiers, references or values below 1."""
    out = []
    for m in _NUMBER.finditer(text):
        shown = m.group(0)
        if re.fullmatch(r"(?:19|20)\d{2}", shown) or re.match(r"10\.\d{4,}", shown) or float(shown) < 1:
            continue
        around = text[max(0, m.start() - 30) : m.end() + 30]
        if not any(p.search(around) for p in _METADATA):
            out.append(int(shown.lstrip("0")[0]))
    return out


def benford(digits: list[int]) -> dict:
    n = len(digits)
    expected = [n * math.log10(1 + 1 / d) for d in range(1, 10)]
    if n < 50 or min(expected) < 5:
        return {"n": n, "chi2": None, "p": None, "deviation": None}
    counts = Counter(digits)
    chi2 = sum((counts[d] - e) ** 2 / e for d, e in zip(range(1, 10), expected))
    return {"n": n, "chi2": chi2, "p": stats.chi2_upper(chi2, 8), "deviation": max(abs(counts[d] - e) / n for d, e in zip(range(1, 10), expected))}


def _benford_ladder(results: str, abstract: str, full: str):
    if not (results or abstract or full):
        return NO_TEXT
    text = results + ("\n" + abstract if len(results) < 500 else "") if results else full
    if sum(1 for _ in _NUMBER.finditer(text)) < 50:  # whatever of them are measurements
        return "green", "fewer than 50 digits", [], 0.35, False
    b = benford(first_digits(text))
    if b["n"] < 50:
        return "green", "fewer than 50 digits", [], 0.35, False
    if b["p"] is None:
        return "green", "too few digits for the rarest", [], 0.35, False
    bad = b["p"] < 0.01
    said = f"first digits of {b['n']} numbers: chi-square {b['chi2']:.1f}, p {b['p']:.3g}"
    return ("yellow" if bad else "green"), said, [said] if bad else [], 0.35, bad


@check("numbers.benford")
def benford_text(papers: DataFrame) -> DataFrame:
    return _result(papers, "numbers.benford", "First digits", _python(_benford_ladder)(col("results"), col("abstract"), col("full_text")))


_P_NEARBY, _DOI_NEARBY, _VARIANT = re.compile(P.P_NEARBY), re.compile(P.DOI_NEARBY), re.compile(P.VARIANT_NEARBY)


def duplicated_values(text: str) -> list[dict]:
    """Values that stand in two different contexts or more, at their highest precision; thresholds, identifiers, clusters of
    one table and names with numbers are left out."""
    held = []
    for m in _DECIMAL.finditer(text):
        value, around = float(m.group(0)), text[max(0, m.start() - 80) : m.end() + 80].replace("\n", " ")
        if any(abs(value - t) < 1e-9 for t in P.P_THRESHOLDS) or _P_NEARBY.search(around) or _DOI_NEARBY.search(around) or _VARIANT.search(around):
            continue
        held.append((value, around, m.start()))
    best: dict[float, dict] = {}
    for precision in (2, 3, 4):
        groups: dict[int, list] = {}
        for value, around, at in held:
            groups.setdefault(round(value * 10**precision), []).append((value, around, at))
        for group in groups.values():
            contexts = {re.sub("[^a-z]", "", a.lower())[:60] for _, a, _ in group}
            if len(group) < 2 or len(contexts) < 2 or same_table(group):
                continue
            best[group[0][0]] = {"value": group[0][0], "precision": precision, "count": len(group)}
    return sorted(best.values(), key=lambda d: -d["precision"] * d["count"])


def same_table(group: list) -> bool:
    """Whether the places are one table's: close together, or most of their contexts alike."""
    at = [g[2] for g in group]
    if max(at) - min(at) < 4000:
        return True
    if len(group) < 3:
        return False
    words = [set(re.findall("[a-z]+", g[1].lower())) for g in group]
    pairs = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if a and b]
    alike = sum(len(a & b) / len(a | b) > 0.5 for a, b in pairs)
    return bool(pairs) and alike / len(pairs) > 0.6


def _identical_ladder(text: str):
    if not text:
        return NO_TEXT
    if len(_DECIMAL.findall(text)) < 10:
        return "error", "too few decimal numbers", [], 1.0, False
    return identical_level(duplicated_values(text), 0)


def identical_level(duplicates: list[dict], strong_cells: int):
    """The ladder over text duplicates and strong duplicates among a data file's cells."""
    texts = sum(d["count"] >= 3 for d in duplicates)
    total = texts + strong_cells
    if total >= 5 or total >= 3 and texts:
        level = "red"
    elif total >= 3 or texts >= 2 or strong_cells >= 2:
        level = "orange"
    else:
        level = "yellow" if total == 1 else "green"
    shown = [f"{d['value']:g} occurs {d['count']} times" for d in duplicates[:10]]
    return level, f"{texts} values repeat in the text, {strong_cells} in tables", shown if total else [], 0.85, total > 0


@check("numbers.identical_values")
def identical_values(papers: DataFrame) -> DataFrame:
    return _result(papers, "numbers.identical_values", "Repeated values", _python(_identical_ladder)(first_of(F.col("results"), F.col("full_text"))))


# --- wording -------------------------------------------------------------------------------------------------------


def _count_ladder(rules, ladder, confidence, human, before, after):
    """A ladder that counts hits: ``ladder`` is (least hits, level) from the highest down."""
    compiled = [re.compile(p, re.I) for p in rules]

    def run(text: str):
        hits = find_spans(text, compiled, before, after)
        level = next((level for least, level in ladder if len(hits) >= least), "green") if text else "error"
        return level, f"{len(hits)} hits", [h[4] for h in hits[:10]], confidence, text != "" and len(hits) >= human

    return run


def hype_rules(extra: list[str] = ()) -> list[str]:
    return list(dict.fromkeys([rf"\b{p}\b" for _, p in P.HYPE] + [rf"\b{p}\b" for p in extra]))


def _hype_ladder(extra: list[str] = ()):
    return _count_ladder(hype_rules(extra), [(5, "orange"), (3, "yellow")], 0.7, 3, 50, 50)


@check("text.blacklist")
def blacklist(papers: DataFrame, extra: list[str] = ()) -> DataFrame:
    text = first_of(F.col("discussion"), F.col("abstract"), F.col("full_text"))
    return _result(papers, "text.blacklist", "Overstatement", _python(_hype_ladder(extra))(text))


def _camouflage_ladder(extra: list[str] = ()):
    count = _count_ladder([*P.CAMOUFLAGE, *map(re.escape, extra)], [(2, "red"), (1, "orange")], 0.85, 1, 60, 60)
    return lambda results, discussion, full: count(f"{results}\n{discussion}" if results or discussion else full)


@check("text.pvalue_camouflage")
def camouflage(papers: DataFrame, extra: list[str] = ()) -> DataFrame:
    return _result(papers, "text.pvalue_camouflage", "Dressed-up p-values", _python(_camouflage_ladder(extra))(col("results"), col("discussion"), col("full_text")))


def _severity_ladder(rules, confidence, before, after, needs=()):
    """A ladder that takes the worst hit's level. No rule matches a text without any of the words ``needs``."""
    compiled, names = [re.compile(p, re.I) for _, p in rules], list(P.LEVELS)

    def run(text: str):
        hits = find_spans(text, compiled, before, after) if not needs or contains_any(folded(text), needs) else []
        worst = max((P.LEVELS[rules[h[0]][0]] for h in hits), default=1)
        return names[worst] if text else "error", f"{len(hits)} hits", [h[4] for h in hits[:10]], confidence, text != "" and worst > 1

    return run


def contains_any(text: str, words) -> bool:
    return any(w in text for w in words)


_normality_ladder = _severity_ladder(P.NORMALITY, 0.9, 40, 80, ("normal", "shapiro", "kolmogorov", "agostino"))


@check("stats.normality_claim")
def normality_claim(papers: DataFrame) -> DataFrame:
    return _result(papers, "stats.normality_claim", "Claims of normal data", _python(_normality_ladder)(first_of(F.col("methods"), F.col("full_text"))))


_fallacy_hits = _severity_ladder(P.FALLACIES, 0.85, 30, 100)


def _fallacy_ladder(results: str, discussion: str, methods: str, full: str):
    return _fallacy_hits(f"{results}\n{discussion}".strip(" \n") or methods or full)


@check("stats.fallacies")
def fallacies(papers: DataFrame) -> DataFrame:
    return _result(papers, "stats.fallacies", "Absence of evidence", _python(_fallacy_ladder)(col("results"), col("discussion"), col("methods"), col("full_text")))


_EFFICACY = [(k, re.compile(p, re.I)) for k, p in P.EFFICACY]
_NULLS = [re.compile(p, re.I) for p in P.NULL_RESULTS]
_MECHANISM = re.compile(P.MECHANISM, re.I)


def _gap_ladder(title: str, abstract: str, results: str, discussion: str):
    if not results:
        return NO_TEXT
    verbs = lambda t: {k for k, p in _EFFICACY if p.search(t)}
    nulls = [s for part in (results, discussion) for s in find_spans(part, _NULLS, 60, 60, once=False)]
    primary = [s for s in nulls if not _MECHANISM.search(s[4])]
    gap = bool(verbs(title) & set(P.GAP_VERBS) and nulls) or bool(verbs(abstract) & set(P.GAP_VERBS) and primary)
    if not gap:
        return "green", "claims and results agree", [], 0.7, False
    level = "red" if len(primary) >= 2 else "orange" if primary else "yellow"
    return level, f"a claim of effect beside {len(primary)} primary null results", [s[4] for s in nulls[:10]], 0.75, True


@check("text.title_conclusion_gap")
def title_conclusion_gap(papers: DataFrame) -> DataFrame:
    return _result(papers, "text.title_conclusion_gap", "Title against results", _python(_gap_ladder)(col("title"), col("abstract"), col("results"), col("discussion")))


# --- statistics ----------------------------------------------------------------------------------------------------

_SAMPLE_N = [re.compile(p, re.I) for p in P.SAMPLE_N]


class _AtStarts:
    """The matches of P.SMALL_N_LINE, tried only where a line or clause starts: elsewhere it can't match."""

    line, starts = re.compile(P.SMALL_N_LINE, re.I | re.S), re.compile(r"\n|[.;,] ")

    def finditer(self, text: str):
        done = 0
        for at in itertools.chain([0], (m.end() for m in self.starts.finditer(text))):
            if at >= done and (m := self.line.match(text, at)):
                done = m.end()
                yield m


_SMALL = [_AtStarts(), re.compile(P.SMALL_N_NEAR, re.I | re.S)]
_OTHERS = re.compile(P.CITES_OTHERS, re.I)
_TECHNICAL = re.compile(P.TECHNICAL, re.I)
_TECHNICAL_NEEDS = ("triplicat", "replicat", "well", "technical", "same", "each")
_SMALL_NEEDS = re.compile(r"[<≤]\s*0[.]0(?:0[1-9]|1)")


def sample_sizes(text: str) -> list[int]:
    """Sample sizes from 1 to 1,000; a span that an earlier pattern has counts once."""
    found = (int(next(g for g in s[5] if g)) for s in find_spans(text, _SAMPLE_N, 0, 0))
    return [n for n in found if 1 <= n <= 1000]


def small_n_claims(text: str) -> list[int]:
    """The n of at most 4 that stand near a p-value below .01 or so, unless the passage is about other people's data."""
    if not _SMALL_NEEDS.search(text):
        return []
    out, seen = [], set()
    for s in find_spans(text, _SMALL, 60, 60, once=False):
        n = int(next(g for g in s[5] if g))
        if n <= 4 and (s[1], s[2]) not in seen and not _OTHERS.search(s[4]):
            seen.add((s[1], s[2]))
            out.append(n)
    return out


def _sample_ladder(methods: str, full: str):
    text = full or methods
    if not text:
        return NO_TEXT
    own, claims = sample_sizes(methods or full), small_n_claims(text)
    below, least = sum(n < 3 for n in claims), min(own, default=None)
    note = "; technical replicates are mentioned" if contains_any(folded(text), _TECHNICAL_NEEDS) and _TECHNICAL.search(text) else ""
    if least is None:
        level = "orange" if below >= 2 else "yellow" if claims else "green"
    elif least < 3 or below >= 2:
        level = "red"
    elif below == 1:
        level = "orange"
    elif claims:
        level = "yellow" if min(claims) == 3 or min(map(stats.critical_d, claims)) > 2 else "green"
    else:
        level = "yellow" if min(sample_sizes(text), default=least) < least else "green"
    said = f"smallest n in methods {least}, {len(claims)} strong claims on n of 4 or less{note}"
    return level, said, [said] if level != "green" else [], 0.85, level in ("red", "orange")


@check("stats.sample_size")
def sample_size(papers: DataFrame) -> DataFrame:
    return _result(papers, "stats.sample_size", "Sample sizes", _python(_sample_ladder)(col("methods"), col("full_text")))


_P_VALUE = re.compile(P.P_VALUE)


def p_curve(text: str) -> dict:
    """Counts of exact p-values along the curve, and how often each is given."""
    found = [(op, float(x)) for op, x in _P_VALUE.findall(text)]
    exact = [x for op, x in found if op == "="]
    inside = lambda a, b: sum(a <= x < b for x in exact)
    return {
        "total": len(found), "below": sum(op in "<≤" for op, _ in found), "exact": exact, "n": len(exact), "b001": inside(0, 0.001), "b01_04": inside(0.01, 0.04), "b04_05": inside(0.04, 0.05),
        "b05_06": inside(0.05, 0.06), "b06": sum(x >= 0.06 for x in exact), "common": Counter(round(x, 2) for x in exact).most_common(3),
    }


def p_hacking_level(c: dict) -> str:
    if c["total"] < 5:
        return "green"
    flags = set()
    if not c["n"] and c["below"] >= 8:
        flags.add("yellow")
    if c["n"] >= 8:
        near, far = 100 * c["b04_05"] / c["n"], 100 * c["b06"] / c["n"]
        ratio = c["b04_05"] / max(c["b05_06"], 1)
        if c["n"] >= 10:
            flags.add("red" if near > 25 and ratio > 2 else "yellow" if near > 20 else "green")
        if c["n"] >= 15:
            flags.add("red" if far < 10 else "yellow" if far < 20 else "green")
        if any(x >= 0.01 and k >= 4 for x, k in c["common"]):
            flags.add("yellow")
    return next((x for x in ("red", "yellow") if x in flags), "green")


def _p_hacking_ladder(text: str):
    if not text:
        return NO_TEXT
    c = p_curve(text)
    if c["total"] < 5:
        return "green", "fewer than 5 p-values", [], 0.6, False
    level = p_hacking_level(c)
    said = f"{c['n']} exact p-values, {c['b04_05']} of them from .04 to .05, {c['below']} only as less-than"
    return level, said, [said] if level != "green" else [], 0.8, level == "red"


@check("stats.p_hacking")
def p_hacking(papers: DataFrame) -> DataFrame:
    return _result(papers, "stats.p_hacking", "Clustered p-values", _python(_p_hacking_ladder)(col("full_text")))


_METHODS = {k: re.compile(p, re.I) for k, p in {"t": P.T_TEST, "groups": P.MULTI_GROUP, "series": P.TIME_SERIES, "pairwise": P.PAIRWISE, "anova": P.ANOVA, "correction": P.CORRECTION, "label": P.GROUP_LABEL}.items()}
#: Words of which each match holds one.
_MISUSE_NEEDS = {
    "t": ("t test", "t-test", "t.test"), "groups": (" group", " experimental group", " treatment group", " condition", " cohort"), "pairwise": ("each", "all", "multiple", "several"),
    "series": ("time", "repeated measure", "longitudinal", "baseline", "at day", "at week", "at month", "at hour"),
}
_COUNTED = {w: k for k, w in enumerate("three four five six seven eight nine ten".split(), 3)}


def _misuse_ladder(text: str):
    if not text:
        return NO_TEXT
    # every sign needs a t-test, and what is searched below costs more than looking for its name
    low = folded(text)
    at = {k: [(m.start(), m.group(0)) for m in _METHODS[k].finditer(text)] if contains_any(low, needs) and contains_any(low, _MISUSE_NEEDS["t"]) else [] for k, needs in _MISUSE_NEEDS.items()}
    if not at["t"]:
        return "green", "0 signs of a test that does not fit", [], 0.75, False
    anova, corrected = _METHODS["anova"].search(text), lambda: _METHODS["correction"].search(text)
    flags, shown = [], []
    for kind, reach in (("groups", 500), ("series", 600)):
        for start, said in at["t"]:
            other = next((o for o in at[kind] if abs(o[0] - start) < reach), None)
            if other:
                flags.append("red")
                shown.append(f"{said} near {other[1]}")
    if at["pairwise"] and not corrected():
        flags.append("orange" if anova else "red")
        shown.append(at["pairwise"][0][1])
    sizes = [_COUNTED.get(w := g[1].split(" ")[0].lower()) or int(w) for g in at["groups"]]
    if not anova and max(sizes, default=0) >= 3:
        flags.append("orange")
    if len(at["t"]) >= 5 and not anova and not corrected():
        flags.append("red")
        shown.append(f"{len(at['t'])} t-tests")
    if len(at["t"]) >= 3 and not anova and "red" not in flags and not corrected():
        labels = {re.sub(r"\s+", " ", m.group(0).lower()).strip() for m in _METHODS["label"].finditer(text)}
        if len(labels) >= 5:
            flags.append("orange")
    level = "red" if "red" in flags else "orange" if flags else "green"
    return level, f"{len(flags)} signs of a test that does not fit", shown[:10], 0.75, bool(flags)


@check("stats.method_misuse")
def method_misuse(papers: DataFrame) -> DataFrame:
    return _result(papers, "stats.method_misuse", "Tests that do not fit", _python(_misuse_ladder)(col("full_text")))


#: Each alternative of P.BLOT holds one of these.
_BLOT_NEEDS = ("blot", "wb", "immunodetection", "ecl", "chemiluminescen", "pvdf", "nitrocellulose", "page", "membrane")


def _with_blots(papers: DataFrame) -> DataFrame:
    """Adds __t, __blot and __control, each searched once a paper and only where it can be found."""
    text = F.concat_ws("\n", col("full_text"), col("methods"))
    folds = "İıſ\u212a"  # besides capitals, what the JVM's engine takes for i, s and k
    rare = F.col("__t").contains(folds[0]) | F.col("__t").contains(folds[1]) | F.col("__t").contains(folds[2]) | F.col("__t").contains(folds[3])
    low = F.lower(F.when(rare, F.translate("__t", folds, "iisk")).otherwise(F.col("__t")))
    may = F.lit(False)
    for word in _BLOT_NEEDS:
        may = may | F.col("__low").contains(word)
    out = papers.withColumn("__t", text).withColumn("__low", low).withColumn("__blot", F.when(may, F.col("__t").rlike(P.native(P.BLOT))).otherwise(False))
    return out.withColumn("__control", F.when(F.col("__blot"), F.col("__t").rlike(P.native(P.LOADING))).otherwise(False)).drop("__low")


def _blot_found() -> Column:
    blot, control = F.col("__blot"), F.col("__control")
    empty = (col("full_text") == "") & (col("methods") == "")
    level = F.when(empty, "error").when(blot & ~control, "red").otherwise("green")
    verdict = F.when(empty, "no text").when(~blot, "no blots").when(control, "a loading control is named").otherwise("blots without a loading control")
    bad = ~empty & blot & ~control
    return _found(level, verdict, F.when(bad, F.array(F.regexp_extract("__t", P.native(P.BLOT), 0))).otherwise(F.array()), F.when(empty, 1.0).when(~blot, 0.9).when(control, 0.95).otherwise(0.92), bad)


@check("bioinfo.western_blot")
def western_blot(papers: DataFrame) -> DataFrame:
    """JVM-side: two searches of the text."""
    return _result(_with_blots(papers), "bioinfo.western_blot", "Loading controls", _blot_found())


# --- all of them ---------------------------------------------------------------------------------------------------

TEXTS = ("title", "abstract", "methods", "results", "discussion", "full_text")
_RESULTS = lambda ladder: lambda t: ladder(t["results"] or t["full_text"])

#: The checks that ``run_checks`` takes in one pass: check, name, ladder over a paper's texts.
TOGETHER = {
    "numbers.statcheck": (statcheck, "Recomputed p-values", _RESULTS(statcheck_ladder)),
    "numbers.grim": (grim, "Possible means", _RESULTS(grim_ladder)),
    "numbers.digit_pref": (digit_pref, "Last digits", _RESULTS(_digit_ladder)),
    "numbers.decimal_cons": (decimal_cons, "Number of decimals", _RESULTS(_decimals_ladder)),
    "numbers.arithmetic": (arithmetic, "Constant ratios", _RESULTS(_arithmetic_ladder)),
    "numbers.benford": (benford_text, "First digits", lambda t: _benford_ladder(t["results"], t["abstract"], t["full_text"])),
    "numbers.identical_values": (identical_values, "Repeated values", _RESULTS(_identical_ladder)),
    "text.blacklist": (blacklist, "Overstatement", lambda t, run=_hype_ladder(): run(t["discussion"] or t["abstract"] or t["full_text"])),
    "text.pvalue_camouflage": (camouflage, "Dressed-up p-values", lambda t, run=_camouflage_ladder(): run(t["results"], t["discussion"], t["full_text"])),
    "stats.normality_claim": (normality_claim, "Claims of normal data", lambda t: _normality_ladder(t["methods"] or t["full_text"])),
    "stats.fallacies": (fallacies, "Absence of evidence", lambda t: _fallacy_ladder(t["results"], t["discussion"], t["methods"], t["full_text"])),
    "text.title_conclusion_gap": (title_conclusion_gap, "Title against results", lambda t: _gap_ladder(t["title"], t["abstract"], t["results"], t["discussion"])),
    "stats.sample_size": (sample_size, "Sample sizes", lambda t: _sample_ladder(t["methods"], t["full_text"])),
    "stats.p_hacking": (p_hacking, "Clustered p-values", lambda t: _p_hacking_ladder(t["full_text"])),
    "stats.method_misuse": (method_misuse, "Tests that do not fit", lambda t: _misuse_ladder(t["full_text"])),
    "bioinfo.western_blot": (western_blot, "Loading controls", None),
}


def _together(papers: DataFrame, ids: list[str]) -> DataFrame:
    """Built-in checks in one pass: a paper's texts go to Python once, and its results come back as one array."""
    ladders = [k for k in ids if TOGETHER[k][2]]
    order = ladders + [k for k in ids if not TOGETHER[k][2]]

    @F.pandas_udf(T.ArrayType(FOUND))
    def run(*texts: pd.Series) -> pd.Series:
        papers_ = (dict(zip(TEXTS, [t or "" for t in row])) for row in zip(*texts))
        return pd.Series([[_guarded(TOGETHER[k][2], t) for k in ladders] for t in papers_])

    rows, found = papers, []
    if ladders:
        found.append(run(*[F.col(c) for c in TEXTS]))
    if order != ladders:
        rows = _with_blots(papers)
        found.append(F.array(_blot_found()))
    # outer: for a plain explode the optimizer adds a filter on the array's size, which would run all checks once more
    rows = rows.select("paper_id", F.concat(*found).alias("__all")).select("paper_id", F.posexplode_outer("__all").alias("__k", "__r"))
    names = F.create_map(*[F.lit(x) for k in order for x in (k, TOGETHER[k][1])])
    check_id = F.array(*[F.lit(k) for k in order])[F.col("__k")]
    return _result(rows.withColumn("__id", check_id), F.col("__id"), names[F.col("__id")], F.col("__r"))


def run_checks(papers: DataFrame, only: list[str] | None = None) -> DataFrame:
    """All check results of all papers. Built-in checks read ``papers`` once, each plug-in once more: store ``papers`` first
    if it is costly to compute."""
    from .registry import CHECKS

    ids = [k for k in CHECKS if only is None or k in only]
    together = [k for k in ids if k in TOGETHER and CHECKS[k] is TOGETHER[k][0]]
    out = _together(papers, together) if together else None
    for check_id in ids:
        if check_id not in together:
            rows = CHECKS[check_id](papers)
            out = rows if out is None else out.unionByName(rows)
    return out
