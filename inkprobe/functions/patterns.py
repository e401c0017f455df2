"""Patterns, word lists and weights of the checks. All are fixed values that decide results.

Texts are matched by Python's ``re`` inside Arrow functions where positions count, and by the JVM's engine where only
counts do; ``native`` gives a pattern the flags under which the two agree.
"""

from __future__ import annotations

#: Default wording rules: category, expression. Fixed values.
HYPE = [
    ("absolute", "definitively"), ("absolute", "unequivocally"), ("absolute", "undoubtedly"), ("absolute", "absolutely"), ("absolute", "certainly"),
    ("absolute", "incontrovertibly"), ("absolute", "irrefutably"),
    ("overclaim", "novel"), ("overclaim", "first.?time"), ("overclaim", "first.?report"), ("overclaim", "first.?evidence"), ("overclaim", "breakthrough"),
    ("overclaim", "revolutionary"), ("overclaim", "game.?changing"), ("overclaim", "paradigm.?shift"), ("overclaim", "unprecedented"),
    ("inflated", "remarkable"), ("inflated", "excellent"), ("inflated", "outstanding"), ("inflated", "extraordinary"), ("inflated", "tremendous"),
    ("inflated", "exceptional"), ("inflated", "superb"), ("inflated", "fantastic"),
]

#: Phrases that dress up a p-value above its threshold. Fixed values.
CAMOUFLAGE = [
    r"(?:trending|tend(?:ed|ing)?)\s+towards?\s+(?:statistical\s+)?significance",
    r"marginally\s+significant",
    r"almost\s+(?:reached\s+)?(?:statistical\s+)?significance",
    r"approached?\s+(?:statistical\s+)?significance",
    r"borderline\s+significant",
    r"(?:a\s+)?trend\s+(?:towards?\s+)?(?:statistical\s+)?significance",
    r"nominally\s+significant",
]

#: Fallacies of absent evidence: level, expression. Fixed values.
FALLACIES = [
    ("red", r"(?:no\s+significant\s+difference|P\s*>\s*0\.05|not\s+(?:statistically\s+)?significant)(?:[^.]*?)(?:therefore|thus|hence|indicating|suggesting|demonstrating|confirming|so\s+(?:that|the))"),
    ("red", r"(?:P\s*>\s*0\.05|no\s+significant\s+difference|not\s+significantly\s+different)(?:[^.]*?)(?:non[.-]toxic|non[.-]cytotoxic|safe|without\s+toxicity|no\s+(?:cytotoxic|toxic)\s+effect|not\s+toxic)"),
    ("orange", r"(?:P\s*>\s*0\.05|no\s+significant\s+difference|not\s+significantly\s+different)(?:[^.]*?)(?:was\s+(?:selected|chosen|used)|therefore\s+(?:selected|chosen|used)|concentration\s+(?:was\s+)?(?:selected|chosen))"),
    ("yellow", r"(?:the\s+)?(?:results|data|findings)\s+(?:demonstrate|confirm|prove|show|indicate)\s+(?:that\s+)?(?:there\s+(?:is|are|was|were)\s+)?no\s+(?:significant\s+)?(?:difference|effect|change|impact|influence|toxicity)"),
]

#: Claims of normality: level, expression. Fixed values.
NORMALITY = [
    ("red", r"(?:all\s+)?(?:the\s+)?data\s+(?:met|satisfied|followed|passed)\s+(?:the\s+)?(?:assumption\s+of\s+)?(?:a\s+)?normal\s+(?:distribution|distributions)"),
    ("red", r"(?:all\s+)?data\s+(?:were|are|was)\s+(?:normally\s+distributed|found\s+to\s+be\s+normal)"),
    ("yellow", r"(?:Shapiro[.-]Wilk|Kolmogorov[.-]Smirnov|D\'?Agostino[.-]Pearson)\s+(?:test|normality\s+test)\s+(?:showed|indicated|confirmed|revealed)\s+(?:that\s+)?(?:the\s+)?data"),
    ("yellow", r"(?:a\s+)?normality\s+(?:test|check)\s+(?:was\s+)?(?:used|performed|employed|conducted)"),
]

#: Methods language. Fixed values.
T_TEST = r"(?:unpaired |paired |two.tailed |two.sided |independent )?(?:t[ .-]test|t test|Student.{0,2}s? t[ .-]test)"
MULTI_GROUP = r"(?:three|four|five|six|seven|eight|nine|ten|\d+) (?:groups?|experimental groups?|treatment groups?|conditions?|cohorts?)"
TIME_SERIES = r"time[ .-]point|time[ .-]course|time[ .-]series|time[ .-]dependent|repeated measures?|longitudinal|baseline.{0,30}(?:and|vs|versus|compared).{0,30}post|at (?:day|week|month|hour)s? \d+"
PAIRWISE = r"(?:each|all|multiple|several) (?:pair|group|condition)s? (?:were|was) (?:compared|analyzed|tested) (?:using|with|by) (?:a )?t[ .-]test|t[ .-]tests? (?:were|was) (?:used|performed|conducted|applied) (?:to compare|for) (?:each|all|multiple) (?:pair|comparison)"
ANOVA = r"ANOVA|analysis of variance|Kruskal.Wallis|Friedman"
CORRECTION = r"Bonferroni|Tukey|Dunnett|Sidak|Holm|FDR|false discovery rate|multiple.comparison.correction|post.hoc|posthoc"
GROUP_LABEL = r"(?:control|treatment|experimental|vehicle|sham|WT|KO|wild.type|knockout|transgenic|mutant|deleted|silenced|overexpressed?)\s+(?:group|mice|rats?|cells?|animals?|samples?)|(?:group|mice|rats?|cells?)\s+(?:were|was|received|treated|injected|fed)"

#: Western blots. Fixed values.
BLOT = r"western\s*blot|immunoblot|immuno[.-]?blot|WB\b|immunodetection|ECL\b|chemiluminescen|PVDF|nitrocellulose|SDS[.-]?PAGE|protein\s*(?:band|expression|level).{0,30}?(?:blot|membrane)"
LOADING = (
    r"loading\s*control|internal\s*control|house[.-]?keeping|reference\s*(?:protein|gene)|endogenous\s*control|β[.-]?actin|beta[.-]?actin|GAPDH|α[.-]?tubulin|alpha[.-]?tubulin|β[.-]?tubulin|beta[.-]?tubulin"
    r"|vinculin|HPRT|18S|28S|actin\b|tubulin\b|lamin\b|cyclophilin|TBP\b|ponceau|coomassie|total\s*protein\s*(?:stain|normalization)"
)

#: Verbs of efficacy: type, expression. Fixed values.
EFFICACY = [
    ("enhance", r"\b(?:enhance[sd]?|enhancing)\b"), ("improve", r"\b(?:improve[sd]?|improving)\b"), ("inhibit", r"\b(?:inhibit[sd]?|inhibiting|inhibition)\b"),
    ("suppress", r"\b(?:suppress[esd]?|suppressing|suppression)\b"), ("reduce", r"\b(?:reduce[sd]?|reducing|reduction)\b"), ("overcome", r"\b(?:overcome[sd]?|overcoming)\b"),
    ("restore", r"\b(?:restore[sd]?|restoring|restoration)\b"), ("rescue", r"\b(?:rescue[sd]?|rescuing)\b"), ("promote", r"\b(?:promote[sd]?|promoting|promotion)\b"),
    ("synergize", r"\b(?:synergi(?:ze[sd]?|stic|sm))\b"),
]
GAP_VERBS = ("enhance", "improve", "overcome", "synergize")

#: Null results, and endpoints that are only mechanism. Fixed values.
NULL_RESULTS = [
    r"no\s+significant\s+difference", r"not\s+(?:statistically\s+)?significant", r"P\s*>\s*0\.05", r"did\s+not\s+(?:reach|achieve|attain)\s+(?:statistical\s+)?significance",
    r"failed\s+to\s+(?:reach|achieve|show)\s+(?:statistical\s+)?significance", r"comparable\s+between", r"no\s+significant\s+(?:improvement|enhancement|benefit|effect|change|difference)",
    r"with\s+no\s+significant\s+difference",
]
MECHANISM = r"viral\s+(?:replication|load|titer)|intratumoral\s+(?:virus|viral|NDV)|IFN.*(?:release|production|expression)|JAK.?(?:STAT)"

#: Reported statistics: type, expression with named groups. Fixed values.
_P = r"(?:[,\s;]+(?P<p>p\s*[<>=]\s*\.?\d*\.?\d*))?"
STATISTICS = [
    ("F", r"\bF\s*\(\s*(?P<df1>\d+(?:\.\d+)?)\s*,\s*(?P<df2>\d+(?:\.\d+)?)\s*\)\s*=\s*(?P<value>\d+\.?\d*)" + _P),
    ("chisq", r"(?:χ\s*[²2]|chi\s*(?:square|sq|squared|²|2)?)\s*\(\s*(?P<df1>\d+(?:\.\d+)?)(?:\s*,\s*N\s*=\s*(?P<n>\d+(?:\.\d+)?))?\s*\)\s*=\s*(?P<value>\d+\.?\d*)" + _P),
    ("t", r"\bt\s*\(\s*(?P<df1>\d+(?:\.\d+)?)\s*\)\s*=\s*(?P<value>\d+\.?\d*)" + _P),
    ("r", r"\br\s*\(\s*(?P<df1>\d+(?:\.\d+)?)\s*\)\s*=\s*(?P<value>-?\d*\.?\d*)" + _P),
    ("Z", r"\bZ\s*=\s*(?P<value>\d+\.?\d*)" + _P),
]
REPORTED_P = r"p\s*(?P<comp>[<>=])\s*(?P<value>\.?\d+\.?\d*)"

#: A mean with its n, either way round; p-values; decimals; table columns. Fixed values.
MEAN_N = r"(?:M(?:ean)?\s*[=:]\s*)?(?P<mean>\d+\.\d+)\s*(?:±|\\pm|plus/minus)\s*(?P<sd>\d+\.\d+)(?:\s*\((?:\s*(?:SD|SEM?)\s*[=:]\s*)?.*?)?.*?(?:n\s*[=:]\s*)(?P<n>\d+)"
N_MEAN = r"n\s*[=:]\s*(?P<n>\d+).*?(?:M(?:ean)?|average)\s*[=:]\s*(?P<mean>\d+\.\d+)"
P_VALUE = r"[pP]\s*([<>=≤≥])\s*(\d+[.]\d+)"
DECIMAL = r"(?<!\d)\d+\.\d+(?!\d)"
COLUMN = r"(?P<header>[A-Za-z][A-Za-z\s\-+()]+?)(?P<numbers>(?:\s*\d+\.?\d*\s*(?:[±,;]\s*\d+\.?\d*)?)+)"

#: Sample sizes. Fixed values.
SAMPLE_N = [
    r"(?:(?:each|per)\s+group\s*[,:]?\s*)?n\s*[=＝]\s*(\d+)",
    r"n\s*[=＝]\s*(\d+)\s*(?:(?:mice|rats|dogs|animals|patients|samples|specimens|replicates?|biological|independent)\b)",
    r"\(n\s*[=＝]\s*(\d+)\)",
    r"(?:each|per)\s+group\s*(?:consisted of|contained|included|comprised|had)\s*(\d+)",
]
SMALL_N_LINE = r"(?:^|(?<=\n)|(?<=\. )|(?<=; )|(?<=, ))(?=.{0,150}?(?:p\s*[<≤]\s*0[.]0(?:0[1-9]|1))).{0,50}?n\s*[=＝]\s*(\d+)"
SMALL_N_NEAR = r"(?:n\s*[=＝]\s*(\d+).{0,100}?p\s*[<≤]\s*0[.]0(?:0[1-9]|1))|(?:p\s*[<≤]\s*0[.]0(?:0[1-9]|1).{0,100}?n\s*[=＝]\s*(\d+))"
TECHNICAL = (
    r"triplicates?|technical\s*replicates?|(?:three|3)\s*(?:replicate\s*)?wells?(?:\s*per\s*(?:sample|condition))?|(?:three|3)\s*(?:technical|replicate)\s*(?:repeats?|experiments?)"
    r"|same\s*(?:sample|specimen|lysate|RNA|cDNA|extract).{0,30}?(?:three|3|triplicat)|each\s*(?:sample|experiment).{0,20}?(?:in|was)\s*(?:triplicat|three|3\s*(?:times|replicates?))"
    r"|performed\s*(?:in|with)\s*(?:three|3)\s*(?:independent\s*)?replicates?\s*(?:of\s*the\s*same|per\s*sample)"
)
HIDDEN_N = (
    r"(?:three|four|five|six|seven|eight|nine|ten|3|4|5|6|7|8|9|10)\s*(?:independent\s*(?:experiments?|biological|replicates?|animals?|mice|rats?|samples?|preparations?))"
    r"|in\s*(?:triplicate|quadruplicate|quintuplicate)|(?:three|four|five|3|4|5)\s*(?:mice|rats?|animals?|patients?)\s*(?:per|each|/)"
)
CITES_OTHERS = (
    r"\b(?:previously|recent\s+study|et\s+al|reported\s+by|review|meta[- ]analysis|cohorts?\s+from|in\s+literature|according\s+to|published\s+by|their\s+study|prior\s+work|other\s+groups?"
    r"|external\s+cohort|publicly\s+available|database\b|deposited|GEO\b|TCGA\b|GTEx\b)\b"
)
EXPERIMENTS = [
    ("in vitro", r"\b(?:cells?|HEK293|HeLa|CHO\b|fibroblast|epithelial|culture|in\s*vitro|transfection|lysate|western\s*blot|immunoblot|qPCR|RT[-\s]?PCR|flow\s*cytometry|FACS|ELISA|recombinant|plasmid)\b"),
    ("in vivo", r"\b(?:mice|mouse|rats?|rabbits?|dogs?|pigs?|swine|monkey|primate|animal|in\s*vivo|C57BL|BALB/c|SD\s*rat|IACUC|sacrificed|euthan|gavage|i\.p\.|i\.v\.)\b"),
    ("clinical", r"\b(?:patients?|human|subjects?|clinical|cohort|trial|randomi[sz]ed|IRB|informed\s*consent|placebo|epidemiology|prospective|retrospective)\b"),
]

#: What around a number tells that it is no measurement. Fixed values.
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
METADATA = [
    r"[Pp]\s*[<>=≤≥]\s*\d", r"\b[tFrRzZχ]\s*[=≈]\s*\d", r"\b[nN]\s*=\s*\d", r"(?i:(?:Figure|Fig\.?|Table)\s*\d)", r"\[\d+(?:\s*[,.\-–—]\s*\d+)*\]", r"\(\d+(?:\s*[,.\-–—]\s*\d+)*\)",
    r"(?i:doi\s*[:.]?\s*10\.\d)", r"(?:19|20)\d{2}\s*[-–—]\s*(?:19|20)\d{2}", rf"(?i:{_MONTH}\s+(?:19|20)\d{{2}})", r"(?:^|\n)\s*\d+\.\d+(?:\.\d+)?\s+[A-Z]", r"(?i:(?:95%?\s*)?CI\s*[=:]\s*\d)",
    r"(?:[Pp]age|[Pp]\.)\s*\d+", r"(?i:(?:Volume|Issue)\s+\d+)", rf"(?i:(?:Accepted|Published|Received)\s+\d+\s+{_MONTH}\s+(?:19|20)\d{{2}})", r"(?:^|\s|,)\d+(?:,\d+){2,}", r"[a-z],\d+(?:,\d+)*\b",
    r"[A-Za-z]{2,}[-–—]\d+\b", r"@\S+\.\d+", r"(?i:(?:Grant|Project)\s+(?:No\.?|Number)\s+\d+)",
]
P_THRESHOLDS = (0.05, 0.01, 0.001, 0.0001, 0.5, 1.0, 1.96)
P_NEARBY = r"(?i)P\s*[<>≤≥]\s*\d+\.\d+"
DOI_NEARBY = r"\b10\.\d{4,}"
VARIANT_NEARBY = r"\b[A-Z]{1,4}\.\d+(?:\.\d+)*\b"

#: Identifiers in posts. Fixed values.
DOI = r"""10\.\d{4,}/[^\s"'<>]+"""
PMID = r"\b\d{8}\b"

#: Words without weight in excerpts. Fixed values.
STOPWORDS = (
    "the a an of in to and or for with was were is are be by as at on from that this it not but we our their its has have had can may will would could also used using each all between"
).split()

#: How much a red, orange or yellow result of a check counts, what it scores, and the order of levels. Fixed values.
WEIGHTS = {
    "numbers.grim": 1.0, "numbers.statcheck": 0.9, "stats.sample_size": 0.85, "numbers.arithmetic": 0.8, "numbers.identical_values": 0.7, "bioinfo.western_blot": 0.6, "stats.method_misuse": 0.75,
    "stats.p_hacking": 0.5, "stats.normality_claim": 0.4, "numbers.benford": 0.4, "stats.fallacies": 0.4, "text.pvalue_camouflage": 0.3, "text.blacklist": 0.3, "numbers.digit": 0.3, "text.title_conclusion_gap": 0.3,
}
DEFAULT_WEIGHT = 0.5
VETO = ("numbers.grim", "numbers.arithmetic")
LEVELS = {"error": 0, "green": 1, "yellow": 2, "orange": 3, "red": 4}
SCORES = {"red": 25, "orange": 12, "yellow": 5}

#: Section names of a paper: name, expression of its heading. Fixed values.
SECTIONS = ("abstract", "introduction", "methods", "results", "discussion", "references")


def native(pattern: str) -> str:
    """A case-insensitive pattern for the JVM's engine, folding as Python does."""
    return f"(?iu){pattern}"
