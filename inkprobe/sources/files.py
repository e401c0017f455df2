"""File sources. Binary documents are read by Spark and opened beside the data, so any store that Spark reads will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SECTIONS
from ..schema import PAPERS

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = "path string, title string, authors array<string>, paragraphs array<struct<idx:int,text:string,style:string,bold:boolean,size:double>>, tables array<struct<headers:array<string>,rows:array<map<string,string>>>>, error string"


def find_documents(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(path, stem, folder, suffix) of all PDF and DOCX files below a folder, each once; ``most`` limits a trial run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").distinct()
    named = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"))
    found = named.where(F.col("suffix").isin("pdf", "docx"))
    return found if most is None else found.orderBy("path").limit(most)


def supplementary(papers: DataFrame, files: DataFrame) -> DataFrame:
    """``papers`` (folder, stem, ...) with data_file: the table of the same name, else the folder's first CSV or TSV."""
    tables = files.where(F.col("suffix").isin("csv", "tsv", "txt")).select(F.col("folder").alias("d"), F.col("stem").alias("s"), "suffix", F.col("path").alias("table"))
    order = F.struct((F.col("s") != F.col("stem")), F.array_position(F.array(F.lit("csv"), F.lit("tsv"), F.lit("txt")), F.col("suffix")), F.col("table"))
    fits = (F.col("s") == F.col("stem")) | F.col("suffix").isin("csv", "tsv")
    best = papers.join(tables, (papers["folder"] == F.col("d")) & fits).groupBy("folder", "stem").agg(F.min_by("table", order).alias("data_file"))
    return papers.drop("data_file").join(best, ["folder", "stem"], "left")


def docx_parts(data: bytes) -> tuple[str, list[str], list[tuple], list[dict]]:
    """Title, authors, paragraphs (text, style, bold, size) without the empty ones, and tables of a DOCX file."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(z.read("word/document.xml"))
    title, authors = "", []
    if "docProps/core.xml" in z.namelist():
        for e in ElementTree.fromstring(z.read("docProps/core.xml")):
            name = e.tag.rpartition("}")[2]
            if name == "title":
                title = e.text or ""
            elif name == "creator":
                authors = [a.strip() for a in re.split("[;,]", e.text or "") if a.strip()]
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    paragraphs, tables = [], []
    body = root.find(f"{W}body")
    for e in body if body is not None else ():
        if e.tag == f"{W}p" and text(e).strip():
            style = e.find(f"{W}pPr/{W}pStyle")
            runs = e.findall(f"{W}r")
            bold = bool(runs) and all(r.find(f"{W}rPr/{W}b") is not None for r in runs)
            sizes = [float(s.get(f"{W}val")) / 2 for r in runs if (s := r.find(f"{W}rPr/{W}sz")) is not None]
            paragraphs.append((len(paragraphs), text(e).strip(), style.get(f"{W}val") if style is not None else "", bold, max(sizes, default=None)))
        elif e.tag == f"{W}tbl":
            rows = [[text(c).strip() for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]
            rows = [r for k, r in enumerate(rows) if k == 0 or any(r)]
            if len(rows) >= 2:
                head = rows[0] if any(rows[0]) else [f"col_{k}" for k in range(len(rows[0]))]
                tables.append({"headers": head, "rows": [dict(zip(head, r)) for r in rows[1:]]})
    return title, authors, paragraphs, tables


#: Words that name a section in a heading. Fixed values.
HEADING_WORDS = {
    "abstract": ("abstract", "summary", "background"), "introduction": ("introduction",), "methods": ("method", "materials", "experimental"), "results": ("result", "finding"), "discussion": ("discussion", "conclusion"),
    "references": ("reference", "bibliography"),
}


def paragraph_sections(paragraphs: list[tuple]) -> dict[str, str]:
    """Sections by heading style; where there is none, by short lines in capitals or in large bold type."""

    def named(text: str) -> str | None:
        low = text.lower()
        return next((s for s, words in HEADING_WORDS.items() if any(w in low for w in words)), None)

    def looks(p, level):
        _, text, style, bold, size = p
        return style.lower().startswith("heading") if level == 1 else len(text) <= 80 and (text.isupper() or bool(bold and (size or 0) >= 14))

    for level in (1, 2):
        out, now = {}, None
        for p in paragraphs:
            if looks(p, level) and (s := named(p[1])):
                now = s if s not in out else None
                out.setdefault(s, [])
            elif now:
                out[now].append(p[1])
        if out:
            break
    found = {k: "\n\n".join(v) for k, v in out.items()}
    if not found.get("abstract"):
        long = next((p[1] for p in paragraphs if len(p[1]) > 150), None)
        found["abstract"] = long[:3000] if long else "\n\n".join(p[1] for p in paragraphs)[:2000]
    return found


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Parts of every DOCX file below a path; one that can't be read gives a row with its error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    title, authors, paragraphs, tables = docx_parts(data)
                    paragraphs = [dict(zip(("idx", "text", "style", "bold", "size"), p)) for p in paragraphs]
                    tables = [{"headers": t["headers"], "rows": [list(r.items()) for r in t["rows"]]} for t in tables]
                    rows.append({"path": name, "title": title, "authors": authors, "paragraphs": paragraphs, "tables": tables, "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({"path": name, "title": "", "authors": [], "paragraphs": [], "tables": [], "error": f"{type(e).__name__}: {e}"[:200]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], PARTS).schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInArrow(run, PARTS)


def papers_from_docx(parts: DataFrame) -> DataFrame:
    """Papers from DOCX parts."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                own = [(p["idx"], p["text"], p["style"], p["bold"], p["size"]) for p in r["paragraphs"]]
                s = paragraph_sections(own)
                rows.append([r["path"], r["title"], list(r["authors"]), "", None, "", *[s.get(k, "") for k in SECTIONS[:5]], "\n\n".join(p[1] for p in own), ""])
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PAPERS.split(", ")])

    return parts.where("error is null").mapInPandas(run, PAPERS)


def papers_from_text(files: DataFrame, extract: Callable[[bytes, str], str]) -> DataFrame:
    """(path, text) of binary documents by an extractor of your own, for formats whose libraries aren't here."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(text=[extract(bytes(d), p) for p, d in zip(pdf.path, pdf.content)])[["path", "text"]]

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, col, raw, value) of delimited files without a reliable header: a file's delimiter is the tab where its
    head has more tabs than commas; quotes and byte order marks are understood. A file is one sheet."""

    def run(batches: Iterator) -> Iterator:
        import csv

        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf.path, pdf.content):
                text = bytes(data).decode("utf-8-sig", "replace")
                head = text[:4096]
                rows = csv.reader(io.StringIO(text), delimiter="\t" if head.count("\t") > head.count(",") else ",")
                held = []
                for r, cells in enumerate(rows):
                    held += [(name, "", r, c, raw) for c, raw in enumerate(cells) if raw.strip()]
                    if len(held) > 50_000:
                        yield pd.DataFrame(held, columns=["file", "sheet", "row", "col", "raw"])
                        held = []
                yield pd.DataFrame(held, columns=["file", "sheet", "row", "col", "raw"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(csv|tsv|txt)$")).select("path", "content")
    return files.mapInPandas(run, "file string, sheet string, row int, col int, raw string").withColumn("value", F.expr("try_cast(trim(raw) as double)"))


def numeric_columns(cells: DataFrame, least: int = 10) -> DataFrame:
    """(file, sheet, header, row, value) of columns with at least so many numbers, named by their first cell."""
    wide = cells.where("value is not null").groupBy("file", "sheet", "col").agg(F.count("*").alias("k")).where(F.col("k") >= least).drop("k")
    headers = cells.where("row = 0").select("file", "sheet", "col", F.trim("raw").alias("header"))
    return cells.where("value is not null").join(wide, ["file", "sheet", "col"]).join(headers, ["file", "sheet", "col"], "left").select("file", "sheet", "col", "header", "row", "value")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
