import io
import zipfile

from pyspark.sql import functions as F

from inkprobe.operators import extract
from inkprobe.sources import files, posts, rules

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, tables=(), title="", creator=""):
    """A DOCX file of (text, style, bold, size) paragraphs and tables of cells."""
    body = ""
    for text, style, bold, size in paragraphs:
        r = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{int(size * 2)}"/>' if size else "")
        body += f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{r}</w:rPr><w:t>{text}</w:t></w:r></w:p>'
    for t in tables:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in t) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", f'<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:creator>{creator}</dc:creator></p>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Abstract", "Heading1", False, None), ("Short.", "", False, None), ("", "", False, None), ("Methods", "Heading1", False, None), ("We did.", "", False, None)], [[["x", "y"], ["1", "2"], ["", ""], ["3", "4"]], [["only", "head"]]], "T", "A; B"))
    (tmp_path / "b.docx").write_bytes(docx([("RESULTS", "", False, None), ("Found.", "", False, None), ("Discussion", "", True, 14), ("So.", "", False, None)]))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    parts = files.read_docx(spark, f"file://{tmp_path}")
    got = {r.path[-6]: r for r in parts.collect()}
    assert got["c"].error and not got["a"].error
    assert [t.asDict(True) for t in got["a"].tables] == [{"headers": ["x", "y"], "rows": [{"x": "1", "y": "2"}, {"x": "3", "y": "4"}]}]
    papers = {r.paper_id[-6]: r for r in files.papers_from_docx(parts).collect()}
    assert (papers["a"].title, papers["a"].authors, papers["a"].abstract, papers["a"].methods) == ("T", ["A", "B"], "Short.", "We did.")
    assert (papers["b"].results, papers["b"].discussion) == ("Found.", "So.")


def test_cells_of_messy_tables(spark, tmp_path):
    (tmp_path / "one.csv").write_text('\ufeffFigure 1\n\ngroup,"a,b",n\nx,1.5,\ny,2,3,extra\n')
    (tmp_path / "two.tsv").write_text("h\tk\n" + "\n".join(f"{i}\t{i / 4}" for i in range(12)))
    cells = files.read_cells(spark, f"file://{tmp_path}")
    one = {(r.row, r.col): (r.raw, r.value) for r in cells.where("file like '%one.csv'").collect()}
    assert one[2, 1] == ("a,b", None) and one[3, 1] == ("1.5", 1.5) and one[4, 3] == ("extra", None) and (3, 2) not in one
    assert {r.header for r in files.numeric_columns(cells).select("header").distinct().collect()} == {"h", "k"}


def test_supplementary(spark):
    papers = spark.createDataFrame([("d", "p"), ("d", "q"), ("e", "p")], "folder string, stem string")
    tables = spark.createDataFrame([("d/p.tsv", "p", "d", "tsv"), ("d/a.csv", "a", "d", "csv"), ("f/x.csv", "x", "f", "csv")], "path string, stem string, folder string, suffix string")
    got = {(r.folder, r.stem): r.data_file for r in files.supplementary(papers, tables).collect()}
    assert got == {("d", "p"): "d/p.tsv", ("d", "q"): "d/a.csv", ("e", "p"): None}


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<rss xmlns:dc="x" xmlns:content="y"><channel><item><guid>g1</guid><title>On 10.1234/abc</title><link>http://l</link><pubDate>Mon, 01 Jan 2024</pubDate><dc:creator>me</dc:creator>'
        "<content:encoded>&lt;p&gt;PMID 12345678 &lt;script&gt;no()&lt;/script&gt;text&lt;/p&gt;</content:encoded><description>short</description></item></channel></rss>"
    )
    r = posts.read_feed(spark, f"file://{tmp_path}/feed.xml").first()
    assert (r.source_id, r.author, r.content, r.dois, r.pmids) == ("g1", "me", "PMID 12345678 text", ["10.1234/abc"], ["12345678"])


def test_rules(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("overclaim:\n  - novel\n  - astonishing\npatterns:\n  - {pattern: 'p (x)', category: blacklist}\n")
    both = rules.union(rules.built_in(spark), rules.from_yaml(spark, f"file://{tmp_path}/r.yaml", "hype"))
    got = {r.pattern for r in both.where("kind = 'hype'").collect()}
    assert "astonishing" in got and both.where("pattern = 'novel'").count() == 1
    assert {r.pattern for r in rules.from_yaml(spark, f"file://{tmp_path}/r.yaml", "camouflage").collect()} >= {r"p\ \(x\)"}


def test_text_helpers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(extract.article_text(F.lit("<p>out</p><article>a<script>x</script> b&amp;c</article>"))) == "a b&c"
    assert value(extract.head_and_tail(F.lit("x" * 30), 20)) == "x" * 14 + "\n...\n" + "x" * 6
    assert value(extract.safe_name(F.lit(" a/b: c? "))) == "a_b__c"
    assert [value(extract.column_letters(F.lit(k))) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert value(extract.tolerant_json(F.lit('ok {"a": 1} end'), "a int"))["a"] == 1
    assert value(extract.tolerant_json(F.lit("none"), "a int")) is None
