"""Queries over chapters. The tables hold none, so a few are listed here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import rendering
from quirespark.operators.chains import tree_index
from quirespark.operators.measures import normalized_levels
from quirespark.plans.scalars import _listed
from quirespark.sources import xhtml

c = F.col
_HEAD = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>x</title></head><body>'
CHAPTERS = [
    ("d", "OEBPS/c1.xhtml", _HEAD + """<h1 id="top">One &amp; only</h1><p>See <a href="c2.xhtml#n1" epub:type="noteref">1</a>, <em>the <b>big</b></em> <a href="#top">top</a>, <a href="https://example.org/x">site</a>, <a href="gone.xhtml">gone</a>, <a href="javascript:x">bad</a>.</p>
<div>loose <span xml:lang="pt">texto</span></div><h4>Deep</h4><figure><img src="img/a.png" alt="A"/><figcaption>Cap</figcaption></figure><img src="img/none.png"/><hr/></body></html>"""),
    ("d", "OEBPS/c2.xhtml", _HEAD + """<section><ol start="3"><li>a<ul><li>b</li></ul></li></ol></section><aside epub:type="footnote" id="n1"><p>Note</p></aside><table><caption>T</caption><tr><th id="h" scope="col">H</th><td headers="h x" colspan="2">1</td></tr></table>
<pre> a
  b</pre><p><ruby>字<rt>zi</rt></ruby><bdo dir="rtl">r</bdo><br/><math alttext="x+1"><mi>x</mi></math></p></body></html>"""),
    ("e", "x.xhtml", "<html><body><p>open"), ("f", "y.xhtml", None),
]
ASSETS = [("d", "OEBPS/img/a.png", "AA"), ("d", "OEBPS/img/b.png", "AA")]


def _rows(spark: SparkSession) -> DataFrame:
    data = [(d, r, None if t is None else bytearray(t.encode())) for d, r, t in CHAPTERS]
    return xhtml.chapter_rows(spark.createDataFrame(data, "doc_id string, resource string, data binary"))


def cnv_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNV1, CNV2, CNV8–25, CNV30, TRE2: the nodes of chapters."""
    n = xhtml.nodes(_rows(spark))
    return n.select("doc_id", "node_id", "parent_id", "node_type", "level", "list_start", "col_span", F.array_join("headers", " ").alias("headers"), "source_id", "asset_path")


NODES = [
    ("d", "n1-0", None, "chapter", None, None, None, None, None, None), ("d", "n1-1", "n1-0", "heading", 1, None, None, None, "top", None), ("d", "n1-2", "n1-0", "paragraph", None, None, None, None, None, None), ("d", "n1-3", "n1-0", "paragraph", None, None, None, None, None, None),
    ("d", "n1-4", "n1-0", "heading", 4, None, None, None, None, None), ("d", "n1-5", "n1-0", "figure", None, None, None, None, None, "OEBPS/img/a.png"), ("d", "n1-6", "n1-5", "caption", None, None, None, None, None, None), ("d", "n1-7", "n1-0", "figure", None, None, None, None, None, "OEBPS/img/none.png"),
    ("d", "n1-8", "n1-0", "horizontal-rule", None, None, None, None, None, None), ("d", "n2-0", None, "chapter", None, None, None, None, None, None), ("d", "n2-1", "n2-0", "section", None, None, None, None, None, None), ("d", "n2-2", "n2-1", "ordered-list", None, 3, None, None, None, None),
    ("d", "n2-3", "n2-2", "list-item", None, None, None, None, None, None), ("d", "n2-4", "n2-3", "paragraph", None, None, None, None, None, None), ("d", "n2-5", "n2-3", "unordered-list", None, None, None, None, None, None), ("d", "n2-6", "n2-5", "list-item", None, None, None, None, None, None),
    ("d", "n2-7", "n2-6", "paragraph", None, None, None, None, None, None), ("d", "n2-8", "n2-0", "footnote", None, None, None, None, "n1", None), ("d", "n2-9", "n2-8", "paragraph", None, None, None, None, None, None), ("d", "n2-10", "n2-0", "table", None, None, None, None, None, None),
    ("d", "n2-11", "n2-10", "table-caption", None, None, None, None, None, None), ("d", "n2-12", "n2-10", "table-body", None, None, None, None, None, None), ("d", "n2-13", "n2-12", "table-row", None, None, None, None, None, None), ("d", "n2-14", "n2-13", "table-header", None, None, 1, None, "h", None),
    ("d", "n2-15", "n2-14", "paragraph", None, None, None, None, None, None), ("d", "n2-16", "n2-13", "table-cell", None, None, 2, "h x", None, None), ("d", "n2-17", "n2-16", "paragraph", None, None, None, None, None, None),
    ("d", "n2-18", "n2-0", "code-block", None, None, None, None, None, None), ("d", "n2-19", "n2-0", "paragraph", None, None, None, None, None, None),
    ("e", "n1-0", None, "broken-chapter", None, None, None, None, None, None), ("f", "n1-0", None, "broken-chapter", None, None, None, None, None, None),
]


def cnv_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CNV26–28, JON8–11: the links of chapters and where they lead."""
    rows = _rows(spark)
    return xhtml.resolved_links(xhtml.inlines(rows), xhtml.nodes(rows)).select("doc_id", "owner_id", "target", "link_kind", "target_id", "target_type")


LINKS = [
    ("d", "n1-2", "c2.xhtml#n1", "internal", "n2-8", "footnote"), ("d", "n1-2", "#top", "internal", "n1-1", "heading"), ("d", "n1-2", "https://example.org/x", "external", None, None), ("d", "n1-2", "gone.xhtml", "broken", None, None), ("d", "n1-2", "javascript:x", "unsafe", None, None),
]


def rnd_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4, RND1–7: the pages of chapters."""
    rows = _rows(spark)
    nodes = xhtml.nodes(rows)
    return rendering.pages(nodes, xhtml.linked_inlines(xhtml.inlines(rows), nodes))


PAGES = [
    ("d", "OEBPS/c1.xhtml", '<article id="n1-0"><h1 id="n1-1">One &amp; only</h1><p id="n1-2">See <a href="#n2-8">1</a>, <em>the <strong>big</strong></em> <a href="#n1-1">top</a>, <a href="https://example.org/x">site</a>, <a>gone</a>, <a>bad</a>.</p><p id="n1-3">loose <span lang="pt">texto</span></p><h4 id="n1-4">Deep</h4><figure id="n1-5"><img src="OEBPS/img/a.png" alt="A"/><figcaption id="n1-6">Cap</figcaption></figure><figure id="n1-7"><img src="OEBPS/img/none.png" alt=""/></figure><hr id="n1-8"/></article>'),
    ("d", "OEBPS/c2.xhtml", '<article id="n2-0"><section id="n2-1"><ol id="n2-2" start="3"><li id="n2-3"><p id="n2-4">a</p><ul id="n2-5"><li id="n2-6"><p id="n2-7">b</p></li></ul></li></ol></section><aside id="n2-8"><p id="n2-9">Note</p></aside><table id="n2-10"><caption id="n2-11">T</caption><tbody id="n2-12"><tr id="n2-13"><th id="n2-14" scope="col"><p id="n2-15">H</p></th><td id="n2-16" colspan="2" headers="h x"><p id="n2-17">1</p></td></tr></tbody></table><pre id="n2-18"> a\n  b</pre><p id="n2-19"><ruby>字<rt>zi</rt></ruby><bdo dir="rtl">r</bdo><br/><span>x+1</span></p></article>'),
    ("e", "x.xhtml", '<article id="n1-0"></article>'), ("f", "y.xhtml", '<article id="n1-0"></article>'),
]


def int_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INT1, INT2, INT6: documents have one digest whatever the order of their rows, and another one when anything is changed."""
    rows = _rows(spark)
    nodes, inlines = xhtml.nodes(rows), xhtml.inlines(rows)
    one = rendering.document_hashes(nodes, inlines)
    other = rendering.document_hashes(nodes.repartition(3), inlines.orderBy(F.desc("inline_ord"))).select(c("doc_id").alias("od"), c("sha256").alias("again"))
    changed = rendering.document_hashes(nodes, inlines.withColumn("value", F.when(c("value") == "big", "bigger").otherwise(c("value")))).select(c("doc_id").alias("cd"), c("sha256").alias("changed"))
    both = one.join(other, c("doc_id") == c("od")).join(changed, c("doc_id") == c("cd"))
    return both.select("doc_id", "n_nodes", (c("sha256") == c("again")).alias("is_stable"), (c("sha256") != c("changed")).alias("is_changed"), F.length("sha256").alias("n_digits"))


def qlt_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QLT19, QLT22–25, QLT28–35: what of the documents leads where it should."""
    rows = _rows(spark)
    nodes = xhtml.nodes(rows)
    return rendering.audits(nodes, xhtml.resolved_links(xhtml.inlines(rows), nodes), spark.createDataFrame(ASSETS, "doc_id string, path string, sha256 string"))


AUDITS = [("d", "links-inside", 3, 1, 2), ("d", "links-external", 1, 1, 0), ("d", "note-references", 1, 1, 0), ("d", "figures", 2, 1, 1), ("d", "table-bodies", 1, 1, 0), ("d", "table-spans", 2, 1, 1), ("d", "assets", 1, 0, 1)]


def agg_produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25, AGG26, AGG29, AGG30, WIN1: what documents hold by kind, with headings at their normal level."""
    rows = _rows(spark)
    nodes = xhtml.nodes(rows)
    levels = normalized_levels(tree_index(nodes).where("node_type = 'heading'").select("doc_id", "resource", "level", "node_no"), ["doc_id", "resource"], ["node_no"], "level")
    return rendering.produced(nodes, xhtml.inlines(rows)).unionByName(levels.groupBy("doc_id").agg(F.lit("levels").alias("metric"), F.sum("normal_level").cast("bigint").alias("n")))


PRODUCED = [
    ("d", "caption", 1), ("d", "chapter", 2), ("d", "characters", 69), ("d", "code-block", 1), ("d", "figure", 2), ("d", "footnote", 1), ("d", "heading", 2), ("d", "horizontal-rule", 1), ("d", "inline-bidirectional", 1), ("d", "inline-emphasis", 1), ("d", "inline-footnote-reference", 1),
    ("d", "inline-language", 1), ("d", "inline-line-break", 1), ("d", "inline-link", 4), ("d", "inline-math", 1), ("d", "inline-ruby", 1), ("d", "inline-ruby-annotation", 1), ("d", "inline-strong", 1), ("d", "inline-text", 29), ("d", "levels", 3), ("d", "list-item", 2), ("d", "ordered-list", 1),
    ("d", "paragraph", 8), ("d", "section", 1), ("d", "table", 1), ("d", "table-body", 1), ("d", "table-caption", 1), ("d", "table-cell", 1), ("d", "table-header", 1), ("d", "table-row", 1), ("d", "unordered-list", 1), ("e", "broken-chapter", 1), ("f", "broken-chapter", 1),
]

QUERIES = {f.__name__: f for f in (cnv_nodes, cnv_links, rnd_pages, int_hashes, qlt_audits, agg_produced)}
SQL = {
    "cnv_nodes": f"SELECT * FROM (VALUES {_listed(*NODES)}) AS t(doc_id, node_id, parent_id, node_type, level, list_start, col_span, headers, source_id, asset_path)",
    "cnv_links": f"SELECT * FROM (VALUES {_listed(*LINKS)}) AS t(doc_id, owner_id, target, link_kind, target_id, target_type)",
    "rnd_pages": f"SELECT * FROM (VALUES {_listed(*PAGES)}) AS t(doc_id, resource, html)",
    "int_hashes": "SELECT doc_id, CAST(n AS BIGINT) AS n_nodes, is_stable, is_changed, n_digits FROM (VALUES ('d', 29, true, true, 64), ('e', 1, true, false, 64), ('f', 1, true, false, 64)) AS t(doc_id, n, is_stable, is_changed, n_digits)",
    "agg_produced": f"SELECT doc_id, metric, CAST(n AS BIGINT) AS n FROM (VALUES {_listed(*PRODUCED)}) AS t(doc_id, metric, n)",
    "qlt_audits": f"SELECT doc_id, audit, CAST(a AS BIGINT) AS n_total, CAST(b AS BIGINT) AS n_resolved, CAST(d AS BIGINT) AS n_broken FROM (VALUES {_listed(*AUDITS)}) AS t(doc_id, audit, a, b, d)",
}
