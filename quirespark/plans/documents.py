"""Queries over document trees: rules, chains, lookups, style sheets and layout. The tables hold no trees, so these are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import css, layout
from quirespark.operators.chains import chain_ends, nearest_ancestor, tree_index
from quirespark.operators.validation import validated
from quirespark.plans.scalars import _listed
from quirespark.session import table

c = F.col

NODES = [
    ("good", "c1", None, "chapter", 0, None, None, None), ("good", "h1", "c1", "heading", 0, 1, None, None), ("good", "h2", "c1", "heading", 1, 2, None, None), ("good", "p1", "c1", "paragraph", 2, None, None, None),
    ("good", "f1", "c1", "figure", 3, None, "cover.png", None), ("good", "cap1", "f1", "caption", 0, None, None, None), ("good", "n1", "c1", "footnote", 4, None, None, None), ("good", "t1", "c1", "table", 5, None, None, None),
    ("good", "b1", "t1", "table-body", 0, None, None, None), ("good", "r1", "b1", "table-row", 0, None, None, None), ("good", "th1", "r1", "table-header", 0, None, None, None), ("good", "td1", "r1", "table-cell", 1, None, None, "th1"),
    ("bad", "c1", None, "chapter", 0, None, None, None), ("bad", "Bad Id", "c1", "paragraph", 0, None, None, None), ("bad", "twice", "c1", "paragraph", 1, None, None, None), ("bad", "twice", "c1", "paragraph", 2, None, None, None),
    ("bad", "c2", "c1", "chapter", 3, None, None, None), ("bad", "li", "c1", "list-item", 4, None, None, None), ("bad", "h1", "c1", "heading", 5, 1, None, None), ("bad", "h3", "c1", "heading", 6, 3, None, None), ("bad", "h9", "c1", "heading", 7, 9, None, None),
    ("bad", "h5", "c2", "heading", 0, 5, None, None), ("bad", "f1", "c1", "figure", 8, None, "gone.png", None), ("bad", "n1", "c1", "footnote", 9, None, None, None), ("bad", "n2", "n1", "footnote", 0, None, None, None),
    ("bad", "t1", "c1", "table", 10, None, None, None), ("bad", "b1", "t1", "table-body", 0, None, None, None), ("bad", "r1", "b1", "table-row", 0, None, None, None), ("bad", "td1", "r1", "table-cell", 0, None, None, "h1 th2"),
    ("bad", "t2", "td1", "table", 0, None, None, None), ("bad", "b2", "t2", "table-body", 0, None, None, None), ("bad", "r2", "b2", "table-row", 0, None, None, None), ("bad", "th2", "r2", "table-header", 0, None, None, None),
]
INLINES = [
    ("good", "p1", 0, None, "link", None, "flow:c1/h2", None), ("good", "p1", 1, None, "link", None, "flow:h2", None), ("good", "p1", 2, None, "footnote-reference", None, "n1", None), ("good", "p1", 3, None, "language", "pt-BR", None, None),
    ("good", "p1", 4, None, "ruby", None, None, None), ("good", "p1", 5, 4, "text", "字", None, None), ("good", "p1", 6, 4, "ruby-annotation", None, None, None), ("good", "p1", 7, None, "bidirectional", "rtl", None, "override"),
    ("bad", "twice", 0, None, "link", None, "flow:Not/An/Anchor", None), ("bad", "twice", 1, None, "link", None, "flow:twice", None), ("bad", "twice", 2, None, "link", None, "https://example.org", None), ("bad", "twice", 3, None, "footnote-reference", None, "h1", None),
    ("bad", "twice", 4, None, "language", "not a tag", None, None), ("bad", "twice", 5, None, "bidirectional", "auto", None, "override"), ("bad", "twice", 6, None, "ruby", None, None, None), ("bad", "twice", 7, 6, "text", "x", None, None),
    ("bad", "twice", 8, None, "ruby-annotation", None, None, None), ("bad", "twice", 9, None, "ruby", None, None, None), ("bad", "twice", 10, 9, "ruby", None, None, None), ("bad", "twice", 11, 9, "ruby-annotation", None, None, None),
    ("bad", "twice", 12, 10, "text", "y", None, None), ("bad", "twice", 13, 10, "ruby-annotation", None, None, None),
]
ASSETS, COVERS = [("good", "cover.png")], [("good", "f1"), ("bad", "p1")]
ENTRIES = [("good", "toc", "flow:h1", 1, 2), ("good", "toc", "flow:c1/h2", 2, 2), ("bad", "toc", "flow:f1", 1, 2), ("bad", "toc", "flow:h1", 3, 2), ("bad", "toc", "flow:none", 1, 2)]
FINDINGS = [
    ("bad", 1, "INVALID_COVER_FIGURE", "p1", "p1"), ("bad", 2, "INVALID_NODE_ID", "Bad Id", "Bad Id"), ("bad", 2, "DUPLICATE_NODE_ID", "twice", "2"), ("bad", 3, "INVALID_HIERARCHY", "c2", "chapter in chapter"),
    ("bad", 3, "INVALID_HIERARCHY", "li", "list-item in chapter"), ("bad", 3, "INVALID_HIERARCHY", "n2", "footnote in footnote"), ("bad", 4, "INVALID_HEADING_LEVEL", "h3", "1 to 3"), ("bad", 4, "INVALID_HEADING_LEVEL", "h9", "9"),
    ("bad", 5, "MISSING_FIGURE_ASSET", "f1", "gone.png"), ("bad", 6, "INVALID_ANCHOR", "twice", "flow:Not/An/Anchor"), ("bad", 6, "UNRESOLVED_ANCHOR", "twice", "flow:twice"), ("bad", 6, "UNRESOLVED_FOOTNOTE_REFERENCE", "twice", "h1"),
    ("bad", 7, "INVALID_TOC_TARGET", "toc", "flow:f1 at 1"), ("bad", 7, "INVALID_TOC_TARGET", "toc", "flow:h1 at 3"), ("bad", 7, "INVALID_TOC_TARGET", "toc", "flow:none at 1"),
    ("bad", 8, "UNRESOLVED_TABLE_HEADER_REFERENCE", "td1", "h1"), ("bad", 8, "UNRESOLVED_TABLE_HEADER_REFERENCE", "td1", "th2"), ("bad", 9, "INVALID_LANGUAGE_TAG", "twice", "not a tag"), ("bad", 9, "INVALID_BIDIRECTIONAL_STRUCTURE", "twice", "auto"),
    ("bad", 9, "INVALID_RUBY_STRUCTURE", "twice", "ruby"), ("bad", 9, "INVALID_RUBY_STRUCTURE", "twice", "ruby"), ("bad", 9, "INVALID_RUBY_STRUCTURE", "twice", "ruby-annotation"),
]


def _nodes(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(NODES, "doc_id string, node_id string, parent_id string, node_type string, ord int, level int, asset_id string, headers string")
    return rows.withColumn("headers", F.split("headers", " "))


def flt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1–12, JON10, JON12, JON15, JON16, TRE8, TRE9: what rules find in one good and one bad document."""
    inlines = spark.createDataFrame(INLINES, "doc_id string, owner_id string, inline_ord int, parent_ord int, kind string, value string, target string, mode string")
    covers, assets = spark.createDataFrame(COVERS, "doc_id string, figure_id string"), spark.createDataFrame(ASSETS, "doc_id string, asset_id string")
    return validated(_nodes(spark), inlines, assets, covers, spark.createDataFrame(ENTRIES, "doc_id string, owner_id string, target string, level int, max_depth int"))


FLT_FINDINGS = f"SELECT * REPLACE ('FLOW_' || code AS code) FROM (VALUES {_listed(*FINDINGS)}) AS t(doc_id, pass_no, code, node_id, detail)"


def tre_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRE1–4, TRE8–11: paths, depths and the nearest chapter and table of the nodes with identifiers of their own."""
    index = tree_index(_nodes(spark).where("node_id <> 'twice'").drop("headers"))
    near = nearest_ancestor(nearest_ancestor(index, c("node_type") == "chapter", "chapter_id"), c("node_type") == "table", "table_id")
    return near.select("doc_id", "node_id", "depth", F.array_join("path", "/").alias("path"), "chapter_id", "table_id")


TRE_INDEX = f"""WITH RECURSIVE n AS (SELECT * FROM (VALUES {_listed(*[r[:4] for r in NODES if r[1] != 'twice'])}) AS t(doc_id, node_id, parent_id, node_type)),
  w AS (SELECT doc_id, node_id, 0 AS depth, node_id AS path, CAST(NULL AS VARCHAR) AS chapter_id, CAST(NULL AS VARCHAR) AS table_id, node_type FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.doc_id, n.node_id, w.depth + 1, w.path || '/' || n.node_id, CASE WHEN w.node_type = 'chapter' THEN w.node_id ELSE w.chapter_id END, CASE WHEN w.node_type = 'table' THEN w.node_id ELSE w.table_id END, n.node_type
  FROM w JOIN n ON n.doc_id = w.doc_id AND n.parent_id = w.node_id) SELECT doc_id, node_id, depth, path, chapter_id, table_id FROM w"""


def _fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all fallback chains: from each item to the one after it."""
    chains = table(spark, sf_dir, "spine_decision").select("pub_id", F.filter("fallback_chain", lambda x: x.isNotNull()).alias("chain"))
    links = F.transform(F.sequence(F.lit(1), F.size("chain")), lambda i: F.struct(F.get("chain", i - 1).alias("item"), F.get("chain", i).alias("following")))
    return chains.where(F.size("chain") > 0).select("pub_id", F.explode(links).alias("l")).select("pub_id", "l.item", "l.following").distinct()


def jon_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON3, JON4, TRE5–7: where the fallback chain from each item of each publication ends, in how many steps, or in a circle."""
    return chain_ends(_fallbacks(spark, sf_dir), ["pub_id"], "item", "following")


JON_FALLBACKS = """WITH RECURSIVE l AS (SELECT pub_id, item, min(following) AS following FROM (SELECT pub_id, chain[i] AS item, chain[i + 1] AS following
    FROM (SELECT pub_id, chain, unnest(range(1, len(chain) + 1)) AS i FROM (SELECT pub_id, list_filter(fallback_chain, lambda x: x IS NOT NULL) AS chain FROM spine_decision))) GROUP BY 1, 2),
  w AS (SELECT pub_id, item, item AS here, 0 AS steps, [item] AS seen, false AS is_circular FROM l
  UNION ALL SELECT w.pub_id, w.item, l.following, w.steps + 1, list_append(seen, l.following), list_contains(seen, l.following)
  FROM w JOIN l ON l.pub_id = w.pub_id AND l.item = w.here WHERE NOT w.is_circular AND l.following IS NOT NULL)
SELECT pub_id, item, CASE WHEN NOT is_circular THEN here END AS last, CASE WHEN NOT is_circular THEN CAST(steps AS BIGINT) END AS steps, is_circular FROM w QUALIFY row_number() OVER (PARTITION BY pub_id, item ORDER BY steps DESC) = 1"""


def jon_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON1, JON2, JON5, JON23, FLT16: the decisions with the catalog: whether their publication is in it, and what of it isn't used."""
    decisions = table(spark, sf_dir, "spine_decision").groupBy("pub_id").agg(F.count("*").alias("n_decisions"), F.count_if(c("selected_path").isNull()).alias("n_unresolved"), F.count_distinct(F.lower("selected_path")).alias("n_paths"))
    held = table(spark, sf_dir, "corpus_catalog").select(c("pub_id").alias("catalog_id"), "relative_path")
    both = decisions.join(held, decisions["pub_id"] == held["catalog_id"], "full")
    return both.select(F.coalesce("pub_id", "catalog_id").alias("pub_id"), c("catalog_id").isNotNull().alias("in_catalog"), F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"), F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


JON_SPINE = """SELECT coalesce(d.pub_id, k.pub_id) AS pub_id, k.pub_id IS NOT NULL AS in_catalog, coalesce(n_decisions, 0) AS n_decisions, coalesce(n_unresolved, 0) AS n_unresolved, coalesce(n_paths, 0) AS n_paths
FROM (SELECT pub_id, count(*) AS n_decisions, count(*) FILTER (WHERE selected_path IS NULL) AS n_unresolved, count(DISTINCT lower(selected_path)) AS n_paths FROM spine_decision GROUP BY 1) d FULL JOIN corpus_catalog k ON k.pub_id = d.pub_id"""


def jon_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON13, JON18–20, JON24: findings without a node get the first node of their resource in the same document."""
    rows = table(spark, sf_dir, "diagnostics")
    known = rows.where("node_id IS NOT NULL AND resource IS NOT NULL").groupBy(c("doc_id").alias("kd"), c("resource").alias("kr")).agg(F.min(F.struct("ord", "node_id")).alias("first"))
    asked = rows.where("node_id IS NULL").groupBy("doc_id", "resource").agg(F.count("*").alias("n_rows"))
    found = asked.join(known, (asked["doc_id"] == known["kd"]) & (asked["resource"] == known["kr"]), "left")
    return found.select("doc_id", "resource", "n_rows", c("first.node_id").alias("node_id"))


JON_PLACES = """SELECT a.doc_id, a.resource, n_rows, k.node_id FROM (SELECT doc_id, resource, count(*) AS n_rows FROM diagnostics WHERE node_id IS NULL GROUP BY 1, 2) a
LEFT JOIN (SELECT doc_id, resource, node_id FROM diagnostics WHERE node_id IS NOT NULL AND resource IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, resource ORDER BY ord NULLS FIRST, node_id) = 1) k ON k.doc_id = a.doc_id AND k.resource = a.resource"""

SHEETS = [
    ("d", 0, "@charset \"utf-8\"; /* a { } */ p, .lead { color: red; font-size: 12px; margin: 1em 2em 3em } p.lead { font-size: 14px } #x { FONT-WEIGHT: bold; text-align: RIGHT }"),
    ("d", 1, "* { line-height: 150% } p > a { font-size: 1px } em { font-style: italic; background: url(a.png) } @media print { p { font-size: 1px } } h1 { font-family: \"A, B\", serif; text-decoration: underline line-through }"),
    ("d", 2, "p { font-size: 13px !important } p { text-indent: 0 ; letter-spacing: normal } broken { font-size: 1px"), ("e", 0, None),
]
ELEMENTS = [("d", "body", None, "body", 0, None, None, "text-transform: uppercase"), ("d", "h", "body", "h1", 0, None, None, None), ("d", "x", "body", "p", 1, "x", "lead", None), ("d", "em", "x", "em", 0, None, None, None), ("d", "y", "body", "P", 2, None, None, "font-size: 2rem; margin-top: 5px"), ("e", "z", None, "p", 0, None, "lead", None)]
STYLES = [
    ("d", "body", "line-height", "150%"), ("d", "body", "text-transform", "uppercase"), ("d", "h", "font-family", '"A, B", serif'), ("d", "h", "line-height", "150%"), ("d", "h", "text-decoration", "underline line-through"), ("d", "h", "text-transform", "uppercase"),
    ("d", "x", "font-size", "14px"), ("d", "x", "font-weight", "bold"), ("d", "x", "letter-spacing", "normal"), ("d", "x", "line-height", "150%"), ("d", "x", "margin-block-end", "3em"), ("d", "x", "margin-block-start", "1em"), ("d", "x", "text-align", "RIGHT"),
    ("d", "x", "text-indent", "0"), ("d", "x", "text-transform", "uppercase"), ("d", "em", "font-size", "14px"), ("d", "em", "font-style", "italic"), ("d", "em", "font-weight", "bold"), ("d", "em", "letter-spacing", "normal"), ("d", "em", "line-height", "150%"),
    ("d", "em", "text-align", "RIGHT"), ("d", "em", "text-indent", "0"), ("d", "em", "text-transform", "uppercase"), ("d", "y", "font-size", "2rem"), ("d", "y", "letter-spacing", "normal"), ("d", "y", "line-height", "150%"), ("d", "y", "margin-block-end", "3em"),
    ("d", "y", "margin-block-start", "1em"), ("d", "y", "margin-top", "5px"), ("d", "y", "text-indent", "0"), ("d", "y", "text-transform", "uppercase"),
]


def _elements(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ELEMENTS, "doc_id string, node_id string, parent_id string, element string, ord int, id string, classes string, style string")
    return rows.withColumn("classes", F.split("classes", " "))


def _styles(spark: SparkSession) -> DataFrame:
    elements = _elements(spark)
    sheets = spark.createDataFrame(SHEETS, "doc_id string, sheet_ord int, css string")
    return css.styled(elements, tree_index(elements), css.rules(sheets))


def css_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSS1–7, CSS9–12: the cascaded and inherited values of each element."""
    return _styles(spark)


def css_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSS8, CSS13–20: the typed values of each element."""
    t = css.typed(_styles(spark), _elements(spark))
    return t.select("doc_id", "node_id", "font_family", c("font_size.value").alias("size"), c("font_size.unit").alias("size_unit"), "font_weight", "font_style", "line_height", c("letter_spacing.unit").alias("spacing_unit"), "text_align", "text_transform", "text_decoration", c("indent.unit").alias("indent_unit"), c("margin_before.value").alias("before"), c("margin_after.value").alias("after"))


TYPED = [
    ("d", "body", None, None, None, None, None, 1.5, None, None, "uppercase", None, None, None, None), ("d", "h", None, None, None, None, None, 1.5, None, None, "uppercase", 3, None, None, None), ("d", "x", None, 14.0, "px", 700, None, 1.5, "em", "end", "uppercase", None, "px", 1.0, 3.0),
    ("d", "em", None, 14.0, "px", 700, "italic", 1.5, "em", "end", "uppercase", None, "px", None, None), ("d", "y", None, 2.0, "rem", None, None, 1.5, "em", None, "uppercase", None, "px", 1.0, 3.0),
]
CSS_VALUES = [
    ("12px", 12.0, "px", None, None), ("-1.5EM", -1.5, "em", None, None), ("0", 0.0, "px", None, None), ("5", None, None, None, 5.0), ("10pt", None, None, None, None), (" 50% ", 50.0, "%", None, 0.5), ("bold", None, None, 700, None), ("300", None, None, 300, 300.0), ("1e3px", 1000.0, "px", None, None), ("px", None, None, None, None), (".5rem", 0.5, "rem", None, None),
]


def css_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSS14, CSS16, CSS18 over listed values."""
    from quirespark.functions import css_values as v

    rows = spark.createDataFrame([(x[0],) for x in CSS_VALUES], "text string")
    size = v.length(c("text"))
    return rows.select("text", size["value"].alias("number"), size["unit"].alias("unit"), v.font_weight(c("text")).alias("weight"), v.line_height(c("text")).alias("line"))


CONTEXTS = [("small", 599.0, True, "page"), ("medium", 600.0, True, "page"), ("large", 1200.0, False, "page"), ("wide", 1400.0, True, None)]


def lay_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY1–6, LAY13: profile, role and intent of the nodes of a document in four viewports."""
    nodes = _nodes(spark).where("doc_id = 'good'").drop("doc_id", "headers")
    contexts = spark.createDataFrame(CONTEXTS, "doc_id string, width double, two_columns boolean, placement string")
    each = nodes.withColumn("doc_id", F.explode(F.array(*[F.lit(x[0]) for x in CONTEXTS])))
    out = layout.laid_out(each, contexts)
    return out.select("doc_id", "node_id", "role", c("profile.category").alias("category"), c("profile.columns").alias("columns"), c("profile.margin.value").alias("margin"), c("profile.gap.value").alias("gap"), c("profile.max_width.unit").alias("width_unit"), c("intent.placement").alias("placement"), c("intent.keep_with_next").alias("keep"))


LAY_PROFILES = f"""SELECT x.doc_id, n.node_id, CASE WHEN node_type = 'heading' AND level = 1 THEN 'chapter-title' WHEN node_type = 'heading' THEN 'heading-' || level WHEN node_type = 'caption' THEN 'caption' WHEN node_type = 'footnote' THEN 'footnote' ELSE 'body' END AS role,
  category, CASE WHEN category = 'large' AND two_columns THEN 2 ELSE 1 END AS columns, CASE category WHEN 'small' THEN 16.0 WHEN 'medium' THEN 32.0 ELSE 64.0 END AS margin, CASE WHEN category = 'large' AND two_columns THEN 48.0 ELSE 0.0 END AS gap,
  CASE category WHEN 'small' THEN '%' ELSE 'px' END AS width_unit, CASE WHEN node_type = 'figure' THEN CASE WHEN category = 'small' THEN 'block' ELSE coalesce(placement, 'renderer-choice') END WHEN node_type = 'footnote' THEN 'renderer-choice' END AS placement, node_type = 'heading' AS keep
FROM (SELECT *, CASE WHEN width < 600 THEN 'small' WHEN width < 1200 THEN 'medium' ELSE 'large' END AS category FROM (VALUES {_listed(*CONTEXTS)}) AS t(doc_id, width, two_columns, placement)) x,
  (VALUES {_listed(*[r for r in NODES if r[0] == 'good'])}) AS n(d, node_id, parent_id, node_type, ord, level, asset_id, headers)"""


def lay_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAY7–12: the styles of all roles by default, and under a document, a user and a renderer."""
    schema = "doc_id string, user struct<font_scale:double,heading_scale:double,line_scale:double,body_font:string,heading_font:string,paragraph_spacing:struct<value:double,unit:string>>, limits struct<font:string,min_font:struct<value:double,unit:string>,max_font:struct<value:double,unit:string>,min_line:double,max_line:double,min_paragraph:struct<value:double,unit:string>>"
    documents = spark.createDataFrame([("plain", None, None), ("ruled", (1.5, 2.0, 1.5, None, "H", (2.0, "rem")), ("Forced", (20.0, "px"), (24.0, "px"), 1.0, 1.6, (3.0, "rem"))), ("none", (None, None, None, "B", None, None), None)], schema)
    style = "struct<" + ",".join(f"{f}:{'struct<value:double,unit:string>' if f in ('font_size', 'letter_spacing', 'margin_before', 'margin_after', 'indent') else 'double' if f == 'line_height' else 'int' if f in ('font_weight', 'text_decoration') else 'string'}" for f in layout.FIELDS) + ">"
    declared = spark.createDataFrame([("ruled", "body", ("D", (20.0, "px"), None, None, 1.2, None, None, None, None, None, None, None)), ("none", "body", ("D", (40.0, "px"), None, None, None, None, None, None, None, None, None, None))], f"doc_id string, role string, style {style}")
    s = layout.cascade(documents, declared)
    return s.where("role IN ('body', 'heading-1', 'code')").select("doc_id", "role", "font_family", c("font_size.value").alias("size"), "font_weight", F.round("line_height", 6).alias("line"), c("margin_after.value").alias("after"), c("margin_before.value").alias("before"))


CASCADE = [
    ("plain", "body", "System Serif", 18.0, 400, 1.5, 1.0, 0.0), ("plain", "heading-1", "System Sans Serif", 32.0, 700, 1.5, 0.75, 1.5), ("plain", "code", "System Monospace", 16.0, 400, 1.35, 0.0, 0.0), ("ruled", "body", "Forced", 24.0, 400, 1.6, 3.0, 0.0),
    ("ruled", "heading-1", "Forced", 24.0, 700, 1.6, 0.75, 1.5), ("ruled", "code", "Forced", 24.0, 400, 1.6, 0.0, 0.0), ("none", "body", "B", 40.0, 400, 1.5, 1.0, 0.0), ("none", "heading-1", "System Sans Serif", 32.0, 700, 1.5, 0.75, 1.5), ("none", "code", "System Monospace", 16.0, 400, 1.35, 0.0, 0.0),
]

QUERIES = {f.__name__: f for f in (flt_findings, tre_index, jon_fallbacks, jon_spine, jon_places, css_styles, css_typed, css_values, lay_profiles, lay_cascade)}
SQL = {
    "flt_findings": FLT_FINDINGS, "tre_index": TRE_INDEX, "jon_fallbacks": JON_FALLBACKS, "jon_spine": JON_SPINE, "jon_places": JON_PLACES, "lay_profiles": LAY_PROFILES,
    "css_styles": f"SELECT * FROM (VALUES {_listed(*STYLES)}) AS t(doc_id, node_id, property, value)",
    "css_typed": f"SELECT * REPLACE (CAST(font_family AS VARCHAR) AS font_family) FROM (VALUES {_listed(*TYPED)}) AS t(doc_id, node_id, font_family, size, size_unit, font_weight, font_style, line_height, spacing_unit, text_align, text_transform, text_decoration, indent_unit, before, after)",
    "css_values": f"SELECT * FROM (VALUES {_listed(*CSS_VALUES)}) AS t(text, number, unit, weight, line)",
    "lay_cascade": f"SELECT * FROM (VALUES {_listed(*CASCADE)}) AS t(doc_id, role, font_family, size, font_weight, line, after, before)",
}
