"""Nodes and their text as HTML pages, digests of documents, and audits of what holds together.

A page is the sorted join of its parts: each node and each piece of text gives what opens and what closes it, with a key
that sorts it into place. A chapter is one group; its size is bounded by that of an archive's entry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.paths import safe_href
from quirespark.functions.text import hash_of_values, html_escaped, sha256_hex, significant
from quirespark.operators.chains import tree_index

c = F.col

# Elements by node and by inline kind; voids have no end.
TAGS = {
    "chapter": "article", "section": "section", "paragraph": "p", "block-quote": "blockquote", "unordered-list": "ul", "ordered-list": "ol", "list-item": "li", "code-block": "pre", "table": "table", "table-caption": "caption", "table-head": "thead", "table-body": "tbody",
    "table-foot": "tfoot", "table-row": "tr", "table-cell": "td", "table-header": "th", "figure": "figure", "caption": "figcaption", "horizontal-rule": "hr", "footnote": "aside", "broken-chapter": "article",
}
INLINE_TAGS = {"strong": "strong", "emphasis": "em", "underline": "u", "strikethrough": "s", "code": "code", "ruby": "ruby", "ruby-annotation": "rt", "ruby-parenthesis": "rp", "language": "span", "bidirectional": "bdo", "link": "a", "footnote-reference": "a", "math": "span"}
_LAST = 2**62


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), html_escaped(value.cast("string")), F.lit('"'))).otherwise("")


def pages(nodes: DataFrame, inlines: DataFrame) -> DataFrame:
    """SNK4, RND1–5, RND7, RND11–13: doc_id, resource, html of each chapter; links to nodes become fragments, unsafe ones only their text.

    inlines may have target_id (see resolved_links); nodes in no chapter's tree are left out.
    """
    index = tree_index(nodes).where("path IS NOT NULL")
    tag = F.when(c("node_type") == "heading", F.concat(F.lit("h"), c("level").cast("string"))).otherwise(F.coalesce(F.element_at(_map(TAGS), c("node_type")), F.lit("div")))
    more = F.concat(
        _attribute("id", c("node_id")), _attribute("start", c("list_start")), _attribute("colspan", F.when(c("col_span") > 1, c("col_span"))), _attribute("rowspan", F.when(c("row_span") > 1, c("row_span"))), _attribute("scope", c("scope")), _attribute("headers", F.array_join("headers", " "))
    )
    image = F.when(c("node_type") == "figure", F.concat(F.lit("<img"), _attribute("src", c("asset_path")), _attribute("alt", F.coalesce("alt_text", F.lit(""))), F.lit("/>"))).otherwise("")
    void = c("node_type") == "horizontal-rule"
    opened = index.select("doc_id", "resource", c("places").alias("key"), F.concat(F.lit("<"), tag, more, F.when(void, F.lit("/>")).otherwise(F.lit(">")), image).alias("part"))
    closed = index.where(~void).select("doc_id", "resource", F.array_append("places", F.lit(_LAST)).alias("key"), F.concat(F.lit("</"), tag, F.lit(">")).alias("part"))
    texts = inlines if "target_id" in inlines.columns else inlines.withColumn("target_id", F.lit(None).cast("string"))
    texts = tree_index(texts.select("*", F.concat_ws("\x1f", "doc_id", "owner_id").alias("__place"), c("inline_ord").cast("string").alias("__id"), c("parent_ord").cast("string").alias("__up")).drop("path", "places", "depth"), "__place", "__id", "__up", "inline_ord")
    owners = index.select(c("doc_id").alias("od"), c("node_id").alias("on"), c("places").alias("owner_places"), c("resource").alias("owner_resource"))
    placed = texts.join(owners, (c("doc_id") == c("od")) & (c("owner_id") == c("on")))
    key = F.concat("owner_places", F.array(F.lit(-1).cast("bigint")), "places")
    href = F.when(c("target_id").isNotNull(), F.concat(F.lit("#"), c("target_id"))).otherwise(safe_href(c("target")))
    inner = F.element_at(_map(INLINE_TAGS), c("kind"))
    extra = F.concat(_attribute("href", F.when(c("kind").isin("link", "footnote-reference"), href)), _attribute("lang", F.when(c("kind") == "language", c("value"))), _attribute("dir", F.when(c("kind") == "bidirectional", c("value"))))
    start = (
        F.when(c("kind") == "text", html_escaped(c("value"))).when(c("kind") == "line-break", "<br/>").when(c("kind") == "image", F.concat(F.lit("<img"), _attribute("src", c("target")), _attribute("alt", F.coalesce("value", F.lit(""))), F.lit("/>")))
        .when(inner.isNotNull(), F.concat(F.lit("<"), inner, extra, F.lit(">"), F.when(c("kind") == "math", html_escaped(F.coalesce("value", F.lit("")))).otherwise(""))).otherwise("")
    )
    text_open = placed.select("doc_id", c("owner_resource").alias("resource"), key.alias("key"), start.alias("part"))
    text_close = placed.where(inner.isNotNull()).select("doc_id", c("owner_resource").alias("resource"), F.array_append(key, F.lit(_LAST)).alias("key"), F.concat(F.lit("</"), inner, F.lit(">")).alias("part"))
    parts = reduce(DataFrame.unionByName, [opened, closed, text_open, text_close])
    sorted_parts = F.transform(F.array_sort(F.collect_list(F.struct("key", "part"))), lambda x: x["part"])
    return parts.groupBy("doc_id", "resource").agg(F.array_join(sorted_parts, "").alias("html"))


def document_hashes(nodes: DataFrame, inlines: DataFrame) -> DataFrame:
    """INT1–3, INT6, INT7, SNK3: doc_id, n_nodes, sha256: a digest over the canonical form of a document's nodes in reading order.

    Each node is a JSON object with its fields in a fixed order and the digest of its text; the digests of nodes are summed
    up by chapter first, then by document, so that no document has to be one text. It doesn't depend on the row order.
    """
    index = tree_index(nodes).where("path IS NOT NULL")
    piece = F.to_json(F.struct("inline_ord", "parent_ord", "kind", "value", "target", "mode"), {"ignoreNullFields": "false"})
    text = inlines.groupBy(c("doc_id").alias("td"), c("owner_id").alias("tn")).agg(hash_of_values(F.transform(F.array_sort(F.collect_list(F.struct("inline_ord", piece.alias("p")))), lambda x: x["p"])).alias("text"))
    both = index.join(text, (c("doc_id") == c("td")) & (c("node_id") == c("tn")), "left")
    fields = [x for x in ("node_id", "node_type", "depth", "level", "list_start", "col_span", "row_span", "scope", "headers", "asset_path", "alt_text", "text") if x in both.columns]
    canonical = both.select("doc_id", "resource", "places", sha256_hex(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("h"))
    in_order = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"])
    chapters = canonical.groupBy("doc_id", "resource").agg(F.count("*").alias("n"), F.min("places").alias("first"), hash_of_values(in_order("places")).alias("h"))
    return chapters.groupBy("doc_id").agg(F.sum("n").alias("n_nodes"), hash_of_values(in_order("first")).alias("sha256"))


def produced(nodes: DataFrame, inlines: DataFrame) -> DataFrame:
    """AGG26, AGG29, AGG30: doc_id, metric, n: what a document holds, by kind of node and of text, and its significant characters."""
    kinds = nodes.groupBy("doc_id", c("node_type").alias("metric")).agg(F.count("*").alias("n"))
    inner = inlines.groupBy("doc_id", F.concat(F.lit("inline-"), c("kind")).alias("metric")).agg(F.count("*").alias("n"))
    characters = inlines.where("kind = 'text'").groupBy("doc_id").agg(F.lit("characters").alias("metric"), F.sum(significant(c("value"))).alias("n"))
    return kinds.unionByName(inner).unionByName(characters)


def audits(nodes: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """QLT19, QLT22–25, QLT28–35: doc_id, audit, n_total, n_resolved, n_broken of a document's links, notes, figures and tables.

    links: see resolved_links; assets: doc_id, path, sha256.
    """
    def rated(df: DataFrame, name: str, good: Column) -> DataFrame:
        return df.groupBy("doc_id").agg(F.lit(name).alias("audit"), F.count("*").alias("n_total"), F.count_if(good).alias("n_resolved"), F.count_if(~good).alias("n_broken"))

    inside = links.where("kind = 'link' AND link_kind <> 'external'")
    of_target = nodes.select(c("doc_id").alias("nd"), c("node_id").alias("nn"), c("resource").alias("target_resource"))
    placed = inside.join(of_target, (c("doc_id") == c("nd")) & (c("target_id") == c("nn")), "left")
    same = placed.where("target_resource IS NULL OR target_resource = resource")
    notes = links.where("kind = 'footnote-reference'")
    held = assets.select(c("doc_id").alias("ad"), c("path").alias("ap")).distinct()
    figures = nodes.where("node_type = 'figure'").join(held, (c("doc_id") == c("ad")) & (c("asset_path") == c("ap")), "left")
    rows = nodes.where("node_type = 'table-row'").select(c("doc_id").alias("rd"), c("parent_id").alias("rp")).distinct()
    bodies = nodes.where("node_type = 'table-body'").join(rows, (c("doc_id") == c("rd")) & (c("node_id") == c("rp")), "left")
    spans = nodes.where("node_type IN ('table-cell', 'table-header')")
    copies = assets.groupBy("doc_id", "sha256").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, [
        rated(same, "links-inside", c("target_id").isNotNull()), rated(placed.where("target_resource <> resource"), "links-across", c("target_id").isNotNull()), rated(links.where("link_kind = 'external'"), "links-external", F.lit(True)),
        rated(notes, "note-references", F.coalesce(c("target_type") == "footnote", F.lit(False))), rated(figures, "figures", c("ap").isNotNull()), rated(bodies, "table-bodies", c("rp").isNotNull()),
        rated(spans, "table-spans", ~((c("col_span") > 1) | (c("row_span") > 1))), rated(copies, "assets", c("n") == 1),
    ])
