"""Rules over the nodes of documents, each a filter or join that gives the rows which break it.

nodes: doc_id, node_id, parent_id, node_type, ord, level, asset_id, headers ARRAY<STRING>. inlines: doc_id, owner_id, inline_ord,
parent_ord, kind, value, target, mode. Extra columns don't matter. All rules give doc_id, pass_no, code, node_id, detail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions import identifiers as ids
from quirespark.functions import kinds
from quirespark.operators.chains import nearest_ancestor, tree_index
from quirespark.operators.ordered import preceded

c = F.col

# What a node may lie in, by its type; null stands for the top of a document. Types that aren't named may lie anywhere.
PARENTS: dict[str, tuple[str | None, ...]] = {
    "chapter": (None,), "section": ("chapter", "section", "table-cell", "table-header", "table-caption"), "list-item": ("ordered-list", "unordered-list"), "caption": ("figure",),
    "table-caption": ("table",), "table-head": ("table",), "table-body": ("table",), "table-foot": ("table",), "table-row": ("table-head", "table-body", "table-foot"), "table-cell": ("table-row",), "table-header": ("table-row",),
}
TARGETS = ("chapter", "section", "heading")
CODE_PREFIX = "FLOW_"


def _found(df: DataFrame, pass_no: int, code: str, detail: Column, node: str = "node_id") -> DataFrame:
    return df.select("doc_id", F.lit(pass_no).alias("pass_no"), F.lit(CODE_PREFIX + code).alias("code"), c(node).alias("node_id"), detail.cast("string").alias("detail"))


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """JON16: doc_id, node_id, node_type of the identifiers that one node of a document has."""
    return nodes.groupBy("doc_id", "node_id").agg(F.count("*").alias("n"), F.min("node_type").alias("node_type")).where("n = 1").drop("n")


def id_rules(nodes: DataFrame) -> DataFrame:
    """FLT3: identifiers of the wrong form, and those that come more than once, with how often."""
    wrong = _found(nodes.where(~F.coalesce(ids.is_stable_id(c("node_id")), F.lit(False))), 2, "INVALID_NODE_ID", c("node_id"))
    counted = nodes.groupBy("doc_id", "node_id").agg(F.count("*").alias("n")).where("n > 1")
    return wrong.unionByName(_found(counted, 2, "DUPLICATE_NODE_ID", c("n")))


def hierarchy_rules(nodes: DataFrame) -> DataFrame:
    """FLT4: nodes that lie where their type may not; a note may not lie in a note."""
    up = nodes.select(c("doc_id").alias("pd"), c("node_id").alias("pn"), c("node_type").alias("parent_type")).dropDuplicates(["pd", "pn"])
    both = nodes.join(up, nodes["doc_id"].eqNullSafe(up["pd"]) & (nodes["parent_id"] == up["pn"]), "left")
    parent = F.coalesce("parent_type", F.lit(""))
    broken = reduce(lambda a, b: a | b, [(c("node_type") == kind) & ~parent.isin(*[p or "" for p in allowed]) for kind, allowed in PARENTS.items()])
    broken = broken | (c("node_type") == "footnote") & (parent == "footnote")
    return _found(both.where(broken), 3, "INVALID_HIERARCHY", F.concat(c("node_type"), F.lit(" in "), F.coalesce("parent_type", F.lit("the top"))))


def heading_rules(index: DataFrame) -> DataFrame:
    """FLT5: heading levels that aren't 1 to 6, or more than one below the heading before in the same chapter.

    Any heading counts as the one before, whether its level is right or not; headings outside chapters are a row of their own.
    """
    with_chapter = nearest_ancestor(index, c("node_type") == "chapter", "chapter_id").where("node_type = 'heading'")
    rows = preceded(with_chapter.select("doc_id", "node_id", "level", "chapter_id", "places"), ["doc_id", "chapter_id"], ["places", "node_id"], {"level_before": "level"})
    outside = ~c("level").between(1, 6)
    jump = ~outside & (c("level") > c("level_before") + 1)
    return _found(rows.where(outside | jump), 4, "INVALID_HEADING_LEVEL", F.when(outside, c("level").cast("string")).otherwise(F.concat_ws(" to ", c("level_before").cast("string"), c("level").cast("string"))))


def figure_rules(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """FLT6, JON20: figures whose asset isn't there."""
    held = assets.select(c("doc_id").alias("ad"), c("asset_id").alias("aa")).distinct()
    figures = nodes.where("node_type = 'figure'")
    return _found(figures.join(held, figures["doc_id"].eqNullSafe(held["ad"]) & (figures["asset_id"] == held["aa"]), "left_anti"), 5, "MISSING_FIGURE_ASSET", c("asset_id"))


def resolved_anchors(targets: DataFrame, index: DataFrame) -> DataFrame:
    """JON15: targets (doc_id, target) and resolved_id, resolved_type: the one node whose path an anchor names, otherwise,
    for an anchor of one identifier, the one node that has it."""
    paths = index.where("path IS NOT NULL").groupBy("doc_id", F.array_join("path", "/").alias("p")).agg(F.count("*").alias("n"), F.min("node_id").alias("by_path"), F.min("node_type").alias("type_path")).where("n = 1")
    single = unique_nodes(index).select(c("doc_id").alias("sd"), c("node_id").alias("by_id"), c("node_type").alias("type_id"))
    segments = ids.anchor_path(c("target"))
    asked = targets.withColumn("__path", F.array_join(segments, "/")).withColumn("__single", F.when(F.size(segments) == 1, segments[0]))
    paths = paths.select(c("doc_id").alias("pd"), "p", "by_path", "type_path")
    out = asked.join(paths, asked["doc_id"].eqNullSafe(paths["pd"]) & (asked["__path"] == paths["p"]), "left")
    out = out.join(single, out["doc_id"].eqNullSafe(single["sd"]) & (out["__single"] == single["by_id"]), "left")
    return out.select(*targets.columns, F.coalesce("by_path", "by_id").alias("resolved_id"), F.when(c("by_path").isNotNull(), c("type_path")).otherwise(c("type_id")).alias("resolved_type"))


def link_rules(inlines: DataFrame, index: DataFrame) -> DataFrame:
    """FLT7, FLT8: links inside the document that have not the form of an anchor, or lead nowhere."""
    links = inlines.where("kind = 'link' AND lower(target) LIKE 'flow:%'").select("doc_id", "owner_id", "target")
    wrong = _found(links.where(ids.anchor_path(c("target")).isNull()), 6, "INVALID_ANCHOR", c("target"), "owner_id")
    known = resolved_anchors(links.where(ids.anchor_path(c("target")).isNotNull()), index)
    return wrong.unionByName(_found(known.where("resolved_id IS NULL"), 6, "UNRESOLVED_ANCHOR", c("target"), "owner_id"))


def note_rules(inlines: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLT9, JON10: references that don't lead to one single note."""
    notes = unique_nodes(nodes).where("node_type = 'footnote'").select(c("doc_id").alias("nd"), c("node_id").alias("nn"))
    asked = inlines.where("kind = 'footnote-reference'")
    return _found(asked.join(notes, asked["doc_id"].eqNullSafe(notes["nd"]) & (asked["target"] == notes["nn"]), "left_anti"), 6, "UNRESOLVED_FOOTNOTE_REFERENCE", c("target"), "owner_id")


def contents_rules(entries: DataFrame, index: DataFrame) -> DataFrame:
    """FLT10: entries (doc_id, owner_id, target, level, max_depth) of tables of contents that lead to no chapter, section or
    heading, or are too deep."""
    known = resolved_anchors(entries, index)
    good = F.coalesce(c("resolved_type").isin(*TARGETS), F.lit(False)) & (c("level") <= c("max_depth"))
    return _found(known.where(~good), 7, "INVALID_TOC_TARGET", F.concat_ws(" at ", c("target"), c("level").cast("string")), "owner_id")


def header_rules(index: DataFrame) -> DataFrame:
    """FLT11, JON12: cells whose headers aren't header cells of the same table; a table in a table is another."""
    inside = nearest_ancestor(index, c("node_type") == "table", "table_id").where("table_id IS NOT NULL AND node_type IN ('table-cell', 'table-header')")
    have = inside.where("node_type = 'table-header'").select(c("doc_id").alias("hd"), c("table_id").alias("ht"), c("node_id").alias("hn")).distinct()
    asked = inside.select("doc_id", "node_id", "table_id", F.explode("headers").alias("header"))
    return _found(asked.join(have, asked["doc_id"].eqNullSafe(have["hd"]) & (asked["table_id"] == have["ht"]) & (asked["header"] == have["hn"]), "left_anti"), 8, "UNRESOLVED_TABLE_HEADER_REFERENCE", c("header"))


def inline_rules(inlines: DataFrame) -> DataFrame:
    """FLT12: languages that are no tags, directions that can't be overridden, and ruby out of its order."""
    languages = inlines.where((c("kind") == "language") & ~F.coalesce(kinds.is_language(c("value")), F.lit(False)))
    direction = F.coalesce(c("value").isin("auto", "ltr", "rtl"), F.lit(False)) & F.coalesce(c("mode").isin("isolate", "embed", "override"), F.lit(False))
    bidi = inlines.where((c("kind") == "bidirectional") & (~direction | (c("mode") == "override") & (c("value") == "auto")))
    up = inlines.select(c("doc_id").alias("ud"), c("owner_id").alias("uo"), c("inline_ord").alias("ui"), c("kind").alias("parent_kind"), c("parent_ord").alias("grand"))
    below = inlines.join(up, inlines["doc_id"].eqNullSafe(up["ud"]) & (inlines["owner_id"] == up["uo"]) & (inlines["parent_ord"] == up["ui"]), "left")
    loose = below.where(c("kind").isin("ruby-annotation", "ruby-parenthesis") & ~F.coalesce(c("parent_kind") == "ruby", F.lit(False)))
    parts = below.where("parent_kind = 'ruby'").groupBy("doc_id", "owner_id", c("parent_ord").alias("of")).agg(F.count_if(c("kind") == "ruby-annotation").alias("n_notes"), F.count_if(~c("kind").isin("ruby-annotation", "ruby-parenthesis")).alias("n_base"))
    ruby = inlines.where("kind = 'ruby'").withColumnsRenamed({"doc_id": "rd", "owner_id": "ro"})
    held = ruby.join(parts, ruby["rd"].eqNullSafe(parts["doc_id"]) & (ruby["ro"] == parts["owner_id"]) & (ruby["inline_ord"] == parts["of"]), "left")
    empty = held.where((F.coalesce("n_notes", F.lit(0)) == 0) | (F.coalesce("n_base", F.lit(0)) == 0)).select(c("rd").alias("doc_id"), c("ro").alias("owner_id"), "inline_ord")
    index = tree_index(inlines.select(F.concat_ws("\x1f", "doc_id", "owner_id").alias("place"), "doc_id", "owner_id", "kind", "inline_ord", c("inline_ord").cast("string").alias("id"), c("parent_ord").cast("string").alias("up")), "place", "id", "up", "inline_ord")
    nested = nearest_ancestor(index, c("kind") == "ruby", "outer", "place", "id").where("kind = 'ruby' AND outer IS NOT NULL").select("doc_id", "owner_id", "inline_ord")
    broken = empty.unionByName(nested).distinct()
    return reduce(DataFrame.unionByName, [
        _found(languages, 9, "INVALID_LANGUAGE_TAG", c("value"), "owner_id"), _found(bidi, 9, "INVALID_BIDIRECTIONAL_STRUCTURE", c("value"), "owner_id"),
        _found(loose, 9, "INVALID_RUBY_STRUCTURE", c("kind"), "owner_id"), _found(broken, 9, "INVALID_RUBY_STRUCTURE", F.lit("ruby"), "owner_id"),
    ])


def cover_rules(covers: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLT2: covers (doc_id, figure_id) that don't name one single figure."""
    figures = unique_nodes(nodes).where("node_type = 'figure'").select(c("doc_id").alias("fd"), c("node_id").alias("fn"))
    return _found(covers.join(figures, covers["doc_id"].eqNullSafe(figures["fd"]) & (covers["figure_id"] == figures["fn"]), "left_anti"), 1, "INVALID_COVER_FIGURE", c("figure_id"), "figure_id")


def validated(nodes: DataFrame, inlines: DataFrame, assets: DataFrame, covers: DataFrame, entries: DataFrame) -> DataFrame:
    """FLT1: the findings of all rules, in passes; a document without any is valid."""
    index = tree_index(nodes)
    return reduce(DataFrame.unionByName, [
        cover_rules(covers, nodes), id_rules(nodes), hierarchy_rules(nodes), heading_rules(index), figure_rules(nodes, assets), link_rules(inlines, index), note_rules(inlines, nodes),
        contents_rules(entries, index), header_rules(index), inline_rules(inlines),
    ])
