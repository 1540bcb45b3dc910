"""Layout and typography of nodes: expressions over a small table of roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# Widths at which a viewport is of the next kind, and the defaults of each role: font size in px, is a heading.
MEDIUM, LARGE = 600, 1200
ROLES: dict[str, tuple[float, bool]] = {
    "body": (18, False), "chapter-title": (36, True), "heading-1": (32, True), "heading-2": (28, True), "heading-3": (24, True), "heading-4": (22, True), "heading-5": (20, True), "heading-6": (18, True), "subtitle": (22, True),
    "toc-title": (28, True), "toc-level-1": (18, False), "toc-level-2": (17, False), "toc-level-3": (16, False), "caption": (14, False), "footnote": (13, False), "block-quote": (18, False), "code": (16, False),
}
BODY_FONTS = ("body", "caption", "footnote", "block-quote", "toc-level-1", "toc-level-2", "toc-level-3")
FIELDS = "font_family font_size font_weight font_style line_height letter_spacing text_align text_transform margin_before margin_after indent text_decoration".split()


def _length(value: Column | float, unit: str) -> Column:
    return F.struct((F.lit(float(value)) if isinstance(value, (int, float)) else value.cast("double")).alias("value"), F.lit(unit).alias("unit"))


def viewport(width: Column) -> Column:
    """LAY2, LAY13: small, medium or large."""
    return F.when(width < MEDIUM, "small").when(width < LARGE, "medium").otherwise("large")


def profile(width: Column, two_columns: Column) -> Column:
    """LAY2: the struct category, columns, margin, max_width, gap of a viewport."""
    kind = viewport(width)
    columns = F.when((kind == "large") & two_columns, 2).otherwise(1)
    margin = F.when(kind == "small", _length(16, "px")).when(kind == "medium", _length(32, "px")).otherwise(_length(64, "px"))
    most = F.when(kind == "small", _length(100, "%")).when(kind == "medium", _length(800, "px")).otherwise(_length(1120, "px"))
    return F.struct(kind.alias("category"), columns.alias("columns"), margin.alias("margin"), most.alias("max_width"), F.when(columns == 2, _length(48, "px")).otherwise(_length(0, "px")).alias("gap"))


def at_least(length: Column, minimum: Column) -> Column:
    """LAY11: a length, or a minimum of the same unit that is above it."""
    return F.when((minimum["unit"] == length["unit"]) & (length["value"] < minimum["value"]), minimum).otherwise(length)


def at_most(length: Column, maximum: Column) -> Column:
    """LAY11: a length, or a maximum of the same unit that is below it."""
    return F.when((maximum["unit"] == length["unit"]) & (length["value"] > maximum["value"]), maximum).otherwise(length)


def content_margin(default: Column, user: Column, minimum: Column) -> Column:
    """LAY3: the user's margin held above the minimum, else the viewport's, unless a minimum of its unit is wider."""
    return F.when(user.isNotNull(), at_least(user, minimum)).otherwise(at_least(default, minimum))


def theme(document: Column, user: Column, required: Column) -> Column:
    """LAY12: what is required, else what the user wants, else the document's, else the system's."""
    return F.coalesce(required, user, document, F.lit("system"))


def role(node_type: Column, level: Column, parent_type: Column) -> Column:
    """LAY4: the role of a node by its type, level and what it lies in."""
    heading = F.when((level == 1) & F.coalesce(parent_type == "chapter", F.lit(False)), "chapter-title").when(level.between(1, 6), F.concat(F.lit("heading-"), level.cast("string"))).otherwise("body")
    return (
        F.when(node_type == "heading", heading).when(node_type.isin("caption", "table-caption"), "caption").when(node_type == "footnote", "footnote").when(node_type == "code-block", "code")
        .when((node_type == "block-quote") | (node_type == "paragraph") & (parent_type == "block-quote"), "block-quote").when((node_type == "paragraph") & (parent_type == "footnote"), "footnote").otherwise("body")
    )


def is_heading(role_name: Column) -> Column:
    return role_name.isin(*[r for r, (_, heading) in ROLES.items() if heading])


def default_style(role_name: Column) -> Column:
    """LAY7: the struct of a role's style."""
    h, code, r = is_heading(role_name), role_name == "code", role_name
    size = F.element_at(F.create_map(*[F.lit(x) for name, (size, _) in ROLES.items() for x in (name, float(size))]), r)
    after = F.when(r == "body", _length(1, "rem")).when(r == "chapter-title", _length(1.5, "rem")).when(h, _length(0.75, "rem")).otherwise(_length(0, "px"))
    return F.struct(
        F.when(code, "System Monospace").when(h, "System Sans Serif").otherwise("System Serif").alias("font_family"), _length(size, "px").alias("font_size"), F.when(h | (r == "toc-level-1"), 700).otherwise(400).alias("font_weight"),
        F.lit("normal").alias("font_style"), F.when(r.isin("caption", "footnote", "code"), 1.35).otherwise(1.5).alias("line_height"), _length(0, "em").alias("letter_spacing"), F.lit("start").alias("text_align"),
        F.lit("none").alias("text_transform"), F.when(h, _length(1.5, "rem")).otherwise(_length(0, "px")).alias("margin_before"), after.alias("margin_after"), _length(0, "px").alias("indent"), F.lit(0).alias("text_decoration"),
    )


def merged(inherited: str, declared: str) -> list[Column]:
    """LAY8: the fields of a declared style over those of an inherited one; both are names of structs."""
    return [F.coalesce(c(f"{declared}.{f}"), c(f"{inherited}.{f}")).alias(f) for f in FIELDS]


def preferred(name: str, user: str) -> Column:
    """LAY10: a role's style with a user's scales and fonts: user is a struct font_scale, heading_scale, line_scale, body_font,
    heading_font, paragraph_spacing, each of which may be null."""
    style, u = c(name), c(user)
    one = lambda x: F.coalesce(u[x], F.lit(1.0))
    scale = one("font_scale") * F.when(c("is_heading"), one("heading_scale")).otherwise(1.0)
    font = F.when(c("is_heading"), u["heading_font"]).when(c("role").isin(*BODY_FONTS), u["body_font"])
    return (
        style.withField("font_family", F.coalesce(font, style["font_family"])).withField("font_size", F.struct((style["font_size"]["value"] * scale).alias("value"), style["font_size"]["unit"].alias("unit")))
        .withField("line_height", style["line_height"] * one("line_scale")).withField("margin_after", F.when(c("role") == "body", F.coalesce(u["paragraph_spacing"], style["margin_after"])).otherwise(style["margin_after"]))
    )


def constrained(name: str, limits: str) -> Column:
    """LAY11: a style within a renderer's limits: a struct font, min_font, max_font, min_line, max_line, min_paragraph; null is none."""
    style, r = c(name), c(limits)
    after = F.when(c("role") == "body", at_least(style["margin_after"], r["min_paragraph"])).otherwise(style["margin_after"])
    line = F.least(F.greatest(style["line_height"], r["min_line"]), F.coalesce(r["max_line"], F.lit(float("inf"))))
    return style.withField("font_family", F.coalesce(r["font"], style["font_family"])).withField("font_size", at_most(at_least(style["font_size"], r["min_font"]), r["max_font"])).withField("line_height", line).withField("margin_after", after)


def cascade(documents: DataFrame, declared: DataFrame) -> DataFrame:
    """LAY9: doc_id, role and the fields of the style: defaults, under what the document declares (doc_id, role, style), under
    the user's preferences, under the renderer's limits. documents: doc_id, user, limits (structs as above)."""
    each = documents.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLES])))
    every = each.withColumn("is_heading", is_heading(c("role"))).withColumn("base", default_style(c("role")))
    held = declared.select(c("doc_id").alias("dd"), c("role").alias("dr"), "style")
    both = every.join(held, every["doc_id"].eqNullSafe(held["dd"]) & (every["role"] == held["dr"]), "left")
    styles = both.select("doc_id", "role", "is_heading", "user", "limits", F.struct(*merged("base", "style")).alias("s"))
    return styles.withColumn("s", preferred("s", "user")).withColumn("s", constrained("s", "limits")).select("doc_id", "role", *[c(f"s.{f}").alias(f) for f in FIELDS])


def intent(node_type: Column, category: Column, placement: Column) -> Column:
    """LAY6: the struct keep_with_next, avoid_split, placement of a node; a figure in a small viewport is a block."""
    place = F.when(node_type == "figure", F.when(category == "small", "block").otherwise(F.coalesce(placement, F.lit("renderer-choice")))).when(node_type == "footnote", "renderer-choice")
    return F.struct((node_type == "heading").alias("keep_with_next"), node_type.isin("heading", "code-block").alias("avoid_split"), place.alias("placement"))


def laid_out(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """LAY1, LAY5: each node with its role, profile and intent. nodes: doc_id, node_id, parent_id, node_type, level; contexts: one row
    a document: doc_id, width, two_columns, placement."""
    up = nodes.select(c("doc_id").alias("ud"), c("node_id").alias("un"), c("node_type").alias("parent_type"))
    both = nodes.join(up, nodes["doc_id"].eqNullSafe(up["ud"]) & (nodes["parent_id"] == up["un"]), "left")
    held = contexts.select(c("doc_id").alias("cd"), "placement", profile(c("width"), c("two_columns")).alias("profile"))
    out = both.join(held, both["doc_id"].eqNullSafe(held["cd"]))
    return out.select("doc_id", "node_id", role(c("node_type"), c("level"), c("parent_type")).alias("role"), "profile", intent(c("node_type"), c("profile.category"), c("placement")).alias("intent"))
