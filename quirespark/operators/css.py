"""Style sheets as rules, and the cascade over elements, as joins.

Sheets are taken apart by regular expressions inside the JVM. A rule is joined by its rarest part (identifier, class,
element), so that no element meets rules it can't match by that; values are inherited along the paths of a tree index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions import css_values as v
from quirespark.functions.text import tokens

c = F.col

# The properties that have a typed form, and those that children take from their parents.
PROPERTIES = "font-family font-size font-weight font-style line-height letter-spacing text-align text-transform text-decoration text-indent margin margin-top margin-bottom margin-block-start margin-block-end".split()
INHERITED = "font-family font-size font-weight font-style line-height letter-spacing text-align text-transform text-decoration text-indent".split()
INLINE_SPECIFICITY = 1000
_QUOTED = r""""[^"]*+"|'[^']*+'"""
_BLOCK = rf"((?:[^{{}}\"']|{_QUOTED})*+)\{{((?:[^{{}}\"']|{_QUOTED})*+)\}}"
_SELECTOR = r"^(\*|[A-Za-z][A-Za-z0-9_-]*)?((?:[.#][A-Za-z0-9_-]+)*)$"


def _named(**fields: Column) -> Column:
    """A struct by names, which inside lambdas are kept this way only."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def without_comments(css: Column) -> Column:
    """CSS11: a sheet without comments; one that isn't ended goes to the end."""
    return F.regexp_replace(css, r"(?s)/\*.*?(?:\*/|$(?![\r\n]))", "")


def split_outside_quotes(text: Column, mark: str) -> Column:
    """CSS12: the parts between marks that stand in no quotes."""
    return F.regexp_extract_all(text, F.lit(rf"((?:[^{mark}\"']|{_QUOTED})++)"), F.lit(1))


def selector(text: Column) -> Column:
    """CSS9: the struct element, id, classes, specificity of a selector of an element, identifiers and classes; null for others."""
    plain = F.trim(text)
    parts = F.regexp_extract_all(F.regexp_extract(plain, _SELECTOR, 2), F.lit(r"([.#][A-Za-z0-9_-]+)"), F.lit(1))
    names = lambda mark: F.transform(F.filter(parts, lambda x: x.startswith(mark)), lambda x: F.substring(x, 2, 2**31 - 1))
    element = F.nullif(F.nullif(F.lower(F.regexp_extract(plain, _SELECTOR, 1)), F.lit("")), F.lit("*"))
    known = plain.rlike(_SELECTOR) & (plain != "") & (F.size(names("#")) <= 1)
    weight = F.size(names("#")) * 100 + F.size(names(".")) * 10 + element.isNotNull().cast("int")
    return F.when(known, F.struct(element.alias("element"), F.get(names("#"), F.lit(0)).alias("id"), names(".").alias("classes"), weight.alias("specificity")))


def declarations(body: Column) -> Column:
    """CSS4, CSS6: the structs property, value, place of a block, as far as they have a typed form.

    What is important, holds an address or script, or has no colon is left out. A margin gives its block sides.
    """
    each = F.transform(split_outside_quotes(body, ";"), lambda x, i: _named(property=F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))), value=F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)), place=i))
    good = F.filter(each, lambda d: d["property"].isin(*PROPERTIES) & ~F.lower(d["value"]).rlike(r"!important$|url\(|javascript:"))

    def sides(d: Column) -> Column:
        sizes = tokens(d["value"])
        one = lambda name, i: _named(property=F.lit(name), value=F.get(sizes, i), place=d["place"])
        both = F.array(one("margin-block-start", F.lit(0)), one("margin-block-end", F.when(F.size(sizes) > 2, F.lit(2)).otherwise(F.lit(0))))
        return F.when(d["property"] != "margin", F.array(d)).when(F.size(sizes).between(1, 4), both).otherwise(F.slice(both, 1, 0))

    return F.flatten(F.transform(good, sides))


def referenced_images(css: Column) -> Column:
    """CSS5: the addresses of a sheet's url() values."""
    found = F.regexp_extract_all(without_comments(css), F.lit(r"(?i)url\(\s*([^)]*?)\s*\)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")))


def rules(sheets: DataFrame) -> DataFrame:
    """CSS2, CSS3: doc_id, ord, selector fields, property, value of sheets (doc_id, sheet_ord, css), in the order they apply.

    ord orders the rules of a document: by sheet, block and selector. At-rules with blocks and what follows an open brace
    don't count, nor do selectors outside the subset; nor null sheets.
    """
    plain = F.regexp_replace(without_comments(c("css")), r"@[^;{}]*;", "")
    blocks = F.arrays_zip(F.regexp_extract_all(plain, F.lit(_BLOCK), F.lit(1)).alias("s"), F.regexp_extract_all(plain, F.lit(_BLOCK), F.lit(2)).alias("b"))
    each = sheets.select("doc_id", "sheet_ord", F.posexplode(blocks).alias("block", "rule")).where(~F.trim("rule.s").startswith("@"))
    parts = each.select("doc_id", "sheet_ord", "block", F.posexplode(split_outside_quotes(c("rule.s"), ",")).alias("part", "text"), declarations(c("rule.b")).alias("d"))
    known = parts.withColumn("selector", selector(c("text"))).where("selector IS NOT NULL")
    order = F.struct(c("sheet_ord").cast("bigint").alias("sheet"), "block", "part")
    return known.select("doc_id", order.alias("ord"), "selector.*", F.explode("d").alias("d")).select("doc_id", "ord", "element", "id", "classes", "specificity", "d.property", "d.value", "d.place")


def cascaded(elements: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """CSS7, CSS10: doc_id, node_id, property, value: for each element the value of the heaviest rule, the last of equals.

    elements: doc_id, node_id, element, id, classes ARRAY<STRING>, style (or null). A rule lies under its identifier, else
    its first class, else its element, else *, and an element looks under all it has: no element meets all rules.
    """
    under = F.coalesce(F.concat(F.lit("#"), "id"), F.concat(F.lit("."), F.get("classes", F.lit(0))), "element", F.lit("*"))
    kept = rule_rows.select(c("doc_id").alias("rd"), under.alias("under"), c("element").alias("re"), c("id").alias("ri"), c("classes").alias("rc"), "specificity", "ord", "place", "property", "value")
    classes = F.coalesce("classes", F.array().cast("array<string>"))
    looks = F.array_distinct(F.concat(F.array(F.lit("*"), F.lower("element")), F.when(c("id").isNotNull(), F.array(F.concat(F.lit("#"), "id"))).otherwise(F.array().cast("array<string>")), F.transform(classes, lambda x: F.concat(F.lit("."), x))))
    look = elements.select("doc_id", "node_id", F.lower("element").alias("element"), "id", classes.alias("classes"), F.explode(looks).alias("look"))
    met = look.join(kept, look["doc_id"].eqNullSafe(kept["rd"]) & (look["look"] == kept["under"])).where(
        (c("re").isNull() | (c("re") == c("element"))) & (c("ri").isNull() | (c("ri") == c("id"))) & (F.size(F.array_except("rc", "classes")) == 0)
    )
    own = elements.where("style IS NOT NULL").select("doc_id", "node_id", F.explode(declarations(c("style"))).alias("d"))
    none = F.struct(F.lit(2**62).alias("sheet"), F.lit(0).alias("block"), F.lit(0).alias("part"))
    every = met.select("doc_id", "node_id", "property", "value", "specificity", "ord", "place").unionByName(
        own.select("doc_id", "node_id", c("d.property").alias("property"), c("d.value").alias("value"), F.lit(INLINE_SPECIFICITY).alias("specificity"), none.alias("ord"), c("d.place").alias("place"))
    )
    return every.groupBy("doc_id", "node_id", "property").agg(F.max_by("value", F.struct("specificity", "ord", "place")).alias("value"))


def styled(elements: DataFrame, index: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """CSS1: the cascade with inheritance: doc_id, node_id, property, value; inherited ones from the nearest ancestor that has
    a value. index is the tree index of the elements."""
    own = cascaded(elements, rule_rows)
    steps = index.where("path IS NOT NULL").select(c("doc_id").alias("d"), c("node_id").alias("n"), F.posexplode("path").alias("at", "step"))
    above = steps.join(own, steps["d"].eqNullSafe(own["doc_id"]) & (steps["step"] == own["node_id"])).where(c("property").isin(*INHERITED) | (c("step") == c("n")))
    return above.groupBy(c("d").alias("doc_id"), c("n").alias("node_id"), "property").agg(F.max_by("value", "at").alias("value"))


def typed(styles: DataFrame, elements: DataFrame) -> DataFrame:
    """CSS8: one row for each styled element with typed properties; margins only of paragraphs; null where a value is wrong."""
    wide = styles.groupBy("doc_id", "node_id").pivot("property", PROPERTIES).agg(F.first("value"))
    kinds = elements.select(c("doc_id").alias("ed"), c("node_id").alias("en"), F.lower("element").alias("element"))
    both = wide.join(kinds, wide["doc_id"].eqNullSafe(kinds["ed"]) & (wide["node_id"] == kinds["en"]))
    p = c("element") == "p"
    return both.select(
        "doc_id", "node_id", v.font_family(c("font-family")).alias("font_family"), v.length(c("font-size"), True).alias("font_size"), v.font_weight(c("font-weight")).alias("font_weight"),
        v.font_style(c("font-style")).alias("font_style"), v.line_height(c("line-height")).alias("line_height"), v.letter_spacing(c("letter-spacing")).alias("letter_spacing"), v.text_align(c("text-align")).alias("text_align"),
        v.text_transform(c("text-transform")).alias("text_transform"), v.text_decoration(c("text-decoration")).alias("text_decoration"), v.length(c("text-indent")).alias("indent"),
        F.when(p, v.length(F.coalesce("margin-block-start", "margin-top"))).alias("margin_before"), F.when(p, v.length(F.coalesce("margin-block-end", "margin-bottom"))).alias("margin_after"),
    )
