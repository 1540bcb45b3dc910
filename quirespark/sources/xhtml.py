"""Chapters of packages as rows of nodes and of the text in them.

A chapter is parsed once, in Arrow batches; which link leads where, which level a heading has in the end and what the rows
are worth is left to joins and aggregations over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.paths import archive_path, directory, is_external, reference_key, unescaped
from quirespark.operators.ordered import numbered
from quirespark.session import cut
from quirespark.sources.packages import _rows, parsed_xml

c = F.col

# What elements become, and the attributes that mark notes.
BLOCKS = {
    "p": "paragraph", "blockquote": "block-quote", "ul": "unordered-list", "ol": "ordered-list", "li": "list-item", "pre": "code-block", "table": "table", "caption": "table-caption", "thead": "table-head", "tbody": "table-body",
    "tfoot": "table-foot", "tr": "table-row", "td": "table-cell", "th": "table-header", "figure": "figure", "figcaption": "caption", "hr": "horizontal-rule", "section": "section", "aside": "section",
} | {f"h{i}": "heading" for i in range(1, 7)}
CONTAINERS = {"div", "article", "main", "header", "footer", "nav", "body", "center", "address"}
INLINES = {"strong": "strong", "b": "strong", "em": "emphasis", "i": "emphasis", "cite": "emphasis", "u": "underline", "s": "strikethrough", "del": "strikethrough", "strike": "strikethrough", "code": "code", "ruby": "ruby", "rt": "ruby-annotation", "rp": "ruby-parenthesis", "bdo": "bidirectional", "bdi": "bidirectional"}
TEXT_BLOCKS = {"paragraph", "heading", "caption", "table-caption", "code-block"}
_EPUB_TYPE = "{http://www.idpf.org/2007/ops}type"
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
#: Elements that may lie in each other; deeper ones give their text only.
DEEPEST = 200
SCHEMA = (
    "doc_id string, resource string, row_kind string, node_ord int, parent int, node_type string, ord int, level int, list_start int, col_span int, row_span int, scope string, headers string, source_id string, source string, alt_text string, "
    "inline_ord int, parent_ord int, kind string, value string, target string, mode string"
)


def _local(tag: Any) -> str:
    return tag.rpartition("}")[2].lower() if isinstance(tag, str) else ""


def _whole(text: str | None, low: int = 1) -> int | None:
    try:
        value = int((text or "").strip())
    except ValueError:
        return None
    return value if low <= value <= 2**31 - 1 else None


class _Reader:
    """The rows of one chapter, in reading order."""

    def __init__(self, doc: str, resource: str) -> None:
        self.doc, self.resource, self.rows, self.nodes, self.inlines, self.children = doc, resource, [], 0, {}, {}

    def node(self, kind: str, parent: int | None, x: Any = None, **more: Any) -> int:
        number = self.nodes
        self.nodes += 1
        place = self.children.get(parent, 0)
        self.children[parent] = place + 1
        get = x.get if x is not None else lambda _: None
        spans = kind in ("table-cell", "table-header")
        self.rows.append((
            self.doc, self.resource, "node", number, parent, kind, place, more.get("level"), _whole(get("start"), -(2**31)) if kind == "ordered-list" else None, (_whole(get("colspan")) or 1) if spans else None, (_whole(get("rowspan")) or 1) if spans else None,
            get("scope") if kind == "table-header" else None, get("headers") if spans else None, get("id"), more.get("source"), more.get("alt"), None, None, None, None, None, None,
        ))
        return number

    def inline(self, owner: int, parent: int | None, kind: str, value: str | None = None, target: str | None = None, mode: str | None = None) -> int:
        place = self.inlines.get(owner, 0)
        self.inlines[owner] = place + 1
        self.rows.append((self.doc, self.resource, "inline", owner, *[None] * 12, place, parent, kind, value, target, mode))
        return place

    def text(self, owner: int, parent: int | None, text: str | None, keep: bool) -> None:
        if text and (keep or text.strip()) or text and self.inlines.get(owner):
            self.inline(owner, parent, "text", text if keep else " ".join(text.split()) if text.strip() == text else (" " * text[:1].isspace() + " ".join(text.split()) + " " * (text[-1:].isspace() and bool(text.strip()))))

    def inner(self, x: Any, owner: int, parent: int | None, keep: bool, depth: int) -> None:
        """The content of an element that holds text."""
        self.text(owner, parent, x.text, keep)
        for child in x:
            name = _local(child.tag)
            kinds = (child.get(_EPUB_TYPE) or "").lower().split()
            if depth > DEEPEST:
                self.text(owner, parent, "".join(child.itertext()), keep)
            elif name == "br":
                self.inline(owner, parent, "line-break")
            elif name == "img":
                self.inline(owner, parent, "image", child.get("alt"), child.get("src"))
            elif name == "math":
                self.inline(owner, parent, "math", child.get("alttext") or " ".join("".join(child.itertext()).split()))
            elif name == "a" and child.get("href"):
                note = "noteref" in kinds or "doc-noteref" in (child.get("role") or "").split()
                self.inner(child, owner, self.inline(owner, parent, "footnote-reference" if note else "link", child.get("id"), child.get("href")), keep, depth + 1)
            elif name in ("bdo", "bdi"):
                self.inner(child, owner, self.inline(owner, parent, "bidirectional", (child.get("dir") or "auto").lower(), None, "override" if name == "bdo" else "isolate"), keep, depth + 1)
            elif name in INLINES:
                self.inner(child, owner, self.inline(owner, parent, INLINES[name]), keep, depth + 1)
            elif name == "span" and (child.get(_LANG) or child.get("lang")):
                self.inner(child, owner, self.inline(owner, parent, "language", child.get(_LANG) or child.get("lang")), keep, depth + 1)
            elif name not in ("script", "style"):
                self.inner(child, owner, parent, keep, depth + 1)
            self.text(owner, parent, child.tail, keep)

    def block(self, x: Any, parent: int, depth: int) -> None:
        """An element among blocks."""
        name = _local(x.tag)
        kinds = f"{x.get(_EPUB_TYPE) or ''} {x.get('role') or ''}".lower().split()
        if not name or name in ("script", "style", "head", "col", "colgroup"):
            return
        if {"footnote", "endnote", "doc-footnote"} & set(kinds):
            self.blocks(x, self.node("footnote", parent, x), depth + 1)
        elif name in ("img", "svg", "image"):
            source = x.get("src") or next((v for k, v in x.attrib.items() if k.endswith("href")), None) or next((v for y in x.iter() for k, v in y.attrib.items() if k.endswith("}href")), None)
            self.node("figure", parent, x, source=source, alt=x.get("alt"))
        elif name == "figure":
            image = next((y for y in x.iter() if _local(y.tag) in ("img", "image")), None)
            source = None if image is None else image.get("src") or next((v for k, v in image.attrib.items() if k.endswith("href")), None)
            number = self.node("figure", parent, x, source=source, alt=None if image is None else image.get("alt"))
            for child in x:
                if _local(child.tag) == "figcaption":
                    self.block(child, number, depth + 1)
        elif name in BLOCKS:
            kind = BLOCKS[name]
            number = self.node(kind, parent, x, level=int(name[1]) if kind == "heading" else None)
            if kind in TEXT_BLOCKS:
                self.inner(x, number, None, kind == "code-block", depth + 1)
            elif kind == "table":
                loose = None
                for child in x:
                    if _local(child.tag) == "tr":  # rows beside bodies have one of their own
                        loose = self.node("table-body", number) if loose is None else loose
                        self.block(child, loose, depth + 2)
                    else:
                        self.block(child, number, depth + 1)
            elif kind != "horizontal-rule":
                self.blocks(x, number, depth + 1)
        elif name in CONTAINERS:
            self.blocks(x, parent, depth + 1)
        else:
            number = self.node("paragraph", parent)
            self.inner(x, number, None, False, depth + 1)

    def blocks(self, x: Any, parent: int, depth: int) -> None:
        """The children of an element that holds blocks; text among them becomes paragraphs."""
        if depth > DEEPEST:
            self.text(self.node("paragraph", parent), None, "".join(x.itertext()), False)
            return
        open_paragraph = None

        def loose(text: str | None) -> None:
            nonlocal open_paragraph
            if text and (text.strip() or open_paragraph is not None):
                open_paragraph = self.node("paragraph", parent) if open_paragraph is None else open_paragraph
                self.text(open_paragraph, None, text, False)

        loose(x.text)
        for child in x:
            name = _local(child.tag)
            if name in INLINES or name in ("a", "span", "br", "math", "small", "sup", "sub", "q", "abbr", "mark"):
                if open_paragraph is None:
                    open_paragraph = self.node("paragraph", parent)
                holder = type("Holder", (), {"text": None, "__iter__": lambda s, y=child: iter([_Bare(y)])})()
                self.inner(holder, open_paragraph, None, False, depth + 1)
            else:
                open_paragraph = None
                self.block(child, parent, depth)
            loose(child.tail)


class _Bare:
    """An element without what comes after it."""

    def __init__(self, x: Any) -> None:
        self.x, self.tag, self.text, self.tail, self.attrib = x, x.tag, x.text, None, x.attrib

    def get(self, name: str) -> str | None:
        return self.x.get(name)

    def __iter__(self) -> Iterator[Any]:
        return iter(self.x)

    def itertext(self) -> Iterator[str]:
        return self.x.itertext()


def chapter_rows(chapters: DataFrame) -> DataFrame:
    """CNV1, CNV8–30: the rows of chapters (doc_id, resource, data), nodes and inline ones together; see nodes and inlines.

    A chapter that can't be parsed, or is null, gives one node without children, of type broken-chapter.
    """

    def read(doc: str, resource: str, data: bytes | None) -> Iterator[tuple]:
        reader, root = _Reader(doc, resource), parsed_xml(data)
        if root is None:
            reader.node("broken-chapter", None)
        else:
            body = next((x for x in root.iter() if _local(x.tag) == "body"), root)
            reader.blocks(body, reader.node("chapter", None, body), 0)
        yield from reader.rows

    return cut(_rows(chapters.select("doc_id", "resource", "data"), SCHEMA, read, 10_000))


def nodes(rows: DataFrame) -> DataFrame:
    """CNV2, CNV29: doc_id, node_id, parent_id, node_type, ord, level, ..., resource, source_id, asset_path of chapter rows.

    A node's identifier is n, the number of its resource in the document, and its own: unique without a common counter.
    """
    known = rows.where("row_kind = 'node'")
    resources = numbered(known.select("doc_id", "resource").distinct(), ["doc_id"], ["resource"], "number").select(c("doc_id").alias("rd"), c("resource").alias("rr"), "number")
    both = known.join(resources, c("doc_id").eqNullSafe(c("rd")) & c("resource").eqNullSafe(c("rr")))
    own = lambda x: F.concat(F.lit("n"), c("number").cast("string"), F.lit("-"), c(x).cast("string"))
    return both.select("doc_id", own("node_ord").alias("node_id"), own("parent").alias("parent_id"), "node_type", F.when(c("parent").isNull(), c("number").cast("int")).otherwise(c("ord")).alias("ord"), "level", "list_start", "col_span", "row_span", "scope", F.filter(F.split("headers", r"\s+"), lambda x: x != "").alias("headers"), "alt_text", "resource", "source_id", c("node_ord").alias("node_no"), archive_path(directory(c("resource")), c("source")).alias("asset_path"))


def inlines(rows: DataFrame) -> DataFrame:
    """CNV26, TRE3: doc_id, owner_id, inline_ord, parent_ord, kind, value, target, mode, resource of chapter rows."""
    known = rows.where("row_kind = 'inline'")
    resources = numbered(rows.where("row_kind = 'node'").select("doc_id", "resource").distinct(), ["doc_id"], ["resource"], "number").select(c("doc_id").alias("rd"), c("resource").alias("rr"), "number")
    both = known.join(resources, c("doc_id").eqNullSafe(c("rd")) & c("resource").eqNullSafe(c("rr")))
    return both.select("doc_id", F.concat(F.lit("n"), c("number").cast("string"), F.lit("-"), c("node_ord").cast("string")).alias("owner_id"), "inline_ord", "parent_ord", "kind", "value", "target", "mode", "resource")


def source_map(node_rows: DataFrame) -> DataFrame:
    """JON13, CNV29, WIN5: doc_id, resource, fragment, node_id, occurrence: the places nodes come from; each resource leads to its first."""
    own = node_rows.where("source_id IS NOT NULL").select("doc_id", "resource", c("source_id").alias("fragment"), "node_id", "node_type", "node_no")
    whole = node_rows.where("parent_id IS NULL").select("doc_id", "resource", F.lit(None).cast("string").alias("fragment"), "node_id", "node_type", "node_no")
    return numbered(own.unionByName(whole), ["doc_id", "resource", "fragment"], ["node_no"], "occurrence")


def resolved_links(inline_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """JON8–11, CNV27: links with link_kind (external, internal, broken, unsafe) and the node an internal one leads to; of places
    with one fragment the first counts."""
    links = inline_rows.where("kind IN ('link', 'footnote-reference')").withColumn("__key", reference_key(c("resource"), c("target")))
    places = source_map(node_rows).where("occurrence = 1").select(c("doc_id").alias("pd"), F.concat_ws("#", "resource", "fragment").alias("pk"), c("node_id").alias("target_id"), c("node_type").alias("target_type"))
    both = links.join(places, (c("doc_id") == c("pd")) & (c("__key.key") == c("pk")), "left")
    kind = F.when(is_external(c("target")), "external").when(c("target_id").isNotNull(), "internal").when(c("__key").isNotNull(), "broken").otherwise("unsafe")
    return both.select(*inline_rows.columns, kind.alias("link_kind"), "target_id", "target_type", unescaped(F.split("target", "#", 2)[1]).alias("fragment"))


def linked_inlines(inline_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """All inline rows, the links among them with where they lead."""
    rest = inline_rows.where("kind NOT IN ('link', 'footnote-reference')")
    return resolved_links(inline_rows, node_rows).unionByName(rest, allowMissingColumns=True)
