"""What is done with a folder of packages as a whole, each step as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions.text import sha256_hex
from quirespark.operators import rendering, validation
from quirespark.operators.chains import tree_index
from quirespark.operators.measures import normalized_levels
from quirespark.operators.ordered import numbered, preceded
from quirespark.session import cut
from quirespark.sources import packages, xhtml

c = F.col


@dataclass
class Library:
    """The packages of a folder (or rows of pub_id, content). Tables are made when they are asked for, and once."""

    files: DataFrame

    @cached_property
    def entries(self) -> DataFrame:
        return cut(packages.entries(self.files))

    @cached_property
    def elements(self) -> DataFrame:
        return cut(packages.package_elements(self.entries))

    @cached_property
    def manifest(self) -> DataFrame:
        return packages.manifest(self.elements, self.entries)

    @cached_property
    def spine(self) -> DataFrame:
        return packages.spine(self.elements, self.manifest)

    @cached_property
    def metadata(self) -> DataFrame:
        return packages.metadata(self.elements)

    @cached_property
    def rows(self) -> DataFrame:
        """The rows of all chapters in the reading order, each once."""
        read = self.spine.where("path IS NOT NULL").select(c("pub_id").alias("sp"), c("path").alias("ss")).distinct()
        chapters = self.entries.where("problem IS NULL").join(read, (c("pub_id") == c("sp")) & (c("path") == c("ss")))
        return xhtml.chapter_rows(chapters.select(c("pub_id").alias("doc_id"), c("path").alias("resource"), "data"))

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(xhtml.nodes(self.rows))

    @cached_property
    def inlines(self) -> DataFrame:
        return cut(xhtml.inlines(self.rows))

    @cached_property
    def links(self) -> DataFrame:
        return xhtml.resolved_links(self.inlines, self.nodes)

    @cached_property
    def assets(self) -> DataFrame:
        """The images of the packages: doc_id, path, media_type, sha256."""
        held = self.manifest.where("exists AND media_type LIKE 'image/%'").select(c("pub_id").alias("mp"), c("path").alias("ms"), "media_type")
        return self.entries.join(held, (c("pub_id") == c("mp")) & (c("path") == c("ms"))).select(c("pub_id").alias("doc_id"), "path", "media_type", sha256_hex(c("data")).alias("sha256"))


def library(spark: SparkSession, path: str) -> Library:
    """API2, SRC7, SRC20: the packages below a path."""
    return Library(packages.package_files(spark, path))


def inspected(of: Library) -> DataFrame:
    """API1, SRC7, AGG15, AGG36: of each package its version, entries, bytes, items, places in the reading order and what is wrong."""
    sizes = of.entries.groupBy("pub_id").agg(F.count_if(c("ordinal") >= 0).alias("n_entries"), F.sum("len").alias("n_bytes"), F.array_sort(F.collect_set("problem")).alias("problems"))
    version = of.elements.where("section = 'package'").select(c("pub_id").alias("vp"), c("value").alias("version"))
    items = of.manifest.groupBy(c("pub_id").alias("mp")).agg(F.count("*").alias("n_items"), F.count_if(~c("exists")).alias("n_missing"), F.count_if(~c("is_supported")).alias("n_unsupported"), F.count_if("is_duplicate").alias("n_duplicate"))
    places = of.spine.groupBy(c("pub_id").alias("sp")).agg(F.count("*").alias("n_places"), F.count_if("is_linear").alias("n_linear"), F.count("problem").alias("n_broken"))
    out = sizes
    for part, key in ((version, "vp"), (items, "mp"), (places, "sp")):
        out = out.join(part, c("pub_id") == c(key), "left").drop(key)
    return out


def validated(of: Library) -> DataFrame:
    """API3: the findings of all rules over the documents."""
    spark = of.nodes.sparkSession
    unresolved = of.links.where("link_kind = 'broken'").select("doc_id", F.lit(6).alias("pass_no"), F.lit(validation.CODE_PREFIX + "UNRESOLVED_ANCHOR").alias("code"), c("owner_id").alias("node_id"), c("target").alias("detail"))
    covers, entries = spark.createDataFrame([], "doc_id string, figure_id string"), spark.createDataFrame([], "doc_id string, owner_id string, target string, level int, max_depth int")
    rules = validation.validated(of.nodes.withColumn("asset_id", c("asset_path")).withColumn("headers", c("headers")), of.inlines.where("kind <> 'footnote-reference'"), of.assets.withColumn("asset_id", c("path")), covers, entries)
    notes = of.links.where("kind = 'footnote-reference' AND coalesce(target_type, '') <> 'footnote'").select("doc_id", F.lit(6).alias("pass_no"), F.lit(validation.CODE_PREFIX + "UNRESOLVED_FOOTNOTE_REFERENCE").alias("code"), c("owner_id").alias("node_id"), c("target").alias("detail"))
    # headers name the cells' own identifiers in the chapter, not those of nodes
    return rules.where(~c("code").endswith("TABLE_HEADER_REFERENCE")).unionByName(unresolved).unionByName(notes)


def hashed(of: Library) -> DataFrame:
    """API4: the digest of each document."""
    return rendering.document_hashes(of.nodes, of.inlines)


def rendered(of: Library) -> DataFrame:
    """API5: the page of each chapter."""
    return rendering.pages(of.nodes, xhtml.linked_inlines(of.inlines, of.nodes))


def book(of: Library) -> DataFrame:
    """API6, SNK5, SNK6, RND8, RND14, RND17, RND18, WIN8, WIN9: of each document its pages in the reading order: file_name, title,
    previous and following, progress, html, media_type and sha256 of the bytes."""
    order = of.spine.where("path IS NOT NULL").groupBy("pub_id", c("path").alias("of_path")).agg(F.min("position").alias("position"))
    pages = rendered(of).join(order, (c("doc_id") == c("pub_id")) & (c("resource") == c("of_path"))).select("doc_id", "resource", "position", "html")
    named = numbered(cut(pages), ["doc_id"], ["position"]).withColumn("file_name", F.format_string("chapters/chapter-%03d.html", "number"))
    both = preceded(named, ["doc_id"], ["position"], {"previous": "file_name"})
    counts = named.groupBy(c("doc_id").alias("cd")).agg(F.count("*").alias("n"))
    headings = of.nodes.where("node_type = 'heading'").groupBy(c("doc_id").alias("hd"), c("resource").alias("hr")).agg(F.min_by("node_id", "node_no").alias("heading"))
    texts = of.inlines.where("kind = 'text'").groupBy(c("doc_id").alias("td"), c("owner_id").alias("tn")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inline_ord", "value"))), lambda x: x["value"]), "").alias("title"))
    titles = headings.join(texts, (c("hd") == c("td")) & (c("heading") == c("tn")), "left").select("hd", "hr", "title")
    out = both.join(counts, c("doc_id") == c("cd")).join(titles, (c("doc_id") == c("hd")) & (c("resource") == c("hr")), "left")
    following = F.when(c("number") < c("n"), F.format_string("chapters/chapter-%03d.html", c("number") + 1))
    return out.select("doc_id", "resource", "file_name", F.trim("title").alias("title"), "previous", following.alias("following"), F.concat_ws(" / ", c("number").cast("string"), c("n").cast("string")).alias("progress"), F.lit("text/html").alias("media_type"), sha256_hex(c("html")).alias("sha256"), "html")


def contents(of: Library) -> DataFrame:
    """RND14, RND15, CNV3, CNV6: the headings of each document in the reading order with their normal levels: doc_id, place, level, title, target_id."""
    order = of.spine.where("path IS NOT NULL").groupBy("pub_id", c("path").alias("of_path")).agg(F.min("position").alias("position"))
    heads = tree_index(of.nodes).where("node_type = 'heading'").join(order, (c("doc_id") == c("pub_id")) & (c("resource") == c("of_path"))).select("doc_id", "node_id", "level", "position", "node_no")
    levels = numbered(normalized_levels(heads, ["doc_id"], ["position", "node_no"], "level"), ["doc_id"], ["position", "node_no"], "place")
    texts = of.inlines.where("kind = 'text'").groupBy(c("doc_id").alias("td"), c("owner_id").alias("tn")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inline_ord", "value"))), lambda x: x["value"]), "").alias("title"))
    return levels.join(texts, (c("doc_id") == c("td")) & (c("node_id") == c("tn")), "left").select("doc_id", "place", c("normal_level").alias("level"), F.trim("title").alias("title"), c("node_id").alias("target_id"))


def written(pages: DataFrame, path: str) -> None:
    """SNK4, SNK25, SNK26: rows as JSON lines below a path; a path that is there is replaced when all is written."""
    pages.write.mode("overwrite").json(path)
