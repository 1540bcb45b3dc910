"""Queries of the column functions: over whole tables where these hold such values, otherwise over listed cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import identifiers as ids
from quirespark.functions import kinds, paths, text
from quirespark.session import table


def _listed(*rows: tuple) -> str:
    """Rows as SQL both engines read."""

    def one(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, float):
            return f"CAST({value} AS DOUBLE)"
        return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


class Cases:
    """Listed inputs with the results that are due: a query that reckons them, and SQL that states them."""

    def __init__(self, inputs: str, outputs: str, rows: list[tuple], reckon: Callable[[], list[Column]]) -> None:
        self.names, self.results = inputs.split(), outputs.split()
        self.rows, self.reckon = rows, reckon

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        held = [r[: len(self.names)] for r in self.rows]
        schema = ", ".join(f"{n} {'bigint' if all(isinstance(r[i], int) or r[i] is None for r in held) else 'string'}" for i, n in enumerate(self.names))
        df = spark.createDataFrame(held, schema)
        return df.select(*self.names, *[c.alias(n) for c, n in zip(self.reckon(), self.results, strict=True)])

    def sql(self) -> str:
        return f"SELECT * FROM (VALUES {_listed(*self.rows)}) AS t({', '.join([*self.names, *self.results])})"


def scl_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL22–24, SCL28, SCL41, SCL45 and the UTF-16 length over all texts."""
    body = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.sha256_hex(text.normalized(body)).alias("normalized_sha256"), text.optional_text(body).isNull().alias("is_blank"), text.significant(body).alias("n_significant"),
        text.is_visible(body).alias("is_visible"), text.utf16_length(body).alias("n_utf16"), text.sha256_hex(text.html_escaped(body)).alias("escaped_sha256"),
    )


_SPACE = text.SPACE
SCL_TEXT = f"""
SELECT doc_id, upper(sha256(n)) AS normalized_sha256, n IS NULL OR n = '' AS is_blank, CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS n_significant,
  coalesce(regexp_matches(text, '{text.VISIBLE}'), false) AS is_visible,
  CAST(length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT) AS n_utf16,
  upper(sha256(array_to_string(list_transform(string_split(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), ''),
    lambda c: CASE WHEN c <> '' AND (unicode(c) BETWEEN 160 AND 255 OR unicode(c) >= 65536) THEN '&#' || unicode(c) || ';' ELSE c END), ''))) AS escaped_sha256
FROM (SELECT *, regexp_replace(regexp_replace(text, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS n FROM documents)"""


def scl_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL30, SCL31 over all tags of records and titles."""
    tags = table(spark, sf_dir, "metadata_results").select("language_tag").unionAll(table(spark, sf_dir, "title_metadata").select("language_tag"))
    counted = tags.groupBy("language_tag").agg(F.count("*").alias("n_rows"))
    return counted.select("language_tag", "n_rows", kinds.is_language(F.col("language_tag")).alias("is_language"), kinds.language_tag(F.col("language_tag")).alias("usual_tag"))


SCL_LANGUAGES = f"""
SELECT language_tag, n_rows, regexp_matches(language_tag, '{kinds.LANGUAGE}') AS is_language,
  CASE WHEN regexp_matches(language_tag, '{kinds.LANGUAGE}') THEN array_to_string(list_transform(string_split(language_tag, '-'), lambda x, i: CASE WHEN i = 1 THEN lower(x)
    WHEN regexp_matches(x, '^[A-Za-z]{{4}}$') THEN upper(x[1]) || lower(x[2:]) WHEN regexp_matches(x, '^[A-Za-z]{{2}}$') THEN upper(x) ELSE lower(x) END), '-') END AS usual_tag
FROM (SELECT language_tag, count(*) AS n_rows FROM (SELECT language_tag FROM metadata_results UNION ALL SELECT language_tag FROM title_metadata) GROUP BY language_tag)"""


def scl_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL4, SCL13, SCL34, SCL47–50 over the catalog."""
    c = F.col
    return table(spark, sf_dir, "corpus_catalog").select(
        ids.publication_id(c("pub_id")).alias("pub_id"), ids.document_id(c("document_id")).alias("document_id"), ids.sha256_value(c("sha256")).alias("sha256"),
        paths.is_safe_relative(c("relative_path")).alias("is_safe"), paths.directory(c("relative_path")).alias("directory"), kinds.version_family(F.substring("expected_epub_version", 5, 9)).alias("family"),
        ids.document_id_or_generated(c("title"), c("relative_path")).alias("made_id"), text.hash_of_values(c("languages")).alias("languages_sha256"),
    )


SCL_CATALOG = r"""
SELECT CASE WHEN regexp_matches(pub_id, '^[a-z0-9][a-z0-9._-]{0,63}$') THEN pub_id END AS pub_id,
  CASE WHEN regexp_matches(document_id, '^[A-Za-z][A-Za-z0-9+.-]*:.') AND length(document_id) <= 512 THEN document_id END AS document_id,
  CASE WHEN regexp_matches(sha256, '^[0-9A-Fa-f]{64}$') THEN upper(sha256) END AS sha256,
  trim(relative_path) <> '' AND NOT regexp_matches(relative_path, '^/|\\|:|//|/$|(^|/)\.\.?(/|$)') AS is_safe,
  regexp_extract(relative_path, '^(.*)/', 1) AS directory,
  CASE WHEN expected_epub_version LIKE 'epub2%' THEN 'Epub2' WHEN expected_epub_version LIKE 'epub3%' THEN 'Epub3' ELSE 'Unknown' END AS family,
  CASE WHEN regexp_matches(title, '^[A-Za-z][A-Za-z0-9+.-]*:.') THEN title ELSE 'urn:flow:epub:' || sha256(coalesce(title, relative_path)) END AS made_id,
  upper(sha256(unhex(array_to_string(list_transform(languages, lambda x: printf('%08X', strlen(x)) || hex(x)), '')))) AS languages_sha256
FROM corpus_catalog"""


def scl_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL1, SCL7, SCL8 (the base), SCL29, SCL42 over all titles."""
    value = F.col("title_value")
    return table(spark, sf_dir, "title_metadata").select(
        "title_id", ids.slug(value).alias("slug"), ids.id_base(value).alias("id_base"), ids.is_stable_id(ids.id_base(value)).alias("is_stable"),
        text.is_ncname(F.col("xml_id")).alias("is_ncname"), text.css_string(value).alias("css_string"), text.has_token(F.col("title_type"), "MAIN").alias("is_main"),
        text.has_token_exactly(F.col("title_type"), "MAIN").alias("is_exactly_main"),
    )


SCL_SLUGS = r"""
SELECT title_id, slug, id_base, regexp_matches(id_base, '^[a-z][a-z0-9._-]{0,127}$') AS is_stable, regexp_matches(xml_id, '^[\pL_][\pL\pM\pN._-]*$') AS is_ncname,
  '"' || replace(replace(replace(replace(title_value, '\', '\\'), '"', '\"'), chr(10), '\a '), chr(13), '\d ') || '"' AS css_string,
  coalesce(lower(title_type) = 'main', false) AS is_main, coalesce(title_type = 'MAIN', false) AS is_exactly_main
FROM (SELECT *, regexp_replace(substr(CASE WHEN regexp_matches(slug, '^[a-z]') THEN slug ELSE 'epub-' || slug END, 1, 112), '[-_.]+$', '') AS id_base
  FROM (SELECT *, regexp_replace(regexp_replace(lower(title_value), '[^a-z0-9._]+', '-', 'g'), '^[-_.]+|[-_.]+$', '', 'g') AS slug FROM title_metadata))"""


def scl_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL9–11, SCL15, SCL16, SCL39 over all resources that diagnostics name."""
    resource = F.col("resource")
    key = paths.reference_key(resource, F.lit("../images/a%20b.png#top"))
    return (
        table(spark, sf_dir, "diagnostics").groupBy("resource").agg(F.count("*").alias("n_rows")).select(
            "resource", "n_rows", paths.directory(resource).alias("directory"), paths.archive_path(F.lit("OEBPS"), F.concat(F.lit("./x/../"), resource, F.lit("?v=1#f"))).alias("inside"),
            key["target"].alias("target"), key["key"].alias("key"), paths.relative_reference(resource, F.lit("OEBPS/nav.xhtml")).alias("to_nav"),
            paths.resolved_path(resource, F.lit("../css/./main.css")).alias("style"), paths.root_path(F.concat(F.lit("/"), resource)).alias("root_path"),
        )
    )


SCL_RESOURCES = r"""
SELECT resource, n_rows, coalesce(directory, CASE WHEN resource IS NOT NULL THEN '' END) AS directory, 'OEBPS/' || resource AS inside,
  up || 'images/a b.png' AS target, up || 'images/a b.png#top' AS key,
  CASE WHEN resource IS NULL THEN NULL WHEN resource LIKE 'OEBPS/%' THEN repeat('../', depth - 1) || 'nav.xhtml' ELSE repeat('../', depth) || 'OEBPS/nav.xhtml' END AS to_nav,
  up || 'css/main.css' AS style, resource AS root_path
FROM (SELECT *, CASE WHEN depth >= 1 THEN array_to_string(list_append(string_split(resource, '/')[1:depth - 1], ''), '/') END AS up,
    CASE WHEN depth >= 1 THEN array_to_string(string_split(resource, '/')[1:depth], '/') END AS directory
  FROM (SELECT resource, count(*) AS n_rows, length(resource) - length(replace(resource, '/', '')) AS depth FROM diagnostics GROUP BY resource))"""


def scl_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL43, SCL44, SCL53 over the left copy of the baseline."""
    kept = F.col("nodes") - F.col("lost")
    sums = table(spark, sf_dir, "baseline_left").groupBy("status").agg(
        kinds.saturating_sum(F.col("imported_node_count").cast("decimal(20,0)") * F.lit(10**14).cast("decimal(15,0)")).alias("huge"), F.sum("imported_node_count").alias("nodes"), F.sum(F.least("fidelity_lost_unit_count", "imported_node_count")).alias("lost")
    )
    length = kinds.scaled_length(F.struct(F.col("nodes").cast("double").alias("value"), F.lit("px").alias("unit")), F.lit(1.5))
    return sums.select("status", "huge", "nodes", "lost", kinds.preserved_percentage(kept, F.col("nodes")).alias("kept_percent"), length["value"].alias("scaled"), text.css_length(length["value"], length["unit"]).alias("css"))


SCL_NUMBERS = """
SELECT status, CAST(least(huge, 9223372036854775807) AS BIGINT) AS huge, CAST(nodes AS BIGINT) AS nodes, CAST(lost AS BIGINT) AS lost,
  CASE WHEN nodes = 0 THEN 100.0 ELSE CAST((CAST(nodes - lost AS HUGEINT) * 100000000) // nodes AS DOUBLE) / 1000000 END AS kept_percent, CAST(nodes AS DOUBLE) * 1.5 AS scaled,
  regexp_replace(CAST(CAST(CAST(nodes AS DOUBLE) * 1.5 AS DECIMAL(30,1)) AS VARCHAR), '\\.0$', '') || 'px' AS css
FROM (SELECT status, sum(CAST(imported_node_count AS HUGEINT) * 100000000000000) AS huge, sum(imported_node_count) AS nodes,
  sum(least(fidelity_lost_unit_count, imported_node_count)) AS lost FROM baseline_left GROUP BY status)"""

c = F.col
CASES = {
    "scl_ids": Cases("value", "node_id anchor_target made", [
        ("chapter-1", "chapter-1", None, "chapter-1"), ("", None, None, "epub"), (" ", None, None, "epub"), ("Chapter", None, None, "chapter"), ("1-chapter", None, None, "epub-1-chapter"),
        ("chapter/introduction", None, None, "chapter-introduction"), ("chapter introduction", None, None, "chapter-introduction"), ("a" * 128, "a" * 128, None, "a" * 112), ("a" * 129, None, None, "a" * 112),
        ("flow:a/b-1", None, "b-1", "flow-a-b-1"), ("flow:", None, None, "flow"), ("flow:a//b", None, None, "flow-a-b"), ("flow:A", None, None, "flow-a"), ("flow:" + "/".join(["a"] * 64), None, "a", "flow" + "-a" * 54),
        ("flow:" + "/".join(["a"] * 65), None, None, "flow" + "-a" * 54), (None, None, None, None),
    ], lambda: [ids.node_id(c("value")), ids.anchor_target(c("value")), ids.id_base(c("value"))]),
    "scl_anchors": Cases("one other", "anchor", [("a", "b", "flow:a/b"), ("a", "B", None), ("a", None, None), ("", "a", None)], lambda: [ids.anchor(F.array("one", "other"))]),
    "scl_paths": Cases("base value", "path root safe escapes", [
        ("OEBPS", "text/a.xhtml", "OEBPS/text/a.xhtml", "text/a.xhtml", True, True), ("OEBPS/text", "../img/./b.png#x", "OEBPS/img/b.png", None, False, True), ("", "../a", None, None, False, True),
        ("a", "../..", None, None, False, True), ("a", "/rooted", None, "rooted", False, True), ("a", "b\\c", None, None, False, True), ("a", "http://h/x", None, None, False, True), ("a", "b%20c+d", "a/b c+d", "b c+d", True, True),
        ("a", "b%2Fc", "a/b/c", "b/c", True, True), ("a", "b%zz", "a/b%zz", "b%zz", False, False), ("a", "%2e%2e/x", "x", None, False, True), ("a", "x:y", None, None, False, True), ("a", "", None, None, False, True),
        ("a", "?q", "a", "?q", True, True), ("a", "b//c", "a/b/c", "b/c", False, True), (None, "x", "x", "x", True, True), ("a", None, None, None, False, None),
    ], lambda: [paths.archive_path(c("base"), c("value")), paths.root_path(c("value")), paths.is_safe_relative(c("value")), paths.has_valid_escapes(c("value"))]),
    "scl_keys": Cases("source href", "target key", [
        ("OEBPS/text/a.xhtml", "b.xhtml#n1", "OEBPS/text/b.xhtml", "OEBPS/text/b.xhtml#n1"), ("OEBPS/text/a.xhtml", "#n%201", "OEBPS/text/a.xhtml", "OEBPS/text/a.xhtml#n 1"), ("OEBPS/a.xhtml", "../c.xhtml", "c.xhtml", "c.xhtml"),
        ("a.xhtml", "../c.xhtml", None, None), ("a.xhtml", "b.xhtml#", None, None), ("a.xhtml", "https://example.org/x", None, None), ("a.xhtml", " ", None, None), ("a.xhtml", None, None, None),
    ], lambda: [paths.reference_key(c("source"), c("href"))["target"], paths.reference_key(c("source"), c("href"))["key"]]),
    "scl_relative": Cases("source target", "reference back", [
        ("index.html", "chapters/c1.html", "chapters/c1.html", "chapters/c1.html"), ("chapters/c1.html", "index.html", "../index.html", "index.html"), ("a/b/c.html", "a/d/e.html", "../d/e.html", "a/d/e.html"),
        ("a/b.html", "a/b.html", "b.html", "a/b.html"), ("a/b/c/d", "x", "../../../x", "x"),
    ], lambda: [paths.relative_reference(c("source"), c("target")), paths.resolved_path(c("source"), paths.relative_reference(c("source"), c("target")))]),
    "scl_links": Cases("href", "external safe output figure", [
        ("https://example.org/a?b#c", True, True, "https://example.org/a?b#c", "https://example.org/a?b#c"), ("HTTP://example.org", True, True, "HTTP://example.org", "HTTP://example.org"), ("tel:+49123", True, False, None, None),
        ("mailto:a@example.org", True, True, "mailto:a@example.org", "mailto:a@example.org"), ("mailto:", False, False, None, None), ("mailto:a b@example.org", False, False, None, None), ("mailto:a%0Ab@example.org", False, False, None, None),
        ("javascript:alert(1)", False, False, None, None), ("ftp://example.org/x", False, False, None, None), ("chapter.xhtml#x", False, False, None, None), ("flow:c1/n2", False, False, "#n2", "flow:c1/n2"), ("#n2", False, False, "#n2", None),
        ("#N2", False, False, None, None), ("http:", False, False, None, None), ("", False, False, None, None), (None, False, False, None, None),
    ], lambda: [paths.is_external(c("href")), paths.is_safe_external(c("href")), paths.safe_href(c("href")), F.coalesce(paths.figure_link(c("href"))["anchor"], paths.figure_link(c("href"))["uri"])]),
    "scl_media": Cases("media_type", "normal matches_jpeg ending safe is_font is_page_map is_supported", [
        ("image/JPEG; q=1", "image/jpeg", True, ".bin", "application/octet-stream", False, False, True), ("image/pjpeg", "image/pjpeg", True, ".bin", "image/pjpeg", False, False, True), ("image/svg+xml", "image/svg+xml", False, ".svg", "image/svg+xml", False, False, True),
        ("Font/WOFF2", "font/woff2", False, ".bin", "application/octet-stream", True, False, True), ("application/oebps-page-map+xml", "application/oebps-page-map+xml", False, ".bin", "application/octet-stream", False, True, True),
        ("text/css", "text/css", False, ".bin", "application/octet-stream", False, False, True), ("application/pdf", "application/pdf", False, ".bin", "application/octet-stream", False, False, False), ("image/png", "image/png", False, ".png", "image/png", False, False, True),
        ("image/x onload=1", "image/x onload=1", False, ".bin", "application/octet-stream", False, False, True), (None, None, None, ".bin", "application/octet-stream", None, None, None),
    ], lambda: [kinds.media_type(c("media_type")), kinds.media_type_matches(c("media_type"), F.lit("image/jpeg")), kinds.file_extension(c("media_type")), kinds.safe_media_type(c("media_type")), kinds.is_font(c("media_type")), kinds.is_page_map(c("media_type")), kinds.is_supported(c("media_type"), F.lit(False))]),
    "scl_dates": Cases("value", "is_date direction", [
        ("1999", True, None), ("1999-12", True, None), ("1999-13", False, None), ("2024-02-29", True, None), ("2023-02-29", False, None), ("2024-01-02T03:04:05Z", True, None), ("2024-01-02T03:04:05+02:00", True, None), ("2024-01-02T25:00:00Z", False, None),
        ("soon", False, None), ("", False, None), (" RTL ", False, "rtl"), ("auto", False, "auto"), ("ltr", False, "ltr"), ("up", False, None),
    ], lambda: [F.coalesce(kinds.is_date(c("value")), F.lit(False)), kinds.text_direction(c("value"))]),
    "scl_codes": Cases("code", "is_asset_code", [("EPUB038", True), ("EPUB046", True), ("EPUB047", False), ("EPUB38", False), ("EPI040", False), ("EPUB0400", False), ("EPUBx40", False), (None, False)], lambda: [ids.code_between(c("code"), 38, 46)]),
    "scl_quoting": Cases("argument", "posix cmd", [("book.epub", "book.epub", "book.epub"), ("my book.epub", "'my book.epub'", '"my book.epub"'), ("it's", "'it''s'", '"it\'s"'), ('say "x"', "'say \"x\"'", '"say ""x"""'), ("", "''", '""')], lambda: [kinds.quoted_argument(c("argument"), "posix"), kinds.quoted_argument(c("argument"), "cmd")]),
}

VERSIONS = ["1.0.0", "v1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "0.9.10", "0.9.9", "2.0.0+b5", "10.0.0", "1.0", "01.0.0", "x", ""]


def scl_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL52, SRT10: versions in their order; what is none has no place."""
    df = spark.createDataFrame([(v,) for v in VERSIONS], "version string").withColumn("parsed", ids.semantic_version(F.col("version")))
    lower = df.select(F.col("parsed").alias("other")).where("other IS NOT NULL")
    placed = df.where("parsed IS NOT NULL").join(lower, F.col("other") < F.col("parsed"), "left").groupBy("version").agg(F.count("other").alias("n_lower"))
    return df.join(placed, "version", "left").select("version", "n_lower")


SCL_VERSIONS = "SELECT * FROM (VALUES " + _listed(
    ("0.9.9", 0), ("0.9.10", 1), ("v1.0.0-alpha", 2), ("1.0.0-alpha.1", 3), ("1.0.0-alpha.beta", 4), ("1.0.0-beta", 5), ("1.0.0-beta.2", 6), ("1.0.0-beta.11", 7), ("1.0.0-rc.1", 8), ("1.0.0", 9), ("2.0.0+b5", 10), ("10.0.0", 11),
    ("1.0", None), ("01.0.0", None), ("x", None), ("", None),
) + ") AS t(version, n_lower)"

QUERIES = {"scl_text": scl_text, "scl_languages": scl_languages, "scl_catalog": scl_catalog, "scl_slugs": scl_slugs, "scl_resources": scl_resources, "scl_numbers": scl_numbers, "scl_versions": scl_versions}
QUERIES |= {name: case.query for name, case in CASES.items()}
SQL = {"scl_text": SCL_TEXT, "scl_languages": SCL_LANGUAGES, "scl_catalog": SCL_CATALOG, "scl_slugs": SCL_SLUGS, "scl_resources": SCL_RESOURCES, "scl_numbers": SCL_NUMBERS, "scl_versions": SCL_VERSIONS}
SQL |= {name: case.sql() for name, case in CASES.items()}
