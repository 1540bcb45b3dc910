"""Queries over packages. The tables hold none, so two are built here and one is broken."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.plans.scalars import _listed
from quirespark.sources import packages as p

c = F.col
_CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata>
<dc:identifier>urn:other</dc:identifier><dc:identifier id="uid"> urn:isbn:9780000000001 </dc:identifier><dc:title id="t2">Second   title</dc:title><dc:title id="t1">First title</dc:title><dc:title id="t3">Below</dc:title>
<meta refines="#t1" property="display-seq">1</meta><meta refines="#t2" property="display-seq">2</meta><meta refines="#t2" property="display-seq">3</meta><meta refines="#t3" property="title-type">subtitle</meta><meta refines="#gone" property="role">aut</meta>
<dc:creator id="a">Ann Author</dc:creator><dc:creator id="b">Ed Editor</dc:creator><dc:creator>Nobody Known</dc:creator><meta refines="#a" property="role">AUT</meta><meta refines="#a" property="role">aut</meta><meta refines="#b" property="role">edt</meta>
<dc:language>not a tag</dc:language><dc:language>pt-BR</dc:language><dc:date>1999-12</dc:date><dc:date>soon</dc:date><meta property="dcterms:modified">2024-01-02T03:04:05Z</meta><meta property="schema:accessMode">textual</meta></metadata>
<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c1" href="text/c%201.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/c2.xhtml" media-type="application/xhtml+xml" fallback="c1"/>
<item id="again" href="text/../text/c%201.xhtml" media-type="application/xhtml+xml"/><item id="bin" href="x.bin" media-type="application/octet-stream"/><item id="out" href="../../x.css" media-type="text/css"/></manifest>
<spine><itemref idref="c1"/><itemref idref="c2" linear="no"/><itemref idref="c1"/><itemref idref="none"/></spine></package>"""


def _archive(files: list[tuple[str, bytes]]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in files:
            archive.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data, compress_type=zipfile.ZIP_DEFLATED)
    return held.getvalue()


def _files(spark: SparkSession) -> DataFrame:
    good = _archive([("mimetype", b"application/epub+zip"), (p.CONTAINER, _CONTAINER.encode()), ("OEBPS/content.opf", _OPF.encode()), ("OEBPS/nav.xhtml", b"<html/>"), ("OEBPS/text/c 1.xhtml", b"<html/>"), ("OEBPS/x.bin", b"\0")])
    entity = '<!DOCTYPE package [<!ENTITY e "x">]>' + _OPF
    unsafe = _archive([(p.CONTAINER, _CONTAINER.encode()), ("OEBPS/content.opf", entity.encode()), ("../evil", b"x"), ("zeros", b"\0" * 500_000)])
    return spark.createDataFrame([("good", bytearray(good)), ("unsafe", bytearray(unsafe)), ("broken", bytearray(good[:200])), ("empty", None)], "pub_id string, content binary")


def src_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1–3, WIN12: the entries of archives with what is wrong with them."""
    return p.entries(_files(spark)).select("pub_id", "ordinal", "path", "len", "problem")


def src_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: where the descriptions are."""
    return p.package_paths(p.entries(_files(spark)))


def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4–6, SRC8, SRC10, JON1, FLT17: the items of descriptions; one with entities gives none."""
    entries = p.entries(_files(spark))
    return p.manifest(p.package_elements(entries), entries).select("pub_id", "item_id", "path", "exists", "is_supported", "is_duplicate", "fallback_id")


def src_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, JON2, FLT18, WIN3: the reading order."""
    entries = p.entries(_files(spark))
    elements = p.package_elements(entries)
    return p.spine(elements, p.manifest(elements, entries))


def met_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET2, MET4, MET10, JON6: titles with what refines them."""
    t = p.refined(p.package_elements(p.entries(_files(spark))), "dc:title", ["title-type", "display-seq"])
    return t.select("pub_id", "xml_id", "value", "title_type", "display_seq", F.array_join("repeated", ",").alias("repeated"))


def met_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET1, MET3–9, JON7, SRT4: the metadata of descriptions."""
    m = p.metadata(p.package_elements(p.entries(_files(spark))))
    return m.select("pub_id", "title", "subtitle", "identifier", "language", F.array_join("authors", "; ").alias("authors"), "modified", "n_dates", "n_bad_dates", F.array_join("accessibility", "; ").alias("accessibility"))


def met_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET2: refinements of what isn't there."""
    return p.refinements(p.package_elements(p.entries(_files(spark)))).where("is_orphan").select("pub_id", "target", "property", "value")


_NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="x">x</a></li></ol></nav><nav epub:type="toc"><ol><li id="a"><a href="text/c%201.xhtml">One</a>
<ol><li><a href="text/c%201.xhtml#s">Part   one</a></li><li id="a"><a href="again">circle</a></li></ol></li><li><span>Unlinked</span><ol><li><a href="../../out">Out</a></li></ol></li></ol></nav></body></html>"""
_NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint id="p1"><navLabel><text>First</text></navLabel><content src="a.xhtml"/><navPoint id="p2"><navLabel><text>Below</text></navLabel><content src="a.xhtml#b"/></navPoint></navPoint></navMap></ncx>"""
_OLD = """<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata/><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx"/></package>"""


def cnv_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, CNV3–6, TRE7, SRT5, JON8: the tables of contents of a package of the third and one of the second version."""
    new = _archive([(p.CONTAINER, _CONTAINER.encode()), ("OEBPS/content.opf", _OPF.encode()), ("OEBPS/nav.xhtml", _NAV.encode())])
    old = _archive([(p.CONTAINER, _CONTAINER.encode()), ("OEBPS/content.opf", _OLD.encode()), ("OEBPS/toc.ncx", _NCX.encode())])
    entries = p.entries(spark.createDataFrame([("new", bytearray(new)), ("old", bytearray(old))], "pub_id string, content binary"))
    return p.navigation(entries, p.manifest(p.package_elements(entries), entries))


_BIG = {"src_entries": " REPLACE (CAST(len AS BIGINT) AS len)", "met_read": " REPLACE (CAST(n_dates AS BIGINT) AS n_dates, CAST(n_bad_dates AS BIGINT) AS n_bad_dates)"}
_OPF_LEN = len(_OPF.encode())
QUERIES = {f.__name__: f for f in (src_entries, src_paths, src_manifest, src_spine, met_titles, met_read, met_orphans, cnv_contents)}
SQL = {
    name: f"SELECT *{_BIG.get(name, '')} FROM (VALUES {_listed(*rows)}) AS t({columns})"
    for name, columns, rows in (
        ("src_entries", "pub_id, ordinal, path, len, problem", [
            ("good", 0, "mimetype", 20, None), ("good", 1, p.CONTAINER, len(_CONTAINER), None), ("good", 2, "OEBPS/content.opf", _OPF_LEN, None), ("good", 3, "OEBPS/nav.xhtml", 7, None), ("good", 4, "OEBPS/text/c 1.xhtml", 7, None), ("good", 5, "OEBPS/x.bin", 1, None),
            ("unsafe", 0, p.CONTAINER, len(_CONTAINER), None), ("unsafe", 1, "OEBPS/content.opf", _OPF_LEN + 36, None), ("unsafe", 2, "../evil", 1, "unsafe-path"), ("unsafe", 3, "zeros", 500000, "suspicious-ratio"), ("broken", -1, None, None, "unreadable"), ("empty", -1, None, None, "unreadable"),
        ]),
        ("src_paths", "pub_id, opf_path", [("good", "OEBPS/content.opf"), ("unsafe", "OEBPS/content.opf"), ("broken", None), ("empty", None)]),
        ("src_manifest", "pub_id, item_id, path, \"exists\", is_supported, is_duplicate, fallback_id", [
            ("good", "nav", "OEBPS/nav.xhtml", True, True, False, None), ("good", "c1", "OEBPS/text/c 1.xhtml", True, True, False, None), ("good", "c2", "OEBPS/text/c2.xhtml", False, True, False, "c1"), ("good", "again", "OEBPS/text/c 1.xhtml", True, True, True, None),
            ("good", "bin", "OEBPS/x.bin", True, False, False, None), ("good", "out", None, False, True, False, None),
        ]),
        ("src_spine", "pub_id, position, idref, path, is_linear, occurrence, problem", [("good", 0, "c1", "OEBPS/text/c 1.xhtml", True, 1, None), ("good", 1, "c2", "OEBPS/text/c2.xhtml", False, 1, None), ("good", 2, "c1", "OEBPS/text/c 1.xhtml", True, 2, "repeated"), ("good", 3, "none", None, True, 1, "unresolved")]),
        ("met_titles", "pub_id, xml_id, value, title_type, display_seq, repeated", [("good", "t2", "Second title", None, "2", "display-seq"), ("good", "t1", "First title", None, "1", ""), ("good", "t3", "Below", "subtitle", None, "")]),
        ("met_read", "pub_id, title, subtitle, identifier, language, authors, modified, n_dates, n_bad_dates, accessibility", [("good", "First title", "Below", "urn:isbn:9780000000001", "pt-BR", "Ann Author; Nobody Known", "2024-01-02T03:04:05Z", 2, 1, "schema:accessMode=textual")]),
        ("cnv_contents", "pub_id, place, level, label, target, key, kind", [
            ("new", 0, 1, "One", "OEBPS/text/c 1.xhtml", "OEBPS/text/c 1.xhtml", "nav"), ("new", 1, 2, "Part one", "OEBPS/text/c 1.xhtml", "OEBPS/text/c 1.xhtml#s", "nav"), ("new", 3, 2, "Out", None, None, "nav"),
            ("old", 0, 1, "First", "OEBPS/a.xhtml", "OEBPS/a.xhtml", "ncx"), ("old", 1, 2, "Below", "OEBPS/a.xhtml", "OEBPS/a.xhtml#b", "ncx"),
        ]),
        ("met_orphans", "pub_id, target, property, value", [("good", "gone", "role", "aut")]),
    )
}
